"""Categories as 0/1 columns, by a dictionary that is kept with the model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: More categories of one column are refused: each is a model input.
MAX_CATEGORIES = 1000


def known_categories(rows: DataFrame, names: list[str]) -> dict[str, list[str]]:
    """The values of each column in the order of their code points; null is none of them.

    All columns are read in one pass, combined on the map side.
    """
    if not names:
        return {}
    cells = F.array(*[F.struct(F.lit(name).alias("name"), F.col(name).cast("string").alias("value")) for name in names])
    found = (
        rows.select(F.inline(cells))
        .where(F.col("value").isNotNull())
        .distinct()
        .limit(MAX_CATEGORIES * len(names) + 1)
        .collect()
    )
    known = {name: sorted(row["value"] for row in found if row["name"] == name) for name in names}
    for name, values in known.items():
        if len(values) > MAX_CATEGORIES:
            raise ValueError(f"{name} has more than {MAX_CATEGORIES} categories")
    return known


def one_hot_columns(known: dict[str, list[str]]) -> list[str]:
    """``<column>_<value>`` for every category but the first of its column.

    Names that differ in case only are one column to Spark, so they are refused like equal ones.
    """
    columns = [f"{name}_{value}" for name, values in known.items() for value in values[1:]]
    if len({column.lower() for column in columns}) < len(columns):
        raise ValueError(f"two categories share a column: {sorted(columns)}")
    return columns


def one_hot(rows: DataFrame, known: dict[str, list[str]], unseen: str = "first") -> DataFrame:
    """``rows`` with the columns of ``one_hot_columns``, 0 or 1; columns of these names are replaced.

    A value that is not in the dictionary counts as the first category, all zeros, or fails the
    query with ``unseen="fail"``. A null is all zeros.
    """
    if unseen not in ("first", "fail"):
        raise ValueError(f"unseen must be 'first' or 'fail', not {unseen!r}")
    one_hot_columns(known)
    made = {}
    for name, values in known.items():
        value = F.col(name).cast("string")
        if unseen == "fail":
            message = F.concat(F.lit(f"unknown category of {name}: "), value)
            value = F.when(value.isNull() | value.isin(values), value).otherwise(F.raise_error(message))
        for one in values[1:]:
            made[f"{name}_{one}"] = F.coalesce((value == one).cast("int"), F.lit(0))
    return rows.withColumns(made) if made else rows
