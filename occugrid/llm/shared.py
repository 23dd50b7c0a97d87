"""Column helpers that several operators use, and the readers of their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from occugrid.storage import written_table

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]"
MIN_LONG = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(text_col: str) -> Column:
    """The text, a null one being empty; never null itself."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{BLANK}+"), "")


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` mentions it."""
    return F.transform(F.array(value), body)[0]


def index_mask(size: Column) -> Column:
    """The low bits that hold any index below ``size``, set."""
    bits = F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(size, F.lit(1)) + 1)).cast("int"))
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits) - F.lit(1).cast("long")


def word_grams(words: Column, size: Column, k: int) -> Column:
    """A 64-bit hash of every run of ``k`` words; of all words where there are fewer, none of none.

    ``words`` and ``size`` must be columns of their own, not expressions: both are read once
    per element.
    """
    run = F.transform(
        F.sequence(F.lit(0), F.greatest(size - k, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]),
    )
    short = F.array(F.xxhash64(F.array_join(words, " "), F.lit("short")))
    none = F.array().cast("array<bigint>")
    return F.when(size == 0, none).when(size < k, short).otherwise(run)


def char_grams(df: DataFrame, texts: dict[str, str], k: int) -> DataFrame:
    """Adds a 64-bit hash of every run of ``k`` characters of the columns ``texts`` (text: new).

    ``k`` is a power of two: hashes of runs are paired to hashes of runs twice as long, so the
    work per character grows with the logarithm of ``k``. Of all characters where there are
    fewer, none of none.
    """
    if k & (k - 1):
        raise ValueError("k must be a power of two")
    out = df.withColumns({to: F.split(F.col(text), "") for text, to in texts.items()})
    width = 1
    while width < k:
        out = out.withColumns({to: _paired(F.col(to), width) for to in texts.values()})
        width *= 2
    none = F.array().cast("array<bigint>")
    return out.withColumns(
        {
            to: F.when(F.length(text) == 0, none)
            .when(F.length(text) < k, F.array(F.xxhash64(F.col(text), F.lit("short"))))
            .otherwise(F.slice(F.col(to), F.lit(1), F.greatest(F.length(text) - k + 1, F.lit(0))))
            for text, to in texts.items()
        }
    )


def _paired(runs: Column, width: int) -> Column:
    """Hashes of runs twice as long; past the last whole run they mean nothing."""
    return F.zip_with(
        runs,
        F.slice(runs, width + 1, F.greatest(F.size(runs) - width, F.lit(0))),
        lambda here, later: F.xxhash64(here, later),
    )


def ordered_chunks(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` range-partitioned by ``order`` and written once, with the number of the range.

    The ranges are sampled, so they hold like numbers of rows whatever the values; writing
    them fixes which row belongs to which range.
    """
    ranged = df.repartitionByRange(*order).withColumn("chunk", F.spark_partition_id())
    return written_table(ranged, name)


def running_sum(
    chunked: DataFrame, value: str, order: list[Column], group: list[str], to: str
) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the group, over a table of ``ordered_chunks``.

    Sums inside a chunk, then over the totals of earlier chunks: a group that holds most of
    the rows is still worked on chunk by chunk.
    """
    inside = Window.partitionBy(*group, "chunk").orderBy(*order)
    before = Window.partitionBy(*group).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        chunked.groupBy(*group, "chunk")
        .agg(F.sum(value).alias("__total"))
        .select(
            *[F.col(name).alias(f"__{name}") for name in [*group, "chunk"]],
            F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"),
        )
    )
    sums = chunked.withColumn(
        "__inside",
        F.coalesce(
            F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ),
    )
    same = F.col("chunk") == F.col("__chunk")
    for name in group:
        same &= F.col(name).eqNullSafe(F.col(f"__{name}"))
    return (
        sums.join(offsets, same)
        .withColumn(to, F.col("__inside") + F.col("__before"))
        .drop("__inside", "__before", "__chunk", *[f"__{name}" for name in group])
    )
