"""Lookups by a key of which a few values hold most of the rows."""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: A value is heavy from this share of the rows on.
HEAVY_SHARE = 0.001
SAMPLE = 0.01
#: Parts for each task that a value would fill, so that the parts fall evenly on the tasks.
PARTS_PER_TASK = 4
_SALT = "__salt"


def is_small(table: DataFrame) -> bool:
    """Whether Catalyst's estimate of ``table`` lies within its own threshold for a broadcast."""
    session = table.sparkSession._jsparkSession.sessionState()
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size <= session.conf().autoBroadcastJoinThreshold()


def heavy_values(
    rows: DataFrame, key: str, share: float = HEAVY_SHARE, fraction: float = SAMPLE, seed: int = 42
) -> dict:
    """Values of ``key`` with ``share`` of the rows or more and their shares, by a sample of ``fraction``.

    At most ``1 / share`` values reach the driver. A value that the sample misses or overrates costs
    time, never rows.
    """
    sampled = Observation()
    counted = (
        rows.where(F.col(key).isNotNull())
        .sample(fraction, seed)
        .groupBy(key)
        .agg(F.count("*").alias("n"))
        .observe(sampled, F.sum("n").alias("total"))
    )
    most = counted.orderBy(F.desc("n"), key).limit(math.ceil(1 / share)).collect()
    total = sampled.get["total"] or 0
    return {row[key]: row.n / total for row in most if row.n >= share * total}


def _parts(key: Column, heavy: dict, n_tasks: int) -> Column:
    """Into how many parts the rows of ``key`` are cut: a power of two that grows with its share."""
    by_parts = defaultdict(list)
    for value, share in heavy.items():
        by_parts[1 << math.ceil(math.log2(max(1, PARTS_PER_TASK * share * n_tasks)))].append(value)
    parts = F.when(key.isNull(), F.lit(PARTS_PER_TASK * n_tasks))
    for n, values in sorted(by_parts.items()):
        parts = parts.when(key.isin(values), F.lit(n))
    return parts.otherwise(1)


def salted_lookup(rows: DataFrame, dimension: DataFrame, on: list[str], heavy: dict, spread_by: str) -> DataFrame:
    """Left join of ``rows`` with ``dimension`` on ``on``, whose first column has the ``heavy`` values.

    Rows of a heavy value are dealt to parts by a hash of ``spread_by``, so retries agree, and the
    dimension's rows of that value are repeated for every part: a few for each task and in all no
    more than the tasks need. Rows without a key match nothing and are dealt in the same way.
    """
    key = F.col(on[0])
    parts = _parts(key, heavy, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = rows.withColumn(_SALT, F.pmod(F.xxhash64(spread_by), parts).cast("int"))
    copies = F.explode(F.sequence(F.lit(0), parts - 1))
    repeated = dimension.where(key.isNotNull()).withColumn(_SALT, copies)
    return salted.join(repeated, [*on, _SALT], "left").drop(_SALT)
