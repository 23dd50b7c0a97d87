"""Region-level multi-label datasets and grouped folds."""

from __future__ import annotations

import heapq
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from occugrid.functions import geo

WORD_BITS = 64
NUMERIC_FEATURES = ["grid_lat", "grid_lon", "sin_lon", "cos_lon"]
#: Derived from the cell; any other category is the value of a region's first observation.
HEMISPHERE = "hemisphere"


def label_words(n_labels: int) -> list[str]:
    """Columns that hold the label bits."""
    return [f"word_{i}" for i in range(-(-n_labels // WORD_BITS))]


def has_label(rank: Column, n_labels: int) -> Column:
    """1 if the label words hold ``rank``, else 0."""
    word = F.element_at(
        F.array(*label_words(n_labels)), F.floor(rank / WORD_BITS).cast("int") + 1
    )
    return F.getbit(word, (rank % WORD_BITS).cast("int")).cast("int")


def labelled_regions(
    features: DataFrame,
    top: DataFrame,
    n_labels: int,
    keep_unlabelled: bool,
    block_deg: int = 1,
    categorical: tuple[str, ...] = (HEMISPHERE,),
) -> DataFrame:
    """One row per region: location features and its top species as label bits.

    ``top`` holds the ``n_labels`` most widespread species, so it is broadcast. Labels,
    first-observation features and regions come out of one aggregation whose buffers are all
    fixed-width, but for further ``categorical`` columns of ``features``. ``keep_unlabelled=False`` drops the regions without a top species. The group of
    a region is its block of ``block_deg`` degrees, by default the region itself.
    """
    lat, lon, rank = F.col("grid_lat"), F.col("grid_lon"), F.col("label_rank")
    words = label_words(n_labels)
    bit = geo.bit_flag(rank % WORD_BITS)
    in_word = [
        F.bit_or(F.when(F.floor(rank / WORD_BITS) == i, bit)) for i in range(len(words))
    ]
    rows = (
        features.join(F.broadcast(top.select("taxon_id", "label_rank")), "taxon_id", "left")
        .groupBy("grid_lat", "grid_lon")
        .agg(
            F.min_by("sin_lon", "row_id").alias("sin_lon"),
            F.min_by("cos_lon", "row_id").alias("cos_lon"),
            *[F.min_by(name, "row_id").alias(name) for name in categorical if name != HEMISPHERE],
            *[
                F.coalesce(bits, F.lit(0).cast("bigint")).alias(word)
                for word, bits in zip(words, in_word)
            ],
        )
    )
    if not keep_unlabelled:
        rows = rows.filter(reduce(or_, [F.col(word) != 0 for word in words]))
    return rows.withColumns(
        {
            "region": geo.region_key(lat, lon),
            "hemisphere": geo.hemisphere(lat),
            "group_key": geo.block_key(lat, lon, block_deg),
        }
    )


def label_array(n_labels: int) -> Column:
    """0/1 per label in popularity order."""
    ranks = F.sequence(F.lit(0), F.lit(n_labels - 1))
    return F.transform(ranks, lambda rank: has_label(rank, n_labels))


def label_grid(rows: DataFrame, n_labels: int) -> DataFrame:
    """Every region with every top species and y = 0/1, in long form.

    Each region row unfolds its own label bits: no join is involved.
    """
    return (
        rows.withColumn("label_rank", F.explode(F.sequence(F.lit(0), F.lit(n_labels - 1))))
        .withColumn("y", has_label(F.col("label_rank"), n_labels))
        .drop(*label_words(n_labels))
    )


def with_taxa(grid: DataFrame, top: DataFrame) -> DataFrame:
    """Adds the species behind each label rank."""
    return grid.join(F.broadcast(top.select("label_rank", "taxon_id")), "label_rank")


def top_species_lists(baskets: DataFrame, top: DataFrame) -> DataFrame:
    """Species lists cut down to the top species."""
    wanted = top.agg(F.collect_list("taxon_id")).scalar()
    return baskets.withColumn("species_topk", F.array_intersect("species_list", wanted))


def balanced_folds(sizes: list[tuple[int, int]], n_splits: int) -> list[tuple[int, int]]:
    """``(group, fold)`` for ``(group, rows)``: the largest group first, each to the fold with the
    fewest rows so far. Among equal groups the greater key goes first, among equal folds the first.
    """
    loads = [(0, fold) for fold in range(1, n_splits + 1)]
    dealt = []
    for group, n in sorted(sizes, key=lambda one: (-one[1], -one[0])):
        load, fold = loads[0]
        heapq.heapreplace(loads, (load + n, fold))
        dealt.append((group, fold))
    return dealt


def assign_block_folds(rows: DataFrame, n_splits: int = 5) -> DataFrame:
    """Grouped k-fold for groups of unequal size, so that the folds have like numbers of rows.

    Groups are blocks of cells, so their table is bounded by the 181 x 361 cells of the globe,
    however many observations there are; that table is what the driver deals and what is
    broadcast. Groups of one row get the folds of ``assign_folds``.
    """
    sizes = [tuple(row) for row in rows.groupBy("group_key").count().collect()]
    folds = rows.sparkSession.createDataFrame(balanced_folds(sizes, n_splits), "group_key BIGINT, fold INT")
    return rows.join(F.broadcast(folds), "group_key")


def assign_folds(rows: DataFrame, n_splits: int = 5) -> DataFrame:
    """Grouped k-fold: groups in descending key order are dealt to the folds in turn.

    Every cell is a group of its own, and with equal sizes the greedy balanced assignment is
    this round robin. The global position is the number of groups in higher bands (one band
    per 1000 keys, that is per latitude row) plus the position inside the band, so no window
    ever sees more than one band or the list of bands.
    """
    banded = rows.select("group_key").distinct().withColumn(
        "band", F.floor(F.col("group_key") / 1000)
    )
    higher = Window.orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        banded.groupBy("band")
        .agg(F.count("*").alias("n"))
        .select("band", F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("before"))
    )
    inside = Window.partitionBy("band").orderBy(F.col("group_key").desc())
    folds = (
        banded.withColumn("position", F.row_number().over(inside))
        .join(offsets, "band")
        .select(
            "group_key",
            ((F.col("before") + F.col("position") - 1) % n_splits + 1).cast("int").alias("fold"),
        )
    )
    return rows.join(folds, "group_key")
