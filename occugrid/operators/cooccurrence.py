"""Species pairs that share regions.

Joining the species of a region with each other would emit every pair of every region. Here
species of the same area form blocks of a few hundred; each pair of blocks whose areas overlap
enough is one group, and its overlaps come from a bit-mask product inside the task. Only pairs
that reach the threshold leave the task, and no group depends on how rich a single region is.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from occugrid import storage
from occugrid.functions import measures
from occugrid.operators import occupancy as occ

# A block pair holds about 2 * 256 species with at most 1,104 tiles each: ~540,000 short rows.
SPECIES_PER_BLOCK = 256


def _overlap_counter(min_pair_count: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def count_overlaps(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        low, high = key
        masks = rows["mask"].to_numpy().view(np.uint64)
        species, index = np.unique(rows["taxon_id"].to_numpy(), return_inverse=True)
        in_low = rows["block"].to_numpy() == low
        shared = np.zeros((len(species), len(species)), dtype=np.int64)
        for at in rows.groupby(["tile_lat", "tile_lon"]).indices.values():
            left, right = at[in_low[at]], at if low == high else at[~in_low[at]]
            if len(left) and len(right):
                shared[np.ix_(index[left], index[right])] += np.bitwise_count(
                    masks[left][:, None] & masks[right][None, :]
                )
        low_species = np.unique(index[in_low])
        high_species = low_species if low == high else np.unique(index[~in_low])
        wanted = np.zeros_like(shared, dtype=bool)
        wanted[np.ix_(low_species, high_species)] = True
        if low == high:
            wanted &= species[:, None] < species[None, :]
        x, y = np.nonzero(wanted & (shared >= min_pair_count))
        return pd.DataFrame({"x": species[x], "y": species[y], "n_ab": shared[x, y]})

    return count_overlaps


def placed_masks(occupied: DataFrame, species: DataFrame, species_per_block: int) -> DataFrame:
    """Mask rows of ``species`` with their ``block``: species of the same area share one.

    Species are ranked by the tile that holds most of their cells, then dealt to blocks in that
    order. The rank is the number of species of earlier tiles (a row per tile) plus the place
    inside the tile.
    """
    mine = occupied.join(species.select("taxon_id"), "taxon_id", "left_semi")
    cells = F.struct(F.bit_count("mask"), "tile_lat", "tile_lon")
    homes = mine.groupBy("taxon_id").agg(F.max_by(F.struct("tile_lat", "tile_lon"), cells).alias("home"))
    earlier = Window.orderBy("home").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        homes.groupBy("home")
        .agg(F.count("*").alias("n"))
        .select("home", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    )
    place = F.row_number().over(Window.partitionBy("home").orderBy("taxon_id")) - 1
    blocks = (
        homes.withColumn("place", place)
        .join(before, "home")
        .select("taxon_id", F.floor((F.col("before") + F.col("place")) / species_per_block).alias("block"))
    )
    return storage.written_table(mine.join(blocks, "taxon_id"), "placed-masks")


def meeting_rows(placed: DataFrame, min_pair_count: int) -> DataFrame:
    """Mask rows of both blocks for each pair of blocks ``(low, high)`` that may hold a pair.

    Two species share at most the cells that the joint masks of their blocks share. So a pair
    of blocks counts only if those reach the threshold, and only in the tiles where they meet.
    Rows grow with the overlap of areas; only species found everywhere still meet all others.
    """
    tile = ["tile_lat", "tile_lon"]
    columns = ["low", "high", "block", "taxon_id", *tile, "mask"]
    if min_pair_count < 1:
        # Pairs that never meet are wanted too: every block meets every other.
        last = placed.agg(F.max("block")).scalar()
        other = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        return other.withColumns(
            {"low": F.least("block", "other"), "high": F.greatest("block", "other")}
        ).select(*columns)
    joint = storage.written_table(
        placed.groupBy("block", *tile).agg(F.bit_or("mask").alias("mask")), "joint-masks"
    )
    low = joint.withColumnsRenamed({"block": "low", "mask": "low_mask"})
    high = joint.withColumnsRenamed({"block": "high", "mask": "high_mask"})
    met = (
        low.join(high, tile)
        .where("low <= high")
        .withColumn("shared", F.bit_count(F.col("low_mask").bitwiseAND(F.col("high_mask"))))
        .where("shared > 0")
        .select("low", "high", *tile, "shared")
    )
    met = storage.written_table(met, "met-blocks")
    enough = met.groupBy("low", "high").agg(F.sum("shared").alias("n")).where(F.col("n") >= min_pair_count)
    tiles = met.join(enough.select("low", "high"), ["low", "high"], "left_semi").select("low", "high", *tile)
    sides = tiles.withColumn("block", F.col("low")).unionByName(
        tiles.where("low < high").withColumn("block", F.col("high"))
    )
    return placed.join(sides, ["block", *tile]).select(*columns)


def shared_regions(
    occupied: DataFrame,
    species: DataFrame,
    min_pair_count: int = 20,
    species_per_block: int = SPECIES_PER_BLOCK,
) -> DataFrame:
    """``(x, y, n_ab)`` for each unordered pair of ``species`` with ``n_ab >= min_pair_count``.

    A threshold of 0 or less also returns the pairs that never meet: all pairs of species.
    """
    placed = placed_masks(occupied, species, species_per_block)
    return meeting_rows(placed, min_pair_count).groupBy("low", "high").applyInPandas(
        _overlap_counter(min_pair_count), "x BIGINT, y BIGINT, n_ab BIGINT"
    )


def cooccurrence(
    features: DataFrame,
    min_species_support: int = 10,
    min_pair_count: int = 20,
    names: DataFrame | None = None,
    species_per_block: int = SPECIES_PER_BLOCK,
) -> DataFrame:
    """Pair table: counts, supports, Jaccard, P(a|b) and lift, strongest lift first.

    ``species_a`` is the more widespread of the two (ties as in the popularity order).
    ``names`` holds one row per species; without it the names come from the features. A
    species missing there is named "", a null name stays null.
    """
    occupied = occ.occupancy(features)
    support = occ.species_support(occupied)
    # A pair cannot share more regions than its rarer species has.
    kept = occ.frequent_species(support, max(min_species_support, min_pair_count))
    # The final sort samples its input first. This shuffle, which the join on x can use, keeps
    # the overlaps, so that the sampling pass does not compute them a second time.
    pairs = shared_regions(occupied, kept, min_pair_count, species_per_block).repartition("x")
    known = names if names is not None else occ.species_names(features)
    known = known.select("taxon_id", F.struct("taxon_name").alias("entry"))
    named = kept.join(known, "taxon_id", "left").withColumn(
        "taxon_name", F.when(F.col("entry").isNull(), "").otherwise(F.col("entry.taxon_name"))
    )
    one = F.struct("n_regions", "first_region", "taxon_id", "taxon_name")
    x = named.select(F.col("taxon_id").alias("x"), one.alias("sx"))
    y = named.select(F.col("taxon_id").alias("y"), one.alias("sy"))
    x_first = F.struct(-F.col("sx.n_regions"), "sx.first_region", "x") < F.struct(
        -F.col("sy.n_regions"), "sy.first_region", "y"
    )
    # Every x and y is in ``named``. The outer join only tells Catalyst that the pairs, whose
    # number it cannot estimate, are never the side to broadcast.
    oriented = (
        pairs.join(x, "x", "left")
        .join(y, "y", "left")
        .select(
            F.when(x_first, F.col("sx")).otherwise(F.col("sy")).alias("a"),
            F.when(x_first, F.col("sy")).otherwise(F.col("sx")).alias("b"),
            "n_ab",
        )
    )
    return pair_measures(oriented, occ.total_regions(occupied)).orderBy(
        F.col("lift").desc(), "species_a", "species_b"
    )


def pair_measures(oriented: DataFrame, total: DataFrame) -> DataFrame:
    n_a, n_b, n_ab = F.col("n_a"), F.col("n_b"), F.col("n_ab")
    regions = total.scalar()
    return (
        oriented.select(
            F.col("a.taxon_id").alias("species_a"),
            F.col("b.taxon_id").alias("species_b"),
            F.col("a.taxon_name").alias("species_a_name"),
            F.col("b.taxon_name").alias("species_b_name"),
            F.col("a.n_regions").alias("n_a"),
            F.col("b.n_regions").alias("n_b"),
            "n_ab",
        )
        .withColumns(
            {
                "support_a": measures.support(n_a, regions),
                "support_b": measures.support(n_b, regions),
                "support_ab": measures.support(n_ab, regions),
                "jaccard": measures.jaccard(n_a, n_b, n_ab),
                "p_a_given_b": n_ab / n_b,
            }
        )
        .withColumn(
            "lift",
            measures.lift(F.col("support_a"), F.col("support_b"), F.col("support_ab")),
        )
    )
