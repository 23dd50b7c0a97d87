"""Which species occurs in which cell, as bit masks; support and ranking built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from occugrid.functions import geo


def occupancy(features: DataFrame) -> DataFrame:
    """``(taxon_id, tile_lat, tile_lon, mask)``: one bit per occupied cell of a tile.

    This replaces ``distinct(region, taxon_id)``. ``bit_or`` combines on the map side, so a
    species, cell or coordinate holding a third of all rows leaves each task as single rows.
    """
    lat, lon = F.col("grid_lat"), F.col("grid_lon")
    return (
        features.select(
            "taxon_id",
            geo.tile_index(lat).alias("tile_lat"),
            geo.tile_index(lon).alias("tile_lon"),
            geo.bit_flag(geo.cell_bit(lat, lon)).alias("flag"),
        )
        .groupBy("taxon_id", "tile_lat", "tile_lon")
        .agg(F.bit_or("flag").alias("mask"))
    )


def species_support(occupied: DataFrame) -> DataFrame:
    """Regions per species and the first of them in string order.

    ``(-n_regions, first_region, taxon_id)`` is the popularity order: ties fall to the
    species that shows up first when regions are read in string order.
    """
    first = geo.first_region_in_tile(F.col("tile_lat"), F.col("tile_lon"), F.col("mask"))
    return (
        occupied.select(
            "taxon_id", F.bit_count("mask").cast("bigint").alias("cells"), first.alias("first")
        )
        .groupBy("taxon_id")
        .agg(F.sum("cells").alias("n_regions"), F.min("first").alias("first_region"))
    )


def popularity_order() -> list[Column]:
    return [F.col("n_regions").desc(), F.col("first_region"), F.col("taxon_id")]


def frequent_species(support: DataFrame, min_species_support: int = 10) -> DataFrame:
    return support.filter(F.col("n_regions") >= min_species_support)


def top_species(support: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` most widespread species with their ``label_rank`` (0 = most widespread).

    The window numbers at most ``k`` rows, which the limit has already brought together.
    """
    head = support.orderBy(*popularity_order()).limit(k)
    return head.withColumn(
        "label_rank", F.row_number().over(Window.orderBy(*popularity_order())) - 1
    )


def total_regions(occupied: DataFrame) -> DataFrame:
    """One row: number of occupied cells over all species."""
    return (
        occupied.groupBy("tile_lat", "tile_lon")
        .agg(F.bit_or("mask").alias("mask"))
        .agg(F.coalesce(F.sum(F.bit_count("mask")), F.lit(0)).cast("bigint").alias("n_regions"))
    )


def region_taxa(features: DataFrame) -> DataFrame:
    """Distinct (cell, species) pairs in long form."""
    return features.select("grid_lat", "grid_lon", "taxon_id").distinct()


def region_baskets(features: DataFrame) -> DataFrame:
    """Region with the ascending list of its species: a list of distinct ids per cell."""
    return (
        region_taxa(features)
        .groupBy("grid_lat", "grid_lon")
        .agg(F.array_sort(F.collect_list("taxon_id")).alias("species_list"))
        .select(
            geo.region_key(F.col("grid_lat"), F.col("grid_lon")).alias("region"), "species_list"
        )
    )


def region_features(features: DataFrame) -> DataFrame:
    """Features of each region, taken from its first observation in source order.

    Cell indices and hemisphere are constant inside a cell and serve as fixed-width keys.
    """
    lat, lon = F.col("grid_lat"), F.col("grid_lon")
    return (
        features.groupBy("grid_lat", "grid_lon")
        .agg(
            F.min_by("sin_lon", "row_id").alias("sin_lon"),
            F.min_by("cos_lon", "row_id").alias("cos_lon"),
        )
        .select(
            geo.region_key(lat, lon).alias("region"),
            "grid_lat",
            "grid_lon",
            "sin_lon",
            "cos_lon",
            geo.hemisphere(lat).alias("hemisphere"),
        )
    )


def species_names(features: DataFrame) -> DataFrame:
    """Name per species; of several names the one whose first record comes last wins."""
    return (
        features.groupBy("taxon_id", "taxon_name")
        .agg(F.min("row_id").alias("first_seen"))
        .groupBy("taxon_id")
        .agg(F.max_by("taxon_name", "first_seen").alias("taxon_name"))
    )
