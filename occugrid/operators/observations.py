"""Union, deduplication, names and grid features of observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occugrid.functions import geo
from occugrid.operators import skew

# Rows of the second source sort after every row of the first one.
EXTRA_OFFSET = 1 << 62


def union_sources(train: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """UNION ALL of the two sources; ``row_id`` keeps the order "train first, then extra"."""
    columns = ["row_id", "lat", "lon", F.col("taxon_id").cast("bigint").alias("taxon_id")]
    merged = train.select(*columns)
    if extra is None:
        return merged
    moved = extra.select(*columns).withColumn("row_id", F.col("row_id") + F.lit(EXTRA_OFFSET))
    return merged.unionByName(moved)


def deduplicate(observations: DataFrame) -> DataFrame:
    """Keep the first record of every (lat, lon, taxon_id).

    All keys and the single buffer are fixed-width, so this is one hash aggregation with
    map-side combine: a hot coordinate shrinks to one row per task before the shuffle.
    """
    return observations.groupBy("lat", "lon", "taxon_id").agg(F.min("row_id").alias("row_id"))


def taxon_dimension(taxa: DataFrame) -> DataFrame:
    """One name per id: of duplicate ids the last entry wins, by the ``position`` column.

    Without that column "last" has no meaning, so an id with two different names (a null one
    included) fails.
    """
    named = taxa.withColumn("taxon_id", F.col("taxon_id").cast("bigint"))
    if "position" in taxa.columns:
        return named.groupBy("taxon_id").agg(F.max_by("taxon_name", "position").alias("taxon_name"))
    one = (F.min("taxon_name") == F.max("taxon_name")) & (F.count("taxon_name") == F.count("*"))
    message = F.concat(F.lit("two names without a position: "), F.col("taxon_id").cast("string"))
    return (
        named.groupBy("taxon_id")
        .agg(F.max("taxon_name").alias("name"), (one | (F.count("taxon_name") == 0)).alias("one"))
        .select(
            "taxon_id",
            F.when(F.col("one"), F.col("name")).otherwise(F.raise_error(message)).alias("taxon_name"),
        )
    )


def attach_names(
    observations: DataFrame,
    taxa: DataFrame | None,
    extra_taxa: DataFrame | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Left lookup id -> name; no dimension means null names.

    ``extra_taxa`` names the rows of the second source where it differs from the first.
    The lookup runs after deduplication, on fewer rows. It carries no broadcast hint:
    Catalyst broadcasts the dimension below its size threshold. Above it, the species that
    hold most of ``counted``, rows that are cheap to read like those before deduplication,
    are salted on both sides; without ``counted`` hot species are left to AQE.
    """
    if taxa is None and extra_taxa is None:
        return observations.withColumn("taxon_name", F.lit(None).cast("string"))
    if extra_taxa is None:
        return _looked_up(observations, taxon_dimension(taxa), ["taxon_id"], counted)
    sided = [
        taxon_dimension(side).withColumn("is_extra", F.lit(flag))
        for side, flag in ((taxa, False), (extra_taxa, True))
        if side is not None
    ]
    dimension = sided[0] if len(sided) == 1 else sided[0].unionByName(sided[1])
    marked = observations.withColumn("is_extra", F.col("row_id") >= EXTRA_OFFSET)
    return _looked_up(marked, dimension, ["taxon_id", "is_extra"], counted).drop("is_extra")


def _looked_up(rows: DataFrame, dimension: DataFrame, on: list[str], counted: DataFrame | None) -> DataFrame:
    if counted is None or skew.is_small(dimension):
        return rows.join(dimension, on, "left")
    return skew.salted_lookup(rows, dimension, on, skew.heavy_values(counted, on[0]), "row_id")


def invalid_coordinates(observations: DataFrame) -> DataFrame:
    """Records the grid step would refuse: null, NaN or infinite coordinates."""
    return observations.filter(~(geo.is_finite(F.col("lat")) & geo.is_finite(F.col("lon"))))


def add_features(points: DataFrame) -> DataFrame:
    """Grid cell, region key, hemisphere and longitude on the unit circle."""
    lat, lon = F.col("lat"), F.col("lon")
    return points.withColumns(
        {"grid_lat": geo.grid_cell(lat), "grid_lon": geo.grid_cell(lon)}
    ).withColumns(
        {
            "region": geo.region_key(F.col("grid_lat"), F.col("grid_lon")),
            "hemisphere": geo.hemisphere(lat),
            "sin_lon": F.sin(F.radians(lon)),
            "cos_lon": F.cos(F.radians(lon)),
        }
    )
