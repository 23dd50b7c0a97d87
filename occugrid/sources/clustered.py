"""Feature tables laid out so that a question about one species or one place reads few files.

Files are ranges along a Z-order of tile and species, so each holds a small part of both. A table
of their statistics beside them names the files that a filter can meet; the others are not opened.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from occugrid.functions import geo
from occugrid.sources import tables

#: Each of the two orders is cut at so many quantiles, less one.
CUTS = 64
ROWS_PER_FILE = 2_000_000


def tile_number(grid_lat: Column, grid_lon: Column) -> Column:
    """One number for each of the at most 1,104 tiles, row by row from the south west."""
    return (geo.tile_index(grid_lat) + 12) * 64 + geo.tile_index(grid_lon) + 23


def _code(value: Column, cuts: list[int]) -> Column:
    """How many of the ascending ``cuts`` lie below."""
    return F.size(F.filter(F.array(*[F.lit(cut) for cut in cuts]), lambda cut: cut < value))


def _interleaved(a: Column, b: Column) -> Column:
    bits = range((CUTS - 1).bit_length())
    parts = [F.shiftleft(F.getbit(x, F.lit(i)).cast("long"), 2 * i + place) for i in bits for place, x in ((1, a), (0, b))]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total


def write_clustered(features: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> str:
    """Write ``features`` under ``path`` and its file statistics under ``<path>.files``.

    Quantiles decide the cuts, so that files hold like numbers of rows however the species and
    places are spread; a species or tile with a great part of all rows is cut by the other of the
    two and by ``row_id``. Statistics have a row per file.
    """
    numbered = features.withColumn("__tile", tile_number(F.col("grid_lat"), F.col("grid_lon")))
    shares = [i / CUTS for i in range(1, CUTS)]
    n, tiles, taxa = numbered.agg(
        F.count("*"),
        F.percentile_approx("__tile", shares, 10_000),
        F.percentile_approx("taxon_id", shares, 10_000),
    ).first()
    z = _interleaved(*[_code(F.col(name), sorted(set(cuts or []))) for name, cuts in (("__tile", tiles), ("taxon_id", taxa))])
    files = max(1, -(-n // rows_per_file))
    ranged = numbered.withColumn("__z", z).repartitionByRange(files, "__z", "__tile", "taxon_id", "row_id")
    ranged.sortWithinPartitions("taxon_id", "__tile").drop("__z", "__tile").write.mode("overwrite").parquet(path)
    written = features.sparkSession.read.schema(features.schema).parquet(path)
    tile = tile_number(F.col("grid_lat"), F.col("grid_lon"))
    statistics = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.min("taxon_id").alias("low_taxon"),
        F.max("taxon_id").alias("high_taxon"),
        F.min(tile).alias("low_tile"),
        F.max(tile).alias("high_tile"),
        F.count("*").alias("n"),
    )
    statistics.coalesce(1).write.mode("overwrite").parquet(f"{path}.files")
    return path


def read_clustered(
    spark: SparkSession,
    path: str,
    schema: str,
    taxa: Iterable[int] | None = None,
    tiles: Iterable[int] | None = None,
) -> DataFrame:
    """Rows of the given species and tiles; only files whose ranges can hold some are opened."""
    wanted, rows = F.lit(True), F.lit(True)
    tile = tile_number(F.col("grid_lat"), F.col("grid_lon"))
    for values, name, column in ((taxa, "taxon", F.col("taxon_id")), (tiles, "tile", tile)):
        if values is None:
            continue
        values = sorted(set(values))
        known = F.array(*[F.lit(value) for value in values]).cast("array<bigint>")
        wanted &= _meets(known, name)
        rows &= column.isin(values)
    files = [row.file for row in spark.read.parquet(f"{path}.files").where(wanted).select("file").collect()]
    if not files:
        return spark.createDataFrame([], schema)
    return tables.read_table(spark, files, schema).where(rows)


def _meets(known: Column, name: str) -> Column:
    low, high = F.col(f"low_{name}"), F.col(f"high_{name}")
    return F.exists(known, lambda value: (value >= low) & (value <= high))
