"""Readers with explicit schemas and writers for every table of the package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from occugrid import schemas, storage

def read_table(
    spark: SparkSession, path: str, schema: str, fmt: str = "parquet", position: str | None = None
) -> DataFrame:
    """Read ``path`` with a declared schema; a missing path fails when the frame is built.

    ``position`` names an id column of ``schema`` that the files do not have: it is then the
    place of the record in its source, as for plain array or CSV exports.
    CSV is read with a header. Only an empty field is null, so a taxon called "NA" stays text.
    """
    declared = StructType.fromDDL(schema)
    stored = StructType([field for field in declared if field.name != position])
    reader = spark.read.schema(stored)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    df = reader.format(fmt).load(path)
    return with_positions(df, position).select(declared.names) if position else df


def _natural(path: Column) -> Column:
    """A sort key of a path in which its numbers compare as numbers."""
    parts = F.regexp_extract_all(path, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(
        F.transform(parts, lambda part: F.when(part.rlike("^[0-9]"), F.lpad(part, 20, "0")).otherwise(part)),
        "",
    )


def with_positions(df: DataFrame, name: str) -> DataFrame:
    """Add the BIGINT position of each record in its source: 0, 1, 2, ... without gaps.

    Files count in the order of their names, numbers in a name as numbers. The scan numbers
    the records of a split as it reads them; how many all earlier splits hold comes from one
    row per split. The numbered records are written once, so that both steps see the same.
    """
    scanned = df.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__split"),
        F.monotonically_increasing_id().alias("__read"),
    )
    numbered = storage.written_table(scanned, "positions")
    splits = numbered.groupBy("__file", "__split").agg(
        F.count("*").alias("__n"), F.min("__read").alias("__first")
    )
    # One row for each split of a file, however many records it has.
    earlier = Window.orderBy(_natural(F.col("__file")), "__split").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = splits.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    return (
        numbered.join(offsets.drop("__n"), ["__file", "__split"])
        .withColumn(name, F.col("__before") + F.col("__read") - F.col("__first"))
        .drop("__file", "__split", "__read", "__first", "__before")
    )


def read_observations(
    spark: SparkSession, path: str, fmt: str = "parquet", by_position: bool = False
) -> DataFrame:
    """``row_id`` is the position of the record in its source and decides every "first"."""
    return read_table(spark, path, schemas.OBSERVATIONS, fmt, "row_id" if by_position else None)


def read_observation_arrays(
    spark: SparkSession, path: str, fmt: str = "parquet", by_position: bool = False
) -> DataFrame:
    """Observations whose coordinates come as one ``[lat, lon]`` array per record."""
    position = "row_id" if by_position else None
    return split_locations(read_table(spark, path, schemas.OBSERVATION_ARRAYS, fmt, position))


def read_taxa(
    spark: SparkSession, path: str, fmt: str = "parquet", by_position: bool = False
) -> DataFrame:
    """By position, the last entry of an id that occurs twice names it."""
    if by_position:
        return read_table(spark, path, schemas.TAXA + ", position BIGINT", fmt, "position")
    return read_table(spark, path, schemas.TAXA, fmt)


def read_test_locations(
    spark: SparkSession, path: str, fmt: str = "parquet", by_position: bool = False
) -> DataFrame:
    return read_table(spark, path, schemas.TEST_LOCATIONS, fmt, "loc_id" if by_position else None)


def read_test_presence(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.TEST_PRESENCE, fmt)


def read_train_features(
    spark: SparkSession, path: str, fmt: str = "parquet", by_position: bool = False
) -> DataFrame:
    return read_table(spark, path, schemas.TRAIN_FEATURES, fmt, "row_id" if by_position else None)


def split_locations(df: DataFrame, locs: str = "locs") -> DataFrame:
    """Name the two positions of a coordinate array ``lat`` and ``lon``."""
    others = [name for name in df.columns if name != locs]
    return df.select(
        *others,
        F.col(locs)[0].cast("double").alias("lat"),
        F.col(locs)[1].cast("double").alias("lon"),
    )


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Parquet between jobs, CSV (with header) as an export."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)
    return path
