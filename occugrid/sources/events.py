"""Occurrence tables derived from ``events.parquet`` of the test data.

The whole event table is used everywhere. The two observation sources overlap in one event
type, so that their union holds real duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRESENCE_CHUNK = 1 << 16


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation per event; fractions are multiples of 1/4 and therefore exact."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    far_east = F.when(
        F.col("event_id") % 40 == 0, F.expr("40 + (event_id div 40) % 90")
    ).otherwise(0)
    return (
        spark.read.parquet(f"{sf_dir}/events.parquet")
        .select("event_id", "user_id", "event_type", k.alias("k"))
        .select(
            F.col("event_id").alias("row_id"),
            (
                F.expr("cast(user_id % 24 - 11 as double)") + F.col("event_id") % 4 / 4.0
            ).alias("lat"),
            (
                (F.expr("(user_id * 7 + event_id % 3) % 40 - 20") + far_east).cast("double")
                + F.col("k") % 4 / 4.0
            ).alias("lon"),
            F.expr("1000 + (user_id % 24) * 4 + (k * k) div 160").alias("taxon_id"),
            "event_type",
        )
    )


def train_and_extra(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    every = observations(spark, sf_dir)
    train = every.filter(F.col("event_type") != "error").drop("event_type")
    extra = every.filter(F.col("event_type").isin("error", "signup")).drop("event_type")
    return train, extra


def taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name dimension; every tenth species has no name."""
    return (
        observations(spark, sf_dir)
        .select("taxon_id")
        .distinct()
        .withColumn(
            "taxon_name",
            F.when(
                F.col("taxon_id") % 10 != 0,
                F.concat(F.lit("taxon_"), F.col("taxon_id").cast("string")),
            ),
        )
    )


def test_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).select(F.col("row_id").alias("loc_id"), "lat", "lon")


def test_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Location lists per species, cut into chunks so that no list grows with the data."""
    return (
        observations(spark, sf_dir)
        .groupBy("taxon_id", F.expr(f"row_id div {PRESENCE_CHUNK}").alias("chunk"))
        .agg(F.sort_array(F.collect_list("row_id")).alias("loc_ids"))
        .drop("chunk")
    )
