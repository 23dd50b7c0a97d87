"""Presence and absence of species at test locations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def present_locations(presence: DataFrame) -> DataFrame:
    """Distinct (taxon_id, loc_id) from the location lists."""
    return presence.select("taxon_id", F.explode("loc_ids").alias("loc_id")).distinct()


def _located(presence: DataFrame, locations: DataFrame) -> DataFrame:
    """Present locations with the columns of ``locations``; fails on an id without location."""
    found = present_locations(presence).join(
        locations.withColumn("known", F.lit(True)), "loc_id", "left"
    )
    lost = F.concat(F.lit("no test location "), F.col("loc_id").cast("string"))
    known = F.when(F.col("known"), True).otherwise(F.raise_error(lost).cast("boolean"))
    return found.where(known).drop("known")


def species_presence(presence: DataFrame, locations: DataFrame) -> DataFrame:
    """Locations where each species is present, with coordinates."""
    return _located(presence, locations)


def absence_counts(presence: DataFrame, locations: DataFrame) -> DataFrame:
    """Present and absent locations per species.

    Absence is the complement of presence, so counting it needs no species x location grid.
    A species with an empty list is absent everywhere.
    """
    total = locations.agg(F.count("*")).scalar()
    counts = (
        _located(presence, locations.select("loc_id"))
        .groupBy("taxon_id")
        .agg(F.count("*").alias("n"))
    )
    return (
        presence.select("taxon_id")
        .distinct()
        .join(counts, "taxon_id", "left")
        .select("taxon_id", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_present"))
        .withColumn("n_absent", total - F.col("n_present"))
    )


def locations_of(presence: DataFrame, locations: DataFrame, species: DataFrame) -> DataFrame:
    """Every test location, marked present or absent for the one species in ``species``."""
    chosen = present_locations(presence.join(species.select("taxon_id"), "taxon_id", "left_semi"))
    kind = F.when(F.col("taxon_id").isNotNull(), "present").otherwise("absent")
    return locations.join(chosen, "loc_id", "left").withColumn("kind", kind).drop("taxon_id")


def observations_of(observations: DataFrame, species: DataFrame) -> DataFrame:
    """Rows of the species in ``species`` (one row: an equality filter on a scalar)."""
    return observations.filter(F.col("taxon_id") == species.select("taxon_id").scalar())


def random_species(taxa: DataFrame, seed: int = 42) -> DataFrame:
    """One species drawn by ``seed``; the draw does not depend on how the data is partitioned."""
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col("taxon_id").cast("string")))
    return taxa.select("taxon_id").distinct().orderBy(draw, "taxon_id").limit(1)
