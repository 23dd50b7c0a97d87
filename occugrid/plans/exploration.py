"""Job: what a survey holds, and one species of it, drawn at random."""

from __future__ import annotations

from pyspark.sql import SparkSession

from occugrid import storage
from occugrid.operators import density, observations, presence
from occugrid.sources import tables


@storage.drops_its_tables
def run(
    spark: SparkSession,
    train: str,
    taxa: str,
    test: str,
    test_presence: str,
    out_dir: str,
    seed: int = 42,
    fmt: str = "parquet",
    out_fmt: str = "parquet",
    by_position: bool = False,
) -> dict[str, str]:
    """Write the statistics, the counts of presence and absence, and the drawn species.

    ``species`` is the drawn species with its name, ``species_observations`` its training rows,
    ``species_locations`` all test locations, marked present or absent.
    """
    rows = tables.read_observations(spark, train, fmt, by_position)
    names = tables.read_taxa(spark, taxa, fmt, by_position)
    locations = tables.read_test_locations(spark, test, fmt, by_position)
    lists = tables.read_test_presence(spark, test_presence, fmt)
    species = presence.random_species(names, seed).join(
        observations.taxon_dimension(names), "taxon_id", "left"
    )
    species = storage.written_table(species, "species")
    results = {
        "stats": density.observation_stats(rows, names),
        "absence_counts": presence.absence_counts(lists, locations),
        "species": species,
        "species_observations": presence.observations_of(rows, species),
        "species_locations": presence.locations_of(lists, locations, species),
    }
    return {
        name: tables.write_table(df, f"{out_dir}/{name}", out_fmt) for name, df in results.items()
    }
