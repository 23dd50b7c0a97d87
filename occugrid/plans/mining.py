"""Job: species co-occurrence over regions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from occugrid import storage
from occugrid.operators.cooccurrence import cooccurrence
from occugrid.sources import tables


@storage.drops_its_tables
def run(
    spark: SparkSession,
    train_features: str,
    out_dir: str,
    min_species_support: int = 10,
    min_pair_count: int = 20,
    fmt: str = "parquet",
    out_fmt: str = "csv",
    by_position: bool = False,
) -> str:
    """Write the pair table, strongest lift first, as ``species_cooccurrence``."""
    features = tables.read_train_features(spark, train_features, fmt, by_position)
    pairs = cooccurrence(features, min_species_support, min_pair_count)
    return tables.write_table(pairs, f"{out_dir}/species_cooccurrence", out_fmt)
