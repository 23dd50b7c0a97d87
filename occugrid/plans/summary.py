"""Job: the tables behind the distribution and density charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from occugrid import storage
from occugrid.operators import density
from occugrid.sources import tables


def summaries(features: DataFrame) -> dict[str, DataFrame]:
    return {
        "global_distribution": density.point_density(features),
        "hotspots": density.hexbin(features),
        "lat_distribution": density.histogram(features, "lat"),
        "lon_distribution": density.histogram(features, "lon"),
        "hemisphere_distribution": density.hemisphere_counts(features),
    }


@storage.drops_its_tables
def run(
    spark: SparkSession,
    train_features: str,
    out_dir: str,
    fmt: str = "parquet",
    out_fmt: str = "parquet",
    by_position: bool = False,
) -> dict[str, str]:
    features = tables.read_train_features(spark, train_features, fmt, by_position)
    return {
        name: tables.write_table(df, f"{out_dir}/{name}", out_fmt)
        for name, df in summaries(features).items()
    }
