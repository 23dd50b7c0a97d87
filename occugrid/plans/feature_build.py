"""Job: raw observations to train and test feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from occugrid import storage
from occugrid.operators import observations as obs
from occugrid.sources import clustered, tables


def train_features(
    train: DataFrame,
    extra: DataFrame | None = None,
    taxa: DataFrame | None = None,
    extra_taxa: DataFrame | None = None,
) -> DataFrame:
    """Union, deduplicate, name and grid the observations.

    One shuffle, and one more where the names are too many to broadcast; hot species are then
    looked for in a sample of the rows.
    """
    every = obs.union_sources(train, extra)
    named = obs.attach_names(obs.deduplicate(every), taxa, extra_taxa, every)
    return obs.add_features(named).select(
        "row_id", "lat", "lon", "taxon_id", "taxon_name",
        "grid_lat", "grid_lon", "region", "hemisphere", "sin_lon", "cos_lon",
    )


def test_features(locations: DataFrame) -> DataFrame:
    return obs.add_features(locations)


@storage.drops_its_tables
def run(
    spark: SparkSession,
    train: str,
    test: str,
    out_dir: str,
    extra: str | None = None,
    taxa: str | None = None,
    extra_taxa: str | None = None,
    fmt: str = "parquet",
    by_position: bool = False,
    cluster: bool = False,
) -> dict[str, str]:
    """Read the sources, write ``train_features`` and ``test_features`` under ``out_dir``.

    ``by_position``: the sources have no id columns; a record is identified by its position.
    ``cluster``: the train features are laid out by place and species, with file statistics, for
    ``clustered.read_clustered``; any other reader sees an ordinary table.
    """

    def names(path: str | None) -> DataFrame | None:
        return tables.read_taxa(spark, path, fmt, by_position) if path else None

    built = train_features(
        tables.read_observations(spark, train, fmt, by_position),
        tables.read_observations(spark, extra, fmt, by_position) if extra else None,
        names(taxa),
        names(extra_taxa),
    )
    tested = test_features(tables.read_test_locations(spark, test, fmt, by_position))
    if cluster and fmt != "parquet":
        raise ValueError(f"only Parquet tables are clustered, not {fmt}")
    write = clustered.write_clustered if cluster else lambda df, path: tables.write_table(df, path, fmt)
    if cluster:
        # Laid out by its own quantiles, so it is read twice.
        built = storage.written_table(built, "features")
    return {
        "train_features": write(built, f"{out_dir}/train_features"),
        "test_features": tables.write_table(tested, f"{out_dir}/test_features", fmt),
    }
