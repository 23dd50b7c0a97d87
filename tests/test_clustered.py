"""A clustered table answers like a plain one, from a share of its files."""

import pytest
from pyspark.sql import functions as F

from occugrid import schemas
from occugrid.plans import catalog, feature_build
from occugrid.sources import clustered, tables

TILE = (0 + 12) * 64 + 0 + 23


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    features = catalog.features(spark, "/root/testdata/sf0.01")
    path = clustered.write_clustered(features, f"{tmp_path_factory.mktemp('table')}/features", rows_per_file=300)
    return features, path


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_all_rows_are_kept_for_any_reader(spark, written):
    features, path = written
    plain = tables.read_train_features(spark, path)
    assert rows_of(plain) == rows_of(features)
    assert rows_of(clustered.read_clustered(spark, path, schemas.TRAIN_FEATURES)) == rows_of(features)
    assert spark.read.parquet(f"{path}.files").agg(F.sum("n")).first()[0] == features.count()


def test_filters_open_a_share_of_the_files(spark, written):
    features, path = written
    every = len(spark.read.parquet(path).inputFiles())
    assert every > 20
    taxa = [r.taxon_id for r in features.select("taxon_id").distinct().orderBy("taxon_id").collect()]
    for wanted in ([taxa[0]], [taxa[-1], taxa[40]]):
        found = clustered.read_clustered(spark, path, schemas.TRAIN_FEATURES, taxa=wanted)
        assert rows_of(found) == rows_of(features.where(F.col("taxon_id").isin(wanted)))
        assert len(found.inputFiles()) < every * 0.4 * len(wanted)
    here = features.where("grid_lat between 0 and 7 and grid_lon between 0 and 7")
    found = clustered.read_clustered(spark, path, schemas.TRAIN_FEATURES, tiles=[TILE])
    assert rows_of(found) == rows_of(here) and here.count() > 0
    assert len(found.inputFiles()) < every * 0.5
    both = clustered.read_clustered(spark, path, schemas.TRAIN_FEATURES, taxa=[taxa[50]], tiles=[TILE])
    assert rows_of(both) == rows_of(here.where(F.col("taxon_id") == taxa[50]))
    assert len(both.inputFiles()) < every * 0.25


def test_unknown_species_and_empty_tables(spark, written, tmp_path):
    features, path = written
    none = clustered.read_clustered(spark, path, schemas.TRAIN_FEATURES, taxa=[-5])
    assert none.collect() == [] and none.schema.names == features.schema.names
    empty = clustered.write_clustered(features.limit(0), f"{tmp_path}/empty")
    assert clustered.read_clustered(spark, empty, schemas.TRAIN_FEATURES, taxa=[1]).collect() == []


def test_one_hot_species_in_one_tile_is_cut_into_files(spark, make_features, tmp_path):
    features = make_features([(i, 0.5 + i / 10_000, 0.5, 7) for i in range(3000)] + [(5000, 40.0, 40.0, 8)])
    path = clustered.write_clustered(features, f"{tmp_path}/hot", rows_per_file=500)
    sizes = [r.n for r in spark.read.parquet(f"{path}.files").collect()]
    assert sum(sizes) == 3001 and len(sizes) >= 5 and max(sizes) < 1500


def test_tiles_have_numbers_of_their_own(spark):
    cells = [(lat, lon) for lat in range(-90, 91) for lon in range(-180, 181)]
    frame = spark.createDataFrame(cells, "a long, b long")
    numbers = frame.select(
        clustered.tile_number(F.col("a"), F.col("b")).alias("n"), F.floor(F.col("a") / 8), F.floor(F.col("b") / 8)
    ).distinct().collect()
    assert len({r.n for r in numbers}) == len(numbers) == 24 * 46


def test_the_feature_job_can_cluster(spark, sf_dir, tmp_path):
    from occugrid.sources import events

    train, _ = events.train_and_extra(spark, sf_dir)
    train.write.parquet(f"{tmp_path}/train")
    events.test_locations(spark, sf_dir).write.parquet(f"{tmp_path}/test")
    plain = feature_build.run(spark, f"{tmp_path}/train", f"{tmp_path}/test", f"{tmp_path}/plain")
    laid = feature_build.run(spark, f"{tmp_path}/train", f"{tmp_path}/test", f"{tmp_path}/laid", cluster=True)
    one, other = (tables.read_train_features(spark, made["train_features"]) for made in (plain, laid))
    assert rows_of(one) == rows_of(other)
    assert spark.read.parquet(f"{laid['train_features']}.files").count() >= 1
    with pytest.raises(ValueError, match="Parquet"):
        feature_build.run(spark, f"{tmp_path}/train", f"{tmp_path}/test", f"{tmp_path}/x", cluster=True, fmt="csv")
