import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from occugrid import schemas
from occugrid.operators import observations as obs
from occugrid.operators import presence
from occugrid.plans import feature_build
from occugrid.sources import tables


def frame(spark, *records):
    return spark.createDataFrame(list(records), schemas.OBSERVATIONS)


def one(df):
    (row,) = df.collect()
    return row


@pytest.mark.parametrize(
    "lat, lon, cell, hemisphere",
    [
        (-0.5, 0.0, (-1, 0), "S"),
        (0.0, -0.25, (0, -1), "N"),
        (-0.0, 10.9, (0, 10), "N"),
        (90.0, 180.0, (90, 180), "N"),
        (-90.0, -180.0, (-90, -180), "S"),
    ],
)
def test_grid_cell_and_hemisphere(spark, lat, lon, cell, hemisphere):
    row = one(obs.add_features(frame(spark, (0, lat, lon, 1))))
    assert (row.grid_lat, row.grid_lon) == cell
    assert row.region == f"{cell[0]}°{cell[1]}°"
    assert row.hemisphere == hemisphere
    assert row.sin_lon == pytest.approx(math.sin(math.radians(lon)), abs=1e-15)
    assert row.cos_lon == pytest.approx(math.cos(math.radians(lon)), abs=1e-15)


@pytest.mark.parametrize("bad", [None, math.nan, math.inf, -math.inf])
def test_invalid_coordinates_are_refused_and_listed(spark, bad):
    points = frame(spark, (0, 1.0, 2.0, 1), (1, bad, 2.0, 1), (2, 1.0, bad, 1))
    assert {row.row_id for row in obs.invalid_coordinates(points).collect()} == {1, 2}
    with pytest.raises(PySparkException, match="null, NaN or infinite"):
        obs.add_features(points).collect()


def test_union_keeps_the_first_record_of_a_duplicate(spark):
    train = frame(spark, (0, 1.0, 2.0, 7), (1, 1.0, 2.0, 7), (2, 1.0, 2.0, 8))
    extra = frame(spark, (0, 1.0, 2.0, 7), (1, 5.0, 2.0, 7))
    rows = obs.deduplicate(obs.union_sources(train, extra)).collect()
    kept = {(row.lat, row.lon, row.taxon_id): row.row_id for row in rows}
    assert kept == {(1.0, 2.0, 7): 0, (1.0, 2.0, 8): 2, (5.0, 2.0, 7): obs.EXTRA_OFFSET + 1}


def test_negative_zero_is_the_same_coordinate(spark):
    points = frame(spark, (0, 0.0, 0.0, 1), (1, -0.0, -0.0, 1))
    assert obs.deduplicate(points).count() == 1


def test_missing_extra_source(spark):
    train = frame(spark, (0, 1.0, 2.0, 7))
    assert obs.union_sources(train).count() == 1


def test_names_absent_unmatched_and_duplicate(spark):
    points = frame(spark, (0, 1.0, 2.0, 7), (1, 1.0, 2.0, 8))
    assert {row.taxon_name for row in obs.attach_names(points, None).collect()} == {None}
    taxa = spark.createDataFrame(
        [(7, "old", 0), (7, "new", 1)], schemas.TAXA + ", position INT"
    )
    named = {r.taxon_id: r.taxon_name for r in obs.attach_names(points, taxa).collect()}
    assert named == {7: "new", 8: None}


def test_each_source_can_bring_its_own_names(spark):
    train, extra = frame(spark, (0, 1.0, 2.0, 7)), frame(spark, (0, 3.0, 2.0, 7))
    mine = spark.createDataFrame([(7, "a")], schemas.TAXA)
    theirs = spark.createDataFrame([(7, "b")], schemas.TAXA)
    rows = feature_build.train_features(train, extra, mine, theirs).collect()
    assert {(r.lat, r.taxon_name) for r in rows} == {(1.0, "a"), (3.0, "b")}


def test_coordinate_arrays(spark, tmp_path):
    spark.createDataFrame([(0, [1.5, 2.5], 9)], schemas.OBSERVATION_ARRAYS).write.parquet(f"{tmp_path}/a")
    row = one(tables.read_observation_arrays(spark, f"{tmp_path}/a"))
    assert (row.lat, row.lon, row.taxon_id) == (1.5, 2.5, 9)


def test_positions_follow_file_names_and_rows(spark, tmp_path):
    path = f"{tmp_path}/many"
    spark.range(1000).selectExpr("double(id) AS lat", "0D AS lon", "7L AS taxon_id").repartitionByRange(
        4, "lat"
    ).sortWithinPartitions("lat").write.parquet(path)
    rows = tables.read_observations(spark, path, by_position=True).orderBy("row_id").collect()
    assert [row.lat for row in rows] == [float(i) for i in range(1000)]
    assert len({row.row_id for row in rows}) == 1000


def test_positions_in_csv_files(spark, tmp_path):
    lines = spark.range(40_000).selectExpr("double(id) AS lat", "0D AS lon", "7L AS taxon_id")
    for name, files in (("one", 1), ("many", 12)):
        path = f"{tmp_path}/{name}"
        lines.repartitionByRange(files, "lat").sortWithinPartitions("lat").write.csv(path, header=True)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
        try:
            rows = tables.read_observations(spark, path, "csv", by_position=True)
            assert rows.where("row_id <> lat").isEmpty()
            assert rows.select("row_id").distinct().count() == 40_000
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_file_numbers_count_as_numbers(spark, tmp_path):
    for i, name in enumerate(("part-9", "part-99999", "part-100000")):
        frame = spark.createDataFrame([(float(2 * i + k), 0.0, 7) for k in range(2)], "lat DOUBLE, lon DOUBLE, taxon_id BIGINT")
        frame.coalesce(1).write.parquet(f"{tmp_path}/draft{i}")
        written = next((tmp_path / f"draft{i}").glob("part-*.parquet"))
        (tmp_path / "all").mkdir(exist_ok=True)
        written.rename(tmp_path / "all" / f"{name}.parquet")
    rows = tables.read_observations(spark, f"{tmp_path}/all", by_position=True).collect()
    assert sorted((r.row_id, r.lat) for r in rows) == [(i, float(i)) for i in range(6)]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
@pytest.mark.parametrize("files", [1, 3])
def test_listed_indices_find_their_location(spark, tmp_path, fmt, files):
    spark.range(4000).selectExpr("double(id) AS lat", "0D AS lon").repartitionByRange(
        files, "lat"
    ).sortWithinPartitions("lat").write.format(fmt).option("header", True).save(f"{tmp_path}/l")
    locations = tables.read_test_locations(spark, f"{tmp_path}/l", fmt, by_position=True)
    lists = spark.createDataFrame([(5, list(range(0, 4000, 10)))], schemas.TEST_PRESENCE)
    found = presence.species_presence(lists, locations)
    assert found.where("loc_id = lat").count() == 400
    counts = one(presence.absence_counts(lists, locations))
    assert (counts.n_present, counts.n_absent) == (400, 3600)
    lost = spark.createDataFrame([(5, [4000])], schemas.TEST_PRESENCE)
    with pytest.raises(PySparkException, match="no test location 4000"):
        presence.species_presence(lost, locations).collect()


def test_the_last_of_two_names_wins_by_position(spark, tmp_path):
    spark.createDataFrame([(7, "z"), (7, "a")], schemas.TAXA).coalesce(1).write.parquet(f"{tmp_path}/t")
    taxa = tables.read_taxa(spark, f"{tmp_path}/t", by_position=True)
    assert one(obs.taxon_dimension(taxa)).taxon_name == "a"


def test_two_names_need_a_position(spark):
    same = spark.createDataFrame([(7, "z"), (7, "z"), (8, None), (8, None)], schemas.TAXA)
    assert {(r.taxon_id, r.taxon_name) for r in obs.taxon_dimension(same).collect()} == {(7, "z"), (8, None)}
    for names in (("z", "a"), ("z", None)):
        taxa = spark.createDataFrame([(7, name) for name in names], schemas.TAXA)
        with pytest.raises(PySparkException, match="two names without a position: 7"):
            obs.taxon_dimension(taxa).collect()
    placed = spark.createDataFrame([(7, "z", 0), (7, None, 1)], schemas.TAXA + ", position BIGINT")
    assert one(obs.taxon_dimension(placed)).taxon_name is None


def test_missing_path_fails_on_read(spark, tmp_path):
    with pytest.raises(PySparkException, match="PATH_NOT_FOUND"):
        tables.read_train_features(spark, f"{tmp_path}/nowhere")


def test_csv_round_trip_keeps_names_that_look_missing(spark, tmp_path, make_features):
    features = make_features([(0, 0.1, 0.2, 1), (1, 1.0, 1.0, 2)], [(1, "NA"), (2, None)])
    path = tables.write_table(features, f"{tmp_path}/f", "csv")
    back = tables.read_train_features(spark, path, "csv")
    assert sorted(map(tuple, back.select("taxon_id", "taxon_name", "lat", "sin_lon").collect())) == sorted(
        map(tuple, features.select("taxon_id", "taxon_name", "lat", "sin_lon").collect())
    )


def test_dedup_is_one_hash_aggregation_shuffle(spark):
    plan = obs.deduplicate(frame(spark, (0, 1.0, 2.0, 1)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortAggregate" not in plan


def test_casts_id(spark):
    train = spark.createDataFrame([(0, 1.0, 2.0, "12")], "row_id BIGINT, lat DOUBLE, lon DOUBLE, taxon_id STRING")
    assert obs.union_sources(train).select(F.col("taxon_id") + 1).first()[0] == 13
