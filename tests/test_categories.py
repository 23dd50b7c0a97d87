import pytest
from pyspark.sql import functions as F

from occugrid.operators import categories, labels, models, occupancy
from occugrid.operators.forest import ForestParams

SMALL = ForestParams(num_trees=5, max_depth=6)


def frame(spark, *values):
    return spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "id INT, soil STRING, wet BOOLEAN")


def test_dictionary_and_columns(spark):
    rows = frame(spark, ("sand", True), ("Clay", False), (None, None), ("loam", True), ("sand", True), ("", True))
    known = categories.known_categories(rows, ["soil", "wet"])
    assert known == {"soil": ["", "Clay", "loam", "sand"], "wet": ["false", "true"]}
    assert categories.one_hot_columns(known) == ["soil_Clay", "soil_loam", "soil_sand", "wet_true"]
    coded = categories.one_hot(rows, known).orderBy("id").select(*categories.one_hot_columns(known)).collect()
    assert [tuple(r) for r in coded] == [
        (0, 0, 1, 1), (1, 0, 0, 0), (0, 0, 0, 0), (0, 1, 0, 1), (0, 0, 1, 1), (0, 0, 0, 1)
    ]


def test_nothing_to_code(spark):
    assert categories.known_categories(frame(spark), []) == {}
    empty = frame(spark).where("false")
    known = categories.known_categories(empty, ["soil"])
    assert known == {"soil": []} and categories.one_hot_columns(known) == []
    assert categories.one_hot(empty, known).columns == empty.columns


def test_unseen_values(spark):
    known = {"soil": ["clay", "sand"]}
    rows = frame(spark, ("peat", True), ("sand", True), (None, True))
    assert [r.soil_sand for r in categories.one_hot(rows, known).orderBy("id").collect()] == [0, 1, 0]
    with pytest.raises(Exception, match="unknown category of soil: peat"):
        categories.one_hot(rows, known, unseen="fail").collect()
    assert categories.one_hot(rows.where("id > 0"), known, unseen="fail").count() == 2
    with pytest.raises(ValueError, match="unseen"):
        categories.one_hot(rows, known, unseen="drop")


def test_too_many_or_clashing_categories_are_refused(spark):
    many = spark.range(categories.MAX_CATEGORIES + 1).selectExpr("string(id) AS soil")
    with pytest.raises(ValueError, match="more than"):
        categories.known_categories(many, ["soil"])
    with pytest.raises(ValueError, match="share a column"):
        categories.one_hot_columns({"a": ["x", "b_c"], "a_b": ["x", "c"]})
    with pytest.raises(ValueError, match="share a column"):
        categories.one_hot_columns({"soil": ["", "Clay", "clay"]})


@pytest.fixture(scope="module")
def soils(spark):
    """Species 1 grows on sand, species 2 everywhere, species 3 in the south only."""
    from occugrid.operators import observations

    records = []
    for lat in range(-6, 8):
        for lon in range(-4, 6):
            soil = ("clay", "peat", "sand")[(lat * 5 + lon * 3) % 3]
            present = [2] + [1] * (soil == "sand") + [3] * (lat < 0)
            records += [(len(records) + i, lat + 0.5, lon + 0.5, s, soil) for i, s in enumerate(present)]
    schema = "row_id BIGINT, lat DOUBLE, lon DOUBLE, taxon_id BIGINT, soil STRING"
    return observations.add_features(spark.createDataFrame(records, schema))


@pytest.fixture(scope="module")
def data(soils):
    top = occupancy.top_species(occupancy.species_support(occupancy.occupancy(soils)), 3)
    return models.prepare(soils, top, 2, True, categorical=("hemisphere", "soil"))


def test_regions_have_the_category_of_their_first_observation(soils, data):
    assert data.categories == {"hemisphere": ["N", "S"], "soil": ["clay", "peat", "sand"]}
    assert data.feature_columns == labels.NUMERIC_FEATURES + ["hemisphere_S", "soil_peat", "soil_sand"]
    expected = {(r.region, r.soil) for r in soils.collect()}
    rows = data.rows.collect()
    assert {(r.region, r.soil) for r in rows} == expected
    assert all((r.soil_peat, r.soil_sand) == (int(r.soil == "peat"), int(r.soil == "sand")) for r in rows)


@pytest.mark.parametrize("kind", models.MODEL_KINDS)
def test_saved_models_bring_their_dictionary(spark, soils, data, tmp_path, kind):
    """Locations of one hemisphere and one soil are scored as among all others."""
    path = models.fit_final(data, f"{tmp_path}/model", kind, forest_params=SMALL)
    located = data.rows.select("region", "grid_lat", "grid_lon", "sin_lon", "cos_lon", "hemisphere", "soil")
    every = {(r.region, r.label_rank): (r.p, r.yhat) for r in models.predict(spark, path, data).collect()}
    few = located.where("hemisphere = 'S' and soil = 'sand'")
    found = models.predict_locations(spark, path, few, "region").collect()
    assert len(found) == 3 * few.count() > 0
    assert all((pytest.approx(r.p, abs=1e-9), r.yhat) == every[r.region, r.label_rank] for r in found)
    # A soil the models do not know is taken for the first one.
    strange = models.predict_locations(spark, path, few.withColumn("soil", F.lit("chalk")), "region")
    clay = models.predict_locations(spark, path, few.withColumn("soil", F.lit("clay")), "region")
    key = lambda r: (r.region, r.label_rank)
    assert sorted(strange.collect(), key=key) == sorted(clay.collect(), key=key)
    with pytest.raises(Exception, match="unknown category of soil: chalk"):
        models.predict_locations(
            spark, path, few.withColumn("soil", F.lit("chalk")), "region", unseen="fail"
        ).collect()


def test_a_dataset_without_a_category_is_predicted(spark, soils, data, tmp_path):
    """The regions of one hemisphere have no column of their own for it, but the models do."""
    path = models.fit_final(data, f"{tmp_path}/model", "lr")
    south = soils.where("hemisphere = 'S'")
    part = models.prepare(south, data.top, 2, True, categorical=("hemisphere", "soil"))
    assert "hemisphere_S" not in part.rows.columns
    every = {(r.region, r.label_rank): r.p for r in models.predict(spark, path, data).collect()}
    rows = models.predict(spark, path, part).collect()
    assert len(rows) == 3 * part.rows.count()
    assert all(r.p == pytest.approx(every[r.region, r.label_rank], abs=1e-9) for r in rows)
