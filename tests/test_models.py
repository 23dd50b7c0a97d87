import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from occugrid import storage
from occugrid.operators import forest, logistic, metrics, models, trees
from occugrid.operators.forest import ForestParams
from occugrid.plans import catalog, modelling

SMALL = ForestParams(num_trees=5, max_depth=6)


@pytest.fixture(scope="module")
def data(spark, sf_dir):
    return modelling.dataset(catalog.features(spark, sf_dir), 4, 2, keep_unlabelled=True)


def local(data, rank, held_out):
    rows = data.grid().filter((F.col("label_rank") == rank) & (F.col("fold") != held_out))
    pdf = rows.select(*data.feature_columns, "y").toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf[data.feature_columns].to_numpy(float)])
    return x, pdf["y"].to_numpy()


def newton(x, y):
    """Plain Newton iteration on the penalised, balanced objective."""
    cost = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        gradient = w + x.T @ (cost * (p - y))
        hessian = np.eye(len(w)) + (x * (cost * p * (1 - p))[:, None]).T @ x
        w = w - np.linalg.solve(hessian, gradient)
    return w


def test_logistic_equals_a_local_newton_solution(data):
    fitted = logistic.fit(data.grid(), data.feature_columns, [1, 2, logistic.FINAL])
    assert len(fitted.weights) == 4 * 3
    for (held_out, rank), weights in fitted.weights.items():
        assert weights == pytest.approx(newton(*local(data, rank, held_out)), abs=1e-5)


def test_logistic_equals_spark_ml(data):
    """Spark ML leaves the intercept unpenalised and ignores constant columns, so the intercept
    becomes a column and half of the rows are mirrored together with their label."""
    rows = data.grid().filter(F.col("label_rank") == 0)
    n, positives = rows.count(), rows.agg(F.sum("y")).first()[0]
    sign = F.when(F.xxhash64("region") % 2 == 0, 1.0).otherwise(-1.0)
    weight = F.when(F.col("y") == 1, n / (2 * positives)).otherwise(n / (2 * (n - positives)))
    mirrored = rows.select(
        weight.alias("weight"),
        F.when(sign > 0, F.col("y")).otherwise(1 - F.col("y")).cast("double").alias("label"),
        sign.alias("one"),
        *[(F.col(name) * sign).alias(name) for name in data.feature_columns],
    )
    vectors = VectorAssembler(inputCols=["one", *data.feature_columns], outputCol="features").transform(mirrored)
    reference = LogisticRegression(
        weightCol="weight", regParam=1 / n, standardization=False, fitIntercept=False, maxIter=500, tol=1e-12
    ).fit(vectors)
    ours = logistic.fit(data.grid().filter(F.col("label_rank") == 0), data.feature_columns, [logistic.FINAL])
    assert ours.weights[logistic.FINAL, 0] == pytest.approx(reference.coefficients.toArray(), abs=1e-4)


def test_single_class_training_set_gives_a_constant(spark, make_features):
    features = make_features([(i, i + 0.5, 0.5, 1) for i in range(6)] + [(9, 0.5, 0.6, 2)])
    data = modelling.dataset(features, 2, 2, keep_unlabelled=True)
    for kind in models.MODEL_KINDS:
        scores = models.cross_validate(data, kind, forest_params=SMALL)
        assert {r.p for r in scores.filter(F.col("taxon_id") == 1).collect()} == {1.0}
        rare = scores.filter((F.col("taxon_id") == 2) & (F.col("y") == 1)).first()
        assert (rare.p, rare.yhat) == (0.0, 0)


def test_unknown_model_kind(data):
    with pytest.raises(ValueError):
        models.cross_validate(data, "svm")


@pytest.mark.parametrize("kind", models.MODEL_KINDS)
def test_every_cell_is_scored_once_and_out_of_fold(data, kind):
    scores = models.cross_validate(data, kind, forest_params=SMALL)
    truth = {(r.fold, r.region, r.label_rank, r.y) for r in data.grid().collect()}
    rows = scores.collect()
    assert {(r.fold, r.region, r.label_rank, r.y) for r in rows} == truth
    assert len(rows) == len(truth)
    for r in rows:
        assert 0 <= r.p <= 1
        if r.p != 0.5:
            assert r.yhat == (r.p > 0.5)


def test_forest_is_reproducible_and_beats_chance(spark, sf_dir):
    data = modelling.dataset(catalog.features(spark, "/root/testdata/sf0.01"), 2, 2, keep_unlabelled=True)
    runs = [storage.written_table(models.cross_validate(data, "rf", forest_params=SMALL), "s") for _ in range(2)]
    first, second = ({(r.region, r.label_rank): r.p for r in run.collect()} for run in runs)
    assert first == second
    for row in metrics.label_metrics(runs[0]).collect():
        assert row.roc_auc > 0.6


def test_forests_are_as_good_as_those_of_spark_ml(spark, sf_dir):
    """Held-out ranking of both, on the same folds; trees differ, since their draws do."""
    data = modelling.dataset(catalog.features(spark, "/root/testdata/sf0.01"), 3, 2, keep_unlabelled=True)
    ours = metrics.label_metrics(models.cross_validate(data, "rf", forest_params=ForestParams(num_trees=60)))
    own = {(r.fold, r.label_rank): r.roc_auc for r in ours.join(data.top, "taxon_id").collect()}
    vectors = VectorAssembler(inputCols=data.feature_columns, outputCol="features").transform(data.wide())
    for (fold, rank), auc in own.items():
        y = F.col("labels")[rank].cast("double").alias("label")
        fitted = RandomForestClassifier(numTrees=60, maxDepth=30, maxBins=512, featureSubsetStrategy="sqrt", seed=1).fit(
            vectors.where(F.col("fold") != fold).select("features", y)
        )
        scored = fitted.transform(vectors.where(F.col("fold") == fold).select("features", y))
        pairs = [(r.p, r.label) for r in scored.select(vector_to_array("probability")[1].alias("p"), "label").collect()]
        up, down = [p for p, y in pairs if y], [p for p, y in pairs if not y]
        other = np.mean([(a > b) + (a == b) / 2 for a in up for b in down])
        assert auc == pytest.approx(other, abs=0.06)


def test_blocks_of_trees_change_nothing(data, monkeypatch):
    """A forest cut into blocks is the same forest, grown, scored and saved."""
    whole = models.cross_validate(data, "rf", forest_params=SMALL).collect()
    path = storage.new_table_path(data.rows.sparkSession, "model")
    saved = models.predict(data.rows.sparkSession, models.fit_final(data, f"{path}/a", "rf", forest_params=SMALL), data)
    saved = {(r.region, r.label_rank): r.p for r in saved.collect()}
    monkeypatch.setattr(forest, "ROWS_AT_A_TIME", 2 * data.rows.count())
    monkeypatch.setattr(forest, "LOCATIONS", 20)
    parts = models.cross_validate(data, "rf", forest_params=SMALL).collect()
    key = lambda r: (r.fold, r.region, r.label_rank)
    assert {key(r): r.p for r in parts} == {key(r): pytest.approx(r.p, abs=1e-12) for r in whole}
    again = models.fit_final(data, f"{path}/b", "rf", forest_params=SMALL)
    nodes = data.rows.sparkSession.read.parquet(f"{again}/nodes")
    assert nodes.select("block").distinct().count() == 3
    found = models.predict(data.rows.sparkSession, again, data).collect()
    assert len(found) == len(saved)
    assert {(r.region, r.label_rank): r.p for r in found} == {k: pytest.approx(p, abs=1e-12) for k, p in saved.items()}


def test_prediction_takes_no_forest_to_the_driver(spark, data, tmp_path):
    path = models.fit_final(data, f"{tmp_path}/model", "rf", forest_params=SMALL)
    located = data.rows.select("region", "grid_lat", "grid_lon", "sin_lon", "cos_lon", "hemisphere")
    plan = models.predict_locations(spark, path, located, "region")._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "LocalRelation" not in plan
    twice = models.predict_locations(spark, path, located.union(located), "region").count()
    assert twice == 2 * located.count() * data.n_labels
    assert models.predict_locations(spark, path, located.limit(0), "region").collect() == []


@pytest.mark.parametrize("kind", models.MODEL_KINDS)
def test_saved_models_predict_like_the_fitted_ones(spark, data, tmp_path, kind):
    path = models.fit_final(data, f"{tmp_path}/model", kind, forest_params=SMALL)
    saved = {(r.region, r.label_rank): r.p for r in models.predict(spark, path, data).collect()}
    if kind == "lr":
        fitted = logistic.fit(data.grid(), data.feature_columns, [logistic.FINAL])
        scored = logistic.predict(data.grid(), fitted.table(spark), data.feature_columns)
        expected = {(r.region, r.label_rank): r.p for r in scored.collect()}
    else:
        local_rows = forest._collected(data.rows, data.feature_columns)
        expected = {}
        for rank in range(data.n_labels):
            grown = local_rows.forest(logistic.FINAL, rank, 0, SMALL.num_trees, SMALL)
            p = trees.walk(grown, SMALL.num_trees, local_rows.x) / SMALL.num_trees
            expected |= {(region, rank): one for region, one in zip(local_rows.region, p, strict=True)}
    assert saved.keys() == expected.keys()
    assert all(saved[key] == pytest.approx(expected[key], abs=1e-9) for key in saved)
    metadata = spark.read.parquet(f"{path}/metadata").orderBy("label_rank").collect()
    assert [m.taxon_id for m in metadata] == [t.taxon_id for t in data.top.orderBy("label_rank").collect()]
    assert metadata[0].feature_columns == data.feature_columns


@pytest.mark.parametrize("kind", ["lr", "rf"])
def test_saved_models_score_locations_without_labels(spark, data, tmp_path, kind):
    path = models.fit_final(data, f"{tmp_path}/model", kind, forest_params=SMALL)
    known = {(r.region, r.label_rank): (r.p, r.yhat) for r in models.predict(spark, path, data).collect()}
    located = data.rows.select("region", "grid_lat", "grid_lon", "sin_lon", "cos_lon", "hemisphere")
    found = models.predict_locations(spark, path, located, "region").collect()
    assert {(r.region, r.label_rank): (pytest.approx(r.p, abs=1e-9), r.yhat) for r in found} == known


SCRIPT = """
import sys
from occugrid.session import get_session
from occugrid.operators import models
from occugrid.operators.forest import ForestParams
from occugrid.plans import catalog, modelling
spark = get_session("cores", sys.argv[1], spark__sql__shuffle__partitions="3", spark__checkpoint__dir=sys.argv[2])
data = modelling.dataset(catalog.features(spark, sys.argv[3]), 2, 2)
scores = models.cross_validate(data, "rf", forest_params=ForestParams(num_trees=5, max_depth=6))
rows = scores.select("fold", "region", "taxon_id", "p").collect()
print("SCORES", sorted((r.fold, r.region, r.taxon_id, round(r.p, 9)) for r in rows))
"""


def test_forests_do_not_depend_on_the_cores(sf_dir, tmp_path):
    """Two sessions with different numbers of cores, each in a process of its own."""
    found = set()
    for master in ("local[2]", "local[4]"):
        done = subprocess.run(
            [sys.executable, "-c", SCRIPT, master, str(tmp_path / master[6]), sf_dir],
            capture_output=True, text=True, timeout=300, cwd=Path(__file__).parents[1],
        )
        assert done.returncode == 0, done.stderr[-2000:]
        found.add(done.stdout.rpartition("SCORES")[2])
    assert len(found) == 1 and len(found.pop()) > 1000
