"""The jobs end to end: files in, files out."""

import csv
import json
from pathlib import Path

import pytest

from occugrid.operators.forest import ForestParams
from occugrid import storage
from occugrid.plans import exploration, feature_build, mining, modelling, summary
from occugrid.sources import events

SMALL = ForestParams(num_trees=3, max_depth=5)


def read_csv(path):
    rows = []
    for part in sorted(Path(path).glob("part-*.csv")):
        with open(part, encoding="utf-8", newline="") as handle:
            rows += list(csv.DictReader(handle))
    return rows


@pytest.fixture(scope="module")
def built(spark, sf_dir, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("jobs"))
    train, extra = events.train_and_extra(spark, sf_dir)
    inputs = {
        "train": train, "extra": extra, "taxa": events.taxa(spark, sf_dir),
        "test": events.test_locations(spark, sf_dir),
    }
    for name, df in inputs.items():
        df.write.parquet(f"{base}/{name}")
    paths = feature_build.run(
        spark, f"{base}/train", f"{base}/test", f"{base}/features", f"{base}/extra", f"{base}/taxa"
    )
    return base, paths


def test_feature_tables(spark, built):
    _, paths = built
    assert spark.read.parquet(paths["train_features"]).count() == 964
    assert spark.read.parquet(paths["test_features"]).count() == 1000


def test_pair_table_is_ordered_by_lift(spark, built):
    base, paths = built
    rows = read_csv(mining.run(spark, paths["train_features"], f"{base}/pairs", 3, 3))
    assert len(rows) == 781
    lifts = [float(row["lift"]) for row in rows]
    assert lifts == sorted(lifts, reverse=True)


def test_a_feature_csv_without_row_ids_is_enough(spark, built):
    base, paths = built
    features = spark.read.parquet(paths["train_features"])
    features.orderBy("row_id").drop("row_id").coalesce(1).write.csv(f"{base}/plain", header=True)
    rows = read_csv(mining.run(spark, f"{base}/plain", f"{base}/plain_pairs", 3, 3, "csv", by_position=True))
    assert rows == read_csv(mining.run(spark, paths["train_features"], f"{base}/pairs_again", 3, 3))


def test_chart_tables(spark, built):
    base, paths = built
    written = summary.run(spark, paths["train_features"], f"{base}/charts")
    assert len(written) == 5
    for name in ("hotspots", "lat_distribution", "lon_distribution", "hemisphere_distribution", "global_distribution"):
        assert sum(r.n for r in spark.read.parquet(written[name]).collect()) == 964


def test_location_to_species(spark, built):
    base, paths = built
    written = modelling.run_location_to_species(
        spark, paths["train_features"], f"{base}/l2s", topk=2, cv_splits=2, forest_params=SMALL
    )
    rows = read_csv(written["metrics"])
    assert [row["fold"] for row in rows] == ["1", "2", "mean"]
    folds, mean = rows[:-1], rows[-1]
    for name in ("micro_f1", "macro_f1"):
        assert float(mean[name]) == pytest.approx(sum(float(f[name]) for f in folds) / 2)


@pytest.mark.parametrize("kind", ["lr", "rf"])
def test_species_to_location(spark, built, kind):
    base, paths = built
    written = modelling.run_species_to_location(
        spark, paths["train_features"], f"{base}/s2l_{kind}", f"{base}/models",
        topk=3, cv_splits=2, model=kind, seed=7, forest_params=SMALL,
    )
    rows = read_csv(written["metrics"])
    assert [row["taxon_id"] for row in rows][-2:] == ["micro", "macro"] and len(rows) == 5
    (part,) = Path(written["log"]).glob("part-*.json")
    log = json.loads(part.read_text())
    assert log["params"] == {"topk": 3, "cv_splits": 2, "model": kind, "seed": 7}
    assert [fold["fold"] for fold in log["folds"]] == [1, 2]
    micro = {row["taxon_id"]: row for row in rows}["micro"]
    assert float(micro["roc_auc"]) == pytest.approx(sum(f["roc_auc_micro"] for f in log["folds"]) / 2)
    assert written["model"].endswith(f"spec2loc_{kind}")


def scratch(spark):
    root = storage.new_table_path(spark, "probe").rsplit("/", 1)[0].removeprefix("file:")
    return {path.name for path in Path(root).glob("*")}


def test_exploration_and_its_scratch_tables(spark, built, sf_dir, tmp_path):
    base, _ = built
    events.test_presence(spark, sf_dir).write.parquet(f"{tmp_path}/presence")
    before = scratch(spark)
    paths = exploration.run(
        spark, f"{base}/train", f"{base}/taxa", f"{base}/test", f"{tmp_path}/presence", f"{tmp_path}/out"
    )
    assert scratch(spark) == before
    tables_ = {name: spark.read.parquet(path) for name, path in paths.items()}
    (species,) = tables_["species"].collect()
    assert species.taxon_name in (None, f"taxon_{species.taxon_id}")
    assert {r.taxon_id for r in tables_["species_observations"].collect()} <= {species.taxon_id}
    kinds = {r.kind: r["count"] for r in tables_["species_locations"].groupBy("kind").count().collect()}
    counts = tables_["absence_counts"].where(f"taxon_id = {species.taxon_id}").first()
    assert (kinds.get("present", 0), kinds["absent"]) == (counts.n_present, counts.n_absent)
    assert tables_["stats"].count() == 1
