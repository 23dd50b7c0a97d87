"""A cross-validation that was stopped goes on where it stopped."""

import pytest

from occugrid.operators import forest, logistic, models
from occugrid.operators.forest import ForestParams
from occugrid.plans import catalog, modelling

SMALL = ForestParams(num_trees=5, max_depth=6)


class Stopped(Exception):
    pass


@pytest.fixture(scope="module")
def data(spark, sf_dir):
    return modelling.dataset(catalog.features(spark, sf_dir), 6, 3, keep_unlabelled=True)


def as_dict(scores):
    rows = scores.collect()
    found = {(r.fold, r.region, r.taxon_id): (pytest.approx(r.p, abs=1e-9), r.y, r.yhat) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize(("kind", "module", "name"), [("rf", forest, "held_out_scores"), ("lr", logistic, "fit")])
def test_only_missing_parts_are_fitted(data, tmp_path, monkeypatch, kind, module, name):
    monkeypatch.setattr(models, "LABELS_PER_PART", 4)
    whole = {key: (p.expected, y, yhat) for key, (p, y, yhat) in as_dict(
        models.cross_validate(data, kind, forest_params=SMALL)
    ).items()}
    done, limit, real = [], [2], getattr(module, name)

    def counted(*args):
        if len(done) == limit[0]:
            raise Stopped
        done.append(args)
        return real(*args)

    monkeypatch.setattr(module, name, counted)
    with pytest.raises(Stopped):
        models.cross_validate(data, kind, forest_params=SMALL, ledger=f"{tmp_path}/runs")
    assert len(done) == 2
    limit[0] = 100
    assert as_dict(models.cross_validate(data, kind, forest_params=SMALL, ledger=f"{tmp_path}/runs")) == whole
    assert len(done) == 3 * 2
    assert as_dict(models.cross_validate(data, kind, forest_params=SMALL, ledger=f"{tmp_path}/runs")) == whole
    assert len(done) == 6


def test_other_parameters_or_data_are_other_runs(data, spark, sf_dir, monkeypatch):
    keys = {models._run_key(data, "rf", 200, SMALL), models._run_key(data, "lr", 200, SMALL)}
    keys.add(models._run_key(data, "rf", 200, ForestParams(num_trees=5, max_depth=6, seed=1)))
    keys.add(models._run_key(data, "lr", 100, SMALL))
    other = modelling.dataset(catalog.features(spark, sf_dir), 5, 3, keep_unlabelled=True)
    keys.add(models._run_key(other, "rf", 200, SMALL))
    assert len(keys) == 5
    again = modelling.dataset(catalog.features(spark, sf_dir), 6, 3, keep_unlabelled=True)
    assert models._run_key(again, "rf", 200, SMALL) == models._run_key(data, "rf", 200, SMALL)
