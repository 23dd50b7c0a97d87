"""The registered forest queries do the whole job: all labels, folds, regions and trees."""

import pytest

from occugrid.operators import forest
from occugrid.operators.logistic import FINAL
from occugrid.plans import catalog, modelling


class Asked(Exception):
    pass


@pytest.mark.parametrize(
    ("name", "keep_unlabelled", "held_out"),
    [
        ("loc2spec_cv_metrics", False, range(1, 6)),
        ("spec2loc_cv_metrics_rf", True, range(1, 6)),
        ("final_model_predictions_rf", True, [FINAL]),
    ],
)
def test_all_forests_are_asked_for(spark, sf_dir, monkeypatch, name, keep_unlabelled, held_out):
    def asked(rows, feature_columns, counts, params):
        raise Asked(set(counts), rows.count(), params)

    monkeypatch.setattr(forest, "held_out_scores", asked)
    monkeypatch.setattr(forest, "fit", asked)
    with pytest.raises(Asked) as found:
        catalog.QUERIES[name](spark, sf_dir)
    counts, n_rows, params = found.value.args
    whole = modelling.dataset(catalog.features(spark, sf_dir), 50, 5, keep_unlabelled)
    assert counts == {(fold, rank) for fold in held_out for rank in range(50)}
    assert n_rows == whole.rows.count()
    assert params == forest.ForestParams()
    assert (params.num_trees, params.max_depth) == (300, None)
