import math
import random

import pytest

from occugrid import schemas
from occugrid.operators import metrics


def table(spark, rows):
    """(fold, taxon_id, p, y) -> score table."""
    full = [(f, f"r{i}", t, 0, y, p, int(p > 0.5)) for i, (f, t, p, y) in enumerate(rows)]
    return spark.createDataFrame(full, schemas.SCORES)


def only(df):
    (row,) = df.collect()
    return row


def brute(cells):
    """AUC over all pairs, AP and F1 over thresholds, from (p, y)."""
    pos, neg = [p for p, y in cells if y], [p for p, y in cells if not y]
    auc = ap = None
    if pos and neg:
        auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    if pos:
        ap = sum(
            sum(p == t for p in pos) * sum(p >= t for p in pos) / sum(p >= t for p, _ in cells)
            for t in {p for p, _ in cells}
        ) / len(pos)
    tp, fp = sum(p > 0.5 for p in pos), sum(p > 0.5 for p in neg)
    errors = fp + len(pos) - tp
    f1 = 2 * tp / (2 * tp + errors) if tp + errors else 0.0
    return auc, ap, f1


@pytest.mark.parametrize(
    "cells, auc, ap",
    [
        ([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], 0.75, 0.833333333),
        ([(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1), (0.4, 1), (0.1, 1)], 0.6875, 0.791666667),
    ],
)
def test_known_values(spark, cells, auc, ap):
    row = only(metrics.label_metrics(table(spark, [(1, 5, *cell) for cell in cells])))
    assert row.roc_auc == pytest.approx(auc, abs=1e-9)
    assert row.pr_auc == pytest.approx(ap, abs=1e-9)


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_brute_force(spark, seed):
    rng = random.Random(seed)
    draws = [
        rng.random,
        lambda: rng.randrange(9) / 8,
        lambda: 1e-9 * rng.random(),
        lambda: 1 - 1e-12 * rng.random(),
    ]
    rows = [
        (f, t, rng.choice(draws)(), rng.randrange(2))
        for f in (1, 2) for t in (7, 8, 9) for _ in range(40)
    ]
    scores = table(spark, rows)
    per_label = metrics.label_metrics(scores)
    for r in per_label.collect():
        expected = brute([(p, y) for f, t, p, y in rows if (f, t) == (r.fold, r.taxon_id)])
        assert (r.roc_auc, r.pr_auc, r.f1) == pytest.approx(expected)
    for r in metrics.fold_metrics(scores, per_label).collect():
        expected = brute([(p, y) for f, _, p, y in rows if f == r.fold])
        assert (r.roc_auc_micro, r.pr_auc_micro, r.f1_micro) == pytest.approx(expected)
        labels = [brute([(p, y) for f, t, p, y in rows if (f, t) == (r.fold, taxon)]) for taxon in (7, 8, 9)]
        macro = [sum(column) / 3 for column in zip(*labels)]
        assert (r.roc_auc_macro, r.pr_auc_macro, r.f1_macro) == pytest.approx(macro)


def test_confusion_agrees_with_the_curve(spark):
    rng = random.Random(4)
    scores = table(spark, [(1, rng.randrange(3), rng.random(), rng.randrange(2)) for _ in range(90)])
    columns = ["fold", "taxon_id", "tp", "fp", "fn", "f1"]
    one = metrics.confusion(scores, metrics.LABEL_KEYS).select(columns).collect()
    two = metrics.label_metrics(scores).select(columns).collect()
    assert sorted(one) == sorted(two)


def test_scores_close_together_are_spread(spark):
    """20,000 scores within a billionth: no range has most of them, and the curve is the same."""
    rng = random.Random(8)
    cells = [(0.5 + 1e-9 * rng.random(), rng.randrange(2)) for _ in range(20_000)]
    scores = table(spark, [(1, 5, *cell) for cell in cells])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = metrics.distinct_scores(scores, metrics.LABEL_KEYS).groupBy("part").count().collect()
        found = only(metrics.label_metrics(scores))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) == 4 and max(part["count"] for part in parts) < 8_000
    ranked = sorted(cells)
    rank_sum = sum(i for i, (_, y) in enumerate(ranked, 1) if y)
    n_pos = sum(y for _, y in cells)
    auc = (rank_sum - n_pos * (n_pos + 1) / 2) / n_pos / (len(cells) - n_pos)
    hits = [i for i, (_, y) in enumerate(reversed(ranked), 1) if y]
    ap = sum(k / i for k, i in enumerate(hits, 1)) / n_pos
    assert (found.roc_auc, found.pr_auc) == pytest.approx((auc, ap))


def test_no_scores(spark):
    assert metrics.label_metrics(table(spark, [])).collect() == []


def test_validation_fold_with_one_class(spark):
    positive = metrics.label_metrics(table(spark, [(1, 5, 0.2, 1), (1, 5, 0.9, 1)]))
    row = only(metrics.defined_only(positive))
    assert (row.roc_auc, row.pr_auc, row.f1) == (None, 1.0, None)
    negative = metrics.label_metrics(table(spark, [(1, 5, 0.2, 0), (1, 5, 0.9, 0)]))
    row = only(metrics.defined_only(negative))
    assert (row.roc_auc, row.pr_auc, row.f1) == (None, None, None)


def test_no_positive_and_no_prediction_counts_as_zero_f1(spark):
    scores = table(spark, [(1, 5, 0.2, 0), (1, 6, 0.9, 1)])
    row = only(metrics.f1_per_fold(metrics.confusion(scores, metrics.LABEL_KEYS)))
    assert (row.micro_f1, row.macro_f1) == (1.0, 0.5)


def test_one_undefined_species_makes_the_macro_auc_undefined(spark):
    scores = table(spark, [(1, 5, 0.2, 0), (1, 5, 0.3, 1), (1, 6, 0.9, 0), (1, 6, 0.8, 0)])
    row = only(metrics.fold_metrics(scores, metrics.label_metrics(scores)))
    assert row.roc_auc_macro is None
    assert row.pr_auc_macro == 0.5


def test_means_skip_undefined_folds(spark):
    rows = [(1, 5, 10, 5, 0.8, 0.5, 0.25), (2, 5, 0, 9, None, None, 0.0)]
    frame = spark.createDataFrame(
        rows, "fold INT, taxon_id BIGINT, n_pos BIGINT, n_neg BIGINT, roc_auc DOUBLE, pr_auc DOUBLE, f1 DOUBLE"
    )
    assert tuple(only(metrics.species_means(frame))) == (5, 0.8, 0.5, 0.25)


# Published cross-validation results (fixed values): rows per fold, then their mean.
MICRO_MACRO_F1 = [
    ("1", 0.48267596426236653, 0.4824502104739585),
    ("2", 0.501491877555531, 0.5026742993842493),
    ("3", 0.5, 0.500682267922182),
    ("4", 0.5072805139186296, 0.507390224462082),
    ("5", 0.49616648411829134, 0.4970306814933835),
    ("mean", 0.4975229679709637, 0.498045536747171),
]


def test_published_fold_table_is_reproduced(spark):
    folds = [(int(fold), micro, macro) for fold, micro, macro in MICRO_MACRO_F1[:-1]]
    frame = spark.createDataFrame(folds, "fold INT, micro_f1 DOUBLE, macro_f1 DOUBLE")
    rows = sorted(map(tuple, metrics.fold_table(frame).collect()))
    for ours, published in zip(rows, MICRO_MACRO_F1):
        assert ours[0] == published[0]
        assert ours[1:] == pytest.approx(published[1:], abs=1e-15)


def test_species_table_and_log(spark):
    per_species = spark.createDataFrame([(5, 0.9, 0.5, 0.4)], "taxon_id BIGINT, roc_auc DOUBLE, pr_auc DOUBLE, f1 DOUBLE")
    names = ["roc_auc_micro", "pr_auc_micro", "f1_micro", "roc_auc_macro", "pr_auc_macro", "f1_macro"]
    per_fold = spark.createDataFrame(
        [(2, 0.5, 0.25, 0.75, 1.0, 0.0, 0.5), (1, 1.0, 0.75, 0.25, None, 1.0, 0.5)],
        "fold INT, " + ", ".join(f"{name} DOUBLE" for name in names),
    )
    rows = {r.taxon_id: tuple(r)[1:] for r in metrics.species_table(per_species, per_fold).collect()}
    assert rows == {"5": (0.9, 0.5, 0.4), "micro": (0.75, 0.5, 0.5), "macro": (1.0, 0.5, 0.5)}
    log = only(metrics.cv_log(per_fold, 50, 2, "rf", 42))
    assert log.params.asDict() == {"topk": 50, "cv_splits": 2, "model": "rf", "seed": 42}
    assert [fold.fold for fold in log.folds] == [1, 2]
    assert list(log.folds[0].asDict()) == ["fold", *names]
    assert not any(isinstance(v, float) and math.isnan(v) for v in log.folds[0])
