import numpy as np
import pytest
from conftest_llm import NASTY, SF_DIR

from occugrid.llm import ordinal

MILD, BAD = "rude unkind", "awful vile hateful"


def graded(n, seed=1):
    rng = np.random.default_rng(seed)
    texts, grades = [], []
    for i in range(n):
        grade = i % 4
        words = [f"plain{w}" for w in rng.integers(0, 50, 30)]
        words += MILD.split() * (grade >= 1) + BAD.split() * (grade >= 2) + ["vile"] * 9 * (grade == 3)
        texts.append(" ".join(rng.permutation(words)))
        grades.append(grade)
    return texts, grades


def test_grades_on_held_out_texts():
    model = ordinal.fit(*graded(400), n_grades=4)
    texts, grades = graded(200, seed=2)
    chances = model.probabilities(np.array([model.score(t) for t in texts]))
    assert chances.shape == (200, 4) and np.allclose(chances.sum(1), 1) and (chances >= 0).all()
    assert (chances.argmax(1) == grades).mean() > 0.95
    expected = chances @ np.arange(4)
    assert np.corrcoef(expected, grades)[0, 1] > 0.95
    assert list(model.thresholds) == sorted(model.thresholds)


def test_slopes_agree_with_differences():
    """The fit lands where the penalised likelihood is flat in the thresholds and weights."""
    texts, grades = graded(80)
    grades = [min(g, 2) for g in grades]
    noise = np.random.default_rng(3).integers(0, 3, 80)
    grades = [int(n) if i % 5 == 0 else g for i, (g, n) in enumerate(zip(grades, noise, strict=True))]
    model = ordinal.fit(texts, grades, n_grades=3, penalty=0.05, rounds=3000)
    rows = [ordinal.features(t) for t in texts]

    def loss(weights, thresholds):
        other = ordinal.Ordinal(weights, thresholds)
        chances = other.probabilities(np.array([other.score(t) for t in texts]))
        likelihood = np.log(chances[np.arange(len(grades)), grades]).mean()
        return -likelihood + 0.025 * sum(w * w for w in weights.values())

    base = loss(model.weights, model.thresholds)
    assert rows and len(model.weights) > 3
    for k in range(2):
        for step in (-0.05, 0.05):
            moved = [t + step * (i == k) for i, t in enumerate(model.thresholds)]
            assert loss(model.weights, tuple(moved)) >= base - 1e-5
    for name in list(model.weights)[:8]:
        for step in (-0.05, 0.05):
            assert loss({**model.weights, name: model.weights[name] + step}, model.thresholds) >= base - 1e-5


def test_nothing_to_learn():
    for texts, grades in (([], []), (["a b"] * 9, [0] * 9)):
        model = ordinal.fit(texts, grades, n_grades=3)
        chances = model.probabilities(np.zeros(1))
        assert not model.weights and chances.sum() == pytest.approx(1)


def test_toxic_documents_of_the_other_half(spark):
    folder = SF_DIR.replace("0.001", "0.1")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    seen, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    texts, toxic = ordinal.labelled_sample(docs, seen)
    model = ordinal.fit(texts, ordinal.grades_by_dose(texts, toxic), n_grades=4)
    found = ordinal.predict(docs, model).join(held, "doc_id").select("toxic", "p_above").collect()
    y = np.array([r["toxic"] for r in found])
    called = np.array([r["p_above"] for r in found]) >= ordinal.TOXIC
    assert (called & (y == 1)).sum() > 0.85 * (y == 1).sum()
    assert (called & (y == 0)).sum() < 0.01 * (y == 0).sum()


def test_sample_is_bounded(documents, spark):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    texts, _ = ordinal.labelled_sample(documents, labels, max_rows=20)
    assert 0 < len(texts) < 60


def test_awkward_rows(nasty, empty):
    model = ordinal.Ordinal({"one": 2.0}, (0.0, 1.0))
    found = ordinal.predict(nasty, model).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(i) for i, _, _ in NASTY)
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[2]["p_above"] == pytest.approx(0.5)
    assert by_id[9]["p_above"] > 0.75
    assert ordinal.predict(empty, model).count() == 0


def test_awkward_labels(nasty, spark):
    labels = spark.createDataFrame(
        [(4, 1), (5, 0), (None, 1), (9, None), (404, 1)], "doc_id long, toxic int"
    )
    texts, toxic = ordinal.labelled_sample(nasty, labels)
    assert sorted(toxic) == [0, 0, 1] and len(texts) == 3
