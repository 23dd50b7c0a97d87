"""``predict`` and the query against a plain second version of features and likelihood."""

import math
import re

import pytest
from conftest_llm import NASTY, SF_DIR

from occugrid.llm import ordinal, queries


def plain_score(model, text):
    counts = {}
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        for name in [word] + [word[:n] + "*" for n in (5, 6) if len(word) >= n]:
            counts[name] = counts.get(name, 0) + 1
    return sum(math.log1p(n) * model.weights.get(name, 0.0) for name, n in counts.items())


def plain_row(model, text):
    score = plain_score(model, text or "")
    at_most = [1 / (1 + math.exp(score - t)) for t in model.thresholds] + [1.0]
    chances = [b - a for a, b in zip([0.0, *at_most], at_most)]
    return sum(k * p for k, p in enumerate(chances)), chances.index(max(chances)), 1 - chances[0]


MODEL = ordinal.Ordinal(
    {"two": 1.5, "words": -0.5, "goes": 0.01, "one": 3.0, "ß": 2.0, "conti*": 1.0, "contin*": 0.5, "text": 0.2},
    (0.5, 1.0, 2.5),
)


def test_predict_against_the_plain_version(nasty):
    found = ordinal.predict(nasty, MODEL).collect()
    expected = [(i, *plain_row(MODEL, text)) for i, text, _ in NASTY]
    assert len(found) == len(expected)
    for row, want in zip(sorted(map(tuple, found), key=repr), sorted(expected, key=repr), strict=True):
        assert row == (want[0], pytest.approx(want[1]), want[2], pytest.approx(want[3]))


def test_words_forgotten_and_remembered_score_the_same(monkeypatch):
    texts = ["Continue two Words", "continual one", "contin conti cont two two two", "", "x" * 9, "TWO two Two"]
    for limit in (1, 2, 500_000):
        monkeypatch.setattr(ordinal, "KNOWN_WORDS", limit)
        score = MODEL.scorer()
        for text in texts * 2:
            assert score(text) == pytest.approx(plain_score(MODEL, text), abs=1e-12)
            assert MODEL.score(text) == pytest.approx(plain_score(MODEL, text), abs=1e-12)


def test_query_against_the_plain_version(spark, rows):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{name}.parquet") for name in ("documents", "labels"))
    texts, toxic = ordinal.labelled_sample(docs, labels)
    wanted = {r.doc_id: r.toxic for r in labels.collect()}
    assert sorted(texts) == sorted(t or "" for i, t, _ in rows if i in wanted)
    model = ordinal.fit(texts, ordinal.grades_by_dose(texts, toxic), n_grades=4)
    found = {r.doc_id: r for r in queries.QUERIES["op9_toxicity"](spark, SF_DIR).collect()}
    assert len(found) == len(rows)
    for i, text, _ in rows:
        expected, grade, p = plain_row(model, text)
        row = found[i]
        assert (row.expected_severity, row.p_toxic) == (pytest.approx(expected, abs=2e-6), pytest.approx(p, abs=2e-6))
        assert row.severity == grade and row.toxic == (p >= ordinal.TOXIC)


def test_grades_by_dose_against_counting():
    texts = ["bad vile foul"] * 6 + ["bad day"] * 5 + ["bad bad vile foul vile foul"] * 5 + ["good day"] * 40
    toxic = [1] * 16 + [0] * 40
    telling = {"bad", "vile", "foul"}
    doses = [sum(w in telling for w in t.split()) for t in texts]
    expected = [(1 + (d >= 3) + (d >= 6)) if y else 0 for d, y in zip(doses, toxic, strict=True)]
    assert ordinal.grades_by_dose(texts, toxic) == expected
