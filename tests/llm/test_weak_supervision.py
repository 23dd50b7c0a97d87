import re
from collections import Counter

import numpy as np
import pytest
from conftest_llm import NASTY, SF_DIR, WORD

from occugrid.llm import weak_supervision as ws


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    grams = Counter(tuple(words[i : i + 5]) for i in range(n - 4))
    covered = {
        j for i in range(n - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)
    }
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        n,
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
        n < 10 or 100 * len(covered) > 20 * n,
    )


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_counts_against_brute_force(documents, rows, make_docs):
    judged = ws.judge(documents).select("row.doc_id", *NAMES).collect()
    assert {r[0]: tuple(r[1:]) for r in judged} == {i: counts(t) for i, t, _ in rows}
    awkward = [
        "a b c d e a b c d e a b c d e",
        "x x x x x x x x x x x x",
        "one two three four five " * 5000,
        "a b c d e f g a b c d e f",
        "line\nline\n \nline",
        "\x1f\x85 #*$%&|<>",
    ]
    own = [*NASTY, *[(100 + i, text, "s") for i, text in enumerate(awkward)]]
    judged = ws.judge(make_docs(own)).select("row.doc_id", "row.text", *NAMES).collect()
    assert Counter(tuple(r) for r in judged) == Counter((i, t, *counts(t)) for i, t, _ in own)


def em(patterns, rounds):
    """The same estimate in NumPy: patterns of votes with their counts."""
    votes = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    for_it, against = (votes == 1).sum(1), (votes == -1).sum(1)
    p = (for_it + 1) / (for_it + 2 * against + 2)
    s = ws.SMOOTHING
    for _ in range(rounds + 1):
        prior = ((n * p).sum() + s) / (n.sum() + 2 * s)

        def rates(weight):
            voted = (weight[:, None] * (votes != 0)).sum(0)
            return ((weight[:, None] * (votes == 1)).sum(0) + s) / (voted + 2 * s)

        good, bad = rates(n * p), rates(n * (1 - p))
        odds = np.log(prior / (1 - prior)) + np.where(
            votes == 1,
            np.log(good / bad),
            np.where(votes == -1, np.log((1 - good) / (1 - bad)), 0.0),
        ).sum(1)
        p = 1 / (1 + np.exp(-odds))
    return p


def test_expectation_maximisation(documents):
    voted = ws.with_votes(ws.with_features(documents)).select("pattern")
    found = {r["pattern"]: r["posterior"] for r in ws.posteriors(voted, rounds=7).collect()}
    counted = sorted(Counter(r["pattern"] for r in voted.collect()).items())
    patterns = [
        ([code // 3**r % 3 - 1 for r in range(len(ws.RULES))], count) for code, count in counted
    ]
    wanted = em(patterns, rounds=7)
    assert list(found) and sorted(found) == [code for code, _ in counted]
    assert [found[code] for code, _ in counted] == pytest.approx(wanted.tolist(), abs=1e-9)


def test_verdicts_agree_with_labels(spark):
    folder = SF_DIR.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    judged = ws.judge(docs).select("row.doc_id", "base_failed", "kept").join(labels, "doc_id")
    table = Counter((r["quality"], r["kept"]) for r in judged.where("not base_failed").collect())
    assert table[1, False] <= 0.01 * table[1, True]
    assert table[0, True] <= 0.1 * max(1, table[0, False])


def test_keeping(nasty, empty, documents):
    kept = ws.keep_good(documents)
    assert kept.schema == documents.schema
    assert 0 < kept.count() < documents.count()
    assert ws.keep_good(nasty).schema == nasty.schema
    assert ws.judge(empty).count() == 0
