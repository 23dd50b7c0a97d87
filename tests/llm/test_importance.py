import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import NASTY, SF_DIR

from occugrid.llm import importance, prefix_crc, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain_buckets(text, buckets, longest=2):
    w = plain_words(text)
    runs = [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    return [zlib.crc32(run.encode()) % buckets for run in runs]


def plain(docs, target, buckets=10_000, percent=25, min_words=20, seed=7):
    """``(id, n_features, weight, score, rank)``, each run cut out and hashed by itself."""
    own = Counter(b for _, text in docs for b in plain_buckets(text, buckets))
    wanted = Counter(b for text in target for b in plain_buckets(text, buckets))
    all_own, all_wanted = sum(own.values()), sum(wanted.values())
    rows = []
    for doc_id, text in docs:
        found = plain_buckets(text, buckets)
        gains = [
            math.floor(1000 * math.log((wanted[b] + 1) * (all_own + buckets) / ((own[b] + 1) * (all_wanted + buckets))))
            for b in found
        ]
        weight = math.floor(sum(gains) / len(gains)) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, len(found), weight, score, len(plain_words(text))))
    able = sorted(
        (r for r in rows if r[4] >= min_words),
        key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[4]),
    )
    ranked = [(*r[:4], i + 1 if i < percent * len(able) // 100 else None) for i, r in enumerate(able)]
    ranked += [(*r[:4], None) for r in rows if r[4] < min_words]
    return sorted(ranked, key=repr)


def test_running_crcs_give_every_run():
    rng = np.random.default_rng(3)
    sizes = [1, 2, 3, 61, 62, 63, 64, 65, 127, 128, 4096, 70_001, 5, 1]
    words = [bytes(rng.choice(list(b"abcxyz019\xc3\xbf"), size).tolist()) for size in sizes]
    for longest in (1, 2, 3, 5):
        runs = [b" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        assert prefix_crc.gram_crcs(words, longest).tolist() == [zlib.crc32(run) for run in runs]
    assert prefix_crc.gram_crcs([], 2).tolist() == []
    assert prefix_crc.gram_crcs([b"a"], 3).tolist() == [zlib.crc32(b"a")]


def test_query_against_brute_force(spark, rows):
    target = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    found = queries.QUERIES["op11_importance_resampling"](spark, SF_DIR)
    assert found.columns[:5] == ["doc_id", "n_features", "weight", "score", "rank"]
    expected = plain([(i, text) for i, text, _ in rows], target)
    assert sorted((tuple(r)[:5] for r in found.collect()), key=repr) == expected
    ranks = sorted(r[4] for r in expected if r[4])
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) > 20


@pytest.mark.parametrize(("percent", "min_words"), [(25, 20), (50, 1), (100, 0), (0, 0)])
def test_awkward_rows(spark, nasty, percent, min_words):
    target = spark.createDataFrame([(None,), ("",), ("two words",), ("one é",)], "text string")
    ranked = importance.resample(importance.importance(nasty, target, buckets=97), "doc_id", percent, min_words)
    expected = plain(
        [(i, text) for i, text, _ in NASTY], [None, "", "two words", "one é"], 97, percent, min_words
    )
    assert sorted((tuple(r)[:5] for r in ranked.collect()), key=repr) == expected


def test_empty_tables(spark, nasty, empty):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(importance.importance(empty, none)).collect() == []
    expected = plain([(i, text) for i, text, _ in NASTY], [])
    ranked = importance.resample(importance.importance(nasty, none))
    assert sorted((tuple(r)[:5] for r in ranked.collect()), key=repr) == expected


def test_ties_go_to_smaller_ids_over_many_ranges(spark):
    rows = [(i, 30, 5, 9, 9) for i in range(1000)]
    weighed = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long")
    ranked = importance.resample(weighed.repartition(7)).where("rank is not null").collect()
    assert {r.doc_id: r["rank"] for r in ranked} == {i: i + 1 for i in range(250)}


def test_drawn_documents_look_more_like_the_target(spark, make_docs):
    docs = [(i, f"{'target words here ' * 8 if i % 4 == 0 else 'other things there ' * 8} n{i}", "s") for i in range(200)]
    frame = make_docs(docs)
    target = spark.createDataFrame([("target words here",)] * 50, "text string")
    taken = importance.drawn(frame, importance.resample(importance.importance(frame, target)))
    assert taken.columns == frame.columns and taken.count() == 50
    assert taken.where("doc_id % 4 = 0").count() > 25
