from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import SF_DIR, WORD
from test_line_dedup import key
from test_lsh_forest import classes
from test_mixture import fill
from test_weak_supervision import counts

import corpus_pipeline
from occugrid.llm import tokens, weak_supervision


@pytest.fixture(scope="module")
def stages(spark, documents):
    """The rows that each stage returns, from the rows of the one before."""
    out, docs = [[r.asDict() for r in documents.collect()]], documents
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, SF_DIR).collect()
        out.append([r.asDict() for r in rows])
        if len(out) < 6:
            docs = spark.createDataFrame(rows, documents.schema)
    return out


def test_order_and_columns(stages, documents):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "near duplicates", "source mixture", "packing"]
    for rows in stages[:-1]:
        assert rows and list(rows[0]) == documents.columns


def test_quality_rules(stages, documents):
    before, after = stages[0], stages[1]
    failed = {r["doc_id"] for r in before if counts(r["text"])[-1]}
    kept = {r["doc_id"] for r in after}
    assert not failed & kept
    judged = weak_supervision.judge(documents).where("kept").select("row.doc_id").collect()
    assert kept == {r["doc_id"] for r in judged} and len(after) == len(kept)
    texts = {r["doc_id"]: r["text"] for r in before}
    assert all(texts[r["doc_id"]] == r["text"] for r in after)


def test_line_dedup(stages):
    before, after = stages[1], stages[2]
    holders = defaultdict(set)
    for r in before:
        for line in r["text"].split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(r["doc_id"])
    wanted = {}
    for r in before:
        lines = [
            line
            for line in r["text"].split("\n")
            if len(holders.get(key(line), ())) < 5 or max(holders[key(line)]) == r["doc_id"]
        ]
        wanted[r["doc_id"]] = "\n".join(lines)
    assert {r["doc_id"]: r["text"] for r in after} == wanted
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_near_duplicates(stages):
    before, after = stages[2], stages[3]
    found = classes([(r["doc_id"], r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted({c for _, c, _ in found})


def test_source_mixture(stages):
    before, after = stages[3], stages[4]
    sizes, taken = defaultdict(int), Counter()
    for r in before:
        sizes[r["source"]] += len(WORD.findall(r["text"]))
    for r in after:
        taken[r["source"]] += len(WORD.findall(r["text"]))
    for source, target in fill(sizes).items():
        assert 0 <= target - taken[source] < 1 + 1e-6
    used = Counter(r["doc_id"] for r in after)
    assert max(used.values()) <= 3


def test_packing(stages):
    vocabulary = tokens.default_vocabulary()
    wanted = Counter(
        np.append(tokens.encode(r["text"], vocabulary), 0).astype("<u4").tobytes()
        for r in stages[4]
    )
    total = sum(len(text) * n for text, n in wanted.items())
    pieces = stages[5]
    assert sum(len(p["ids"]) for p in pieces) == total
    sequences = defaultdict(int)
    for p in pieces:
        sequences[p["sequence_id"]] += p["length"]
    assert max(sequences.values()) <= 1024


def test_run_reads_the_table(spark, stages):
    out = corpus_pipeline.run(spark, SF_DIR)
    assert out.columns == list(stages[5][0])
    got = out.groupBy("doc_id").sum("length").collect()
    wanted = Counter()
    for p in stages[5]:
        wanted[p["doc_id"]] += p["length"]
    assert {r[0]: r[1] for r in got} == wanted
