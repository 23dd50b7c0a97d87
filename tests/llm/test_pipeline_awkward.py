"""Every stage of the pipeline, and all of them in a row, over rows of every awkward kind."""

from collections import Counter

import pytest
from conftest_llm import NASTY

import corpus_pipeline


def texts_of(df):
    return Counter((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect())


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_each_stage(spark, nasty, empty, sf_dir, number):
    name, stage = corpus_pipeline.STAGES[number]
    none = stage(spark, empty, sf_dir)
    assert none.collect() == []
    found = stage(spark, nasty, sf_dir)
    if number < len(corpus_pipeline.STAGES) - 1:
        assert found.columns == nasty.columns == none.columns
        assert found.schema == nasty.schema or [f.dataType for f in found.schema] == [f.dataType for f in nasty.schema]
    given = Counter((i, t or "") for i, t, _ in NASTY)
    rows = found.collect()
    if name == "quality rules":
        assert texts_of(found) <= given
    elif name == "line dedup":
        assert Counter(r.doc_id for r in rows) == Counter(i for i, _, _ in NASTY)
        lines = {i: {line for j, t, _ in NASTY if j == i for line in (t or "").split("\n")} for i, _, _ in NASTY}
        assert all(set((r.text or "").split("\n")) <= lines[r.doc_id] | {""} for r in rows)
    elif name == "near duplicates":
        kept = texts_of(found)
        assert kept <= given and {t for _, t in kept} >= {t for _, t in given if 0 < len(t) < 40}
        assert max(Counter(t for _, t in kept.elements() if t).values()) == 1
    elif name == "source mixture":
        words = {i: [" ".join((t or "").split()) for j, t, _ in NASTY if j == i] for i, _, _ in NASTY}
        assert rows and all(any(" ".join(r.text.split()) in w for w in words[r.doc_id]) for r in rows if len(r.text) < 5000)
    else:
        assert Counter(r.doc_id for r in rows if r.start == 0) == Counter(i for i, _, _ in NASTY)
        assert all(r.length == len(r.ids) // 4 and 0 < r.length <= 1024 for r in rows)


def test_all_stages_in_a_row(spark, nasty, empty, sf_dir):
    for docs in (nasty, empty):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
        pieces = docs.collect()
        assert all(r.length == len(r.ids) // 4 for r in pieces)
    assert pieces == []
