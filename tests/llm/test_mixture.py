from collections import defaultdict

import pytest
from conftest_llm import NASTY, WORD

from occugrid.llm import mixture


def fill(sizes, weights=(1, 2, 3)):
    """Targets by sharing again what is over, until no target is above its bound."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    names += [None] if None in sizes else []
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full, left = {}, set(), float(sum(sizes.values()))
    while True:
        free = [s for s in names if s not in full]
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        over = [s for s in free if share[s] >= 3 * sizes[s]]
        if not over:
            return {**target, **share}
        for s in over:
            target[s] = 3.0 * sizes[s]
            full.add(s)
        left = sum(sizes.values()) - sum(target.values())
        if len(full) == len(names):
            return target


def checked(docs, rows, **options):
    sizes, count = defaultdict(int), {}
    for i, text, source in rows:
        n = len(WORD.findall(text or ""))
        sizes[source] += n
        count.setdefault((i, n, source), 0)
        count[i, n, source] += 1
    mixed = mixture.mix(docs, **options)
    wanted = fill(sizes)
    taken = defaultdict(int)
    found = mixed.documents.count()
    assert found == len(rows)
    rows_taken = mixture.taken(mixed).collect()
    assert len(rows_taken) == len(rows)
    for r in rows_taken:
        assert r["taken"] <= 3 * r["size"]
    for r in mixed.pieces.collect():
        taken[r["source"]] += r["length"]
        assert 0 <= r["start"] and r["start"] + r["length"] <= r["size"]
    for r in mixed.sources.collect():
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(wanted[r["source"]])
        assert taken[r["source"]] == r["words"]
    return mixed, rows_taken


def test_targets_are_met(documents, rows):
    mixed, first = checked(documents, rows)
    again = mixture.taken(mixture.mix(documents.repartition(5))).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


def test_small_sources_are_full(make_docs):
    rows = [(i, "w " * 300, "big") for i in range(50)]
    rows += [(100, "a b c", "a"), (101, "a b c d", "c"), (102, "", "e"), (103, "x", None)]
    checked(make_docs(rows), rows)


def test_slots_follow_the_shares(make_docs):
    """Low discrepancy: the slots of every source keep close to its share at any time."""
    rows = [(i, "w " * (10 + i % 5), f"s{i % 4}") for i in range(200)]
    mixed = mixture.mix(make_docs(rows))
    total = sum(r["words"] for r in mixed.sources.collect())
    share = {r["source"]: r["words"] / total for r in mixed.sources.collect()}
    pieces = mixed.pieces.select("slot", "source").distinct().orderBy("slot").collect()
    seen = defaultdict(int)
    for n, r in enumerate(pieces, 1):
        seen[r["source"]] += 1
        if n % 97 == 0:
            for source, part in share.items():
                assert abs(seen[source] - part * n) < 12


def test_awkward_rows(nasty, empty):
    checked(nasty, NASTY)
    assert mixture.taken(mixture.mix(empty)).count() == 0
    assert mixture.mixed_documents(empty).count() == 0


def test_mixed_documents(documents, rows, nasty):
    out = mixture.mixed_documents(documents)
    assert out.schema == documents.schema
    mixed = mixture.mix(documents)
    words = defaultdict(int)
    texts = {i: text for i, text, _ in rows}
    for r in out.collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["text"].strip() in texts[r["doc_id"]]
        assert r["n_chars"] == len(r["text"])
    wanted = {r["doc_id"]: r["taken"] for r in mixture.taken(mixed).collect() if r["taken"]}
    assert words == wanted
    assert mixture.mixed_documents(nasty).schema == nasty.schema
