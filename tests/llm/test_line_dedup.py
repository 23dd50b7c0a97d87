import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest_llm import NASTY

from occugrid.llm import line_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SMALLEST = -(2**63)


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def expected(rows, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    rows = [(SMALLEST if i is None else i, text or "") for i, text in rows]
    for i, text in rows:
        for line in text.split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = text.split("\n")
        stay = [
            not (len(holders.get(key(x), ())) >= min_docs and max(holders[key(x)]) != i)
            for x in lines
        ]
        kept = "\n".join(x for x, s in zip(lines, stay, strict=True) if s)
        out.append((i, len(lines), len(lines) - sum(stay), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def result(docs, **options):
    return sorted(
        (
            SMALLEST if r["row"]["doc_id"] is None else r["row"]["doc_id"],
            r["n_lines"],
            r["n_dropped"],
            hashlib.sha256(r["kept"].encode()).hexdigest(),
        )
        for r in line_dedup.with_kept_text(docs, **options).collect()
    )


def test_against_brute_force(documents, rows):
    got = result(documents, min_docs=3)
    assert got == expected([(i, t) for i, t, _ in rows], min_docs=3)
    assert sum(r[2] for r in got) > 0


def test_awkward_rows(nasty, empty):
    assert result(nasty, min_docs=2, min_chars=5) == expected(
        [(i, t) for i, t, _ in NASTY], min_docs=2, min_chars=5
    )
    assert line_dedup.keep_bitmaps(empty).count() == 0


def hot_rows():
    """One line in every document, one in a few, repeats inside a document, ties of case."""
    common = "A line that every single document has, again and again."
    rows = []
    for i in range(400):
        lines = [common if i % 2 else common.upper() + " ", f"only in document {i} " * 3]
        if i % 7 == 0:
            lines += ["a line of one document in seven, é, long enough"] * (1 + i % 3)
        if i == 13:
            lines += [common] * 50
        rows.append((i, "\n".join(lines), "s"))
    return rows


@pytest.mark.parametrize("held", [line_dedup.HELD, 16])
def test_a_line_of_all_documents(make_docs, held):
    """The line spans several ranges, and, with few rows held, several parts of a range."""
    rows = hot_rows()
    got = result(make_docs(rows).repartition(4), held=held)
    assert got == expected([(i, t) for i, t, _ in rows])


def test_bitmaps(make_docs):
    text = "x" * 50
    docs = make_docs([(i, f"{text}\nshort {i}", "s") for i in range(5)])
    bits = {
        r["id"]: np.unpackbits(np.frombuffer(zlib.decompress(r["keep"]), np.uint8))[: r["n_lines"]]
        for r in line_dedup.keep_bitmaps(docs).collect()
    }
    assert {i: b.tolist() for i, b in bits.items()} == {
        **{i: [0, 1] for i in range(4)},
        4: [1, 1],
    }


def test_documents_keep_their_columns(nasty):
    out = line_dedup.drop_repeated_lines(nasty, min_docs=2, min_chars=5)
    assert out.schema == nasty.schema
    assert out.count() == len(NASTY)
    assert out.where("text is null").count() == 2


def test_totals_beyond_the_broadcast_bound_give_the_same(documents, nasty, monkeypatch):
    for docs in (documents, nasty):
        few = sorted(map(tuple, line_dedup.keep_bitmaps(docs, held=3).collect()), key=repr)
        monkeypatch.setattr(line_dedup, "MAX_BROADCAST", -1)
        assert sorted(map(tuple, line_dedup.keep_bitmaps(docs, held=3).collect()), key=repr) == few
        monkeypatch.undo()
