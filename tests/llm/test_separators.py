import random
from collections import Counter

import numpy as np
from conftest_llm import NASTY

from occugrid.llm import separators, tokens


def wanted(texts):
    vocabulary = tokens.default_vocabulary()
    return [len(tokens.encode(t or "", vocabulary)) + 1 for t in texts]


def test_counts_of_documents(documents, rows):
    found = separators.count_documents(documents).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in found} == dict(
        zip([i for i, _, _ in rows], wanted([t for _, t, _ in rows]), strict=True)
    )


def test_awkward_rows(nasty, empty):
    found = separators.count_documents(nasty).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in found) == Counter(
        zip([i for i, _, _ in NASTY], wanted([t for _, t, _ in NASTY]), strict=True)
    )
    assert separators.count_documents(empty).count() == 0


def test_stitching_across_blocks(spark, tmp_path):
    """Flat files of many shapes, cut into blocks of a few tokens."""
    random.seed(2)
    end, wanted_rows = 9, []
    shapes = {
        "a": [1, 2, 9, 3, 9, 9, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 9],
        "b": [1] * 30,
        "c": [9] * 11,
        "d": [],
        "e": [5],
        "f": [random.choice([1, 2, 9]) for _ in range(500)],
        "g": [1] * 40 + [9] + [2] * 17,
    }
    for name, ids in shapes.items():
        (tmp_path / f"{name}.bin").write_bytes(np.array(ids, "<u2").tobytes())
        start = ordinal = 0
        for at, one in enumerate(ids):
            if one == end:
                wanted_rows.append((f"{name}.bin", ordinal, start, at + 1 - start, True))
                ordinal, start = ordinal + 1, at + 1
        if start < len(ids):
            wanted_rows.append((f"{name}.bin", ordinal, start, len(ids) - start, False))
    for block in (1, 7, 1000):
        found = separators.scan(spark, f"file://{tmp_path}", end, block).collect()
        assert sorted(map(tuple, found)) == sorted(wanted_rows)


def test_an_empty_folder(spark, tmp_path):
    assert separators.scan(spark, f"file://{tmp_path}").count() == 0
