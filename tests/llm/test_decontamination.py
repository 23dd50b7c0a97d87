import hashlib
import re

import pytest
from conftest_llm import NASTY, SF_DIR

from occugrid.llm import decontamination, queries
from occugrid.llm.decontamination import Searcher

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, items, window=10):
    """``(id, n_words, hit places, items)`` by comparing every place with every window."""
    known = {}
    for item, text in items:
        w = words(text)
        for end in range(min(window, len(w)), len(w) + 1) if w else ():
            known.setdefault(tuple(w[max(0, end - window) : end]), set()).add(item)
    sizes = {len(one) for one in known}
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for start in range(len(w) - size + 1):
                of = known.get(tuple(w[start : start + size]))
                if of is not None:
                    hit.update(range(start, start + size))
                    found |= of
        out.append((doc_id, len(w), sorted(hit), sorted(str(one) for one in found if one is not None)))
    return sorted(out, key=repr)


def places(rows):
    out = [
        (r[0], r.n_words, [i for s in r.spans for i in range(s.start, s.end)], list(r["items"]))
        for r in rows
    ]
    return sorted(out, key=repr)


def as_items(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def benchmark(spark):
    return [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]


def test_query_against_brute_force(spark, rows):
    found = queries.QUERIES["op13_decontamination"](spark, SF_DIR)
    assert found.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    expected = [
        (i, n, len(hit), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), bool(hit))
        for i, n, hit, items in plain([(i, text) for i, text, _ in rows], benchmark(spark))
    ]
    assert sorted(map(tuple, found.collect()), key=repr) == expected
    assert sum(one[-1] for one in expected) > 0


@pytest.mark.parametrize("window", [1, 2, 3, 10])
def test_windows_of_any_length(spark, make_docs, window):
    items = [(1, "a b c d e f g h i j k l"), (2, "b b b"), (3, "Z"), (4, "k l a"), (5, "c d e"), (None, "q q")]
    texts = ["a B,c d e f g h i j!k l m", "b b b b", "b b", "z z Z", "", "c d", "x k l a k l", "q-q q", None]
    docs = [(i, text, "s") for i, text in enumerate(texts)]
    found = decontamination.find_windows(make_docs(docs), as_items(spark, items), window=window)
    assert places(found.collect()) == plain([(i, text) for i, text, _ in docs], items, window)


def test_sets_of_windows_find_the_same(spark, documents):
    """A benchmark beyond the bound of one broadcast is searched for set by set."""
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    whole = decontamination.find_windows(documents, items)
    n = decontamination.windows(items).count()
    parts = decontamination.find_windows(documents, items, max_windows=n // 3)
    small = decontamination.find_windows(documents, items, max_bytes=8_000)
    assert places(parts.collect()) == places(whole.collect()) == places(small.collect())


def test_awkward_rows(spark, nasty, empty, make_docs):
    items = benchmark(spark) + [(7, None), (8, ""), (9, "?!"), (10, "two words"), (10, "two words"), (None, "one")]
    items += [(11, NASTY[3][1]), (12, "É ß"), (13, "é ß")]
    found = decontamination.find_windows(nasty, as_items(spark, items))
    assert places(found.collect()) == plain([(i, text) for i, text, _ in NASTY], items)
    assert decontamination.find_windows(empty, as_items(spark, items)).collect() == []
    none = decontamination.contamination(decontamination.find_windows(nasty, as_items(spark, [])))
    assert none.where("contaminated or n_hit > 0 or n_items > 0").count() == 0
    assert none.count() == len(NASTY)


def test_no_document_is_shuffled(spark, documents):
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    found = decontamination.find_windows(documents, items)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_shifts_skip_and_never_miss():
    text = [b"a", b"b", b"a", b"b", b"c", b"a", b"b", b"c", b"d"]
    searcher = Searcher([(b"a b c", "1"), (b"b c d", "2"), (b"a b c", "3"), (b"c", None)])
    assert sorted(searcher.find(text)) == [
        (2, 5, ["1", "3"]), (4, 5, []), (5, 8, ["1", "3"]), (6, 9, ["2"]), (7, 8, []),
    ]
    (table,) = Searcher([(b"a b c d", "1")]).tables
    assert table.shift == {(b"a", b"b"): 2, (b"b", b"c"): 1, (b"c", b"d"): 0}
