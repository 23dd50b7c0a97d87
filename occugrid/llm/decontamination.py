"""Benchmark decontamination: Wu-Manber search for the word windows of test items."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occugrid.llm import ascii_words
from occugrid.storage import written_table

#: Words in a window.
WINDOW = 10
#: Words in a block of the shift table.
BLOCK = 2
#: Windows, and bytes of their words, that one set of search tables holds at most (about: windows
#: are dealt by hash). More windows are searched for set by set.
MAX_WINDOWS = 100_000
MAX_BYTES = 16 << 20

_MATCHES = "id {id}, text binary, n_words long, spans array<struct<start:long,end:long>>, items array<string>"


class _OneLength:
    """Search tables for windows that all have ``length`` words.

    ``shift`` says for each block of words how far the search may move on when that block ends
    at the place looked at: by the least distance from such a block to the end of a window. A
    block of no window allows the greatest move. Where the distance is 0, the block is the end
    of some windows, and ``buckets`` holds those.
    """

    def __init__(self, length: int, windows: dict[tuple[bytes, ...], list[str]]):
        self.length, self.block = length, min(BLOCK, length)
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[str]]] = {}
        for window, items in windows.items():
            for end in range(self.block, length + 1):
                block = window[end - self.block : end]
                self.shift[block] = min(length - end, self.shift.get(block, length))
            self.buckets.setdefault(window[-self.block :], {})[window] = items

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """``(start, items)`` of every occurrence."""
        length, block, shift = self.length, self.block, self.shift
        farthest = length - block + 1
        end, n = length, len(words)
        while end <= n:
            last = tuple(words[end - block : end])
            step = shift.get(last, farthest)
            if step:
                end += step
                continue
            # Words are compared one by one where the hash of the whole window agrees.
            items = self.buckets[last].get(tuple(words[end - length : end]))
            if items is not None:
                yield end - length, items
            end += 1


class Searcher:
    """Wu-Manber search over words as symbols, with tables of their own for each window length."""

    def __init__(self, windows: Iterable[tuple[bytes, str | None]]):
        by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
        for text, item in windows:
            window = tuple(text.split())
            items = by_length.setdefault(len(window), {}).setdefault(window, [])
            if item is not None:
                items.append(item)
        self.tables = [_OneLength(n, windows) for n, windows in sorted(by_length.items())]

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, list[str]]]:
        """``(start, end, items)`` of every occurrence of a window, the end exclusive."""
        for table in self.tables:
            for start, items in table.find(words):
                yield start, start + table.length, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same places as spans that neither touch nor overlap, ascending."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def windows(
    benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """``(words, item)``, distinct: every run of ``window`` words of an item, joined by one space.

    An item with fewer words, but not none, is one window; a null text or one without words
    gives none. The item's id becomes a string; a null id stays null.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch["item"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = ascii_words.words(text)
                ends = range(min(window, len(words)), len(words) + 1) if words else range(0)
                for first in range(0, len(ends), 10_000):
                    cuts = [b" ".join(words[max(0, end - window) : end]) for end in ends[first : first + 10_000]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cuts, pa.binary()), pa.array([item] * len(cuts), pa.string())],
                        names=["words", "item"],
                    )

    rows = benchmark.select(ascii_words.id_text(id_col).alias("item"), ascii_words.utf8(text_col))
    return rows.mapInArrow(cut, "words binary, item string").distinct()


def _searched(rows: DataFrame, searcher: Searcher) -> DataFrame:
    """``rows`` with the spans and items of one set of windows added."""
    shared = rows.sparkSession.sparkContext.broadcast(searcher)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value.find
        for batch in batches:
            n_words, spans, items = [], [], []
            known = zip(
                batch["text"].to_pylist(), batch["spans"].to_pylist(), batch["items"].to_pylist(), strict=True
            )
            for text, old_spans, old_items in known:
                words = ascii_words.words(text)
                found, names = [(s["start"], s["end"]) for s in old_spans], set(old_items)
                for start, end, of in find(words):
                    found.append((start, end))
                    names.update(of)
                n_words.append(len(words))
                spans.append([{"start": start, "end": end} for start, end in merged(found)])
                items.append(sorted(names))
            fields = [batch.schema.field(name) for name in ("spans", "items")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["id"],
                    batch["text"],
                    pa.array(n_words, pa.int64()),
                    pa.array(spans, fields[0].type),
                    pa.array(items, fields[1].type),
                ],
                names=["id", "text", "n_words", "spans", "items"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(search, _MATCHES.format(id=kind))


def find_windows(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    max_windows: int = MAX_WINDOWS,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """``(id, n_words, spans, items)`` of every row: where windows of test items occur in it.

    ``spans`` are runs of words (from 0, end exclusive, ascending, disjoint) that lie in an
    occurrence; ``items`` are the distinct ids, as strings and sorted as such, of the items with
    an occurring window. Whole texts are read, and no document is shuffled.

    The windows are broadcast in sets of bounded size. Each further set is one more pass over
    the documents, whose spans so far are written in between; so a benchmark of any size, or a
    passage that most of its items share, is searched for completely.

    A null or empty text has no words. Null ids and repeated rows of documents are kept. Items
    that repeat an id are one item. An item without an id marks its words, but is not listed.
    Without items nothing is marked. Other columns are not read.
    """
    table = written_table(windows(benchmark, item_id_col, item_text_col, window), "item-windows")
    n, size = table.agg(F.count("*"), F.sum(F.length("words") + F.length(F.coalesce("item", F.lit(""))))).first()
    n_sets = max(1, ceil(n / max_windows), ceil((size or 0) / max_bytes))
    rows = docs.select(
        F.col(id_col).alias("id"),
        ascii_words.utf8(text_col),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<struct<start:long,end:long>>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    dealt = F.pmod(F.xxhash64("words", "item"), F.lit(n_sets))
    for number in range(n_sets):
        if number:
            rows = written_table(rows, "searched")
        # Bounded by max_windows and max_bytes.
        part = table.where(dealt == number).toArrow()
        pairs = zip(part["words"].to_pylist(), part["item"].to_pylist(), strict=True)
        rows = _searched(rows, Searcher(pairs))
    return rows.select(F.col("id").alias(id_col), "n_words", "spans", "items")


def contamination(found: DataFrame) -> DataFrame:
    """``find_windows`` in numbers: words hit, items, a digest of their ids, the verdict.

    The digest is the SHA-256 of the sorted ids joined by commas, that of the empty string where
    there are none. Nothing here is null but an id that was null.
    """
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, one: total + one["end"] - one["start"])
    return found.select(
        found.columns[0],
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
