"""Packing documents into training sequences: an order-preserving dynamic program."""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occugrid.llm import tokens
from occugrid.llm.shared import text_of

PIECES = (
    "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
)


@dataclass(frozen=True)
class Costs:
    """What a cut costs, in tokens of padding, and where cuts inside sentences may lie."""

    sequence: int = 1024
    at_sentence: int = 1
    inside_sentence: int = 6
    #: Cuts inside a sentence lie a multiple of so many tokens after the document's start.
    grid: int = 16


def choose_cuts(
    places: np.ndarray, costs: np.ndarray, length: int, open_end: bool = False
) -> list[int]:
    """Indices of the cuts that minimise padding plus cut costs.

    The last place is the last cut; with ``open_end`` it is the place less than ``length``
    before it that has cost least so far, and what follows goes on with later tokens.

    ``places`` ascend from 0 (no cut) and are at most ``length`` apart. With ``g(j)`` the
    least cost up to place ``j`` plus ``j`` itself, ``g(j) = min g(i) + length + cost(j)`` over
    the places ``i`` at most ``length`` before ``j``: padding is what windows hold in all minus
    the tokens. That minimum slides, so a queue of ascending ``g`` gives it in constant time.
    Among equal ones the earliest place wins.
    """
    at, cost = places.tolist(), costs.tolist()
    best = [0] * len(at)
    before = [0] * len(at)
    queue = deque([0])
    for j in range(1, len(at)):
        floor = at[j] - length
        while at[queue[0]] < floor:
            queue.popleft()
        i = queue[0]
        before[j] = i
        g = best[j] = best[i] + length + cost[j]
        while queue and best[queue[-1]] > g:
            queue.pop()
        queue.append(j)
    end = len(at) - 1
    if open_end:
        late = range(end, bisect_right(at, at[end] - length, 0, end), -1)
        end = min(late, key=lambda j: best[j] - at[j], default=end)
    cuts = [end]
    while before[cuts[-1]]:
        cuts.append(before[cuts[-1]])
    return cuts[::-1]


def _cut_places(
    ids: np.ndarray, doc_ends: np.ndarray, carried: int, vocabulary: str, costs: Costs
) -> tuple[np.ndarray, np.ndarray]:
    """Places where a cut may lie, and its cost: ends of documents, of sentences, a grid.

    ``carried``: tokens of the first document that went to earlier sequences.
    """
    ends, blank, feed = tokens.sentence_tables(vocabulary)
    cost = np.full(len(ids) + 1, -1, np.int32)
    starts = np.concatenate([[-carried], doc_ends[:-1]])
    inside = np.arange(1, len(ids) + 1)
    in_doc = inside - np.repeat(starts, np.diff(np.concatenate([[0], doc_ends])))
    cost[1:][in_doc % costs.grid == 0] = costs.inside_sentence
    sentence = feed[ids]
    sentence[:-1] |= ends[ids[:-1]] & blank[ids[1:]]
    cost[1:][sentence] = costs.at_sentence
    cost[doc_ends] = 0
    cost[0] = 0
    places = np.flatnonzero(cost >= 0)
    return places, cost[places]


class _Packer:
    """Packs the documents of one range, block by block, in order."""

    def __init__(
        self,
        vocabulary: str,
        costs: Costs,
        end_id: int,
        block: int,
        first_sequence: int,
        added_tokens: bool,
    ):
        self.encode = tokens.encode_with_added if added_tokens else tokens.encode
        self.vocabulary, self.costs, self.end_id, self.block = vocabulary, costs, end_id, block
        self.sequence = first_sequence
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple[int | None, int, int]] = []  # id, tokens before, tokens in all
        self.held = 0

    def add(self, doc_id: int | None, text: str) -> Iterator[pa.RecordBatch]:
        ids = np.append(self.encode(text, self.vocabulary), np.uint32(self.end_id))
        self.ids.append(ids)
        self.docs.append((doc_id, 0, len(ids)))
        self.held += len(ids)
        if self.held >= self.block:
            yield self.flush(final=False)

    def flush(self, final: bool) -> pa.RecordBatch:
        """Sequences of what is held; unless ``final``, what is past the best cut waits."""
        ids = np.concatenate(self.ids)
        doc_ends = np.cumsum([total - before for _, before, total in self.docs])
        places, costs = _cut_places(
            ids, doc_ends, self.docs[0][1], self.vocabulary, self.costs
        )
        cuts = places[choose_cuts(places, costs, self.costs.sequence, open_end=not final)]
        end = int(cuts[-1])
        edges = np.union1d(cuts, doc_ends[doc_ends < end]).astype(np.int64)
        starts = np.concatenate([[0], edges[:-1]]).astype(np.int64)
        doc = np.searchsorted(doc_ends, starts, side="right")
        window = np.searchsorted(cuts, starts, side="right")
        doc_starts = np.concatenate([[0], doc_ends])
        taken = np.array([before for _, before, _ in self.docs], np.int64)
        totals = np.array([total for _, _, total in self.docs], np.int64)
        window_starts = np.concatenate([[0], cuts]).astype(np.int64)
        lengths = edges - starts
        raw = ids[:end].astype("<u4").tobytes()
        offsets = (np.concatenate([[0], edges]) * 4).astype(np.int32)
        columns = [
            pa.array([self.docs[i][0] for i in doc.tolist()], pa.int64()),
            pa.array(starts - doc_starts[doc] + taken[doc], pa.int64()),
            pa.array(lengths, pa.int64()),
            pa.Array.from_buffers(
                pa.binary(), len(edges), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]
            ),
            pa.array(totals[doc], pa.int64()),
            pa.array(window + self.sequence, pa.int64()),
            pa.array(starts - window_starts[window], pa.int64()),
        ]
        self.sequence += len(cuts)
        rest = ids[end:]
        left = [
            (doc_id, total - int(stop - end) if stop - end < total - before else before, total)
            for (doc_id, before, total), stop in zip(self.docs, doc_ends.tolist(), strict=True)
            if stop > end
        ]
        self.ids, self.docs, self.held = ([rest] if len(rest) else []), left, len(rest)
        names = [field.split()[0] for field in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays(columns, names=names)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    costs: Costs = Costs(),  # noqa: B008
    end_id: int = 0,
    block: int = 1 << 18,
    added_tokens: bool = False,
) -> DataFrame:
    """Pieces of all documents in sequences of at most ``costs.sequence`` tokens.

    Returns ``(id, start, length, ids, doc_tokens, sequence_id, offset)``: the tokens of the
    piece as little-endian unsigned 32-bit integers, how many of its document come before it,
    how many the document has with the closing ``end_id``, and the place in its sequence.
    Sequences follow the documents in the order of id, then text; the sum of padding and cut
    costs is least for each range of documents, but for the seams between blocks of ``block``
    tokens. A document goes on in the next sequence where it is cut. Every range ends with one
    sequence of what is left.

    With ``added_tokens`` the string of an added token in a text is that token, as the tokenizer
    reads it when loaded; without, it is ordinary text.

    A null or empty text is the single ``end_id``. Null ids come first. Repeated rows are packed
    each. No rows give no pieces. A long text takes as many sequences as it needs. Other columns
    are not read.
    """
    vocabulary = vocabulary or tokens.default_vocabulary()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        packer = _Packer(vocabulary, costs, end_id, block, first, added_tokens)
        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            for doc_id, text in zip(ids, texts, strict=True):
                yield from packer.add(doc_id, text)
        if packer.held:
            yield packer.flush(final=True)

    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")
    )
    # The text's hash splits the rows of an id that a great part of all rows has.
    return (
        rows.withColumn("hash", F.xxhash64("text"))
        .repartitionByRange("id", "hash")
        .sortWithinPartitions("id", "hash")
        .select("id", "text")
        .mapInArrow(packed, PIECES)
    )


def digests(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The pieces with a checksum in place of their tokens."""
    return pieces.select(
        F.col("id").alias(id_col),
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )
