"""Line deduplication that returns keep bitmaps instead of text."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from occugrid.llm.shared import MIN_LONG, text_of
from occugrid.storage import written_table

MIN_CHARS = 40
MIN_DOCS = 5
#: Rows of one line that a task holds before it leaves them to the second step.
HELD = 100_000
#: Totals of lines that are broadcast at most (24 bytes each); more are joined by a shuffle.
MAX_BROADCAST = 1_000_000

_LINES = "high long, low long, doc long, row long, pos int"
_FOUND = f"{_LINES}, state int"
_NAMES = ("high", "low", "doc", "row", "pos")
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
DROP, PENDING, TOTAL = 0, 1, 2
_STRIPPED = b" \t\n\x0b\x0c\r"


def _key_hashes(min_chars: int):
    """Hashes of the keys of all long lines: ``(doc, row, text)`` to ``_LINES``."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, docs, rows, positions = [], [], [], []
            doc_ids = batch.column("doc").to_pylist()
            row_ids = batch.column("row").to_pylist()
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for doc, row, text in zip(doc_ids, row_ids, texts, strict=True):
                for pos, line in enumerate(text.split(b"\n")):
                    if len(line) < min_chars:
                        continue
                    # Bytes are lower-cased in the ASCII range only.
                    key = line.strip(_STRIPPED).lower()
                    if len(key) < 4 * min_chars and len(key.decode()) < min_chars:
                        continue
                    digests.append(xxhash.xxh3_128_digest(key))
                    docs.append(doc)
                    rows.append(row)
                    positions.append(pos)
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            columns = (halves[:, 0], halves[:, 1], docs, rows, positions)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES
            )

    return hashed


def _changes(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before it; True for the first."""
    changed = np.ones(len(columns[0]), bool)
    changed[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return changed


def _stream(min_docs: int, held: int):
    """First occurrences of each line in a range, sorted by hash, document descending, position.

    A run of equal hashes lies whole inside the range, unless it is the range's first or last
    one. Such runs, and runs too long to hold, are passed on as pending rows together with
    totals of their documents; a document's rows of one line are never torn apart.
    """

    def emitted(rows: list[np.ndarray], state: np.ndarray | int) -> pa.RecordBatch:
        arrays = [pa.array(c, t) for c, t in zip(rows, _TYPES, strict=True)]
        states = np.broadcast_to(np.asarray(state, np.int32), len(rows[0]))
        return pa.RecordBatch.from_arrays([*arrays, pa.array(states)], names=[*_NAMES, "state"])

    def pending(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        runs = np.flatnonzero(_changes(*rows[:2]))
        n_docs = np.add.reduceat(_changes(*rows[:3]).astype(np.int32), runs)
        yield emitted(rows, PENDING)
        # The first row of a run has its largest document.
        yield emitted([*[c[runs] for c in rows[:4]], n_docs], TOTAL)

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: list[np.ndarray] | None = None
        # Whether the run at the head of what is carried may have begun elsewhere.
        open_head = True
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(name).to_numpy() for name in _NAMES]
            if carried is not None:
                rows = [np.concatenate(pair) for pair in zip(carried, rows, strict=True)]
            runs = np.flatnonzero(_changes(*rows[:2]))
            last = runs[-1]
            if open_head and last > 0:
                # The first run ends here, so what it holds is all that this range has of it.
                head = runs[1]
                yield from pending([c[:head] for c in rows])
                rows, runs, last = [c[head:] for c in rows], runs[1:] - head, last - head
                open_head = False
            if last > 0:
                done = [c[:last] for c in rows]
                starts = runs[:-1]
                lengths = np.diff(runs)
                n_docs = np.add.reduceat(_changes(*done[:3]).astype(np.int64), starts)
                first_doc = np.repeat(done[2][starts], lengths)
                drop = (np.repeat(n_docs, lengths) >= min_docs) & (done[2] != first_doc)
                if drop.any():
                    yield emitted([c[drop] for c in done], DROP)
                rows = [c[last:] for c in rows]
            if len(rows[0]) > held and (whole := np.flatnonzero(_changes(rows[2]))[-1]) > 0:
                yield from pending([c[:whole] for c in rows])
                rows = [c[whole:] for c in rows]
                open_head = True
            carried = rows
        if carried is not None:
            yield from pending(carried)

    return streamed


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(MIN_LONG)).alias("doc"),
        F.xxhash64(text).alias("row"),
        text.alias("text"),
        F.col(id_col).alias("id"),
    )


def dropped_lines(
    keyed: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, held: int = HELD
) -> DataFrame:
    """``(doc, row, pos)`` of every line that goes, from ``(doc, row, text)``."""
    lines = keyed.select("doc", "row", "text").mapInArrow(_key_hashes(min_chars), _LINES)
    # The document is part of the range, so that a line of very many documents is split.
    sorted_lines = lines.repartitionByRange("high", "low", "doc").sortWithinPartitions(
        "high", "low", F.col("doc").desc(), "row", "pos"
    )
    found = written_table(
        sorted_lines.mapInArrow(_stream(min_docs, held), _FOUND), "repeated-lines"
    )
    totals = (
        found.where(F.col("state") == TOTAL)
        .groupBy("high", "low")
        .agg(F.sum("pos").alias("n_docs"), F.max("doc").alias("last_doc"))
        .where(F.col("n_docs") >= min_docs)
    )
    # Two lines for each range, one more for every HELD rows: few, but counted before they are
    # broadcast. Lines that wait for them may be very many of one kind, which a shuffle by line
    # would bring into one task.
    if found.where(F.col("state") == TOTAL).count() <= MAX_BROADCAST:
        totals = F.broadcast(totals)
    late = (
        found.where(F.col("state") == PENDING)
        .join(totals, ["high", "low"])
        .where(F.col("doc") < F.col("last_doc"))
    )
    columns = ("doc", "row", "pos")
    return found.where(F.col("state") == DROP).select(*columns).unionByName(late.select(*columns))


@F.pandas_udf(BinaryType())
def _bitmap(n_lines: pd.Series, dropped: pd.Series) -> pd.Series:
    whole: dict[int, bytes] = {}

    def packed(n: int, gone) -> bytes:
        if gone is None:
            if n not in whole:
                whole[n] = zlib.compress(np.packbits(np.ones(n, bool)).tobytes())
            return whole[n]
        keep = np.ones(n, bool)
        keep[gone] = False
        return zlib.compress(np.packbits(keep).tobytes())

    return pd.Series([packed(n, gone) for n, gone in zip(n_lines, dropped, strict=True)])


@F.pandas_udf(StringType())
def kept_text(text: pd.Series, n_dropped: pd.Series, keep: pd.Series) -> pd.Series:
    """The lines of a text whose bit is set, joined by line feeds."""

    def kept(text: str, n_dropped: int, keep: bytes) -> str:
        if not n_dropped:
            return text
        lines = text.split("\n")
        bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
        return "\n".join([line for line, bit in zip(lines, bits.tolist(), strict=True) if bit])

    return pd.Series([kept(*row) for row in zip(text, n_dropped, keep, strict=True)], dtype=object)


def keep_bitmaps(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    held: int = HELD,
) -> DataFrame:
    """``(doc, row, id, n_lines, n_dropped, keep)``, one row per input row.

    A line's key is the line without blanks at its ends, A-Z lower-cased. Keys of at least
    ``min_chars`` code points that occur in at least ``min_docs`` documents lose all their
    lines but those of the document with the largest id. ``keep`` is a zlib-compressed bitmap,
    a bit per line, the first in the highest bit. ``doc`` and ``row`` (a hash of the text) tell
    rows apart, for ``with_kept_text``.

    A null or empty text has one empty line, which stays. A null id counts as the smallest
    long. Rows with the same id are one document, and each row loses its own lines. Other
    columns are not read.
    """
    keyed = _keyed(docs, id_col, text_col)
    gone = (
        dropped_lines(keyed, min_chars, min_docs, held)
        .groupBy("doc", "row")
        .agg(F.collect_set("pos").alias("dropped"))
    )
    sizes = keyed.select("doc", "row", "id", F.size(F.split("text", "\n")).alias("n_lines"))
    return sizes.join(gone, ["doc", "row"], "left").select(
        "doc",
        "row",
        "id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        _bitmap(F.col("n_lines"), F.col("dropped")).alias("keep"),
    )


def with_kept_text(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """``(row, n_lines, n_dropped, kept)``: the input row in a struct, and the text that stays."""
    keeps = keep_bitmaps(docs, id_col, text_col, **options).dropDuplicates(["doc", "row"]).alias("k")
    whole = docs.select(
        F.struct("*").alias("input"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(MIN_LONG)).alias("doc"),
        F.xxhash64(text_of(text_col)).alias("row"),
        text_of(text_col).alias("text"),
    ).alias("d")
    return whole.join(
        keeps, (F.col("d.doc") == F.col("k.doc")) & (F.col("d.row") == F.col("k.row"))
    ).select(
        F.col("d.input").alias("row"),
        F.col("k.n_lines").alias("n_lines"),
        F.col("k.n_dropped").alias("n_dropped"),
        kept_text(F.col("d.text"), F.col("k.n_dropped"), F.col("k.keep")).alias("kept"),
    )


def drop_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_chars_col: str = "n_chars",
    **options,
) -> DataFrame:
    """``docs`` with the lines that stay as text; its length in ``n_chars_col`` if there is one.

    Every row stays; a text that loses all its lines is empty, a null one stays null.
    """
    kept = with_kept_text(docs, id_col, text_col, **options)
    text = F.when(F.col("row")[text_col].isNotNull(), F.col("kept"))
    row = F.col("row").withField(text_col, text)
    if n_chars_col in docs.columns:
        n_chars = F.when(F.col("n_dropped") > 0, F.length("kept")).otherwise(
            F.col("row")[n_chars_col]
        )
        row = row.withField(n_chars_col, n_chars.cast(docs.schema[n_chars_col].dataType))
    return kept.select(row.alias("row")).select("row.*")
