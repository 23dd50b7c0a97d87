"""Importance resampling towards a target: hashed word n-grams, Gumbel top-k draws.

Features are runs of words, hashed by CRC-32 into buckets. The CRCs of all runs come from the
running CRCs of one scan of the text (``prefix_crc``); no run is ever cut out or hashed by itself.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occugrid.llm import ascii_words
from occugrid.llm.prefix_crc import gram_crcs
from occugrid.llm.shared import ordered_chunks, running_sum
from occugrid.storage import written_table

BUCKETS = 10_000
LONGEST = 2
MIN_WORDS = 20
PERCENT = 25
SEED = 7


def bucket_counts(
    docs: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS
) -> DataFrame:
    """``(bucket, n)``: features of all texts in each bucket, repeats counted; empty ones left out.

    Whole texts are read, once. A task hands on one row per bucket, whatever the texts hold. A
    null or empty text has no features; repeated rows count each; no rows give no buckets.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch["text"].to_pylist():
                crcs = gram_crcs(ascii_words.words(text), longest)
                total += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    parts = docs.select(ascii_words.utf8(text_col)).mapInArrow(count, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """What one feature of each bucket says for the target, in thousandths of a natural log.

    The two tables are counts of ``buckets`` rows at most, so they come to the driver. Every
    bucket has one feature more than was counted, in both.
    """
    own, wanted = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, table in ((own, docs), (wanted, target)):
        for bucket, n in table.collect():
            counts[bucket] = n
    all_own, all_wanted = float(own.sum() + buckets), float(wanted.sum() + buckets)
    gains = [
        math.floor(1000 * math.log((t + 1.0) * all_own / ((s + 1.0) * all_wanted)))
        for s, t in zip(own.tolist(), wanted.tolist(), strict=True)
    ]
    return np.array(gains, np.int64)


def gumbel(doc_id: int | None, seed: int = SEED) -> int:
    """Noise of a document, in thousandths: the same on every run. A null id counts as no text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return math.floor(-1000 * math.log(-math.log((int(digest[:8], 16) + 0.5) / 4294967296)))


def importance(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """``(id, n_words, n_features, weight, score)`` of every row, in one table that is written.

    ``weight`` is the mean gain of its features, rounded down; ``score`` adds the noise, so that
    the highest scores are draws without replacement in proportion to the weights.

    Texts are scanned twice: once for the counts of the whole corpus, once for the weights that
    need them. Keeping the buckets in between would take as much room as the texts.

    A null text, an empty one and one without words have no features and weight 0. Null ids and
    repeated rows are kept. An empty target gives weights from the corpus alone. No rows give no
    rows. Other columns are not read.
    """
    gains = bucket_gains(
        bucket_counts(docs, text_col, longest, buckets),
        bucket_counts(target, target_text_col, longest, buckets),
        buckets,
    )
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            ids = batch["id"].to_pylist()
            n_words, n_features, weights = [], [], []
            for text in batch["text"].to_pylist():
                words = ascii_words.words(text)
                crcs = gram_crcs(words, longest)
                n_words.append(len(words))
                n_features.append(len(crcs))
                total = int(gain[crcs % np.uint32(buckets)].sum())
                weights.append(total // len(crcs) if len(crcs) else 0)
            scores = [weight + gumbel(one, seed) for one, weight in zip(ids, weights, strict=True)]
            columns = [pa.array(values, pa.int64()) for values in (n_words, n_features, weights, scores)]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], *columns], names=["id", "n_words", "n_features", "weight", "score"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), ascii_words.utf8(text_col))
    schema = "id long, n_words long, n_features long, weight long, score long"
    weighed = written_table(rows.mapInArrow(weigh, schema), "importance")
    return weighed.withColumnRenamed("id", id_col)


def resample(
    weighed: DataFrame, id_col: str = "doc_id", percent: int = PERCENT, min_words: int = MIN_WORDS
) -> DataFrame:
    """``weighed`` with ``rank``: 1, 2, 3... for the drawn rows, null for the others.

    Of the ``N`` rows with at least ``min_words`` words the ``floor(percent * N / 100)`` highest
    scores are drawn; ties go to the smaller id, a null id last. Rows are put in order by range
    partitions; each counts for itself and adds the counts of the ranges before it, so a rank
    needs neither one task nor the driver, and equal scores are cut by their ids.

    Repeated rows take a rank each. No rows, or none with enough words, draw nothing.
    """
    rows = weighed.select(
        F.col(id_col).alias("id"),
        *[name for name in weighed.columns if name != id_col],
        (F.col("n_words") >= min_words).cast("long").alias("eligible"),
    )
    order = [
        F.col("eligible").desc(),
        F.col("score").desc(),
        F.col("id").asc_nulls_last(),
        F.col("n_features").asc(),
        F.col("n_words").asc(),
    ]
    ordered = ordered_chunks(rows, "by-score", *order)
    quota = percent * ordered.where("eligible = 1").count() // 100
    ranked = running_sum(ordered, "eligible", order, [], "before")
    drawn = (F.col("eligible") == 1) & (F.col("before") < quota)
    return ranked.select(
        F.col("id").alias(id_col),
        "n_features",
        "weight",
        "score",
        F.when(drawn, F.col("before") + 1).alias("rank"),
        "n_words",
    )


def drawn(docs: DataFrame, ranked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that were drawn, whole. Ids tell rows apart here; null ids go."""
    return docs.join(ranked.where(F.col("rank").isNotNull()).select(id_col).distinct(), id_col, "left_semi")
