"""Severity of toxic texts by cumulative-link ordinal regression over sparse features."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occugrid.llm.shared import text_of

#: Labelled rows that a model is fitted on, at most (about: rows are drawn by hash).
MAX_ROWS = 8_000
#: Chance of any grade above 0 from which a text counts as toxic: missing one costs more than
#: looking at one too many.
TOXIC = 0.3
#: Words whose features a task remembers.
KNOWN_WORDS = 500_000
#: Word beginnings that are features beside the words.
PREFIXES = (5, 6)

_WORD = re.compile(r"[^\W\d_]+")


def features(text: str) -> dict[str, float]:
    """Words and word beginnings of a whole text, lower-cased, with damped counts."""
    counts: Counter[str] = Counter()
    for word, n in Counter(_WORD.findall(text.lower())).items():
        counts[word] += n
        for length in PREFIXES:
            if len(word) >= length:
                counts[f"{word[:length]}*"] += n
    return {name: float(np.log1p(n)) for name, n in counts.items()}


@dataclass(frozen=True)
class Ordinal:
    """``P(grade <= k) = sigmoid(thresholds[k] - score)``; one score for all thresholds."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def score(self, text: str) -> float:
        weights = self.weights
        return sum(x * weights[name] for name, x in features(text).items() if name in weights)

    def scorer(self) -> Callable[[str], float]:
        """``score``, quickly: a word's features in the model are looked up once for many texts.

        Most words have none, so a text costs little more than counting its words.
        """
        numbers = {name: i for i, name in enumerate(self.weights)}
        weights = np.fromiter(self.weights.values(), float, len(numbers))
        known: dict[str, tuple[int, ...]] = {}

        def look_up(word: str) -> tuple[int, ...]:
            names = [word, *(f"{word[:length]}*" for length in PREFIXES if len(word) >= length)]
            if len(known) >= KNOWN_WORDS:
                known.clear()
            found = known[word] = tuple(numbers[name] for name in names if name in numbers)
            return found

        def score(text: str) -> float:
            counts: dict[int, int] = {}
            for word, n in Counter(_WORD.findall(text.lower())).items():
                found = known.get(word)
                if found is None:
                    found = look_up(word)
                for number in found:
                    counts[number] = counts.get(number, 0) + n
            used = np.fromiter(counts, np.int64, len(counts))
            times = np.fromiter(counts.values(), float, len(counts))
            return float(np.log1p(times) @ weights[used])

        return score

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """A column for each grade."""
        at_most = _sigmoid(np.asarray(self.thresholds)[None, :] - scores[:, None])
        return np.diff(at_most, axis=1, prepend=0.0, append=1.0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def _ids(names: dict[str, float]) -> np.ndarray:
    return np.fromiter((zlib.crc32(name.encode()) for name in names), np.uint32, len(names))


def _selected(ids: np.ndarray, other: np.ndarray, n_other: int, n: int, min_rows: int, limit: int):
    """Features whose share of rows differs between grade 0 and the others, ``limit`` at most.

    ``ids`` has each row's features once, ``other`` says which rows are above grade 0.
    """
    if n_other in (0, n):
        return np.zeros(0, np.uint32)
    found, place = np.unique(ids, return_inverse=True)
    both = np.bincount(place, minlength=len(found))
    a = np.bincount(place[other], minlength=len(found))
    share = both / n
    gap = a / n_other - (both - a) / (n - n_other)
    spread = share * (1 - share) * (1 / n_other + 1 / (n - n_other))
    z = np.where(both >= min_rows, np.abs(gap) / np.sqrt(spread + 1e-12), 0.0)
    best = np.lexsort((found, -z))[:limit]
    return np.sort(found[best[z[best] >= 2.5]])


def fit(
    texts: list[str],
    grades: list[int],
    n_grades: int,
    min_rows: int = 5,
    limit: int = 20_000,
    penalty: float = 2e-4,
    rounds: int = 400,
) -> Ordinal:
    """Fit weights and ordered thresholds by full-batch Adam on the penalised likelihood.

    Thresholds are the first plus positive steps, so they stay ordered. Without two different
    grades there is nothing to learn: no weights, and thresholds that give the grades' shares.
    """
    y = np.asarray(grades, np.int64)
    # Rows are kept as numbers; the few names that matter are looked up once they are known.
    ids, values = [np.zeros(0, np.uint32)], [np.zeros(0, np.float32)]
    for text in texts:
        row = features(text)
        ids.append(_ids(row))
        values.append(np.fromiter(row.values(), np.float32, len(row)))
    at = np.repeat(np.arange(len(y)), [len(row) for row in ids[1:]])
    flat, value = np.concatenate(ids), np.concatenate(values).astype(np.float64)
    names = _selected(flat, y[at] > 0, int((y > 0).sum()), len(y), min_rows, limit)
    feature = np.searchsorted(names, flat)
    used = np.append(names, 0)[feature] == flat if len(names) else np.zeros(len(flat), bool)
    at, feature, value = at[used], feature[used], value[used]

    shares = np.bincount(y, minlength=n_grades) + 0.5 if len(y) else np.ones(n_grades)
    below = np.cumsum(shares)[:-1] / shares.sum()
    start = np.log(below / (1 - below))
    steps = np.log(np.maximum(np.diff(start), 1e-3))
    parameters = np.concatenate([np.zeros(len(names)), start[:1], steps])
    first, second = np.zeros_like(parameters), np.zeros_like(parameters)
    n = max(len(y), 1)
    for t in range(1, rounds + 1 if len(value) else 1):
        w, theta = _unpacked(parameters, len(names))
        score = np.bincount(at, value * w[feature], minlength=len(y))
        high = np.append(theta, np.inf)[y] - score
        low = np.insert(theta, 0, -np.inf)[y] - score
        upper, lower = _sigmoid(high), _sigmoid(low)
        chance = np.maximum(upper - lower, 1e-12)
        d_upper, d_lower = upper * (1 - upper) / chance, lower * (1 - lower) / chance
        d_score = (d_upper - d_lower) / n
        d_w = np.bincount(feature, value * d_score[at], minlength=len(names)) + penalty * w
        d_theta = np.array(
            [
                (d_lower[y == k + 1].sum() - d_upper[y == k].sum()) / n
                for k in range(n_grades - 1)
            ]
        )
        tail = np.cumsum(d_theta[::-1])[::-1]
        d_steps = tail[1:] * np.exp(parameters[len(names) + 1 :])
        slope = np.concatenate([d_w, tail[:1], d_steps])
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        parameters = parameters - 0.05 * (first / (1 - 0.9**t)) / (
            np.sqrt(second / (1 - 0.999**t)) + 1e-9
        )
    w, theta = _unpacked(parameters, len(names))
    weight = dict(zip(names.tolist(), w.tolist(), strict=True))
    named = {}
    for text in texts:
        for name in features(text):
            if (number := zlib.crc32(name.encode())) in weight:
                named[name] = weight[number]
    return Ordinal(named, tuple(theta.tolist()))


def _unpacked(parameters: np.ndarray, n_weights: int) -> tuple[np.ndarray, np.ndarray]:
    w, rest = parameters[:n_weights], parameters[n_weights:]
    return w, rest[0] + np.concatenate([[0.0], np.cumsum(np.exp(rest[1:]))])


def grades_by_dose(texts: list[str], toxic: list[int], bounds: tuple[int, ...] = (3, 6)):
    """Grades from labels that only say toxic or not: 0, or 1 and up by how much there is of it.

    The dose of a toxic text is the count of its words that are ten times as frequent in toxic
    texts as in others, and in at least five of them.
    """
    clean, other = Counter(), Counter()
    for text, label in zip(texts, toxic, strict=True):
        if label:
            other.update(set(_WORD.findall(text.lower())))
    for text, label in zip(texts, toxic, strict=True):
        if not label:
            clean.update(other.keys() & set(_WORD.findall(text.lower())))
    n_other = max(sum(1 for label in toxic if label), 1)
    n_clean = max(len(toxic) - n_other, 1)
    telling = {
        word
        for word, n in other.items()
        if n >= 5 and n / n_other >= 10 * (clean[word] + 0.5) / n_clean
    }

    def dose(text: str) -> int:
        return sum(1 for word in _WORD.findall(text.lower()) if word in telling)

    return [
        1 + int(np.searchsorted(bounds, dose(text), side="right")) if label else 0
        for text, label in zip(texts, toxic, strict=True)
    ]


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = MAX_ROWS,
) -> tuple[list[str], list[int]]:
    """Texts and labels of about ``max_rows`` labelled rows, drawn by a hash of the id.

    Rows without id or label do not count; a null text is empty.
    """
    wanted = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    wanted = wanted.where(F.col("id").isNotNull() & F.col("label").isNotNull())
    share = min(1.0, max_rows / max(wanted.count(), 1))
    drawn = F.pmod(F.xxhash64(F.lit("sample"), F.col("id")), F.lit(1 << 20)) < share * (1 << 20)
    # Bounded by max_rows.
    chosen = F.broadcast(wanted.where(drawn))
    rows = (
        docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
        .join(chosen, "id")
        .select("id", "label", "text")
        .toArrow()
        .sort_by([("id", "ascending"), ("text", "ascending")])
    )
    return rows.column("text").to_pylist(), rows.column("label").to_pylist()


def predict(
    docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, expected, grade, p_above)`` of every row: expected grade, likeliest grade, P(grade > 0).

    Whole texts are read. A null or empty text has no features, so it gets the shares that the
    thresholds give. Null ids and repeated rows are kept. Other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.value.scorer()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            scores = np.array([score(text) for text in texts], np.float64)
            chances = model.value.probabilities(scores)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(chances @ np.arange(chances.shape[1])),
                    pa.array(chances.argmax(axis=1).astype(np.int64)),
                    pa.array(1.0 - chances[:, 0]),
                ],
                names=["id", "expected", "grade", "p_above"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    schema = "id long, expected double, grade long, p_above double"
    return rows.mapInArrow(predicted, schema).withColumnRenamed("id", id_col)
