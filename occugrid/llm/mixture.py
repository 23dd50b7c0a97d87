"""Mixing sources to target weights by a low-discrepancy schedule of slots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from occugrid.llm.shared import WORD, n_words, ordered_chunks, running_sum, text_of
from occugrid.storage import written_table

#: 1 / golden ratio: multiples modulo 1 spread evenly over every stretch of the sequence.
STEP = 0.6180339887498949
SLOTS_PER_SOURCE = 4096
#: A source gives at most so many times its size.
MAX_REPEATS = 3


@dataclass(frozen=True)
class Mix:
    """Tables of one schedule.

    ``documents``: ``(id, source, size, hash, chunk, first)``, a row per input row, where
    ``first`` is its place in the shuffled words of its source, ``chunk`` the range of rows it
    was shuffled in. ``sources``: ``(source, source_size, target,
    words, n_slots)``. ``pieces``: ``(slot, source, id, first, round, start, length)``: in the
    order of ``slot``, then ``round`` and ``first``, the words of the mix.
    """

    documents: DataFrame
    sources: DataFrame
    pieces: DataFrame


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``.

    Sources in the order of their code points, null last, get the weights in turn. All words
    are shared by weight; no target exceeds ``MAX_REPEATS`` times the source's size, and what
    is over goes to the others by weight. Sorted by the share at which they fill up, the full
    sources come first, so the level that all others reach follows from running sums.
    """
    everything = Window.partitionBy()
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * MAX_REPEATS
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("turn"))
    level = (F.col("total") - F.col("cap_before")) / F.col("weight_left")
    return (
        sizes.select("source", "source_size", weight.alias("weight"), turn.alias("turn"))
        .withColumn("cap", cap)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn(
            "cap_before",
            F.coalesce(
                F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .withColumn(
            "weight_left", F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
        )
        .withColumn("level", level)
        .withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
        .withColumn(
            "share_level",
            F.min_by(
                F.when(~F.col("full"), F.col("level")),
                F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("turn"))),
            ).over(everything),
        )
        .select(
            "source",
            "source_size",
            F.when(F.col("full"), F.col("cap").cast("double"))
            .otherwise(F.col("share_level") * F.col("weight"))
            .alias("target"),
        )
    )


def schedule(sources: DataFrame, slots_per_source: int = SLOTS_PER_SOURCE) -> DataFrame:
    """``(slot, source, rank)`` from ``(source, words)``: the source of every slot.

    Slot ``i`` has the point ``i / golden ratio`` modulo 1, which falls into one source's part
    of the cumulative shares; its rank is the number of earlier slots of that source. Points
    and parts meet by an equal cell of a grid over [0, 1), then exactly. A source so small
    that no point met it gets one slot at the end.
    """
    everything = Window.partitionBy()
    up_to = F.sum("words").over(Window.orderBy("order"))
    parts = (
        sources.where(F.col("words") > 0)
        .withColumn("order", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("total", F.sum("words").over(everything))
        .withColumn("n_sources", F.count("*").over(everything))
        .withColumn("high", up_to / F.col("total"))
        .withColumn("low", (up_to - F.col("words")) / F.col("total"))
        .withColumn("cells", F.col("n_sources") * 64)
        .select(
            "source", "order", "low", "high", "n_sources", "cells",
            F.explode(
                F.sequence(
                    F.floor(F.col("low") * F.col("cells")), F.floor(F.col("high") * F.col("cells"))
                )
            ).alias("cell"),
        )
    )
    slots = (
        sources.where(F.col("words") > 0)
        .agg(F.count("*").alias("n_sources"))
        .where(F.col("n_sources") > 0)
        .select(
            (F.col("n_sources") * 64).alias("n_cells"),
            F.explode(F.sequence(F.lit(0), F.col("n_sources") - 1)).alias("part"),
        )
        .select("n_cells", "part", F.explode(F.sequence(F.lit(0), F.lit(slots_per_source - 1))).alias("i"))
        .select("n_cells", (F.col("part") * slots_per_source + F.col("i")).alias("slot"))
        .withColumn("point", (F.col("slot") + F.lit(0.5)) * STEP)
        .withColumn("point", F.col("point") - F.floor("point"))
        .withColumn("cell", F.floor(F.col("point") * F.col("n_cells")))
    )
    met = slots.join(parts, "cell").where(
        (F.col("point") >= F.col("low")) & (F.col("point") < F.col("high"))
    )
    spare = (
        sources.where(F.col("words") > 0)
        .withColumn("order", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .select("source", (F.lit(2**62) + F.col("order")).alias("slot"), F.lit(True).alias("spare"))
    )
    together = met.select("source", "slot", F.lit(False).alias("spare")).unionByName(spare)
    per_source = Window.partitionBy("source")
    return (
        together.withColumn("rank", F.row_number().over(per_source.orderBy("slot")) - 1)
        .where(~F.col("spare") | (F.col("rank") == 0))
        .select("slot", "source", F.col("rank").cast("long").alias("rank"))
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    seed: int = 7,
    slots_per_source: int = SLOTS_PER_SOURCE,
) -> Mix:
    """Mix the words of all documents to target weights; see ``Mix`` for the result.

    Each source's documents are shuffled by a hash of id, text and ``seed`` and laid end to
    end, the whole up to ``MAX_REPEATS`` times over. Its slots take equal stretches (to a
    word) of the first ``floor(target)`` words, in the order of their rank. So a source gives
    its target but for less than a word, and no document is used more often than the source
    is repeated, rounded up.

    A null text has no words and is never taken; a null source is a source, after all others;
    null ids are kept. Repeated rows are documents of their own. No rows or no words give an
    empty schedule. Reruns agree, whatever the partitioning. Other columns are not read.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        n_words(text_of(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), text_of(text_col)).alias("hash"),
    )
    order = [F.col("hash").asc(), F.col("id").asc(), F.col("size").asc()]
    chunked = ordered_chunks(rows, "shuffled-documents", F.col("source").asc(), *order)
    documents = running_sum(chunked, "size", order, ["source"], "first")
    shares = targets(chunked.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    shares = written_table(shares.withColumn("words", F.floor("target")), "source-targets")
    slots = written_table(
        schedule(shares.select("source", "words"), slots_per_source), "source-slots"
    )
    n_slots = slots.groupBy("source").agg(F.count("*").alias("n_slots")).alias("n")
    sources = (
        shares.alias("s")
        .join(n_slots, F.col("s.source").eqNullSafe(F.col("n.source")), "left")
        .select("s.*", F.coalesce("n.n_slots", F.lit(0)).alias("n_slots"))
    )
    return Mix(documents, sources, _pieces(documents, sources, slots))


def _with_source(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """The documents, with what ``sources`` has of their source.

    Sources are spread over the ranges they reach into first, so that the documents of a
    source that has most of them meet it range by range, not in one task.
    """
    reach = documents.select("source", "chunk").distinct().alias("r")
    spread = (
        reach.join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
        .select("r.*", "s.source_size", "s.target", "s.words", "s.n_slots")
        .alias("s")
    )
    d = documents.alias("d")
    same = F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.chunk") == F.col("s.chunk"))
    return d.join(spread, same).select("d.*", "s.source_size", "s.target", "s.words", "s.n_slots")


def _pieces(documents: DataFrame, sources: DataFrame, slots: DataFrame) -> DataFrame:
    """Stretches of the slots cut at the ends of documents."""
    begin = F.col("round") * F.col("source_size") + F.col("first")
    end = F.least(begin + F.col("size"), F.col("words"))
    rounds = F.floor((F.col("words") - F.col("first") - 1) / F.col("source_size"))
    placed = (
        _with_source(documents.where(F.col("size") > 0), sources)
        .where(F.col("first") < F.col("words"))
        .withColumn("round", F.explode(F.sequence(F.lit(0), rounds.cast("int"))))
        .withColumn("begin", begin)
        .withColumn("end", end)
    )

    def whole(a: Column, b: Column) -> Column:
        """Whole-number division; a quotient of decimals would be rounded first."""
        return F.call_function("div", a.cast("decimal(38,0)"), b.cast("decimal(38,0)"))

    def slot_of(word: Column) -> Column:
        """The slot whose stretch ``[rank * words // n, (rank + 1) * words // n)`` has it."""
        return whole((word + 1) * F.col("n_slots") - 1, F.col("words"))

    reached = placed.withColumn(
        "rank",
        F.explode(
            F.sequence(slot_of(F.col("begin")).cast("long"), slot_of(F.col("end") - 1).cast("long"))
        ),
    )
    met = reached.alias("p").join(
        slots.alias("t"),
        F.col("p.source").eqNullSafe(F.col("t.source")) & (F.col("p.rank") == F.col("t.rank")),
    )
    low = whole(F.col("p.rank") * F.col("words"), F.col("n_slots"))
    high = whole((F.col("p.rank") + 1) * F.col("words"), F.col("n_slots"))
    left = F.greatest(F.col("begin"), low.cast("long"))
    right = F.least(F.col("end"), high.cast("long"))
    return met.select(
        F.col("t.slot").alias("slot"),
        F.col("p.source").alias("source"),
        "id",
        "hash",
        "size",
        "first",
        "round",
        (left - F.col("begin")).alias("start"),
        (right - left).alias("length"),
    ).where(F.col("length") > 0)


def taken(mixed: Mix, id_col: str = "doc_id") -> DataFrame:
    """``(id, size, source_size, target, taken)``, a row per input row."""
    used = mixed.pieces.groupBy("source", "first").agg(F.sum("length").alias("taken"))
    d, u = _with_source(mixed.documents, mixed.sources).alias("d"), used.alias("u")
    # A place belongs to one document with words; documents without share it, but take none.
    same = (
        F.col("d.source").eqNullSafe(F.col("u.source"))
        & (F.col("d.first") == F.col("u.first"))
        & (F.col("d.size") > 0)
    )
    return d.join(u, same, "left").select(
        F.col("d.id").alias(id_col),
        F.col("d.size").alias("size"),
        F.col("d.source_size").alias("source_size"),
        F.col("d.target").alias("target"),
        F.coalesce("u.taken", F.lit(0)).alias("taken"),
    )


def mixed_documents(docs: DataFrame, n_chars_col: str = "n_chars", **options) -> DataFrame:
    """The columns of ``docs``, a row for each time the mix takes a document or a part of it.

    A document taken in part keeps the words taken, with the blanks between them; where the
    input has ``n_chars_col``, it is the length of the text that remains. Documents that are
    not taken, or have no words, go. Repeated rows are taken as often as their places say.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    seed = options.get("seed", 7)
    mixed = mix(docs, **options)
    uses = (
        mixed.pieces.groupBy("source", "first", "round", "id", "hash", "size")
        .agg(F.min("start").alias("start"), F.sum("length").alias("length"))
        .select(F.struct("id", "hash").alias("key"), "start", "length", "size")
    )
    # Rows with the same id and text are alike, so any of them can stand for all.
    rows = docs.select(
        F.struct(
            F.col(id_col).alias("id"),
            F.xxhash64(F.lit(seed), F.col(id_col), text_of(text_col)).alias("hash"),
        ).alias("key"),
        F.struct("*").alias("row"),
    )
    repeated = Window.partitionBy("key")
    rows = rows.withColumn("copy", F.row_number().over(repeated.orderBy(F.lit(0))))
    rows = rows.where(F.col("copy") == 1).drop("copy")
    text = F.col("row")[text_col]
    pieces = F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    part = F.array_join(
        F.slice(pieces, F.col("start").cast("int") + 1, F.col("length").cast("int")), ""
    )
    kept = F.when(F.col("length") == F.col("size"), text).otherwise(part)
    out = rows.join(uses, "key").withColumn("row", F.col("row").withField(text_col, kept))
    if n_chars_col in docs.columns:
        out = out.withColumn(
            "row",
            F.col("row").withField(
                n_chars_col, F.length(F.col("row")[text_col]).cast(docs.schema[n_chars_col].dataType)
            ),
        )
    return out.select("row.*")
