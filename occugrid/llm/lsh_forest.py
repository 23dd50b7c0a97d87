"""Near copies by an LSH forest of MinHash signatures, every link verified exactly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occugrid.llm.shared import MIN_LONG, text_of, word_grams, words_of
from occugrid.storage import written_table

#: Values of a signature in one tree, so the greatest depth of a trie; 16 bits each.
MAX_DEPTH = 8
#: How far below the threshold the signatures of a pair at the threshold may seem to be.
MARGIN = 0.1
#: Classes that one task compares with each other are about twice as many, at most.
BLOCK = 256
#: Shingles that are hashed at a time.
CHUNK = 1 << 19

_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Forest:
    """Parameters: shingles of ``words`` words, links from ``threshold`` Jaccard similarity.

    Pairs as alike as the least alike ones that were met are found with probability ``recall``
    at least, and pairs at the threshold, met or not, with probability ``worst`` (or ``recall``, if
    that is less); others more surely.
    """

    words: int = 5
    threshold: float = 0.8
    trees: int = 16
    recall: float = 0.999
    worst: float = 0.99

    def depth(self) -> int:
        """The longest prefix that reaches the recall at the threshold: none is cut shorter."""
        depth = MAX_DEPTH
        while depth > 1 and self.found(depth) < self.recall:
            depth -= 1
        return depth

    def found(self, depth: int, similarity: float | None = None) -> float:
        """Chance that a pair (at the threshold) shares a prefix of this depth in some tree."""
        alike = self.threshold if similarity is None else similarity
        return 1 - (1 - alike**depth) ** self.trees

    def suffices(self, depth: int, least: float | None) -> bool:
        """Whether prefixes need not be shortened below ``depth``.

        ``least`` is the least similarity of the pairs met so far, none before the first.
        """
        return (
            self.found(depth, least) >= self.recall
            and self.found(depth) >= min(self.worst, self.recall)
        ) or depth <= self.depth()


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of ``n`` hash functions, fixed for all time."""
    state = np.random.default_rng(20240501)
    odd = state.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, state.integers(0, 2**63, n, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(shingles: np.ndarray, starts: np.ndarray, trees: int) -> np.ndarray:
    """MinHash values as big-endian 16 bits, a row of ``trees * MAX_DEPTH`` for each set.

    ``shingles``: distinct hashes of all sets, ``starts``: where each set, none empty, begins.
    """
    odd, offset = _functions(trees * MAX_DEPTH)
    out = np.empty((len(starts), len(odd)), ">u2")
    for i in range(len(odd)):
        # Odd multipliers permute; the high bits are mixed in by the second step.
        hashed = shingles * odd[i] + offset[i]
        hashed ^= hashed >> np.uint64(32)
        least = np.minimum.reduceat(hashed, starts)
        out[:, i] = (_mixed(least) >> np.uint64(48)).astype(np.uint16)
    return out


def _sketcher(trees: int):
    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column("grams")
            offsets = grams.offsets.to_numpy()
            values = grams.values.to_numpy().view(np.uint64)
            doc, row = batch.column("doc"), batch.column("row")
            at = 0
            while at < batch.num_rows:
                stop = int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1
                stop = min(max(stop, at + 1), batch.num_rows)
                keys, sizes, forests = _sketches(
                    values[offsets[at] : offsets[stop]],
                    offsets[at : stop + 1] - offsets[at],
                    trees,
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        doc.slice(at, stop - at),
                        row.slice(at, stop - at),
                        pa.array(keys, pa.binary()),
                        pa.array(sizes, pa.int32()),
                        pa.array(forests, pa.binary()),
                    ],
                    names=["doc", "row", "key", "size", "forest"],
                )
                at = stop

    return sketched


def _sketches(values: np.ndarray, offsets: np.ndarray, trees: int):
    """Key of the set, its size and its signatures; none for a set without members."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    distinct = np.ones(len(values), bool)
    distinct[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[distinct], owner[distinct]
    sizes = np.bincount(owner, minlength=n)
    keys: list[bytes | None] = [None] * n
    forests: list[bytes | None] = [None] * n
    full = np.flatnonzero(sizes)
    if len(full):
        starts = np.searchsorted(owner, full)
        rows = signatures(values, starts, trees)
        for i, start, row in zip(full.tolist(), starts.tolist(), rows, strict=True):
            keys[i] = xxhash.xxh3_128_digest(values[start : start + sizes[i]].tobytes())
            forests[i] = row.tobytes()
    return keys, sizes, forests


def _groups(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows of equal ``key``, from batches sorted by it."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table]).combine_chunks()
        columns = [table.column(name).to_numpy() for name in key]
        changed = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        edges = [0, *(np.flatnonzero(changed) + 1).tolist()]
        for start, stop in zip(edges[:-1], edges[1:], strict=True):
            yield table.slice(start, stop - start)
        rest = table.slice(edges[-1])
    if rest is not None:
        yield rest


def _common(trees: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Values that each label shares with the following one from the start; none across trees."""
    same = np.logical_and.accumulate(labels[1:] == labels[:-1], axis=1).sum(axis=1)
    return np.where(trees[1:] == trees[:-1], same, 0)


def _neighbours(floor: int):
    """Leaves of sorted tries with ``near``, ``next`` and ``common``.

    ``near`` is the longest prefix that a neighbour shares, ``next`` the set of the following leaf
    and ``common`` the prefix it shares. Leaves below ``floor`` go. The neighbours of the first and
    last leaf of a range are in other ranges, so those two stay in any case: at worst they are
    alone below their node.
    """

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        before = MAX_DEPTH
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table]).combine_chunks()
            labels = np.frombuffer(b"".join(table.column("label").to_pylist()), ">u2")
            common = _common(table.column("tree").to_numpy(), labels.reshape(-1, MAX_DEPTH))
            following = table.column("key").slice(1)
            yield from _near(table.slice(0, len(common)), following, before, common, common, floor)
            before = int(common[-1]) if len(common) else before
            rest = table.slice(len(common))
        if rest is not None:
            none, unknown = pa.nulls(1, pa.binary()), np.array([MAX_DEPTH])
            yield from _near(rest, none, before, unknown, np.array([0]), floor)

    return neighbours


def _near(
    leaves: pa.Table, following: pa.Array, before: int, after: np.ndarray, common: np.ndarray, floor: int
) -> list[pa.RecordBatch]:
    near = np.maximum(after, np.concatenate([[before], after[:-1]])[: len(after)])
    table = (
        leaves.append_column("near", pa.array(near, pa.int32()))
        .append_column("next", following)
        .append_column("common", pa.array(common, pa.int32()))
    )
    return table.filter(pa.array(near >= floor)).to_batches()


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(common, similarity)`` of pairs of signatures: the share of equal values."""
    for batch in batches:
        one, other = (
            np.frombuffer(b"".join(batch.column(name).to_pylist()), ">u2").reshape(batch.num_rows, -1)
            for name in ("forest", "other")
        )
        similarity = pa.array((one == other).mean(axis=1) if batch.num_rows else np.zeros(0))
        yield pa.RecordBatch.from_arrays([batch.column("common"), similarity], names=["common", "similarity"])


_GROUP = ("node", "low", "high")


def _prefixes(forests: list[bytes], trees: int, depth: int) -> np.ndarray:
    """A number for each set and tree that stands for the prefix."""
    rows = np.frombuffer(b"".join(forests), ">u2").reshape(len(forests), trees, MAX_DEPTH)
    out = np.zeros((len(forests), trees), np.uint64)
    for level in range(depth):
        out = _mixed(out * _MIX + rows[:, :, level].astype(np.uint64) + np.uint64(1))
    return out


def _first_met(trees: int, depth: int, threshold: float):
    """Members of a group that meet another one here first, of all trees."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, _GROUP):
            pairs = _new_pairs(group, trees, depth, threshold)
            active = np.flatnonzero(pairs.any(axis=1))
            if len(active):
                chosen = group.take(pa.array(active)).combine_chunks()
                yield from chosen.to_batches()

    return met


def _new_pairs(group: pa.Table, trees: int, depth: int, threshold: float) -> np.ndarray:
    """Candidates that share no prefix in an earlier tree."""
    pairs = _candidates(group, threshold)
    prefixes = _prefixes(group.column("forest").to_pylist(), trees, depth)
    for earlier in range(group.column("tree")[0].as_py()):
        pairs &= prefixes[:, None, earlier] != prefixes[None, :, earlier]
    return pairs


def _candidates(group: pa.Table, threshold: float) -> np.ndarray:
    """Pairs of different blocks (or all, if there is one) whose sizes allow a link."""
    block = group.column("block").to_numpy()
    size = group.column("size").to_numpy().astype(np.float64)
    pairs = np.minimum.outer(size, size) >= threshold * np.maximum.outer(size, size) - 1e-9
    if group.column("low")[0].as_py() != group.column("high")[0].as_py():
        pairs &= block[:, None] != block[None, :]
    np.fill_diagonal(pairs, False)
    return pairs


def _shared(grams: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    if len(grams) == 2:
        n = len(np.intersect1d(grams[0], grams[1], assume_unique=True))
        return np.array([[len(grams[0]), n], [n, len(grams[1])]], np.float64)
    owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    _, column, count = np.unique(
        np.concatenate(grams), return_inverse=True, return_counts=True
    )
    # Only shingles of several sets count.
    several = count > 1
    place = np.cumsum(several) - 1
    used = several[column]
    owner, column = owner[used], place[column[used]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(grams), len(grams)))
    step = max(1, (1 << 23) // len(grams))
    for first in range(0, int(several.sum()), step):
        a, b = np.searchsorted(column, [first, first + step])
        part = np.zeros((len(grams), step), np.float32)
        part[owner[a:b], column[a:b] - first] = 1
        total += part @ part.T
    return total


def _verified(trees: int, depth: int, threshold: float):
    """Links of a group: for each member that has one, how many documents, and a root.

    Roots stand for the components of the group's links; a member and its root are an edge of
    the graph of all links, with no more edges than members.
    """

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, _GROUP):
            links = _new_pairs(group, trees, depth, threshold)
            if not links.any():
                continue
            column = group.column("grams").combine_chunks()
            grams = [column[i].values.to_numpy() for i in range(len(column))]
            sizes = np.array([len(g) for g in grams], np.float64)
            shared = _shared(grams)
            either = sizes[:, None] + sizes[None, :] - shared
            links &= shared >= threshold * either - 1e-9
            linked = np.flatnonzero(links.any(axis=1))
            if not len(linked):
                continue
            documents = links @ group.column("n_docs").to_numpy()
            root = np.arange(len(grams))
            while True:
                least = np.where(links, root[None, :], len(grams)).min(axis=1)
                joined = np.minimum(root, least)
                joined = joined[joined]
                if (joined == root).all():
                    break
                root = joined
            keys = group.column("key").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[i] for i in linked.tolist()], pa.binary()),
                    pa.array([keys[i] for i in root[linked].tolist()], pa.binary()),
                    pa.array(documents[linked].astype(np.int64)),
                ],
                names=["key", "root", "n_links"],
            )

    return verified


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(MIN_LONG)).alias("doc"),
        F.xxhash64(text).alias("row"),
        text.alias("text"),
    )


def _with_grams(rows: DataFrame, words: int) -> DataFrame:
    """``grams`` in place of ``text``: hashes of all runs of ``words`` words."""
    split = rows.withColumn("words", words_of(F.col("text"))).withColumn("n", F.size("words"))
    return split.withColumn("grams", word_grams(F.col("words"), F.col("n"), words)).drop(
        "text", "words", "n"
    )


def sketch(docs: DataFrame, forest: Forest, id_col: str, text_col: str) -> DataFrame:
    """``(doc, row, key, size, forest)``, written once. ``key`` names the set of shingles."""
    rows = _with_grams(_identified(docs, id_col, text_col), forest.words)
    sketched = rows.select("doc", "row", "grams").mapInArrow(
        _sketcher(forest.trees), "doc long, row long, key binary, size int, forest binary"
    )
    return written_table(sketched, "sketches")


def links(docs: DataFrame, sketched: DataFrame, forest: Forest, id_col: str, text_col: str):
    """``(classes, linked)``: sets of shingles, and the links between different ones.

    ``classes``: ``(key, size, forest, rep, n_docs)``, a row per set; ``linked``: ``(key, root,
    n_links)``, written once, see ``_verified``.
    """
    classes = (
        sketched.where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(
            F.first("size").alias("size"),
            F.first("forest").alias("forest"),
            F.min(F.struct("doc", "row")).alias("rep"),
            F.count("*").alias("n_docs"),
        )
    )
    classes = written_table(classes, "shingle-sets")
    leaves = tries(classes, forest)
    depth = shortened(classes, leaves, forest)
    return classes, _links_at(docs, classes, leaves, forest, depth, id_col, text_col)


def tries(classes: DataFrame, forest: Forest) -> DataFrame:
    """``(key, tree, label, near, next, common)``: the sorted labels of every tree, written once.

    Sorted labels are a prefix trie: what hangs below a node is a run of them. ``near`` is the
    longest prefix, in values, that a neighbour shares, ``next`` the following set and ``common``
    the prefix shared with it; labels without company down to the
    shortest prefix that may be used are left out. Ranges are sampled over labels and keys, so a
    label that many sets have is cut as well.
    """
    leaves = classes.select(
        "key", F.explode(F.sequence(F.lit(0), F.lit(forest.trees - 1))).alias("tree"), "forest"
    ).select(
        "key",
        "tree",
        F.substring(F.col("forest"), F.col("tree") * 2 * MAX_DEPTH + 1, F.lit(2 * MAX_DEPTH)).alias("label"),
    )
    order = ("tree", "label", "key")
    ranged = leaves.repartitionByRange(*order).sortWithinPartitions(*order)
    return written_table(
        ranged.mapInArrow(
            _neighbours(forest.depth()),
            "key binary, tree int, label binary, near int, next binary, common int",
        ),
        "tries",
    )


def shortened(classes: DataFrame, leaves: DataFrame, forest: Forest) -> int:
    """The length of prefixes that all trees use, shortened from whole labels.

    Neighbours in the sorted tries, no more pairs than leaves, show how unlike the pairs are that
    meet at each length: by the share of equal values in their signatures, of which about one in
    a thousand errs by more than ``MARGIN``; so pairs from ``MARGIN`` below the threshold count, as
    pairs at the threshold. A row for each length reaches the driver.
    """
    pairs = (
        leaves.where(F.col("common") >= forest.depth())
        .groupBy(F.least("key", "next").alias("key"), F.greatest("key", "next").alias("next"))
        .agg(F.max("common").alias("common"))
    )
    signed = classes.select("key", "forest")
    both = pairs.join(signed, "key").join(
        signed.select(F.col("key").alias("next"), F.col("forest").alias("other")), "next"
    )
    alike = both.select("common", "forest", "other").mapInArrow(_alike, "common int, similarity double")
    seen = dict(
        alike.where(F.col("similarity") >= forest.threshold - MARGIN)
        .groupBy("common")
        .agg(F.greatest(F.min("similarity"), F.lit(forest.threshold)).alias("least"))
        .collect()
    )
    depth, least = MAX_DEPTH, seen.get(MAX_DEPTH)
    while not forest.suffices(depth, least):
        depth -= 1
        least = min((x for x in (least, seen.get(depth)) if x is not None), default=None)
    return depth


def _links_at(
    docs: DataFrame,
    classes: DataFrame,
    leaves: DataFrame,
    forest: Forest,
    depth: int,
    id_col: str,
    text_col: str,
) -> DataFrame:
    """Links of the pairs that share a prefix of ``depth`` values in some tree, written once."""
    prefix = F.substring(F.col("label"), F.lit(1), F.lit(2 * depth))
    below = leaves.where(F.col("near") >= depth).select(
        "key", "tree", F.xxhash64("tree", prefix).alias("node")
    )
    crowded = below.groupBy("node").agg(F.count("*").alias("m")).where(F.col("m") > 1)
    n_blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("key", "node"), n_blocks).cast("int")
    placed = (
        below.join(crowded, "node")
        .select("key", "tree", "node", block.alias("block"), n_blocks.alias("n_blocks"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .select(
            "key",
            "tree",
            "node",
            "block",
            F.least("block", "other").alias("low"),
            F.greatest("block", "other").alias("high"),
        )
    )
    described = classes.select("key", "size", "forest", "n_docs")
    group = (
        "key binary, tree int, node long, block int, low int, high int, size int, "
        "forest binary, n_docs long"
    )
    columns = [field.split()[0] for field in group.split(", ")]
    met = written_table(
        _grouped(placed.join(described, "key").select(*columns)).mapInArrow(
            _first_met(forest.trees, depth, forest.threshold), group
        ),
        "met-prefixes",
    )
    wanted = met.select("key").distinct().join(classes.select("key", "rep"), "key")
    wanted = wanted.select("key", F.col("rep.doc").alias("doc"), F.col("rep.row").alias("row"))
    texts = _identified(docs, id_col, text_col).join(wanted, ["doc", "row"]).select("key", "text")
    grams = _with_grams(texts, forest.words).select(
        "key", F.array_distinct("grams").alias("grams")
    ).dropDuplicates(["key"])
    return written_table(
        _grouped(met.join(grams, "key")).mapInArrow(
            _verified(forest.trees, depth, forest.threshold),
            "key binary, root binary, n_links long",
        ),
        "links",
    )


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(key, root)``: the least key of each component of ``(key, root)`` edges.

    Each round takes the least label among neighbours, then the label of the label; a star or
    a chain shrinks fast. Labels are written every round, only a count comes to the driver.
    """
    both = edges.select("key", "root").unionByName(
        edges.select(F.col("root").alias("key"), F.col("key").alias("root"))
    )
    both = written_table(both.distinct(), "edges")
    labels = written_table(
        both.groupBy("key").agg(F.min("root").alias("root")).select(
            "key", F.least("key", "root").alias("root")
        ),
        "labels",
    )
    for _ in range(rounds):
        theirs = labels.select(F.col("key").alias("root"), F.col("root").alias("theirs"))
        best = both.join(theirs, "root").groupBy("key").agg(F.min("theirs").alias("theirs"))
        nearer = labels.join(best, "key").select(
            "key", F.col("root").alias("old"), F.least("root", "theirs").alias("root")
        )
        jumped = nearer.join(theirs, "root", "left").select(
            "key", "old", F.coalesce("theirs", "root").alias("root")
        )
        labels = written_table(jumped, "labels")
        if labels.where(F.col("old") != F.col("root")).isEmpty():
            return labels.select("key", "root")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    forest: Forest = Forest(),  # noqa: B008
) -> DataFrame:
    """``(doc, row, class_id, class_row, n_links)``, one row per input row.

    Documents whose sets of 5-word shingles have Jaccard similarity 0.8 or more are linked; a
    class is what links connect. ``class_id`` and ``class_row`` are the least ``(doc, row)`` of
    the class, ``n_links`` the number of other documents linked to this one, copies included.
    ``row`` is a hash of the text. A text of fewer than five words is one shingle; texts without
    words (null ones too) are classes of their own. A null id counts as the smallest long.
    Repeated rows are documents, so copies of each other. Other columns are not read.

    Copies (equal sets) are one from the start. The signatures of each tree, sorted, are a prefix
    trie. Prefixes are shortened from whole labels, value by value in all trees at once, until the
    recall is reached for pairs as alike as the least alike neighbours met so far (``shortened``,
    ``Forest``). Sets below one node are compared in blocks, so that neither a task holds a whole
    node nor any pair becomes a row. A pair counts in the first tree where it meets, and its link
    is verified on the whole sets (of 64-bit hashes).
    """
    sketched = sketch(docs, forest, id_col, text_col)
    classes, linked = links(docs, sketched, forest, id_col, text_col)
    roots = components(linked).alias("r")
    counts = linked.groupBy("key").agg(F.sum("n_links").alias("n_links")).alias("n")
    described = (
        classes.alias("c")
        .join(roots, F.col("c.key") == F.col("r.key"), "left")
        .join(counts, F.col("c.key") == F.col("n.key"), "left")
        .select(
            F.col("c.key").alias("key"),
            F.coalesce("r.root", "c.key").alias("root"),
            F.col("c.rep").alias("rep"),
            (F.coalesce("n.n_links", F.lit(0)) + F.col("c.n_docs") - 1).alias("n_links"),
        )
    )
    first = described.groupBy("root").agg(F.min("rep").alias("first"))
    info = described.join(first, "root").select("key", "first", "n_links")
    with_words = (
        sketched.where(F.col("key").isNotNull())
        .select("doc", "row", "key")
        .join(info, "key")
        .select(
            "doc",
            "row",
            F.col("first.doc").alias("class_id"),
            F.col("first.row").alias("class_row"),
            "n_links",
        )
    )
    without = sketched.where(F.col("key").isNull()).select(
        "doc",
        "row",
        F.col("doc").alias("class_id"),
        F.col("row").alias("class_row"),
        F.lit(0).cast("long").alias("n_links"),
    )
    return with_words.unionByName(without)


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """The rows of ``docs`` that come first, by id, in their class of near copies.

    Of repeated rows one stays. Texts without words (null and empty ones) have no copies: but for
    repeated rows, all of them stay. Null ids, long texts and clashing names are as in
    ``near_copies``; an empty table stays empty. Columns and their names stay as they are.
    """
    found = near_copies(docs, id_col, text_col, **options)
    first = found.where(
        (F.col("doc") == F.col("class_id")) & (F.col("row") == F.col("class_row"))
    ).select("doc", "row")
    whole = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(MIN_LONG)).alias("doc"),
        F.xxhash64(text_of(text_col)).alias("row"),
        F.struct("*").alias("input"),
    )
    return whole.dropDuplicates(["doc", "row"]).join(first, ["doc", "row"], "left_semi").select(
        "input.*"
    )
