"""Random forests: one binary forest per label, all of them grown by one Spark job.

The rows of a dataset are cells of one degree, at most ``MAX_ROWS`` whatever the observations, and
five numbers each. So the rows are the small side and the trees the large one: a unit of work is a
block of trees of one (fold, label), units are spread over the cluster, and every task has all rows.
A lost executor costs its units. Fitted forests are a table of nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occugrid.operators import trees
from occugrid.operators.logistic import single_class

#: Cells of one degree on the globe, both ends included.
MAX_ROWS = 181 * 361
#: Drawn rows that a task holds for a block of trees; what a block holds changes no tree.
ROWS_AT_A_TIME = 1_000_000
#: Locations that meet a block of trees in one group.
LOCATIONS = 500_000

NODES = (
    "label_rank int, block int, tree int, node int, feature int, threshold double, "
    "left int, right int, p double"
)


@dataclass(frozen=True)
class ForestParams:
    """Trees see ``sqrt(features)`` of the features at each node and grow until a node has one
    class; ``max_depth`` stops them earlier."""

    num_trees: int = 300
    max_depth: int | None = None
    seed: int = 42


@dataclass(frozen=True)
class _Rows:
    """The training table in every task: features, folds and label bits, by region."""

    region: list[str]
    x: np.ndarray
    fold: np.ndarray
    words: np.ndarray

    def labels(self, rank: int) -> np.ndarray:
        return (self.words[:, rank // 64] >> np.int64(rank % 64)) & 1

    def forest(self, fold: int, rank: int, first: int, last: int, params: ForestParams) -> trees.Nodes:
        """Trees ``first`` to ``last`` of a label over the rows outside ``fold``."""
        rows = np.flatnonzero(self.fold != fold)
        keys = trees.mixed(params.seed, fold, rank, np.arange(first, last)).view(np.int64)
        weights = np.stack([trees.bootstrap(key, rows, len(self.fold)) for key in keys])
        candidates = max(1, int(np.sqrt(self.x.shape[1])))
        return trees.grow(self.x, self.labels(rank), weights, keys, candidates, params.max_depth)


def _collected(rows: DataFrame, feature_columns: list[str]) -> _Rows:
    """All rows in the order of their regions; ``MAX_ROWS`` bounds them, and more are refused."""
    words = [name for name in rows.columns if name.startswith("word_")]
    columns = [F.col(name).cast("double").alias(name) for name in feature_columns]
    table = rows.select("region", "fold", *words, *columns).limit(MAX_ROWS + 1).toArrow().sort_by("region")
    if table.num_rows > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} regions: forests are fitted over cells of one degree")
    return _Rows(
        table["region"].to_pylist(),
        np.column_stack([table[name].to_numpy() for name in feature_columns]),
        table["fold"].to_numpy(),
        np.column_stack([table[name].to_numpy() for name in words]),
    )


def _units(spark, models: list[tuple[int, int]], n_blocks: int) -> DataFrame:
    """``(unit)``: a number for every block of every model, spread over the cores."""
    n = len(models) * n_blocks
    return spark.range(0, n, 1, max(1, min(n, 8 * spark.sparkContext.defaultParallelism))).toDF("unit")


def _blocks(n_rows: int, params: ForestParams) -> tuple[int, int]:
    """``(trees in a block, number of blocks)``."""
    size = max(1, min(params.num_trees, ROWS_AT_A_TIME // max(n_rows, 1)))
    return size, -(-params.num_trees // size)


def _block_trees(units: DataFrame, rows: _Rows, models: list[tuple[int, int]], params: ForestParams, use, schema: str):
    """What ``use(fold, rank, block, number of trees, nodes, rows)`` yields for every block."""
    size, n_blocks = _blocks(len(rows.region), params)
    shared = units.sparkSession.sparkContext.broadcast(rows)

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in batch["unit"].to_pylist():
                (fold, rank), block = models[unit // n_blocks], unit % n_blocks
                first = block * size
                last = min(first + size, params.num_trees)
                nodes = shared.value.forest(fold, rank, first, last, params)
                yield use(fold, rank, block, first, last, nodes, shared.value)

    return units.mapInArrow(grown, schema)


def _constants(counts: dict[tuple[int, int], tuple[int, int]]) -> dict[tuple[int, int], float]:
    known = {key: single_class(*n) for key, n in counts.items()}
    return {key: constant for key, constant in known.items() if constant is not None}


def held_out_scores(
    rows: DataFrame,
    feature_columns: list[str],
    counts: dict[tuple[int, int], tuple[int, int]],
    params: ForestParams,
) -> DataFrame:
    """``(fold, region, label_rank, y, p, yhat)``: rows of each fold, scored by the forests that
    did not see it. ``counts`` has training rows and positives per (fold, label); a training set
    of one class gives that class as a constant. ``p`` is the mean of the trees' leaf shares."""
    data = _collected(rows, feature_columns)
    constants = _constants(counts)
    models = [key for key in counts if key not in constants]
    schema = "fold int, region string, label_rank int, y int, block int, total double"

    def score(fold, rank, block, first, last, nodes, own) -> pa.RecordBatch:
        seen = np.flatnonzero(own.fold == fold)
        total = trees.walk(nodes, last - first, own.x[seen])
        return _scored(fold, rank, block, total, seen, own)

    def constant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for fold, rank, p in zip(*[batch[i].to_pylist() for i in range(3)], strict=True):
                seen = np.flatnonzero(own.fold == fold)
                yield _scored(fold, rank, 0, np.full(len(seen), p * params.num_trees), seen, own)

    spark = rows.sparkSession
    parts = []
    if models:
        units = _units(spark, models, _blocks(len(data.region), params)[1])
        parts.append(_block_trees(units, data, models, params, score, schema))
    if constants:
        shared = spark.sparkContext.broadcast(data)
        known = spark.createDataFrame([(*key, p) for key, p in constants.items()], "fold int, rank int, p double")
        parts.append(known.mapInArrow(constant, schema))
    scores = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if _blocks(len(data.region), params)[1] > 1:
        scores = _added(scores, ["fold", "region", "label_rank", "y"])
    return _with_p(scores, params.num_trees).select("fold", "region", "label_rank", "y", "p", "yhat")


def _scored(fold: int, rank: int, block: int, total: np.ndarray, seen: np.ndarray, own: _Rows) -> pa.RecordBatch:
    n = len(seen)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, fold, np.int32)),
            pa.array([own.region[i] for i in seen.tolist()], pa.string()),
            pa.array(np.full(n, rank, np.int32)),
            pa.array(own.labels(rank)[seen].astype(np.int32)),
            pa.array(np.full(n, block, np.int32)),
            pa.array(total, pa.float64()),
        ],
        names=["fold", "region", "label_rank", "y", "block", "total"],
    )


def _added(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of the blocks of a forest added in their order, the same on every run."""
    parts = F.sort_array(F.collect_list(F.struct("block", "total")))
    total = F.aggregate(parts, F.lit(0.0), lambda before, one: before + one["total"])
    return scores.groupBy(*keys).agg(total.alias("total"))


def _with_p(scores: DataFrame, num_trees: int) -> DataFrame:
    p = F.col("total") / num_trees
    return scores.withColumn("p", p).withColumn("yhat", (F.col("p") > 0.5).cast("int"))


def fit(
    rows: DataFrame,
    feature_columns: list[str],
    counts: dict[tuple[int, int], tuple[int, int]],
    params: ForestParams,
) -> DataFrame:
    """The nodes of the forests of ``counts`` as a table: ``(label_rank, block, tree, node,
    feature, threshold, left, right, p)``.

    ``feature`` is the place of the input, -1 in a leaf; a row goes right where its value is above
    ``threshold``; ``p`` is the share of the class among the node's rows. A label with one class
    only has no nodes.
    """
    data = _collected(rows, feature_columns)
    constants = _constants(counts)
    models = [key for key in counts if key not in constants]

    def table(fold, rank, block, first, last, nodes, own) -> pa.RecordBatch:
        n = len(nodes.tree)
        whole = {
            "label_rank": np.full(n, rank), "block": np.full(n, block), "tree": nodes.tree + first,
            "node": nodes.node, "feature": nodes.feature, "left": nodes.left, "right": nodes.right,
        }
        columns = {name: pa.array(values.astype(np.int32)) for name, values in whole.items()}
        columns |= {"threshold": pa.array(nodes.threshold), "p": pa.array(nodes.p)}
        names = [field.split()[0] for field in NODES.split(", ")]
        return pa.RecordBatch.from_arrays([columns[name] for name in names], names=names)

    spark = rows.sparkSession
    if not models:
        return spark.createDataFrame([], NODES)
    units = _units(spark, models, _blocks(len(data.region), params)[1])
    return _block_trees(units, data, models, params, table, NODES)


def predict(nodes: DataFrame, num_trees: int, rows: DataFrame, feature_columns: list[str], keep: list[str]) -> DataFrame:
    """``keep`` with ``(label_rank, p, yhat)`` of every forest in ``nodes``, for any number of rows.

    Blocks of trees and groups of rows are brought together by a shuffle, the nodes in front of
    the rows, so that a task holds one block of trees and streams the rows past it. Neither
    passes through the driver. Rows and their repetitions are kept, each by itself.
    """
    last_label, last_block = nodes.agg(F.max("label_rank"), F.max("block")).first()
    n_blocks = (last_block or 0) + 1
    # Without a forest the sequence is empty, and so is the result.
    n_forests = 0 if last_label is None else (last_label + 1) * n_blocks
    n_groups = max(1, -(-rows.count() // LOCATIONS))
    key = ["label_rank", "block", "location_group"]
    inputs = F.array(*[F.col(name).cast("double") for name in feature_columns])
    forests = F.filter(F.sequence(F.lit(0), F.lit(n_forests)), lambda number: number < n_forests)
    # The numbers come first: next to the explode they would be drawn after it.
    numbered = rows.select(
        F.struct(*keep, F.monotonically_increasing_id().alias("__row")).alias("kept"), inputs.alias("x")
    )
    located = numbered.select("kept", "x", F.explode(forests).alias("forest")).select(
        F.floor(F.col("forest") / n_blocks).cast("int").alias("label_rank"),
        (F.col("forest") % n_blocks).cast("int").alias("block"),
        F.pmod(F.col("kept.__row"), F.lit(n_groups)).cast("int").alias("location_group"),
        "kept",
        "x",
    )
    copied = nodes.withColumn("location_group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    both = copied.unionByName(located, allowMissingColumns=True)
    ordered = both.repartition(*key).sortWithinPartitions(*key, F.col("kept").isNotNull(), "tree", "node")
    kept_type = located.schema["kept"].dataType.simpleString()

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts, forest = None, [], None
        for batch in batches:
            ranks, blocks, groups = (batch[name].to_numpy() for name in key)
            is_row = batch["kept"].is_valid().to_numpy(zero_copy_only=False)
            marks = np.stack([ranks, blocks, groups, is_row], axis=1)
            edges = np.flatnonzero(np.any(marks[1:] != marks[:-1], axis=1)) + 1
            for start, end in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                piece = batch.slice(start, end - start)
                if group != (own := tuple(marks[start, :3].tolist())):
                    group, parts, forest = own, [], None
                if not is_row[start]:
                    parts.append(piece)
                    continue
                if forest is None:
                    forest = _as_nodes(parts)
                if forest is not None:
                    x = np.asarray(piece["x"].flatten(), np.float64).reshape(end - start, -1)
                    total = trees.walk(*forest, x)
                    yield pa.RecordBatch.from_arrays(
                        [piece["kept"], piece["label_rank"], piece["block"], pa.array(total)],
                        names=["kept", "label_rank", "block", "total"],
                    )

    scores = ordered.mapInArrow(walked, f"kept {kept_type}, label_rank int, block int, total double")
    if n_blocks > 1:
        scores = _added(scores, ["kept", "label_rank"])
    return _with_p(scores, num_trees).select("kept.*", "label_rank", "p", "yhat").drop("__row")


def _as_nodes(parts: list[pa.RecordBatch]) -> tuple[trees.Nodes, int] | None:
    """A block's trees, numbered from 0, and how many there are; none if it has no nodes."""
    if not parts:
        return None
    whole = pa.Table.from_batches(parts)
    names = ("tree", "node", "feature", "threshold", "left", "right", "p")
    columns = [whole[name].to_numpy() for name in names]
    columns[0] = columns[0] - columns[0].min()
    return trees.Nodes(*columns), int(columns[0].max()) + 1
