"""Cross-validation, final fit, prediction and storage of the per-label models."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from occugrid import storage
from occugrid.operators import categories, forest, labels, logistic
from occugrid.operators.forest import ForestParams
from occugrid.operators.logistic import FINAL

MODEL_KINDS = ("lr", "rf")
#: Labels whose fits are one entry of a ledger.
LABELS_PER_PART = 25


@dataclass(frozen=True)
class Dataset:
    """Region rows with label bits and fold, the labels, and the inputs of the models.

    ``categories`` is the dictionary behind the 0/1 columns among the inputs.
    """

    rows: DataFrame
    top: DataFrame
    n_labels: int
    n_splits: int
    feature_columns: list[str]
    categories: dict[str, list[str]] = field(default_factory=dict)

    def grid(self) -> DataFrame:
        """Long label table: every region with every label."""
        return labels.label_grid(self.rows, self.n_labels)

    def wide(self) -> DataFrame:
        """Region rows with the 0/1 label list, in popularity order."""
        return self.rows.withColumn("labels", labels.label_array(self.n_labels))

    def folds(self) -> range:
        return range(1, self.n_splits + 1)


def check_kind(model: str) -> str:
    if model not in MODEL_KINDS:
        raise ValueError(f"unsupported model type {model!r}, expected one of {MODEL_KINDS}")
    return model


def prepare(
    features: DataFrame,
    top: DataFrame,
    n_splits: int,
    keep_unlabelled: bool,
    block_deg: int = 1,
    categorical: tuple[str, ...] = (labels.HEMISPHERE,),
) -> Dataset:
    """Build the dataset in two passes over the features: one for ``top``, one for the regions.

    Each step is written, so the folds and every later fit only read small tables. With
    ``block_deg`` above 1 all regions of a block of so many degrees are in one fold, so that a
    region is not judged by its neighbours. ``categorical`` columns of ``features`` become 0/1
    inputs, one for each category that occurs but the first.
    """
    if block_deg < 1:
        raise ValueError(f"block_deg must be a whole number from 1 up, not {block_deg}")
    top = storage.written_table(top, "labels")
    n_labels = top.count()
    rows = storage.written_table(
        labels.labelled_regions(features, top, n_labels, keep_unlabelled, block_deg, categorical), "regions"
    )
    known = categories.known_categories(rows, list(categorical))
    dealt = labels.assign_folds if block_deg == 1 else labels.assign_block_folds
    rows = storage.written_table(
        categories.one_hot(dealt(rows, n_splits), known), "folds", spread_by="region"
    )
    n_groups = rows.agg(F.count_distinct("group_key")).first()[0]
    if not 2 <= n_splits <= n_groups:
        raise ValueError(f"cannot split {n_groups} groups into {n_splits} folds")
    inputs = labels.NUMERIC_FEATURES + categories.one_hot_columns(known)
    return Dataset(rows, top, n_labels, n_splits, inputs, known)


def _score_columns(scores: DataFrame, top: DataFrame) -> DataFrame:
    return labels.with_taxa(scores, top).select(
        "fold", "region", "taxon_id", "label_rank", "y", "p", "yhat"
    )


def _held_out(
    data: Dataset, grid: DataFrame, folds: list[int], model: str, max_iter: int, forest_params: ForestParams
) -> DataFrame:
    """Scores of the rows of ``folds``, by the models of the labels in ``grid`` that did not see them."""
    if model == "lr":
        models = logistic.fit(grid, data.feature_columns, folds, max_iter)
        held = grid.where(F.col("fold").isin(folds))
        return logistic.predict(held, models.table(grid.sparkSession), data.feature_columns)
    counts = logistic.class_counts(grid, folds)
    return forest.held_out_scores(data.rows, data.feature_columns, counts, forest_params)


def cross_validate(
    data: Dataset,
    model: str = "lr",
    max_iter: int = 200,
    forest_params: ForestParams = ForestParams(),
    ledger: str | None = None,
) -> DataFrame:
    """Out-of-fold scores ``(fold, region, taxon_id, label_rank, y, p, yhat)``.

    With ``ledger``, a folder that outlives the run, the fits are done in parts of one fold and
    ``LABELS_PER_PART`` labels, each of which leaves its scores there. A run that was stopped does
    only what is missing when it is started again on the same data with the same parameters; other
    data or parameters have parts of their own.
    """
    check_kind(model)
    grid = data.grid()
    if ledger is None:
        scores = _held_out(data, grid, list(data.folds()), model, max_iter, forest_params)
        if model == "rf":
            scores = storage.written_table(scores, "scores")
        return _score_columns(scores, data.top)
    spark = data.rows.sparkSession
    folder = f"{ledger}/{_run_key(data, model, max_iter, forest_params)}"
    columns = ["fold", "region", "label_rank", "y", "p", "yhat"]
    paths = []
    for fold in data.folds():
        for first in range(0, data.n_labels, LABELS_PER_PART):
            path = f"{folder}/fold-{fold}-labels-{first}"
            paths.append(path)
            if not storage.is_written(spark, path):
                part = grid.where(F.col("label_rank").between(first, first + LABELS_PER_PART - 1))
                scores = _held_out(data, part, [fold], model, max_iter, forest_params)
                scores.select(*columns).write.mode("overwrite").parquet(path)
    return _score_columns(spark.read.parquet(*paths), data.top)


def _run_key(data: Dataset, model: str, max_iter: int, forest_params: ForestParams) -> str:
    """A name for the fits of these rows and labels with these parameters."""
    ordered = sorted(data.rows.columns)
    rows = data.rows.agg(F.count("*"), F.expr(f"bit_xor(xxhash64({', '.join(ordered)}))")).first()
    top = data.top.agg(F.count("*"), F.expr("bit_xor(xxhash64(label_rank, taxon_id))")).first()
    settings = forest_params if model == "rf" else max_iter
    named = (*rows, *top, ordered, data.feature_columns, data.n_splits, model, settings, LABELS_PER_PART)
    return f"{model}-{hashlib.sha256(repr(named).encode()).hexdigest()[:16]}"


def fit_final(
    data: Dataset,
    path: str,
    model: str = "lr",
    max_iter: int = 200,
    forest_params: ForestParams = ForestParams(),
) -> str:
    """Fit every label on all rows and save the models, their labels and their inputs."""
    spark = data.rows.sparkSession
    grid = data.grid()
    if check_kind(model) == "lr":
        models = logistic.fit(grid, data.feature_columns, [FINAL], max_iter)
        models.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")
        constants = {rank: c for (_, rank), c in models.constants.items()}
    else:
        counts = logistic.class_counts(grid, [FINAL])
        constants = {
            rank: c for (_, rank), n in counts.items() if (c := logistic.single_class(*n)) is not None
        }
        nodes = forest.fit(data.rows, data.feature_columns, counts, forest_params)
        nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    known = spark.createDataFrame(list(constants.items()), "label_rank INT, constant DOUBLE")
    metadata = (
        data.top.select("label_rank", "taxon_id")
        .join(F.broadcast(known), "label_rank", "left")
        .withColumns(
            {
                "model": F.lit(model),
                "feature_columns": F.array(*[F.lit(name) for name in data.feature_columns]),
                "categories": F.from_json(F.lit(json.dumps(data.categories)), "map<string,array<string>>"),
                "num_trees": F.lit(forest_params.num_trees if model == "rf" else None).cast("int"),
            }
        )
    )
    metadata.coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")
    return path


def predict(spark: SparkSession, path: str, data: Dataset) -> DataFrame:
    """Scores of every region of ``data`` by the models saved under ``path``.

    Categories are read by the dictionary of the models, whichever occur in ``data``.
    """
    metadata = spark.read.parquet(f"{path}/metadata").orderBy("label_rank").collect()
    kind, columns = metadata[0]["model"], list(metadata[0]["feature_columns"])
    rows = categories.one_hot(data.rows, metadata[0]["categories"])
    if kind == "lr":
        grid = labels.label_grid(rows, data.n_labels)
        scores = logistic.predict(grid, spark.read.parquet(f"{path}/weights"), columns)
        return _score_columns(scores, data.top)
    words = labels.label_words(data.n_labels)
    scored = _forest_scores(spark, path, metadata, rows, ["fold", "region", *words])
    scored = scored.withColumn("y", labels.has_label(F.col("label_rank"), data.n_labels))
    return _score_columns(scored, data.top)


def _forest_scores(spark: SparkSession, path: str, metadata: list, rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` with ``(label_rank, p, yhat)`` of every saved forest and constant."""
    nodes = spark.read.schema(forest.NODES).parquet(f"{path}/nodes")
    scored = forest.predict(nodes, metadata[0]["num_trees"], rows, list(metadata[0]["feature_columns"]), keep)
    constants = [(m["label_rank"], m["constant"]) for m in metadata if m["constant"] is not None]
    if not constants:
        return scored
    # One for each label at most.
    known = F.explode(F.array(*[F.struct(F.lit(r).alias("label_rank"), F.lit(c).alias("p")) for r, c in constants]))
    constant = rows.select(*keep, known.alias("known")).select(*keep, "known.*")
    return scored.unionByName(constant.withColumn("yhat", (F.col("p") > 0.5).cast("int")))


def predict_locations(
    spark: SparkSession, path: str, features: DataFrame, id_col: str = "loc_id", unseen: str = "first"
) -> DataFrame:
    """``(id, taxon_id, label_rank, p, yhat)``: saved models on any table with grid features.

    ``features`` needs ``id_col`` and the five features of a cell, like the test features of
    the feature job, and the other categories of the models; it needs no labels. Categories are
    read by the models' dictionary; those the models do not know are treated as ``unseen`` says
    (``categories.one_hot``).
    """
    metadata = spark.read.parquet(f"{path}/metadata").orderBy("label_rank").collect()
    kind, columns = metadata[0]["model"], list(metadata[0]["feature_columns"])
    rows = categories.one_hot(features, metadata[0]["categories"], unseen)
    if kind == "lr":
        weights = spark.read.parquet(f"{path}/weights")
        scored = logistic.predict_rows(rows, weights, columns, [id_col])
    else:
        scored = _forest_scores(spark, path, metadata, rows, [id_col])
    top = spark.read.parquet(f"{path}/metadata").select("label_rank", "taxon_id")
    return scored.join(F.broadcast(top), "label_rank").select(
        id_col, "taxon_id", "label_rank", "p", "yhat"
    )
