"""F1, ROC-AUC and average precision as aggregations over a long score table.

Scores: ``(fold, region, taxon_id, label_rank, y, p, yhat)``. An undefined value is NULL, and
``avg`` skips it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occugrid import storage
from occugrid.functions import measures

LABEL_KEYS = ["fold", "taxon_id"]
FOLD_KEYS = ["fold"]


def confusion(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of the class predictions and F1 (0/0 = 0) per key."""
    y, yhat = F.col("y"), F.col("yhat")
    return (
        scores.groupBy(*keys)
        .agg(
            F.sum(y * yhat).alias("tp"),
            F.sum((1 - y) * yhat).alias("fp"),
            F.sum(y * (1 - yhat)).alias("fn"),
        )
        .withColumn("f1", measures.f1(F.col("tp"), F.col("fp"), F.col("fn")))
    )


def distinct_scores(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Per distinct score: positives and negatives there (``pos``, ``neg``), predicted as 1
    (``hit``, ``miss``), and the range (``part``) it lies in.

    Equal scores are counted first (map-side). Ranges follow keys and falling scores; they are
    sampled, so they hold like numbers of scores however clustered those are, and written, so
    that a retry keeps them.
    """
    counted = scores.groupBy(*keys, "p").agg(
        F.expr("sum(y) AS pos"),
        F.expr("sum(1 - y) AS neg"),
        F.expr("sum(y * yhat) AS hit"),
        F.expr("sum((1 - y) * yhat) AS miss"),
    )
    ranged = counted.repartitionByRange(*[F.col(key).asc() for key in keys], F.col("p").desc())
    return storage.written_table(ranged.withColumn("part", F.spark_partition_id()), "distinct-scores")


def cumulative_counts(scores: DataFrame, keys: list[str]) -> DataFrame:
    """``distinct_scores`` with the counts at each score or above (``pos_upto``, ``neg_upto``).

    Totals of the earlier ranges plus the sum inside the range: no single task sorts all scores
    of a fold. Every range has its totals; the outer join keeps Catalyst from broadcasting the
    larger side.
    """
    counted = distinct_scores(scores, keys)
    partition = ", ".join(keys)
    earlier = f"(PARTITION BY {partition} ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    totals = (
        counted.groupBy(*keys, "part")
        .agg(F.expr("sum(pos) AS pos"), F.expr("sum(neg) AS neg"))
        .selectExpr(
            *keys,
            "part",
            f"coalesce(sum(pos) OVER {earlier}, 0) AS pos_above",
            f"coalesce(sum(neg) OVER {earlier}, 0) AS neg_above",
        )
    )
    inside = (
        f"(PARTITION BY {partition}, part ORDER BY p DESC "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    )
    return (
        counted.selectExpr(
            "*",
            f"sum(pos) OVER {inside} AS pos_inside",
            f"sum(neg) OVER {inside} AS neg_inside",
        )
        .join(totals, [*keys, "part"], "left")
        .selectExpr(
            *keys,
            "pos",
            "neg",
            "hit",
            "miss",
            "CAST(pos_above + pos_inside AS DOUBLE) AS pos_upto",
            "CAST(neg_above + neg_inside AS DOUBLE) AS neg_upto",
        )
    )


def metrics_by(scores: DataFrame, keys: list[str]) -> DataFrame:
    """ROC-AUC (ties count half), step-wise average precision and F1 per key, with counts."""
    return (
        cumulative_counts(scores, keys)
        .groupBy(*keys)
        .agg(
            F.expr("sum(neg * (pos_upto - pos) + 0.5D * neg * pos) AS area"),
            F.expr("sum(pos * pos_upto / (pos_upto + neg_upto)) AS steps"),
            F.expr("sum(pos) AS n_pos"),
            F.expr("sum(neg) AS n_neg"),
            F.expr("sum(hit) AS tp"),
            F.expr("sum(miss) AS fp"),
        )
        .selectExpr("*", "n_pos - tp AS fn")
        .select(
            *keys,
            "n_pos",
            "n_neg",
            "tp",
            "fp",
            "fn",
            F.expr("try_divide(area, CAST(n_pos AS DOUBLE) * n_neg) AS roc_auc"),
            F.expr("try_divide(steps, CAST(n_pos AS DOUBLE)) AS pr_auc"),
            measures.f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"),
        )
    )


def label_metrics(scores: DataFrame) -> DataFrame:
    """``metrics_by`` fold and species: one row per model."""
    return metrics_by(scores, LABEL_KEYS)


def defined_only(per_label: DataFrame) -> DataFrame:
    """Per-species view: AUC and F1 need both classes, AP needs a positive; else NULL."""
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return per_label.withColumn("f1", F.when(both, F.col("f1")))


def f1_per_fold(per_label: DataFrame) -> DataFrame:
    """Micro F1 (pooled counts) and macro F1 (mean over species, 0/0 = 0) per fold."""
    pooled = measures.f1(F.sum("tp"), F.sum("fp"), F.sum("fn"))
    return per_label.groupBy("fold").agg(pooled.alias("micro_f1"), F.avg("f1").alias("macro_f1"))


def fold_metrics(scores: DataFrame, per_label: DataFrame) -> DataFrame:
    """The six metrics of each fold.

    The macro AUC is undefined as soon as one species is; a species without a positive
    enters the averaged AP as 0.
    """
    zero = F.lit(0.0)
    micro = metrics_by(scores, FOLD_KEYS).select(
        "fold",
        F.col("roc_auc").alias("roc_auc_micro"),
        F.coalesce("pr_auc", zero).alias("pr_auc_micro"),
        F.col("f1").alias("f1_micro"),
    )
    complete = F.count("roc_auc") == F.count("*")
    macro = per_label.groupBy("fold").agg(
        F.when(complete, F.avg("roc_auc")).alias("roc_auc_macro"),
        F.avg(F.coalesce("pr_auc", zero)).alias("pr_auc_macro"),
        F.avg("f1").alias("f1_macro"),
    )
    return micro.join(macro, "fold")


def species_means(per_label: DataFrame) -> DataFrame:
    """Mean over folds of each species' metrics, undefined folds left out."""
    names = ("roc_auc", "pr_auc", "f1")
    return defined_only(per_label).groupBy("taxon_id").agg(
        *[F.avg(name).alias(name) for name in names]
    )


def fold_table(per_fold: DataFrame) -> DataFrame:
    """``fold, micro_f1, macro_f1`` with a closing ``mean`` row."""
    rows = per_fold.select(F.col("fold").cast("string").alias("fold"), "micro_f1", "macro_f1")
    mean = per_fold.agg(F.avg("micro_f1").alias("micro_f1"), F.avg("macro_f1").alias("macro_f1"))
    return rows.unionByName(mean.select(F.lit("mean").alias("fold"), "micro_f1", "macro_f1"))


def species_table(per_species: DataFrame, per_fold: DataFrame) -> DataFrame:
    """``taxon_id, roc_auc, pr_auc, f1`` per species with closing ``micro`` and ``macro`` rows."""
    names = ("roc_auc", "pr_auc", "f1")
    rows = per_species.select(F.col("taxon_id").cast("string").alias("taxon_id"), *names)
    summary = F.array(
        *[
            F.struct(
                F.lit(level).alias("taxon_id"),
                *[F.avg(f"{name}_{level}").alias(name) for name in names],
            )
            for level in ("micro", "macro")
        ]
    )
    return rows.unionByName(per_fold.agg(summary.alias("rows")).select(F.inline("rows")))


def cv_log(per_fold: DataFrame, topk: int, cv_splits: int, model: str, seed: int) -> DataFrame:
    """One row: run parameters and the metrics of the ``cv_splits`` folds in order."""
    params = F.struct(
        F.lit(topk).alias("topk"),
        F.lit(cv_splits).alias("cv_splits"),
        F.lit(model).alias("model"),
        F.lit(seed).alias("seed"),
    )
    fold = F.struct(*per_fold.columns)
    return per_fold.agg(F.array_sort(F.collect_list(fold)).alias("folds")).select(
        params.alias("params"), "folds"
    )
