"""Jobs: location -> species and species -> location models with grouped cross-validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from occugrid import storage
from occugrid.operators import labels, metrics, models, occupancy
from occugrid.operators.forest import ForestParams
from occugrid.sources import tables


def dataset(
    features: DataFrame,
    top_k: int = 50,
    cv_splits: int = 5,
    keep_unlabelled: bool = False,
    block_deg: int = 1,
    categorical: tuple[str, ...] = (labels.HEMISPHERE,),
) -> models.Dataset:
    """Region dataset of the ``top_k`` species.

    location -> species leaves out the regions without any of them; species -> location
    (``keep_unlabelled=True``) keeps every region. ``block_deg`` is the edge of the blocks that
    cross-validation keeps together, in degrees. ``categorical`` columns are one-hot inputs.
    """
    top = occupancy.top_species(
        occupancy.species_support(occupancy.occupancy(features)), top_k
    )
    return models.prepare(features, top, cv_splits, keep_unlabelled, block_deg, categorical)


def location_to_species_metrics(
    data: models.Dataset, forest_params: ForestParams = ForestParams(), ledger: str | None = None
) -> DataFrame:
    """``fold, micro_f1, macro_f1`` of the forests, with the mean row."""
    scores = models.cross_validate(data, "rf", forest_params=forest_params, ledger=ledger)
    per_label = metrics.confusion(scores, metrics.LABEL_KEYS)
    return metrics.fold_table(metrics.f1_per_fold(per_label))


def species_to_location_tables(scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per-fold metrics and the species table with its summary rows.

    Both derive from one row per model and one per fold; these are written, so the scores
    are read once for each.
    """
    per_label = storage.written_table(metrics.label_metrics(scores), "label_metrics")
    per_fold = storage.written_table(metrics.fold_metrics(scores, per_label), "fold_metrics")
    return per_fold, metrics.species_table(metrics.species_means(per_label), per_fold)


@storage.drops_its_tables
def run_location_to_species(
    spark: SparkSession,
    train_features: str,
    out_dir: str,
    topk: int = 50,
    cv_splits: int = 5,
    seed: int = 42,
    forest_params: ForestParams | None = None,
    fmt: str = "parquet",
    by_position: bool = False,
    block_deg: int = 1,
    ledger: str | None = None,
    categorical: tuple[str, ...] = (labels.HEMISPHERE,),
) -> dict[str, str]:
    """Cross-validate, write the metric table, fit on all regions and save the models."""
    params = forest_params or ForestParams(seed=seed)
    features = tables.read_train_features(spark, train_features, fmt, by_position)
    data = dataset(features, topk, cv_splits, block_deg=block_deg, categorical=categorical)
    table = location_to_species_metrics(data, params, ledger)
    return {
        "metrics": tables.write_table(
            table.coalesce(1).orderBy(F.col("fold").try_cast("int").asc_nulls_last(), "fold"),
            f"{out_dir}/cv_metrics",
            "csv",
        ),
        "model": models.fit_final(data, f"{out_dir}/loc2spec_model", "rf", forest_params=params),
    }


@storage.drops_its_tables
def run_species_to_location(
    spark: SparkSession,
    train_features: str,
    out_dir: str,
    model_dir: str,
    topk: int = 50,
    cv_splits: int = 5,
    model: str = "lr",
    seed: int = 42,
    forest_params: ForestParams | None = None,
    fmt: str = "parquet",
    by_position: bool = False,
    block_deg: int = 1,
    ledger: str | None = None,
    categorical: tuple[str, ...] = (labels.HEMISPHERE,),
) -> dict[str, str]:
    """Cross-validate, write metric table and run log, fit on all regions, save the models."""
    models.check_kind(model)
    params = forest_params or ForestParams(seed=seed)
    features = tables.read_train_features(spark, train_features, fmt, by_position)
    data = dataset(features, topk, cv_splits, keep_unlabelled=True, block_deg=block_deg, categorical=categorical)
    scores = storage.written_table(
        models.cross_validate(data, model, forest_params=params, ledger=ledger), "scores"
    )
    per_fold, table = species_to_location_tables(scores)
    rank = F.broadcast(data.top.select(F.col("taxon_id").cast("string").alias("taxon_id"), "label_rank"))
    summary_last = F.coalesce("label_rank", F.when(F.col("taxon_id") == "micro", topk).otherwise(topk + 1))
    ordered = table.join(rank, "taxon_id", "left").orderBy(summary_last).drop("label_rank")
    log = metrics.cv_log(per_fold, topk, cv_splits, model, seed)
    return {
        "metrics": tables.write_table(ordered, f"{out_dir}/spec2loc_cv_metrics", "csv"),
        "log": tables.write_table(log, f"{out_dir}/spec2loc_cv_logs", "json"),
        "model": models.fit_final(
            data, f"{model_dir}/spec2loc_{model}", model, forest_params=params
        ),
    }
