"""Every operator as a query over the test tables: name -> (spark, sf_dir) -> DataFrame.

Ratios and trigonometric values are rounded to 9 decimals, lists become strings, so that the
results compare exactly with the SQL in ``occugrid.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from occugrid import schemas, storage
from occugrid.operators import (
    categories,
    density,
    incremental,
    labels,
    logistic,
    metrics,
    models,
    observations,
    occupancy,
    presence,
    skew,
)
from occugrid.operators.cooccurrence import cooccurrence
from occugrid.operators.forest import ForestParams
from occugrid.plans import feature_build, modelling
from occugrid.sources import clustered, events, tables

Query = Callable[[SparkSession, str], DataFrame]

TOP_K = 50
N_SPLITS = 5
SCORED_K = TOP_K

PAIR_RATIOS = ("support_a", "support_b", "support_ab", "jaccard", "p_a_given_b", "lift")
SIX_METRICS = (
    "roc_auc_micro", "pr_auc_micro", "f1_micro", "roc_auc_macro", "pr_auc_macro", "f1_macro",
)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, 9) for name in names})


def joined_text(column: str):
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(column)


_PATHS: dict[tuple, str] = {}


def _file_state(spark: SparkSession, path: str) -> int:
    """A number that changes with the files of ``path``, their sizes or their times.

    The file system is asked, not the rows.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True)
    state = set()
    while files.hasNext():
        one = files.next()
        state.add((one.getPath().toString(), one.getLen(), one.getModificationTime()))
    return hash(frozenset(state))


def _written(
    spark: SparkSession, sf_dir: str, build: Query, schema: str
) -> DataFrame:
    """The table of ``build``, written once per application as a separate job would do."""
    state = _file_state(spark, f"{sf_dir}/events.parquet")
    key = (spark.sparkContext.applicationId, build.__name__, sf_dir, state)
    if key not in _PATHS:
        path = storage.new_table_path(spark, build.__name__)
        build(spark, sf_dir).write.parquet(path)
        _PATHS[key] = path
    return tables.read_table(spark, _PATHS[key], schema)


def build_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, extra = events.train_and_extra(spark, sf_dir)
    return feature_build.train_features(train, extra, events.taxa(spark, sf_dir))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, build_features, schemas.TRAIN_FEATURES)


def _stored_and_batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Features of the first source as stored, and those of the second as a batch that comes later."""
    train, extra = events.train_and_extra(spark, sf_dir)
    taxa = events.taxa(spark, sf_dir)
    later = extra.withColumn("row_id", F.col("row_id") + F.lit(observations.EXTRA_OFFSET))
    stored = storage.written_table(feature_build.train_features(train, taxa=taxa), "stored")
    return stored, feature_build.train_features(later, taxa=taxa)


def incremental_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored features and the new ones of the batch: the table that one build gives."""
    stored, batch = _stored_and_batch(spark, sf_dir)
    every = stored.unionByName(incremental.new_features(stored, batch))
    return rounded(every.drop("row_id"), "sin_lon", "cos_lon")


def incremental_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support from stored masks and a batch."""
    stored, batch = _stored_and_batch(spark, sf_dir)
    masks = storage.written_table(occupancy.occupancy(stored), "masks")
    return occupancy.species_support(incremental.merged_masks(masks, batch))


def _clustered(spark: SparkSession, sf_dir: str) -> str:
    """The feature table laid out by place and species, written once per application."""
    state = _file_state(spark, f"{sf_dir}/events.parquet")
    key = (spark.sparkContext.applicationId, "clustered", sf_dir, state)
    if key not in _PATHS:
        path = storage.new_table_path(spark, "clustered-features")
        _PATHS[key] = clustered.write_clustered(features(spark, sf_dir), path, rows_per_file=500)
    return _PATHS[key]


def one_species_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of one species, from the files that can hold it."""
    taxon = random_species(spark, sf_dir).first().taxon_id
    found = clustered.read_clustered(spark, _clustered(spark, sf_dir), schemas.TRAIN_FEATURES, taxa=[taxon])
    return rounded(found.drop("row_id"), "sin_lon", "cos_lon")


def one_tile_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the tile north east of 0, 0, from the files that can hold it."""
    tile = spark.range(1).select(clustered.tile_number(F.lit(0), F.lit(0))).first()[0]
    found = clustered.read_clustered(spark, _clustered(spark, sf_dir), schemas.TRAIN_FEATURES, tiles=[tile])
    return rounded(found.drop("row_id"), "sin_lon", "cos_lon")


def _support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occupancy.species_support(occupancy.occupancy(features(spark, sf_dir)))


def _top(spark: SparkSession, sf_dir: str, k: int = TOP_K) -> DataFrame:
    return occupancy.top_species(_support(spark, sf_dir), k)


def observation_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(build_features(spark, sf_dir).drop("row_id"), "sin_lon", "cos_lon")


def test_location_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = feature_build.test_features(events.test_locations(spark, sf_dir))
    return rounded(built, "sin_lon", "cos_lon")


def region_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    baskets = occupancy.region_baskets(features(spark, sf_dir))
    return baskets.select("region", joined_text("species_list"))


def top_species_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = labels.top_species_lists(
        occupancy.region_baskets(features(spark, sf_dir)), _top(spark, sf_dir)
    )
    return lists.filter(F.size("species_topk") > 0).select("region", joined_text("species_topk"))


def species_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occupancy.frequent_species(_support(spark, sf_dir), 10)


def species_name_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occupancy.species_names(features(spark, sf_dir))


def _pairs(min_species_support: int, min_pair_count: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pairs = cooccurrence(features(spark, sf_dir), min_species_support, min_pair_count)
        return rounded(pairs, *PAIR_RATIOS)

    return run


def top_k_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir)


def top_10_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, 10).select("label_rank", "taxon_id", "n_regions")


def region_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(occupancy.region_features(features(spark, sf_dir)), "sin_lon", "cos_lon")


def hemisphere_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.hemisphere_counts(features(spark, sf_dir))


def lat_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(density.histogram(features(spark, sf_dir), "lat"), "bin_start")


def lon_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(density.histogram(features(spark, sf_dir), "lon"), "bin_start")


def hexbin_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(density.hexbin(features(spark, sf_dir)), "lon", "lat")


def point_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.point_density(features(spark, sf_dir))


def _pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.point_pyramid(features(spark, sf_dir), finest=10, split_above=40)


def density_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pyramid(spark, sf_dir)


def density_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.fitting_cells(_pyramid(spark, sf_dir))


def observations_per_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.observations_per_species(events.observations(spark, sf_dir))


def observation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = density.observation_stats(
        events.observations(spark, sf_dir), events.taxa(spark, sf_dir)
    )
    return rounded(stats, "mean_per_species")


def dataset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.dataset_counts(features(spark, sf_dir))


def species_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presence.species_presence(
        events.test_presence(spark, sf_dir), events.test_locations(spark, sf_dir)
    )


def species_presence_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test locations without ids in several files; the lists hold their positions."""
    path = storage.new_table_path(spark, "locations")
    located = events.test_locations(spark, sf_dir).repartitionByRange(5, "loc_id")
    located.sortWithinPartitions("loc_id").drop("loc_id").write.parquet(path)
    return presence.species_presence(
        events.test_presence(spark, sf_dir), tables.read_test_locations(spark, path, by_position=True)
    )


def species_absence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presence.absence_counts(
        events.test_presence(spark, sf_dir), events.test_locations(spark, sf_dir)
    )


def random_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presence.random_species(events.taxa(spark, sf_dir))


def random_species_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presence.locations_of(
        events.test_presence(spark, sf_dir),
        events.test_locations(spark, sf_dir),
        random_species(spark, sf_dir),
    )


def one_species_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = events.observations(spark, sf_dir).drop("event_type")
    return presence.observations_of(every, random_species(spark, sf_dir))


def _prepared(
    spark: SparkSession, sf_dir: str, k: int, keep_unlabelled: bool, block_deg: int = 1
) -> models.Dataset:
    return modelling.dataset(features(spark, sf_dir), k, N_SPLITS, keep_unlabelled, block_deg)


def _dataset(keep_unlabelled: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        wide = _prepared(spark, sf_dir, TOP_K, keep_unlabelled).wide()
        return rounded(wide, "sin_lon", "cos_lon").select(
            "region", "grid_lat", "grid_lon", "sin_lon", "cos_lon", "hemisphere_S",
            "group_key", "fold", F.array_join(F.col("labels").cast("array<string>"), "").alias("labels"),
        )

    return run


def multilabel_matrix_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _prepared(spark, sf_dir, TOP_K, keep_unlabelled=True)
    return labels.with_taxa(data.grid(), data.top).select("region", "taxon_id", "label_rank", "y")


def category_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with the 0/1 columns of two categories, hemisphere and type of the first event."""
    every = observations.add_features(events.observations(spark, sf_dir))
    data = modelling.dataset(every, 10, N_SPLITS, True, categorical=("hemisphere", "event_type"))
    return data.rows.select("region", "event_type", *categories.one_hot_columns(data.categories))


def hot_species_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of observations of which one species has nine tenths, by a salted lookup."""
    every = events.observations(spark, sf_dir).select(
        "row_id", F.when(F.col("row_id") % 10 == 0, F.col("taxon_id")).otherwise(1001).alias("taxon_id")
    )
    heavy = skew.heavy_values(every, "taxon_id")
    return skew.salted_lookup(every, events.taxa(spark, sf_dir), ["taxon_id"], heavy, "row_id")


def _group_folds(block_deg: int) -> Query:
    """Folds of both populations: all regions, and those with a top species."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        parts = [
            _prepared(spark, sf_dir, TOP_K, keep, block_deg).rows.select(
                F.lit(name).alias("population"), "region", "group_key", "fold"
            )
            for name, keep in (("all", True), ("labelled", False))
        ]
        return parts[0].unionByName(parts[1])

    return run


def build_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic scores with many ties: every region x the top species."""
    data = _prepared(spark, sf_dir, SCORED_K, keep_unlabelled=True)
    spread = (F.abs("grid_lat") * 7 + F.abs("grid_lon") * 3 + F.col("taxon_id")) % 33
    p = spread / F.lit(64.0) + F.when(F.col("y") == 1, 0.25).otherwise(0.0)
    return labels.with_taxa(data.grid(), data.top).select(
        "fold", "region", "taxon_id", "label_rank", "y", p.alias("p"), (p > 0.5).cast("int").alias("yhat")
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, build_scores, schemas.SCORES)


def _confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(scores(spark, sf_dir), metrics.LABEL_KEYS)


def f1_micro_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.f1_per_fold(_confusion(spark, sf_dir)), "micro_f1", "macro_f1")


def f1_per_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_confusion(spark, sf_dir), "f1")


def _fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = scores(spark, sf_dir)
    return metrics.fold_metrics(every, metrics.label_metrics(every))


def ranking_micro_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [name for name in SIX_METRICS if not name.startswith("f1")]
    return rounded(_fold_metrics(spark, sf_dir).select("fold", *names), *names)


def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_label = metrics.label_metrics(scores(spark, sf_dir))
    return rounded(per_label.select("fold", "taxon_id", "roc_auc"), "roc_auc")


def ranking_of_close_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC and average precision of scores that all lie within a millionth."""
    close = scores(spark, sf_dir).withColumn("p", F.lit(0.5) + F.col("p") / 2**20)
    found = metrics.label_metrics(close).select("fold", "taxon_id", "roc_auc", "pr_auc")
    return rounded(found, "roc_auc", "pr_auc")


def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_label = metrics.label_metrics(scores(spark, sf_dir))
    return rounded(per_label.select("fold", "taxon_id", "pr_auc"), "pr_auc")


def fold_metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = metrics.fold_table(metrics.f1_per_fold(_confusion(spark, sf_dir)))
    return rounded(table, "micro_f1", "macro_f1")


def species_metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, table = modelling.species_to_location_tables(scores(spark, sf_dir))
    return rounded(table, "roc_auc", "pr_auc", "f1")


def cv_log_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run log of the score fixture, unfolded again."""
    log = metrics.cv_log(_fold_metrics(spark, sf_dir), SCORED_K, N_SPLITS, "lr", 42)
    return rounded(log.select("params.*", F.inline("folds")), *SIX_METRICS)


def loc2spec_cv_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = modelling.dataset(features(spark, sf_dir), TOP_K, N_SPLITS)
    return modelling.location_to_species_metrics(data, ForestParams())


def spec2loc_cv_metrics_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = modelling.dataset(features(spark, sf_dir), TOP_K, N_SPLITS, keep_unlabelled=True)
    held_out = storage.written_table(models.cross_validate(data, "lr"), "scores")
    return modelling.species_to_location_tables(held_out)[1]


def spec2loc_cv_metrics_rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = modelling.dataset(features(spark, sf_dir), TOP_K, N_SPLITS, keep_unlabelled=True)
    held_out = models.cross_validate(data, "rf", forest_params=ForestParams())
    return modelling.species_to_location_tables(held_out)[1]


def cv_log_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = modelling.dataset(features(spark, sf_dir), TOP_K, N_SPLITS, keep_unlabelled=True)
    held_out = storage.written_table(models.cross_validate(data, "lr"), "scores")
    per_fold = metrics.fold_metrics(held_out, metrics.label_metrics(held_out))
    return metrics.cv_log(per_fold, TOP_K, N_SPLITS, "lr", 42)


def _final_predictions(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = modelling.dataset(features(spark, sf_dir), TOP_K, N_SPLITS, keep_unlabelled=True)
        path = models.fit_final(
            data, storage.new_table_path(spark, "model"), kind, forest_params=ForestParams()
        )
        return models.predict(spark, path, data).drop("fold")

    return run


def out_of_fold_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region is scored once for each label, by models that did not see its fold."""
    data = _prepared(spark, sf_dir, TOP_K, keep_unlabelled=True)
    held_out = models.cross_validate(data, "lr")
    return held_out.where("p between 0 and 1").select("fold", "region", "taxon_id", "y")


def forest_out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the forests of all species, rare ones included: every region once for each, and
    the constant where the training rows of a fold have one class."""
    data = _prepared(spark, sf_dir, 10_000, keep_unlabelled=True)
    counts = logistic.class_counts(data.grid(), data.folds())
    one_class = F.array(
        *[
            F.struct(F.lit(fold).alias("fold"), F.lit(rank).alias("label_rank"))
            for (fold, rank), n in counts.items()
            if logistic.single_class(*n) is not None
        ]
    ).cast("array<struct<fold:int,label_rank:int>>")
    held_out = models.cross_validate(data, "rf", forest_params=ForestParams())
    constant = F.array_contains(one_class, F.struct("fold", "label_rank"))
    return held_out.where("p between 0 and 1 and yhat = int(p > 0.5)").select(
        "fold", "region", "taxon_id", "y", F.when(constant, F.col("p")).alias("constant")
    )


def logistic_optimality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows and positives of every fit, and whether the objective is flat there."""
    data = _prepared(spark, sf_dir, TOP_K, keep_unlabelled=True)
    grid = data.grid()
    fitted = logistic.fit(grid, data.feature_columns, data.folds())
    return logistic.optimality(grid, fitted, data.folds()).select(
        F.col("model_fold").alias("held_out"),
        "label_rank",
        F.col("n").cast("bigint").alias("n"),
        F.col("n_pos").cast("bigint").alias("n_pos"),
        (F.col("gradient") < 1e-6).alias("flat"),
    )


def location_predictions_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The saved models on the test locations, which have no labels."""
    data = _prepared(spark, sf_dir, TOP_K, keep_unlabelled=True)
    path = models.fit_final(data, storage.new_table_path(spark, "model"), "lr")
    located = feature_build.test_features(events.test_locations(spark, sf_dir))
    return models.predict_locations(spark, path, located)


def _gap_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of a fold whose rows have one class only for every fifth species."""
    gap = (F.col("fold") == 1) & (F.col("label_rank") % 5 == 0)
    lost = F.when(F.col("label_rank") % 2 == 0, F.col("y") == 1).otherwise(F.col("y") == 0)
    kept = storage.written_table(scores(spark, sf_dir).where(~(gap & lost)), "gap-scores")
    return storage.written_table(metrics.label_metrics(kept), "gap-metrics")


def species_metrics_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics per fold and species; undefined ones are null."""
    found = metrics.defined_only(_gap_metrics(spark, sf_dir))
    return rounded(found.select("fold", "taxon_id", "roc_auc", "pr_auc", "f1"), "roc_auc", "pr_auc", "f1")


def species_means_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over the folds in which a metric is defined."""
    return rounded(metrics.species_means(_gap_metrics(spark, sf_dir)), "roc_auc", "pr_auc", "f1")


def saved_model_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved models against themselves: scores of all regions by their labels and as locations."""
    data = _prepared(spark, sf_dir, TOP_K, keep_unlabelled=True)
    located = data.rows.select("region", "grid_lat", "grid_lon", "sin_lon", "cos_lon", "hemisphere")
    parts = []
    for kind in models.MODEL_KINDS:
        path = models.fit_final(
            data, storage.new_table_path(spark, "model"), kind, forest_params=ForestParams(num_trees=30)
        )
        by_label = models.predict(spark, path, data).select("region", "taxon_id", "p", "yhat")
        by_place = models.predict_locations(spark, path, located, "region").select(
            "region", "taxon_id", F.col("p").alias("q"), F.col("yhat").alias("z")
        )
        met = by_label.join(by_place, ["region", "taxon_id"], "full")
        same = (F.abs(F.col("p") - F.col("q")) < 1e-12) & (F.col("yhat") == F.col("z"))
        parts.append(
            met.agg(
                F.lit(kind).alias("model"),
                F.count("*").alias("n"),
                F.count_if(~F.coalesce(same, F.lit(False))).alias("n_different"),
            )
        )
    return parts[0].unionByName(parts[1])


QUERIES: dict[str, Query] = {
    "observation_features": observation_features,
    "test_location_features": test_location_features,
    "region_baskets": region_baskets,
    "top_species_lists": top_species_lists,
    "species_support": species_support,
    "species_name_map": species_name_map,
    "cooccurrence_pairs": _pairs(10, 20),
    "cooccurrence_pairs_low_threshold": _pairs(3, 3),
    "top_k_species": top_k_species,
    "top_10_species": top_10_species,
    "region_features": region_features,
    "hemisphere_counts": hemisphere_counts,
    "lat_histogram": lat_histogram,
    "lon_histogram": lon_histogram,
    "hexbin_density": hexbin_density,
    "point_density": point_density,
    "density_pyramid": density_pyramid,
    "density_cells": density_cells,
    "observations_per_species": observations_per_species,
    "observation_stats": observation_stats,
    "dataset_counts": dataset_counts,
    "species_presence": species_presence,
    "species_presence_by_position": species_presence_by_position,
    "species_absence_counts": species_absence_counts,
    "random_species": random_species,
    "random_species_locations": random_species_locations,
    "one_species_observations": one_species_observations,
    "incremental_features": incremental_features,
    "incremental_support": incremental_support,
    "one_species_features": one_species_features,
    "one_tile_features": one_tile_features,
    "loc2spec_dataset": _dataset(keep_unlabelled=False),
    "spec2loc_dataset": _dataset(keep_unlabelled=True),
    "multilabel_matrix_long": multilabel_matrix_long,
    "category_dataset": category_dataset,
    "hot_species_names": hot_species_names,
    "group_folds": _group_folds(1),
    "group_folds_5deg": _group_folds(5),
    "f1_micro_macro": f1_micro_macro,
    "f1_per_species": f1_per_species,
    "ranking_micro_macro": ranking_micro_macro,
    "roc_auc": roc_auc,
    "average_precision": average_precision,
    "ranking_of_close_scores": ranking_of_close_scores,
    "fold_metric_table": fold_metric_table,
    "species_metric_table": species_metric_table,
    "cv_log_folds": cv_log_folds,
    "loc2spec_cv_metrics": loc2spec_cv_metrics,
    "spec2loc_cv_metrics_lr": spec2loc_cv_metrics_lr,
    "spec2loc_cv_metrics_rf": spec2loc_cv_metrics_rf,
    "cv_log": cv_log_lr,
    "final_model_predictions_lr": _final_predictions("lr"),
    "final_model_predictions_rf": _final_predictions("rf"),
    "out_of_fold_labels": out_of_fold_labels,
    "forest_out_of_fold": forest_out_of_fold,
    "logistic_optimality": logistic_optimality,
    "species_metrics_with_gaps": species_metrics_with_gaps,
    "species_means_with_gaps": species_means_with_gaps,
    "saved_model_differences": saved_model_differences,
    "location_predictions_lr": location_predictions_lr,
}
