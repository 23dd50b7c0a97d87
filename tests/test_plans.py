"""The physical plans keep the properties the design relies on."""

import re

import pytest

from occugrid.operators import labels, metrics, occupancy, presence
from occugrid.operators.cooccurrence import cooccurrence
from occugrid.plans import catalog, oracle
from occugrid.sources import events


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan_of(df).split("Initial Plan")[0]


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_no_cross_join(spark, sf_dir, name):
    plan = plan_of(catalog.QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_occupancy_combines_before_its_only_shuffle(spark, sf_dir):
    plan = plan_of(occupancy.occupancy(catalog.features(spark, sf_dir)))
    assert plan.count("Exchange") == 1
    assert "partial_bit_or" in plan.split("Exchange")[1]
    assert re.search(r"ReadSchema: struct<taxon_id:bigint,grid_lat:bigint,grid_lon:bigint>", plan)


def test_pairs_compute_the_occupancy_once(spark, sf_dir):
    df = cooccurrence(catalog.features(spark, sf_dir), 3, 3)
    df.collect()
    plan = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "ReusedExchange" in plan


def test_dataset_is_one_hash_aggregation(spark, sf_dir):
    features = catalog.features(spark, sf_dir)
    top = occupancy.top_species(occupancy.species_support(occupancy.occupancy(features)), 50)
    plan = plan_of(labels.labelled_regions(features, top, 50, keep_unlabelled=False))
    upper = plan.split("BroadcastExchange")[0]
    assert "SortAggregate" not in upper and "ObjectHashAggregate" not in upper
    assert upper.count("Exchange hashpartitioning") == 1


def test_curves_never_use_a_single_partition(spark, sf_dir):
    for keys in (metrics.FOLD_KEYS, metrics.LABEL_KEYS):
        plan = plan_of(metrics.metrics_by(catalog.scores(spark, sf_dir), keys))
        assert "SinglePartition" not in plan


def test_locations_are_read_once(spark, sf_dir):
    marked = presence.locations_of(
        events.test_presence(spark, sf_dir),
        events.test_locations(spark, sf_dir),
        presence.random_species(events.taxa(spark, sf_dir)),
    )
    assert plan_of(marked).count("FileScan") == 3  # locations, presence lists, species
