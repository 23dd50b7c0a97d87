"""A batch on top of stored tables gives what one build over everything gives."""

import random

import pytest

from occugrid.operators import incremental, occupancy


def records(n, seed, first_id):
    rng = random.Random(seed)
    return [(first_id + i, rng.randrange(-40, 40) / 4, rng.randrange(-40, 40) / 4, rng.randrange(6)) for i in range(n)]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("max_words", [1, 16, 1 << 20])
def test_only_new_observations_are_added(make_features, max_words):
    old, batch = records(2000, 1, 0), records(900, 2, 10_000)
    batch += [(20_000 + i, *row[1:]) for i, row in enumerate(old[:300])] + [(30_000, 0.25, 0.25, 99), (30_001, 0.25, 0.25, 99)]
    stored, later = make_features(old), make_features(batch)
    both = stored.unionByName(incremental.new_features(stored, later, max_words))
    assert rows_of(both) == rows_of(make_features(old + batch))


def test_the_filter_lets_all_of_the_batch_and_little_else_pass(make_features):
    stored = make_features(records(4000, 3, 0))
    batch = stored.where("row_id % 20 = 0")
    passed = {tuple(r) for r in incremental.may_be_in(stored, batch).collect()}
    wanted = {(r.lat, r.lon, r.taxon_id) for r in batch.collect()}
    assert wanted <= passed and len(passed) < 1.3 * len(wanted) + 0.1 * stored.count()


def test_masks_of_stored_and_batch(make_features):
    old, batch = records(500, 4, 0), records(500, 5, 1000)
    masks = occupancy.occupancy(make_features(old))
    merged = incremental.merged_masks(masks, make_features(batch + old[:50]))
    assert rows_of(merged) == rows_of(occupancy.occupancy(make_features(old + batch)))


def test_empty_batch_and_empty_table(make_features):
    stored, none = make_features(records(50, 6, 0)), make_features(records(1, 6, 0)).limit(0)
    assert incremental.new_features(stored, none).collect() == []
    assert rows_of(incremental.new_features(none, stored)) == rows_of(stored)
    assert rows_of(incremental.merged_masks(occupancy.occupancy(none), stored)) == rows_of(occupancy.occupancy(stored))


def test_stored_observations_are_not_shuffled_whole(make_features):
    stored, batch = make_features(records(2000, 1, 0)), make_features(records(50, 2, 10_000))
    plan = incremental.may_be_in(stored.cache(), batch)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
