import pytest
from pyspark.sql import functions as F

from occugrid.operators import labels, models, occupancy


def prepared(features, k, n_splits=2, keep=True):
    top = occupancy.top_species(occupancy.species_support(occupancy.occupancy(features)), k)
    return models.prepare(features, top, n_splits, keep)


def grid_records(n_species=70, seed=0):
    """Species s occurs in cell c iff s divides c + 1."""
    cells = [(lat, lon) for lat in range(-3, 5) for lon in range(-6, 9)]
    records = []
    for c, (lat, lon) in enumerate(cells, 1):
        records += [(len(records) + i, lat + 0.5, lon + 0.5, s)
                    for i, s in enumerate(s for s in range(1, n_species + 1) if c % s == 0)]
    return records


def test_labels_cross_the_word_boundary(make_features):
    data = prepared(make_features(grid_records()), 100)
    assert data.n_labels == 70
    truth = {(r.region, r.taxon_id) for r in make_features(grid_records()).collect()}
    grid = labels.with_taxa(data.grid(), data.top).collect()
    assert len(grid) == 120 * 70
    assert {(r.region, r.taxon_id) for r in grid if r.y} == truth
    taxa = [r.taxon_id for r in data.top.orderBy("label_rank").collect()]
    for row in data.wide().collect():
        assert [t for t, y in zip(taxa, row.labels) if y] == [t for t in taxa if (row.region, t) in truth]


def test_regions_without_a_top_species_are_kept_or_dropped(make_features):
    features = make_features([(0, 0.5, 0.5, 1), (1, 1.5, 0.5, 1), (2, 2.5, 0.5, 2)])
    assert prepared(features, 1, keep=True).rows.count() == 3
    assert {r.region for r in prepared(features, 1, keep=False).rows.collect()} == {"0°0°", "1°0°"}


def test_region_features_come_from_the_first_record(make_features):
    features = make_features([(5, 0.5, 0.75, 1), (2, 0.25, 0.25, 2), (9, 0.1, 0.0, 1), (10, 5.0, 5.0, 1)])
    first = features.filter(F.col("row_id") == 2).first()
    here = F.col("grid_lat") == 0
    for row in (
        prepared(features, 2).rows.filter(here).first(),
        occupancy.region_features(features).filter(here).first(),
    ):
        assert (row.sin_lon, row.cos_lon) == (first.sin_lon, first.cos_lon)


def test_one_hemisphere_leaves_the_column_out(make_features):
    north = [(0, 0.5, 0.5, 1), (1, 1.5, 0.5, 1)]
    assert prepared(make_features(north), 1).feature_columns == labels.NUMERIC_FEATURES
    both = prepared(make_features(north + [(2, -1.5, 0.5, 1)]), 1)
    assert both.feature_columns == labels.NUMERIC_FEATURES + ["hemisphere_S"]
    assert {(r.grid_lat, r.hemisphere_S) for r in both.rows.collect()} == {(0, 0), (1, 0), (-2, 1)}


@pytest.mark.parametrize("n_splits", [2, 5, 7])
def test_folds_are_dealt_in_descending_group_order(make_features, n_splits):
    rows = prepared(make_features(grid_records(5)), 5, n_splits).rows.collect()
    ordered = sorted(rows, key=lambda r: -r.group_key)
    assert [r.fold for r in ordered] == [i % n_splits + 1 for i in range(len(ordered))]
    sizes = [sum(r.fold == f for r in rows) for f in range(1, n_splits + 1)]
    assert max(sizes) - min(sizes) <= 1


def test_top_species_lists(make_features):
    features = make_features([(0, 0.5, 0.5, 3), (1, 0.5, 0.6, 1), (2, 1.5, 0.5, 3), (3, 2.5, 0.5, 9), (4, 2.5, 0.5, 3)])
    top = occupancy.top_species(occupancy.species_support(occupancy.occupancy(features)), 1)
    lists = labels.top_species_lists(occupancy.region_baskets(features), top).collect()
    assert {r.region: (r.species_list, r.species_topk) for r in lists} == {
        "0°0°": ([1, 3], [3]), "1°0°": ([3], [3]), "2°0°": ([3, 9], [3])
    }


@pytest.mark.parametrize("n_splits", [1, 3])
def test_more_folds_than_groups_is_refused(make_features, n_splits):
    features = make_features([(0, 0.5, 0.5, 1), (1, 1.5, 0.5, 1)])
    with pytest.raises(ValueError):
        prepared(features, 1, n_splits)


def test_blocks_of_one_degree_keep_the_folds(make_features):
    data = prepared(make_features(grid_records(9)), 100, 5)
    again = labels.assign_block_folds(data.rows.drop("fold"), 5)
    assert {(r.region, r.fold) for r in again.collect()} == {(r.region, r.fold) for r in data.rows.collect()}


def test_blocks_stay_together_and_folds_are_balanced(make_features):
    features = make_features(grid_records(9))
    top = occupancy.top_species(occupancy.species_support(occupancy.occupancy(features)), 100)
    rows = models.prepare(features, top, 3, True, block_deg=4).rows.collect()
    folds = {}
    for r in rows:
        folds.setdefault((r.grid_lat // 4, r.grid_lon // 4), set()).add(r.fold)
        assert r.group_key == (r.grid_lat // 4) * 1000 + r.grid_lon // 4
    assert all(len(one) == 1 for one in folds.values()) and len(folds) > 6
    loads = [sum(r.fold == k for r in rows) for k in (1, 2, 3)]
    assert max(loads) - min(loads) <= 16
    with pytest.raises(ValueError, match="cannot split"):
        models.prepare(features, top, 5, True, block_deg=90)
    with pytest.raises(ValueError, match="block_deg"):
        models.prepare(features, top, 5, True, block_deg=0)


def test_greedy_folds():
    sizes = [(1, 5), (2, 5), (3, 4), (4, 3), (5, 3), (6, 3), (-7, 1)]
    assert labels.balanced_folds(sizes, 3) == [(2, 1), (1, 2), (3, 3), (6, 3), (5, 1), (4, 2), (-7, 3)]
    assert labels.balanced_folds([], 3) == []
