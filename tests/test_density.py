import math
import random
from collections import Counter

import numpy as np
import pytest

from occugrid.operators import density


@pytest.fixture
def points(spark):
    rng = random.Random(3)
    records = [(rng.gauss(0, 30), rng.gauss(10, 50)) for _ in range(500)]
    return records, spark.createDataFrame(records, "lat DOUBLE, lon DOUBLE")


def test_histogram_equals_numpy(points):
    records, frame = points
    counts, edges = np.histogram([lat for lat, _ in records], bins=60)
    rows = density.histogram(frame, "lat").orderBy("bin").collect()
    assert [r.n for r in rows] == counts.tolist()
    assert [r.bin_start for r in rows] == pytest.approx(edges[:-1].tolist())


@pytest.mark.parametrize("low, high, bins", [(-11, 12.75, 60), (-20, 147, 60), (0, 3, 60), (0.1, 0.7, 6)])
def test_values_on_bin_edges(spark, low, high, bins):
    values = [low + (high - low) * i / 600 for i in range(601)] + [low + i / 4 for i in range(int((high - low) * 4))]
    values += np.linspace(low, high, bins + 1).tolist()
    frame = spark.createDataFrame([(v,) for v in values], "x DOUBLE")
    rows = density.histogram(frame, "x", bins).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=bins)
    assert [r.n for r in rows] == counts.tolist()
    assert [r.bin_start for r in rows] == edges[:-1].tolist()


def test_histogram_without_rows(spark):
    rows = density.histogram(spark.createDataFrame([], "x DOUBLE"), "x", 4).orderBy("bin").collect()
    assert [(r.bin_start, r.n) for r in rows] == [(0.0, 0), (0.25, 0), (0.5, 0), (0.75, 0)]


def test_hexbin_of_one_position(spark):
    frame = spark.createDataFrame([(4.0, 0.0)] * 3, "lat DOUBLE, lon DOUBLE")
    (cell,) = density.hexbin(frame).collect()
    assert cell.n == 3
    assert (cell.lon, cell.lat) == pytest.approx((0.0, 4.0), abs=0.1)


def test_histogram_of_a_constant_is_widened(spark):
    frame = spark.createDataFrame([(2.0,)] * 3, "lat DOUBLE")
    rows = density.histogram(frame, "lat").orderBy("bin").collect()
    counts, edges = np.histogram([2.0] * 3, bins=60)
    assert [r.n for r in rows] == counts.tolist()
    assert rows[0].bin_start == edges[0] == 1.5


def hexagons(records, nx=80):
    ny = int(nx / math.sqrt(3))
    xs, ys = [x for _, x in records], [y for y, _ in records]
    pad = 1e-9 * (max(xs) - min(xs))
    x0, sx = min(xs) - pad, (max(xs) - min(xs) + 2 * pad) / nx
    y0, sy = min(ys), (max(ys) - min(ys)) / ny
    cells = Counter()
    for lat, lon in records:
        x, y = (lon - x0) / sx, (lat - y0) / sy
        near = (round(x), round(y))
        half = (math.floor(x), math.floor(y))
        d1 = (x - near[0]) ** 2 + 3 * (y - near[1]) ** 2
        d2 = (x - half[0] - 0.5) ** 2 + 3 * (y - half[1] - 0.5) ** 2
        cells[(1, *near) if d1 < d2 else (2, *half)] += 1
    return cells


def test_hexbin_equals_a_loop_and_counts_every_point(points):
    records, frame = points
    rows = density.hexbin(frame).collect()
    assert {(r.lattice, r.i, r.j): r.n for r in rows} == hexagons(records)
    assert sum(r.n for r in rows) == len(records)


def test_hexbin_min_count(points):
    records, frame = points
    rows = density.hexbin(frame, gridsize=10, mincnt=5).collect()
    assert {(r.lattice, r.i, r.j): r.n for r in rows} == {
        cell: n for cell, n in hexagons(records, 10).items() if n >= 5
    }


def test_counts(spark, make_features):
    features = make_features([(0, 1.0, 1.0, 1), (1, 1.0, 1.0, 2), (2, -1.0, 1.0, 1)])
    assert {(r.lon, r.lat): r.n for r in density.point_density(features).collect()} == {
        (1.0, 1.0): 2, (1.0, -1.0): 1
    }
    assert {r.hemisphere: r.n for r in density.hemisphere_counts(features).collect()} == {"N": 2, "S": 1}
    taxa = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "taxon_id BIGINT, taxon_name STRING")
    assert tuple(density.observation_stats(features, taxa).first()) == (3, 3, 1.5, 1, 2)
    assert tuple(density.dataset_counts(features).first()) == (3, 2, 2)


def grown(spark, records, **options):
    points = spark.createDataFrame(records, "lon double, lat double").repartition(3)
    return density.point_pyramid(points, **options)


def test_every_level_of_the_pyramid_sums_to_all_points(spark):
    records = [((i * 37 % 360) - 180.0, (i * 53 % 181) - 90.0) for i in range(500)]
    records += [(12.34, 56.78)] * 300 + [(180.0, 90.0), (-180.0, -90.0), (None, 1.0), (1.0, None)]
    pyramid = grown(spark, records, finest=6, split_above=25).collect()
    for level in range(7):
        cells = [r for r in pyramid if r.level == level]
        assert sum(r.n for r in cells) == 802 and len({(r.x, r.y) for r in cells}) == len(cells)
        assert all(len(r.quadkey) == level and 0 <= r.x < 2**level > r.y >= 0 for r in cells)
    by_key = {r.quadkey: r for r in pyramid}
    for r in pyramid:
        if r.level:
            parent = by_key[r.quadkey[:-1]]
            assert (parent.x, parent.y, parent.n) == (r.x >> 1, r.y >> 1, r.parent_n)
    shown = [r for r in pyramid if r.shown]
    assert sum(r.n for r in shown) == 802
    assert all(r.n <= 25 or r.level == 6 for r in shown)
    assert all(by_key[r.quadkey[:-1]].n > 25 for r in shown if r.level)
    assert not any(a.quadkey != b.quadkey and b.quadkey.startswith(a.quadkey) for a in shown for b in shown)


def test_cells_of_the_pyramid_hold_their_points(spark):
    records = [(10.5, 20.5), (10.6, 20.4), (-100.0, -45.0)]
    cells = density.fitting_cells(grown(spark, records, finest=8, split_above=1)).collect()
    for lon, lat in records:
        inside = [c for c in cells if c.west <= lon < c.west + c.width and c.south <= lat < c.south + c.height]
        assert len(inside) == 1
    assert sum(c.n for c in cells) == 3


def test_pyramid_without_points(spark):
    assert grown(spark, [], finest=3).collect() == []
    assert [(r.level, r.n, r.shown) for r in grown(spark, [(1.0, 2.0)], finest=0).collect()] == [(0, 1, True)]
