"""Sampling-bias and density aggregates."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occugrid.storage import written_table


def point_density(points: DataFrame) -> DataFrame:
    """Observations per exact position."""
    return points.groupBy("lon", "lat").agg(F.count("*").alias("n"))


def point_pyramid(points: DataFrame, finest: int = 12, split_above: int = 1000) -> DataFrame:
    """Counts on a quad tree of cells: ``(level, x, y, quadkey, n, parent_n, shown)``.

    Level 0 is the globe as one cell; every cell has four children of half its width and height,
    ``quadkey`` names its ancestors by a digit 0 to 3 each. Only the finest level is counted from
    the observations, and combined before the shuffle; each coarser level adds up the at most four
    children of the next finer one. So every level sums to all observations, and cells without
    any are left out.

    ``shown`` marks the cells that together cover each observation once at a fitting grain: a cell
    is split where it holds more than ``split_above``, down to the finest level. Null coordinates
    count nowhere; the upper edges belong to the last cell.
    """
    last = F.lit((1 << finest) - 1).cast("long")

    def cell(coordinate: str, low: float, width: float) -> Column:
        inside = F.floor((F.col(coordinate) - low) / width * (1 << finest))
        return F.least(F.greatest(inside, F.lit(0).cast("long")), last)

    counted = (
        points.where(F.col("lon").isNotNull() & F.col("lat").isNotNull())
        .groupBy(cell("lon", -180.0, 360.0).alias("x"), cell("lat", -90.0, 180.0).alias("y"))
        .agg(F.count("*").alias("n"))
    )
    cells = written_table(counted, "finest-cells")
    levels = []
    for level in range(finest, 0, -1):
        parents = cells.groupBy(F.shiftright("x", 1).alias("px"), F.shiftright("y", 1).alias("py")).agg(
            F.sum("n").alias("parent_n"), F.collect_list(F.struct("x", "y", "n")).alias("children")
        )
        # The next level and this one read the same written parents.
        parents = written_table(parents, f"cells-{level - 1}")
        levels.append(parents.select(F.lit(level).alias("level"), F.inline("children"), "parent_n"))
        cells = parents.select(F.col("px").alias("x"), F.col("py").alias("y"), F.col("parent_n").alias("n"))
    levels.append(
        cells.select(F.lit(0).alias("level"), "x", "y", "n", F.lit(None).cast("long").alias("parent_n"))
    )
    pyramid = reduce(DataFrame.unionByName, levels)
    bits = F.sequence(F.lit(1), F.col("level"))
    digit = lambda i: (
        F.getbit("x", F.col("level") - i) + 2 * F.getbit("y", F.col("level") - i)
    ).cast("string")
    split = F.coalesce(F.col("parent_n") > split_above, F.lit(True))
    return pyramid.select(
        "level",
        "x",
        "y",
        F.when(F.col("level") == 0, "").otherwise(F.array_join(F.transform(bits, digit), "")).alias("quadkey"),
        "n",
        "parent_n",
        (split & ((F.col("n") <= split_above) | (F.col("level") == finest))).alias("shown"),
    )


def fitting_cells(pyramid: DataFrame) -> DataFrame:
    """``(quadkey, level, n, west, south, width, height)`` of the shown cells, in degrees."""
    width, height = 360.0 / F.pow(2.0, F.col("level")), 180.0 / F.pow(2.0, F.col("level"))
    return pyramid.where("shown").select(
        "quadkey",
        "level",
        "n",
        (F.col("x") * width - 180.0).alias("west"),
        (F.col("y") * height - 90.0).alias("south"),
        width.alias("width"),
        height.alias("height"),
    )


def hemisphere_counts(features: DataFrame) -> DataFrame:
    return features.groupBy("hemisphere").agg(F.count("*").alias("n"))


def histogram(points: DataFrame, column: str, bins: int = 60) -> DataFrame:
    """Equal-width bins over [min, max], last bin closed, empty bins as 0.

    A constant column gets the range [value - 0.5, value + 0.5], an empty one [0, 1].
    The quotient may round across an edge, so each value is checked against its bin's edges.
    """
    flat = F.min(column) == F.max(column)
    span = points.agg(
        F.struct(
            F.coalesce(F.when(flat, F.min(column) - 0.5).otherwise(F.min(column)), F.lit(0.0)).alias("lo"),
            F.coalesce(F.when(flat, F.max(column) + 0.5).otherwise(F.max(column)), F.lit(1.0)).alias("hi"),
        )
    ).scalar()
    lo, hi = span["lo"], span["hi"]

    def edge(index: Column) -> Column:
        return index * ((hi - lo) / bins) + lo

    value, guess = F.col(column), F.col("guess")
    last = F.lit(bins - 1).cast("bigint")
    guessed = points.select(
        value, F.least(F.floor((value - lo) / (hi - lo) * bins), last).alias("guess")
    )
    exact = (
        F.when(value < edge(guess), guess - 1)
        .when((guess < last) & (value >= edge(guess + 1)), guess + 1)
        .otherwise(guess)
    )
    counts = (
        guessed.filter(value.isNotNull())
        .groupBy(exact.alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    return (
        points.sparkSession.range(bins)
        .withColumnRenamed("id", "bin")
        .join(counts, "bin", "left")
        .select(
            "bin",
            edge(F.col("bin")).alias("bin_start"),
            F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
        )
    )


def _widened(low: Column, high: Column) -> tuple[Column, Column]:
    """A range without extent is opened by a tenth of its value (0.1 around zero)."""
    singular = high - low <= F.greatest(F.abs(low), F.abs(high)) * 1e-15

    def margin(end: Column) -> Column:
        return F.when((low == 0) & (high == 0), 0.1).otherwise(F.abs(end) * 0.1)

    return (
        F.when(singular, low - margin(low)).otherwise(low),
        F.when(singular, high + margin(high)).otherwise(high),
    )


def hexbin(points: DataFrame, gridsize: int = 80, mincnt: int = 1) -> DataFrame:
    """Counts on a hexagonal grid, ``gridsize`` cells wide, cells below ``mincnt`` left out.

    Two rectangular lattices, shifted by half a cell, cover the plane with hexagons: a point
    belongs to the nearer of its two lattice candidates. ``i`` and ``j`` index the lattice.
    """
    nx, ny = gridsize, int(gridsize / math.sqrt(3))
    xmin, xmax = _widened(F.min("lon"), F.max("lon"))
    ymin, ymax = _widened(F.min("lat"), F.max("lat"))
    box = points.agg(
        F.struct(
            xmin.alias("xmin"), xmax.alias("xmax"), ymin.alias("ymin"), ymax.alias("ymax")
        )
    ).scalar()
    padding = (box["xmax"] - box["xmin"]) * 1e-9
    left = box["xmin"] - padding
    width = (box["xmax"] + padding - left) / nx
    height = (box["ymax"] - box["ymin"]) / ny

    def squared_distance(i: Column, j: Column) -> Column:
        dx, dy = F.col("x") - i, F.col("y") - j
        return dx * dx + 3.0 * dy * dy

    scaled = points.select(
        ((F.col("lon") - left) / width).alias("x"),
        ((F.col("lat") - box["ymin"]) / height).alias("y"),
    )
    nearer_first = squared_distance(F.rint("x"), F.rint("y")) < squared_distance(
        F.floor("x") + 0.5, F.floor("y") + 0.5
    )
    cells = scaled.select(
        F.when(nearer_first, 1).otherwise(2).alias("lattice"),
        F.when(nearer_first, F.rint("x")).otherwise(F.floor("x")).cast("bigint").alias("i"),
        F.when(nearer_first, F.rint("y")).otherwise(F.floor("y")).cast("bigint").alias("j"),
    )
    shift = F.when(F.col("lattice") == 2, 0.5).otherwise(0.0)
    return (
        cells.groupBy("lattice", "i", "j")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= mincnt)
        .select(
            "lattice",
            "i",
            "j",
            (left + (F.col("i") + shift) * width).alias("lon"),
            (box["ymin"] + (F.col("j") + shift) * height).alias("lat"),
            "n",
        )
    )


def observations_per_species(observations: DataFrame) -> DataFrame:
    return observations.groupBy("taxon_id").agg(F.count("*").alias("n"))


def observation_stats(observations: DataFrame, taxa: DataFrame) -> DataFrame:
    """One row: species in the dimension, observations, and mean / min / max per species."""
    return observations_per_species(observations).agg(
        taxa.agg(F.count_distinct("taxon_id")).scalar().alias("n_species"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_observations"),
        F.avg("n").alias("mean_per_species"),
        F.min("n").alias("min_per_species"),
        F.max("n").alias("max_per_species"),
    )


def dataset_counts(features: DataFrame) -> DataFrame:
    """One row: observations, regions and species of a feature table."""
    cells = features.groupBy("grid_lat", "grid_lon").agg(F.count("*").alias("n"))
    species = features.groupBy("taxon_id").agg(F.count("*").alias("n"))
    return cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_observations"),
        F.count("*").alias("n_regions"),
        species.agg(F.count("*")).scalar().alias("n_species"),
    )
