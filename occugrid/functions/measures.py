"""Association measures and classification scores as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def support(n: Column, total: Column) -> Column:
    return n / total


def jaccard(n_a: Column, n_b: Column, n_ab: Column) -> Column:
    return F.try_divide(n_ab, n_a + n_b - n_ab)


def lift(support_a: Column, support_b: Column, support_ab: Column) -> Column:
    """The quotient is kept in this order: rearranging it changes the last bits."""
    return F.try_divide(support_ab, support_a * support_b)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 with 0/0 = 0."""
    return F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0))
