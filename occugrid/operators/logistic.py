"""Balanced, L2-penalised logistic regression for all folds and labels at once.

Objective per model, with the intercept as a penalised weight like every other:
``1/2 |w|^2 + sum_i c_i * log(1 + exp(-s_i * w.x_i))``, ``c_i = n / (2 * n_class)``, s = +-1.
It is minimised by damped Newton steps. One step for every model of a run is one aggregation
over the label table: loss, gradient and Hessian are plain sums, so the number of Spark jobs
does not depend on how many models there are. Only those sums (a few dozen numbers per model)
reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINAL = 0  # model of the whole table: no row has fold 0, so nothing is held out
SUFFICIENT_DECREASE = 1e-4
SMALLEST_STEP = 1e-10
# Relative loss that may be left when the search stops for rounding.
ROUNDING = 1e-9


@dataclass
class _State:
    """Progress of one model: last accepted weights and the step being tried."""

    weights: np.ndarray
    trial: np.ndarray
    loss: float = np.inf
    slope: float = 0.0
    direction: np.ndarray | None = None
    step: float = 1.0
    done: bool = False
    converged: bool = False


@dataclass
class LogisticModels:
    """Weights per (model_fold, label_rank); a one-class training set yields a constant."""

    feature_columns: list[str]
    weights: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    constants: dict[tuple[int, int], float] = field(default_factory=dict)

    def table(self, spark) -> DataFrame:
        names = [f"w_{name}" for name in ["intercept", *self.feature_columns]]
        rows = [(*key, None, *map(float, w)) for key, w in self.weights.items()]
        rows += [(*key, c, *[0.0] * len(names)) for key, c in self.constants.items()]
        return small_table(spark, rows, ["constant", *names])


def small_table(spark, rows: list[tuple], numbers: list[str]) -> DataFrame:
    """``(model_fold, label_rank, *numbers)`` as a local relation, a row per fold and label."""
    fields = [("model_fold", pa.int32()), ("label_rank", pa.int32())]
    schema = pa.schema(fields + [(name, pa.float64()) for name in numbers])
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [
        pa.array([], f.type) for f in schema
    ]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=schema))


def class_counts(grid: DataFrame, folds: Iterable[int]) -> dict[tuple[int, int], tuple[int, int]]:
    """Training rows and positives per (model_fold, label_rank); one row per fold and label."""
    counts = grid.groupBy("fold", "label_rank").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    per_cell = [(r["fold"], r["label_rank"], r["n"], r["pos"]) for r in counts.collect()]
    ranks = sorted({rank for _, rank, _, _ in per_cell})
    result = {}
    for fold in folds:
        for rank in ranks:
            used = [(n, pos) for f, r, n, pos in per_cell if r == rank and f != fold]
            result[fold, rank] = (sum(n for n, _ in used), sum(pos for _, pos in used))
    return result


def single_class(n: int, positives: int) -> float | None:
    """The constant to predict if a training set has only one class."""
    if positives == 0:
        return 0.0
    return 1.0 if positives == n else None


def _linear(names: list[str]) -> str:
    return " + ".join(["w_intercept", *[f"w_{name} * {name}" for name in names]])


def _sums(grid: DataFrame, trials: DataFrame, names: list[str]) -> dict:
    """Loss, gradient and upper Hessian of every trial point, in one pass over ``grid``.

    ``trials`` has one row per model still running (folds x labels), hence the broadcast.
    """
    inputs = ["1D", *names]
    size = len(inputs)
    upper = [(i, j) for i in range(size) for j in range(i, size)]
    sums = (
        grid.join(F.broadcast(trials), "label_rank")
        .where("fold <> model_fold")
        .selectExpr("*", f"{_linear(names)} AS z", "if(y = 1, cost_pos, cost_neg) AS cost")
        .selectExpr("*", "if(y = 1, z, -z) AS margin", "1D / (1D + exp(-z)) AS p")
        .selectExpr(
            "model_fold",
            "label_rank",
            *names,
            "cost * (greatest(-margin, 0D) + log1p(exp(-abs(margin)))) AS loss",
            "cost * (p - y) AS residual",
            "cost * p * (1D - p) AS curvature",
        )
        .groupBy("model_fold", "label_rank")
        .agg(
            F.expr("sum(loss) AS loss"),
            *[F.expr(f"sum(residual * {x}) AS g{i}") for i, x in enumerate(inputs)],
            *[
                F.expr(f"sum(curvature * {inputs[i]} * {inputs[j]}) AS h{i}_{j}")
                for i, j in upper
            ],
        )
    )
    result = {}
    for row in sums.collect():
        gradient = np.array([row[f"g{i}"] for i in range(size)])
        hessian = np.zeros((size, size))
        for i, j in upper:
            hessian[i, j] = hessian[j, i] = row[f"h{i}_{j}"]
        result[row["model_fold"], row["label_rank"]] = (row["loss"], gradient, hessian)
    return result


def _advance(state: _State, loss: float, gradient, hessian, tol: float) -> None:
    """Accept the trial point and plan the next Newton step, or shorten the step."""
    loss += 0.5 * state.trial @ state.trial
    if not loss <= state.loss + SUFFICIENT_DECREASE * state.step * state.slope:
        state.step /= 2
        state.done = state.step < SMALLEST_STEP
        # Rounding can stop the search next to the optimum.
        state.converged = state.done and -state.slope / 2 <= ROUNDING * max(1.0, state.loss)
    else:
        gradient = gradient + state.trial
        state.weights, state.loss, state.step = state.trial, loss, 1.0
        state.direction = -np.linalg.solve(hessian + np.eye(len(gradient)), gradient)
        state.slope = gradient @ state.direction
        # Half the squared Newton decrement bounds the loss still to be gained.
        state.done = state.converged = -state.slope / 2 <= tol * max(1.0, loss)
        if state.converged:
            # The step is known already, and this close it squares the error.
            state.weights = state.weights + state.direction
    state.trial = state.weights + state.step * state.direction


def fit(
    grid: DataFrame,
    feature_columns: list[str],
    folds: Iterable[int],
    max_iter: int = 200,
    tol: float = 1e-12,
) -> LogisticModels:
    """Fit one model per label for each entry of ``folds``, holding that fold out.

    ``grid`` is the label table (``fold, label_rank, y`` and the features); it is read once
    per step and should be a written table.
    """
    spark = grid.sparkSession
    names = list(feature_columns)
    models = LogisticModels(names)
    states, costs = {}, {}
    for key, (n, positives) in class_counts(grid, folds).items():
        constant = single_class(n, positives)
        if constant is not None:
            models.constants[key] = constant
            continue
        zero = np.zeros(len(names) + 1)
        states[key] = _State(weights=zero, trial=zero)
        costs[key] = (n / (2.0 * positives), n / (2.0 * (n - positives)))

    weight_names = [f"w_{name}" for name in ["intercept", *names]]
    for _ in range(max_iter):
        running = {key: state for key, state in states.items() if not state.done}
        if not running:
            break
        trials = small_table(
            spark,
            [(*key, *costs[key], *map(float, s.trial)) for key, s in running.items()],
            ["cost_pos", "cost_neg", *weight_names],
        )
        for key, sums in _sums(grid, trials, names).items():
            _advance(states[key], *sums, tol)
    stuck = sorted(key for key, state in states.items() if not state.converged)
    if stuck:
        raise RuntimeError(f"(fold, label) without a converged fit: {stuck[:10]}, {len(stuck)} in all")
    models.weights = {key: state.weights for key, state in states.items()}
    return models


def optimality(grid: DataFrame, models: LogisticModels, folds: Iterable[int]) -> DataFrame:
    """``(model_fold, label_rank, n, n_pos, gradient)`` of fitted models on their training rows.

    ``gradient`` is the largest slope of the objective in any weight; null for a constant.
    """
    counts = class_counts(grid, folds)
    weight_names = [f"w_{name}" for name in ["intercept", *models.feature_columns]]
    trials = small_table(
        grid.sparkSession,
        [
            (*key, counts[key][0] / (2.0 * counts[key][1]),
             counts[key][0] / (2.0 * (counts[key][0] - counts[key][1])), *map(float, weights))
            for key, weights in models.weights.items()
        ],
        ["cost_pos", "cost_neg", *weight_names],
    )
    slopes = {
        key: float(np.abs(gradient + models.weights[key]).max())
        for key, (_, gradient, _) in _sums(grid, trials, models.feature_columns).items()
    }
    rows = [(*key, float(n), float(pos), slopes.get(key)) for key, (n, pos) in counts.items()]
    return small_table(grid.sparkSession, rows, ["n", "n_pos", "gradient"])


def predict_rows(rows: DataFrame, models: DataFrame, feature_columns: list[str], keep: list[str]) -> DataFrame:
    """``keep`` with ``(label_rank, p, yhat)`` of every final model, for rows without labels."""
    n_labels = models.agg(F.max("label_rank") + 1).scalar()
    return (
        rows.withColumn("label_rank", F.explode(F.sequence(F.lit(0), n_labels - 1)))
        .join(F.broadcast(models.where(F.col("model_fold") == FINAL)), "label_rank")
        .selectExpr(*keep, "label_rank", "constant", f"{_linear(feature_columns)} AS z")
        .selectExpr(
            *keep,
            "label_rank",
            "coalesce(constant, 1D / (1D + exp(-z))) AS p",
            "CAST(coalesce(constant > 0, z > 0) AS INT) AS yhat",
        )
    )


def predict(grid: DataFrame, models: DataFrame, feature_columns: list[str]) -> DataFrame:
    """Score label rows with the model of their label; ``p`` = P(y = 1), ``yhat`` = 1 iff z > 0.

    Rows of a validation fold meet the model that held that fold out; the final model
    (``model_fold`` 0) meets every row.
    """
    return (
        grid.join(F.broadcast(models), "label_rank")
        .where(f"model_fold = fold OR model_fold = {FINAL}")
        .selectExpr("*", f"{_linear(feature_columns)} AS z")
        .selectExpr(
            "fold",
            "region",
            "label_rank",
            "y",
            "coalesce(constant, 1D / (1D + exp(-z))) AS p",
            "CAST(coalesce(constant > 0, z > 0) AS INT) AS yhat",
        )
    )
