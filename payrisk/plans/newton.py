"""The linear classifier fitted to its optimum, with the equations that prove it.

The objective is that of ``models.fit_baseline``: weighted mean log loss plus half the penalty times the squared coefficients, without the
intercept. It is strictly convex, so the coefficients at which its gradient is zero are the only ones. Each Newton step is one
pass over the rows: loss, gradient and Gram matrix, a few hundred sums that are combined inside each task. The system of as
many equations as features is solved on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payrisk.plans import models
from payrisk.schemas import MODEL_FEATURES
from payrisk.session import store

MAX_STEPS, MAX_HALVINGS = 60, 30
# Largest component of the gradient at which the fit is done.
TOLERANCE = 1e-10


@dataclass(frozen=True)
class LinearFit:
    """Coefficients on filled, scaled features, the intercept last in ``weights``."""

    fills: dict[str, float]
    scaling: dict[str, models.Scaling]
    weights: np.ndarray
    gradient: np.ndarray
    penalty: float
    steps: int

    def score(self, df: DataFrame) -> DataFrame:
        """(transaction_id, is_fraud, score) of each row."""
        ready = models.scale(models.fill_missing(df, self.fills), self.scaling)
        return ready.select("transaction_id", "is_fraud", _probability(self.weights).alias("score"))


def _margin(weights: np.ndarray) -> Column:
    total = F.lit(float(weights[-1]))
    for feature, weight in zip(MODEL_FEATURES, weights):
        total = total + F.lit(float(weight)) * F.col(feature)
    return total


def _probability(weights: np.ndarray) -> Column:
    return 1 / (1 + F.exp(-_margin(weights)))


def _inputs() -> list[Column]:
    return [*[F.col(f) for f in MODEL_FEATURES], F.lit(1.0)]


def prepared(train: DataFrame) -> tuple[DataFrame, dict, dict]:
    """Filled, scaled, class-balanced training rows, stored once; with the fills and the scaling."""
    rows = models.with_balanced_weight(store(train, "newton-train"))
    fills = models.fill_values(rows)
    filled = models.fill_missing(rows, fills)
    scaling = models.scaling_values(filled)
    ready = models.scale(filled, scaling).select(*MODEL_FEATURES, F.col("is_fraud").cast("double").alias("is_fraud"), "weight")
    return store(ready, "newton-rows"), fills, scaling


def _derivatives(rows: DataFrame, weights: np.ndarray, penalty: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Objective, gradient and Hessian at some weights, by one pass.

    A task multiplies its batches as matrices and hands on one row of sums. (As column sums this would be hundreds of expressions that are
    compiled anew for the weights of every step.)
    """
    n = len(weights)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + n + n * n)
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            x, y, w = np.column_stack([*columns[: n - 1], np.ones(batch.num_rows)]), columns[n - 1], columns[n]
            m = x @ weights
            p = 1 / (1 + np.exp(-m))
            loss = np.maximum(m, 0) + np.log1p(np.exp(-np.abs(m))) - y * m
            total += np.concatenate([[w.sum(), w @ loss], x.T @ (w * (p - y)), ((x.T * (w * p * (1 - p))) @ x).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["slot", "part"])

    parts = rows.select(*MODEL_FEATURES, "is_fraud", "weight").mapInArrow(sums, "slot bigint, part double")
    # As many rows as there are sums, however many rows the table has.
    found = np.zeros(2 + n + n * n)
    for r in parts.groupBy("slot").agg(F.sum("part").alias("total")).collect():
        found[r["slot"]] = r["total"]
    values = found[2:] / found[0]
    shrunk = penalty * np.append(weights[:-1], 0.0)
    hessian = values[n:].reshape(n, n) + np.diag(np.append(np.full(n - 1, penalty), 0.0))
    return found[1] / found[0] + 0.5 * float(shrunk @ weights), values[:n] + shrunk, hessian


def fit_newton(train: DataFrame, penalty: float = models.LINEAR_PENALTY, tolerance: float = TOLERANCE) -> LinearFit:
    """The optimum of the baseline objective. A step that raises the objective is halved until it does not.

    Needs rows of both classes; a feature without deviation is 0 throughout and gets the coefficient 0.
    """
    rows, fills, scaling = prepared(train)
    weights = np.zeros(len(MODEL_FEATURES) + 1)
    value, gradient, hessian = _derivatives(rows, weights, penalty)
    steps = 0
    while np.abs(gradient).max() > tolerance and steps < MAX_STEPS:
        move, size = np.linalg.solve(hessian, gradient), 1.0
        for _ in range(MAX_HALVINGS):
            tried = weights - size * move
            found = _derivatives(rows, tried, penalty)
            if found[0] <= value + 1e-12:
                break
            size /= 2
        weights, (value, gradient, hessian) = tried, found
        steps += 1
    return LinearFit(fills, scaling, weights, gradient, penalty, steps)


def score_equations(fit: LinearFit, train: DataFrame, decimals: int = 6) -> DataFrame:
    """One row per feature and one for the intercept: (feature, moment).

    ``moment`` is the weighted mean of score times feature plus the penalty's share. At the optimum, and nowhere else, it equals the
    weighted mean of label times feature for every feature, which needs no model to compute.
    """
    rows = models.with_balanced_weight(store(train, "equations-train"))
    ready = models.scale(models.fill_missing(rows, fit.fills), fit.scaling).withColumn("_p", _probability(fit.weights))
    names = [*MODEL_FEATURES, "intercept"]
    shares = fit.penalty * np.append(fit.weights[:-1], 0.0)
    moments = [
        F.struct(
            F.lit(name).alias("feature"),
            F.round(F.sum(F.col("weight") * F.col("_p") * x) / F.sum("weight") + F.lit(float(share)), decimals).alias("moment"),
        )
        for name, x, share in zip(names, _inputs(), shares)
    ]
    return ready.agg(F.array(*moments).alias("rows")).select(F.inline("rows"))
