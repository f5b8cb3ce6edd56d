"""The Newton fit is at the optimum, and the equations show it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from payrisk import fixtures as fx
from payrisk.plans import datasets, models, newton
from payrisk.schemas import MODEL_FEATURES
from payrisk.session import store


@pytest.fixture(scope="module")
def train(spark):
    matrix = store(fx.matrix(spark, "/root/testdata/sf0.01"), "matrix")
    return store(datasets.baseline_train(matrix, datasets.time_cutoffs(matrix)[1], "md5"), "train")


@pytest.fixture(scope="module")
def fit(train):
    return newton.fit_newton(train)


def plain(train, fit):
    rows = np.array([[np.nan if v is None else float(v) for v in r] for r in train.select(*MODEL_FEATURES, "is_fraud").collect()])
    x, y = rows[:, :-1].copy(), rows[:, -1]
    for k in range(x.shape[1]):
        known = x[~np.isnan(x[:, k]), k]
        x[np.isnan(x[:, k]), k] = np.median(known) if len(known) else 0.0
        deviation = x[:, k].std()
        x[:, k] = (x[:, k] - x[:, k].mean()) / deviation if deviation > 1e-12 else 0.0
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    return np.column_stack([x, np.ones(len(y))]), y, w


def test_gradient_is_zero(train, fit):
    x, y, w = plain(train, fit)
    p = 1 / (1 + np.exp(-x @ fit.weights))
    gradient = x.T @ (w * (p - y)) / w.sum() + fit.penalty * np.append(fit.weights[:-1], 0)
    assert np.abs(gradient).max() < 1e-8 and np.abs(fit.gradient).max() <= newton.TOLERANCE
    assert 2 <= fit.steps < 30


def test_no_other_weights_do_better(train, fit):
    x, y, w = plain(train, fit)

    def objective(b):
        m = x @ b
        return (w @ (np.logaddexp(0, m) - y * m)) / w.sum() + 0.5 * fit.penalty * (b[:-1] ** 2).sum()

    draw = np.random.default_rng(1)
    best = objective(fit.weights)
    assert all(objective(fit.weights + draw.normal(size=len(fit.weights)) * s) > best for s in (1e-3, 0.01, 0.1, 1) for _ in range(20))


def test_equations_hold_only_at_the_optimum(train, fit):
    x, y, w = plain(train, fit)
    want = dict(zip([*MODEL_FEATURES, "intercept"], x.T @ (w * y) / w.sum()))
    found = {r["feature"]: r["moment"] for r in newton.score_equations(fit, train).collect()}
    assert set(found) == set(want) and all(abs(found[f] - want[f]) < 2e-6 for f in want)
    off = newton.LinearFit(fit.fills, fit.scaling, fit.weights + 1e-3, fit.gradient, fit.penalty, 0)
    moved = {r["feature"]: r["moment"] for r in newton.score_equations(off, train).collect()}
    assert any(abs(moved[f] - want[f]) > 1e-5 for f in want)


def test_scores_agree_with_the_other_solver(train, fit):
    ours = fit.score(train).withColumnRenamed("score", "ours")
    theirs = models.score(models.fit_baseline(train), train).select(F.col("transaction_id").alias("_id"), "score")
    gap = ours.join(theirs, F.col("transaction_id") == F.col("_id")).agg(F.max(F.abs(F.col("ours") - F.col("score")))).first()[0]
    assert gap < 0.02


def test_a_feature_without_deviation(spark):
    draw = np.random.default_rng(3)
    rows = [(k, *[float(v) for v in draw.normal(size=len(MODEL_FEATURES) - 1)], None, int(draw.random() < 0.3)) for k in range(300)]
    schema = ", ".join(["transaction_id bigint", *[f"{f} double" for f in MODEL_FEATURES], "is_fraud bigint"])
    fit = newton.fit_newton(spark.createDataFrame(rows, schema))
    assert fit.weights[len(MODEL_FEATURES) - 1] == 0 and np.abs(fit.gradient).max() <= newton.TOLERANCE
