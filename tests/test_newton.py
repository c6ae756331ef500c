from __future__ import annotations

import math
import random

import numpy as np
import pytest

from benchloom.operators import newton


def points(n=400, seed=1):
    """Labels that mostly follow a plane, with far outliers."""
    draw = random.Random(seed)
    rows = []
    for _ in range(n):
        a, b = draw.gauss(0, 1), draw.gauss(5, 3)
        rows.append((a, b, int(2 * a - 0.4 * b + 2 + draw.gauss(0, 1) > 0)))
    return [*rows, (40.0, 5.0, 0), (-30.0, 80.0, 1)]


def objective(rows, w, loss, reg, with_bias):
    x = np.array([(a, b, 1.0) for a, b, _ in rows])
    y = np.array([r[2] for r in rows])
    z = x @ w
    each = np.logaddexp(0, z) - y * z if loss == "log" else np.maximum(0, 1 - (2 * y - 1) * z) ** 2
    return each.mean() + reg / 2 * (w[:2] @ w[:2] + (w[2] ** 2 if with_bias else 0))


@pytest.mark.parametrize(("fit", "loss", "with_bias"), [(newton.fit_logistic, "log", False), (newton.fit_svm, "hinge", True)])
def test_no_near_weights_are_better(spark, fit, loss, with_bias):
    rows = points()
    model = fit(spark.createDataFrame(rows, "a double, b double, y int"), "y", ["a", "b"], reg=0.05)
    w = np.array([*model.weights.values(), model.bias])
    best = objective(rows, w, loss, 0.05, with_bias)
    assert math.isclose(best, model.objective, rel_tol=1e-12) and model.rows == len(rows)
    draw = np.random.default_rng(2)
    for size in (1e-1, 1e-3):
        assert all(objective(rows, w + size * draw.normal(size=3), loss, 0.05, with_bias) > best for _ in range(200))


def test_gap_certifies_the_optimum_and_only_that(spark):
    rows = spark.createDataFrame(points()[:-2], "a double, b double, y int")
    best, early = (newton.fit_svm(rows, "y", ["a", "b"], steps=n) for n in (50, 1))
    assert 0 <= best.gap < 1e-9 and early.gap > 1e-4
    assert 0 <= early.objective - best.objective <= early.gap


def test_steps_are_halved_where_whole_ones_overshoot(spark):
    """Nearly separable and far from the origin: whole steps from zero would swing."""
    rows = [(1000.0 + k, float(k % 7), int(k >= 30)) for k in range(60)]
    model = newton.fit_logistic(spark.createDataFrame(rows, "a double, b double, y int"), "y", ["a", "b"], reg=1e-4)
    assert sum((model.weights["a"] * a + model.weights["b"] * b + model.bias > 0) == bool(y) for a, b, y in rows) == 60


def test_nulls_clashing_names_and_errors(spark):
    rows = points(100)
    plain = newton.fit_logistic(spark.createDataFrame(rows, "a double, b double, y int"), "y", ["a", "b"])
    odd = spark.createDataFrame([*rows, (None, 1.0, 1), (1.0, None, 0), (1.0, 1.0, None)], "margin double, label double, x0 int")
    model = newton.fit_logistic(odd, "x0", ["margin", "label"])
    assert np.allclose([*plain.weights.values()], [*model.weights.values()]) and model.rows == len(rows)
    scored = plain.score(spark.createDataFrame([(1.0, 2.0), (None, 1.0)], "a double, b double")).collect()
    assert scored[0].predicted == int(scored[0].margin > 0) and math.isclose(scored[0].probability, 1 / (1 + math.exp(-scored[0].margin)))
    assert scored[1].margin is None
    for frame, features, reg in ((odd.limit(0), ["margin"], 0.1), (odd, [], 0.1), (odd, ["margin"], 0.0)):
        with pytest.raises(ValueError):
            newton.fit_logistic(frame, "x0", features, reg)
