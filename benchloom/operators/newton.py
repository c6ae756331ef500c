"""Linear classifiers by Newton steps: logistic regression, and a support vector machine with squared hinge loss.

For tables with a few numeric feature columns. Each step is one aggregate over the rows: the sums of gradient and
curvature are of fixed size, whatever the rows are, and only these reach the driver. Both objectives are convex with one
optimum, which both the weights found and other engines agree on. Wide sparse features are for `classify`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

# Sums of one step: the upper half of the curvature has this many at most.
MOST_FEATURES = 100


@dataclass
class Linear:
    """Weights by feature and a bias. `objective` is the mean loss with the penalty; `gap` bounds its distance from the optimum."""

    weights: dict[str, float]
    bias: float
    link: str
    objective: float
    steps: int
    rows: int
    gap: float | None = None

    def margin(self) -> Column:
        return sum((F.col(name) * weight for name, weight in self.weights.items()), F.lit(self.bias))

    def score(self, df: DataFrame) -> DataFrame:
        """Rows with margin and predicted class; under the logistic link with the probability of class 1 too. NULL features give NULLs."""
        out = df.withColumns({"margin": self.margin(), "predicted": (self.margin() > 0).cast("int")})
        return out.withColumn("probability", 1 / (1 + F.exp(-F.col("margin")))) if self.link == "logit" else out


def _names(features: list[str]) -> list[str]:
    return [f"x{k}" for k in range(len(features))]


def _margin(names: list[str], w: np.ndarray) -> Column:
    return sum((F.col(c) * float(x) for c, x in zip(names, w[:-1], strict=True)), F.lit(float(w[-1])))


def _logistic(z: Column, label: Column) -> tuple[Column, Column, Column]:
    """Loss, its slope and its curvature at margin z."""
    p = 1 / (1 + F.exp(-z))
    return F.greatest(z, F.lit(0.0)) - label * z + F.log1p(F.exp(-F.abs(z))), p - label, p * (1 - p)


def _squared_hinge(z: Column, label: Column) -> tuple[Column, Column, Column]:
    sign = 2 * label - 1
    short = F.greatest(F.lit(0.0), 1 - sign * z)
    return short * short, -2 * sign * short, F.when(short > 0, 2.0).otherwise(0.0)


def _sums(rows: DataFrame, names: list[str], w: np.ndarray, loss) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and curvature over all rows."""
    value, slope, curve = loss(F.col("margin"), F.col("label"))
    rows = rows.withColumn("margin", _margin(names, w)).withColumns({"loss": value, "slope": slope, "curve": curve})
    x = [*[F.col(c) for c in names], F.lit(1.0)]
    many = len(x)
    pairs = [(i, j) for i in range(many) for j in range(i, many)]
    row = rows.agg(
        F.sum("loss"), *[F.sum(F.col("slope") * c) for c in x], *[F.sum(F.col("curve") * x[i] * x[j]) for i, j in pairs],
    ).first()
    curvature = np.zeros((many, many))
    for (i, j), v in zip(pairs, row[many + 1:], strict=True):
        curvature[i, j] = curvature[j, i] = v
    return row[0], np.array(row[1:many + 1]), curvature


def _fit(df: DataFrame, label: str, features: list[str], loss, reg: float, steps: int, tol: float, penalized: np.ndarray):
    """Newton's method with halved steps where a whole one does not lower the objective."""
    if not 1 <= len(features) <= MOST_FEATURES:
        raise ValueError(f"between 1 and {MOST_FEATURES} features can be fitted")
    if reg <= 0:
        raise ValueError("without a penalty there may be no single optimum")
    # Names of their own, whatever the features are called.
    names = _names(features)
    rows = df.select(F.col(label).cast("double").alias("label"), *[F.col(c).cast("double").alias(x) for c, x in zip(features, names)]).dropna().persist()
    try:
        n = rows.count()
        if not n:
            raise ValueError("no row has a label and all features")
        penalty = reg * np.where(penalized, 1.0, 0.0)
        w = np.zeros(len(features) + 1)

        def at(w: np.ndarray):
            value, slope, curve = _sums(rows, names, w, loss)
            return value / n + 0.5 * float(penalty @ (w * w)), slope / n + penalty * w, curve / n + np.diag(penalty)

        value, slope, curve = at(w)
        for step in range(1, steps + 1):
            move = np.linalg.lstsq(curve, slope, rcond=None)[0]
            if float(slope @ move) <= tol:
                break
            share = 1.0
            while share > 1e-6:
                after = at(w - share * move)
                # Near the optimum the last digits of the sums decide no more.
                if after[0] <= value - 1e-4 * share * float(slope @ move) + 1e-13 * abs(value):
                    break
                share /= 2
            else:
                break
            w = w - share * move
            value, slope, curve = after
        return w, value, step, n, rows
    finally:
        rows.unpersist()


def fit_logistic(df: DataFrame, label: str, features: list[str], reg: float = 0.01, steps: int = 30, tol: float = 1e-24) -> Linear:
    """Logistic regression: least mean log loss + reg / 2 * |weights|^2; the bias has no penalty.

    Labels are 0 and 1. Rows with a NULL label or feature are left out; without any others, and without a penalty, there is an
    error. Ends when a step could lower the objective by less than about `tol`.
    """
    w, value, step, n, _ = _fit(df, label, features, _logistic, reg, steps, tol, np.arange(len(features) + 1) < len(features))
    return Linear(dict(zip(features, w[:-1].tolist(), strict=True)), float(w[-1]), "logit", value, step, n)


def fit_svm(df: DataFrame, label: str, features: list[str], reg: float = 0.01, steps: int = 50, tol: float = 1e-24) -> Linear:
    """Support vector machine: least mean squared hinge + reg / 2 * (|weights|^2 + bias^2), with its duality gap.

    With the shortfalls s = max(0, 1 - y * margin), a = 2 * s / n is feasible for the dual problem
    sum(a) - n / 4 * sum(a^2) - |sum(a * y * x)|^2 / (2 * reg), whose value is no larger than the optimum. So the objective is
    at most `gap` above it, however the weights were found. NULLs, labels and errors as in `fit_logistic`.
    """
    w, value, step, n, rows = _fit(df, label, features, _squared_hinge, reg, steps, tol, np.full(len(features) + 1, True))
    sign = 2 * F.col("label") - 1
    short = F.greatest(F.lit(0.0), 1 - sign * _margin(_names(features), w))
    row = rows.agg(F.sum(short), F.sum(short * short), *[F.sum(short * sign * F.col(c)) for c in _names(features)], F.sum(short * sign)).first()
    pull = 2 / n * np.array(row[2:])
    dual = 2 / n * row[0] - row[1] / n - float(pull @ pull) / (2 * reg)
    return Linear(dict(zip(features, w[:-1].tolist(), strict=True)), float(w[-1]), "none", value, step, n, value - dual)
