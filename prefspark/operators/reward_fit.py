"""U4: linear Bradley-Terry reward models, one for each attribute, by Newton's method.

The loss of an attribute is the weighted mean of -log sigmoid(r(chosen) - r(rejected) - margin)
with r(x) = w . x, plus ``center`` times the mean of (r(chosen) + r(rejected))^2, plus
``reg`` / 2 times |w|^2. One scan of a narrow table gives loss, gradient and Hessian of
all attributes as sums (Spark's partial aggregation, no Python on the executors); the
driver solves one small system for each attribute and never sees a row of data.
What it holds grows with attributes times features squared.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.functions.core import log_sigmoid, sigmoid
from prefspark.session import materialize


@dataclass
class Fitted:
    """An attribute's weights and how they were found."""

    weights: np.ndarray
    loss: float
    steps: int
    converged: bool
    n_pairs: int


def _narrow(pairs: DataFrame, features: Sequence[str], by: str, weight: str | None, margin: str | None) -> DataFrame:
    """(attribute, weight, margin, d features, s features): differences and sums; rows with a null or NaN are left out."""
    f = lambda c: F.col(f"`{c}`").cast("double")
    cols = [F.col(f"`{by}`").alias("attribute"), (f(weight) if weight else F.lit(1.0)).alias("w"), (f(margin) if margin else F.lit(0.0)).alias("m")]
    cols += [(f(f"chosen_{c}") - f(f"rejected_{c}")).alias(f"d{i}") for i, c in enumerate(features)]
    cols += [(f(f"chosen_{c}") + f(f"rejected_{c}")).alias(f"s{i}") for i, c in enumerate(features)]
    x = pairs.select(*cols)
    whole = F.lit(True)
    for c in x.columns[1:]:
        whole = whole & F.col(c).isNotNull() & ~F.isnan(c)
    return x.where(whole & F.col("attribute").isNotNull())


def _dot(weights: dict[str, np.ndarray], prefix: str, k: int) -> Column:
    """w(attribute) . columns; the weights are literals, a few for each attribute."""
    out = F.lit(0.0)
    for name, w in weights.items():
        own = F.lit(0.0)
        for i in range(k):
            own = own + F.lit(float(w[i])) * F.col(f"{prefix}{i}")
        out = F.when(F.col("attribute") == name, own).otherwise(out)
    return out


def _sums(x: DataFrame, weights: dict[str, np.ndarray], k: int) -> dict[str, dict[str, float]]:
    """One scan: per attribute the loss, its gradient and its Hessian as sums."""
    x = x.withColumn("z", _dot(weights, "d", k) - F.col("m")).withColumn("c", _dot(weights, "s", k))
    x = x.withColumn("p", sigmoid(F.col("z")))
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("w").alias("sw"), F.sum(-F.col("w") * log_sigmoid(F.col("z"))).alias("loss"), F.sum(F.col("c") * F.col("c")).alias("centre")]
    slope, bend = -F.col("w") * (1 - F.col("p")), F.col("w") * F.col("p") * (1 - F.col("p"))
    for i in range(k):
        aggs += [F.sum(slope * F.col(f"d{i}")).alias(f"g{i}"), F.sum(F.col("c") * F.col(f"s{i}")).alias(f"cg{i}")]
        for j in range(i, k):
            aggs += [F.sum(bend * F.col(f"d{i}") * F.col(f"d{j}")).alias(f"h{i}_{j}"), F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"ch{i}_{j}")]
    return {r["attribute"]: r.asDict() for r in x.groupBy("attribute").agg(*aggs).collect()}


def _system(r: dict[str, float], w: np.ndarray, reg: float, center: float) -> tuple[float, np.ndarray, np.ndarray]:
    k = len(w)
    loss = r["loss"] / r["sw"] + center * r["centre"] / r["n"] + reg / 2 * float(w @ w)
    grad = np.array([r[f"g{i}"] / r["sw"] + 2 * center * r[f"cg{i}"] / r["n"] for i in range(k)]) + reg * w
    hess = reg * np.eye(k)
    for i in range(k):
        for j in range(i, k):
            v = r[f"h{i}_{j}"] / r["sw"] + 2 * center * r[f"ch{i}_{j}"] / r["n"]
            hess[i, j] += v
            hess[j, i] = hess[i, j]
    return loss, grad, hess


def fit_reward_models(pairs: DataFrame, features: Sequence[str], by: str = "attribute", weight: str | None = None, margin: str | None = None,
                      reg: float = 0.0, center: float = 0.0, max_iter: int = 25, tol: float = 1e-12) -> dict[str, Fitted]:
    """A reward model for each value of ``by``, from ``chosen_<f>`` and ``rejected_<f>`` columns.

    A step that doesn't lower the loss is halved, so each attribute's loss falls in every scan
    that counts. An attribute is converged when its Newton step's decrement is below ``tol``;
    separable pairs without ``reg`` have no finite optimum and end unconverged at
    ``max_iter``. Rows with a null or NaN among attribute, weight, margin and features are left out;
    attributes whose weights sum to nothing keep weight 0. A singular system
    (a feature that never differs) is solved in the least-squares sense.
    """
    k = len(features)
    x = materialize(_narrow(pairs, features, by, weight, margin), "reward-fit")
    names = [r[0] for r in x.select("attribute").distinct().orderBy("attribute").collect()]
    w = {a: np.zeros(k) for a in names}
    out = {a: Fitted(w[a], float("nan"), 0, False, 0) for a in names}
    step: dict[str, np.ndarray] = {}
    best: dict[str, float] = {}
    open_ = set(names)
    for _ in range(max_iter + 1):
        if not open_:
            break
        sums = _sums(x.where(F.col("attribute").isin(sorted(open_))) if len(open_) < len(names) else x, {a: w[a] for a in sorted(open_)}, k)
        for a in sorted(open_):
            r, own = sums[a], out[a]
            own.n_pairs = r["n"]
            if not r["sw"]:
                open_.discard(a)
                continue
            loss, grad, hess = _system(r, w[a], reg, center)
            if a in step and not loss <= best[a] + 1e-15 * abs(best[a]):
                step[a] = step[a] / 2                       # back to half of the way
                w[a] = own.weights - step[a]
                continue
            best[a], own.loss, own.weights = loss, loss, w[a]
            own.steps += a in step
            move = np.linalg.lstsq(hess, grad, rcond=None)[0]
            if float(grad @ move) <= tol * max(1.0, abs(loss)):
                own.converged, own.weights = True, w[a] - move      # so near, the last step is exact to rounding
                open_.discard(a)
                continue
            step[a] = move
            w[a] = own.weights - move
    return out


def newton_steps(pairs: DataFrame, features: Sequence[str], steps: int, by: str = "attribute", weight: str | None = None, margin: str | None = None,
                 reg: float = 0.0, center: float = 0.0) -> DataFrame:
    """(attribute, feature, weight) after exactly ``steps`` undamped Newton steps from zero."""
    k, spark = len(features), pairs.sparkSession
    x = materialize(_narrow(pairs, features, by, weight, margin), "reward-fit")
    w: dict[str, np.ndarray] = {r[0]: np.zeros(k) for r in x.select("attribute").distinct().collect()}
    for _ in range(steps):
        for a, r in _sums(x, w, k).items():
            _, grad, hess = _system(r, w[a], reg, center)
            w[a] = w[a] - np.linalg.lstsq(hess, grad, rcond=None)[0]
    return spark.createDataFrame([(a, f, float(v)) for a in w for f, v in zip(features, w[a])], "attribute string, feature string, weight double")


def weights_table(spark, fitted: dict[str, Fitted], features: Sequence[str]) -> DataFrame:
    """(attribute, feature, weight, loss, steps, converged, n_pairs)."""
    rows = [(a, f, float(v), m.loss, m.steps, m.converged, m.n_pairs) for a, m in fitted.items() for f, v in zip(features, m.weights)]
    return spark.createDataFrame(rows, "attribute string, feature string, weight double, loss double, steps int, converged boolean, n_pairs long")


def model_scores(rows: DataFrame, fitted: dict[str, Fitted], features: Sequence[str], prefix: str = "", by: str = "attribute") -> Column:
    """r(x) of a row by its attribute's model (null for an attribute without one)."""
    out = F.lit(None).cast("double")
    for name, m in fitted.items():
        own = F.lit(0.0)
        for f, v in zip(features, m.weights):
            own = own + F.lit(float(v)) * F.col(f"`{prefix}{f}`")
        out = F.when(F.col(f"`{by}`") == name, own).otherwise(out)
    return out
