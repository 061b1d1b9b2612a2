"""Least squares by Adam, and the separating hyperplane made with it.

A model gives its value and the value's derivative by the score, as Columns and for numpy. Each step is one aggregate that
yields cost and gradient together, of rows that are written and cached once. With local=True equal rows are counted first,
and where few enough differ the same steps run on the driver in numpy.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import discard, materialise

#: Modulus of the hashes that draw batches.
PRIME = (1 << 31) - 1
#: Numbers in the different rows that local=True takes to the driver at most.
LOCAL_VALUES = 2_000_000


def score(weights: list[float], x: list[Column]) -> Column:
    """weights[0] + sum of weights[k + 1] * x[k]."""
    return sum((F.lit(float(w)) * c for w, c in zip(weights[1:], x)), F.lit(float(weights[0])))


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


@dataclass(frozen=True)
class Model:
    """value and the derivative of the value by the score, as Columns and for numpy."""

    value: Callable[[Column], Column]
    slope: Callable[[Column], Column]
    np_value: Callable[[np.ndarray], np.ndarray]
    np_slope: Callable[[np.ndarray], np.ndarray]


def _np_sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


LINEAR = Model(lambda z: z, lambda z: F.lit(1.0), lambda z: z, np.ones_like)
SIGMOID = Model(sigmoid, lambda z: sigmoid(z) * (1 - sigmoid(z)), _np_sigmoid, lambda z: _np_sigmoid(z) * (1 - _np_sigmoid(z)))


def cost_gradient(rows: DataFrame, weights: list[float], model: Model = SIGMOID, drawn: Column | None = None) -> DataFrame:
    """One row: cost, g0..gk. rows: y, x (array), w and, if equal rows are counted, n. With drawn, the gradient is that of the rows for which it is true."""
    x = [F.col("x")[k] for k in range(len(weights) - 1)]
    d = rows.withColumn("_z", score(weights, x))
    d = d.withColumns({"_f": model.value(F.col("_z")) - F.col("y"), "_s": model.slope(F.col("_z"))})
    w2 = F.col("w") * F.col("w") * F.col("n") if "n" in rows.columns else F.col("w") * F.col("w")
    part = F.lit(1.0) if drawn is None else F.when(drawn, 1.0).otherwise(0.0)
    return d.agg((0.5 * F.sum(w2 * F.col("_f") * F.col("_f"))).alias("cost"), *[F.sum(part * w2 * F.col("_f") * F.col("_s") * v).alias(f"g{k}") for k, v in enumerate([F.lit(1.0), *x])])


def adam(cost_and_gradient: Callable[[np.ndarray, int], tuple[float, np.ndarray]], start: np.ndarray, eps: float = 1e-6, alpha: float = 1e-3, b1: float = 0.9, b2: float = 0.999, epsilon: float = 1e-8, max_iterations: int = 10_000) -> tuple[np.ndarray, float, int]:
    """(weights, cost, steps). Ends when the cost changes by eps at most."""
    w, m, v = start.astype(float), np.zeros_like(start, float), np.zeros_like(start, float)
    before, step = None, 0
    while True:
        cost, g = cost_and_gradient(w, step)
        if step >= max_iterations or (before is not None and abs(cost - before) <= eps):
            return w, cost, step
        before, step = cost, step + 1
        m = b1 * m + (1 - b1) * g
        v = b2 * v + (1 - b2) * g * g
        w = w - alpha * (m / (1 - b1**step)) / (np.sqrt(v / (1 - b2**step)) + epsilon)


def draw(step: int) -> tuple[int, int]:
    """(a, b): at a step, a row's number is (a * its hash + b) mod PRIME, anew for each step."""
    a, b = np.random.default_rng(step).integers(1, PRIME, 2)
    return int(a), int(b)


def fit(rows: DataFrame, n_attributes: int, model: Model = SIGMOID, start: list[float] | None = None, batch_size: int | None = None, local: bool = False, local_values: int = LOCAL_VALUES, **options) -> tuple[np.ndarray, float, int]:
    """Fits rows (row_id, y, x, w). With batch_size, gradients come from about that many rows, drawn anew by hash of row_id at each
    step; the cost always from all. local=True counts equal rows and, if the different ones have local_values numbers at most,
    takes those to the driver, where the same rows are drawn and the same sums made; more of them stay where they are."""
    start = np.zeros(n_attributes + 1) if start is None else np.asarray(start, float)
    keyed = F.pmod(F.xxhash64("row_id"), F.lit(PRIME)).alias("_h") if batch_size else F.lit(0).alias("_h")
    rows = rows.select("y", "w", "x", keyed)
    if local:
        rows = rows.groupBy("y", "w", "x", "_h").agg(F.count("*").alias("n"))
    written = materialise(rows, "least-squares")
    if local and written.count() * (n_attributes + 4) <= local_values:
        t = written.toArrow()
        discard(written)
        counts = t["n"].to_numpy()
        n, y, w2, h = int(counts.sum()), t["y"].to_numpy(), t["w"].to_numpy() ** 2 * counts, t["_h"].to_numpy().astype(np.int64)
        x = np.column_stack([np.ones(t.num_rows), np.array(t["x"].to_pylist(), float).reshape(t.num_rows, n_attributes)])

        def here(w: np.ndarray, step: int) -> tuple[float, np.ndarray]:
            z = x @ w
            f = model.np_value(z) - y
            r = w2 * f * model.np_slope(z)
            pick = slice(None)
            if batch_size and batch_size < n:
                a, b = draw(step)
                pick = (a * h + b) % PRIME < PRIME * batch_size // n
            return 0.5 * float((w2 * f * f).sum()), x[pick].T @ r[pick]

        return adam(here, start, **options)
    cached = written.persist()
    n = cached.agg(F.sum("n")).first()[0] if local else cached.count()

    def spread(w: np.ndarray, step: int) -> tuple[float, np.ndarray]:
        drawn = None
        if batch_size and batch_size < n:
            a, b = draw(step)
            drawn = F.pmod(F.lit(a) * F.col("_h") + F.lit(b), F.lit(PRIME)) < PRIME * batch_size // n
        got = cost_gradient(cached, list(w), model, drawn).first()
        return got["cost"], np.array(got[1:], float)

    try:
        return adam(spread, start, **options)
    finally:
        cached.unpersist()
        discard(written)


def balanced(rows: DataFrame) -> DataFrame:
    """Weights scaled so that both classes have the same sum; both must be there."""
    s = rows.agg(F.sum("w").alias("all"), F.sum(F.when(F.col("y") == 1, F.col("w"))).alias("p"), F.sum(F.when(F.col("y") == 0, F.col("w"))).alias("n")).first()
    if not s["p"] or not s["n"]:
        raise ValueError("a class has no weight")
    return rows.withColumn("w", F.col("w") * F.when(F.col("y") == 1, s["all"] / s["p"]).otherwise(s["all"] / s["n"]))


def split(rows: DataFrame, n_attributes: int, balance: bool = False, **options) -> tuple[np.ndarray, float, int]:
    """The hyperplane w0 + w.x = 0 that separates the classes 0 and 1 best in the least-squares sense of the sigmoid."""
    rows = rows if "w" in rows.columns else rows.withColumn("w", F.lit(1.0))
    return fit(balanced(rows) if balance else rows, n_attributes, SIGMOID, **options)


def confusion(rows: DataFrame, weights: list[float]) -> DataFrame:
    """One row: tp, fp, np, nn, tpr, fpr, precision, accuracy of `score > 0` as class 1."""
    z = score(weights, [F.col("x")[k] for k in range(len(weights) - 1)])
    n = lambda c: F.sum(c.cast("long"))
    t = rows.agg(n((z > 0) & (F.col("y") == 1)).alias("tp"), n((z > 0) & (F.col("y") == 0)).alias("fp"), n(F.col("y") == 1).alias("np"), n(F.col("y") == 0).alias("nn"))
    return t.withColumns({"tpr": F.try_divide("tp", "np"), "fpr": F.try_divide("fp", "nn"), "precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "accuracy": F.try_divide(F.col("tp") + F.col("nn") - F.col("fp"), F.col("np") + F.col("nn"))})


def best_threshold(rows: DataFrame, criterion: str = "rates") -> DataFrame:
    """One row, cut and gain, for `score > cut` as class 1; rows: score, y (0 or 1).

    criterion: rates, the largest TPR - FPR; information, the least mean entropy of both sides (gain is minus that, in nats);
    mean, the middle of both classes' mean scores (gain is its TPR - FPR). Ties go to the least cut. No row comes out if a
    class is missing; rows with a null or NaN score or a null y count for nothing. Counts are summed for each score, ranges
    of scores are summed on their own, and only the ranges' totals meet in one window."""
    if criterion not in ("rates", "information", "mean"):
        raise ValueError(f"unknown criterion {criterion}")
    n = lambda k: F.sum((F.col("y") == k).cast("decimal(38,0)"))
    by_score = rows.filter("score IS NOT NULL AND NOT isnan(score) AND y IS NOT NULL").groupBy("score").agg(n(1).alias("p"), n(0).alias("q"))
    parts = materialise(by_score.repartitionByRange("score").withColumn("part", F.spark_partition_id()), "threshold-scores")
    total = lambda c: F.sum(c).cast("double")
    weighed = lambda c: F.try_divide(F.sum(F.col("score") * F.col(c).cast("double")), total(c))
    whole = parts.agg(total("p").alias("np"), total("q").alias("nq"), ((weighed("p") + weighed("q")) / 2).alias("mid")).first()
    n_p, n_q = F.lit(whole["np"] or None).cast("double"), F.lit(whole["nq"] or None).cast("double")
    if criterion == "mean":
        above = lambda c: F.sum(F.when(F.col("score") > F.lit(whole["mid"]), F.col(c)).otherwise(0)).cast("double")
        return parts.agg(F.lit(whole["mid"]).cast("double").alias("cut"), F.round(above("p") / n_p - above("q") / n_q, 12).alias("gain")).filter("gain IS NOT NULL")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("part").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    totals = totals.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).cast("decimal(38,0)").alias(f"{c}0") for c in ("p", "q")])
    upto = Window.partitionBy("part").orderBy("score")
    cum = parts.join(totals, "part").select("score", *[(F.sum(c).over(upto) + F.col(f"{c}0")).cast("double").alias(c) for c in ("p", "q")])
    if criterion == "rates":
        gain = F.col("q") / n_q - F.col("p") / n_p
    else:
        plogp = lambda a, b: F.when(a > 0, a * F.log(a / (a + b))).otherwise(0.0)
        p, q = F.col("p"), F.col("q")
        gain = (plogp(p, q) + plogp(q, p) + plogp(n_p - p, n_q - q) + plogp(n_q - q, n_p - p)) / (n_p + n_q)
    best = cum.select("score", F.round(gain, 12).alias("gain")).filter("gain IS NOT NULL")
    return best.agg(F.max_by("score", F.struct("gain", (-F.col("score")).alias("s"))).alias("cut"), F.max("gain").alias("gain")).filter("gain IS NOT NULL")
