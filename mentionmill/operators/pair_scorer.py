"""A logistic scorer of mention pairs, fitted by Newton steps on sums that Spark makes.

A step is one pass over the rows: gradient, Hessian and losses are sums of column
expressions, combined on the map side, so the driver gets one row of
(d + 1) (d + 4) / 2 + 3 numbers for d features, and solves d + 1 equations.  Rows
of a held-out split only give their loss: when it has not fallen for ``patience``
steps the fit ends, and the weights with the least held-out loss are returned.

The sums may also come from elsewhere (``fit_sums``): ``arrow_sums`` makes them of an Arrow
table of rows, so rows that tasks can make again need not be rows of Spark, nor be stored.

Rows whose label or a feature is null or NaN teach nothing and get a null score.
Without rows all weights are 0.  Order and partitions change sums only in their
last digits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .filters import running_sums

STEPS, RIDGE, PATIENCE, LEAST_FALL = 25, 1e-3, 2, 1e-9


def _inputs(features: list[str]) -> list[Column]:
    return [F.lit(1.0), *[F.nanvl(F.col(f).cast("double"), F.lit(None)) for f in features]]


def probability(weights: np.ndarray, features: list[str]) -> Column:
    """The scorer as a column expression; ``weights`` begin with the constant's."""
    z = F.lit(0.0)
    for w, x in zip(weights.tolist(), _inputs(features)):
        z = z + F.lit(w) * x
    return F.when(z.isNotNull(), 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z)))))  # least and greatest pass nulls over


def _upper(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i, d)]


def fit(rows: DataFrame, features: list[str], label: str = "label", held: str | None = None, steps: int = STEPS, ridge: float = RIDGE, patience: int = PATIENCE) -> np.ndarray:
    """Weights (constant first) with the least mean logistic loss plus ``ridge`` / 2 times their squares; ``held`` names a boolean column."""
    x, d = _inputs(features), len(features) + 1
    whole = F.col(label).isNotNull()
    for c in x[1:]:
        whole = whole & c.isNotNull()
    known = rows.where(whole)
    y = F.col(label).cast("double")
    out = F.coalesce(F.col(held), F.lit(False)) if held else F.lit(False)

    def sums(w: np.ndarray) -> dict[str, float]:
        p = probability(w, features)
        own = lambda c: F.sum(F.when(~out, c))
        loss = -(y * F.log(p) + (1 - y) * F.log(1 - p))
        return known.agg(
            *[own((p - y) * x[i]).alias(f"g{i}") for i in range(d)], *[own(p * (1 - p) * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in _upper(d)],
            F.count_if(~out).alias("n"), own(loss).alias("loss"), F.count_if(out).alias("n_held"), F.sum(F.when(out, loss)).alias("loss_held"),
        ).first().asDict()

    return fit_sums(sums, d, steps, ridge, patience)


def fit_sums(sums, d: int, steps: int = STEPS, ridge: float = RIDGE, patience: int = PATIENCE) -> np.ndarray:
    """``fit`` from a function that gives the sums of all rows at d weights (``SUMS`` of d)."""
    w, best, least, since = np.zeros(d), np.zeros(d), np.inf, 0
    for _ in range(steps):
        s = sums(w)
        if not s["n"]:
            return best
        now = s["loss_held"] / s["n_held"] if s["n_held"] else s["loss"] / s["n"] + ridge / 2 * float(w @ w)
        if now < least - LEAST_FALL:
            best, least, since = w.copy(), now, 0
        else:
            since += 1
            if since >= patience:
                break
        hessian = np.zeros((d, d))
        for i, j in _upper(d):
            hessian[i, j] = hessian[j, i] = s[f"h{i}_{j}"] / s["n"]
        gradient = np.array([s[f"g{i}"] for i in range(d)]) / s["n"] + ridge * w
        w = w - np.linalg.solve(hessian + ridge * np.eye(d), gradient)
    return best


def SUMS(d: int) -> list[str]:
    """Names of the sums of d weights, all doubles."""
    return [*(f"g{i}" for i in range(d)), *(f"h{i}_{j}" for i, j in _upper(d)), "n", "loss", "n_held", "loss_held"]


def _arrays(t: pa.Table, features: list[str], label: str) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Inputs (a row for each weight) and labels of the rows that teach, and which these are (None: all)."""
    plain = lambda c: t[c].combine_chunks().to_numpy(zero_copy_only=False).astype(float, copy=False)
    x, y = np.stack([np.ones(len(t)), *map(plain, features)]), plain(label)
    if not np.isnan(x.sum() + y.sum()):
        return x, y, None
    known = ~(np.isnan(x).any(0) | np.isnan(y))
    return x[:, known], y[known], known


def _linear(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.clip(w @ x, -30.0, 30.0)


def arrow_sums(t: pa.Table, w: np.ndarray, features: list[str], label: str = "label", held: str | None = None) -> pa.Table:
    """The sums of the rows of a table, as one row."""
    d = len(features) + 1
    x, y, known = _arrays(t, features, label)
    out = pc.fill_null(t[held], False).combine_chunks().to_numpy(zero_copy_only=False) if held else np.zeros(len(t), bool)
    out = out if known is None else out[known]
    z = _linear(w, x)
    e = np.exp(-z)
    loss = z + np.log1p(e) - y * z
    n_held, lost = int(out.sum()), float(loss[out].sum())
    row = [0.0] * len(SUMS(d))
    if n_held < len(y):
        if n_held:
            x, y, e, loss = x[:, ~out], y[~out], e[~out], loss[~out]
        p = 1 / (1 + e)
        hessian = (x * (p * (1 - p))) @ x.T
        row = [*(x @ (p - y)), *(hessian[i, j] for i, j in _upper(d)), len(y), loss.sum()]
    row = [*row[: len(SUMS(d)) - 2], n_held, lost]
    return pa.table({k: pa.array([float(v)]) for k, v in zip(SUMS(d), row)})


def arrow_counts(t: pa.Table, w: np.ndarray, features: list[str], label: str = "label", places: int = 4) -> pa.Table:
    """``score, pos, neg``: how many rows of either label have each score, rounded to ``places``."""
    x, y, _ = _arrays(t, features, label)
    score, at = np.unique(np.floor(10**places / (1 + np.exp(-_linear(w, x))) + 0.5), return_inverse=True)
    count = lambda k: pa.array(np.bincount(at, y == k, len(score)).astype(np.int64))
    return pa.table({"score": pa.array(score / 10**places), "pos": count(1), "neg": count(0)})


def best_f1_threshold(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """``threshold, f1`` with the best F1 among all distinct scores; the largest threshold among equals."""
    known = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    return best_f1_of_counts(known.groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")))


def best_f1_of_counts(counts: DataFrame) -> DataFrame:
    """The same from ``score, pos, neg``, a row or several for each score."""
    per = counts.groupBy(F.col("score").alias("threshold")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    sweep = running_sums(per, F.col("threshold").desc(), ["pos", "neg"]).crossJoin(per.agg(F.sum("pos").alias("all")))  # one row
    f1 = F.coalesce(F.try_divide(2.0 * F.col("pos"), F.col("pos") + F.col("neg") + F.col("all")), F.lit(0.0))
    return sweep.select("threshold", f1.alias("f1")).agg(F.max_by("threshold", F.struct("f1", "threshold")).alias("threshold"), F.max("f1").alias("f1")).where("threshold is not null")
