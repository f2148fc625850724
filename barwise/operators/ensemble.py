"""Ensembles over the predictions table.

Rows of one key ``(symbol, ts)`` are the models' predictions for the same bar; the
model list is a parameter (bounded by the number of models), so pivots take it
explicitly and no distinct pass is needed.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["symbol", "ts"]


def matrix(p: DataFrame, models: list[str], col: str = "y_score") -> DataFrame:
    """One column per model (row key + truth)."""
    return p.groupBy(*KEY, "y_true").pivot("model", models).agg(F.first(col))


def contributions(p: DataFrame, weights: DataFrame | None = None, col: str = "y_score") -> DataFrame:
    """Each model's weighted share of the ensemble value per row."""
    w = weights if weights is not None else p.select("model").distinct().withColumn("weight", F.lit(1.0))
    j = p.join(w, "model").withColumn("_wp", F.col("weight") * F.col(col))
    # the models of one key (bounded by the model count) summed in sorted order: the same
    # total whatever the row order, so shares are reproducible run to run
    vals = F.array_sort(F.collect_list("_wp").over(Window.partitionBy(*KEY)))
    tot = F.aggregate(vals, F.lit(0.0), lambda a, x: a + x)
    return j.select(*KEY, "model", F.try_divide(F.col("_wp"), tot).alias("contribution"))


def simple_average(p: DataFrame, col: str = "y_score") -> DataFrame:
    """N02."""
    return p.groupBy(*KEY).agg(F.avg(col).alias("ensemble"))


def weighted_average(p: DataFrame, weights: DataFrame, col: str = "y_score") -> DataFrame:
    """sum(w p) / sum(w); weights is a (model, weight) table (one row per model)."""
    j = p.join(F.broadcast(weights), "model")
    return j.groupBy(*KEY).agg((F.sum(F.col("weight") * F.col(col)) / F.sum("weight")).alias("ensemble"))


def voting(p: DataFrame, t: float = 0.5, col: str = "y_score", regression: bool = False) -> DataFrame:
    """Share of positive votes (the reference's output) and the majority label."""
    if regression:
        return p.groupBy(*KEY).agg(F.avg(col).alias("ensemble"))
    a = p.groupBy(*KEY).agg(F.avg((F.col(col) > t).cast("double")).alias("vote_share"))
    return a.withColumn("majority", (F.col("vote_share") > 0.5).cast("int"))


def simplex_grid(n_models: int, step: float = 0.1) -> list[tuple[float, ...]]:
    k = round(1 / step)
    pts = [c for c in itertools.product(range(k + 1), repeat=n_models) if sum(c) == k]
    return [tuple(x / k for x in c) for c in sorted(pts)]


def weight_search(p: DataFrame, models: list[str], loss: str = "logloss", step: float = 0.1,
                  col: str = "y_score") -> DataFrame:
    """Best weights on a simplex grid by mean log loss (clip 1e-15) or MSE.

    Each row evaluates every grid point in-row (the grid is a parameter, bounded by
    the step), and one aggregate sums the losses: no join of rows with the grid.
    Output: one row per (grid point id, model) of the best point and its loss.
    """
    grid = simplex_grid(len(models), step)
    m = matrix(p, models, col)
    losses = []
    for g in grid:
        e = sum(F.lit(w) * F.col(f"`{mo}`") for w, mo in zip(g, models))
        if loss == "logloss":
            e = F.least(F.greatest(e, F.lit(1e-15)), F.lit(1 - 1e-15))
            y = F.col("y_true")
            losses.append(-(y * F.log(e) + (1 - y) * F.log(1 - e)))
        else:
            losses.append((e - F.col("y_true")) ** 2)
    agg = m.agg(*[F.avg(x).alias(f"g{i}") for i, x in enumerate(losses)]).first()
    vals = [(agg[f"g{i}"], i) for i in range(len(grid))]
    best_loss, best = min(vals)
    spark = p.sparkSession
    return spark.createDataFrame([(mo, float(w), float(best_loss), best) for mo, w in zip(models, grid[best])],
                                 "model string, weight double, loss double, grid_id int")


def _simplex_step(w: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The weights that minimise the quadratic ``g (v - w) + (v - w) h (v - w) / 2`` over the simplex (active set)."""
    k = len(w)
    h = h + 1e-12 * max(1.0, np.trace(h)) * np.eye(k)
    v, free = w.copy(), w > 0
    for _ in range(20 * k):
        f = np.flatnonzero(free)
        slope = g + h @ (v - w)
        system = np.block([[h[np.ix_(f, f)], np.ones((len(f), 1))], [np.ones((1, len(f))), np.zeros((1, 1))]])
        move = np.zeros(k)
        move[f] = np.linalg.lstsq(system, np.append(-slope[f], 0.0), rcond=None)[0][:-1]
        down = move < -1e-15
        reach = np.min(-v[down] / move[down]) if down.any() else np.inf
        if np.abs(move).max() > 1e-14:
            v = np.maximum(v + min(1.0, reach) * move, 0)
            if reach <= 1.0:                            # a weight has come to 0 and stays there
                free &= v > 1e-15
                continue
        slope = g + h @ (v - w)
        level = slope[free].mean()
        wake = np.where(free, np.inf, slope - level)
        if wake.min() >= -1e-13:
            break
        free[np.argmin(wake)] = True
    return v / v.sum()


def _kkt(w: np.ndarray, g: np.ndarray) -> float:
    """How far weights are from the optimum: gradients equal where a weight is positive, no smaller elsewhere."""
    level = float(w @ g)
    return float(np.max(np.where(w > 1e-12, np.abs(g - level), np.maximum(level - g, 0))))


def _loss_terms(e: Column, y: Column, loss: str) -> tuple[Column, Column, Column]:
    """Loss of an ensemble value, and its first and second derivative."""
    if loss == "mse":
        return (e - y) ** 2, 2 * (e - y), F.lit(2.0)
    e = F.least(F.greatest(e, F.lit(1e-15)), F.lit(1 - 1e-15))
    return -(y * F.log(e) + (1 - y) * F.log(1 - e)), (e - y) / (e * (1 - e)), y / e ** 2 + (1 - y) / (1 - e) ** 2


def simplex_weights(p: DataFrame, models: list[str], loss: str = "logloss", col: str = "y_score",
                    tol: float = 1e-9, steps: int = 60) -> DataFrame:
    """The weights on the simplex with the least mean log loss (clip 1e-15) or MSE, by Newton's method.

    Loss, gradient and Hessian are one aggregate a step (a row of k + k (k + 1) / 2 sums for k models), the quadratic
    over the simplex is solved from them, and a second aggregate picks the step length.  Any number of models costs the
    same number of passes.  Output ``model, weight, loss, kkt`` (residual of the optimum's conditions, over all rows).
    """
    from barwise.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(p.sparkSession)
    m = matrix(p, models, col).select(F.col("y_true").cast("double").alias("_y"), *models).dropna().checkpoint()
    x, y, k = [F.col(f"`{mo}`") for mo in models], F.col("_y"), len(models)

    def value(w) -> Column:
        return sum(F.lit(float(a)) * c for a, c in zip(w, x))

    def at(w) -> tuple[float, np.ndarray, np.ndarray]:
        one, first, second = _loss_terms(value(w), y, loss)
        row = m.agg(F.avg(one), *[F.avg(first * c) for c in x],
                    *[F.avg(second * x[i] * x[j]) for i in range(k) for j in range(i, k)]).first()
        h = np.zeros((k, k))
        h[np.triu_indices(k)] = row[1 + k:]
        return row[0], np.array(row[1:1 + k], float), h + np.triu(h, 1).T

    w = np.full(k, 1.0 / k)
    for _ in range(steps):
        now, g, h = at(w)
        if _kkt(w, g) < tol:
            break
        v = _simplex_step(w, g, h)
        lengths = [0.5 ** i for i in range(12)]
        tried = m.agg(*[F.avg(_loss_terms(value(w + t * (v - w)), y, loss)[0]) for t in lengths]).first()
        best = int(np.argmin(tried))
        if tried[best] >= now - 1e-16:
            break
        w = w + lengths[best] * (v - w)
        w[w < 1e-13] = 0
        w = w / w.sum()
    now, g, _ = at(w)
    return p.sparkSession.createDataFrame([(mo, float(a), float(now), _kkt(w, g)) for mo, a in zip(models, w)],
                                          "model string, weight double, loss double, kkt double")


def linear_meta(p: DataFrame, models: list[str], col: str = "y_score") -> DataFrame:
    """N06 for regression: least squares of ``y_true`` on the base predictions and a constant, from the normal
    equations of one Gram aggregate.  Output ``term, coefficient`` (terms: ``constant`` and the models)."""
    m = matrix(p, models, col).select(F.col("y_true").cast("double").alias("_y"), *models).dropna()
    x = [F.lit(1.0), *[F.col(f"`{mo}`") for mo in models]]
    k = len(x)
    row = m.agg(*[F.avg(x[i] * x[j]) for i in range(k) for j in range(i, k)], *[F.avg(c * F.col("_y")) for c in x]).first()
    gram = np.zeros((k, k))
    gram[np.triu_indices(k)] = row[:k * (k + 1) // 2]
    gram = gram + np.triu(gram, 1).T
    found = np.linalg.lstsq(gram, np.array(row[k * (k + 1) // 2:], float), rcond=None)[0]
    return p.sparkSession.createDataFrame([(t, float(c)) for t, c in zip(["constant", *models], found)], "term string, coefficient double")


def linear_stacking(p_val: DataFrame, p_test: DataFrame, models: list[str], col: str = "y_score") -> DataFrame:
    """N06 for regression: the linear meta model fitted on ``p_val``, applied to ``p_test``."""
    c = {r["term"]: r["coefficient"] for r in linear_meta(p_val, models, col).collect()}    # a row a model
    te = matrix(p_test, models, col)
    return te.select(*KEY, "y_true", (F.lit(c["constant"]) + sum(F.lit(c[mo]) * F.col(f"`{mo}`") for mo in models)).alias("stacked"))


def stacking_score(stacked: DataFrame) -> DataFrame:
    """Validation score of a stacked regression: rows, MSE and R²."""
    y, e = F.col("y_true").cast("double"), F.col("stacked")
    return stacked.agg(F.count(F.lit(1)).alias("n"), F.avg((y - e) ** 2).alias("mse"),
                       (1 - F.try_divide(F.avg((y - e) ** 2), F.var_pop(y))).alias("r2"))


def stacking(p_val: DataFrame, p_test: DataFrame, models: list[str], col: str = "y_score") -> DataFrame:
    """Logistic meta-model (L2, C = 1 as regParam = 1/n) on base predictions."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    tr = matrix(p_val, models, col)
    te = matrix(p_test, models, col)
    n = tr.count()
    va = VectorAssembler(inputCols=models, outputCol="features", handleInvalid="skip")
    lr = LogisticRegression(featuresCol="features", labelCol="y_true", regParam=1.0 / max(n, 1),
                            elasticNetParam=0.0, standardization=False)
    model = lr.fit(va.transform(tr.withColumn("y_true", F.col("y_true").cast("double"))))
    out = model.transform(va.transform(te))
    from pyspark.ml.functions import vector_to_array
    return out.select(*KEY, "y_true", vector_to_array("probability")[1].alias("stacked"))
