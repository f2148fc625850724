"""Model fitting on Spark ML.

The reference trains single-machine networks on one symbol; here the same inputs
(flattened look-back sequences of scaled features) feed Spark ML estimators over the
whole panel: training is distributed, scoring is a ``transform``.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwise.functions.core import c as col_, lag


def flatten(seqs: DataFrame) -> DataFrame:
    """Sequence array<array<double>> -> ML vector ``features``."""
    return seqs.withColumn("features", array_to_vector(F.flatten("seq")))


def classifier(kind: str = "logistic", **params):
    if kind == "gbt":
        return GBTClassifier(featuresCol="features", labelCol="label", seed=7, **params)
    return LogisticRegression(featuresCol="features", labelCol="label", **params)


def regressor(kind: str = "linear", **params):
    if kind == "gbt":
        return GBTRegressor(featuresCol="features", labelCol="label", seed=7, **params)
    return LinearRegression(featuresCol="features", labelCol="label", **params)


def fit_direction(train: DataFrame, kind: str = "logistic", **params):
    """Direction classifier on flattened sequences (label = target)."""
    data = flatten(train).withColumn("label", F.col("target").cast("double"))
    return Pipeline(stages=[classifier(kind, **params)]).fit(data)


def fit_price(train: DataFrame, kind: str = "linear", **params):
    """Next-price (or return) regressor on flattened sequences."""
    data = flatten(train).withColumn("label", F.col("target").cast("double"))
    return Pipeline(stages=[regressor(kind, **params)]).fit(data)


def score(model, seqs: DataFrame, model_name: str, classification: bool = True) -> DataFrame:
    """Panel -> predictions(symbol, ts, model, y_true, y_score)."""
    out = model.transform(flatten(seqs))
    s = vector_to_array("probability")[1] if classification else F.col("prediction")
    return out.select("symbol", "ts", F.lit(model_name).alias("model"), F.col("target").alias("y_true"), s.alias("y_score"))


def dilated_conv(df: DataFrame, x: str, weights=(0.5, 0.3, 0.2), dilations=(1, 2, 4), lookback: int = 10) -> DataFrame:
    """Causal dilated convolution with given weights (zero left padding), then global
    max and mean pooling over the look-back window."""
    from barwise.functions.core import full
    cols = {}
    for dl in dilations:
        y = sum(F.lit(w) * (col_(x) if k == 0 else F.coalesce(lag(x, dl * k), F.lit(0.0)))
                for k, w in enumerate(weights))
        cols[f"conv_d{dl}"] = y
    df = df.withColumns(cols)
    pooled = {}
    for dl in dilations:
        pooled[f"conv_d{dl}_max"] = full(F.max(f"conv_d{dl}"), f"conv_d{dl}", lookback)
        pooled[f"conv_d{dl}_mean"] = full(F.avg(f"conv_d{dl}"), f"conv_d{dl}", lookback)
    return df.withColumns(pooled)


def sweep(train: DataFrame, valid: DataFrame, grid: list[dict], kind: str = "logistic") -> DataFrame:
    """Fit one model per parameter set on the training split, score the time-later
    validation split; failures are skipped and reported."""
    from barwise.operators.evaluation import roc_auc
    rows = []
    spark = train.sparkSession
    for i, params in enumerate(grid, start=1):
        try:
            m = fit_direction(train, kind, **params)
            p = score(m, valid, f"trial_{i}")
            auc = roc_auc(p).first()["roc_auc"]
            acc = p.agg(F.avg(((F.col("y_score") > 0.5).cast("int") == F.col("y_true")).cast("double"))).first()[0]
            rows.append((i, str(sorted(params.items())), float(acc), None if auc is None else float(auc), "ok"))
        except Exception as e:  # noqa: BLE001 - a failed trial is skipped, as in the reference
            rows.append((i, str(sorted(params.items())), None, None, f"failed: {type(e).__name__}"))
    return spark.createDataFrame(rows, "trial int, params string, accuracy double, roc_auc double, status string")

