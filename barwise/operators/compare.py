"""Model comparison (O01-O08): summary, pairs, significance tests, best models.

Pair statistics are aggregates over the row key; only the final one-row-per-pair
p-values use a small Python helper (no erf / incomplete beta in Spark SQL).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwise.operators import evaluation as M

KEY = ["symbol", "ts"]
# metrics where lower is better
LOWER_BETTER = ("rmse", "mae", "mape", "mse")


def summary(p: DataFrame, t: float = 0.5) -> DataFrame:
    """Model x (accuracy, precision, recall, f1, roc_auc, tpr, tnr, mcc)."""
    lab = M.threshold_labels(p, t)
    cm = M.classification_metrics(lab)
    tm = M.trading_metrics(lab).select("model", "tpr", "tnr", "mcc")
    auc = M.roc_auc(p)
    return cm.join(auc, "model").join(tm, "model")


def pairs(models: DataFrame) -> DataFrame:
    """All unordered pairs i < j (theta self-join of the model list)."""
    a = models.select(F.col("model").alias("model_a"))
    b = models.select(F.col("model").alias("model_b"))
    return a.join(b, F.col("model_a") < F.col("model_b"))


def chi2_sf1(x: float) -> float:
    """Survival function of chi-square with 1 degree of freedom."""
    return math.erfc(math.sqrt(x / 2.0)) if x > 0 else 1.0


def _betacf(a: float, b: float, x: float) -> float:
    # continued fraction of the regularised incomplete beta (modified Lentz)
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        de = d * c
        h *= de
        if abs(de - 1.0) < 3e-16:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)
    if x < (a + 1) / (a + b + 2):
        return math.exp(lbeta) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbeta) * _betacf(b, a, 1 - x) / b


def t_two_sided(t: float | None, dof: float) -> float | None:
    if t is None or dof is None or dof <= 0 or math.isnan(t):
        return None
    return betainc(dof / 2.0, 0.5, dof / (dof + t * t))


_chi2_udf = F.udf(lambda x: None if x is None else chi2_sf1(x), T.DoubleType())
_t_udf = F.udf(lambda t, d: t_two_sided(t, d), T.DoubleType())


def _pair_rows(p: DataFrame, models: list[str], value) -> DataFrame:
    """Per row key, the per-model value as columns (models is a bounded parameter)."""
    return p.withColumn("_v", value).groupBy(*KEY).pivot("model", models).agg(F.first("_v"))


def mcnemar(p: DataFrame, models: list[str], t: float = 0.5) -> DataFrame:
    """b = A right & B wrong, c = the opposite; stat (|b-c|-1)^2/(b+c), 0 and p=1 if b+c=0."""
    lab = M.threshold_labels(p, t)
    m = _pair_rows(lab, models, (F.col("y_pred") == F.col("y_true")).cast("int"))
    prs = [(a, b) for i, a in enumerate(models) for b in models[i + 1:]]
    aggs = []
    for a, b in prs:
        aggs += [F.count_if((F.col(f"`{a}`") == 1) & (F.col(f"`{b}`") == 0)).alias(f"{a}|{b}|b"),
                 F.count_if((F.col(f"`{a}`") == 0) & (F.col(f"`{b}`") == 1)).alias(f"{a}|{b}|c")]
    row = m.agg(*aggs)
    long = row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"),
                                                   F.col(f"`{a}|{b}|b`").alias("b"), F.col(f"`{a}|{b}|c`").alias("c"))
                                          for a, b in prs])).alias("r")).select("r.*")
    bc = F.col("b") + F.col("c")
    stat = F.when(bc == 0, F.lit(0.0)).otherwise(F.pow(F.abs(F.col("b") - F.col("c")) - 1, 2) / bc)
    long = long.withColumn("statistic", stat)
    return long.withColumn("p_value", F.when(bc == 0, F.lit(1.0)).otherwise(_chi2_udf("statistic")))


def paired_t(p: DataFrame, models: list[str], y="price_true", yhat="price_pred") -> DataFrame:
    """Paired t test on absolute errors of two models over the same rows."""
    m = _pair_rows(p, models, F.abs(F.col(y) - F.col(yhat)))
    prs = [(a, b) for i, a in enumerate(models) for b in models[i + 1:]]
    aggs = []
    for a, b in prs:
        dcol = F.col(f"`{a}`") - F.col(f"`{b}`")
        aggs += [F.avg(dcol).alias(f"{a}|{b}|m"), F.stddev_samp(dcol).alias(f"{a}|{b}|s"),
                 F.count(dcol).alias(f"{a}|{b}|n")]
    row = m.agg(*aggs)
    long = row.select(F.explode(F.array(*[F.struct(
        F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col(f"`{a}|{b}|m`").alias("mean_diff"),
        F.col(f"`{a}|{b}|s`").alias("sd_diff"), F.col(f"`{a}|{b}|n`").alias("n")) for a, b in prs])).alias("r")) \
        .select("r.*")
    tstat = F.try_divide(F.col("mean_diff"), F.col("sd_diff") / F.sqrt("n"))
    long = long.withColumn("t_statistic", tstat)
    return long.withColumn("p_value", _t_udf("t_statistic", (F.col("n") - 1).cast("double")))


def best_model(summary_df: DataFrame, metric: str) -> DataFrame:
    """Arg max (arg min for error metrics) of one metric."""
    v = F.col(metric)
    agg = F.min_by("model", v) if metric in LOWER_BETTER else F.max_by("model", v)
    best = F.min(v) if metric in LOWER_BETTER else F.max(v)
    return summary_df.agg(agg.alias("best_model"), best.alias("value")).withColumn("metric", F.lit(metric))


def best_per_metric(summary_df: DataFrame, metrics: list[str]) -> DataFrame:
    """Unpivot the summary, best model per metric by the metric's direction."""
    long = summary_df.unpivot(["model"], metrics, "metric", "value")
    signed = F.when(F.col("metric").isin(*LOWER_BETTER), -F.col("value")).otherwise(F.col("value"))
    long = long.withColumn("_s", signed)
    return long.groupBy("metric").agg(F.max_by("model", F.struct("_s", F.col("model"))).alias("best_model"),
                                      F.max_by("value", F.struct("_s", F.col("model"))).alias("value"))


def radar(reg_metrics: DataFrame) -> DataFrame:
    """Error metrics mapped into (0, 1], higher is better."""
    return reg_metrics.select("model", (1 / (1 + F.col("rmse"))).alias("rmse_score"),
                              (1 / (1 + F.col("mae"))).alias("mae_score"),
                              (1 / (1 + F.col("mape") / 100)).alias("mape_score"))


def leaderboard(trials: DataFrame, target: float = 0.80, metric: str = "accuracy", by=("model",)) -> DataFrame:
    """Trials in order; best so far; trials up to and including the first hit of the target."""
    by = list(by)
    w = Window.partitionBy(*by).orderBy("trial").rowsBetween(Window.unboundedPreceding, 0)
    t = trials.withColumn("best_so_far", F.max(metric).over(w))
    hit = F.min(F.when(F.col(metric) >= target, F.col("trial"))).over(Window.partitionBy(*by))
    t = t.withColumn("_hit", hit)
    return t.filter(F.col("_hit").isNull() | (F.col("trial") <= F.col("_hit"))).drop("_hit")
