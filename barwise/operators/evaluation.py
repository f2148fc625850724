"""Predictions table and evaluation aggregates.

Input: ``predictions(symbol, ts, model, y_true, y_score, price_true, price_pred)``.
Every metric is a grouped aggregate over ``by`` (default ``["model"]``): partial
aggregation on the map side, one small shuffle; curves and AUC use the bucketed
global order of :mod:`barwise.operators.ranking` instead of one task per model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwise.operators.ranking import ordered_cumsum

MODELS = ("lstm", "tcn", "gbt")


def predictions(bars: DataFrame, models=MODELS) -> DataFrame:
    """Deterministic stand-in predictions (integer arithmetic, identical in any engine)."""
    w = Window.partitionBy("symbol").orderBy("ts")
    b = bars.select("symbol", "ts", "close", F.lead("close").over(w).alias("next_close")) \
            .filter(F.col("next_close").isNotNull())
    b = b.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    key = F.concat_ws("|", "symbol", F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"), "model")
    h = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % 1000
    b = b.withColumns({"_h": h, "y_true": (F.col("close") < F.col("next_close")).cast("int")})
    return b.select("symbol", "ts", "model", "y_true",
                    ((350 * F.col("y_true") + F.expr("(650 * _h) div 1000")) / 1000.0).alias("y_score"),
                    F.col("next_close").alias("price_true"),
                    (F.col("close") * (950 + F.expr("_h div 10")) / 1000.0).alias("price_pred"),
                    F.col("close").alias("price_now"))


def _safe(num, den):
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


# ---------------------------------------------------------------- M01
def threshold_labels(p: DataFrame, t: float = 0.5, by=("model",), strict: bool = True) -> DataFrame:
    """Scores are probabilities only if all of a model's scores lie in [0, 1]."""
    by = list(by)
    probs = p.groupBy(*by).agg(F.bool_and(F.col("y_score").between(0, 1)).alias("_is_prob"))
    j = p.join(probs, by, "left")
    cmp = (F.col("y_score") > t) if strict else (F.col("y_score") >= t)
    return j.withColumn("y_pred", F.when(F.col("_is_prob"), cmp.cast("int"))
                        .otherwise(F.col("y_score").cast("int"))).drop("_is_prob")


def _counts(lab: DataFrame, by) -> DataFrame:
    yt, yp = F.col("y_true"), F.col("y_pred")
    return lab.groupBy(*by).agg(
        F.count_if((yt == 1) & (yp == 1)).alias("tp"), F.count_if((yt == 0) & (yp == 0)).alias("tn"),
        F.count_if((yt == 0) & (yp == 1)).alias("fp"), F.count_if((yt == 1) & (yp == 0)).alias("fn"))


# ---------------------------------------------------------------- M02 / M06
def classification_metrics(lab: DataFrame, by=("model",)) -> DataFrame:
    by = list(by)
    c = _counts(lab, by)
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    prec = _safe(tp, tp + fp)
    rec = _safe(tp, tp + fn)
    return c.select(*by, _safe(tp + tn, tp + tn + fp + fn).alias("accuracy"), prec.alias("precision"),
                    rec.alias("recall"), _safe(2 * prec * rec, prec + rec).alias("f1"))


def trading_metrics(lab: DataFrame, by=("model",)) -> DataFrame:
    by = list(by)
    c = _counts(lab, by)
    tp, tn, fp, fn = (F.col(x).cast("double") for x in ("tp", "tn", "fp", "fn"))
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return c.select(*by, _safe(tp, tp + fn).alias("tpr"), _safe(tn, tn + fp).alias("tnr"),
                    _safe(tp, tp + fp).alias("ppv"), _safe(tn, tn + fn).alias("npv"),
                    F.when(den > 0, (tp * tn - fp * fn) / den).otherwise(0.0).alias("mcc"))


# ---------------------------------------------------------------- M03 / M04
def confusion(lab: DataFrame, by=("model",)) -> DataFrame:
    """Counts by (true, pred) with zero cells kept (grid per group, left join)."""
    by = list(by)
    cells = lab.groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    grid = lab.select(*by).distinct().select(*by, F.explode(F.array(*[
        F.struct(F.lit(a).alias("y_true"), F.lit(b).alias("y_pred")) for a in (0, 1) for b in (0, 1)])).alias("g")) \
        .select(*by, "g.*")
    return grid.join(cells, [*by, "y_true", "y_pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def class_report(lab: DataFrame, by=("model",)) -> DataFrame:
    """Per class precision/recall/F1/support plus macro and weighted averages."""
    by = list(by)
    c = _counts(lab, by)
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    rows = []
    for cls, (a, b_, m) in {"1": (tp, fp, fn), "0": (tn, fn, fp)}.items():
        p_ = _safe(a, a + b_)
        r_ = _safe(a, a + m)
        rows.append(F.struct(F.lit(cls).alias("label"), p_.alias("precision"), r_.alias("recall"),
                             _safe(2 * p_ * r_, p_ + r_).alias("f1"), (a + m).cast("double").alias("support")))
    per = c.select(*by, F.explode(F.array(*rows)).alias("r")).select(*by, "r.*")
    n = F.sum("support")
    avg = per.groupBy(*by).agg(
        F.avg("precision").alias("m_p"), F.avg("recall").alias("m_r"), F.avg("f1").alias("m_f"),
        (F.sum(F.col("precision") * F.col("support")) / n).alias("w_p"),
        (F.sum(F.col("recall") * F.col("support")) / n).alias("w_r"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("w_f"), n.alias("n"))
    extra = avg.select(*by, F.explode(F.array(
        F.struct(F.lit("macro avg").alias("label"), F.col("m_p").alias("precision"), F.col("m_r").alias("recall"),
                 F.col("m_f").alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), F.col("w_p").alias("precision"), F.col("w_r").alias("recall"),
                 F.col("w_f").alias("f1"), F.col("n").alias("support")))).alias("r")).select(*by, "r.*")
    return per.unionByName(extra)


# ---------------------------------------------------------------- M05 / M11 / M12
def _score_counts(p: DataFrame, by) -> DataFrame:
    return p.groupBy(*by, "y_score").agg(F.count_if(F.col("y_true") == 1).alias("pos"),
                                         F.count_if(F.col("y_true") == 0).alias("neg"))


def roc_auc(p: DataFrame, by=("model",)) -> DataFrame:
    """Exact AUC with ties: sum(pos * (neg below + neg here / 2)) / (P * N); null for one class."""
    by = list(by)
    s = _score_counts(p, by)
    r = ordered_cumsum(s, by, ["y_score"], {"neg": F.col("neg")}, inclusive=False)
    a = r.groupBy(*by).agg((F.sum(F.col("pos") * (F.col("cum_neg") + F.col("neg") / 2.0))).alias("_u"),
                           F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return a.select(*by, F.when((F.col("_p") > 0) & (F.col("_n") > 0),
                                F.col("_u") / (F.col("_p") * F.col("_n"))).alias("roc_auc"))


def roc_curve(p: DataFrame, by=("model",)) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score: rates of scores >= threshold."""
    by = list(by)
    s = _score_counts(p, by).withColumn("_neg_score", -F.col("y_score"))
    r = ordered_cumsum(s, by, ["_neg_score"], {"pos": F.col("pos"), "neg": F.col("neg")})
    return r.select(*by, F.col("y_score").alias("threshold"),
                    F.try_divide(F.col("cum_neg"), F.col("tot_neg")).alias("fpr"),
                    F.try_divide(F.col("cum_pos"), F.col("tot_pos")).alias("tpr"))


def pr_curve(p: DataFrame, by=("model",)) -> DataFrame:
    """(threshold, precision, recall) for every distinct score, decreasing thresholds."""
    by = list(by)
    s = _score_counts(p, by).withColumn("_neg_score", -F.col("y_score"))
    r = ordered_cumsum(s, by, ["_neg_score"], {"pos": F.col("pos"), "all": F.col("pos") + F.col("neg")})
    return r.select(*by, F.col("y_score").alias("threshold"),
                    (F.col("cum_pos") / F.col("cum_all")).alias("precision"),
                    F.try_divide(F.col("cum_pos"), F.col("tot_pos")).alias("recall"))


def average_precision(p: DataFrame, by=("model",)) -> DataFrame:
    """Step integral sum((R_k - R_{k-1}) * P_k) over decreasing thresholds."""
    by = list(by)
    s = _score_counts(p, by).withColumn("_neg_score", -F.col("y_score"))
    r = ordered_cumsum(s, by, ["_neg_score"], {"pos": F.col("pos"), "all": F.col("pos") + F.col("neg")})
    # recall step of a threshold = its positives / P
    term = (F.col("pos") / F.col("tot_pos")) * (F.col("cum_pos") / F.col("cum_all"))
    return r.groupBy(*by).agg(F.sum(term).alias("average_precision"))


# ---------------------------------------------------------------- M07-M10
def regression_metrics(p: DataFrame, by=("model",), y="price_true", yhat="price_pred") -> DataFrame:
    by = list(by)
    e = F.col(y) - F.col(yhat)
    a = p.groupBy(*by).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
                           F.sum(e * e).alias("_sse"), (F.var_pop(y) * F.count(y)).alias("_sst"),
                           (F.avg(F.abs(e / (F.col(y) + F.lit(1e-8)))) * 100).alias("mape"))
    return a.select(*by, "mse", F.sqrt("mse").alias("rmse"), "mae",
                    F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.col("_sst")).alias("r2"), "mape")


def residual_stats(p: DataFrame, by=("model",), y="price_true", yhat="price_pred") -> DataFrame:
    by = list(by)
    e = F.col(y) - F.col(yhat)
    return p.groupBy(*by).agg(F.avg(e).alias("mean_residual"), F.stddev_pop(e).alias("std_residual"))


def residuals(p: DataFrame, y="price_true", yhat="price_pred") -> DataFrame:
    return p.withColumn("residual", F.col(y) - F.col(yhat))


def directional_accuracy(p: DataFrame, by=("model",), y="price_true", yhat="price_pred") -> DataFrame:
    """Share of consecutive steps (per symbol, in time) whose direction the prediction gets right;
    0 with fewer than 2 rows."""
    by = list(by)
    w = Window.partitionBy(*by, "symbol").orderBy("ts")
    d = p.withColumns({"_dt": F.col(y) - F.lag(y).over(w), "_dp": F.col(yhat) - F.lag(yhat).over(w)})
    ok = ((F.col("_dt") > 0) == (F.col("_dp") > 0)).cast("double")
    return d.groupBy(*by).agg(F.coalesce(F.avg(F.when(F.col("_dt").isNotNull(), ok)), F.lit(0.0))
                              .alias("directional_accuracy"))


def error_bounds(p: DataFrame, by=("model",), y="price_true", yhat="price_pred", bounds=(0.01, 0.05, 0.10, 0.20)) -> DataFrame:
    by = list(by)
    rel = F.abs((F.col(y) - F.col(yhat)) / (F.col(y) + F.lit(1e-8)))
    return p.groupBy(*by).agg(*[(F.avg((rel <= b).cast("double")) * 100).alias(f"within_{round(b * 100)}pct")
                                for b in bounds])


# ---------------------------------------------------------------- M13
def histogram(df: DataFrame, x: str, by: list[str], bins: int = 30, range_by: list[str] | None = None) -> DataFrame:
    """Equal-width histogram (numpy rule: the last bin includes the maximum)."""
    rb = range_by if range_by is not None else by
    rng = df.groupBy(*rb).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    j = df.join(rng, rb, "left") if rb else df.withColumn("_k", F.lit(0)).join(
        rng.withColumn("_k", F.lit(0)), "_k").drop("_k")
    width = F.col("_hi") - F.col("_lo")
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col(x) - F.col("_lo")) / width * bins), F.lit(bins - 1))).cast("int")
    return j.withColumn("bin", b).groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.first("_lo").alias("lo"), F.first("_hi").alias("hi")) \
        .withColumn("bin_start", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / bins).drop("lo", "hi")
