"""Latest state, overview and decision rules (P01-P11), for every symbol at once.

The per-bar decision inputs are the models' predictions of one row key; the rules are
``when`` chains on small per-key aggregates.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwise.operators.ranking import exact_quantiles
from barwise.operators.segments import last_rows

KEY = ["symbol", "ts"]


def stable(x):
    """Decision inputs rounded to 1e-9, so bands do not flip on float noise of the mean."""
    return F.round(x, 9)


# ---------------------------------------------------------------- P01-P03
def latest_quote(bars: DataFrame) -> DataFrame:
    """Last close, change and change % against the previous bar, volume, high, low.

    One pass; two bars of a symbol at most leave a task.
    """
    one = F.struct("ts", "close", "volume", "high", "low")
    q = last_rows(bars, 2).groupBy("symbol").agg(F.max(F.when(F.col("_k") == 1, one)).alias("l"),
                                                 F.max(F.when(F.col("_k") == 2, F.col("close"))).alias("prev_close"))
    q = q.select("symbol", "l.*", "prev_close")
    return q.withColumns({"change": F.col("close") - F.col("prev_close"),
                          "change_pct": F.try_divide(F.col("close") - F.col("prev_close"), F.col("prev_close")) * 100})


def describe(bars: DataFrame, cols=("close", "volume")) -> DataFrame:
    """Count, mean, std, min, quartiles, max per symbol and column (exact quartiles)."""
    long = bars.select("symbol", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value"))
                                                     for c in cols])).alias("kv")).select("symbol", "kv.*")
    base = long.groupBy("symbol", "feature").agg(F.count("value").alias("count"), F.avg("value").alias("mean"),
                                                 F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
                                                 F.max("value").alias("max"))
    q = exact_quantiles(bars, list(cols), [0.25, 0.5, 0.75], group=["symbol"])
    qw = q.groupBy("symbol", "feature").agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n)
                                              for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    return base.join(qw, ["symbol", "feature"], "left")


def tail(bars: DataFrame, n: int = 5) -> DataFrame:
    """Last n bars of each symbol (n of a symbol at most leave a task) and the extent."""
    return last_rows(bars, n, place="pos_from_end")


def extent(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
                                      F.min("low").alias("min_low"), F.max("high").alias("max_high"),
                                      F.count(F.lit(1)).alias("n_bars"))


# ---------------------------------------------------------------- P04-P10
def direction(p: DataFrame, t: float = 0.5) -> DataFrame:
    """UP when p >= t; confidence = max(p, 1-p) * 100."""
    return p.withColumns({"direction": F.when(F.col("y_score") >= t, "UP").otherwise("DOWN"),
                          "confidence": F.greatest(F.col("y_score"), 1 - F.col("y_score")) * 100})


def class_decision(p: DataFrame, t: float = 0.5, require_agreement: bool = False) -> DataFrame:
    """P05-P07, P09-P10 for classification: per row key over the models.

    agreement gate (an option, off by default: HOLD when models disagree), ensemble mean, agreement share,
    probability spread (population std), signal strength, risk level, recommendation,
    position size and stop loss.
    """
    up = (F.col("y_score") >= t).cast("int")
    a = p.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_models"), F.sum(up).alias("n_up"),
                            F.avg("y_score").alias("ensemble"), F.stddev_pop("y_score").alias("spread"),
                            F.first("price_now").alias("price_now"))
    n, nu = F.col("n_models"), F.col("n_up")
    a = a.withColumns({"ensemble": stable(F.col("ensemble")), "spread": stable(F.col("spread"))})
    a = a.withColumns({
        "disagree": ((nu > 0) & (nu < n)).cast("int"),
        "agreement": stable(F.greatest(nu, n - nu) / n),
        "signal_strength": stable(F.abs(F.col("ensemble") - t) / F.lit(max(max(t, 1 - t), 1e-6))),
        "direction": F.when(F.col("ensemble") >= t, "UP").otherwise("DOWN"),
        "confidence": stable(F.greatest(F.col("ensemble"), 1 - F.col("ensemble")) * 100)})
    ag, ss, sp = F.col("agreement"), F.col("signal_strength"), F.col("spread")
    risk = (F.when((ag >= 0.80) & (ss >= 0.30) & (sp <= 0.08), "low")
            .when((ag >= 0.60) & (ss >= 0.15) & (sp <= 0.15), "medium").otherwise("high"))
    a = a.withColumn("risk", risk)
    upd = F.col("direction") == "UP"
    multi = (F.when(F.col("risk") == "low", F.when(upd, "STRONG BUY").otherwise("STRONG SELL"))
             .when(F.col("risk") == "medium", F.when(upd, "MODERATE BUY").otherwise("MODERATE SELL"))
             .otherwise("HOLD"))
    conf = F.col("confidence")
    single = (F.when(conf > 80, F.when(upd, "STRONG BUY").otherwise("STRONG SELL"))
              .when(conf > 60, F.when(upd, "MODERATE BUY").otherwise("MODERATE SELL")).otherwise("HOLD"))
    rec = F.when(n > 1, multi).otherwise(single)
    if require_agreement:
        rec = F.when(F.col("disagree") == 1, "HOLD").otherwise(rec)
    a = a.withColumn("recommendation", rec)
    a = a.withColumn("position_size", F.when(conf > 80, "large").when(conf > 60, "medium").otherwise("small"))
    return a.withColumn("stop_loss", stop_loss(F.col("recommendation"), F.col("price_now")))


def stop_loss(rec, price):
    """P10: 5 % below for a buy, 5 % above for a sell."""
    return (F.when(rec.contains("BUY"), price * 0.95).when(rec.contains("SELL"), price * 1.05))


def regression_decision(p: DataFrame) -> DataFrame:
    """P08-P10 for price predictions: spread % of price, agreement on the side, expected
    return, risk, recommendation by return bands, position size, stop loss."""
    a = p.groupBy(*KEY).agg(F.avg("price_pred").alias("ensemble"), F.stddev_pop("price_pred").alias("_sd"),
                            F.first("price_now").alias("price_now"), F.count(F.lit(1)).alias("n_models"),
                            F.collect_list("price_pred").alias("_preds"))
    now, ens = F.col("price_now"), F.col("ensemble")
    same_side = F.size(F.filter("_preds", lambda x: (x > now) == (ens > now)))
    a = a.withColumns({"spread_pct": stable(F.col("_sd") / now * 100),
                       "agreement": stable(same_side / F.col("n_models")),
                       "expected_return": stable((ens - now) / now * 100)})
    ag, sp, er = F.col("agreement"), F.col("spread_pct"), F.col("expected_return")
    a = a.withColumn("risk", F.when((ag > 0.8) & (sp < 2), "low").when((ag > 0.6) & (sp < 5), "medium").otherwise("high"))
    rec = (F.when(er > 5, "STRONG BUY").when(er > 2, "MODERATE BUY").when(er > -2, "HOLD")
           .when(er > -5, "MODERATE SELL").otherwise("STRONG SELL"))
    a = a.withColumn("recommendation", rec)
    a = a.withColumn("position_size", F.when(F.abs(er) > 5, "large").when(F.abs(er) > 2, "medium").otherwise("small"))
    return a.withColumn("stop_loss", stop_loss(F.col("recommendation"), now)).drop("_sd", "_preds")


# ---------------------------------------------------------------- P11
def context(bars: DataFrame, n: int = 20) -> DataFrame:
    """On each symbol's last 20 bars: MA5, MA20, trend, RSI (pct form), annualised
    volatility of the % changes and their bands."""
    w = Window.partitionBy("symbol").orderBy("ts")
    r = F.try_divide(F.col("close"), F.lag("close").over(w)) - 1
    b = last_rows(bars, n + 1).withColumn("_r", r)      # n + 1 rows of a symbol: the windows are as short
    b = b.withColumn("_r", F.when(F.col("_k") <= n - 1, F.col("_r")))   # changes inside the last n bars
    fr = lambda k: w.rowsBetween(-(k - 1), 0)
    g = F.when(F.col("_r") > 0, F.col("_r")).when(F.col("_r").isNotNull(), 0.0)
    lo = F.when(F.col("_r") < 0, -F.col("_r")).when(F.col("_r").isNotNull(), 0.0)
    b = b.withColumns({"_g": g, "_l": lo})
    cnt = F.count("_r").over(fr(n))
    ag = F.when(cnt >= 14, F.avg("_g").over(fr(14))).otherwise(F.avg("_g").over(fr(n)))
    al = F.when(cnt >= 14, F.avg("_l").over(fr(14))).otherwise(F.avg("_l").over(fr(n)))
    out = b.withColumns({"ma_5": F.when(F.count("close").over(fr(5)) == 5, F.avg("close").over(fr(5))),
                         "ma_20": F.when(F.count("close").over(fr(n)) == n, F.avg("close").over(fr(n))),
                         "rsi": 100 - 100 / (1 + ag / (al + F.lit(1e-8))),
                         "volatility": F.stddev_samp("_r").over(fr(n)) * math.sqrt(252) * 100}).filter(F.col("_k") == 1)
    out = out.withColumn("trend", F.when(F.col("ma_5") > F.col("ma_20"), "up")
                         .when(F.col("ma_5") < F.col("ma_20"), "down").otherwise("sideways"))
    out = out.withColumn("volatility_band", F.when(F.col("volatility") > 30, "high")
                         .when(F.col("volatility") > 20, "medium").otherwise("low"))
    out = out.withColumn("rsi_band", F.when(F.col("rsi") > 70, "overbought").when(F.col("rsi") < 30, "oversold")
                         .otherwise("neutral"))
    return out.select("symbol", "ts", "close", "ma_5", "ma_20", "trend", "rsi", "rsi_band", "volatility",
                      "volatility_band")
