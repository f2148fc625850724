"""Flagship query: lineitem x part -> daily brand bars -> SMA 5/20 + MACD + direction
target -> latest bar per brand with its signal and the signal's past hit rate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise.functions.core import flag, sma
from barwise.operators.labels import targets
from barwise.operators.scan import ema_memory, macd
from barwise.operators.segments import segmented
from barwise.sources.bars import bars_brand

SPEC = ("symbol:s, ts:t, close:d, sma_5:d, sma_20:d, macd:d4, macd_signal:d4, signal:s, "
        "n_signals:l, hit_rate:d")


def flagship(spark: SparkSession, d: str, skew_safe: bool = True) -> DataFrame:
    """Windows by (symbol, block), the next bar of the target included; ``skew_safe=False`` asks for plain
    per-symbol windows."""
    def features(b: DataFrame) -> DataFrame:
        b = macd(b.withColumns({"sma_5": sma("close", 5), "sma_20": sma("close", 20)}))
        return targets(b, horizon=1, drop_last=False)

    bars = bars_brand(spark, d)
    f = segmented(bars, features, lookback=ema_memory(26, 9), ahead=1) if skew_safe else features(bars)
    up = (F.col("macd") > F.col("macd_signal")) & (F.col("sma_5") > F.col("sma_20"))
    dn = (F.col("macd") < F.col("macd_signal")) & (F.col("sma_5") < F.col("sma_20"))
    f = f.withColumn("signal", F.when(up, "BUY").when(dn, "SELL").otherwise("HOLD"))
    called = (F.col("signal") != "HOLD") & F.col("target_direction").isNotNull()
    hit = flag(((F.col("signal") == "BUY") & (F.col("target_direction") == 1))
               | ((F.col("signal") == "SELL") & (F.col("target_direction") == 0)))
    last = F.struct("ts", "close", "sma_5", "sma_20", "macd", "macd_signal", "signal")
    agg = f.groupBy("symbol").agg(
        F.max_by(last, "ts").alias("l"),
        F.count_if(called).alias("n_signals"),
        F.try_divide(F.sum(F.when(called, hit)), F.count_if(called)).alias("hit_rate"))
    return agg.select("symbol", "l.*", "n_signals", "hit_rate")
