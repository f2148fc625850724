"""Regime, volatility and interaction features.

Guarded comparisons follow the reference's ``series.where(x > eps, eps)``, which also
replaces a not-yet-defined value by eps; so these flags can be set while the guarded
frame fills (``coalesce(when(x > eps, x), eps)``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwise.functions.core import bar_cols, div, flag, lag, rstd, sma, with_cols

EPS = 1e-6


def _guard(x, eps: float = EPS):
    return F.coalesce(F.when(x > eps, x), F.lit(eps))


def _returns():
    c, = bar_cols('close')
    return div(c, lag(c)) - 1


def market_state(df: DataFrame, short: int = 10, long: int = 50) -> DataFrame:
    """1 bull / -1 bear / 0 sideways from SMA10 vs guarded SMA50 +-2 %."""
    df = with_cols(df, {"_ms": sma("close", short), "_ml": sma("close", long)})
    ml = F.coalesce(F.when(F.abs(F.col("_ml")) > EPS, F.col("_ml")), F.lit(EPS))
    ms = F.col("_ms")
    st = F.when(ms > ml * 1.02, 1).when(ms < ml * 0.98, -1).otherwise(0)
    return df.withColumn("market_state", st.cast("int")).drop("_ms", "_ml")


def vol_regime(df: DataFrame, w: int = 20, long: int = 50) -> DataFrame:
    """20-bar return volatility vs its guarded 50-bar mean x 1.5 / 0.5."""
    df = df.withColumn("_r", _returns())
    df = df.withColumn("_vol", rstd("_r", w))
    df = df.withColumn("_vm", _guard(sma("_vol", long)))
    vol, vm = F.col("_vol"), F.col("_vm")
    st = F.when(vol > vm * 1.5, 1).when(vol < vm * 0.5, -1).otherwise(0)
    return df.withColumn("vol_regime", st.cast("int")).drop("_r", "_vol", "_vm")


def realized_vol(df: DataFrame, ws=(5, 10, 20)) -> DataFrame:
    """Realised volatility and volatility of volatility."""
    df = df.withColumn("_r", _returns())
    df = with_cols(df, {f"realized_vol_{w}": rstd("_r", w) for w in ws})
    return with_cols(df, {f"vol_of_vol_{w}": rstd(f"realized_vol_{w}", w) for w in ws}).drop("_r")


def vol_cluster(df: DataFrame, w: int = 20, long: int = 50) -> DataFrame:
    """Realised vol 20 above its 50-bar mean."""
    df = df.withColumn("_r", _returns())
    df = df.withColumn("_rv", rstd("_r", w))
    return df.withColumn("vol_cluster", flag(F.col("_rv") > sma("_rv", long))).drop("_r", "_rv")


def jump(df: DataFrame, w: int = 20, k: float = 3.0) -> DataFrame:
    """|return| above the guarded 3 x realised vol 20."""
    df = df.withColumn("_r", _returns())
    df = df.withColumn("_th", _guard(rstd("_r", w) * k))
    return df.withColumn("jump_indicator", flag(F.abs(F.col("_r")) > F.col("_th"))).drop("_r", "_th")


def price_volume(df: DataFrame) -> DataFrame:
    """Price x volume; price / (volume + eps) with both eps of the reference."""
    c, v = bar_cols('close', 'volume')
    return with_cols(df, {"price_volume_interaction": c * v,
                          "price_volume_ratio": c / (v + F.lit(1e-8)),
                          "price_volume_ratio_adv": c / (v + F.lit(1e-6))})


def indicator_products(df: DataFrame) -> DataFrame:
    """ATR x RSI, MACD x ADX, Bollinger position x RSI (computes the inputs if absent)."""
    from barwise.operators import indicators as G
    from barwise.operators import scan as S
    if "atr_14" not in df.columns:
        df = S.atr(df, (14,))
    if "rsi_14" not in df.columns:
        df = S.rsi(df, 14)
    if "macd" not in df.columns:
        df = S.macd(df)
    if "adx" not in df.columns:
        df = S.adx(df)
    if "bb_position" not in df.columns:
        df = G.bollinger(df)
    return with_cols(df, {"volatility_momentum": F.col("atr_14") * F.col("rsi_14"),
                          "trend_momentum": F.col("macd") * F.col("adx"),
                          "bb_rsi_interaction": F.col("bb_position") * F.col("rsi_14")})


def joint_signals(df: DataFrame) -> DataFrame:
    """RSI/MACD and Bollinger/RSI joint flags."""
    from barwise.operators import indicators as G
    from barwise.operators import scan as S
    if "rsi_14" not in df.columns:
        df = S.rsi(df, 14)
    if "macd" not in df.columns:
        df = S.macd(df)
    if "bb_position_20_2" not in df.columns:
        df = G.bollinger(df, 20, 2.0, ddof=1, suffix="_20_2")
    r, m, bb = F.col("rsi_14"), F.col("macd"), F.col("bb_position_20_2")
    return with_cols(df, {"rsi_macd_signal": flag((r > 50) & (m > 0)),
                          "bb_rsi_oversold": flag((bb < 0.2) & (r < 30)),
                          "bb_rsi_overbought": flag((bb > 0.8) & (r > 70)),
                          "rsi_macd_bullish": flag((r > 50) & (F.col("macd_bullish") == 1))})


def volume_return(df: DataFrame, w: int = 20) -> DataFrame:
    """Volume ratio x return, volume x return."""
    v, = bar_cols('volume')
    df = df.withColumn("_vs", sma("volume", w))
    r = _returns()
    return with_cols(df, {"volume_price_momentum": div(v, F.col("_vs")) * r,
                          "volume_price_trend": v * r}).drop("_vs")
