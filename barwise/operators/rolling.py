"""Rolling windows, lags and ratios (E01-E19): ``ROWS W-1 PRECEDING`` frames.

All frames share one window spec (per symbol, in time order), so a whole stage of
rolling columns compiles to one Exchange + one Sort + Window operators; stages that
read the outputs of an earlier stage reuse the same ordering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwise.functions.candles import returns as _returns, true_range_col
from barwise.functions.core import (bar_cols, c as col_, div, flag, full, lag, rmax, rmedian, rmin,
                                    rstd, sma, win, with_cols)



def ensure_returns(df: DataFrame) -> DataFrame:
    return df if "returns" in df.columns else df.withColumns(_returns((1,)))


def sma_cols(ws=(3, 5, 10, 20, 50, 100, 200), x: str = "close", prefix: str = "sma") -> dict:
    """E01."""
    return {f"{prefix}_{w}": sma(x, w) for w in ws}


def volume_sma(df: DataFrame, ws=(5, 10, 20, 50)) -> DataFrame:
    """Volume SMA and volume / SMA."""
    v, = bar_cols('volume')
    df = with_cols(df, {f"volume_sma_{w}": sma("volume", w) for w in ws})
    return with_cols(df, {f"volume_ratio_{w}": div(v, F.col(f"volume_sma_{w}")) for w in ws})


def price_sma_ratios(df: DataFrame, ws=(5, 10, 20, 50)) -> DataFrame:
    """Close / SMA_W and SMA5 / SMA20."""
    c, = bar_cols('close')
    need = sorted(set(ws) | {5, 20})
    df = with_cols(df, {f"_sma_{w}": sma("close", w) for w in need})
    cols = {f"close_sma_{w}_ratio": div(c, F.col(f"_sma_{w}")) for w in ws}
    cols["sma_5_20_ratio"] = div(F.col("_sma_5"), F.col("_sma_20"))
    return with_cols(df, cols).drop(*[f"_sma_{w}" for w in need])


def sma_slope(df: DataFrame, ws=(5, 10, 20, 50), k: int = 5) -> DataFrame:
    """SMA_W - SMA_W k bars earlier."""
    df = with_cols(df, {f"_sma_{w}": sma("close", w) for w in ws})
    df = with_cols(df, {f"sma_slope_{w}": F.col(f"_sma_{w}") - lag(f"_sma_{w}", k) for w in ws})
    return df.drop(*[f"_sma_{w}" for w in ws])


ROLL_FEATURES = ("close", "volume", "returns", "high", "low")


def rolling_pack(df: DataFrame, feats=ROLL_FEATURES, ws=(5, 10, 20), ratios: bool = True) -> DataFrame:
    """E05 (+E06 when ``ratios``): mean, std, min, max, median per feature and window."""
    df = ensure_returns(df)
    cols = {}
    for f in feats:
        for w in ws:
            cols[f"{f}_mean_{w}"] = sma(f, w)
            cols[f"{f}_std_{w}"] = rstd(f, w)
            cols[f"{f}_min_{w}"] = rmin(f, w)
            cols[f"{f}_max_{w}"] = rmax(f, w)
            cols[f"{f}_median_{w}"] = rmedian(f, w)
    df = with_cols(df, cols)
    if ratios:
        df = with_cols(df, rolling_ratio_cols(feats, ws))
    return df


def rolling_ratio_cols(feats=ROLL_FEATURES, ws=(5, 10, 20)) -> dict:
    """X / mean and (x - mean) / std (needs the E05 columns)."""
    out = {}
    for f in feats:
        for w in ws:
            out[f"{f}_ratio_mean_{w}"] = div(F.col(f), F.col(f"{f}_mean_{w}"))
            out[f"{f}_zscore_{w}"] = div(F.col(f) - F.col(f"{f}_mean_{w}"), F.col(f"{f}_std_{w}"))
    return out


def rolling_skew(df: DataFrame, ws=(5, 10, 20), x: str = "close") -> DataFrame:
    """Bias-adjusted skewness of a column (null when the frame is constant)."""
    df = ensure_returns(df) if x == "returns" else df
    cols = {}
    for w in ws:
        g1 = full(F.skewness(col_(x)), x, w)
        sd = full(F.stddev_pop(col_(x)), x, w)
        cols[f"{x}_skew_{w}"] = F.when(sd > 0, g1 * F.lit((w * (w - 1)) ** 0.5 / (w - 2)))
    return with_cols(df, cols)


def volatility(df: DataFrame, ws=(5, 10, 20)) -> DataFrame:
    """Sample std of 1-bar returns."""
    df = ensure_returns(df)
    return with_cols(df, {f"volatility_{w}": rstd("returns", w) for w in ws})


LAG_FEATURES = ("close", "volume", "returns")


def lags(df: DataFrame, feats=LAG_FEATURES, ks=(1, 2, 3, 5, 10)) -> DataFrame:
    """Lagged copies ``<f>_lag_<k>``."""
    if "returns" in feats:
        df = ensure_returns(df)
    return with_cols(df, {f"{f}_lag_{k}": lag(f, k) for f in feats for k in ks if f in df.columns})


def momentum(df: DataFrame, ks=(1, 3, 5, 10, 20), smooth: int = 5) -> DataFrame:
    """K-bar momentum and its 5-bar mean."""
    c, = bar_cols('close')
    df = with_cols(df, {f"momentum_{k}": div(c, lag(c, k)) - 1 for k in ks})
    return with_cols(df, {f"momentum_{k}_sma_{smooth}": sma(f"momentum_{k}", smooth) for k in ks})


def support_resistance(df: DataFrame, w: int = 20) -> DataFrame:
    """W-bar max high / min low and the distance of close to them."""
    c, = bar_cols('close')
    df = with_cols(df, {f"resistance_{w}": rmax("high", w), f"support_{w}": rmin("low", w)})
    return with_cols(df, {f"resistance_distance_{w}": div(F.col(f"resistance_{w}") - c, c),
                          f"support_distance_{w}": div(c - F.col(f"support_{w}"), c)})


def range_position(df: DataFrame, ws=(10, 20), floor: float | None = None) -> DataFrame:
    """(close - min low) / (max high - min low); ``floor`` guards the range."""
    c, = bar_cols('close')
    cols = {}
    for w in ws:
        rng = rmax("high", w) - rmin("low", w)
        if floor is not None:
            rng = F.greatest(rng, F.lit(floor))
        name = f"price_position_{w}" if floor is None else f"price_position_{w}_guarded"
        cols[name] = div(c - rmin("low", w), rng)
    return with_cols(df, cols)


def high_low_ratio(df: DataFrame, ws=(5, 10, 20)) -> DataFrame:
    """E13."""
    return with_cols(df, {f"high_low_ratio_{w}": div(rmax("high", w), rmin("low", w)) for w in ws})


def mean_ranges(df: DataFrame, ws=(5, 10, 14, 20)) -> DataFrame:
    """Mean bar range and mean true range over W."""
    h, l = bar_cols('high', 'low')
    df = with_cols(df, {"_range": h - l, "_tr": true_range_col()})
    df = with_cols(df, {**{f"avg_range_{w}": sma("_range", w) for w in ws},
                        **{f"avg_true_range_{w}": sma("_tr", w) for w in ws}})
    return df.drop("_range", "_tr")


def trend_slope(df: DataFrame, w: int = 20) -> DataFrame:
    """|OLS slope of close on 0..W-1| over the last W bars."""
    c, = bar_cols('close')
    df = df.withColumn("_i", F.row_number().over(win()).cast("double"))
    slope = full(F.regr_slope(c, F.col("_i")), "close", w)
    return df.withColumn(f"trend_strength_{w}", F.abs(slope)).drop("_i")


def trend_vs_atr(df: DataFrame, w: int = 20, atr_w: int = 14) -> DataFrame:
    """|close - SMA20| / ATR14 (Wilder ATR from the scan module)."""
    c, = bar_cols('close')
    from barwise.operators.scan import atr
    df = atr(df, (atr_w,))
    return df.withColumn(f"trend_atr_{w}", div(F.abs(c - sma("close", w)), F.col(f"atr_{atr_w}")))


def price_volume_trend_mean(df: DataFrame, w: int = 5) -> DataFrame:
    """5-bar mean of (close % change x volume % change); undefined changes are 0."""
    c, v = bar_cols('close', 'volume')
    dc = F.coalesce(div(c, lag(c)) - 1, F.lit(0.0))
    dv = F.coalesce(div(v, lag(v)) - 1, F.lit(0.0))
    df = df.withColumn("_pv", dc * dv)
    return df.withColumn(f"volume_price_trend_{w}", sma("_pv", w)).drop("_pv")


def ma_cross(df: DataFrame, fast: int = 5, slow: int = 20) -> DataFrame:
    """Fast SMA above slow SMA, and their relative distance."""
    df = with_cols(df, {"_f": sma("close", fast), "_s": sma("close", slow)})
    return with_cols(df, {"ma_cross_signal": flag(F.col("_f") > F.col("_s")),
                          "ma_distance": div(F.col("_f") - F.col("_s"), F.col("_s"))}).drop("_f", "_s")


def obv_smoothed(df: DataFrame, w: int = 10) -> DataFrame:
    """SMA of on-balance volume, which is added if absent."""
    from barwise.operators.indicators import obv
    if "obv" not in df.columns:
        df = obv(df)
    return df.withColumn(f"obv_sma_{w}", sma("obv", w))
