"""Feature-set composites (I01-I06): staged selects over one bars DataFrame.

Stages follow dependency depth (bars -> frames on bars -> frames on frames); every
stage uses the same (symbol, ts) window, so Catalyst keeps one Exchange and adds only
sorts.  Which rows to trim is a stated column list (never "any null anywhere": some
indicators are undefined by design, e.g. the down-trend SAR in an up-trend).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwise.functions import calendar as D
from barwise.functions import candles as C
from barwise.functions.core import div, flag, lag, sma, with_cols
from barwise.operators import clean as J
from barwise.operators import indicators as G
from barwise.operators import regime as H
from barwise.operators import rolling as E
from barwise.operators import scan as S
from barwise.operators.ranking import exact_quantiles
from barwise.operators.segments import positions, segmented
from barwise.session import ensure_checkpoint_dir

CORE_TRIM = ["sma_20", "ema_12", "rsi_14", "atr_14", "obv", "adx", "macd_signal", "aroon_up"]


def core_set(bars: DataFrame, trim: list[str] | None = CORE_TRIM, with_psar: bool = True,
             skew_safe: bool = True) -> DataFrame:
    """Trend, momentum, volatility, volume, pattern and trend-strength groups.

    Frames, scans and steps of cumulative lines are one pass over (symbol, block) windows; cumulative lines and PSAR
    follow in their block forms.  ``skew_safe=False`` asks for plain per-symbol windows (same results).
    """
    df = _core(bars, with_psar, skew_safe)
    return df.dropna(subset=trim) if trim else df


def _core(bars: DataFrame, with_psar: bool, skew_safe: bool, more=lambda b: b, back: int = 0) -> DataFrame:
    """I01 untrimmed, and ``more`` columns on it that look ``back`` bars further."""
    if skew_safe:
        ensure_checkpoint_dir(bars.sparkSession)
        bars = bars.checkpoint()                # the pass and PSAR read them
        df = segmented(bars, lambda b: more(G.volume_steps(_core_frames(_core_scans(b)))), lookback=CORE_BACK + back)
        df = G.summed_steps(df.checkpoint())    # sums read their rows more than once
    else:
        df = more(_core_frames(G.ad_line(G.vpt(G.obv(_core_scans(bars))))))
    if with_psar:
        from barwise.operators.path import psar
        p = psar(bars, skew_safe=skew_safe)
        df = df.join(p, ["symbol", "ts"], "left")
    return df


def _core_scans(df: DataFrame) -> DataFrame:
    df = S.macd(S.emas(df, "close", [12, 26, 50]))
    df = S.rsi(S.rsi(df, 7), 14)
    return S.adx(S.atr(df, (14, 20)))


#: Bars that the deepest recursion and the deepest frame (52 bars) of I01 look back, one after the other.
CORE_BACK = max(S.ema_memory(50), S.ema_memory(26, 9), S.wilder_memory(14, depth=2), S.wilder_memory(20)) + 52


def _core_frames(df: DataFrame) -> DataFrame:
    """The bounded-frame part of I01 (look-back at most 52 bars)."""
    df = df.withColumns({**E.sma_cols((5, 10, 20, 50)), **C.returns((1,))})
    df = E.price_sma_ratios(df, (5, 20))
    df = G.stochastic(df)
    df = G.williams_r(df, (14,))
    df = G.roc(df, (10, 20))
    df = G.cci(df)
    df = G.bollinger(df)
    df = G.keltner(df)
    df = G.donchian(df)
    df = G.cmf(df)
    df = G.mfi(df)
    df = G.vwap(df)
    df = E.volume_sma(df, (10, 20))
    df = df.withColumns({**C.close_position(), **C.gaps(), **C.doji(), **C.hammer(1), **C.shooting_star(),
                         **C.shadows(), **C.true_range()})
    df = E.momentum(df, (1, 3, 5, 10, 20))
    df = E.support_resistance(df)
    df = G.aroon(df)
    return G.ichimoku(df)


def full_set(bars: DataFrame, trim: list[str] | None = CORE_TRIM, skew_safe: bool = True,
             with_psar: bool = True) -> DataFrame:
    """Core set + calendar + lags + regime + rolling pack + interactions, inf -> null.

    The fitted cleaning steps are :func:`cleaned`.  C17 fractals (next bar) stay out.
    ``skew_safe`` as in :func:`core_set`."""
    # the deepest frame: 50-bar mean of a 20-bar std of returns (70 bars back)
    df = _core(bars, with_psar, skew_safe, lambda b: _full_frames(S.garch_vol(b)), back=70)
    df = df.withColumns({**D.parts(), **D.cyclical(), **D.weekday_flags(), **D.month_flags()})
    num = J.numeric_cols(df)
    df = J.inf_to_null(df, num)
    return df.dropna(subset=trim) if trim else df


def _full_frames(df: DataFrame) -> DataFrame:
    """The bounded-frame part of I02 (look-back at most 70 bars)."""
    df = E.lags(df, ("close", "volume", "returns", "rsi_14", "macd", "bb_position"))
    df = E.rolling_pack(df)
    df = H.price_volume(df)
    df = H.indicator_products(df)
    df = E.ma_cross(df)
    df = E.price_volume_trend_mean(df)
    df = E.range_position(df, (20,), floor=1e-6)
    df = df.withColumns(C.gap_flags_2pct())
    df = H.market_state(df)
    df = H.vol_regime(df)
    df = H.realized_vol(df)
    df = H.vol_cluster(df)
    df = H.jump(df)
    return E.trend_slope(df)


def cleaned(df: DataFrame, cols: list[str] | None = None, fit_where: Column | None = None,
            backward: bool = False) -> DataFrame:
    """The cleaning that follows I02: inf -> null, columns that are mostly null or constant
    dropped, clip, forward fill, medians (then 0) and rescaling of large values.

    Clip bounds and medians are fitted on ``fit_where`` rows.  ``backward`` adds the backward
    fill, which leaks later bars; off, the medians fill what leads a symbol's history.
    """
    cols = cols or J.numeric_cols(df)
    df = J.prune(J.inf_to_null(df, cols), cols)
    cols = [c for c in cols if c in df.columns]
    df = J.ffill(J.clip(df, J.clip_bounds(df, cols, fit_where)), cols)
    if backward:
        df = J.bfill(df, cols)
    return J.rescale_large(J.median_fill(df, cols, fit_where), cols)


#: Bars that I03 and I04 look back: the slowest smoother, or Wilder means, then a mean of 200 and lags.
EXTENDED_BACK = max(S.ema_memory(200), S.ema_memory(39, 9), S.wilder_memory(21)) + 260
SIMPLE_BACK = max(S.ema_memory(100), S.ema_memory(26, 9)) + 130


def extended_set(bars: DataFrame, with_psar: bool = True) -> DataFrame:
    """The multi-setting set (several RSI, MACD, Bollinger, stochastic settings), in (symbol, block) windows."""
    ensure_checkpoint_dir(bars.sparkSession)
    bars = bars.checkpoint()                    # the pass, cumulative lines and PSAR read them
    lines = G.volume_lines_segmented(bars, ("obv", "ad_line")).checkpoint()
    df = segmented(lines, _extended_frames, lookback=EXTENDED_BACK)
    if with_psar:
        from barwise.operators.path import psar
        df = df.join(psar(bars, skew_safe=True).select("symbol", "ts", "psar", "psar_trend"), ["symbol", "ts"], "left")
    return J.inf_to_null(df, J.numeric_cols(df))


def _extended_frames(df: DataFrame) -> DataFrame:
    """I03 on bars that have their cumulative lines."""
    df = df.withColumns(C.returns((1, 2, 3, 5, 10, 20)))
    df = S.emas(df, "close", [5, 10, 20, 50, 100, 200], adjust=True, names=[f"ema_{w}" for w in (5, 10, 20, 50, 100, 200)])
    df = df.withColumns(E.sma_cols((5, 10, 20, 50, 100, 200)))
    c = F.col("close")
    df = with_cols(df, {**{f"close_sma_{w}_ratio": div(c, F.col(f"sma_{w}")) for w in (5, 10, 20, 50, 100, 200)},
                        **{f"close_ema_{w}_ratio": div(c, F.col(f"ema_{w}")) for w in (5, 10, 20, 50, 100, 200)}})
    for n in (7, 14, 21, 30):
        df = S.rsi(df, n, method="sma")
        r = F.col(f"rsi_sma_{n}")
        df = with_cols(df, {f"rsi_sma_{n}_oversold": flag(r < 30), f"rsi_sma_{n}_overbought": flag(r > 70)})
    for f, s, g in ((12, 26, 9), (5, 35, 5), (19, 39, 9)):
        df = S.macd(df, f, s, g, adjust=True)
    for w, k, sfx in ((20, 2.0, "_20_2"), (20, 1.5, "_20_1_5"), (10, 2.0, "_10_2")):
        df = G.bollinger(df, w, k, ddof=1, suffix=sfx)
    df = G.stochastic_slow(df)
    df = G.williams_r(df, (14, 21))
    df = G.roc(df, (5, 10, 20))
    df = S.atr(df, (14, 21), ratio=True)
    df = E.volume_sma(df, (5, 10, 20, 50))
    df = H.volume_return(df)
    df = E.obv_smoothed(df)
    df = E.high_low_ratio(df, (1, 2, 3, 5, 10, 20))
    df = E.support_resistance(df)
    df = E.range_position(df, (20,))
    df = E.range_position(df, (20,), floor=1e-6)
    df = E.trend_vs_atr(df)
    df = df.withColumns({**C.doji(), **C.hammer(2), **C.gap_flags()})
    df = E.rolling_pack(df, ("close",), ratios=False)
    df = E.rolling_skew(df)
    df = E.lags(df, ("rsi_sma_14", "macd_12_26_9_adj", "bb_position_20_2", "volume_ratio_20"), (1, 2, 3, 5))
    # the joint flags read Wilder RSI and the plain MACD, which are not of this set
    return H.joint_signals(df).drop("rsi_14", "macd", "macd_signal", "macd_histogram", "macd_bullish")


def simple_set(bars: DataFrame) -> DataFrame:
    """The dependency-free set (plain means, weight-normalised EMAs, sample std bands), in (symbol, block) windows."""
    return segmented(bars, _simple_frames, lookback=SIMPLE_BACK)


def _simple_frames(bars: DataFrame) -> DataFrame:
    c = F.col("close")
    df = bars.withColumns(C.returns((1, 2, 3, 5, 10, 20)))
    df = df.withColumnRenamed("returns", "return_1")
    df = E.high_low_ratio(df, (1, 2, 3, 5, 10, 20))
    df = E.range_position(df, (1, 2, 3, 5, 10, 20))
    df = S.emas(df, "close", [5, 10, 20, 50, 100], adjust=True, names=[f"ema_{w}" for w in (5, 10, 20, 50, 100)])
    df = df.withColumns(E.sma_cols((5, 10, 20, 50, 100)))
    df = with_cols(df, {**{f"close_sma_{w}_ratio": div(c, F.col(f"sma_{w}")) for w in (5, 10, 20, 50, 100)},
                        **{f"close_ema_{w}_ratio": div(c, F.col(f"ema_{w}")) for w in (5, 10, 20, 50, 100)},
                        **{f"sma_slope_{w}": F.col(f"sma_{w}") - lag(f"sma_{w}", 5) for w in (5, 10, 20, 50, 100)}})
    from barwise.functions.core import rstd
    df = with_cols(df, {f"volatility_{w}": rstd("return_1", w) for w in (5, 10, 20)})
    df = E.mean_ranges(df, (5, 10, 20))
    for n in (7, 14, 21):
        df = S.rsi(df, n, method="sma", name=f"rsi_{n}")
        df = S.rsi_flags(df, n)
    df = S.macd(df, 12, 26, 9, adjust=True, prefix="macd")
    for w in (10, 20):
        df = G.bollinger(df, w, 2.0, ddof=1, suffix=f"_{w}")
    df = E.volume_sma(df, (5, 10, 20))
    df = df.withColumn("volume_price_trend", F.col("volume") * F.col("return_1"))
    df = df.withColumns({**C.shadow_ratios(), **C.doji(), **C.gap_flags(), **C.trend_flags()})
    df = E.support_resistance(df)
    df = E.lags(df, ("rsi_14", "macd", "bb_position_20", "volume_ratio_20"), (1, 2, 3, 5))
    r, bb = F.col("rsi_14"), F.col("bb_position_20")
    return with_cols(df, {"rsi_macd_bullish": flag((r > 50) & (F.col("macd_bullish") == 1)),
                          "volume_momentum": F.col("volume_ratio_20") * F.col("return_1"),
                          "bb_rsi_oversold": flag((bb < 0.2) & (r < 30)),
                          "bb_rsi_overbought": flag((bb > 0.8) & (r > 70))})


#: Feature -> the column it reads and the bars a symbol needs for it.
BASIC = {"returns": ("close", 1), "price_change": ("close", 1), "price_range": ("high", 1),
         "sma_3": ("close", 3), "sma_5": ("close", 5), "sma_10": ("close", 10),
         "volume_sma_3": ("volume", 3), "volume_sma_5": ("volume", 5), "volume_sma_10": ("volume", 10),
         "volatility_5": ("returns", 5), "momentum_3": ("close", 3)}


def basic_set(bars: DataFrame) -> DataFrame:
    """Fallback for short histories: each feature only if the symbol has >= W bars,
    then forward fill, backward fill, 0."""
    from barwise.functions.core import rstd
    c = F.col("close")

    def raw(b: DataFrame) -> DataFrame:
        b = b.withColumns(C.returns((1,)))
        found = {"returns": F.col("returns"), "price_change": c - F.col("open"), "price_range": F.col("high") - F.col("low"),
                 "sma_3": sma("close", 3), "sma_5": sma("close", 5), "sma_10": sma("close", 10),
                 "volume_sma_3": sma("volume", 3), "volume_sma_5": sma("volume", 5), "volume_sma_10": sma("volume", 10),
                 "volatility_5": rstd("returns", 5), "momentum_3": div(c, lag(c, 3)) - 1}
        return b.withColumns({k: F.when(F.col("_n") >= BASIC[k][1], v) for k, v in found.items()})

    df = segmented(positions(bars), raw, lookback=10)
    cols = list(BASIC)
    df = J.bfill(J.ffill(df, cols), cols)
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(0.0)) for k in cols}).drop("_n", "_pos")


def default_for(name: str, close, median_volume):
    """I06 typed defaults for a selected feature the serving frame lacks (tested in order)."""
    n = name.lower()
    if "ma" in n:
        return close
    if "rsi" in n:
        return F.lit(50.0)
    if "volume" in n:
        return median_volume
    if "vol" in n:
        return F.lit(0.01)
    return F.lit(0.0)


def serving_transform(bars: DataFrame, selected: list[str], features: DataFrame) -> DataFrame:
    """The selected features for new bars; absent ones get typed defaults."""
    med = exact_quantiles(bars, ["volume"], [0.5], group=["symbol"]).select("symbol", F.col("value").alias("_medv"))
    df = features.join(med, "symbol", "left")
    cols = {}
    for s in selected:
        cols[s] = F.col(s) if s in features.columns else default_for(s, F.col("close"), F.col("_medv"))
    return df.select("symbol", "ts", *[v.alias(k) for k, v in cols.items()])
