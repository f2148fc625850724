"""Named indicators on frames (G01-G15) by their published definitions.

Rolling frames follow the full-frame rule (null until W non-null inputs); cumulative
ones (OBV, VPT, A/D) run over the symbol's whole history in time order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwise.functions.core import (bar_cols, cum, div, flag, frame, lag, nfull, rmax, rmin, rn,
                                    rstd, rsum, sma, with_cols)



def stochastic(df: DataFrame, k: int = 14, d: int = 3) -> DataFrame:
    """G01 fast: %K = 100 (c - LL) / (HH - LL) over k bars; %D = SMA_d of %K."""
    c, = bar_cols('close')
    df = df.withColumn(f"stoch_k_{k}", 100 * div(c - rmin("low", k), rmax("high", k) - rmin("low", k)))
    return df.withColumn(f"stoch_d_{k}", sma(f"stoch_k_{k}", d))


def stochastic_slow(df: DataFrame, settings=((14, 3), (21, 5), (5, 3))) -> DataFrame:
    """G01 slow: K = mean of d fast %K, D = mean of d K; cross flag K > D."""
    c, = bar_cols('close')
    for k, d in settings:
        fast = f"_fk_{k}_{d}"
        df = df.withColumn(fast, 100 * div(c - rmin("low", k), rmax("high", k) - rmin("low", k)))
        df = df.withColumn(f"stoch_slowk_{k}_{d}", sma(fast, d))
        df = df.withColumn(f"stoch_slowd_{k}_{d}", sma(f"stoch_slowk_{k}_{d}", d))
        df = df.withColumn(f"stoch_cross_{k}_{d}",
                           flag(F.col(f"stoch_slowk_{k}_{d}") > F.col(f"stoch_slowd_{k}_{d}"))).drop(fast)
    return df


def williams_r(df: DataFrame, ws=(14, 21)) -> DataFrame:
    """G02."""
    c, = bar_cols('close')
    return with_cols(df, {f"williams_r_{w}": -100 * div(rmax("high", w) - c, rmax("high", w) - rmin("low", w))
                          for w in ws})


def roc(df: DataFrame, ns=(5, 10, 20)) -> DataFrame:
    """G03."""
    c, = bar_cols('close')
    return with_cols(df, {f"roc_{n}": 100 * (div(c, lag(c, n)) - 1) for n in ns})


def cci(df: DataFrame, w: int = 20) -> DataFrame:
    """(tp - SMA tp) / (0.015 * mean absolute deviation about the window mean)."""
    h, l, c = bar_cols('high', 'low', 'close')
    TP = (h + l + c) / 3
    df = df.withColumn("_tp", TP)
    df = with_cols(df, {"_tpm": sma("_tp", w), "_tpl": F.collect_list("_tp").over(frame(w))})
    mad = F.aggregate("_tpl", F.lit(0.0), lambda acc, x: acc + F.abs(x - F.col("_tpm"))) / w
    return df.withColumn(f"cci_{w}", div(F.col("_tp") - F.col("_tpm"), 0.015 * mad)).drop("_tp", "_tpm", "_tpl")


def bollinger(df: DataFrame, w: int = 20, k: float = 2.0, ddof: int = 0, suffix: str = "") -> DataFrame:
    """Middle, upper, lower, width, position (and squeeze = width / middle)."""
    c, = bar_cols('close')
    s = suffix
    df = with_cols(df, {f"bb_middle{s}": sma("close", w), "_sd": rstd("close", w, ddof)})
    m, sd = F.col(f"bb_middle{s}"), F.col("_sd")
    df = with_cols(df, {f"bb_upper{s}": m + k * sd, f"bb_lower{s}": m - k * sd})
    up, lo = F.col(f"bb_upper{s}"), F.col(f"bb_lower{s}")
    cols = {f"bb_position{s}": div(c - lo, up - lo)}
    if s:
        cols[f"bb_squeeze{s}"] = div(up - lo, m)
    else:
        cols["bb_width"] = up - lo
    return with_cols(df, cols).drop("_sd")


def keltner(df: DataFrame, w: int = 20) -> DataFrame:
    """Typical-price form of the Keltner channel."""
    h, l, c = bar_cols('high', 'low', 'close')
    TP = (h + l + c) / 3
    df = with_cols(df, {"_m": TP, "_u": (4 * h - 2 * l + c) / 3, "_d": (-2 * h + 4 * l + c) / 3})
    return with_cols(df, {"kc_middle": sma("_m", w), "kc_upper": sma("_u", w),
                          "kc_lower": sma("_d", w)}).drop("_m", "_u", "_d")


def donchian(df: DataFrame, w: int = 20) -> DataFrame:
    """G07."""
    df = with_cols(df, {"dc_upper": rmax("high", w), "dc_lower": rmin("low", w)})
    return df.withColumn("dc_middle", (F.col("dc_upper") + F.col("dc_lower")) / 2)


def aroon(df: DataFrame, w: int = 25) -> DataFrame:
    """100 (w - bars since the latest w+1-bar extreme) / w."""
    h, l = bar_cols('high', 'low')
    df = df.withColumn("_rn", rn())
    n = w + 1
    hi_at = F.max_by(F.col("_rn"), F.struct(h, F.col("_rn"))).over(frame(n))
    lo_at = F.max_by(F.col("_rn"), F.struct(-l, F.col("_rn"))).over(frame(n))
    ok = nfull("high", n) & nfull("low", n)
    df = with_cols(df, {"aroon_up": F.when(ok, 100.0 * (w - (F.col("_rn") - hi_at)) / w),
                        "aroon_down": F.when(ok, 100.0 * (w - (F.col("_rn") - lo_at)) / w)})
    return df.withColumn("aroon_oscillator", F.col("aroon_up") - F.col("aroon_down")).drop("_rn")


def ichimoku(df: DataFrame, conv: int = 9, base: int = 26, span_b: int = 52) -> DataFrame:
    """Unshifted conversion, base, span A, span B."""
    def mid(w):
        return (rmax("high", w) + rmin("low", w)) / 2
    df = with_cols(df, {"ichimoku_conversion": mid(conv), "ichimoku_base": mid(base),
                        "ichimoku_b": mid(span_b)})
    return df.withColumn("ichimoku_a", (F.col("ichimoku_conversion") + F.col("ichimoku_base")) / 2)


def vwap(df: DataFrame, w: int = 14) -> DataFrame:
    """Rolling volume-weighted typical price."""
    h, l, c, v = bar_cols('high', 'low', 'close', 'volume')
    TP = (h + l + c) / 3
    df = df.withColumn("_tpv", TP * v)
    return df.withColumn(f"vwap_{w}", div(rsum("_tpv", w), rsum("volume", w))).drop("_tpv")


def obv(df: DataFrame) -> DataFrame:
    """Cumulative signed volume, 0 when unchanged, first bar 0."""
    c, v = bar_cols('close', 'volume')
    step = F.coalesce(F.signum(c - lag(c)) * v, F.lit(0.0))
    return df.withColumn("_obv", step).withColumn("obv", F.sum("_obv").over(cum())).drop("_obv")


def vpt(df: DataFrame) -> DataFrame:
    """Cumulative volume x return, first bar 0."""
    c, v = bar_cols('close', 'volume')
    step = F.coalesce(v * (div(c, lag(c)) - 1), F.lit(0.0))
    return df.withColumn("_vpt", step).withColumn("vpt", F.sum("_vpt").over(cum())).drop("_vpt")


def _mfv():
    h, l, c, v = bar_cols('high', 'low', 'close', 'volume')
    return F.coalesce(v * div((c - l) - (h - c), h - l), F.lit(0.0))


def ad_line(df: DataFrame) -> DataFrame:
    """accumulation/distribution line (flat bar contributes 0)."""
    return df.withColumn("_mfv", _mfv()).withColumn("ad_line", F.sum("_mfv").over(cum())).drop("_mfv")


def cmf(df: DataFrame, w: int = 20) -> DataFrame:
    """Chaikin money flow."""
    df = df.withColumn("_mfv", _mfv())
    return df.withColumn(f"cmf_{w}", div(rsum("_mfv", w), rsum("volume", w))).drop("_mfv")


def mfi(df: DataFrame, w: int = 14) -> DataFrame:
    """Money flow index; no negative flow -> 100."""
    h, l, c, v = bar_cols('high', 'low', 'close', 'volume')
    TP = (h + l + c) / 3
    ptp = lag(TP)
    mf = TP * v
    df = with_cols(df, {"_pos": F.when(ptp.isNotNull(), F.when(TP > ptp, mf).otherwise(0.0)),
                        "_neg": F.when(ptp.isNotNull(), F.when(TP < ptp, mf).otherwise(0.0))})
    P, N = rsum("_pos", w), rsum("_neg", w)
    val = F.when(N == 0, F.when(P.isNotNull(), F.lit(100.0))).otherwise(100 - 100 / (1 + div(P, N)))
    return df.withColumn(f"mfi_{w}", val).drop("_pos", "_neg")



# ---------------------------------------------------------------- skew-safe cumulative forms
def volume_steps(df: DataFrame) -> DataFrame:
    """What each bar adds to OBV, VPT and the A/D line (one bar back)."""
    c, v = bar_cols("close", "volume")
    return with_cols(df, {"_st_obv": F.coalesce(F.signum(c - lag(c)) * v, F.lit(0.0)),
                          "_st_vpt": F.coalesce(v * (div(c, lag(c)) - 1), F.lit(0.0)), "_st_ad_line": _mfv()})


def summed_steps(df: DataFrame, lines=("obv", "vpt", "ad_line")) -> DataFrame:
    """Running sums of steps over each symbol's history without a per-symbol window: bucket offsets
    and in-bucket windows of the ordered cumulative sum."""
    from barwise.operators.ranking import ordered_cumsum
    out = ordered_cumsum(df, ["symbol"], ["ts"], {k: F.col(f"_st_{k}") for k in lines})
    return out.withColumnsRenamed({f"cum_{k}": k for k in lines}).drop("_st_obv", "_st_vpt", "_st_ad_line", *[f"tot_{k}" for k in lines])


def volume_lines_segmented(df: DataFrame, lines=("obv", "vpt", "ad_line")) -> DataFrame:
    """G11-G13 (OBV, VPT, A/D line) in the skew-safe form."""
    from barwise.operators.segments import segmented
    return summed_steps(segmented(df, volume_steps, lookback=1), lines)
