"""Recursive smoothers as a blocked linear scan in pure window SQL.

EMA, Wilder means and everything built on them (MACD, RSI, ATR, ADX, GARCH-like
volatility) are first-order linear recurrences ``y_j = q*y_{j-1} + a*x_j`` started at a
seed row ``j = 0`` with ``y_0 = w0*x_0``.  A sequential fold would make one task per
symbol and a Python loop; instead:

1. number the rows from the seed: ``j``; cut blocks of ``K = ceil(40 / -ln q)`` rows, so
   ``q^K < 1e-17`` (a block further back no longer changes a double);
2. inside a block ``loc_j = q^jj * sum_{i<=j} wt_i x_i q^-jj_i`` is a running sum over
   the window ``(symbol, blk) ORDER BY jj`` (``q^-jj <= e^40``: no overflow);
3. the value entering a block is the previous block's last ``loc`` (a running
   last-non-null over the symbol, no join); ``y = loc + carry * q^(jj+1)``.

All windows share the panel's partitioning, so a chain of scans adds sorts but no
exchange.  Accuracy: relative error ~1e-15 against the sequential recursion.

In ``segments.segmented`` the panel is cut into (symbol, block) and every block reads the rows that
its scans remember (:func:`memory`) before its own: no carry, no join and no checkpoint, however deep
the chain.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwise.functions.candles import true_range_col
from barwise.functions.core import (c as col_, div, flag, gmax, lag, part_cols, sma, win,
                                    with_cols)


def block_len(q: float) -> int:
    return max(1, math.ceil(40.0 / -math.log(q)))


def linear_scan(df: DataFrame, name: str, x: str, q: float, a: float, seed: Column,
                seed_value: Column | None = None, seed_weight: float = 1.0,
                normalise: bool = False, min_j: int = 0) -> DataFrame:
    """Add column ``name`` = recurrence of ``x`` from the first row where ``seed`` holds.

    * ``seed_value``: value used on the seed row instead of ``x`` (Wilder: mean of the first W)
    * ``seed_weight``: weight of the seed value (1 = start at x0; ``a`` with ``normalise``
      gives the weight-normalised EMA ``sum a q^k x / sum a q^k``)
    * ``min_j``: null for rows ``j < min_j`` (warm-up)
    """
    return linear_scans(df, x, seed, [(name, q, a, seed_weight, normalise, min_j)], seed_value)


# |ln q| * block length must stay below this, so q^-jj stays far inside double range
_MAX_EXP = 600.0


def _groups(specs):
    """Group recurrences that can share one block length."""
    out, cur = [], []
    for sp in sorted(specs, key=lambda t: t[1], reverse=True):     # q descending: longest blocks first
        trial = cur + [sp]
        k = max(block_len(t[1]) for t in trial)
        if all(k * -math.log(t[1]) <= _MAX_EXP for t in trial):
            cur = trial
        else:
            out.append(cur)
            cur = [sp]
    if cur:
        out.append(cur)
    return out


def linear_scans(df: DataFrame, x: str, seed: Column, specs, seed_value: Column | None = None) -> DataFrame:
    """Several recurrences of the same input and seed in one pass.

    ``specs`` = [(name, q, a, seed_weight, normalise, min_j), ...].  Recurrences whose block
    lengths are compatible share the block windows, so e.g. the fast and slow EMAs of MACD
    cost one sort and one window pass instead of two.
    """
    parts = list(part_cols())
    w = win()
    tmp = df.withColumns({"_rn": F.row_number().over(w), "_seed": seed,
                          "_sv": seed_value if seed_value is not None else col_(x)})
    seed_rn = F.min(F.when(F.col("_seed"), F.col("_rn"))).over(Window.partitionBy(*parts))
    tmp = tmp.withColumn("_j", F.col("_rn") - seed_rn)
    j = F.col("_j")
    u = F.when(j == 0, F.col("_sv")).otherwise(col_(x))
    prev = Window.partitionBy(*parts).orderBy("_j").rowsBetween(Window.unboundedPreceding, -1)
    for gi, group in enumerate(_groups(specs)):
        K = max(block_len(t[1]) for t in group)
        tmp = tmp.withColumns({"_run": F.floor(j / K), "_jj": F.pmod(j, F.lit(K))})
        jj = F.col("_jj").cast("double")
        wb = Window.partitionBy(*parts, "_run").orderBy("_jj").rowsBetween(Window.unboundedPreceding, 0)
        locs = {}
        for name, q, a, sw, _norm, _mj in group:
            wt = F.when(j == 0, F.lit(sw)).otherwise(F.lit(a))
            term = F.when(j >= 0, wt * u * F.pow(F.lit(q), -jj))
            locs[f"_loc_{name}"] = F.pow(F.lit(q), jj) * F.sum(term).over(wb)
        tmp = tmp.withColumns(locs)
        # value entering a block = last loc of the previous (complete) block; a running
        # "last non-null" over the symbol's rows, so no self-join and no lineage doubling
        tmp = tmp.withColumns({f"_carry_{name}": F.last(F.when(F.col("_jj") == K - 1, F.col(f"_loc_{name}")),
                                                        ignorenulls=True).over(prev)
                               for name, *_ in group})
        outs = {}
        for name, q, a, sw, norm, mj in group:
            y = F.col(f"_loc_{name}") + F.coalesce(F.col(f"_carry_{name}"), F.lit(0.0)) * F.pow(F.lit(q), jj + 1)
            if norm:
                y = y / (1 - F.pow(F.lit(q), j.cast("double") + 1))
            outs[name] = F.when(j >= mj, y)
        tmp = tmp.withColumns(outs).drop(*[f"_loc_{t[0]}" for t in group], *[f"_carry_{t[0]}" for t in group])
    return tmp.drop("_rn", "_seed", "_sv", "_j", "_run", "_jj")


def _first_nonnull(x) -> Column:
    """True on the first row of the symbol where x is not null."""
    return col_(x).isNotNull() & (F.count(col_(x)).over(win().rowsBetween(Window.unboundedPreceding, 0)) == 1)


def _nth_nonnull(x, n: int) -> Column:
    return col_(x).isNotNull() & (F.count(col_(x)).over(win().rowsBetween(Window.unboundedPreceding, 0)) == n)


# ---------------------------------------------------------------- F01 / F02
def ema(df: DataFrame, x: str, span: int | None = None, name: str | None = None,
        adjust: bool = False, alpha: float | None = None, warmup: bool = True) -> DataFrame:
    """F01 (``adjust=False``: y0 = x0, null for the first W-1 values) and
    F02 (``adjust=True``: weight-normalised, no warm-up null)."""
    a = alpha if alpha is not None else 2.0 / (span + 1)
    q = 1.0 - a
    name = name or (f"ema_{span}" if not adjust else f"ema_adj_{span}")
    if adjust:
        return linear_scan(df, name, x, q, a, _first_nonnull(x), seed_weight=a, normalise=True)
    return linear_scan(df, name, x, q, a, _first_nonnull(x), seed_weight=1.0,
                       min_j=(span - 1) if (warmup and span) else 0)


def emas(df: DataFrame, x: str, spans, adjust: bool = False, names=None, warmup: bool = True) -> DataFrame:
    """Several EMAs of one column in one pass (shared seed and block windows)."""
    names = names or [(f"ema_{s}" if not adjust else f"ema_adj_{s}") for s in spans]
    specs = []
    for s_, nm in zip(spans, names):
        a = 2.0 / (s_ + 1)
        if adjust:
            specs.append((nm, 1.0 - a, a, a, True, 0))
        else:
            specs.append((nm, 1.0 - a, a, 1.0, False, (s_ - 1) if warmup else 0))
    return linear_scans(df, x, _first_nonnull(x), specs)


def wilder(df: DataFrame, x: str, n: int, name: str) -> DataFrame:
    """Wilder mean: null until the n-th non-null x; there the mean of the first n;
    then ``((n-1)*prev + x)/n``."""
    seed = _nth_nonnull(x, n)
    seed_val = F.avg(col_(x)).over(win().rowsBetween(Window.unboundedPreceding, 0))
    return linear_scan(df, name, x, (n - 1) / n, 1.0 / n, seed, seed_value=seed_val)


# ---------------------------------------------------------------- F03 RSI
def rsi(df: DataFrame, n: int = 14, method: str = "wilder", name: str | None = None) -> DataFrame:
    """RSI by ``wilder`` (recursive), ``sma`` (plain means) or ``pct`` (%-change form)."""
    name = name or (f"rsi_{n}" if method == "wilder" else f"rsi_{method}_{n}")
    c = F.col("close")
    if method == "pct":
        r = div(c, lag(c)) - 1
        df = with_cols(df, {"_g": F.when(r.isNotNull(), F.when(r > 0, r).otherwise(0.0)),
                            "_b": F.when(r.isNotNull(), F.when(r < 0, -r).otherwise(0.0))})
        g, b = sma("_g", n), sma("_b", n)
        df = df.withColumn(name, 100 - 100 / (1 + g / (b + F.lit(1e-8))))
        return df.drop("_g", "_b")
    d = c - lag(c)
    if method == "sma":
        # the mean form replaces the undefined first change by 0 (``where(delta > 0, 0)``)
        df = with_cols(df, {"_g": F.when(d > 0, d).otherwise(0.0), "_b": F.when(d < 0, -d).otherwise(0.0)})
    else:
        df = with_cols(df, {"_g": gmax(d, F.lit(0.0)), "_b": gmax(-d, F.lit(0.0))})
    if method == "sma":
        df = with_cols(df, {"_gm": sma("_g", n), "_bm": sma("_b", n)})
        val = (F.when(F.col("_bm") > 0, 100 - 100 / (1 + F.col("_gm") / F.col("_bm")))
               .when(F.col("_gm") > 0, F.lit(100.0)))
    else:
        df = wilder(df, "_g", n, "_gm")
        df = wilder(df, "_b", n, "_bm")
        val = F.when(F.col("_bm") > 0, 100 - 100 / (1 + F.col("_gm") / F.col("_bm"))) \
               .when(F.col("_gm").isNotNull(), F.lit(100.0))
    return df.withColumn(name, val).drop("_g", "_b", "_gm", "_bm")


def rsi_flags(df: DataFrame, n: int = 14, lo: float = 30, hi: float = 70) -> DataFrame:
    r = F.col(f"rsi_{n}")
    return with_cols(df, {f"rsi_{n}_oversold": flag(r < lo), f"rsi_{n}_overbought": flag(r > hi)})


# ---------------------------------------------------------------- F04 / F05 MACD
def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, adjust: bool = False,
         prefix: str | None = None) -> DataFrame:
    """line = EMA fast - EMA slow; signal = EMA of the line; histogram; bullish flag."""
    p = prefix or ("macd" if (fast, slow, signal) == (12, 26, 9) and not adjust
                   else f"macd_{fast}_{slow}_{signal}" + ("_adj" if adjust else ""))
    df = emas(df, "close", [fast, slow], adjust=adjust, names=["_ef", "_es"])
    df = df.withColumn(p, F.col("_ef") - F.col("_es")).drop("_ef", "_es")
    df = ema(df, p, signal, f"{p}_signal", adjust=adjust)
    return with_cols(df, {f"{p}_histogram": F.col(p) - F.col(f"{p}_signal"),
                          f"{p}_bullish": flag(F.col(p) > F.col(f"{p}_signal"))})


def close_ema_ratio(df: DataFrame, spans=(5, 10, 20, 50)) -> DataFrame:
    """close / weight-normalised EMA."""
    df = emas(df, "close", list(spans), adjust=True)
    return with_cols(df, {f"close_ema_{s}_ratio": div(F.col("close"), F.col(f"ema_adj_{s}")) for s in spans})


# ---------------------------------------------------------------- F06 / F07
def atr(df: DataFrame, ns=(14,), ratio: bool = False) -> DataFrame:
    """Wilder ATR of the true range (first value on bar n+1); optional ATR / close."""
    df = df.withColumn("_tr", true_range_col())
    for n in ns:
        df = wilder(df, "_tr", n, f"atr_{n}")
        if ratio:
            df = df.withColumn(f"atr_{n}_ratio", div(F.col(f"atr_{n}"), F.col("close")))
    return df.drop("_tr")


def adx(df: DataFrame, n: int = 14) -> DataFrame:
    """+DI, -DI and ADX from Wilder-smoothed directional movement."""
    h, l = F.col("high"), F.col("low")
    up = h - lag(h)
    dn = lag(l) - l
    df = with_cols(df, {
        "_tr": true_range_col(),
        "_pdm": F.when(up.isNotNull(), F.when((up > dn) & (up > 0), up).otherwise(0.0)),
        "_mdm": F.when(dn.isNotNull(), F.when((dn > up) & (dn > 0), dn).otherwise(0.0))})
    df = wilder(df, "_tr", n, "_atr")
    df = wilder(df, "_pdm", n, "_ps")
    df = wilder(df, "_mdm", n, "_ms")
    df = with_cols(df, {"adx_pos": 100 * div("_ps", "_atr"), "adx_neg": 100 * div("_ms", "_atr")})
    s = F.col("adx_pos") + F.col("adx_neg")
    df = df.withColumn("_dx", F.when(s == 0, F.lit(0.0)).otherwise(
        100 * div(F.abs(F.col("adx_pos") - F.col("adx_neg")), s)))
    df = wilder(df, "_dx", n, "adx")
    return df.drop("_tr", "_pdm", "_mdm", "_atr", "_ps", "_ms", "_dx")


# ---------------------------------------------------------------- F09
def garch_vol(df: DataFrame, alpha: float = 0.1) -> DataFrame:
    """weight-normalised EWM (alpha 0.1) of squared returns from the first return."""
    c = F.col("close")
    df = df.withColumn("returns_squared", F.pow(div(c, lag(c)) - 1, 2))
    return ema(df, "returns_squared", None, "garch_vol", adjust=True, alpha=alpha)


# ---------------------------------------------------------------- skew-safe form
def memory(*qs: float, seed: int = 1) -> int:
    """Rows after which recurrences with these decays, each over the one before, no longer show how they began.

    A block that reads so many earlier rows may begin its scans there: what the true start would add
    weighs less than a double shows.  Inputs that are null in all but fewer than ``seed`` of these rows
    start anew, as at the head of a symbol.
    """
    return sum(block_len(q) + seed for q in qs)


def _decay(span: int) -> float:
    return 1.0 - 2.0 / (span + 1)


def wilder_memory(n: int, depth: int = 1) -> int:
    """Look-back of Wilder means of ``n`` (of means of means: ``depth``) over bar changes."""
    return 1 + memory(*[(n - 1) / n] * depth, seed=n)


def ema_memory(*spans: int) -> int:
    """Look-back of an EMA, or of EMAs each over the one before."""
    return memory(*map(_decay, spans), seed=max(spans))


def _segmented(df: DataFrame, fn, lookback: int) -> DataFrame:
    from barwise.operators.segments import segmented
    return segmented(df, fn, lookback)


def emas_segmented(df: DataFrame, x: str, spans, adjust: bool = False, names=None) -> DataFrame:
    """:func:`emas` in the skew-safe form."""
    return _segmented(df, lambda b: emas(b, x, spans, adjust, names), ema_memory(max(spans)))


def wilder_segmented(df: DataFrame, x: str, n: int, name: str) -> DataFrame:
    """:func:`wilder` in the skew-safe form."""
    return _segmented(df, lambda b: wilder(b, x, n, name), wilder_memory(n))


def macd_segmented(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, adjust: bool = False) -> DataFrame:
    """:func:`macd` in the skew-safe form."""
    return _segmented(df, lambda b: macd(b, fast, slow, signal, adjust), ema_memory(max(fast, slow), signal))


def rsi_segmented(df: DataFrame, n: int = 14, name: str | None = None) -> DataFrame:
    """:func:`rsi` (Wilder) in the skew-safe form."""
    return _segmented(df, lambda b: rsi(b, n, name=name), wilder_memory(n))


def atr_segmented(df: DataFrame, n: int = 14) -> DataFrame:
    """:func:`atr` in the skew-safe form."""
    return _segmented(df, lambda b: atr(b, (n,)), wilder_memory(n))


def adx_segmented(df: DataFrame, n: int = 14) -> DataFrame:
    """:func:`adx` in the skew-safe form."""
    return _segmented(df, lambda b: adx(b, n), wilder_memory(n, depth=2))


def garch_vol_segmented(df: DataFrame, alpha: float = 0.1) -> DataFrame:
    """:func:`garch_vol` in the skew-safe form."""
    return _segmented(df, lambda b: garch_vol(b, alpha), 1 + memory(1.0 - alpha))
