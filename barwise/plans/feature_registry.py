"""Feature registry with warm-ups, and warm-up-aware range reads.

A request for features on ``[start, end]`` reads bars from ``start`` minus the largest
warm-up of the requested features (as a time margin from the bar interval), computes,
and trims to ``[start, end]``.  The time filter is on the bar key, so it is pushed to
the scan (and through the bar aggregation into the tick scan).  Symbols without
enough bars inside the margin (gaps, a history starting inside it) are re-read with
a wider margin, and after three widenings from their whole history, so the result
always equals the full-history computation.

Recursive features carry their start forever; their warm-up is the number of bars
after which the start's weight drops below double precision (``ceil(40 / -ln q)``
past the seed), so the range result equals the full-history one to double precision.
Cumulative features (OBV, VPT, A/D) and leaking ones are not range-readable.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwise.functions.core import sma
from barwise.operators import scan as S


def _ema_warmup(span: int) -> int:
    return span + math.ceil(40.0 / -math.log(1 - 2.0 / (span + 1)))


def _wilder_warmup(n: int) -> int:
    return n + 1 + math.ceil(40.0 / -math.log((n - 1) / n))


@dataclass(frozen=True)
class Feature:
    name: str
    build: Callable[[DataFrame], DataFrame]
    warmup: int              # bars needed before the first wanted bar
    leaks: bool = False      # uses later bars (never range-read, excluded by default)
    cumulative: bool = False  # depends on the whole history


def _col(name, expr_fn):
    return lambda df: df.withColumn(name, expr_fn())


REGISTRY: dict[str, Feature] = {}


def register(f: Feature) -> None:
    REGISTRY[f.name] = f


for _w in (5, 10, 20, 50, 100, 200):
    register(Feature(f"sma_{_w}", _col(f"sma_{_w}", lambda w=_w: sma("close", w)), _w - 1))
for _s in (12, 26, 50):
    register(Feature(f"ema_{_s}", lambda df, s=_s: S.ema(df, "close", s), _ema_warmup(_s)))
for _n in (14,):
    register(Feature(f"rsi_{_n}", lambda df, n=_n: S.rsi(df, n), _wilder_warmup(_n)))
    register(Feature(f"atr_{_n}", lambda df, n=_n: S.atr(df, (n,)), _wilder_warmup(_n)))
register(Feature("macd", lambda df: S.macd(df), _ema_warmup(26) + _ema_warmup(9)))


def features(bars: DataFrame, names: list[str], start: dt.datetime, end: dt.datetime,
             bar_interval: dt.timedelta = dt.timedelta(days=1), margin_factor: float = 2.0) -> DataFrame:
    """Features ``names`` for bars in ``[start, end]`` reading only the needed history."""
    feats = [REGISTRY[n] for n in names]
    bad = [f.name for f in feats if f.leaks or f.cumulative]
    if bad:
        raise ValueError(f"not range-readable: {bad}")
    warm = max(f.warmup for f in feats)
    lo = start - bar_interval * int(math.ceil(warm * margin_factor))

    def compute(df: DataFrame) -> DataFrame:
        for f in feats:
            df = f.build(df)
        return df

    def window(lo_k):
        return bars.filter((F.col("ts") >= F.lit(lo_k)) & (F.col("ts") <= F.lit(end)))

    def short_of(rows, candidates=None):
        """Symbols with fewer than `warm` bars before `start` in `rows`."""
        cnt = rows.filter(F.col("ts") < F.lit(start)).groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))
        syms = rows.select("symbol").distinct() if candidates is None else candidates
        return syms.join(cnt, "symbol", "left").filter(F.coalesce(F.col("_n"), F.lit(0)) < warm).select("symbol")

    part = window(lo)
    short = short_of(part)
    outs = [compute(part.join(short, "symbol", "left_anti"))]
    # gaps or a history that starts inside the margin: widen the read for those symbols only
    # (x4 per round); after three rounds the remaining ones use their whole history
    lo_k = lo
    for _ in range(3):
        if short.isEmpty():
            break
        lo_k = start - (start - lo_k) * 4
        wide = window(lo_k).join(short, "symbol", "left_semi")
        still = short_of(wide, short)
        outs.append(compute(wide.join(still, "symbol", "left_anti")))
        short = still
    if not short.isEmpty():
        outs.append(compute(bars.filter(F.col("ts") <= F.lit(end)).join(short, "symbol", "left_semi")))
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out.filter(F.col("ts") >= F.lit(start)).select("symbol", "ts", *names)
