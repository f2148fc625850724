"""Bar arithmetic: returns, ranges, candles, gaps, fractals.

Each builder returns ``{name: Column}``; apply with ``df.withColumns``.  Lags run over
the panel window (per symbol, in time order).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from barwise.functions.core import bar_cols, div, flag, gmax, lag, lead


def returns(ks=(1, 2, 3, 5, 10, 20), col: str = "close") -> dict:
    """K-bar simple returns; ``returns`` is the 1-bar one."""
    x = F.col(col)
    out = {}
    for k in ks:
        out["returns" if k == 1 else f"return_{k}"] = div(x, lag(x, k)) - 1
    return out


def log_returns() -> dict:
    """C02."""
    c, = bar_cols('close')
    return {"log_returns": F.log(div(c, lag(c)))}


def price_change() -> dict:
    """C03."""
    o, h, l, c = bar_cols('open', 'high', 'low', 'close')
    return {"price_change": c - o, "price_range": h - l}


def shadows() -> dict:
    """C04."""
    o, h, l, c = bar_cols('open', 'high', 'low', 'close')
    return {"upper_shadow": h - F.greatest(o, c), "lower_shadow": F.least(o, c) - l,
            "body_size": F.abs(c - o), "total_range": h - l}


def shadow_ratios() -> dict:
    """Body and shadows relative to the bar range (flat bar -> null)."""
    o, h, l, c = bar_cols('open', 'high', 'low', 'close')
    rng = h - l
    return {"body_ratio": div(F.abs(c - o), rng), "upper_shadow_ratio": div(h - F.greatest(o, c), rng),
            "lower_shadow_ratio": div(F.least(o, c) - l, rng)}


def close_position() -> dict:
    """Close in the day's range; flat bar -> 0.5."""
    h, l, c = bar_cols('high', 'low', 'close')
    return {"price_position_day": F.coalesce(div(c - l, h - l), F.lit(0.5))}


def volume_change() -> dict:
    """C07."""
    c, v = bar_cols('close', 'volume')
    return {"volume_change": div(v, lag(v)) - 1, "traded_value": c * v}


def gaps() -> dict:
    """C08."""
    o, c = bar_cols('open', 'close')
    pc = lag(c)
    return {"gap": o - pc, "gap_pct": div(o - pc, pc)}


def gap_flags() -> dict:
    """Plain gap up/down flags."""
    o, c = bar_cols('open', 'close')
    pc = lag(c)
    return {"gap_up": flag(o > pc), "gap_down": flag(o < pc)}


def gap_flags_2pct(th: float = 0.02) -> dict:
    """Gap flags that also need |open - previous close| > 2 % of it."""
    o, c = bar_cols('open', 'close')
    pc = lag(c)
    big = F.abs(o - pc) > F.lit(th) * pc
    return {"gap_up_2pct": flag((o > pc) & big), "gap_down_2pct": flag((o < pc) & big)}


def intraday_overnight() -> dict:
    """C11."""
    o, c = bar_cols('open', 'close')
    pc = lag(c)
    return {"intraday_return": div(c - o, o), "overnight_return": div(o - pc, pc)}


def doji(th: float = 0.1) -> dict:
    """Body under 10 % of the range."""
    o, h, l, c = bar_cols('open', 'high', 'low', 'close')
    return {"doji": flag(div(F.abs(c - o), h - l) < th)}


def hammer(variant: int = 1) -> dict:
    """Variant 1 by shadows vs body; variant 2 bullish with long lower part."""
    o, h, l, c = bar_cols('open', 'high', 'low', 'close')
    body = F.abs(c - o)
    upper = h - F.greatest(o, c)
    lower = F.least(o, c) - l
    if variant == 1:
        return {"hammer": flag((lower > 2 * body) & (upper < body))}
    return {"hammer_v2": flag((c > o) & ((o - l) > 2 * (c - o)))}


def shooting_star() -> dict:
    """C14."""
    o, h, l, c = bar_cols('open', 'high', 'low', 'close')
    body = F.abs(c - o)
    upper = h - F.greatest(o, c)
    lower = F.least(o, c) - l
    return {"shooting_star": flag((upper > 2 * body) & (lower < body))}


def true_range_col():
    """True range; null on the first bar (no previous close)."""
    h, l, c = bar_cols('high', 'low', 'close')
    pc = lag(c)
    return gmax(h - l, F.abs(h - pc), F.abs(l - pc))


def true_range() -> dict:
    return {"true_range": true_range_col()}


def trend_flags(ks=(5, 10, 20)) -> dict:
    """C16."""
    c, = bar_cols('close')
    return {f"trend_{k}": flag(c > lag(c, k)) for k in ks}


def fractals() -> dict:
    """C17: local max/min using the next bar (leaks the future by one bar)."""
    h, l = bar_cols('high', 'low')
    lmax = flag((h > lag(h)) & (h > lead(h)))
    lmin = flag((l < lag(l)) & (l < lead(l)))
    return {"local_max": lmax, "local_min": lmin, "fractal_score": lmax - lmin}
