"""Calendar parts and cyclical encodings."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from barwise.functions.core import bar_cols


def parts() -> dict:
    """Year, month, day, day of week (Monday = 0), day of year, ISO week, quarter."""
    ts, = bar_cols('ts')
    return {"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts),
            "day_of_week": F.weekday(ts), "day_of_year": F.dayofyear(ts),
            "week_of_year": F.weekofyear(ts), "quarter": F.quarter(ts)}


def cyclical() -> dict:
    """sin/cos of month/12, day-of-week/7, day-of-year/365."""
    ts, = bar_cols('ts')
    tp = 2 * math.pi
    m, dw, dy = F.month(ts), F.weekday(ts), F.dayofyear(ts)
    return {"month_sin": F.sin(tp * m / 12), "month_cos": F.cos(tp * m / 12),
            "dow_sin": F.sin(tp * dw / 7), "dow_cos": F.cos(tp * dw / 7),
            "doy_sin": F.sin(tp * dy / 365), "doy_cos": F.cos(tp * dy / 365)}


def weekday_flags() -> dict:
    """D03."""
    ts, = bar_cols('ts')
    return {"is_monday": (F.weekday(ts) == 0).cast("int"), "is_friday": (F.weekday(ts) == 4).cast("int")}


def month_flags() -> dict:
    """Calendar month start/end and quarter end (not trading days)."""
    ts, = bar_cols('ts')
    d = F.to_date(ts)
    month_end = d == F.last_day(d)
    return {"is_month_start": (F.dayofmonth(ts) == 1).cast("int"),
            "is_month_end": month_end.cast("int"),
            "is_quarter_end": (F.month(ts).isin(3, 6, 9, 12) & month_end).cast("int")}


def parse_ts(col: str, fmt: str | None = None):
    """Text -> zone-naive timestamp."""
    x = F.col(col)
    return (F.to_timestamp_ntz(x, F.lit(fmt)) if fmt else F.to_timestamp_ntz(x))
