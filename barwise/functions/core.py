"""Column helpers shared by every operator: the panel window, null rules, flags.

Null rules (they decide most values):

* a rolling W-bar statistic is null until W non-null inputs are in the frame (``full``);
* every division is ``try_divide``: a zero divisor gives null, never an error or inf;
* a comparison flag is 0, never null (``flag``);
* ``greatest``/``least`` in Spark skip nulls, the pandas ``np.maximum`` propagates them:
  use ``gmax``/``gmin`` when a null input must give null.
"""

from __future__ import annotations

import contextlib
import contextvars
from collections.abc import Iterator

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# (partition columns, order column) of the current panel window
_PANEL = contextvars.ContextVar("barwise_panel", default=(("symbol",), "ts"))


@contextlib.contextmanager
def panel_window(part: tuple[str, ...], order: str) -> Iterator[None]:
    """Build the Column expressions inside this block over another window.

    Used by the segmented (skew-safe) runner which windows by ``(symbol, _blk)``
    ordered by the global row number ``_rn``.
    """
    tok = _PANEL.set((tuple(part), order))
    try:
        yield
    finally:
        _PANEL.reset(tok)


def win():
    """Current per-symbol window, ordered in time."""
    part, order = _PANEL.get()
    return Window.partitionBy(*part).orderBy(order)


def part_cols() -> tuple[str, ...]:
    return _PANEL.get()[0]


def frame(n: int, ahead: int = 0):
    """Frame of the last ``n`` rows (current row included), optionally ``ahead`` rows."""
    return win().rowsBetween(-(n - 1), ahead)


def cum():
    """Frame from the first row of the symbol up to the current row."""
    return win().rowsBetween(Window.unboundedPreceding, 0)


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def div(a, b) -> Column:
    """Null-safe division: a zero or null divisor gives null."""
    return F.try_divide(c(a), c(b))


def flag(cond: Column) -> Column:
    """Comparison flag as int: null/unknown is 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def gmax(*cols) -> Column:
    """Greatest that propagates a null operand (numpy ``maximum`` semantics)."""
    cols = [c(x) for x in cols]
    anynull = F.lit(False)
    for x in cols:
        anynull = anynull | x.isNull()
    return F.when(~anynull, F.greatest(*cols))


def gmin(*cols) -> Column:
    cols = [c(x) for x in cols]
    anynull = F.lit(False)
    for x in cols:
        anynull = anynull | x.isNull()
    return F.when(~anynull, F.least(*cols))


def lag(x, k: int = 1) -> Column:
    return F.lag(c(x), k).over(win())


def lead(x, k: int = 1) -> Column:
    return F.lead(c(x), k).over(win())


def nfull(x, n: int) -> Column:
    """True when the n-row frame holds n non-null values of x."""
    return F.count(c(x)).over(frame(n)) == n


def full(agg: Column, x, n: int) -> Column:
    """Rolling aggregate over the last n rows, null until n non-null inputs exist."""
    return F.when(nfull(x, n), agg.over(frame(n)))


def sma(x, n: int) -> Column:
    return full(F.avg(c(x)), x, n)


def rsum(x, n: int) -> Column:
    return full(F.sum(c(x)), x, n)


def rstd(x, n: int, ddof: int = 1) -> Column:
    fn = F.stddev_samp if ddof == 1 else F.stddev_pop
    return full(fn(c(x)), x, n)


def rmax(x, n: int) -> Column:
    return full(F.max(c(x)), x, n)


def rmin(x, n: int) -> Column:
    return full(F.min(c(x)), x, n)


def rmedian(x, n: int) -> Column:
    # median() with a frame is rejected by Spark; percentile(.5) is exact and accepted
    return full(F.percentile(c(x), F.lit(0.5)), x, n)


def rn() -> Column:
    return F.row_number().over(win())


def with_cols(df, cols: dict):
    """Add a stage of columns at once (one Project; avoids quadratic withColumn loops)."""
    return df.withColumns(cols) if cols else df


def bar_cols(*names: str) -> tuple[Column, ...]:
    """Column handles for bar fields (built per call: no Spark context needed at import)."""
    return tuple(F.col(n) for n in names)


def text_hash(*parts, bits: int = 60) -> Column:
    """Non-negative hash of texts joined by ``|``, from the first digits of their MD5: an order that any engine can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, bits // 4), 16, 10).cast("bigint")
