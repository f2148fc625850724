"""Skew-safe runner for panel operators: windows by (symbol, block) with halos.

``Window.partitionBy("symbol")`` puts a symbol's whole history in one task; if one
symbol holds a third of 100 TB that task never finishes.  ``segmented`` cuts every symbol into
blocks of about ``block`` rows:

1. one small aggregate finds the symbols with more rows than a block; the others are one block each;
2. for the large ones, rows are counted by (symbol, slice of time); a block is a run of slices, and
   a slice whose rows reach into the last ``lookback`` rows of a block (the first ``ahead`` rows) is
   copied into the next (previous) one as halo.  This table has some SLICES rows a block;
3. the operator's columns are built with the panel window switched to
   ``partitionBy(symbol, _blk).orderBy(ts)`` and the halo rows dropped.

Every frame of at most ``lookback`` rows back and ``ahead`` rows forward then sees
exactly the rows it would see in one pass, so results are identical (tested).  Recursive smoothers
forget: ``scan.memory`` says after how many rows a double no longer shows the past.  Rows so uneven in
time that a slice would fill a block are cut by their row number instead.  Cumulative operators
use :func:`barwise.operators.ranking.ordered_cumsum` (same idea, offsets).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwise.functions.core import panel_window, part_cols

#: Rows of a block, and slices of time a block is made of.
BLOCK, SLICES = 65536, 16

#: Plans (by their hash) whose symbols were all found to fit one block.  If the data grow
#: meanwhile, blocks are longer than planned and results the same.
_FITS: set[tuple] = set()


def segmented(df: DataFrame, fn: Callable[[DataFrame], DataFrame], lookback: int, ahead: int = 0,
              block: int | None = None, key: str = "symbol", order: str = "ts", rows: DataFrame | None = None) -> DataFrame:
    """``fn(df)`` for an operator that sees ``lookback`` rows back and ``ahead`` rows forward.  ``rows`` may name a frame with
    at least the rows of every symbol of ``df`` that is cheaper to count."""
    block = block or max(BLOCK, 8 * (lookback + ahead))
    if lookback >= block or ahead >= block:
        raise ValueError("block must be longer than the operator's look-back and look-ahead")
    with panel_window((key, "_blk"), order):
        out = fn(_copied(df, lookback, ahead, block, key, order, rows)[0])
    return out.filter(F.col("_halo") == 0).drop("_blk", "_halo")


def in_block() -> bool:
    """Are columns being built inside :func:`segmented`?"""
    return "_blk" in part_cols()


def positions(df: DataFrame, key: str = "symbol", order: str = "ts", block: int = BLOCK, rows: DataFrame | None = None) -> DataFrame:
    """``df`` with ``_pos`` (1-based, in time order) and ``_n`` (rows of the symbol): counted in blocks, moved on by the
    blocks before."""
    df, whole = _copied(df, 0, 0, block, key, order, rows)
    one = Window.partitionBy(key, "_blk")
    df = df.drop("_halo").withColumns({"_pos": F.row_number().over(one.orderBy(order)).cast("long"), "_n": F.count(F.lit(1)).over(one)})
    if whole:
        return df.drop("_blk")
    # a row a block; a symbol's blocks are its rows / block
    per = df.groupBy(key, "_blk").agg(F.count(F.lit(1)).alias("_m"))
    by = Window.partitionBy(key)
    per = per.select(key, "_blk", (F.sum("_m").over(by.orderBy("_blk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_m")).alias("_before"),
                     F.sum("_m").over(by).alias("_all"))
    df = df.join(per, [key, "_blk"])
    return df.withColumns({"_pos": F.col("_pos") + F.col("_before"), "_n": F.col("_all")}).drop("_blk", "_before", "_all")


def carried(df: DataFrame, cols: list[str], backward: bool = False, key: str = "symbol", order: str = "ts",
            block: int = BLOCK) -> DataFrame:
    """Nulls of ``cols`` replaced by the last known value (``backward``: the next one): inside a block by a window, and where
    the block knows none yet by what the blocks before carry on."""
    df, whole = _copied(df, 0, 0, block, key, order)
    df = df.drop("_halo")
    pick, near = (F.first, (0, Window.unboundedFollowing)) if backward else (F.last, (Window.unboundedPreceding, 0))
    inside = Window.partitionBy(key, "_blk").orderBy(order).rowsBetween(*near)
    if not whole:
        edge = F.min_by if backward else F.max_by
        known = df.groupBy(key, "_blk").agg(*[edge(c, F.when(F.col(f"`{c}`").isNotNull(), F.col(order))).alias(f"_at{i}")
                                              for i, c in enumerate(cols)])
        far = (1, Window.unboundedFollowing) if backward else (Window.unboundedPreceding, -1)
        other = Window.partitionBy(key).orderBy("_blk").rowsBetween(*far)
        known = known.select(key, "_blk", *[pick(f"_at{i}", ignorenulls=True).over(other).alias(f"_from{i}") for i in range(len(cols))])
    df = df.withColumns({c: pick(c, ignorenulls=True).over(inside) for c in cols})
    if whole:
        return df.drop("_blk")
    df = df.join(known, [key, "_blk"])
    return df.withColumns({c: F.coalesce(c, f"_from{i}") for i, c in enumerate(cols)}).drop("_blk", *[f"_from{i}" for i in range(len(cols))])


def last_rows(df: DataFrame, n: int, key: str = "symbol", order: str = "ts", place: str = "_k") -> DataFrame:
    """Each symbol's last ``n`` rows, ``place`` 1 the last.  The limit on the row number is applied in every task
    before the shuffle (a window group limit), so at most n rows of a symbol leave a task."""
    last = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn(place, F.row_number().over(last)).filter(F.col(place) <= n)


def _copied(df: DataFrame, lookback: int, ahead: int, block: int, key: str, order: str,
            rows: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """``df`` with ``_blk`` and ``_halo``, halo rows added; and whether every symbol is one block."""
    whole = df.withColumns({"_blk": F.lit(0).cast("long"), "_halo": F.lit(0)})
    if rows is not None and _copied(rows, lookback, ahead, block, key, order)[1]:
        return whole, True
    plan = (df.select(key, order).semanticHash(), block)
    if plan in _FITS:
        return whole, True
    slim = df.select(F.col(key).alias("_k"), _micros(df, order).alias("_t"))
    # at most one row for every `block` rows
    large = slim.groupBy("_k").agg(F.count(F.lit(1)).alias("n"), F.min("_t").alias("t0"), F.max("_t").alias("t1")).filter(F.col("n") > block)
    known = [tuple(r) for r in large.agg(F.count(F.lit(1)), F.min((F.col("t1") - F.col("t0") + 1) / F.col("n"))).collect()][0]
    if not known[0]:
        _FITS.add(plan)
        return whole, True
    width = max(1, int(known[1] * block / SLICES))       # of the densest symbol: the others have fewer rows a slice
    table = _layout(slim.join(F.broadcast(large.select("_k")), "_k"), width, lookback, ahead, block)
    if table is None:
        return _ranked(df, lookback, ahead, block, key, order), False
    at = df.withColumn("_slice", F.floor(_micros(df, order) / width))
    at = at.join(table.withColumnRenamed("_k", key), [key, "_slice"], "left")
    at = _exploded(at, F.coalesce("_own", F.lit(0).cast("long")), F.col("_next"), F.col("_prev"))
    return at.drop("_slice", "_own", "_next", "_prev"), False


def _exploded(df: DataFrame, own: Column, after: Column, before: Column) -> DataFrame:
    def copy(b: Column, halo: int) -> Column:
        return F.when(b.isNotNull(), F.struct(b.alias("b"), F.lit(halo).alias("h")))

    places = F.filter(F.array(copy(own, 0), copy(after, 1), copy(before, 1)), lambda s: s.isNotNull())
    return df.withColumn("_c", F.explode(places)).withColumns({"_blk": F.col("_c.b"), "_halo": F.col("_c.h")}).drop("_c")


def _micros(df: DataFrame, order: str) -> Column:
    """Time as a whole number."""
    t = dict(df.dtypes)[order]
    c = F.col(order)
    return F.unix_micros(c.cast("timestamp")) if t.startswith(("timestamp", "date")) else c.cast("long")


def _layout(slim: DataFrame, width: int, lookback: int, ahead: int, block: int) -> DataFrame | None:
    """``_k, _slice``: the slice's own block, and the next and previous one if they need its rows; none if a slice is too full."""
    by = Window.partitionBy("_k").orderBy("_slice")
    counts = slim.groupBy("_k", F.floor(F.col("_t") / width).alias("_slice")).agg(F.count(F.lit(1)).alias("n")).checkpoint()
    if counts.agg(F.max("n")).first()[0] > block - max(lookback, ahead):
        return None
    # a symbol's slices are few: its rows / block * SLICES
    t = counts.withColumn("end", F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("start", F.col("end") - F.col("n")).withColumn("_own", F.floor(F.col("start") / block))
    one = Window.partitionBy("_k", "_own")
    t = t.withColumns({"first": F.min("start").over(one), "last": F.max("end").over(one),
                       "final": F.max("end").over(Window.partitionBy("_k"))})
    # blocks have block - n rows at least, so a halo never reaches over a whole one
    after = F.when((F.col("end") > F.col("last") - lookback) & (F.col("last") < F.col("final")), F.floor(F.col("last") / block))
    before = F.when((F.col("start") < F.col("first") + ahead) & (F.col("first") > 0), F.col("_own") - 1)
    return t.select("_k", "_slice", "_own", after.alias("_next"), before.alias("_prev"))


def _ranked(df: DataFrame, lookback: int, ahead: int, block: int, key: str, order: str) -> DataFrame:
    """Blocks by row number, from the bucketed global rank."""
    from barwise.operators.ranking import global_rank
    r = global_rank(df, [key], [order]).drop("n").withColumnRenamed("rank", "_rank")
    pos, blk = F.pmod(F.col("_rank") - 1, F.lit(block)), F.floor((F.col("_rank") - 1) / block)
    return _exploded(r, blk, F.when(pos >= block - lookback, blk + 1), F.when((pos < ahead) & (blk > 0), blk - 1)).drop("_rank")
