"""Global order statistics without a single-partition window.

``Window.orderBy`` without a partition (or partitioned only by a handful of model or
class keys) sends everything to one task.  Here an order is cut into range buckets
whose bounds come from a small approximate-quantile aggregate; each bucket is ranked
in parallel and bucket offsets come from a tiny per-bucket count table.  The bounds
only decide the parallel layout: ranks, cumulative sums and quantiles are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _as_number(df: DataFrame, col: str) -> Column:
    """Order-preserving numeric view of a column (timestamps as epoch microseconds)."""
    from pyspark.sql.types import TimestampNTZType, TimestampType
    t = df.schema[col].dataType
    if isinstance(t, (TimestampType, TimestampNTZType)):
        return F.unix_micros(F.col(col).cast("timestamp")).cast("double")
    return F.col(col).cast("double")


def _bucketed(df: DataFrame, group: list[str], order: str, buckets: int) -> DataFrame:
    probs = [i / buckets for i in range(1, buckets)]
    num = _as_number(df, order)
    # one array of bucket bounds per group: bounded by `buckets`, not by the data
    if not group:                      # a constant key instead of a cartesian product
        df, group = df.withColumn("_g0", F.lit(0)), ["_g0"]
    bounds = df.groupBy(*group).agg(F.approx_percentile(num, probs, 10000).alias("_bounds"))
    j = df.join(bounds, group, "left")
    return j.withColumn("_bkt", F.size(F.filter("_bounds", lambda b: b < num))).drop("_bounds")


def ordered_cumsum(df: DataFrame, group: list[str], order: list[str], sums: dict[str, Column],
                   buckets: int = 64, inclusive: bool = True) -> DataFrame:
    """Running sums of ``sums`` over rows ordered by ``order`` inside ``group``.

    The first order column decides the bucket; rows with equal values share a bucket.
    Adds ``cum_<name>`` for every sum and ``tot_<name>`` with the group total.
    """
    b = _bucketed(df, group, order[0], buckets)
    b = b.withColumns({f"_v_{k}": v for k, v in sums.items()})
    per = b.groupBy(*group, "_bkt").agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in sums])
    wb = Window.partitionBy(*group).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    wt = Window.partitionBy(*group)
    per = per.select(*group, "_bkt",
                     *[F.coalesce(F.sum(f"_s_{k}").over(wb), F.lit(0)).alias(f"_o_{k}") for k in sums],
                     *[F.sum(f"_s_{k}").over(wt).alias(f"tot_{k}") for k in sums])
    b = b.join(per, [*group, "_bkt"], "left")
    frame = Window.partitionBy(*group, "_bkt").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    out = b.withColumns({f"cum_{k}": F.col(f"_o_{k}") + F.coalesce(F.sum(f"_v_{k}").over(frame), F.lit(0))
                         for k in sums})
    return out.drop("_bkt", *[f"_v_{k}" for k in sums], *[f"_o_{k}" for k in sums])


def global_rank(df: DataFrame, group: list[str], order: list[str], buckets: int = 64) -> DataFrame:
    """Exact 1-based row number over ``order`` inside ``group`` (ties broken by ``order``)."""
    r = ordered_cumsum(df, group, order, {"one": F.lit(1)}, buckets)
    r = r.withColumnRenamed("cum_one", "rank").withColumnRenamed("tot_one", "n")
    return r.drop("_g0") if "_g0" in r.columns else r


#: Rank error of the first look at a column, as a share of its rows: one in so many; brackets stand MARGIN errors away.
ACCURACY, MARGIN = 10_000, 10
#: Values of a column, or between a wanted rank's brackets, that are collected and sorted at last; more are bracketed
#: (again).  A column of more values has MARGIN / ACCURACY * HELD ranks between rank and bracket at least.
HELD = 8_192
#: Steps of the grid by which too wide brackets are narrowed.
GRID = 128
#: Features looked at together: the width of one aggregate.
TOGETHER = 16


def _known(c: str) -> Column:
    x = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(x), x)


def _between(x: Column, lo: Column, hi: Column) -> Column:
    return F.when((x > lo) & (x < hi), x)


def _ranks(n: Column, p: float) -> tuple[Column, Column]:
    """0-based ranks around the quantile, NaN counted last."""
    at = (n - 1) * F.lit(p)
    return F.floor(at), F.ceil(at)


def _brackets(df: DataFrame, cols: list[str], probs: list[float], group: list[str]) -> DataFrame:
    """A row a group: count ``n<i>`` and, for every feature i and probability j, values ``lo<i>_<j>`` and ``hi<i>_<j>`` around
    the quantile, from one bounded digest a feature."""
    step = MARGIN / ACCURACY
    asked = sorted({q for p in probs for q in (p - step, p + step) if 0 < q < 1})
    look = F.approx_percentile
    row = df.groupBy(*group).agg(*[a for i, c in enumerate(cols) for a in (
        F.count(F.col(f"`{c}`")).alias(f"n{i}"), *([look(_known(c), asked, ACCURACY).alias(f"a{i}")] if asked else []))])

    def side(i: int, q: float, end: float) -> Column:
        return F.coalesce(F.get(f"a{i}", F.lit(asked.index(q))), F.lit(end)) if 0 < q < 1 else F.lit(end)

    inf = float("inf")
    return row.select(*group, *[f"n{i}" for i in range(len(cols))], *[s for i in range(len(cols)) for j, p in enumerate(probs) for s in (
        side(i, p - step, -inf).alias(f"lo{i}_{j}"), side(i, p + step, inf).alias(f"hi{i}_{j}"))])


def _counted(df: DataFrame, cols: list[str], probs: list[float], group: list[str], at, extra) -> DataFrame:
    """A row a group: values under, at and between the brackets, and ``extra`` of those between, or all values where they are
    few; ``at(name)`` gives the brackets."""
    aggs = []
    for i, c in enumerate(cols):
        few = at(f"n{i}") <= HELD
        x = _known(c)
        aggs += [F.max(at(f"n{i}")).alias(f"n{i}"), F.count(x).alias(f"m{i}"), F.collect_list(F.when(few, x)).alias(f"all{i}")]
        x = F.when(~few, x)
        for j in range(len(probs)):
            k = f"{i}_{j}"
            lo, hi = at(f"lo{k}"), at(f"hi{k}")
            aggs += [F.max(lo).alias(f"lo{k}"), F.max(hi).alias(f"hi{k}"), F.count_if(x < lo).alias(f"lt{k}"),
                     F.count_if(x == lo).alias(f"eq{k}"), F.count(_between(x, lo, hi)).alias(f"mid{k}"),
                     extra(_between(x, lo, hi)).alias(f"x{k}")]
    return df.groupBy(*group).agg(*aggs)


def _narrowed(counted: DataFrame, cols: list[str], probs: list[float], group: list[str]) -> DataFrame:
    """Closer brackets from the grids of :func:`_counted`; brackets whose quantile is one of their ends close on it."""
    out = [F.col(f"n{i}") for i in range(len(cols))]
    for i in range(len(cols)):
        for j, p in enumerate(probs):
            k = f"{i}_{j}"
            lo, hi, mid, grid = (F.col(f"{s}{k}") for s in ("lo", "hi", "mid", "x"))
            first, last = (r - F.col(f"lt{k}") - F.col(f"eq{k}") for r in _ranks(F.col(f"n{i}"), p))
            last = F.least(last, F.greatest(mid, F.lit(1)))     # NaN ranks need no bracket
            below = F.floor(first * GRID / mid) - 1
            above = F.floor(last * GRID / mid) + 2
            out += [F.when(first >= mid, hi).when((first < 0) | (below < 0), lo).otherwise(F.get(grid, below.cast("int"))).alias(f"lo{k}"),
                    F.when(last < 0, lo).when((last >= mid) | (above > GRID), hi).otherwise(F.get(grid, above.cast("int"))).alias(f"hi{k}")]
    return counted.select(*group, *out)


def _quantile_rows(counted: DataFrame, cols: list[str], probs: list[float], group: list[str]) -> DataFrame:
    """``(*group, feature, prob, value)`` from counts and the sorted values between the brackets."""
    def value(i: int, j: int, rank: Column) -> Column:
        k = f"{i}_{j}"
        inner = rank - F.col(f"lt{k}") - F.col(f"eq{k}")
        return F.when(rank >= F.col(f"m{i}"), F.lit(float("nan"))).when(
            F.col(f"n{i}") <= HELD, F.get(F.sort_array(f"all{i}"), rank.cast("int"))).when(inner < 0, F.col(f"lo{k}")).when(
            inner < F.col(f"mid{k}"), F.get(F.sort_array(f"x{k}"), inner.cast("int"))).otherwise(F.col(f"hi{k}"))

    cells = []
    for i, c in enumerate(cols):
        n = F.col(f"n{i}")
        for j, p in enumerate(probs):
            lower, upper = _ranks(n, p)
            part = (n - 1) * F.lit(p) - lower
            a, b = value(i, j, lower), value(i, j, upper)
            cells.append(F.when(n > 0, F.struct(F.lit(c).alias("feature"), F.lit(p).alias("prob"),
                                                F.when((part == 0) | (a == b), a).otherwise(a + (b - a) * part).alias("value"))))
    return counted.select(*group, F.explode(F.filter(F.array(*cells), lambda s: s.isNotNull())).alias("_q")).select(*group, "_q.*")


def _narrow(df: DataFrame, state: DataFrame, cols: list[str], probs: list[float], group: list[str], joined) -> DataFrame:
    """Brackets of ``state`` with at most HELD values between each, pass after pass over the rows."""
    grid = [k / GRID for k in range(GRID + 1)]
    widest = F.greatest(F.lit(0), *[F.coalesce(f"mid{i}_{j}", F.lit(0)) for i in range(len(cols)) for j in range(len(probs))])
    while True:
        rows, at = joined(df, state)
        counted = _counted(rows, cols, probs, group, at, lambda v: F.approx_percentile(v, grid, ACCURACY)).checkpoint()
        if (counted.agg(F.max(widest)).first()[0] or 0) <= HELD:
            return state
        state = _narrowed(counted, cols, probs, group).checkpoint()


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], group: list[str] | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles (numpy/pandas default, DuckDB ``quantile_cont``).

    Long output ``(*group, feature, prob, value)``; null is missing, NaN is the greatest value; a feature without
    values has no row.  No row is multiplied by features: one wide aggregate brackets every wanted rank by a
    bounded digest, a second one counts exactly what lies under, at and between the brackets and collects only the values
    strictly between (ties at a bracket are counted, not kept).  Where that would be more than HELD,
    further passes narrow the brackets first.  Groups that large are few, so their brackets are broadcast.
    """
    from barwise.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    group = group or []
    out = None
    for k in range(0, len(cols), TOGETHER):
        part = _quantiles_of(df.select(*group, *cols[k:k + TOGETHER]), cols[k:k + TOGETHER], probs, group)
        out = part if out is None else out.unionAll(part)
    return out


def _quantiles_of(df: DataFrame, cols: list[str], probs: list[float], group: list[str]) -> DataFrame:
    # values between brackets at most
    most = (2 * MARGIN + 2) * F.greatest(F.lit(0), *[F.col(f"n{i}") for i in range(len(cols))]) / ACCURACY
    state = _brackets(df, cols, probs, group)
    if not group:                           # one row: its values go into the plan
        def literal(rows: DataFrame, known: DataFrame):
            held = known.first()
            return rows, lambda name: F.lit(held[name])

        state = state.checkpoint()
        if state.select(most > HELD).first()[0]:
            state = _narrow(df, state, cols, probs, group, literal)
        rows, at = literal(df, state)
        return _quantile_rows(_counted(rows, cols, probs, group, at, F.collect_list), cols, probs, group)

    def joined(rows: DataFrame, known: DataFrame):
        return rows.join(known, group), F.col

    def spread(rows: DataFrame, known: DataFrame):
        return rows.join(F.broadcast(known), group), F.col

    state = state.checkpoint()
    large = state.filter(most > HELD).checkpoint()      # at most one in 3.7 million rows
    if large.isEmpty():
        rows, at = joined(df, state)
        return _quantile_rows(_counted(rows, cols, probs, group, at, F.collect_list), cols, probs, group)
    rows, at = joined(df.join(F.broadcast(large.select(*group)), group, "left_anti"), state)
    small = _quantile_rows(_counted(rows, cols, probs, group, at, F.collect_list), cols, probs, group)
    rows, at = spread(df, _narrow(df, large, cols, probs, group, spread))
    return small.unionAll(_quantile_rows(_counted(rows, cols, probs, group, at, F.collect_list), cols, probs, group))
