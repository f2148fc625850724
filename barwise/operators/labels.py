"""Targets, scalers, look-back sequences and splits.

Scalers split into ``fit(df, cols, fit_where, by)`` -> parameter table and
``apply(df, params)``.  Global parameters are one row per feature (bounded by the
schema) and are applied as literals; per-symbol parameters are a table joined on the
symbol (AQE broadcasts it only when its measured size is small).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwise.functions.core import lead, text_hash, win
from barwise.operators.ranking import exact_quantiles, global_rank
from barwise.operators.segments import in_block, last_rows, positions, segmented


# ---------------------------------------------------------------- K01
def targets(df: DataFrame, horizon: int = 1, drop_last: bool = True) -> DataFrame:
    """Direction / price / return of ``close`` ``horizon`` bars ahead, in (symbol, block) windows."""
    c = F.col("close")

    def ahead(b: DataFrame) -> DataFrame:
        return b.withColumn("target_price", lead(c, horizon))

    df = ahead(df) if in_block() else segmented(df, ahead, lookback=0, ahead=horizon)
    t = F.col("target_price")
    df = df.withColumns({"target_direction": F.when(t.isNotNull(), (t > c).cast("int")),
                         "target_return": F.try_divide(t - c, c)})
    return df.filter(t.isNotNull()) if drop_last else df


# ---------------------------------------------------------------- K02-K05 scalers
def _long_params(row_or_df, cols, stats, by):
    return row_or_df.select(*by, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), *[F.col(f"{c}__{s}").cast("double").alias(s) for s in stats])
        for c in cols])).alias("_p")).select(*by, "_p.*")


def fit_scaler(df: DataFrame, cols: list[str], kind: str = "minmax", fit_where: Column | None = None,
               by: list[str] | None = None) -> DataFrame:
    """Parameter table ``(*by, feature, <stats>)`` for ``minmax``, ``standard`` or ``robust``."""
    by = by or []
    src = df if fit_where is None else df.filter(fit_where)
    if kind == "robust":
        q = exact_quantiles(src, cols, [0.25, 0.5, 0.75], group=by)
        return q.groupBy(*by, "feature").agg(
            F.max(F.when(F.col("prob") == 0.25, F.col("value"))).alias("q25"),
            F.max(F.when(F.col("prob") == 0.5, F.col("value"))).alias("median"),
            F.max(F.when(F.col("prob") == 0.75, F.col("value"))).alias("q75"))
    if kind == "minmax":
        stats = ("min", "max")
        aggs = [a for c in cols for a in (F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max"))]
    else:
        stats = ("mean", "std")
        aggs = [a for c in cols for a in (F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std"))]
    wide = src.groupBy(*by).agg(*aggs)
    return _long_params(wide, cols, stats, by)


def _scaled(kind: str, x: Column, p) -> Column:
    if kind == "minmax":
        rng = p("max") - p("min")
        return F.when(rng == 0, F.lit(0.0)).otherwise((x - p("min")) / rng)
    if kind == "standard":
        return F.when(p("std") == 0, F.lit(0.0)).otherwise((x - p("mean")) / p("std"))
    iqr = p("q75") - p("q25")
    return (x - p("median")) / F.when(iqr == 0, F.lit(1.0)).otherwise(iqr)


def _unscaled(kind: str, x: Column, p) -> Column:
    if kind == "minmax":
        return x * (p("max") - p("min")) + p("min")
    if kind == "standard":
        return x * p("std") + p("mean")
    iqr = p("q75") - p("q25")
    return x * F.when(iqr == 0, F.lit(1.0)).otherwise(iqr) + p("median")


def _apply(df: DataFrame, params: DataFrame, kind: str, by: list[str] | None, fn) -> DataFrame:
    by = by or []
    feats = [r["feature"] for r in params.select("feature").distinct().collect()]   # schema-bounded
    stats = [c for c in params.columns if c not in (*by, "feature")]
    if not by:
        vals = {(r["feature"], s): r[s] for r in params.collect() for s in stats}
        return df.withColumns({c: fn(kind, F.col(c), lambda s, c=c: F.lit(vals[(c, s)]).cast("double"))
                               for c in feats if c in df.columns})
    wide = params.groupBy(*by).pivot("feature", feats).agg(*[F.first(s).alias(s) for s in stats])
    ren = {f"{c}_{s}": f"__{c}__{s}" for c in feats for s in stats} if len(stats) > 1 else \
          {c: f"__{c}__{stats[0]}" for c in feats}
    wide = wide.select(*by, *[F.col(f"`{k}`").alias(v) for k, v in ren.items()])
    j = df.join(wide, by, "left")
    j = j.withColumns({c: fn(kind, F.col(c), lambda s, c=c: F.col(f"__{c}__{s}")) for c in feats if c in df.columns})
    return j.drop(*ren.values())


def apply_scaler(df: DataFrame, params: DataFrame, kind: str = "minmax", by: list[str] | None = None) -> DataFrame:
    """K02-K04 transform with fitted parameters."""
    return _apply(df, params, kind, by, _scaled)


def inverse_scaler(df: DataFrame, params: DataFrame, kind: str = "minmax", by: list[str] | None = None) -> DataFrame:
    """Inverse transform (works for targets too: any column named in the table)."""
    return _apply(df, params, kind, by, _unscaled)


# ---------------------------------------------------------------- K06-K08 sequences
def sequences(df: DataFrame, feats: list[str], target: str, lookback: int = 10, gap: int = 1,
              keep: tuple[str, ...] = (), rows: DataFrame | None = None) -> DataFrame:
    """Features of rows [i-L-gap+1, i-gap] (gap=1: the L rows before i) with target of row i, and its ``keep`` columns."""
    df = _framed(df, feats, "seq", lookback, gap, rows)
    return df.filter(F.size("seq") == lookback).select("symbol", "ts", "seq", F.col(target).alias("target"), *keep)


def _framed(df: DataFrame, feats: list[str], name: str, lookback: int, gap: int, rows: DataFrame | None = None) -> DataFrame:
    """``df`` with ``name``, the features of the ``lookback`` rows that end ``gap`` rows back, and ``_vec``, the row's own."""
    df = df.withColumn("_vec", F.array(*[F.col(c).cast("double") for c in feats]))
    return segmented(df, lambda b: b.withColumn(name, F.collect_list("_vec").over(win().rowsBetween(-(lookback + gap - 1), -gap))),
                     lookback=lookback + gap - 1, rows=rows)


def adaptive_sequences(df: DataFrame, feats: list[str], target: str, lookback: int = 60) -> DataFrame:
    """Per-symbol look-back ``min(L, max(1, n-1))``; one bar -> the bar itself."""
    df = _framed(positions(df).withColumn("_i", F.col("_pos") - 1), feats, "_prev", lookback, 1)
    df = df.withColumn("_L", F.least(F.lit(lookback), F.greatest(F.lit(1), F.col("_n") - 1)).cast("int"))
    seq = F.when(F.col("_n") == 1, F.array(F.col("_vec"))).otherwise(
        F.slice("_prev", -F.col("_L"), F.col("_L")))
    keep = (F.col("_n") == 1) | (F.col("_i") >= F.col("_L"))
    return df.filter(keep).select("symbol", "ts", seq.alias("seq"), F.col("_L").alias("lookback"),
                                  F.col(target).alias("target"))


def latest_sequence(df: DataFrame, feats: list[str], lookback: int = 10) -> DataFrame:
    """The last L bars of each symbol, for scoring the next bar."""
    vec = F.struct("ts", F.array(*[F.col(c).cast("double") for c in feats]).alias("v"))
    # `lookback` rows of a symbol at most
    df = last_rows(df, lookback).groupBy("symbol").agg(F.max("ts").alias("ts"), F.sort_array(F.collect_list(vec)).alias("_rows"))
    return df.filter(F.size("_rows") == lookback).select("symbol", "ts", F.col("_rows.v").alias("seq"))


def seq_summary(seqs: DataFrame) -> DataFrame:
    """Checksum form of a sequence table: size, first, last and sum of the flattened array."""
    flat = F.flatten("seq")
    return seqs.select("symbol", "ts", F.size(flat).alias("n_values"), F.element_at(flat, 1).alias("first"),
                       F.element_at(flat, -1).alias("last"),
                       F.aggregate(flat, F.lit(0.0), lambda a, x: a + x).alias("total"), "target")


# ---------------------------------------------------------------- K09-K12 splits
def chrono_split(df: DataFrame, test: float = 0.2, val: float = 0.2, by: str = "symbol",
                 rows: DataFrame | None = None) -> DataFrame:
    """Per symbol, last ceil(n*test) rows test, then last ceil(rest*val) validation."""
    df = positions(df, key=by, rows=rows)
    n_test = F.ceil(F.col("_n") * test)
    rest = F.col("_n") - n_test
    n_val = F.ceil(rest * val)
    split = F.when(F.col("_pos") > rest, "test").when(F.col("_pos") > rest - n_val, "validation").otherwise("train")
    return df.withColumn("split", split).drop("_n", "_pos")


def stratified_split(df: DataFrame, label: str, key: list[str], seed: int = 42, train: float = 0.7) -> DataFrame:
    """Per class, hash order; first ceil(.7 n) train, ceil(half the rest) validation, rest test.

    The per-class order is a bucketed global rank (two classes must not mean two tasks).
    """
    h = text_hash(*[F.date_format(k, "yyyy-MM-dd HH:mm:ss") if dict(df.dtypes)[k].startswith("timestamp") else F.col(k).cast("string")
                    for k in key], F.lit(str(seed)))
    r = global_rank(df.withColumn("_h", h), [label], ["_h", *key])
    n_tr = F.ceil(F.col("n") * train)
    n_va = F.ceil((F.col("n") - n_tr) / 2)
    split = F.when(F.col("rank") <= n_tr, "train").when(F.col("rank") <= n_tr + n_va, "validation").otherwise("test")
    return r.withColumn("split", split).drop("_h", "rank", "n")


def split_gate(df: DataFrame, label: str = "target", min_rows: int = 10) -> DataFrame:
    """Rows and class balance per split, and whether each split has enough rows."""
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.col(label).cast("double")).alias("pos_rate")) \
             .withColumn("enough", (F.col("n_rows") >= min_rows).cast("int"))


def augment_noise(seqs: DataFrame, sigma: float = 0.01, seed: int = 7) -> DataFrame:
    """Add N(0, sigma) noise to every sequence value (deterministic per row and slot)."""
    base = F.concat_ws("|", "symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(str(seed)))

    def noisy(vec, i):
        def one(x, j):
            # Box-Muller from two hash-derived uniforms in (0, 1)
            u1, u2 = ((text_hash(base, i.cast("string"), j.cast("string"), F.lit(k), bits=28) + 1) / float((1 << 28) + 1) for k in "12")
            z = F.sqrt(-2 * F.log(u1)) * F.cos(2 * math.pi * u2)
            return x + sigma * z
        return F.transform(vec, one)
    return seqs.withColumn("seq", F.transform("seq", noisy))
