"""The skew-safe (symbol, block) runner gives exactly the single-pass results."""

from pyspark.sql import functions as F

from barwise.functions import candles as C
from barwise.operators import indicators as G
from barwise.operators import rolling as E
from barwise.operators.segments import segmented


def _ops(df):
    df = df.withColumns({**C.returns((1, 5)), **C.true_range(), **C.fractals()})
    df = E.rolling_pack(df, ("close", "returns"), (5, 20))
    df = G.aroon(G.stochastic(G.bollinger(df)))
    return E.trend_slope(df)


def test_segmented_equals_plain(brand):
    plain = _ops(brand)
    seg = segmented(brand, _ops, lookback=26, ahead=1, block=37)   # many blocks per symbol
    cols = [c for c in plain.columns]
    a = plain.select(*cols)
    b = seg.select(*cols)
    assert a.count() == b.count() == brand.count()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_scans_in_blocks_equal_plain(spark, brand):
    """Depth-two recursions in blocks hardly longer than their memory."""
    from barwise.operators import scan as S

    def ops(df):
        return S.adx(S.rsi(S.macd(S.emas(df, "close", [3, 12])), 7), 7)

    back = max(S.ema_memory(26, 9), S.wilder_memory(7, depth=2))
    cols = ["ema_3", "ema_12", "macd", "macd_signal", "rsi_7", "adx_pos", "adx_neg", "adx"]
    seg = segmented(brand, ops, lookback=back, block=back + 40)
    assert seg.count() == brand.count()
    j = ops(brand).select("symbol", "ts", *cols).join(seg.select("symbol", "ts", *[F.col(c).alias(f"s_{c}") for c in cols]), ["symbol", "ts"])
    r = j.agg(*[F.max(F.abs(F.col(c) - F.col(f"s_{c}")) / F.greatest(F.abs(F.col(c)), F.lit(1.0))) for c in cols],
              *[F.sum((F.col(c).isNull() != F.col(f"s_{c}").isNull()).cast("int")) for c in cols], F.count(F.lit(1))).first()
    assert all(x < 1e-9 for x in r[:8]) and not any(r[8:16]) and r[16] == brand.count()


def test_rows_uneven_in_time(spark):
    """Half the rows within a second: blocks are cut by row number; and one symbol much larger than the others."""
    rows = spark.range(3000).select(
        F.when(F.col("id") < 2900, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("symbol"),
        F.timestamp_micros(F.when(F.col("id") < 1400, F.col("id") * 3).otherwise(F.col("id") * 10_000_000)).alias("ts"),
        (F.col("id") * 7 % 31).cast("double").alias("x"))

    def op(df):
        from barwise.functions.core import win
        return df.withColumns({"back": F.sum("x").over(win().rowsBetween(-5, 0)), "ahead": F.lead("x", 2).over(win())})

    want = op(rows)
    for block in (50, 700):
        got = segmented(rows, op, lookback=5, ahead=2, block=block)
        assert got.exceptAll(want).count() == 0 and got.count() == 3000


def test_plan_windows_by_block(brand):
    """Symbols of more rows than a block are windowed by block, the others whole."""
    plan = segmented(brand, _ops, lookback=26, ahead=1, block=300)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window [" in x and "close#" in x]   # others are of the layout
    assert windows and all("_blk#" in w for w in windows)


def test_hot_symbol_path_equals_plain(spark, sf):
    # the (symbol, block) plan and plain per-symbol windows: same flagship result
    from barwise.plans.flagship import flagship
    a = flagship(spark, sf, skew_safe=False)
    b = flagship(spark, sf)
    cols = ["symbol", "ts", "signal", "n_signals"]
    assert a.select(*cols).exceptAll(b.select(*cols)).count() == 0
    j = a.alias("a").join(b.alias("b"), "symbol").select(
        F.max(F.abs(F.col("a.macd") - F.col("b.macd"))).alias("d"),
        F.max(F.abs(F.col("a.hit_rate") - F.col("b.hit_rate"))).alias("h")).first()
    assert j["d"] < 1e-9 and j["h"] < 1e-12


def test_cumulative_lines_segmented(brand):
    from barwise.operators import indicators as G
    a = G.ad_line(G.vpt(G.obv(brand))).select("symbol", "ts", "obv", "vpt", "ad_line")
    b = G.volume_lines_segmented(brand).select("symbol", "ts", F.col("obv").alias("o"), F.col("vpt").alias("p"),
                                               F.col("ad_line").alias("a"))
    j = a.join(b, ["symbol", "ts"])
    r = j.agg(F.max(F.abs(F.col("obv") - F.col("o"))), F.max(F.abs(F.col("vpt") - F.col("p"))),
              F.max(F.abs(F.col("ad_line") - F.col("a"))), F.count(F.lit(1))).first()
    assert r[0] < 1e-6 and r[1] < 1e-6 and r[2] < 1e-6 and r[3] == brand.count()


def test_core_set_skew_safe_equals_plain(brand):
    from barwise.plans.featuresets import core_set
    a = core_set(brand, skew_safe=False)
    b = core_set(brand, skew_safe=True)
    cols = sorted(a.columns)
    assert sorted(b.columns) == cols
    num = [c for c, t in a.dtypes if t == "double" and c not in ("symbol", "ts")]
    j = a.select("symbol", "ts", *num).alias("a").join(
        b.select("symbol", "ts", *[F.col(c).alias(f"s_{c}") for c in num]).alias("b"), ["symbol", "ts"])
    diffs = j.agg(*[F.max(F.abs(F.col(c) - F.col(f"s_{c}")) / F.greatest(F.abs(F.col(c)), F.lit(1.0))).alias(c)
                    for c in num],
                  *[F.sum((F.col(c).isNull() != F.col(f"s_{c}").isNull()).cast("int")).alias(f"n_{c}") for c in num],
                  F.count(F.lit(1)).alias("rows")).first().asDict()
    assert diffs["rows"] == a.count() == b.count()
    bad = {c: diffs[c] for c in num if diffs[c] is not None and diffs[c] > 1e-9}
    bad.update({c: diffs[f"n_{c}"] for c in num if diffs[f"n_{c}"]})
    assert not bad, bad


def test_full_set_skew_safe_equals_plain(brand):
    # sampled columns from every stage (scans, frames over frames, guarded regimes)
    from barwise.plans.featuresets import full_set
    # PSAR, which both plans join at the end, is compared in the core set
    a = full_set(brand, skew_safe=False, with_psar=False)
    b = full_set(brand, skew_safe=True, with_psar=False)
    assert sorted(a.columns) == sorted(b.columns)
    cols = ["garch_vol", "market_state", "vol_regime", "close_mean_20", "trend_strength_20", "vol_of_vol_20",
            "jump_indicator", "volatility_momentum", "rsi_14_lag_5", "macd"]
    j = a.select("symbol", "ts", *cols).join(
        b.select("symbol", "ts", *[F.col(c).alias(f"s_{c}") for c in cols]), ["symbol", "ts"])
    d = j.agg(*[F.max(F.abs(F.col(c) - F.col(f"s_{c}")) / F.greatest(F.abs(F.col(c)), F.lit(1.0))).alias(c)
                for c in cols],
              *[F.sum((F.col(c).isNull() != F.col(f"s_{c}").isNull()).cast("int")).alias(f"n_{c}") for c in cols],
              F.count(F.lit(1)).alias("rows")).first().asDict()
    assert d["rows"] == a.count() == b.count()
    bad = {c: d[c] for c in cols if d[c] is not None and d[c] > 1e-9}
    bad.update({c: d[f"n_{c}"] for c in cols if d[f"n_{c}"]})
    assert not bad, bad


def _uneven(spark):
    """Symbols of very different length, with nulls at the head, in the middle and at the end."""
    return spark.range(2000).select(
        F.when(F.col("id") < 1500, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 9)).alias("symbol"),
        F.timestamp_seconds(F.col("id") * 60).alias("ts"),
        F.when((F.col("id") > 40) & (F.col("id") % 11 < 4) & (~F.col("id").between(300, 900)), F.col("id").cast("double")).alias("x"),
        F.when(F.col("id") % 3 == 0, F.col("id").cast("double")).alias("y"))


def test_positions_and_fills_in_blocks_equal_windows(spark):
    from pyspark.sql import Window

    from barwise.operators.segments import carried, positions
    df = _uneven(spark)
    w = Window.partitionBy("symbol").orderBy("ts")
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    numbered = df.withColumns({"_pos": F.row_number().over(w).cast("long"), "_n": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})
    forward = df.withColumns({c: F.last(c, ignorenulls=True).over(before) for c in "xy"})
    back = df.withColumns({c: F.first(c, ignorenulls=True).over(after) for c in "xy"})
    for block in (40, 5000):
        for got, want in ((positions(df, block=block), numbered), (carried(df, ["x", "y"], block=block), forward),
                          (carried(df, ["x", "y"], backward=True, block=block), back)):
            got = got.select(*want.columns)
            assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_last_rows_leave_tasks_limited(spark):
    from barwise.operators.segments import last_rows
    got = last_rows(_uneven(spark), 3)
    assert {(r["symbol"], r["n"]) for r in got.groupBy("symbol").agg(F.count("*").alias("n")).collect()} == \
        {("hot", 3), *((f"s{k}", 3) for k in range(9))}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2          # in the tasks, then merged
