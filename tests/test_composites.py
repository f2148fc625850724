"""Cleaning after the full set, and the columns of the basic set."""

import math

from pyspark.sql import functions as F


def _frame(spark):
    rows = [("A", i, float(i), math.inf if i == 3 else 1.0 * i * i, None if i < 12 else 1.0, 7.0,
             None if i in (0, 5) else 100.0 + i) for i in range(20)]
    return (spark.createDataFrame(rows, "symbol string, i int, x double, y double, mostly_null double, "
                                        "constant double, z double")
            .withColumn("ts", (F.lit("2020-01-01").cast("timestamp") + F.make_interval(days=F.col("i"))).cast("timestamp_ntz"))
            .drop("i"))


def test_cleaned_drops_fills_and_leaves_no_gap(spark):
    from barwise.plans.featuresets import cleaned
    out = cleaned(_frame(spark))
    assert set(out.columns) == {"symbol", "ts", "x", "y", "z"}      # pruned: mostly null, constant
    rows = out.orderBy("ts").collect()
    assert len(rows) == 20
    assert all(math.isfinite(r[c]) for r in rows for c in ("x", "y", "z"))
    assert rows[3]["y"] == rows[2]["y"] == 4.0                       # inf -> null -> forward fill
    assert rows[5]["z"] == 104.0                                     # forward fill
    # a leading gap gets the median of the filled column, or the next value where asked
    z = [100.0 + (i if i != 5 else 4) for i in range(1, 20)]
    assert rows[0]["z"] == sorted(z)[len(z) // 2]
    back = cleaned(_frame(spark), backward=True).orderBy("ts").first()
    # the next value, 101, was clipped to the 0.1 % quantile of the 18 values before the fill
    assert abs(back["z"] - (101.0 + 17 * 0.001)) < 1e-9


def test_basic_set_short_history(spark):
    from barwise.plans.featuresets import BASIC, basic_set
    bars = spark.sql("select 'A' as symbol, timestamp_ntz'2020-01-01 00:00:00' + make_interval(0, 0, 0, i) as ts, "
                     "10D + i as open, 13D + i as high, 9D + i as low, 11D + i as close, 100D as volume "
                     "from (select explode(sequence(0, 3)) as i)")
    rows = basic_set(bars).select("ts", *BASIC).orderBy("ts").collect()
    assert [r["price_change"] for r in rows] == [1.0] * 4 and [r["price_range"] for r in rows] == [4.0] * 4
    assert rows[0]["returns"] == rows[1]["returns"] == 12 / 11 - 1          # backward fill of the first bar
    assert rows[0]["sma_3"] == 12.0 and rows[3]["sma_3"] == 13.0 and rows[0]["volume_sma_3"] == 100.0
    assert all(r["sma_5"] == r["sma_10"] == r["volume_sma_10"] == r["volatility_5"] == 0.0 for r in rows)


def test_every_column_of_a_set_is_compared(spark, sf):
    """The columns that I01-I04 add to the bars are those of their all-columns specs."""
    from barwise.plans.registry import load_all
    load_all()
    from barwise.plans import composite_full_queries as Q
    from barwise.plans import featuresets as I
    from barwise.sources.bars import bars_brand
    bars = bars_brand(spark, sf).limit(0)
    made = {"i01_core_set_all_columns": lambda: I.core_set(bars, trim=None), "i02_full_set_all_columns": lambda: I.full_set(bars, trim=None),
            "i03_extended_set_all_columns": lambda: I.extended_set(bars), "i04_simple_set_all_columns": lambda: I.simple_set(bars)}
    assert made.keys() == Q.COMPARED.keys()
    for name, build in made.items():
        assert sorted(set(build().columns) - set(bars.columns) - {"symbol", "ts"}) == sorted(Q.COMPARED[name]), name
