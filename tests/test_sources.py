"""Bars by hash aggregate: packed order keys give the first and last price of the struct order."""
import pytest
from pyspark.sql import functions as F

from barwise.sources import bars as B


def test_packed_key_orders_as_the_struct(spark):
    rows = [(k % 3, (k * 7919) % 5, (k * 31) % 11, float(k)) for k in range(400)]
    df = spark.createDataFrame(rows, "g int, a bigint, b int, v double").withColumn("c", F.monotonically_increasing_id() % 97)
    names = ["a", "b", "c", "v"]
    one = F.struct(*names[:3], "v")
    for widths in ({"a": 3, "b": 4, "c": 40}, {"a": 60, "b": 31, "c": 32}):
        k = B.order_key(df, widths)
        got = df.groupBy("g").agg(F.min_by(F.struct(*names[:3]), k).alias("x"), F.max_by(F.struct(*names[:3]), k).alias("y"))
        want = df.groupBy("g").agg(F.min(one).alias("x"), F.max(one).alias("y"))
        assert {r["g"]: (tuple(r["x"]), tuple(r["y"])) for r in got.collect()} == {
            r["g"]: (tuple(r["x"])[:3], tuple(r["y"])[:3]) for r in want.collect()}
    with pytest.raises(ValueError):
        B.order_key(df, {"a": 60, "b": 60, "c": 60})
    with pytest.raises(Exception, match="does not fit"):
        df.groupBy("g").agg(F.min_by("v", B.order_key(df, {"a": 2}))).collect()


def test_bars_aggregate_in_hash_tables(spark, sf):
    for make in (B.bars_brand, B.bars_event, B.bars_user):
        plan = make(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan
    plan = B.rollup_bars(B.bars_brand(spark, sf), "1wk")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
