"""The cache's folders do not multiply with the symbols; a refetch replaces its keys only."""
import datetime as dt
import os

from barwise.sources import cache as C
from barwise.sources.bars import BAR_COLS


def _bars(spark, symbols, value):
    rows = [(s, dt.datetime(2024, 1, 1 + k), value, value, None, value, 1.0) for s in symbols for k in range(2)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")


def _rows(df):
    return sorted(map(str, df.collect()))


def test_folders_are_bounded_and_rows_come_back(spark, tmp_path):
    path = str(tmp_path / "cache")
    bars = _bars(spark, [str(k) for k in range(3000)] + ["007", "a/b c=%", None], 1.5)
    C.write_cache(bars, path, "events", "6h")
    assert sum(len(d) for _, d, _ in os.walk(path)) <= C.BUCKETS + 2
    got = C.read_cache(spark, path, "events", "6h")
    assert got.columns == BAR_COLS and _rows(got) == _rows(bars)
    one = C.read_cache(spark, path, "events", "6h", ["007", "2999"])
    assert _rows(one) == _rows(bars.filter("symbol in ('007', '2999')"))
    assert len(one.inputFiles()) and "bucket" in one._jdf.queryExecution().executedPlan().toString()
    assert C.read_cache(spark, path, "other", "6h").count() == 0


def test_refetch_replaces_its_keys_only(spark, tmp_path):
    path = str(tmp_path / "cache")
    symbols = [str(k) for k in range(500)] + [None]
    C.write_cache(_bars(spark, symbols, 1.0), path, "events", "6h")
    C.write_cache(_bars(spark, symbols, 9.0), path, "events", "1d")
    C.write_cache(_bars(spark, ["7", "8", None, "new"], 2.0), path, "events", "6h")
    want = _bars(spark, [s for s in symbols if s not in ("7", "8", None)], 1.0).unionAll(_bars(spark, ["7", "8", None, "new"], 2.0))
    assert _rows(C.read_cache(spark, path, "events", "6h")) == _rows(want)
    assert _rows(C.read_cache(spark, path, "events", "1d")) == _rows(_bars(spark, symbols, 9.0))
