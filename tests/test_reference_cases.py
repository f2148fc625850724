"""Hand-computed cases carried over from the reference's own tests."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barwise.operators import clean as J
from barwise.operators import ensemble as N
from barwise.operators import evaluation as M
from barwise.sources.bars import validate

KEYS = [("S", datetime(2024, 1, 1) + timedelta(days=i)) for i in range(3)]


def _preds(spark):
    rows = []
    for model, scores in (("m1", [.8, .3, .9]), ("m2", [.7, .4, .8])):
        for (sym, ts), s, y in zip(KEYS, scores, [1, 0, 1]):
            rows.append((sym, ts, model, y, s))
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, model string, y_true int, y_score double")


def test_simple_average(spark):
    out = N.simple_average(_preds(spark)).orderBy("ts").collect()
    assert [round(r["ensemble"], 10) for r in out] == [0.75, 0.35, 0.85]


def test_weighted_average(spark):
    w = spark.createDataFrame([("m1", 0.7), ("m2", 0.3)], "model string, weight double")
    out = N.weighted_average(_preds(spark), w).orderBy("ts").collect()
    exp = [.7 * a + .3 * b for a, b in zip([.8, .3, .9], [.7, .4, .8])]
    assert [round(r["ensemble"], 10) for r in out] == [round(x, 10) for x in exp]


def test_threshold_labels(spark):
    lab = M.threshold_labels(_preds(spark).filter("model = 'm1'")).orderBy("ts").collect()
    assert [r["y_pred"] for r in lab] == [1, 0, 1]


def test_voting_share_and_majority(spark):
    v = N.voting(_preds(spark)).orderBy("ts").collect()
    assert [r["vote_share"] for r in v] == [1.0, 0.0, 1.0]
    assert [r["majority"] for r in v] == [1, 0, 1]


def _bars(spark, rows):
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, "
                                       "close double, volume double")


def test_validation_cases(spark):
    t = datetime(2024, 1, 1)
    good = _bars(spark, [("A", t, 10., 11., 9., 10.5, 100.)])
    neg = _bars(spark, [("A", t, 10., 11., 9., -1., 100.)])
    hl = _bars(spark, [("A", t, 75., 50., 100., 75., 100.)])
    assert validate(good).first()["valid"] == 1
    assert validate(neg).first()["valid"] == 0
    assert validate(hl).first()["valid"] == 0
    missing = good.drop("close")
    assert validate(missing).first()["valid"] == 0
    assert validate(good.limit(0)).count() == 0          # empty input: nothing valid to report


def test_guard_raises_on_nan_and_inf(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    with pytest.raises(Exception):
        J.assert_ok(J.input_guard(df, ["x"])).collect()
    df2 = spark.createDataFrame([(1.0,), (float("inf"),)], "x double")
    with pytest.raises(Exception):
        J.assert_ok(J.input_guard(df2, ["x"])).collect()
    ok = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    assert J.assert_ok(J.input_guard(ok, ["x"])).first()["ok"] == 1


def test_substring_hits_of_any_length(spark):
    from barwise.sources.dims import substring_hits
    dim = spark.createDataFrame([("AAPL", "Apple Inc"), ("msft", None), ("x1", "Customer#000")], "symbol string, name string")
    asked = ["", "a", "pp", "APP", "appl", "e inc", "customer#000", "zz", "applx", "0000", None, "sft"]
    got = substring_hits(spark.createDataFrame([(q,) for q in asked], "q string"), dim)
    want = {q for q in asked if q is not None and any(q.lower() in t for t in ("aapl", "apple inc", "msft", "x1", "customer#000"))}
    assert {r["q"] for r in got.collect()} == want and got.count() == len(want)


@pytest.mark.parametrize("values", [
    [1.0, 2.0, 3.0, 4.0, float("inf")], [float("-inf"), 1.0, 2.0, 3.0, 4.0], [float("nan"), 1.0, 2.0, 100.0, None],
    [1.0, 1.0, 1.0, float("inf"), float("nan")], [1.0, 2.0, 3.0, 4.0, 1e6]])
def test_clip_of_values_that_are_not_finite(spark, values):
    import numpy as np
    import pandas as pd
    x = pd.Series(values, dtype="float64")
    v = sorted(x.dropna())

    def quantile(p):       # a value at its own rank is not mixed with an infinite neighbour
        at = p * (len(v) - 1)
        low, part = int(at), at - int(at)
        return np.float64(v[low]) + (np.float64(v[low + 1]) - v[low]) * part if part else np.float64(v[low])

    with np.errstate(invalid="ignore"):
        q1, q3, p1, p9 = map(quantile, (0.25, 0.75, 0.001, 0.999))
        low, high = q1 - 3 * (q3 - q1), q3 + 3 * (q3 - q1)
    low = p1 if np.isnan(low) else low if np.isnan(p1) else max(low, p1)
    high = p9 if np.isnan(high) else high if np.isnan(p9) else min(high, p9)
    low = low if np.isfinite(low) else x.min()
    high = high if np.isfinite(high) else x.max()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x double")
    bounds = J.clip_bounds(df, ["x"])
    r = bounds.first()
    assert (r["lower"], r["upper"]) == (pytest.approx(low), pytest.approx(high))
    got = [row["x"] for row in J.clip(df, bounds).orderBy("i").collect()]
    want = x.clip(low, high)
    assert [g is None or np.isnan(g) for g in got] == list(want.isna())
    assert [g for g in got if g is not None and not np.isnan(g)] == pytest.approx(list(want.dropna()))
