"""Exact quantiles against numpy: ties, infinities, nulls, NaN, groups, and many passes."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwise.operators import ranking

PROBS = [0.0, 0.001, 0.25, 0.5, 0.75, 0.999, 1.0]


def rows(n, seed):
    r = random.Random(seed)
    tied = [3.5 if r.random() < 0.9 else r.gauss(0, 1) for _ in range(n)]
    wide = [r.choice([-1, 1]) * math.exp(r.gauss(0, 60)) for _ in range(n)]
    holes = [None if r.random() < 0.4 else float(r.randint(-3, 3)) for _ in range(n)]
    return [(f"s{min(k % 7, 2)}", tied[k], wide[k], holes[k], None, float(k)) for k in range(n)]


SCHEMA = "symbol string, tied double, wide double, holes double, none double, ramp double"
COLS = ["tied", "wide", "holes", "none", "ramp"]


def want(data, col):
    v = np.array([r[col] for r in data if r[col] is not None])
    return {p: float(np.quantile(v, p)) for p in PROBS} if len(v) else {}


def check(got, data, key):
    by = {}
    for r in got.collect():
        by.setdefault((r["symbol"] if key else None, r["feature"]), {})[r["prob"]] = r["value"]
    for g in {r[0] for r in data} if key else [None]:
        mine = [r for r in data if not key or r[0] == g]
        for i, c in enumerate(COLS, 1):
            w = want(mine, i)
            assert by.get((g, c), {}).keys() == w.keys()
            for p, v in w.items():
                assert math.isclose(by[g, c][p], v, rel_tol=1e-12, abs_tol=1e-300), (g, c, p)


@pytest.mark.parametrize("key", [[], ["symbol"]])
@pytest.mark.parametrize("accuracy, held", [(10_000, 8_192), (200, 200)])
def test_equal_numpy(spark, monkeypatch, key, accuracy, held):
    """With few steps and little held, every bracket is narrowed pass after pass."""
    monkeypatch.setattr(ranking, "ACCURACY", accuracy)
    monkeypatch.setattr(ranking, "HELD", held)
    monkeypatch.setattr(ranking, "GRID", 16)
    monkeypatch.setattr(ranking, "TOGETHER", 3)
    data = rows(3_000, 4)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    check(ranking.exact_quantiles(df, COLS, PROBS, group=key), data, bool(key))


def test_infinities_nan_and_empty_tables(spark):
    data = [(float("-inf"), 1.0), (2.0, float("nan")), (2.0, 0.0), (float("inf"), -0.0), (None, float("nan"))]
    got = {(r["feature"], r["prob"]): r["value"] for r in ranking.exact_quantiles(
        spark.createDataFrame(data, "a double, b double"), ["a", "b"], [0.0, 0.5, 1.0]).collect()}
    assert got["a", 0.0] == float("-inf") and got["a", 0.5] == 2.0 and got["a", 1.0] == float("inf")
    assert got["b", 0.0] == 0.0 and got["b", 0.5] == 1.0 and math.isnan(got["b", 1.0])
    empty = spark.createDataFrame([], "a double, symbol string")
    assert ranking.exact_quantiles(empty, ["a"], [0.5]).count() == 0
    assert ranking.exact_quantiles(empty, ["a"], [0.5], group=["symbol"]).count() == 0


def test_no_row_is_multiplied_by_features(spark):
    df = spark.range(1000).select(*[(F.col("id") * k).cast("double").alias(f"f{k}") for k in range(1, 9)])
    plan = ranking.exact_quantiles(df, [f"f{k}" for k in range(1, 9)], [0.5])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and plan.index("Generate") < plan.index("Aggregate")     # only of the result row
