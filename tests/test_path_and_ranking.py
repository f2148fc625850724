"""PSAR blocks vs one sequential pass; exact distributed quantiles and ranks."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from barwise.operators.path import psar
from barwise.operators.ranking import exact_quantiles, global_rank


def test_psar_blocked_equals_sequential(brand):
    whole = psar(brand, block=100000).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    small = psar(brand, block=40, halo=8).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    assert len(whole) == len(small) == brand.count()
    np.testing.assert_array_equal(whole["psar"].to_numpy(), small["psar"].to_numpy())
    np.testing.assert_array_equal(whole["psar_trend"].to_numpy(), small["psar_trend"].to_numpy())


def test_exact_quantiles_match_numpy(brand):
    q = exact_quantiles(brand, ["close", "volume"], [0.001, 0.25, 0.5, 0.75, 0.999])
    got = {(r["feature"], r["prob"]): r["value"] for r in q.collect()}
    pdf = brand.select("close", "volume").toPandas()
    for f in ("close", "volume"):
        for p in (0.001, 0.25, 0.5, 0.75, 0.999):
            assert abs(got[(f, p)] - np.quantile(pdf[f], p)) <= 1e-9 * max(1.0, abs(got[(f, p)]))


def test_global_rank_equals_row_number(brand):
    r = global_rank(brand, ["symbol"], ["close", "ts"], buckets=7)
    w = Window.partitionBy("symbol").orderBy("close", "ts")
    ref = brand.withColumn("rn", F.row_number().over(w))
    bad = r.join(ref, ["symbol", "ts"]).filter(F.col("rank") != F.col("rn")).count()
    assert bad == 0
