"""Checks for the operators whose final value needs Python (p-values, PCA, stacking)."""

import math

import numpy as np
from pyspark.sql import functions as F

from barwise.operators import compare as O
from barwise.operators import select as L


def test_chi2_and_t_pvalues():
    # chi-square(1) survival and two-sided t p-values at textbook points
    assert abs(O.chi2_sf1(3.841458820694124) - 0.05) < 1e-9
    assert O.chi2_sf1(0.0) == 1.0
    assert abs(O.t_two_sided(2.228138851986274, 10) - 0.05) < 1e-9
    assert abs(O.t_two_sided(1.959963984540054, 1e7) - 0.05) < 1e-6
    assert abs(O.t_two_sided(0.0, 5) - 1.0) < 1e-12


def test_mcnemar_counts(spark):
    from datetime import datetime, timedelta
    rows = []
    # model a right, b wrong on 6 rows; the opposite on 2 rows; both right on 2
    pattern = [(1, 0)] * 6 + [(0, 1)] * 2 + [(1, 1)] * 2
    for i, (ra, rb) in enumerate(pattern):
        ts = datetime(2024, 1, 1) + timedelta(hours=i)
        rows.append(("S", ts, "a", 1, 0.9 if ra else 0.1))
        rows.append(("S", ts, "b", 1, 0.9 if rb else 0.1))
    p = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, model string, y_true int, y_score double")
    r = O.mcnemar(p, ["a", "b"]).first()
    assert (r["b"], r["c"]) == (6, 2)
    assert abs(r["statistic"] - (abs(6 - 2) - 1) ** 2 / 8) < 1e-12
    assert abs(r["p_value"] - math.erfc(math.sqrt(r["statistic"] / 2))) < 1e-12


def test_pca_matches_numpy(spark, sf):
    from barwise.plans.selection_queries import FEATS, selection_frame
    df = selection_frame(spark, sf)
    table, proj = L.pca(df, FEATS, k=3)
    ev = [r["explained_variance"] for r in table.orderBy("component").collect()]
    x = df.select(*FEATS).toPandas().to_numpy()
    lam = np.sort(np.linalg.eigvalsh(np.cov(x, rowvar=False)))[::-1]
    np.testing.assert_allclose(ev, lam / lam.sum(), rtol=1e-6, atol=1e-9)
    assert proj.count() == df.count()


def test_stacking_outputs_probabilities(spark, sf):
    from barwise.operators import ensemble as N
    from barwise.operators.evaluation import MODELS, predictions
    from barwise.sources.bars import bars_event
    p = predictions(bars_event(spark, sf))
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    s = N.stacking(p.filter(F.col("ts") < cut), p.filter(F.col("ts") >= cut), list(MODELS))
    r = s.agg(F.min("stacked"), F.max("stacked"), F.count(F.lit(1))).first()
    assert 0.0 <= r[0] <= r[1] <= 1.0 and r[2] > 0
