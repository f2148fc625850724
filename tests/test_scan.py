"""The blocked linear scan against plain sequential recursions (pandas)."""

import numpy as np
import pandas as pd

from barwise.operators import scan as S


def _seq_ema(x, span, adjust):
    return pd.Series(x).ewm(span=span, adjust=adjust).mean().to_numpy()


def test_ema_matches_pandas(brand):
    # span 3 -> block length 58: several blocks per symbol at sf0.001
    df = brand
    for span in (3, 12):
        df = S.ema(df, "close", span, f"e{span}", warmup=False)
        df = S.ema(df, "close", span, f"a{span}", adjust=True)
    pdf = df.toPandas().sort_values(["symbol", "ts"])
    for _, g in pdf.groupby("symbol"):
        for span in (3, 12):
            np.testing.assert_allclose(g[f"e{span}"], _seq_ema(g["close"].to_numpy(), span, False), rtol=1e-12)
            np.testing.assert_allclose(g[f"a{span}"], _seq_ema(g["close"].to_numpy(), span, True), rtol=1e-12)


def test_wilder_matches_loop(brand):
    df = S.atr(brand, (5,))
    pdf = df.toPandas().sort_values(["symbol", "ts"])
    for _, g in pdf.groupby("symbol"):
        h, l, c = g["high"].to_numpy(), g["low"].to_numpy(), g["close"].to_numpy()
        tr = np.maximum(h[1:] - l[1:], np.maximum(abs(h[1:] - c[:-1]), abs(l[1:] - c[:-1])))
        exp = [np.nan] * 5 + [tr[:5].mean()]
        for x in tr[5:]:
            exp.append((exp[-1] * 4 + x) / 5)
        np.testing.assert_allclose(g["atr_5"].to_numpy(dtype=float), np.array(exp), rtol=1e-12)


def test_rsi_bounds(brand):
    df = S.rsi(S.rsi(brand, 14), 14, method="sma")
    r = df.selectExpr("min(rsi_14) lo", "max(rsi_14) hi", "min(rsi_sma_14) lo2", "max(rsi_sma_14) hi2").first()
    assert 0 <= r["lo"] <= r["hi"] <= 100 and 0 <= r["lo2"] <= r["hi2"] <= 100


def test_segmented_scan_equals_windowed(brand):
    from pyspark.sql import functions as F
    a = S.emas(brand, "close", [3, 12, 50]).select("symbol", "ts", "ema_3", "ema_12", "ema_50")
    b = S.emas_segmented(brand, "close", [3, 12, 50]).select(
        "symbol", "ts", *[F.col(f"ema_{s}").alias(f"s_{s}") for s in (3, 12, 50)])
    j = a.join(b, ["symbol", "ts"])
    rel = [F.max(F.abs(F.col(f"ema_{s}") - F.col(f"s_{s}")) / F.greatest(F.abs(F.col(f"ema_{s}")), F.lit(1.0)))
           for s in (3, 12, 50)]
    nulls = F.sum((F.col("ema_50").isNull() != F.col("s_50").isNull()).cast("int"))
    r = j.agg(*rel, nulls, F.count(F.lit(1))).first()
    assert max(r[0], r[1], r[2]) < 1e-12 and r[3] == 0 and r[4] == brand.count()
    tr = brand.withColumn("tr", F.col("high") - F.col("low"))
    c = S.wilder(tr, "tr", 5, "w5").select("symbol", "ts", "w5")
    d = S.wilder_segmented(tr, "tr", 5, "w5").select("symbol", "ts", F.col("w5").alias("v5"))
    k = c.join(d, ["symbol", "ts"]).agg(
        F.max(F.abs(F.col("w5") - F.col("v5")) / F.greatest(F.abs(F.col("w5")), F.lit(1.0))),
        F.sum((F.col("w5").isNull() != F.col("v5").isNull()).cast("int"))).first()
    assert k[0] < 1e-12 and k[1] == 0


def test_segmented_rsi_atr_adx(brand):
    from pyspark.sql import functions as F
    cols = ["rsi_14", "atr_14", "adx_pos", "adx_neg", "adx"]
    a = S.adx(S.atr(S.rsi(brand, 14), (14,)), 14).select("symbol", "ts", *cols)
    b = S.adx_segmented(S.atr_segmented(S.rsi_segmented(brand, 14), 14), 14).select(
        "symbol", "ts", *[F.col(c).alias(f"s_{c}") for c in cols])
    j = a.join(b, ["symbol", "ts"])
    r = j.agg(*[F.max(F.abs(F.col(c) - F.col(f"s_{c}")) / F.greatest(F.abs(F.col(c)), F.lit(1.0))) for c in cols],
              *[F.sum((F.col(c).isNull() != F.col(f"s_{c}").isNull()).cast("int")) for c in cols],
              F.count(F.lit(1))).first()
    assert all(x < 1e-9 for x in r[:5]) and all(x == 0 for x in r[5:10]) and r[10] == brand.count()


def test_seed_among_interior_nulls(spark):
    """Nulls among the first n inputs: the windowed and the skew-safe form agree."""
    import datetime as dt
    t0 = dt.datetime(2020, 1, 1)
    rows = [("a", t0 + dt.timedelta(days=i), None if i in (0, 6, 9, 30) else 10 + (i * 7 % 11) / 3) for i in range(60)]
    rows += [("b", t0 + dt.timedelta(days=i), None if i % 2 else float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double")
    for n in (3, 14):
        one = {(r["symbol"], r["ts"]): r["w"] for r in S.wilder(df, "x", n, "w").collect()}
        two = {(r["symbol"], r["ts"]): r["w"] for r in S.wilder_segmented(df, "x", n, "w").collect()}
        assert one.keys() == two.keys() and sum(v is not None for v in one.values()) > 40
        assert all((one[k] is None) == (two[k] is None) and (one[k] is None or abs(one[k] - two[k]) < 1e-9) for k in one)
