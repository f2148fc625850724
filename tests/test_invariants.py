"""Invariants and the leakage check (perturb the last bar: no earlier feature moves)."""

from pyspark.sql import functions as F

from barwise.functions.core import sma
from barwise.operators import indicators as G
from barwise.operators import labels as K
from barwise.operators import scan as S


def test_channels_enclose_close(brand):
    df = G.donchian(brand)
    bad = df.filter(F.col("dc_upper").isNotNull() & ((F.col("close") > F.col("dc_upper")) |
                                                     (F.col("close") < F.col("dc_lower")))).count()
    assert bad == 0


def test_bounded_oscillators(brand):
    df = G.aroon(G.mfi(brand))
    r = df.agg(F.min("aroon_up"), F.max("aroon_up"), F.min("mfi_14"), F.max("mfi_14")).first()
    assert 0 <= r[0] <= r[1] <= 100 and 0 <= r[2] <= r[3] <= 100


def test_split_sizes_add_up(brand):
    s = K.chrono_split(brand)
    per = s.groupBy("symbol").pivot("split", ["train", "validation", "test"]).count().collect()
    n = {r["symbol"]: r["count"] for r in brand.groupBy("symbol").count().collect()}
    for r in per:
        assert (r["train"] or 0) + (r["validation"] or 0) + (r["test"] or 0) == n[r["symbol"]]


def test_sequences_shape(brand):
    seqs = K.sequences(K.targets(brand), ["close", "volume"], "target_direction", lookback=10)
    sizes = seqs.select(F.size("seq").alias("n"), F.size(F.flatten("seq")).alias("m")).distinct().collect()
    assert [(r["n"], r["m"]) for r in sizes] == [(10, 20)]


def test_no_lookahead(brand):
    last = brand.groupBy("symbol").agg(F.max("ts").alias("last"))
    bumped = brand.join(last, "symbol").withColumn(
        "close", F.when(F.col("ts") == F.col("last"), F.col("close") * 3).otherwise(F.col("close"))).drop("last")

    def feats(b):
        b = b.withColumn("sma_5", sma("close", 5))
        b = S.macd(S.rsi(b, 14))
        return b.join(last, "symbol").filter(F.col("ts") < F.col("last")).select("symbol", "ts", "sma_5", "rsi_14", "macd")
    a, b = feats(brand), feats(bumped)
    assert a.exceptAll(b).count() == 0
