"""Path-dependent operators (F08 Parabolic SAR, F10 look-back scan).

PSAR is a state machine (trend, SAR, extreme point, acceleration factor) that no
associative scan expresses.  It runs in a grouped-map over (symbol, block) with a
halo of the previous block's last bars: each block starts from a reset state at its
halo start, and PSAR forgets its start after a couple of trend flips.  Exactness is
then *checked*, not assumed: the state a block computes for the last halo bar must
equal the state the previous block computed for that bar.  Blocks that fail are
re-run from the exact state of their predecessor (the first failing block of each
symbol per round), until all boundaries agree (with a 512-bar halo usually none fail).  A hot symbol is therefore many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwise.functions.core import win
from barwise.operators.segments import positions

OUT_SCHEMA = ("symbol string, ts timestamp_ntz, _rn long, _blk long, _halo int, "
              "psar double, psar_ep double, psar_af double, psar_trend int")


def _run(high: np.ndarray, low: np.ndarray, init, step: float, max_af: float):
    """Sequential PSAR over one block.  ``init`` = (sar, ep, af, trend, l1, l2, h1, h2):
    the exact state after the bar before the block and that bar's and the previous
    bar's low/high; without it the block starts from the reset state on its first bar
    (exact on the first bar of a series, a guess on a halo start)."""
    n = len(high)
    sar, ep, af = np.empty(n), np.empty(n), np.empty(n)
    tr = np.empty(n, dtype=np.int32)
    if init is None:
        s, e, a, t = low[0], high[0], step, 1
        sar[0], ep[0], af[0], tr[0] = s, e, a, t
        H, L, off, start = high, low, 0, 1
    else:
        s, e, a, t, l1, l2, h1, h2 = init
        H = np.concatenate([[h2, h1], high])
        L = np.concatenate([[l2, l1], low])
        off, start = 2, 0
    for i in range(start, n):
        k = i + off
        l1, h1 = L[k - 1], H[k - 1]
        # on the second bar of a series the bar two back is the bar one back
        l2, h2 = (L[k - 2], H[k - 2]) if k >= 2 else (l1, h1)
        nxt = s + a * (e - s)
        if t == 1:
            nxt = min(nxt, l1, l2)
            if L[k] < nxt:
                t, s, e, a = -1, e, L[k], step
            else:
                s = nxt
                if H[k] > e:
                    e, a = H[k], min(a + step, max_af)
        else:
            nxt = max(nxt, h1, h2)
            if H[k] > nxt:
                t, s, e, a = 1, e, H[k], step
            else:
                s = nxt
                if L[k] < e:
                    e, a = L[k], min(a + step, max_af)
        sar[i], ep[i], af[i], tr[i] = s, e, a, t
    return sar, ep, af, tr


def _block_fn(step: float, max_af: float):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rn").reset_index(drop=True)
        hi = pdf["high"].to_numpy(dtype=float)
        lo = pdf["low"].to_numpy(dtype=float)
        init = None
        if "_init_sar" in pdf.columns and pd.notna(pdf["_init_sar"].iloc[0]):
            r = pdf.iloc[0]
            # exact state of the bar before the block's first (non-halo) bar
            init = (r["_init_sar"], r["_init_ep"], r["_init_af"], int(r["_init_trend"]),
                    r["_init_l1"], r["_init_l2"], r["_init_h1"], r["_init_h2"])
            keep = pdf["_halo"] == 0
            pdf, hi, lo = pdf[keep].reset_index(drop=True), hi[keep.to_numpy()], lo[keep.to_numpy()]
        sar, ep, af, tr = _run(hi, lo, init, step, max_af)
        return pd.DataFrame({"symbol": pdf["symbol"], "ts": pdf["ts"], "_rn": pdf["_rn"], "_blk": pdf["_blk"],
                             "_halo": pdf["_halo"], "psar": sar, "psar_ep": ep, "psar_af": af, "psar_trend": tr})
    return fn


def psar(bars: DataFrame, step: float = 0.02, max_af: float = 0.2, block: int = 4096, halo: int = 512,
         skew_safe: bool = False) -> DataFrame:
    """sar, up (sar in an up-trend), down, trend (+1/-1) for every bar.

    ``skew_safe`` numbers the bars with the bucketed global rank instead of a per-symbol
    window (everything after that is already per block)."""
    from barwise.session import ensure_checkpoint_dir
    spark = bars.sparkSession
    ensure_checkpoint_dir(spark)
    halo = min(halo, block)
    base = bars.select("symbol", "ts", "high", "low")
    if skew_safe:
        from barwise.operators.ranking import global_rank
        base = global_rank(base, ["symbol"], ["ts"]).drop("n").withColumnRenamed("rank", "_rn")
    else:
        base = base.withColumn("_rn", F.row_number().over(win()))
    pos = F.pmod(F.col("_rn") - 1, F.lit(block))
    blk = F.floor((F.col("_rn") - 1) / block)
    copies = F.when(pos >= block - halo, F.array(F.struct(blk.alias("b"), F.lit(0).alias("h")),
                                                  F.struct((blk + 1).alias("b"), F.lit(1).alias("h")))) \
              .otherwise(F.array(F.struct(blk.alias("b"), F.lit(0).alias("h"))))
    rows = base.select("*", F.explode(copies).alias("_c")).select(
        "symbol", "ts", "high", "low", "_rn", F.col("_c.b").alias("_blk"), F.col("_c.h").alias("_halo"))
    # a halo copy past the last block has no own rows: drop blocks without non-halo rows
    real = rows.filter(F.col("_halo") == 0).select("symbol", "_blk").distinct()
    rows = rows.join(real, ["symbol", "_blk"], "left_semi")
    out = rows.groupBy("symbol", "_blk").applyInPandas(_block_fn(step, max_af), OUT_SCHEMA).checkpoint()
    # every round makes the first failing block of each symbol exact, so this ends
    while True:
        bad = _boundary_mismatch(out, rows)
        if bad.isEmpty():
            break
        # only the first failing block of a symbol has an exact predecessor; later blocks
        # are checked again once it is repaired
        first = bad.groupBy("symbol").agg(F.min("_blk").alias("_blk"))
        bad = bad.join(first, ["symbol", "_blk"], "left_semi")
        redo = rows.join(bad, ["symbol", "_blk"])
        fixed = redo.groupBy("symbol", "_blk").applyInPandas(_block_fn(step, max_af), OUT_SCHEMA)
        keep = out.join(bad.select("symbol", "_blk"), ["symbol", "_blk"], "left_anti")
        out = keep.unionByName(fixed).checkpoint()
    final = out.filter(F.col("_halo") == 0)
    t = F.col("psar_trend")
    return final.select("symbol", "ts", "psar", F.when(t == 1, F.col("psar")).alias("psar_up"),
                        F.when(t == -1, F.col("psar")).alias("psar_down"), "psar_trend")


def _boundary_mismatch(out: DataFrame, rows: DataFrame) -> DataFrame:
    """Blocks whose halo-end state differs from the predecessor's state at that bar, with
    the predecessor's exact state (and the two previous lows/highs) as the new start."""
    own = out.filter(F.col("_halo") == 0)
    last_prev = own.groupBy("symbol", "_blk").agg(F.max_by(F.struct("_rn", "psar", "psar_ep", "psar_af", "psar_trend"),
                                                          "_rn").alias("p"))
    last_prev = last_prev.select("symbol", (F.col("_blk") + 1).alias("_blk"), "p.*")
    halo_end = out.filter(F.col("_halo") == 1).groupBy("symbol", "_blk").agg(
        F.max_by(F.struct("_rn", "psar", "psar_ep", "psar_af", "psar_trend"), "_rn").alias("h")).select(
        "symbol", "_blk", F.col("h._rn").alias("_hrn"), F.col("h.psar").alias("_hs"), F.col("h.psar_ep").alias("_he"),
        F.col("h.psar_af").alias("_ha"), F.col("h.psar_trend").alias("_ht"))
    j = last_prev.join(halo_end, ["symbol", "_blk"])
    diff = ~((F.col("psar") == F.col("_hs")) & (F.col("psar_ep") == F.col("_he")) & (F.col("psar_af") == F.col("_ha"))
             & (F.col("psar_trend") == F.col("_ht")))
    bad = j.filter(diff)
    # the two bars before the block start give l[-1], l[-2], h[-1], h[-2] of the first bar
    prev2 = rows.filter(F.col("_halo") == 0).select("symbol", (F.col("_blk") + 1).alias("_blk"), "_rn", "high", "low")
    w = Window.partitionBy("symbol", "_blk")
    prev2 = prev2.withColumn("_mx", F.max("_rn").over(w)).filter(F.col("_rn") >= F.col("_mx") - 1) \
                 .groupBy("symbol", "_blk").agg(
        F.max_by("low", "_rn").alias("_init_l1"), F.min_by("low", "_rn").alias("_init_l2"),
        F.max_by("high", "_rn").alias("_init_h1"), F.min_by("high", "_rn").alias("_init_h2"))
    return bad.select("symbol", "_blk", F.col("psar").alias("_init_sar"), F.col("psar_ep").alias("_init_ep"),
                      F.col("psar_af").alias("_init_af"), F.col("psar_trend").alias("_init_trend")) \
              .join(prev2, ["symbol", "_blk"])


def lookback_scan(labels: DataFrame, windows=(5, 10, 15, 20), label: str = "target_direction",
                  min_seq: int = 50, train: float = 0.8) -> DataFrame:
    """per symbol, the window whose training labels have the largest majority-class
    rate (first maximum); windows with <= 50 sequences are skipped."""
    df = positions(labels).withColumn("_i", F.col("_pos") - 1)
    ex = df.select("symbol", F.col(label).cast("double").alias("_y"), "_i", "_n",
                   F.explode(F.array(*[F.lit(x) for x in windows])).alias("window"))
    n_seq = F.col("_n") - F.col("window")
    split = F.floor(n_seq * train)
    ex = ex.filter((n_seq > min_seq) & (F.col("_i") >= F.col("window")) & (F.col("_i") < F.col("window") + split))
    rates = ex.groupBy("symbol", "window").agg(F.avg("_y").alias("_p"))
    rates = rates.withColumn("rate", F.greatest(F.col("_p"), 1 - F.col("_p")))
    best = rates.groupBy("symbol").agg(F.max_by(F.struct("rate", (-F.col("window")).alias("_nw"), "window"),
                                                F.struct("rate", (-F.col("window")).alias("_nw"))).alias("b"))
    return best.select("symbol", F.col("b.window").alias("best_window"), F.col("b.rate").alias("best_rate"))
