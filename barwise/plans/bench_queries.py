"""Bench-only workloads (not part of the oracle catalogue)."""

from __future__ import annotations

from barwise.functions import candles as C
from barwise.operators import indicators as G
from barwise.operators import rolling as E
from barwise.sources.bars import bars_user


def bars_user_features(spark, d):
    """Many short symbols through a stage of frames, lags and cumulative sums."""
    b = bars_user(spark, d).withColumns({**C.returns((1, 5)), **C.true_range(), **C.gap_flags()})
    b = E.rolling_pack(b, ("close", "volume"), (5, 10, 20))
    b = G.bollinger(b)
    b = G.obv(b)
    return G.stochastic(b)


def extra():
    return {"bars_user_features": bars_user_features}
