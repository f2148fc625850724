"""Registered queries for the streaming operators (S): each drives a streaming query over
the events table with ``availableNow`` and returns its sink table."""

from __future__ import annotations

import uuid


from pyspark.sql import functions as F

from barwise.plans import sqlgen as G
from barwise.plans import scan_queries  # noqa: F401  (its oracle of RSI)
from barwise.plans.registry import REGISTRY, query
from barwise.session import scratch_path
from barwise.sources.bars import BAR_SCHEMA, EVENTS_SCHEMA, bars_event
from barwise.streaming import bars_stream as S

BARS = "symbol:s, ts:t, open:d, high:d, low:d, close:d, volume:d"


def _ticks(spark, d):
    return S.tick_stream(spark, f"{d}/events*.parquet", EVENTS_SCHEMA)


@query("s01_stream_bars", BARS, "select * from bars_event")
def _s01(spark, d):
    bars = S.ohlcv(_ticks(spark, d), "event_type", "ts", "value", "1 hour", "1 hour",
                   order=["ts", "event_id"])
    return S.run_upserts(bars, ["symbol", "ts"], "s01")


@query("s01_stream_bars_append", BARS, "select * from bars_event")
def _s01b(spark, d):
    # append mode: a bar is written once, when the watermark passes its end; the closing row
    # tells the stream that the session has ended, so no bar stays open
    ticks = _ticks(spark, d)
    closing = S.Closing(spark, ticks.schema, "ts", _after(spark, d, "3 hours"))
    bars = S.ohlcv(ticks.unionByName(closing.stream), "event_type", "ts", "value", "1 hour", "1 hour", order=["ts", "event_id"])
    return S.run_counted(bars, "append", "s01a", closing=closing)[0]


@query("s02_sliding_stats", "symbol:s, window_start:t, window_end:t, mean:d, min:d, max:d, n:l",
       "select event_type as symbol, ws as window_start, ws + interval 3 hour as window_end, avg(value) as mean, "
       "min(value) as min, max(value) as max, count(*) as n from (select e.*, "
       "time_bucket(interval '1 hour', ts, timestamp '1970-01-01') - to_hours(k) as ws from events e, "
       "(select unnest([0, 1, 2]) as k) as _k) as _w group by 1, 2")
def _s02(spark, d):
    return S.run_upserts(S.sliding_stats(_ticks(spark, d), "event_type", "ts", "value"),
                         ["symbol", "window_start"], "s02")


@query("s03_dedupe_refetch", "event_id:l, symbol:s, ts:t, value:d",
       "select event_id, event_type as symbol, ts, value from events")
def _s03(spark, d):
    a = _ticks(spark, d)
    b = _ticks(spark, d)        # an overlapping re-delivery of the same ticks
    u = S.dedupe(a.unionByName(b), ["event_id"], "ts")
    out = S.run(u, "append", "s03")
    return out.select("event_id", F.col("event_type").alias("symbol"), "ts", "value")


@query("s04_latest_quote_state", "symbol:s, ts:t, close:d, prev_close:d, change:d, change_pct:d",
       "with r as (select event_type as symbol, ts, value, row_number() over (partition by event_type "
       "order by ts desc, event_id desc) as k from events) select a.symbol, a.ts, a.value as close, b.value as prev_close, "
       "a.value - b.value as change, (a.value - b.value) / nullif(b.value, 0) * 100 as change_pct "
       "from r a left join r b on a.symbol = b.symbol and b.k = 2 where a.k = 1")
def _s04(spark, d):
    q = S.latest_quote(_ticks(spark, d), "event_type", "ts", "value", "event_id")
    return S.run_upserts(q, ["symbol"], "s04")


def _bar_chunks(spark, d, n_chunks: int = 4, mixed: bool = False, backward: bool = False) -> str:
    """bars_event written as chunks, one write a chunk, so a file stream replays them in that order: of times in order
    (``backward``: in reverse), or ``mixed``: every chunk holds bars of all times."""
    bars = bars_event(spark, d).checkpoint()
    lo, hi = bars.agg(F.min("ts"), F.max("ts")).first()
    path = scratch_path(spark, f"bar-chunks-{uuid.uuid4().hex}")
    part = F.least(F.lit(n_chunks - 1), F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(lo).cast("timestamp")))
                                                * n_chunks / (F.unix_micros(F.lit(hi).cast("timestamp")) - F.unix_micros(F.lit(lo).cast("timestamp")))))
    if mixed:
        part = F.pmod(F.xxhash64("symbol", "ts"), F.lit(n_chunks))
    bars = bars.withColumn("_part", part).checkpoint()
    for i in range(n_chunks)[::-1 if backward else 1]:
        bars.filter(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(path)
    return path


def _smoothed(spark, path: str, delay: str, end=None):
    """Streamed EMA and RSI of the chunks in ``path``, the bars that came too late for them, and how many more the
    engine dropped."""
    bars = S.tick_stream(spark, f"{path}/*.parquet", BAR_SCHEMA, max_files=1)
    closing = S.Closing(spark, bars.schema, "ts", end) if end is not None else None
    if closing:
        bars = bars.unionByName(closing.stream)
    out, dropped = S.run_counted(S.incremental_smoothers(bars, 12, 14, delay), "append", "s05", closing=closing)
    return out.filter(~F.col("late")), out.filter("late"), dropped


def _after(spark, d, span: str):
    return bars_event(spark, d).agg(F.max("ts") + F.expr(f"interval {span}")).first()[0]


_EMA_SQL = ("with recursive b as (select *, row_number() over (partition by symbol order by ts) as rn from bars_event),\n"
            + G.ema("ema_12", "b", '"close"', 12) + "\nselect b.symbol, b.ts, ema_12.ema_12 from b left join ema_12 using (symbol, rn)")
_RSI_SQL = REGISTRY["f03_rsi_wilder"].sql.replace("bars_brand", "bars_event")


@query("s05_incremental_ema", "symbol:s, ts:t, ema_12:d", _EMA_SQL)
def _s05(spark, d):
    out, _, _ = _smoothed(spark, _bar_chunks(spark, d), "1 hour", _after(spark, d, "2 hours"))
    return out.select("symbol", "ts", F.col("ema").alias("ema_12"))


@query("s05_incremental_ema_shuffled", "symbol:s, ts:t, ema_12:d", _EMA_SQL)
def _s05b(spark, d):
    # every file holds bars of all times: they wait in the buffer until the watermark passes them
    out, _, _ = _smoothed(spark, _bar_chunks(spark, d, mixed=True), "40 days", _after(spark, d, "41 days"))
    return out.select("symbol", "ts", F.col("ema").alias("ema_12"))


@query("s05_incremental_rsi", "symbol:s, ts:t, rsi_14:d", f"select symbol, ts, rsi_14 from ({_RSI_SQL}) as _r")
def _s05c(spark, d):
    out, _, _ = _smoothed(spark, _bar_chunks(spark, d, mixed=True), "40 days", _after(spark, d, "41 days"))
    return out.select("symbol", "ts", F.col("rsi").alias("rsi_14"))


@query("s05_late_bars", "n_bars:l, n_late:l",
       "select count(*) filter (where part > 0) as n_bars, count(*) filter (where part = 0) as n_late from (select least(2, "
       "floor(epoch_us(ts - lo) * 3 / epoch_us(hi - lo))) as part from bars_event, (select min(ts) as lo, max(ts) as hi from bars_event) as _m) as _p")
def _s05d(spark, d):
    # thirds of the time arrive from the last to the first, with no delay allowed: the middle third still meets the
    # last one in the buffer, the first third is behind the watermark
    path = _bar_chunks(spark, d, n_chunks=3, backward=True)
    out, late, dropped = _smoothed(spark, path, "0 seconds", _after(spark, d, "2 hours"))
    return out.agg(F.count(F.lit(1)).alias("n_bars")).withColumn("n_late", F.lit(late.count() + dropped).cast("long"))


def _scored_stream(spark, d):
    """Every batch's predictions, and the model."""
    from barwise.operators import labels as K
    from barwise.operators import ml as R
    from barwise.plans.featuresets import BASIC, basic_set
    feats = list(BASIC)
    hist = K.targets(basic_set(bars_event(spark, d)))
    seqs = K.sequences(hist, feats, "target_direction", lookback=5)
    model = R.fit_direction(seqs, "logistic", regParam=0.01)
    bars = S.tick_stream(spark, f"{_bar_chunks(spark, d)}/*.parquet", BAR_SCHEMA, max_files=1)
    return S.run(bars, "append", "s06", foreach=S.scoring_sink(model, feats, 5)), model


@query("s06_stream_scoring", "symbol:s, ts:t, model:s, y_score:d, batch_id:l")
def _s06(spark, d):
    return _scored_stream(spark, d)[0].select("symbol", "ts", "model", "y_score", "batch_id")


# after every batch the streamed score of a symbol is the batch score on its bars so far
@query("s06_stream_equals_batch", "symbol:s, ts:t, batch_id:l, score_error:d",
       "with p as (select symbol, ts, least(3, floor(epoch_us(ts - lo) * 4 / epoch_us(hi - lo))) as part from bars_event, "
       "(select min(ts) as lo, max(ts) as hi from bars_event) as _m) "
       "select symbol, max(ts) as ts, cast(part as bigint) as batch_id, 0.0 as score_error from p group by symbol, part")
def _s06b(spark, d):
    from barwise.operators import labels as K
    from barwise.operators import ml as R
    from barwise.plans.featuresets import BASIC, basic_set
    out, model = _scored_stream(spark, d)
    bars = bars_event(spark, d).checkpoint()
    # the whole history up to the last bar of each prediction, scored at once
    cuts = out.select(F.concat_ws("|", "symbol", F.col("batch_id").cast("string")).alias("run"), "symbol", F.col("ts").alias("cut")).checkpoint()
    upto = bars.join(cuts, "symbol").filter(F.col("ts") <= F.col("cut")).drop("cut", "symbol").withColumnRenamed("run", "symbol")
    seq = K.latest_sequence(basic_set(upto), list(BASIC), 5).withColumn("target", F.lit(None).cast("double"))
    want = R.score(model, seq, "logistic").select(F.col("symbol").alias("run"), F.col("y_score").alias("want"))
    got = out.withColumn("run", F.concat_ws("|", "symbol", F.col("batch_id").cast("string")))
    return got.join(want, "run", "left").withColumn("score_error", F.abs(F.col("y_score") - F.col("want")))
