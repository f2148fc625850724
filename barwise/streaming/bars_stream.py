"""Structured Streaming operators.

The reference polls a vendor hourly and overwrites its cache; here ticks arrive as
files and every operator is a streaming query with event-time watermarks, keyed
state and idempotent sinks.  ``run`` drives a query with ``availableNow`` into a
parquet table in the shared checkpoint folder (its checkpoint next to it), so a
restarted query resumes exactly once.
"""

from __future__ import annotations

import threading
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barwise.operators.scan import block_len
from barwise.session import scratch_path


def tick_stream(spark: SparkSession, glob: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """A file stream (a glob: the file source needs a directory or a pattern)."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return r.parquet(glob)


def run(df: DataFrame, mode: str = "append", name: str = "q", foreach=None) -> DataFrame:
    """Drive a streaming DataFrame to completion (``availableNow``) into a parquet table;
    return the table as a batch DataFrame."""
    return run_counted(df, mode, name, foreach)[0]


def run_counted(df: DataFrame, mode: str = "append", name: str = "q", foreach=None,
                closing: Closing | None = None) -> tuple[DataFrame, int]:
    """As :func:`run`, with the number of rows that the engine found behind the watermark and dropped: input rows of keyed
    state and of de-duplication, partial sums (a task's rows of one window) of aggregations.  With ``closing`` the
    query goes on from its checkpoint once all data are read, to the end of the session."""
    spark = df.sparkSession
    late = _Late()
    spark.streams.addListener(late)
    base = scratch_path(spark, f"stream-{name}-{uuid.uuid4().hex}")
    w = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/_checkpoint").trigger(availableNow=True)
    w = w.foreachBatch(lambda b, i: foreach(b, i, f"{base}/data")) if foreach is not None else \
        w.format("parquet").option("path", f"{base}/data")
    for last in (False, True) if closing else (True,):
        late.ended.clear()
        q = w.start()
        late.watched = str(q.id)
        q.awaitTermination()
        late.ended.wait(60)
        if not last:
            closing.end()
    spark.streams.removeListener(late)
    return spark.read.parquet(f"{base}/data"), sum(late.dropped.get(late.watched, {}).values())


class _Late(StreamingQueryListener):
    """Rows dropped by the watermark, by query and batch."""

    def __init__(self):
        self.dropped: dict[str, dict[int, int]] = {}
        self.watched, self.ended = "", threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.dropped.setdefault(str(p.id), {})[p.batchId] = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.id) == self.watched or not self.watched:
            self.ended.set()


def _append_batches(batch: DataFrame, batch_id: int, path: str) -> None:
    # overwrite of the batch's own folder: a replayed batch id rewrites, never duplicates
    batch.withColumn("_batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/_b={batch_id}")


def run_upserts(df: DataFrame, keys: list[str], name: str = "q") -> DataFrame:
    """Drive a stateful query in update mode; the sink keeps every emitted version of a
    key, and the table view is the latest version per key (an upsert by batch id).
    Open windows are included: no sentinel tick is needed at the end of the input."""
    out = run(df, "update", name, foreach=_append_batches)
    cols = [c for c in out.columns if c not in (*keys, "_batch_id", "_b")]
    last = out.groupBy(*keys).agg(F.max_by(F.struct(*cols), "_batch_id").alias("_v"))
    return last.select(*keys, "_v.*")


def _keyed(key: str, ts: str) -> Column:
    """Rows with a key.  It names the event time too, so the filter stays above the watermark and keyless rows move it."""
    return F.when(F.col(key).isNotNull(), F.col(ts)).isNotNull()


# ---------------------------------------------------------------- S01
def ohlcv(ticks: DataFrame, key: str, ts: str, px: str, interval: str = "1 hour", delay: str = "1 hour",
          order: list[str] | None = None, count_volume: bool = True, qty: str | None = None) -> DataFrame:
    """Tumbling OHLCV bars with a watermark (append: a bar is final once the watermark
    passes its end; later ticks for it are dropped and counted, see :func:`run_counted`).  Rows without a key, such as
    the :class:`Closing` row, only move the watermark."""
    t = ticks.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).filter(_keyed(key, ts))
    k = F.struct(*[F.col(x) for x in (order or [ts])])
    vol = F.count(F.lit(1)).cast("double") if count_volume else F.sum(qty).cast("double")
    g = t.groupBy(F.window(ts, interval).alias("w"), F.col(key).alias("symbol")).agg(
        F.min_by(px, k).alias("open"), F.max(px).alias("high"), F.min(px).alias("low"),
        F.max_by(px, k).alias("close"), vol.alias("volume"))
    return g.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close",
                    "volume")


# ---------------------------------------------------------------- S02
def sliding_stats(ticks: DataFrame, key: str, ts: str, x: str, size: str = "3 hours", slide: str = "1 hour",
                  delay: str = "1 hour") -> DataFrame:
    t = ticks.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    g = t.groupBy(F.window(ts, size, slide).alias("w"), F.col(key).alias("symbol")).agg(
        F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"), F.count(F.lit(1)).alias("n"))
    return g.select(
        "symbol", F.col("w.start").cast("timestamp_ntz").alias("window_start"),
        F.col("w.end").cast("timestamp_ntz").alias("window_end"), "mean", "min", "max", "n")


# ---------------------------------------------------------------- S03
def dedupe(ticks: DataFrame, keys: list[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """Idempotent refetch: overlapping re-deliveries of a key inside the watermark are dropped."""
    t = ticks.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return t.dropDuplicatesWithinWatermark(keys)


# ---------------------------------------------------------------- S04 / S05 keyed state
QUOTE_SCHEMA = "symbol string, ts timestamp, close double, prev_close double, change double, change_pct double"
QUOTE_STATE = "ts timestamp, seq long, close double, prev_close double"


def _quote_fn(key, pdfs, state: GroupState):
    last_ts, last_seq, last, prev = (state.get if state.exists else (None, None, None, None))
    for pdf in pdfs:
        pdf = pdf.sort_values(["ts", "seq"])
        for t, s, v in zip(pdf["ts"], pdf["seq"], pdf["value"]):
            if last_ts is None or (t, s) > (last_ts, last_seq):
                prev, last, last_ts, last_seq = last, v, t, s
    state.update((last_ts, last_seq, last, prev))
    chg = None if prev is None else last - prev
    pct = None if (prev is None or prev == 0) else (last - prev) / prev * 100
    yield pd.DataFrame({"symbol": [key[0]], "ts": [last_ts], "close": [last], "prev_close": [prev],
                        "change": [chg], "change_pct": [pct]})


def latest_quote(ticks: DataFrame, key: str, ts: str, px: str, seq: str) -> DataFrame:
    """Per-symbol state with the last and previous price (ordered by (ts, seq))."""
    t = ticks.select(F.col(key).alias("symbol"), F.col(ts).cast("timestamp").alias("ts"), F.col(seq).alias("seq"),
                     F.col(px).cast("double").alias("value"))
    return t.groupBy("symbol").applyInPandasWithState(_quote_fn, QUOTE_SCHEMA, QUOTE_STATE, "update",
                                                       GroupStateTimeout.NoTimeout)


SMOOTH_SCHEMA = "symbol string, ts timestamp, ema double, rsi double, late boolean"
SMOOTH_STATE = ("ts binary, close binary, ema double, n long, prev double, gain double, loss double, changes long, "
                "gains binary, losses binary, last long")


def recurrence(start: float, x: np.ndarray, q: float, a: float) -> np.ndarray:
    """``y = q * y + a * x`` from ``start`` over a run of values, block by block as in the batch scan."""
    out, block = np.empty(len(x)), block_len(q)
    for k in range(0, len(x), block):
        some = x[k:k + block]
        i = np.arange(len(some))
        out[k:k + block] = q ** i * (q * start + np.cumsum(a * some * q ** -i))
        start = out[k + len(some) - 1]
    return out


def _smooth_fn(span: int, n_rsi: int):
    a = 2.0 / (span + 1)

    def ema_of(ema, n, x):
        """EMAs of new values, null for the first span - 1 values of the symbol; and the new state."""
        first = ema is None
        y = recurrence(x[0] if first else ema, x[1:] if first else x, 1 - a, a)
        y = np.append(x[:1], y) if first else y
        shown = np.where(n + 1 + np.arange(len(x)) >= span, y, np.nan)
        return shown, float(y[-1]), n + len(x)

    def rsi_of(prev, held, means, changes, x):
        """Wilder RSI of new values; ``held`` are the changes before the first mean."""
        d = np.diff(np.append([np.nan if prev is None else prev], x))
        d = d[1:] if prev is None else d
        out = np.full(len(x), np.nan)
        at = len(x) - len(d)                    # place of the first change
        parts, new = [], []
        for k, v in enumerate((np.maximum(d, 0), np.maximum(-d, 0))):
            need = max(0, n_rsi - changes)
            held[k] = np.append(held[k], v[:need])
            y = np.full(len(v), np.nan)
            mean = means[k]
            if len(held[k]) == n_rsi and need and len(v) >= need:
                mean = held[k].mean()
                y[need - 1] = mean
            if mean is not None and len(v) > need:
                y[need:] = recurrence(mean, v[need:], (n_rsi - 1) / n_rsi, 1 / n_rsi)
            known = y[~np.isnan(y)]
            new.append(float(known[-1]) if len(known) else mean)
            parts.append(y)
        g, b = parts
        with np.errstate(divide="ignore", invalid="ignore"):
            out[at:] = np.where(np.isnan(g), np.nan, np.where(b > 0, 100 - 100 / (1 + g / b), 100.0))
        return out, float(x[-1]), held, new, changes + len(d)

    def fn(key, pdfs, state: GroupState):
        ts, close, ema, n, prev, gain, loss, changes, gains, losses, last = state.get if state.exists else (
            b"", b"", None, 0, None, None, None, 0, b"", b"", None)
        ts, close = [np.frombuffer(ts, "<i8")], [np.frombuffer(close, "<f8")]
        for pdf in pdfs:
            pdf = pdf[pdf["close"].notna()]
            ts.append(pdf["ts"].to_numpy().astype("datetime64[us]").astype("<i8"))
            close.append(pdf["close"].to_numpy().astype("<f8"))
        ts, close = np.concatenate(ts), np.concatenate(close)
        order = np.argsort(ts, kind="stable")
        ts, close = ts[order], close[order]
        once = np.append(True, np.diff(ts) > 0) if len(ts) else np.zeros(0, bool)     # a bar delivered twice counts once
        ts, close = ts[once], close[once]
        if last is not None and len(ts) and ts[0] <= last:
            old = int(np.searchsorted(ts, last, "right"))
            yield pd.DataFrame({"symbol": key[0], "ts": ts[:old].astype("datetime64[us]"), "ema": np.nan, "rsi": np.nan, "late": True})
            ts, close = ts[old:], close[old:]
        passed = state.getCurrentWatermarkMs() * 1000
        done = int(np.searchsorted(ts, passed, "right"))
        if done:
            x = close[:done]
            shown, ema, n = ema_of(ema, n, x)
            held = [np.frombuffer(gains, "<f8"), np.frombuffer(losses, "<f8")]
            rsi, prev, held, (gain, loss), changes = rsi_of(prev, held, [gain, loss], changes, x)
            gains, losses = (h.tobytes() if changes < n_rsi else b"" for h in held)
            yield pd.DataFrame({"symbol": key[0], "ts": ts[:done].astype("datetime64[us]"), "ema": shown, "rsi": rsi, "late": False})
            last = int(ts[done - 1])
        ts, close = ts[done:], close[done:]
        state.update((ts.tobytes(), close.tobytes(), ema, n, prev, gain, loss, changes, gains, losses, last))
        if len(ts):
            state.setTimeoutTimestamp(int(ts[0] // 1000) + 1)
    return fn


def incremental_smoothers(bars: DataFrame, span: int = 12, n_rsi: int = 14, delay: str = "1 hour") -> DataFrame:
    """EMA (y0 = x0, null for the first span - 1 bars) and Wilder RSI carried across micro-batches in
    keyed state; equal to the batch scans F01 and F03 however bars arrive inside the ``delay``.

    A symbol's bars wait in an ordered buffer until the watermark has passed them (an event-time timer wakes symbols
    without new bars), then go through the recurrences in time order.  The buffer holds the bars of one delay.
    A bar no newer than one already released comes too late: it is a row of its own with ``late`` true (a side output; those
    that the engine drops before are counted by :func:`run_counted`).  Bars delivered twice inside the delay
    count once.  A :class:`Closing` row releases the last bars.
    """
    b = bars.select("symbol", F.col("ts").cast("timestamp").alias("ts"), "close").withWatermark("ts", delay)
    return b.filter(_keyed("symbol", "ts")).groupBy("symbol").applyInPandasWithState(
        _smooth_fn(span, n_rsi), SMOOTH_SCHEMA, SMOOTH_STATE, "append", GroupStateTimeout.EventTimeTimeout)


class Closing:
    """The end of a session as a row of its own: null but for its time, after which nothing older is to come.

    ``stream`` is joined to the data stream by ``unionByName`` before the watermark; ``end(at)`` writes the row. Given to
    :func:`run_counted`, it does so when all data are read, and append mode writes what is still open."""

    def __init__(self, spark: SparkSession, like: T.StructType, ts: str, at):
        self.path = scratch_path(spark, f"closing-{uuid.uuid4().hex}")
        self.rows = spark.range(1, numPartitions=1).select(*[
            (F.lit(at) if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.fields])
        self.rows.limit(0).write.parquet(self.path)
        self.stream = tick_stream(spark, self.path, self.rows.schema)

    def end(self) -> None:
        self.rows.write.mode("append").parquet(self.path)


# ---------------------------------------------------------------- S06
#: Bars before a sequence that its features still depend on: the longest window of the basic set, and one bar back.
WARM_UP = 11


def with_history(batch: DataFrame, batch_id: int, store: str, keep: int) -> DataFrame:
    """A micro-batch's bars behind the last ``keep`` stored bars of every symbol.

    The store has one folder a batch id, written whole from the folder before and the batch, so a replayed
    batch reads the same history and replaces its own folder.  A bar delivered again replaces the stored one.
    """
    from barwise.operators.segments import last_rows
    spark = batch.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [int(s.getPath().getName().split("=")[1]) for s in (fs.listStatus(hadoop) if fs.exists(hadoop) else ())
            if s.getPath().getName().startswith("after=")]
    before = max((k for k in done if k < batch_id), default=None)
    both = batch.withColumn("_new", F.lit(1))
    if before is not None:
        old = spark.read.schema(batch.schema).parquet(f"{store}/after={before}").withColumn("_new", F.lit(0))
        both = both.unionByName(old)
    cells = [c for c in batch.columns if c not in ("symbol", "ts")]
    both = both.groupBy("symbol", "ts").agg(F.max_by(F.struct(*cells), "_new").alias("_b"), F.max("_new").alias("_new"))
    both = both.select("symbol", "ts", "_b.*", "_new")
    last_rows(both, keep).drop("_k", "_new").select(*batch.columns).write.mode("overwrite").parquet(f"{store}/after={batch_id}")
    return both


def scoring_sink(model, feats: list[str], lookback: int):
    """foreachBatch body: features of the stored and the new bars, latest sequence of every symbol with
    new bars, score with the saved model, predictions written whole per batch id."""
    from barwise.operators import labels as K
    from barwise.operators import ml as R
    from barwise.plans.featuresets import basic_set

    def body(batch: DataFrame, batch_id: int, path: str):
        bars = batch.filter("symbol is not null").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        rows = with_history(bars, batch_id, f"{path}-store", lookback + WARM_UP)
        seen = rows.filter("_new = 1").select("symbol").distinct()
        seq = K.latest_sequence(basic_set(rows.drop("_new")), feats, lookback).withColumn("target", F.lit(None).cast("double"))
        p = R.score(model, seq.join(seen, "symbol", "left_semi"), "logistic").withColumn("batch_id", F.lit(batch_id))
        p.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return body
