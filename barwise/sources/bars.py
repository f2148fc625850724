"""Bar sources, ingestion and quality.

The canonical bar schema is ``symbol string, ts timestamp_ntz, open, high, low,
close, volume double`` with key ``(symbol, ts)``.  All symbols live in one DataFrame.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwise.functions.core import div

BAR_COLS = ["symbol", "ts", "open", "high", "low", "close", "volume"]

BAR_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType(), False),
    T.StructField("ts", T.TimestampNTZType(), False),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.DoubleType()),
])

# Explicit schemas of the driver tables we read (no inference, columns pruned at the scan)
LINEITEM_SCHEMA = T.StructType([
    T.StructField("l_orderkey", T.LongType()), T.StructField("l_partkey", T.LongType()),
    T.StructField("l_suppkey", T.LongType()), T.StructField("l_linenumber", T.IntegerType()),
    T.StructField("l_quantity", T.DoubleType()), T.StructField("l_extendedprice", T.DoubleType()),
    T.StructField("l_discount", T.DoubleType()), T.StructField("l_tax", T.DoubleType()),
    T.StructField("l_returnflag", T.StringType()), T.StructField("l_linestatus", T.StringType()),
    T.StructField("l_shipdate", T.TimestampNTZType()),
])
PART_SCHEMA = T.StructType([
    T.StructField("p_partkey", T.LongType()), T.StructField("p_name", T.StringType()),
    T.StructField("p_brand", T.StringType()), T.StructField("p_type", T.StringType()),
    T.StructField("p_size", T.IntegerType()), T.StructField("p_retailprice", T.DoubleType()),
])
EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])
CUSTOMER_SCHEMA = T.StructType([
    T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()),
    T.StructField("c_nationkey", T.IntegerType()), T.StructField("c_acctbal", T.DoubleType()),
    T.StructField("c_mktsegment", T.StringType()),
])
SCHEMAS = {"lineitem": LINEITEM_SCHEMA, "part": PART_SCHEMA, "events": EVENTS_SCHEMA,
           "customer": CUSTOMER_SCHEMA}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Scan one driver table with its explicit schema."""
    r = spark.read
    if name in SCHEMAS:
        r = r.schema(SCHEMAS[name])
    return r.parquet(f"{d.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- A01 scan
def read_bars(spark: SparkSession, path: str, fmt: str = "parquet", mapping: dict | None = None,
              schema: T.StructType | None = None) -> DataFrame:
    """Scan bars from files with an explicit schema, mapped to the bar columns.

    ``mapping`` maps bar column -> source column (or Column); NaN becomes null at the scan.
    """
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        r = r.option("header", "true")
    df = r.load(path)
    mapping = mapping or {k: k for k in BAR_COLS}
    cols = []
    for k in BAR_COLS:
        src = mapping.get(k)
        col = F.col(src) if isinstance(src, str) else src
        if k == "symbol":
            col = col.cast("string")
        elif k == "ts":
            col = col.cast("timestamp_ntz")
        else:
            col = F.nanvl(col.cast("double"), F.lit(None).cast("double"))
        cols.append(col.alias(k))
    return df.select(*cols)


# ---------------------------------------------------------------- A02 ticks -> bars
_UNIT_SECONDS = {"m": 60, "h": 3600, "d": 86400}


def interval_seconds(interval: str) -> int:
    """'1m','5m','15m','30m','60m','1h','6h','1d','5d' -> seconds."""
    n, unit = int(interval[:-1]), interval[-1]
    return n * _UNIT_SECONDS[unit]


def bucket(ts: Column | str, interval: str | None) -> Column:
    """Epoch-aligned bucket start of a zone-naive timestamp."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    if interval is None:
        return ts
    s = interval_seconds(interval)
    # zone-naive -> seconds since epoch (session zone is UTC), floor to the bucket
    secs = F.unix_seconds(ts.cast("timestamp"))
    return F.timestamp_seconds(secs - F.pmod(secs, F.lit(s))).cast("timestamp_ntz")


def order_key(df: DataFrame, order: list[str] | dict[str, int]) -> Column:
    """One value in the order of ``order``.  Columns with their widths in bits (non-negative whole numbers or times, 126 bits
    in all) are packed into one number of fixed width, which lets ``min_by``/``max_by`` aggregate in a hash
    table; a value that does not fit its width fails the job.  Without widths it is a struct, which needs a sort."""
    if not isinstance(order, dict):
        return F.struct(*[F.col(c) for c in order])
    types = dict(df.dtypes)
    longs, free = [], 0
    for c, bits in order.items():
        x = F.unix_micros(F.col(c).cast("timestamp")) if types[c].startswith("timestamp") else F.col(c).cast("bigint")
        x = F.when((x >= 0) & (x <= (1 << bits) - 1), x).when(x.isNotNull(), F.raise_error(F.lit(f"{c} does not fit {bits} bits")).cast("bigint"))
        if bits <= free:
            longs[-1] = (F.shiftleft(longs[-1][0], bits).bitwiseOR(x), longs[-1][1] + bits)
            free -= bits
        else:
            longs.append((x, bits))
            free = 63 - bits
    if sum(order.values()) > 126 or len(longs) > 2:
        raise ValueError("an order key has 126 bits at most, in two runs of 63")
    if len(longs) == 1:
        return longs[0][0]
    high, low = (x.cast("decimal(19,0)") for x, _ in longs)
    return (high * F.lit(Decimal(1 << longs[1][1])) + low).cast("decimal(38,0)")


def to_bars(ticks: DataFrame, key: str, ts: str, px: str, qty: str | None, interval: str | None,
            order: list[str] | dict[str, int] | None = None, count_volume: bool = False) -> DataFrame:
    """Ticks -> OHLCV bars per (key, bucket).

    open/close are the price of the first/last tick by ``order`` (a unique tie-break key,
    default the tick time); min_by/max_by aggregate partially on the map side, so a hot
    symbol is pre-aggregated before the shuffle, in a hash table where the key has a fixed width.
    """
    k = order_key(ticks, order or [ts])
    vol = F.count(F.lit(1)).cast("double") if count_volume else F.sum(F.col(qty)).cast("double")
    return (ticks.groupBy(F.col(key).cast("string").alias("symbol"), bucket(ts, interval).alias("ts"))
            .agg(F.min_by(F.col(px), k).alias("open"), F.max(px).alias("high"),
                 F.min(px).alias("low"), F.max_by(F.col(px), k).alias("close"),
                 vol.alias("volume")))


# ---------------------------------------------------------------- A03 calendar roll-up
_ROLL = {"1wk": "week", "1mo": "month", "3mo": "quarter"}


def rollup_bars(bars: DataFrame, unit: str) -> DataFrame:
    """Re-aggregate bars to calendar weeks (Monday), months or quarters."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return (bars.groupBy("symbol", F.date_trunc(_ROLL[unit], "ts").cast("timestamp_ntz").alias("ts"))
            .agg(F.min_by("open", at).alias("open"), F.max("high").alias("high"),
                 F.min("low").alias("low"), F.max_by("close", at).alias("close"),
                 F.sum("volume").alias("volume")))


# ---------------------------------------------------------------- A04 period filter
# Look-back period names and their lengths
PERIODS = {"1d": ("day", 1), "5d": ("day", 5), "1mo": ("month", 1), "3mo": ("month", 3),
           "6mo": ("month", 6), "1y": ("month", 12), "2y": ("month", 24), "5y": ("month", 60),
           "10y": ("month", 120), "ytd": ("ytd", 0), "max": ("max", 0)}


def period(bars: DataFrame, p: str) -> DataFrame:
    """Keep bars with ts >= last bar of the symbol minus the period."""
    unit, n = PERIODS[p]
    if unit == "max":
        return bars
    from pyspark.sql import Window
    last = F.max("ts").over(Window.partitionBy("symbol"))
    if unit == "ytd":
        start = F.date_trunc("year", last).cast("timestamp_ntz")
    elif unit == "day":
        start = last - F.expr(f"interval {n} days")
    else:
        start = last - F.expr(f"interval {n} months")
    return bars.withColumn("_start", start).filter(F.col("ts") >= F.col("_start")).drop("_start")


# ---------------------------------------------------------------- A05 / A06 normalisation
def normalise_columns(df: DataFrame) -> DataFrame:
    """Lower-case names, blanks -> '_', 'date' -> 'timestamp', vendor '1. open' -> 'open'."""
    import re
    names = []
    for n in df.columns:
        m = re.match(r"^\s*\d+\.\s*(.*)$", n)
        n2 = (m.group(1) if m else n).strip().lower().replace(" ", "_")
        if n2 == "date":
            n2 = "timestamp"
        names.append(n2)
    return df.toDF(*names)


def strip_tz(df: DataFrame, col: str = "ts") -> DataFrame:
    """Zone-aware timestamp -> zone-naive wall clock in the session zone."""
    return df.withColumn(col, F.col(col).cast("timestamp_ntz"))


# ---------------------------------------------------------------- A07 panel
def panel(frames: dict[str, DataFrame | None]) -> DataFrame:
    """Union per-symbol frames into one panel; a missing (failed) frame is skipped."""
    out = None
    for sym, f in frames.items():
        if f is None:
            continue
        if "symbol" not in f.columns:
            f = f.withColumn("symbol", F.lit(sym))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


# ---------------------------------------------------------------- A08 source fallback
def resolve_source(requested: DataFrame, available: DataFrame, req_col: str = "requested",
                   key_col: str = "symbol", source_col: str = "source",
                   source_priority: dict[str, int] | None = None) -> DataFrame:
    """Candidates (given, upper, '.NS', '.BO') x sources, first one with data wins.

    ``available`` lists (source, symbol) keys that have data.  The candidate table is
    4 rows per request, joined on the key: a shuffle join, no broadcast of data.
    """
    from pyspark.sql import Window
    q = F.col(req_col)
    cands = requested.select(req_col, F.explode(F.array(
        F.struct(F.lit(1).alias("cand_rank"), q.alias("candidate")),
        F.struct(F.lit(2).alias("cand_rank"), F.upper(q).alias("candidate")),
        F.struct(F.lit(3).alias("cand_rank"), F.concat(q, F.lit(".NS")).alias("candidate")),
        F.struct(F.lit(4).alias("cand_rank"), F.concat(q, F.lit(".BO")).alias("candidate")),
    )).alias("c")).select(req_col, "c.*")
    prio = source_priority or {}
    src_rank = F.lit(99)
    for s, r in prio.items():
        src_rank = F.when(F.col(source_col) == s, F.lit(r)).otherwise(src_rank)
    av = available.select(F.col(key_col).alias("candidate"), F.col(source_col)).distinct() \
        .withColumn("src_rank", src_rank)
    j = cands.join(av, "candidate", "left")
    w = Window.partitionBy(req_col).orderBy(F.col("src_rank").asc_nulls_last(), "cand_rank")
    best = j.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    return best.select(req_col, F.when(F.col(source_col).isNotNull(), F.col("candidate")).alias("resolved"),
                       F.col(source_col), F.when(F.col(source_col).isNotNull(), F.col("cand_rank")).alias("cand_rank"))


# ---------------------------------------------------------------- A10 freshness
def fresh(log: DataFrame, now: Column, ttl_hours: float = 6.0, loaded_at: str = "loaded_at") -> DataFrame:
    """A10: age of each cache entry and whether it is within the TTL."""
    age = (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col(loaded_at).cast("timestamp"))) / 3600.0
    return log.withColumn("age_hours", age).withColumn("fresh", (F.col("age_hours") <= ttl_hours).cast("int"))


def within_ttl(bars: DataFrame, log: DataFrame, now, ttl_hours: float = 6.0) -> DataFrame:
    """A10: the cached rows that may still be served: of keys loaded within the TTL."""
    return bars.join(fresh(log, now, ttl_hours=ttl_hours).filter("fresh = 1").select("symbol"), "symbol", "left_semi")


def stale_keys(asked: DataFrame, log: DataFrame, now, ttl_hours: float = 6.0) -> DataFrame:
    """A10: keys asked for that must be loaded again: older than the TTL, or never loaded."""
    return asked.join(fresh(log, now, ttl_hours=ttl_hours).filter("fresh = 1").select("symbol"), "symbol", "left_anti")


# ---------------------------------------------------------------- A11 ordering
def ordered(bars: DataFrame) -> DataFrame:
    """Row number in time order per symbol."""
    from barwise.operators.segments import positions
    return positions(bars).withColumn("rn", F.col("_pos").cast("int")).drop("_pos", "_n")


# ---------------------------------------------------------------- A12 validation
def validate(bars: DataFrame) -> DataFrame:
    """Per-symbol quality report; negative prices or high < low fail, nulls warn."""
    missing = [c for c in ("open", "high", "low", "close", "volume") if c not in bars.columns]
    price = [c for c in ("open", "high", "low", "close") if c in bars.columns]
    null_any = F.lit(False)
    neg_any = F.lit(False)
    for c_ in price:
        null_any = null_any | F.col(c_).isNull()
        neg_any = neg_any | (F.col(c_) < 0)
    hl = (F.col("high") < F.col("low")) if {"high", "low"} <= set(bars.columns) else F.lit(False)
    rep = bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(null_any).alias("n_null_price"),
        F.count_if(F.coalesce(neg_any, F.lit(False))).alias("n_negative"),
        F.count_if(F.coalesce(hl, F.lit(False))).alias("n_high_lt_low"))
    return rep.withColumn("n_missing_cols", F.lit(len(missing))).withColumn(
        "valid", ((F.col("n_missing_cols") == 0) & (F.col("n_rows") > 0) & (F.col("n_negative") == 0)
                  & (F.col("n_high_lt_low") == 0)).cast("int"))


# ---------------------------------------------------------------- A13 history gate
def min_history(bars: DataFrame, n: int) -> DataFrame:
    """Keep symbols with at least n bars (rows counted by block)."""
    from barwise.operators.segments import positions
    return positions(bars).filter(F.col("_n") >= n).drop("_pos", "_n")


# ---------------------------------------------------------------- fixtures (FIXTURES.md §2, §5)
def brand_ticks(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                           "l_quantity", "l_extendedprice", "l_shipdate")
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    return li.join(p, li.l_partkey == p.p_partkey).withColumn(
        "px", div("l_extendedprice", "l_quantity"))


def bars_brand(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars per part brand from lineitem x part (25 symbols, 1995-2001)."""
    return to_bars(brand_ticks(spark, d), "p_brand", "l_shipdate", "px", "l_quantity", None,
                   order={"l_orderkey": 50, "l_linenumber": 13, "l_partkey": 32, "l_suppkey": 31})


def bars_event(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars per event type (5 symbols, January 2024)."""
    return to_bars(table(spark, d, "events"), "event_type", "ts", "value", None, "1h",
                   order={"ts": 58, "event_id": 63}, count_volume=True)


def bars_user(spark: SparkSession, d: str) -> DataFrame:
    """6-hourly bars per user (many short symbols)."""
    return to_bars(table(spark, d, "events"), "user_id", "ts", "value", None, "6h",
                   order={"ts": 58, "event_id": 63}, count_volume=True)


def bars_dirty(spark: SparkSession, d: str) -> DataFrame:
    """bars_brand with planted defects by row number per symbol."""
    from barwise.operators.segments import positions
    b = positions(bars_brand(spark, d)).withColumn("_n", F.col("_pos"))
    swap = F.col("_n") % 101 == 0
    return b.select(
        "symbol", "ts", "open",
        F.when(swap, F.col("low")).otherwise(F.col("high")).alias("high"),
        F.when(swap, F.col("high")).otherwise(F.col("low")).alias("low"),
        F.when(F.col("_n") % 89 == 0, F.lit(None).cast("double"))
         .when(F.col("_n") % 97 == 0, -F.col("close")).otherwise(F.col("close")).alias("close"),
        "volume")


FIXTURES = {"bars_brand": bars_brand, "bars_event": bars_event, "bars_user": bars_user,
            "bars_dirty": bars_dirty}


def feat_dirty(spark: SparkSession, d: str) -> DataFrame:
    """Feature frame with planted cleaning cases (nulls, outliers, sparse, constant, huge, inf)."""
    from barwise.functions.core import lag
    from barwise.operators.segments import positions, segmented
    b = segmented(positions(bars_brand(spark, d)), lambda b: b.withColumn("_before", lag("close")), lookback=1)
    n = F.col("_pos")

    def planted(x):
        return F.when(n % 53 == 0, F.lit(None).cast("double")).when(n % 71 == 0, F.col(x) * 1e6).otherwise(F.col(x))
    return b.select("symbol", "ts", planted("close").alias("f_close"), planted("volume").alias("f_volume"),
                    F.when(n % 3 == 0, F.col("close")).alias("f_sparse"), F.lit(1.0).alias("f_const"),
                    (F.col("close") * 1e12).alias("f_big"),
                    F.when(n % 61 == 0, F.lit(float("inf"))).otherwise(
                        div("close", "_before")).alias("f_ratio"),
                    "close")
