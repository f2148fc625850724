"""Registered queries for sources, ingestion, quality (A) and the symbol dimension (B)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from barwise.plans.registry import query
from barwise.sources import bars as B
from barwise.sources import dims as D
from barwise.session import scratch_path

BARS = "symbol:s, ts:t, open:d, high:d, low:d, close:d, volume:d"


@query("a01_read_bars", BARS, """
select event_type as symbol, ts, value as "open", value as high, value as low, value as "close",
       1.0 as volume from events""")
def _a01(spark, d):
    return B.read_bars(spark, f"{d}/events.parquet", schema=B.EVENTS_SCHEMA, mapping={
        "symbol": "event_type", "ts": "ts", "open": "value", "high": "value", "low": "value",
        "close": "value", "volume": F.lit(1.0)})


@query("a02_to_bars", BARS, "select * from bars_event")
def _a02(spark, d):
    return B.bars_event(spark, d)


@query("a02_to_bars_6h", BARS, "select * from bars_user")
def _a02b(spark, d):
    return B.bars_user(spark, d)


@query("a02_to_bars_daily", BARS, "select * from bars_brand")
def _a02c(spark, d):
    return B.bars_brand(spark, d)


@query("a03_rollup_bars", BARS, """
select symbol, date_trunc('week', ts) as ts, arg_min("open", ts) as "open", max(high) as high,
       min(low) as low, arg_max("close", ts) as "close", sum(volume) as volume
from bars_brand group by 1, 2""")
def _a03(spark, d):
    return B.rollup_bars(B.bars_brand(spark, d), "1wk")


@query("a03_rollup_bars_quarter", BARS, """
select symbol, date_trunc('quarter', ts) as ts, arg_min("open", ts) as "open", max(high) as high,
       min(low) as low, arg_max("close", ts) as "close", sum(volume) as volume
from bars_brand group by 1, 2""")
def _a03b(spark, d):
    return B.rollup_bars(B.bars_brand(spark, d), "3mo")


@query("a04_period", BARS, """
select symbol, ts, "open", high, low, "close", volume
from (select *, max(ts) over (partition by symbol) as _last from bars_brand) as _b
where ts >= _last - interval 12 month""")
def _a04(spark, d):
    return B.period(B.bars_brand(spark, d), "1y")


@query("a04_period_ytd", BARS, """
select symbol, ts, "open", high, low, "close", volume
from (select *, max(ts) over (partition by symbol) as _last from bars_brand) as _b
where ts >= date_trunc('year', _last)""")
def _a04b(spark, d):
    return B.period(B.bars_brand(spark, d), "ytd")


@query("a05_normalise_columns", "symbol:s, timestamp:t, open:d, high:d, low:d, close:d, volume:d",
       'select symbol, ts as "timestamp", "open", high, low, "close", volume from bars_event')
def _a05(spark, d):
    vendor = B.bars_event(spark, d).select(
        F.col("ts").alias("Date"), F.col("open").alias("1. open"), F.col("high").alias("2. high"),
        F.col("low").alias("3. low"), F.col("close").alias("4. close"),
        F.col("volume").alias("5. volume"), F.col("symbol").alias("Symbol"))
    return B.normalise_columns(vendor)


@query("a06_strip_tz", BARS, "select * from bars_event")
def _a06(spark, d):
    aware = B.bars_event(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return B.strip_tz(aware)


@query("a07_panel", BARS + ", src:s", """
select *, null as src from bars_event
union all select *, 'user' as src from bars_user""")
def _a07(spark, d):
    return B.panel({"event": B.bars_event(spark, d), "failed": None,
                    "user": B.bars_user(spark, d).withColumn("src", F.lit("user"))})


@query("a08_resolve_source", "requested:s, resolved:s, source:s, cand_rank:i", """
with req as (select distinct symbol as requested from bars_user),
cands as (select requested, 1 as cand_rank, requested as candidate from req
          union all select requested, 2, upper(requested) from req
          union all select requested, 3, requested || '.NS' from req
          union all select requested, 4, requested || '.BO' from req),
av as (select distinct market_symbol as candidate, 'vendor1' as source from dim
       where cast(symbol as bigint) % 2 = 0
       union select distinct symbol as candidate, 'vendor2' as source from dim),
j as (select c.*, av.source,
             case av.source when 'vendor1' then 1 when 'vendor2' then 2 else 99 end as src_rank
      from cands c left join av using (candidate)),
r as (select *, row_number() over (partition by requested order by src_rank, cand_rank) as _r from j)
select requested, case when source is not null then candidate end as resolved, source,
       case when source is not null then cand_rank end as cand_rank
from r where _r = 1""")
def _a08(spark, d):
    req = B.bars_user(spark, d).select(F.col("symbol").alias("requested")).distinct()
    dim = D.dim_symbols(spark, d)
    av = dim.filter(F.col("symbol").cast("bigint") % 2 == 0).select(
        F.col("market_symbol").alias("symbol"), F.lit("vendor1").alias("source")).unionByName(
        dim.select("symbol", F.lit("vendor2").alias("source")))
    return B.resolve_source(req, av, source_priority={"vendor1": 1, "vendor2": 2})


@query("a09_cache_roundtrip", BARS, "select * from bars_user")
def _a09(spark, d):
    from barwise.sources.cache import read_cache, write_cache
    path = scratch_path(spark, f"cache-{uuid.uuid4().hex}")
    bars = B.bars_user(spark, d)
    write_cache(bars, path, source="events", interval="6h")
    return read_cache(spark, path, source="events", interval="6h")


@query("a10_fresh", "symbol:s, loaded_at:t, age_hours:d, fresh:i", """
with log as (select symbol, max(ts) as loaded_at from bars_user group by 1),
n as (select max(loaded_at) as now from log)
select symbol, loaded_at, (epoch(now) - epoch(loaded_at)) / 3600.0 as age_hours,
       cast((epoch(now) - epoch(loaded_at)) / 3600.0 <= 6 as integer) as fresh
from log, n""")
def _a10(spark, d):
    log = B.bars_user(spark, d).groupBy("symbol").agg(F.max("ts").alias("loaded_at"))
    now = log.agg(F.max("loaded_at")).first()[0]   # one scalar parameter
    return B.fresh(log, F.lit(now).cast("timestamp_ntz"), ttl_hours=6.0)


@query("a10_fresh_rows", "symbol:s, ts:t, close:d", """
with log as (select symbol, max(ts) as loaded_at from bars_user group by 1), n as (select max(loaded_at) as now from log)
select symbol, ts, "close" from bars_user where symbol in (
  select symbol from log, n where (epoch(now) - epoch(loaded_at)) / 3600.0 <= 48)""")
def _a10b(spark, d):
    bars = B.bars_user(spark, d)
    log = bars.groupBy("symbol").agg(F.max("ts").alias("loaded_at"))
    now = log.agg(F.max("loaded_at")).first()[0]
    return B.within_ttl(bars, log, F.lit(now).cast("timestamp_ntz"), ttl_hours=48.0)


@query("a10_stale_keys", "symbol:s, asked:s", """
with log as (select symbol, max(ts) as loaded_at from bars_user group by 1), n as (select max(loaded_at) as now from log),
fresh as (select symbol from log, n where (epoch(now) - epoch(loaded_at)) / 3600.0 <= 48)
select c as symbol, 'refetch' as asked from (select distinct cast(c_custkey as varchar) as c from customer) as _c
where c not in (select symbol from fresh)""")
def _a10c(spark, d):
    log = B.bars_user(spark, d).groupBy("symbol").agg(F.max("ts").alias("loaded_at"))
    now = log.agg(F.max("loaded_at")).first()[0]
    asked = B.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("symbol")).distinct()
    return B.stale_keys(asked, log, F.lit(now).cast("timestamp_ntz"), ttl_hours=48.0).withColumn("asked", F.lit("refetch"))


@query("a11_ordered", "symbol:s, ts:t, rn:l", """
select symbol, ts, row_number() over (partition by symbol order by ts) as rn from bars_brand""")
def _a11(spark, d):
    return B.ordered(B.bars_brand(spark, d))


@query("a12_validate", "symbol:s, n_rows:l, n_null_price:l, n_negative:l, n_high_lt_low:l, "
       "n_missing_cols:i, valid:i", """
select symbol, count(*) as n_rows,
       count(*) filter (where "open" is null or high is null or low is null or "close" is null) as n_null_price,
       count(*) filter (where coalesce("open" < 0 or high < 0 or low < 0 or "close" < 0, false)) as n_negative,
       count(*) filter (where coalesce(high < low, false)) as n_high_lt_low,
       0 as n_missing_cols,
       cast(count(*) > 0
            and count(*) filter (where coalesce("open" < 0 or high < 0 or low < 0 or "close" < 0, false)) = 0
            and count(*) filter (where coalesce(high < low, false)) = 0 as integer) as valid
from bars_dirty group by symbol""")
def _a12(spark, d):
    return B.validate(B.bars_dirty(spark, d))


@query("a13_min_history", BARS, """
select symbol, ts, "open", high, low, "close", volume
from (select *, count(*) over (partition by symbol) as _n from bars_user) as _b where _n >= 50""")
def _a13(spark, d):
    return B.min_history(B.bars_user(spark, d), 50)


# ------------------------------------------------------------------ B: dimension
DIM_BRIEF = "symbol:s, name:s, category:s"


@query("b01_enrich", "symbol:s, n_bars:l, name:s, category:s", """
select b.symbol, b.n_bars, coalesce(d.name, 'Unknown') as name, coalesce(d.category, 'Unknown') as category
from (select symbol, count(*) as n_bars from bars_user group by 1) as b
left join (select * from dim where cast(symbol as bigint) % 13 <> 0) as d using (symbol)""")
def _b01(spark, d):
    bars = B.bars_user(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"))
    dim = D.dim_symbols(spark, d).filter(F.col("symbol").cast("bigint") % 13 != 0)
    return D.enrich(bars, dim)


@query("b02_flatten_dim", DIM_BRIEF, "select symbol, name, category from dim")
def _b02(spark, d):
    dim = D.dim_symbols(spark, d)
    # nested input: one bounded map per (category, block of 1,000 keys)
    nested = dim.groupBy("category", F.floor(F.col("symbol").cast("bigint") / 1000).alias("blk")).agg(
        F.map_from_entries(F.collect_list(F.struct("symbol", "name"))).alias("members"))
    return D.flatten_dim(nested)


@query("b03_search", DIM_BRIEF, """
select symbol, name, category from dim
where contains(lower(symbol), '0012') or contains(lower(name), '0012')""")
def _b03(spark, d):
    return D.search(D.dim_symbols(spark, d), "0012")


@query("b04_expand_candidates", "q:s, candidate:s", """
with qs as (select market_symbol as q from dim
            union select replace(lower(name), '#', '') as q from dim),
empty as (select q from qs where not exists (
            select 1 from dim where contains(lower(dim.symbol), lower(qs.q)) or contains(lower(dim.name), lower(qs.q)))),
cand as (select q, case when upper(q) like '%.NS' or upper(q) like '%.BO'
                        then [regexp_replace(upper(q), '\\.(NS|BO)$', '')]
                        else [upper(q) || '.NS', upper(q) || '.BO'] end as cs from empty),
known as (select upper(market_symbol) as candidate from dim union select upper(symbol) from dim)
select distinct q, candidate from (select q, unnest(cs) as candidate from cand) as x
where candidate in (select candidate from known)""")
def _b04(spark, d):
    dim = D.dim_symbols(spark, d)
    qs = dim.select(F.col("market_symbol").alias("q")).union(
        dim.select(F.replace(F.lower("name"), F.lit("#"), F.lit("")).alias("q"))).distinct()
    return D.expand_candidates(qs, dim)


@query("b05_by_category", DIM_BRIEF, "select symbol, name, category from dim where category = 'BUILDING'")
def _b05(spark, d):
    return D.by_category(D.dim_symbols(spark, d), "BUILDING")


@query("b06_sample_symbols", DIM_BRIEF, "select symbol, name, category from dim "
       "order by cast(('0x' || substr(md5(symbol || '|42'), 1, 15)) as bigint), symbol limit 20")
def _b06(spark, d):
    return D.sample_symbols(D.dim_symbols(spark, d), 20, seed=42)


@query("b07_tag", "symbol:s, tag:s", """
select symbol, 'popular' as tag from dim where popular
union all select symbol, 'volatile' from dim where volatile
union all select symbol, 'stable' from dim where stable""")
def _b07(spark, d):
    dim = D.dim_symbols(spark, d)
    tags = {t: dim.filter(F.col(t)).select("symbol") for t in ("popular", "volatile", "stable")}
    return D.tag(dim, tags)


@query("b08_category_counts", "category:s, n_symbols:l",
       "select category, count(*) as n_symbols from dim group by 1")
def _b08(spark, d):
    return D.category_counts(D.dim_symbols(spark, d))


@query("b09_peers", "symbol:s, category:s, peer:s, peer_rank:i", """
with ranked as (select category, symbol as peer,
                       row_number() over (partition by category order by symbol) as _r from dim),
req as (select distinct b.symbol, d.category from bars_user b join dim d using (symbol)),
j as (select req.symbol, req.category, ranked.peer from req join ranked
      on ranked.category = req.category and ranked._r <= 6 where ranked.peer <> req.symbol)
select * from (select symbol, category, peer,
                      row_number() over (partition by symbol order by peer) as peer_rank from j) as x
where peer_rank <= 5""")
def _b09(spark, d):
    req = B.bars_user(spark, d).select("symbol").distinct()
    return D.peers(D.dim_symbols(spark, d), req, 5)


@query("b10_listing", "category:s, symbol:s, pos:i", """
select * from (select category, symbol, row_number() over (partition by category order by symbol) as pos
               from dim) as x where pos <= 3""")
def _b10(spark, d):
    return D.listing(D.dim_symbols(spark, d), 3).select("category", "symbol", "pos")


@query("b11_currency", "market_symbol:s, currency:s", """
select market_symbol, case when upper(market_symbol) like '%.NS' or upper(market_symbol) like '%.BO'
                           then 'INR' else 'USD' end as currency from dim""")
def _b11(spark, d):
    return D.dim_symbols(spark, d).select("market_symbol", D.currency("market_symbol").alias("currency"))


@query("b13_align", "symbol:s, ts:t, close:d, next_close:d", """
select a.symbol, a.ts, a."close", b.next_close
from bars_brand a join (select symbol, ts, lead("close") over (partition by symbol order by ts) as next_close
                        from bars_brand) b using (symbol, ts)""")
def _b13(spark, d):
    bars = B.bars_brand(spark, d)
    feats = bars.select("symbol", "ts", "close")
    target = bars.select("symbol", "ts", F.lead("close").over(
        Window.partitionBy("symbol").orderBy("ts")).alias("next_close"))
    return D.align(feats, target)

