"""DuckDB forms of the shared fixtures (bars, dimension, predictions) for the oracle.

They are the SQL twins of :mod:`barwise.sources.bars`, :mod:`barwise.sources.dims` and
:mod:`barwise.operators.predictions`; ``with_fixtures`` prepends only the CTEs a
query text mentions.
"""

from __future__ import annotations

import re

FIXTURE_SQL: dict[str, str] = {}

FIXTURE_SQL["bars_brand"] = """
select p_brand as symbol, l_shipdate as ts,
       arg_min(px, k) as "open", max(px) as high, min(px) as low, arg_max(px, k) as "close",
       sum(l_quantity) as volume
from (select p_brand, l_shipdate, l_quantity, l_extendedprice / l_quantity as px,
             row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) as k
      from lineitem join part on l_partkey = p_partkey) as _t
group by 1, 2"""

FIXTURE_SQL["bars_event"] = """
select event_type as symbol, time_bucket(interval '1 hour', ts, timestamp '1970-01-01') as ts,
       arg_min(value, row(ts, event_id)) as "open", max(value) as high, min(value) as low,
       arg_max(value, row(ts, event_id)) as "close", cast(count(*) as double) as volume
from events group by 1, 2"""

FIXTURE_SQL["bars_user"] = """
select cast(user_id as varchar) as symbol, time_bucket(interval '6 hours', ts, timestamp '1970-01-01') as ts,
       arg_min(value, row(ts, event_id)) as "open", max(value) as high, min(value) as low,
       arg_max(value, row(ts, event_id)) as "close", cast(count(*) as double) as volume
from events group by 1, 2"""

FIXTURE_SQL["bars_dirty"] = """
select symbol, ts, "open",
       case when n % 101 = 0 then low else high end as high,
       case when n % 101 = 0 then high else low end as low,
       case when n % 89 = 0 then null when n % 97 = 0 then -"close" else "close" end as "close",
       volume
from (select *, row_number() over (partition by symbol order by ts) as n from bars_brand) as _d"""

FIXTURE_SQL["dim"] = """
select cast(c_custkey as varchar) as symbol, c_name as name, c_mktsegment as category,
       c_custkey % 7 = 0 as popular, c_custkey % 11 = 0 as volatile, c_custkey % 5 = 0 as stable,
       cast(c_custkey as varchar) || case c_nationkey % 5 when 0 then '.NS' when 1 then '.BO' else '' end
         as market_symbol
from customer"""

FIXTURE_SQL["preds"] = """
select symbol, ts, model, y_true,
       (350 * y_true + (650 * h) // 1000) / 1000.0 as y_score,
       next_close as price_true,
       "close" * (950 + h // 10) / 1000.0 as price_pred, "close" as price_now
from (select symbol, ts, model, "close", next_close,
             cast("close" < next_close as integer) as y_true,
             cast(('0x' || substr(md5(symbol || '|' || cast(cast(epoch(ts) as bigint) as varchar) || '|' || model), 1, 8))
                  as bigint) % 1000 as h
      from (select symbol, ts, "close", lead("close") over (partition by symbol order by ts) as next_close
            from bars_event) as _b
      cross join (select unnest(['lstm', 'tcn', 'gbt']) as model) as _m
      where next_close is not null) as _p"""

FIXTURE_SQL["feat_dirty"] = """
select symbol, ts,
       case when n % 53 = 0 then null when n % 71 = 0 then "close" * 1e6 else "close" end as f_close,
       case when n % 53 = 0 then null when n % 71 = 0 then volume * 1e6 else volume end as f_volume,
       case when n % 3 = 0 then "close" end as f_sparse, 1.0 as f_const, "close" * 1e12 as f_big,
       case when n % 61 = 0 then cast('inf' as double)
            else "close" / nullif(lag("close") over (partition by symbol order by ts), 0) end as f_ratio,
       "close"
from (select *, row_number() over (partition by symbol order by ts) as n from bars_brand) as _d"""

# dependencies between fixtures (a fixture text may mention another)
_DEPS = {"bars_dirty": ["bars_brand"], "feat_dirty": ["bars_brand"], "preds": ["bars_event"]}
_ORDER = ["bars_brand", "bars_event", "bars_user", "bars_dirty", "feat_dirty", "dim", "preds"]


def _mentions(sql: str, name: str) -> bool:
    return re.search(rf"\b{name}\b", sql) is not None


def with_fixtures(sql: str) -> str:
    """Prepend the fixture CTEs that ``sql`` uses; merge with its own WITH clause."""
    body = sql.strip()
    recursive = False
    own = ""
    m = re.match(r"(?is)^with\s+(recursive\s+)?", body)
    if m:
        recursive = bool(m.group(1))
        own = body[m.end():]
    need = set()
    for n in _ORDER:
        if _mentions(body, n):
            need.add(n)
    changed = True
    while changed:
        changed = False
        for n in list(need):
            for dep in _DEPS.get(n, []):
                if dep not in need:
                    need.add(dep)
                    changed = True
    ctes = [f"{n} as ({FIXTURE_SQL[n]}\n)" for n in _ORDER if n in need]
    head = "with recursive " if recursive else "with "
    if own:
        return head + ",\n".join(ctes + [own]) if ctes else head + own
    if not ctes:
        return body
    return head + ",\n".join(ctes) + "\n" + body
