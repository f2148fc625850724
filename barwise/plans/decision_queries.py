"""Registered queries for latest state, overview and decision rules (P)."""

from __future__ import annotations


from pyspark.sql import functions as F

from barwise.operators import decide as P
from barwise.operators import evaluation as M
from barwise.plans.registry import query
from barwise.sources.bars import bars_brand, bars_event, bars_user

BARS = "symbol:s, ts:t, open:d, high:d, low:d, close:d, volume:d"


@query("p01_latest_quote", "symbol:s, ts:t, close:d, volume:d, high:d, low:d, prev_close:d, change:d, change_pct:d",
       "with r as (select *, row_number() over (partition by symbol order by ts desc) as k from bars_user) "
       "select a.symbol, a.ts, a.\"close\", a.volume, a.high, a.low, b.\"close\" as prev_close, a.\"close\" - b.\"close\" as change, "
       "(a.\"close\" - b.\"close\") / nullif(b.\"close\", 0) * 100 as change_pct "
       "from r a left join r b on a.symbol = b.symbol and b.k = 2 where a.k = 1")
def _p01(spark, d):
    return P.latest_quote(bars_user(spark, d))


@query("p02_describe", "symbol:s, feature:s, count:l, mean:d, std:d, min:d, max:d, q25:d, q50:d, q75:d",
       " union all ".join(
           f"select symbol, '{c}' as feature, count({c}) as count, avg({c}) as mean, stddev_samp({c}) as std, "
           f"min({c}) as min, max({c}) as max, quantile_cont({c}, 0.25) as q25, quantile_cont({c}, 0.5) as q50, "
           f"quantile_cont({c}, 0.75) as q75 from bars_event group by symbol" for c in ('"close"', "volume"))
       .replace("'\"close\"'", "'close'"))
def _p02(spark, d):
    return P.describe(bars_event(spark, d))


@query("p03_tail", BARS + ", pos_from_end:l",
       "select * from (select *, row_number() over (partition by symbol order by ts desc) as pos_from_end from bars_user) "
       "as _t where pos_from_end <= 5")
def _p03(spark, d):
    return P.tail(bars_user(spark, d), 5)


@query("p03_extent", "symbol:s, first_ts:t, last_ts:t, min_low:d, max_high:d, n_bars:l",
       "select symbol, min(ts) as first_ts, max(ts) as last_ts, min(low) as min_low, max(high) as max_high, "
       "count(*) as n_bars from bars_user group by symbol")
def _p03b(spark, d):
    return P.extent(bars_user(spark, d))


def _preds(spark, d):
    return M.predictions(bars_event(spark, d))


@query("p04_direction", "symbol:s, ts:t, model:s, direction:s, confidence:d",
       "select symbol, ts, model, case when y_score >= 0.5 then 'UP' else 'DOWN' end as direction, "
       "greatest(y_score, 1 - y_score) * 100 as confidence from preds")
def _p04(spark, d):
    return P.direction(_preds(spark, d)).select("symbol", "ts", "model", "direction", "confidence")


_CD = ("with a as (select symbol, ts, count(*) as n_models, sum(cast(y_score >= 0.5 as integer)) as n_up, "
       "round(avg(y_score), 9) as ensemble, round(stddev_pop(y_score), 9) as spread, first(price_now) as price_now "
       "from preds group by symbol, ts), "
       "b as (select *, cast(n_up > 0 and n_up < n_models as integer) as disagree, "
       "round(greatest(n_up, n_models - n_up) / n_models, 9) as agreement, "
       "round(abs(ensemble - 0.5) / 0.5, 9) as signal_strength, "
       "case when ensemble >= 0.5 then 'UP' else 'DOWN' end as direction, "
       "round(greatest(ensemble, 1 - ensemble) * 100, 9) as confidence from a), "
       "c as (select *, case when agreement >= 0.80 and signal_strength >= 0.30 and spread <= 0.08 then 'low' "
       "when agreement >= 0.60 and signal_strength >= 0.15 and spread <= 0.15 then 'medium' else 'high' end as risk from b), "
       "e as (select *, case when n_models > 1 then "
       "(case when risk = 'low' then (case when direction = 'UP' then 'STRONG BUY' else 'STRONG SELL' end) "
       "when risk = 'medium' then (case when direction = 'UP' then 'MODERATE BUY' else 'MODERATE SELL' end) else 'HOLD' end) "
       "else (case when confidence > 80 then (case when direction = 'UP' then 'STRONG BUY' else 'STRONG SELL' end) "
       "when confidence > 60 then (case when direction = 'UP' then 'MODERATE BUY' else 'MODERATE SELL' end) else 'HOLD' end) "
       "end as recommendation from c), "
       "f as (select *, case when confidence > 80 then 'large' when confidence > 60 then 'medium' else 'small' end as position_size, "
       "case when contains(recommendation, 'BUY') then price_now * 0.95 when contains(recommendation, 'SELL') then price_now * 1.05 end "
       "as stop_loss from e) ")


def _cd(spark, d):
    return P.class_decision(_preds(spark, d))


@query("p05_agreement_gate", "symbol:s, ts:t, n_models:l, n_up:l, disagree:i",
       _CD + "select symbol, ts, n_models, n_up, disagree from f")
def _p05(spark, d):
    return _cd(spark, d)


@query("p06_agreement_stats", "symbol:s, ts:t, ensemble:d, agreement:d, spread:d, signal_strength:d",
       _CD + "select symbol, ts, ensemble, agreement, spread, signal_strength from f")
def _p06(spark, d):
    return _cd(spark, d)


@query("p07_risk_level", "symbol:s, ts:t, risk:s", _CD + "select symbol, ts, risk from f")
def _p07(spark, d):
    return _cd(spark, d)


@query("p09_recommendation", "symbol:s, ts:t, direction:s, confidence:d, recommendation:s",
       _CD + "select symbol, ts, direction, confidence, recommendation from f")
def _p09(spark, d):
    return _cd(spark, d)


@query("p09_recommendation_gated", "symbol:s, ts:t, direction:s, confidence:d, recommendation:s, stop_loss:d",
       _CD.replace("case when n_models > 1 then", "case when disagree = 1 then 'HOLD' when n_models > 1 then")
       + "select symbol, ts, direction, confidence, recommendation, stop_loss from f")
def _p09_gated(spark, d):
    return P.class_decision(_preds(spark, d), require_agreement=True)


@query("p09_recommendation_single", "symbol:s, ts:t, n_models:l, direction:s, confidence:d, recommendation:s, stop_loss:d",
       _CD.replace("from preds group by", "from preds where model = (select min(model) from preds) group by")
       + "select symbol, ts, n_models, direction, confidence, recommendation, stop_loss from f")
def _p09_single(spark, d):
    p = _preds(spark, d)
    first = p.agg(F.min("model")).first()[0]
    return P.class_decision(p.filter(F.col("model") == first))


@query("p10_position", "symbol:s, ts:t, position_size:s, stop_loss:d",
       _CD + "select symbol, ts, position_size, stop_loss from f")
def _p10(spark, d):
    return _cd(spark, d)


@query("p08_regression_decision", "symbol:s, ts:t, ensemble:d, spread_pct:d, agreement:d, expected_return:d, risk:s, "
       "recommendation:s, position_size:s, stop_loss:d",
       "with a as (select symbol, ts, avg(price_pred) as ensemble, stddev_pop(price_pred) as sd, first(price_now) as price_now, "
       "count(*) as n_models, list(price_pred) as preds_ from preds group by symbol, ts), "
       "b as (select *, round(sd / price_now * 100, 9) as spread_pct, "
       "round(len(list_filter(preds_, lambda x: (x > price_now) = (ensemble > price_now))) / n_models, 9) as agreement, "
       "round((ensemble - price_now) / price_now * 100, 9) as expected_return from a), "
       "c as (select *, case when agreement > 0.8 and spread_pct < 2 then 'low' when agreement > 0.6 and spread_pct < 5 then 'medium' "
       "else 'high' end as risk, case when expected_return > 5 then 'STRONG BUY' when expected_return > 2 then 'MODERATE BUY' "
       "when expected_return > -2 then 'HOLD' when expected_return > -5 then 'MODERATE SELL' else 'STRONG SELL' end as recommendation, "
       "case when abs(expected_return) > 5 then 'large' when abs(expected_return) > 2 then 'medium' else 'small' end as position_size "
       "from b) select symbol, ts, ensemble, spread_pct, agreement, expected_return, risk, recommendation, position_size, "
       "case when contains(recommendation, 'BUY') then price_now * 0.95 when contains(recommendation, 'SELL') then price_now * 1.05 end "
       "as stop_loss from c")
def _p08(spark, d):
    return P.regression_decision(_preds(spark, d))


@query("p11_context", "symbol:s, ts:t, close:d, ma_5:d, ma_20:d, trend:s, rsi:d, rsi_band:s, volatility:d, volatility_band:s",
       "with b as (select *, \"close\" / nullif(lag(\"close\") over (partition by symbol order by ts), 0) - 1 as r0, "
       "row_number() over (partition by symbol order by ts desc) as k from bars_brand), "
       "c as (select *, case when k <= 19 then r0 end as r from b), "
       "d as (select *, case when r > 0 then r when r is not null then 0 end as g, "
       "case when r < 0 then -r when r is not null then 0 end as lo from c), "
       "e as (select symbol, ts, \"close\", k, case when count(\"close\") over f5 = 5 then avg(\"close\") over f5 end as ma_5, "
       "case when count(\"close\") over f20 = 20 then avg(\"close\") over f20 end as ma_20, count(r) over f20 as cnt, "
       "avg(g) over f14 as ag14, avg(lo) over f14 as al14, avg(g) over f20 as ag20, avg(lo) over f20 as al20, "
       "stddev_samp(r) over f20 * sqrt(252) * 100 as volatility from d "
       "window f5 as (partition by symbol order by ts rows between 4 preceding and current row), "
       "f14 as (partition by symbol order by ts rows between 13 preceding and current row), "
       "f20 as (partition by symbol order by ts rows between 19 preceding and current row)), "
       "g as (select *, 100 - 100 / (1 + (case when cnt >= 14 then ag14 else ag20 end) / "
       "((case when cnt >= 14 then al14 else al20 end) + 1e-8)) as rsi from e where k = 1) "
       "select symbol, ts, \"close\", ma_5, ma_20, case when ma_5 > ma_20 then 'up' when ma_5 < ma_20 then 'down' else 'sideways' end as trend, "
       "rsi, case when rsi > 70 then 'overbought' when rsi < 30 then 'oversold' else 'neutral' end as rsi_band, volatility, "
       "case when volatility > 30 then 'high' when volatility > 20 then 'medium' else 'low' end as volatility_band from g")
def _p11(spark, d):
    return P.context(bars_brand(spark, d))



