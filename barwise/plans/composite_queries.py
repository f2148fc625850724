"""Registered queries for the feature-set composites."""

from __future__ import annotations

from barwise.plans import featuresets as I
from barwise.plans import sqlgen as G
from barwise.plans.registry import query
from barwise.plans.scan_queries import BASE, adx_ctes, atr_ctes, macd_ctes, rsi_ctes
from barwise.sources.bars import bars_brand, bars_event, bars_user

KEY = "symbol:s, ts:t"


def _fr(n):
    return f"(partition by symbol order by rn rows between {n - 1} preceding and current row)"


def _core_sql(extra_ctes=(), extra_sel: str = "", extra_joins: str = "", out_cols: str = "*") -> str:
    c2, j2, rsi = rsi_ctes(14)
    c1, j1, atr = atr_ctes(14)
    c4, j4, adx = adx_ctes(14)
    c3, j3, _line, sig = macd_ctes()
    e12 = G.ema("ema12", "b", '"close"', 12)
    cum = "(partition by symbol order by rn rows between unbounded preceding and current row)"
    obv = (f"ob as (select symbol, rn, sum(st) over {cum} as obv from (select symbol, rn, "
           f"coalesce(sign(\"close\" - lag(\"close\") over (partition by symbol order by rn)) * volume, 0) as st from b) as _s)")
    ok = f"count(high) over {_fr(26)} = 26 and count(low) over {_fr(26)} = 26"
    ar = (f"ar as (select symbol, rn, case when {ok} then 100.0 * (25 - (rn - arg_max(rn, row(high, rn)) over {_fr(26)})) / 25 end "
          "as aroon_up from b)")
    sm = f"sm as (select symbol, rn, case when count(\"close\") over {_fr(20)} = 20 then avg(\"close\") over {_fr(20)} end as sma_20 from b)"
    sel = (f"select b.symbol, b.ts, sm.sma_20, ema12.ema12 as ema_12, {rsi} as rsi_14, {atr} as atr_14, ob.obv, {adx} as adx, "
           f"{sig} as macd_signal, ar.aroon_up{extra_sel} from b {j2} {j1} {j4} {j3} left join ema12 using (symbol, rn) "
           f"left join ob using (symbol, rn) left join ar using (symbol, rn) left join sm using (symbol, rn){extra_joins}")
    cols = ["sma_20", "ema_12", "rsi_14", "atr_14", "obv", "adx", "macd_signal", "aroon_up"]
    return (f"with recursive {BASE},\n" + ",\n".join(c2 + c1 + c4 + c3 + [e12, obv, ar, sm, *extra_ctes]) +
            f"\nselect {out_cols} from ({sel}) as _c where " + " and ".join(f"{c} is not null" for c in cols))


@query("i01_core_set", KEY + ", sma_20:d, ema_12:d, rsi_14:d, atr_14:d, obv:d2, adx:d, macd_signal:d4, aroon_up:d",
       _core_sql())
def _i01(spark, d):
    return I.core_set(bars_brand(spark, d))


def _full_sql() -> str:
    c = '"close"'
    lagp = "over (partition by symbol order by rn)"

    def full(agg, x, n):
        return f"(case when count({x}) over {_fr(n)} = {n} then {agg}({x}) over {_fr(n)} end)"
    eps = G.lit(1e-6)
    ml = f"coalesce(case when abs({full('avg', c, 50)}) > {eps} then {full('avg', c, 50)} end, {eps})"
    extra = [f"r2 as (select symbol, rn, pow({c} / nullif(lag({c}) {lagp}, 0) - 1, 2) as rsq from b)",
             G.ema("gv", "r2", "rsq", None, adjust=True, alpha=0.1),
             f"mst as (select symbol, rn, case when {full('avg', c, 10)} > {ml} * 1.02 then 1 "
             f"when {full('avg', c, 10)} < {ml} * 0.98 then -1 else 0 end as market_state, "
             f"abs(case when count({c}) over {_fr(20)} = 20 then regr_slope({c}, cast(rn as double)) over {_fr(20)} end) "
             "as trend_strength_20 from b)"]
    return _core_sql(extra, ", sm.sma_20 as close_mean_20, mst.market_state, gv.gv as garch_vol, mst.trend_strength_20",
                     " left join gv using (symbol, rn) left join mst using (symbol, rn)",
                     "symbol, ts, sma_20, rsi_14, close_mean_20, market_state, garch_vol, trend_strength_20")


@query("i01_core_set_skew_safe", KEY + ", sma_20:d, ema_12:d, rsi_14:d, atr_14:d, obv:d2, adx:d, macd_signal:d4, aroon_up:d",
       _core_sql())
def _i01s(spark, d):
    # global ranks, (symbol, block) windows, carry joins
    return I.core_set(bars_brand(spark, d), skew_safe=True)


@query("i02_full_set", KEY + ", sma_20:d, rsi_14:d, close_mean_20:d, market_state:i, garch_vol:d, trend_strength_20:d",
       _full_sql())
def _i02(spark, d):
    return I.full_set(bars_brand(spark, d))


def _extended_sql() -> str:
    c = '"close"'
    lagp = "over (partition by symbol order by rn)"

    def full(agg, x, n):
        return f"(case when count({x}) over {_fr(n)} = {n} then {agg}({x}) over {_fr(n)} end)"
    c2, j2, rsi = rsi_ctes(14)
    c1, j1, atr = atr_ctes(14)
    c3, j3, line, _sig = macd_ctes()
    ea = [G.ema("ea50", "b", c, 50, adjust=True), G.ema("ea12", "b", c, 12, adjust=True), G.ema("ea26", "b", c, 26, adjust=True)]
    dd = f"({c} - lag({c}) {lagp})"
    x = (f"x as (select symbol, rn, case when {dd} > 0 then {dd} else 0 end as gp, case when {dd} < 0 then -{dd} else 0 end as gn, "
         f"100 * ({c} - {full('min', 'low', 14)}) / nullif({full('max', 'high', 14)} - {full('min', 'low', 14)}, 0) as fk, "
         f"{full('avg', c, 20)} as m20, {full('stddev_samp', c, 20)} as sd20, {c} as cl from b)")
    y = (f"y as (select symbol, rn, case when {full('avg', 'gn', 14)} > 0 then 100 - 100 / (1 + {full('avg', 'gp', 14)} / "
         f"{full('avg', 'gn', 14)}) when {full('avg', 'gp', 14)} > 0 then 100 end as rsi_sma_14, "
         f"{full('avg', 'fk', 3)} as stoch_slowk_14_3, "
         "(cl - (m20 - 2 * sd20)) / nullif((m20 + 2 * sd20) - (m20 - 2 * sd20), 0) as bb_position_20_2 from x)")
    sel = (f"select b.symbol, b.ts, ea50.ea50 as ema_50, y.rsi_sma_14, ea12.ea12 - ea26.ea26 as macd_12_26_9_adj, "
           f"y.bb_position_20_2, y.stoch_slowk_14_3, {atr} / nullif(b.{c}, 0) as atr_14_ratio, "
           f"{G.flag(f'{rsi} > 50 and {line} > 0')} as rsi_macd_signal from b {j2} {j1} {j3} left join y using (symbol, rn) "
           "left join ea50 using (symbol, rn) left join ea12 using (symbol, rn) left join ea26 using (symbol, rn)")
    return f"with recursive {BASE},\n" + ",\n".join(c2 + c1 + c3 + ea + [x, y]) + "\n" + sel


@query("i03_extended_set", KEY + ", ema_50:d, rsi_sma_14:d, macd_12_26_9_adj:d4, bb_position_20_2:d, stoch_slowk_14_3:d, "
       "atr_14_ratio:d, rsi_macd_signal:i", _extended_sql())
def _i03(spark, d):
    return I.extended_set(bars_brand(spark, d))


def _simple_sql() -> str:
    c = '"close"'
    lagp = "over (partition by symbol order by rn)"
    ret1 = f'({c} / nullif(lag({c}) {lagp}, 0) - 1)'
    e20 = G.ema("e20", "b", c, 20, adjust=True)
    e12 = G.ema("e12", "b", c, 12, adjust=True)
    e26 = G.ema("e26", "b", c, 26, adjust=True)

    def full(agg, x, n):
        return f"(case when count({x}) over {_fr(n)} = {n} then {agg}({x}) over {_fr(n)} end)"
    d = f'({c} - lag({c}) {lagp})'
    g = f"case when {d} > 0 then {d} else 0 end"
    lo = f"case when {d} < 0 then -{d} else 0 end"
    x = (f"x as (select symbol, rn, ts, {c} as \"close\", high, low, volume, {ret1} as r1, {g} as gp, {lo} as gn, "
         f"{c} / nullif(lag({c}, 5) {lagp}, 0) - 1 as return_5 from b)")
    y = (f"y as (select x.*, {full('avg', c, 20)} as s20, {full('stddev_samp', c, 20)} as sd20, "
         f"{full('stddev_samp', 'r1', 10)} as volatility_10, {full('avg', 'gp', 14)} as g14, {full('avg', 'gn', 14)} as l14, "
         f"({c} - {full('min', 'low', 10)}) / nullif({full('max', 'high', 10)} - {full('min', 'low', 10)}, 0) as price_position_10, "
         f"volume / nullif({full('avg', 'volume', 20)}, 0) as volume_ratio_20 from x)")
    z = (f"z as (select y.*, s20 - lag(s20, 5) {lagp} as sma_slope_20, "
         "case when l14 > 0 then 100 - 100 / (1 + g14 / l14) when g14 > 0 then 100 end as rsi_14, "
         f"({c} - (s20 - 2 * sd20)) / nullif((s20 + 2 * sd20) - (s20 - 2 * sd20), 0) as bb_position_20 from y)")
    ml = ("ml as (select b.symbol, b.rn, e12.e12 - e26.e26 as line from b left join e12 using (symbol, rn) "
          "left join e26 using (symbol, rn))")
    return (f"with recursive {BASE},\n" + ",\n".join([e20, e12, e26, x, y, z, ml]) +
            "\nselect z.symbol, z.ts, return_5, price_position_10, sma_slope_20, volatility_10, rsi_14, bb_position_20, "
            "volume_ratio_20, e20.e20 as ema_20, ml.line as macd from z left join e20 using (symbol, rn) "
            "left join ml using (symbol, rn)")


@query("i04_simple_set", KEY + ", return_5:d, price_position_10:d, sma_slope_20:d4, volatility_10:d, rsi_14:d, "
       "bb_position_20:d, volume_ratio_20:d, ema_20:d, macd:d4", _simple_sql())
def _i04(spark, d):
    return I.simple_set(bars_brand(spark, d))


def _basic_sql(src: str) -> str:
    c = '"close"'
    w = "(partition by symbol order by ts)"

    def full(agg, x, n):
        f = f"(partition by symbol order by ts rows between {n - 1} preceding and current row)"
        return f"(case when count({x}) over {f} = {n} then {agg}({x}) over {f} end)"
    raw = {"returns": ("r", 1), "price_change": (f'{c} - "open"', 1), "price_range": ("high - low", 1),
           "volume_sma_3": (full("avg", "volume", 3), 3), "volume_sma_10": (full("avg", "volume", 10), 10),
           "sma_3": (full("avg", c, 3), 3), "sma_5": (full("avg", c, 5), 5), "sma_10": (full("avg", c, 10), 10),
           "volume_sma_5": (full("avg", "volume", 5), 5), "volatility_5": (full("stddev_samp", "r", 5), 5),
           "momentum_3": (f"{c} / nullif(lag({c}, 3) over {w}, 0) - 1", 3)}
    a = ", ".join(f"case when n >= {k} then {e} end as {name}" for name, (e, k) in raw.items())
    cum = "(partition by symbol order by ts rows between unbounded preceding and current row)"
    fwd = "(partition by symbol order by ts rows between current row and unbounded following)"
    b = ", ".join(f"last_value({name} ignore nulls) over {cum} as {name}" for name in raw)
    cc = ", ".join(f"coalesce(first_value({name} ignore nulls) over {fwd}, 0) as {name}" for name in raw)
    return (f"select symbol, ts, {', '.join(raw)} from (select symbol, ts, {cc} from (select symbol, ts, {b} from "
            f"(select symbol, ts, {a} from (select *, count(*) over (partition by symbol) as n, "
            f"{c} / nullif(lag({c}) over {w}, 0) - 1 as r from {src}) as _0) as _1) as _2) as _3")


_BASIC = KEY + ", returns:d, price_change:d, price_range:d, volume_sma_3:d, volume_sma_10:d, sma_3:d, sma_5:d, sma_10:d, volume_sma_5:d, volatility_5:d, momentum_3:d"


@query("i05_basic_set", _BASIC, _basic_sql("bars_user"))
def _i05(spark, d):
    return I.basic_set(bars_user(spark, d)).select("symbol", "ts", *I.BASIC)


SELECTED = ["sma_5", "momentum_3", "ma_cross_7", "rsi_custom_9", "volume_trend_x", "volatility_custom", "other_feature"]


@query("i06_serving_transform", KEY + "".join(f", {s}:d" for s in SELECTED),
       "select symbol, ts, sma_5, momentum_3, \"close\" as ma_cross_7, 50.0 as rsi_custom_9, medv as volume_trend_x, "
       "0.01 as volatility_custom, 0.0 as other_feature from (" + _basic_sql("bars_event") + ") as f join "
       "(select symbol, ts, \"close\", median(volume) over (partition by symbol) as medv from bars_event) as e using (symbol, ts)")
def _i06(spark, d):
    bars = bars_event(spark, d)
    feats = I.basic_set(bars).select("symbol", "ts", "close", "sma_5", "momentum_3")
    return I.serving_transform(bars, SELECTED, feats)
