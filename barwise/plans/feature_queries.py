"""Registered queries for bar arithmetic (C), calendar (D), rolling (E), indicators (G)
and regime features (H); oracle texts are written with :mod:`barwise.plans.sqlgen`."""

from __future__ import annotations

from barwise.functions import calendar as D
from barwise.functions import candles as C
from barwise.operators import indicators as GI
from barwise.operators import regime as H
from barwise.operators import rolling as E
from barwise.operators.scan import wilder_memory
from barwise.operators.segments import segmented
from barwise.plans import sqlgen as G
from barwise.plans.registry import query
from barwise.sources.bars import bars_brand, bars_event

O, HI, LO, CL, V = '"open"', "high", "low", '"close"', "volume"
KEY = "symbol:s, ts:t"


def _spec(cols: dict[str, str] | list[str], kind: dict[str, str] | None = None) -> str:
    kind = kind or {}
    return KEY + "".join(f", {n}:{kind.get(n, 'd')}" for n in cols)


def _sel(exprs: dict[str, str], src: str = "bars_brand") -> str:
    return "select symbol, ts, " + ", ".join(f"{e} as {G.q(n)}" for n, e in exprs.items()) + f" from {src}"


def _reg(name: str, exprs: dict[str, str], build, src: str = "bars_brand", ints=(), extra_spec="",
         kinds: dict[str, str] | None = None):
    """Register a query whose oracle is one projection of ``exprs`` over ``src``.

    Cumulative sums and differences of price-level values are compared at 1e-4
    (``kinds``): their summation order differs between engines by ~1e-11.
    """
    kinds = {**{n: "i" for n in ints}, **(kinds or {})}
    spec = _spec(list(exprs), kinds) + extra_spec
    query(name, spec, _sel(exprs, src))(build)


#: Bars that the longest frame here looks back (a mean of 200, then differences and lags on it).
FRAMES = 260


def _cols(fn_cols):
    """Builder for a Column-dict operator that sees one bar at a time."""
    def build(spark, d):
        return bars_brand(spark, d).withColumns(fn_cols())
    return build


def _df(fn, back: int = FRAMES):
    """Builder for an operator on frames, in (symbol, block) windows."""
    def build(spark, d):
        return segmented(bars_brand(spark, d), fn, lookback=back, ahead=1)
    return build


def _line(name: str, then=None):
    """Builder for a cumulative line: its steps by block, summed by bucket, and frames on it by block."""
    def build(spark, d):
        df = GI.volume_lines_segmented(bars_brand(spark, d), (name,))
        return segmented(df, then, lookback=FRAMES) if then else df
    return build


def _lagged(fn_cols):
    return _df(lambda b: b.withColumns(fn_cols()))


# ------------------------------------------------------------------------ C
PC = G.lag(CL)
BODY = f"abs({CL} - {O})"
UPPER = f"(high - greatest({O}, {CL}))"
LOWER = f"(least({O}, {CL}) - low)"

_reg("c01_returns", {("returns" if k == 1 else f"return_{k}"): f"{G.div(CL, G.lag(CL, k))} - 1"
                     for k in (1, 2, 3, 5, 10, 20)}, _lagged(C.returns))
_reg("c02_log_returns", {"log_returns": f"ln({G.div(CL, PC)})"}, _lagged(C.log_returns))
_reg("c03_price_change", {"price_change": f"{CL} - {O}", "price_range": "high - low"}, _cols(C.price_change))
_reg("c04_shadows", {"upper_shadow": UPPER, "lower_shadow": LOWER, "body_size": BODY, "total_range": "high - low"},
     _cols(C.shadows))
_reg("c05_shadow_ratios", {"body_ratio": G.div(BODY, "high - low"), "upper_shadow_ratio": G.div(UPPER, "high - low"),
                           "lower_shadow_ratio": G.div(LOWER, "high - low")}, _cols(C.shadow_ratios))
_reg("c06_close_position", {"price_position_day": f"coalesce({G.div(f'{CL} - low', 'high - low')}, 0.5)"},
     _cols(C.close_position))
_reg("c07_volume_change", {"volume_change": f"{G.div(V, G.lag(V))} - 1", "traded_value": f"{CL} * {V}"},
     _lagged(C.volume_change))
_reg("c08_gaps", {"gap": f"{O} - {PC}", "gap_pct": G.div(f"{O} - {PC}", PC)}, _lagged(C.gaps))
_reg("c09_gap_flags", {"gap_up": G.flag(f"{O} > {PC}"), "gap_down": G.flag(f"{O} < {PC}")}, _lagged(C.gap_flags),
     ints=("gap_up", "gap_down"))
_reg("c10_gap_flags_2pct", {"gap_up_2pct": G.flag(f"{O} > {PC} and abs({O} - {PC}) > 0.02 * {PC}"),
                            "gap_down_2pct": G.flag(f"{O} < {PC} and abs({O} - {PC}) > 0.02 * {PC}")},
     _lagged(C.gap_flags_2pct), ints=("gap_up_2pct", "gap_down_2pct"))
_reg("c11_intraday_overnight", {"intraday_return": G.div(f"{CL} - {O}", O), "overnight_return": G.div(f"{O} - {PC}", PC)},
     _lagged(C.intraday_overnight))
_reg("c12_doji", {"doji": G.flag(f"{G.div(BODY, 'high - low')} < 0.1")}, _cols(C.doji), ints=("doji",))
_reg("c13_hammer", {"hammer": G.flag(f"{LOWER} > 2 * {BODY} and {UPPER} < {BODY}"),
                    "hammer_v2": G.flag(f"{CL} > {O} and ({O} - low) > 2 * ({CL} - {O})")},
     _cols(lambda: {**C.hammer(1), **C.hammer(2)}), ints=("hammer", "hammer_v2"))
_reg("c14_shooting_star", {"shooting_star": G.flag(f"{UPPER} > 2 * {BODY} and {LOWER} < {BODY}")},
     _cols(C.shooting_star), ints=("shooting_star",))
_reg("c15_true_range", {"true_range": G.tr()}, _lagged(C.true_range))
_reg("c16_trend_flags", {f"trend_{k}": G.flag(f"{CL} > {G.lag(CL, k)}") for k in (5, 10, 20)},
     _lagged(C.trend_flags), ints=("trend_5", "trend_10", "trend_20"))
_LMAX = f"high > {G.lag('high')} and high > {G.lead('high')}"
_LMIN = f"low < {G.lag('low')} and low < {G.lead('low')}"
_reg("c17_fractals", {"local_max": G.flag(_LMAX), "local_min": G.flag(_LMIN),
                      "fractal_score": f"{G.flag(_LMAX)} - {G.flag(_LMIN)}"}, _lagged(C.fractals),
     ints=("local_max", "local_min", "fractal_score"))


# ------------------------------------------------------------------------ D
def _ev(fn_cols):
    def build(spark, d):
        return bars_event(spark, d).withColumns(fn_cols())
    return build


_DOW = "(isodow(ts) - 1)"
_reg("d01_calendar_parts", {"year": "year(ts)", "month": "month(ts)", "day": "day(ts)", "day_of_week": _DOW,
                            "day_of_year": "dayofyear(ts)", "week_of_year": "week(ts)", "quarter": "quarter(ts)"},
     _ev(D.parts), src="bars_event",
     ints=("year", "month", "day", "day_of_week", "day_of_year", "week_of_year", "quarter"))
_reg("d02_cyclical", {"month_sin": "sin(2 * pi() * month(ts) / 12)", "month_cos": "cos(2 * pi() * month(ts) / 12)",
                      "dow_sin": f"sin(2 * pi() * {_DOW} / 7)", "dow_cos": f"cos(2 * pi() * {_DOW} / 7)",
                      "doy_sin": "sin(2 * pi() * dayofyear(ts) / 365)", "doy_cos": "cos(2 * pi() * dayofyear(ts) / 365)"},
     _ev(D.cyclical), src="bars_event")
_reg("d03_weekday_flags", {"is_monday": f"cast({_DOW} = 0 as integer)", "is_friday": f"cast({_DOW} = 4 as integer)"},
     _cols(D.weekday_flags), ints=("is_monday", "is_friday"))
_ME = "(cast(ts as date) = last_day(cast(ts as date)))"
_reg("d04_month_flags", {"is_month_start": "cast(day(ts) = 1 as integer)", "is_month_end": f"cast({_ME} as integer)",
                         "is_quarter_end": f"cast(month(ts) in (3, 6, 9, 12) and {_ME} as integer)"},
     _cols(D.month_flags), ints=("is_month_start", "is_month_end", "is_quarter_end"))


@query("d05_parse_ts", KEY + ", ts_parsed:t", "select symbol, ts, ts as ts_parsed from bars_event")
def _d05(spark, d):
    from pyspark.sql import functions as F
    b = bars_event(spark, d).withColumn("_txt", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return b.withColumn("ts_parsed", D.parse_ts("_txt", "yyyy-MM-dd HH:mm:ss"))


# ------------------------------------------------------------------------ E
RET = f"({G.div(CL, PC)} - 1)"
_E01 = (3, 5, 10, 20, 50, 100, 200)
_reg("e01_sma", {f"sma_{w}": G.sma(CL, w) for w in _E01}, _lagged(lambda: E.sma_cols(_E01)))

_e02 = {f"volume_sma_{w}": G.sma(V, w) for w in (5, 10, 20, 50)}
_e02.update({f"volume_ratio_{w}": G.div(V, G.sma(V, w)) for w in (5, 10, 20, 50)})
_reg("e02_volume_sma", _e02, _df(E.volume_sma))

_e03 = {f"close_sma_{w}_ratio": G.div(CL, G.sma(CL, w)) for w in (5, 10, 20, 50)}
_e03["sma_5_20_ratio"] = G.div(G.sma(CL, 5), G.sma(CL, 20))
_reg("e03_price_sma_ratios", _e03, _df(E.price_sma_ratios))

# differences of price-level means: compared at 1e-4
query("e04_sma_slope", _spec([f"sma_slope_{w}" for w in (5, 10, 20, 50)], {f"sma_slope_{w}": "d4" for w in (5, 10, 20, 50)}),
      "select symbol, ts, " + ", ".join(f"s{w} - {G.lag(f's{w}', 5)} as sma_slope_{w}" for w in (5, 10, 20, 50))
      + " from (select symbol, ts, " + ", ".join(f"{G.sma(CL, w)} as s{w}" for w in (5, 10, 20, 50))
      + " from bars_brand) as _s")(_df(E.sma_slope))


def _pack_sql(feats=E.ROLL_FEATURES, ws=(5, 10, 20)) -> tuple[str, list[str]]:
    base = f"select symbol, ts, {O} as \"open\", high, low, {CL} as \"close\", volume, {RET} as returns from bars_brand"
    inner, outer, names = [], [], []
    for f in feats:
        for w in ws:
            inner += [f"{G.sma(G.q(f), w)} as {f}_mean_{w}", f"{G.full('stddev_samp', G.q(f), w)} as {f}_std_{w}",
                      f"{G.full('min', G.q(f), w)} as {f}_min_{w}", f"{G.full('max', G.q(f), w)} as {f}_max_{w}",
                      f"{G.full('median', G.q(f), w)} as {f}_median_{w}"]
            names += [f"{f}_mean_{w}", f"{f}_std_{w}", f"{f}_min_{w}", f"{f}_max_{w}", f"{f}_median_{w}"]
    for f in feats:
        for w in ws:
            outer += [f"{G.div(G.q(f), f'{f}_mean_{w}')} as {f}_ratio_mean_{w}",
                      f"{G.div(f'{G.q(f)} - {f}_mean_{w}', f'{f}_std_{w}')} as {f}_zscore_{w}"]
            names += [f"{f}_ratio_mean_{w}", f"{f}_zscore_{w}"]
    sql = (f"select symbol, ts, {', '.join(n for n in names if 'ratio_mean' not in n and 'zscore' not in n)}, "
           f"{', '.join(outer)} from (select *, {', '.join(inner)} from ({base}) as _b) as _p")
    return sql, names


_PACK_SQL, _PACK_NAMES = _pack_sql()
query("e05_rolling_pack", _spec(_PACK_NAMES), _PACK_SQL)(_df(E.rolling_pack))

# the same pack with the skew-safe runner: windows by (symbol, block of 512 bars) + halo
query("e05_rolling_pack_segmented", _spec(_PACK_NAMES), _PACK_SQL)(
    lambda spark, d: segmented(bars_brand(spark, d), E.rolling_pack, lookback=20, block=512))

query("e06_rolling_ratios", _spec([n for n in _PACK_NAMES if "ratio_mean" in n or "zscore" in n]),
      _PACK_SQL)(_df(lambda b: E.rolling_pack(b).select(
          "symbol", "ts", *[n for n in _PACK_NAMES if "ratio_mean" in n or "zscore" in n])))

for _x, _key, _expr in (("close", "e07_rolling_skew", CL), ("returns", "e07_rolling_skew_returns", RET)):
    _SKW = {f"{_x}_skew_{w}": (f"case when {G.full('stddev_pop', 'r', w)} > 0 then "
                               f"{G.full('skewness', 'r', w)} end") for w in (5, 10, 20)}
    query(_key, _spec(list(_SKW), {k: "d4" for k in _SKW}),
          _sel(_SKW, f"(select symbol, ts, {_expr} as r from bars_brand) as _r"))(
        _df(lambda b, x=_x: E.rolling_skew(b, x=x)))

_reg("e08_volatility", {f"volatility_{w}": G.full("stddev_samp", "r", w) for w in (5, 10, 20)},
     _df(E.volatility), src=f"(select symbol, ts, {RET} as r from bars_brand) as _r")

_E09 = {f"{f}_lag_{k}": G.lag(G.q(f), k) for f in ("close", "volume", "returns") for k in (1, 2, 3, 5, 10)}
_reg("e09_lags", _E09, _df(E.lags),
     src=f"(select symbol, ts, {CL} as \"close\", volume, {RET} as returns from bars_brand) as _r")

_MOM = (1, 3, 5, 10, 20)
query("e10_momentum", _spec([f"momentum_{k}" for k in _MOM] + [f"momentum_{k}_sma_5" for k in _MOM]),
      "select symbol, ts, " + ", ".join(f"m{k} as momentum_{k}" for k in _MOM) + ", "
      + ", ".join(f"{G.sma(f'm{k}', 5)} as momentum_{k}_sma_5" for k in _MOM)
      + " from (select symbol, ts, " + ", ".join(f"{G.div(CL, G.lag(CL, k))} - 1 as m{k}" for k in _MOM)
      + " from bars_brand) as _m")(_df(E.momentum))

_R20, _S20 = G.full("max", "high", 20), G.full("min", "low", 20)
_reg("e11_support_resistance", {"resistance_20": _R20, "support_20": _S20,
                                "resistance_distance_20": G.div(f"{_R20} - {CL}", CL),
                                "support_distance_20": G.div(f"{CL} - {_S20}", CL)}, _df(E.support_resistance))


def _rp(w, floor=None):
    rng = f"({G.full('max', 'high', w)} - {G.full('min', 'low', w)})"
    if floor is not None:
        rng = f"greatest({rng}, {G.lit(floor)})"
    return G.div(f"{CL} - {G.full('min', 'low', w)}", rng)


_reg("e12_range_position", {"price_position_10": _rp(10), "price_position_20": _rp(20)}, _df(E.range_position))
_reg("e12_range_position_guarded", {"price_position_10_guarded": _rp(10, 1e-6), "price_position_20_guarded": _rp(20, 1e-6)},
     _df(lambda b: E.range_position(b, floor=1e-6)))
_reg("e13_high_low_ratio", {f"high_low_ratio_{w}": G.div(G.full("max", "high", w), G.full("min", "low", w))
                            for w in (5, 10, 20)}, _df(E.high_low_ratio))
# the windows of the dependency-free set
_SIX = (1, 2, 3, 5, 10, 20)
_reg("e12_range_position_short", {f"price_position_{w}": _rp(w) for w in _SIX}, _df(lambda b: E.range_position(b, _SIX)))
_reg("e13_high_low_ratio_short", {f"high_low_ratio_{w}": G.div(G.full("max", "high", w), G.full("min", "low", w)) for w in _SIX},
     _df(lambda b: E.high_low_ratio(b, _SIX)))
_e14 = {f"avg_range_{w}": G.sma("rng", w) for w in (5, 10, 14, 20)}
_e14.update({f"avg_true_range_{w}": G.sma("tr", w) for w in (5, 10, 14, 20)})
_reg("e14_mean_ranges", _e14, _df(E.mean_ranges),
     src=f"(select symbol, ts, high - low as rng, {G.tr()} as tr from bars_brand) as _t")
_SLOPE = f"case when count({CL}) over {G.fr(20)} = 20 then regr_slope({CL}, i) over {G.fr(20)} end"
_reg("e15_trend_slope", {"trend_strength_20": f"abs({_SLOPE})"},
     _df(E.trend_slope), src=f"(select symbol, ts, {CL} as \"close\", cast(row_number() over (partition by symbol order by ts) as double) as i from bars_brand) as _i")


def _e16_sql() -> str:
    base = "b as (select *, row_number() over (partition by symbol order by ts) as rn from bars_brand)"
    lagp = "over (partition by symbol order by rn)"
    t = ("t as (select symbol, rn, ts, \"close\", " +
         G.gmax("high - low", f'abs(high - lag("close") {lagp})', f'abs(low - lag("close") {lagp})') +
         f" as tr, {G.sma(CL, 20).replace('order by ts', 'order by rn')} as s20 from b)")
    return (f"with recursive {base},\n{t},\n{G.wilder('atr_14', 't', 'tr', 14)}\n"
            f"select t.symbol, t.ts, atr_14.atr_14 as atr_14, {G.div('abs(t.' + CL + ' - t.s20)', 'atr_14.atr_14')} as trend_atr_20 "
            "from t left join atr_14 using (symbol, rn)")


query("e16_trend_vs_atr", _spec(["atr_14", "trend_atr_20"]), _e16_sql())(_df(E.trend_vs_atr, back=wilder_memory(14) + 21))

_PCT = f"coalesce({G.div(CL, PC)} - 1, 0)"
_VCT = f"coalesce({G.div(V, G.lag(V))} - 1, 0)"
_reg("e17_volume_price_trend", {"volume_price_trend_5": G.sma("pv", 5)}, _df(E.price_volume_trend_mean),
     src=f"(select symbol, ts, {_PCT} * {_VCT} as pv from bars_brand) as _p")
_reg("e18_ma_cross", {"ma_cross_signal": G.flag(f"{G.sma(CL, 5)} > {G.sma(CL, 20)}"),
                      "ma_distance": G.div(f"{G.sma(CL, 5)} - {G.sma(CL, 20)}", G.sma(CL, 20))},
     _df(E.ma_cross), ints=("ma_cross_signal",))

_OBV_STEP = f"coalesce(sign({CL} - {PC}) * volume, 0)"
_CUM = "(partition by symbol order by ts rows between unbounded preceding and current row)"
_reg("e19_obv_smoothed", {"obv": "obv", "obv_sma_10": G.sma("obv", 10)}, _line("obv", E.obv_smoothed),
     src=f"(select symbol, ts, sum(st) over {_CUM} as obv from (select symbol, ts, {_OBV_STEP} as st from bars_brand) as _s) as _o")


# ------------------------------------------------------------------------ G
def _kfast(k):
    mn, mx = G.full("min", "low", k), G.full("max", "high", k)
    return f"100 * {G.div(f'{CL} - {mn}', f'{mx} - {mn}')}"


query("g01_stochastic", _spec(["stoch_k_14", "stoch_d_14"]),
      f"select symbol, ts, k as stoch_k_14, {G.sma('k', 3)} as stoch_d_14 from (select symbol, ts, {_kfast(14)} as k from bars_brand) as _k"
      )(_df(GI.stochastic))

_SLOW = ((14, 3), (21, 5), (5, 3))
_slow_names = [n for k, d in _SLOW for n in (f"stoch_slowk_{k}_{d}", f"stoch_slowd_{k}_{d}", f"stoch_cross_{k}_{d}")]


def _slow_sql() -> str:
    l1 = ", ".join(f"{_kfast(k)} as f_{k}_{d}" for k, d in _SLOW)
    l2 = ", ".join(f"{G.sma(f'f_{k}_{d}', d)} as sk_{k}_{d}" for k, d in _SLOW)
    l3 = ", ".join(f"sk_{k}_{d} as stoch_slowk_{k}_{d}, {G.sma(f'sk_{k}_{d}', d)} as stoch_slowd_{k}_{d}" for k, d in _SLOW)
    l4 = ", ".join(f"stoch_slowk_{k}_{d}, stoch_slowd_{k}_{d}, {G.flag(f'stoch_slowk_{k}_{d} > stoch_slowd_{k}_{d}')} as stoch_cross_{k}_{d}"
                   for k, d in _SLOW)
    return (f"select symbol, ts, {l4} from (select symbol, ts, {l3} from (select symbol, ts, {l2} from "
            f"(select symbol, ts, {l1} from bars_brand) as _a) as _b) as _c")


query("g01_stochastic_slow", _spec(_slow_names, {n: "i" for n in _slow_names if "cross" in n}),
      _slow_sql())(_df(GI.stochastic_slow))

_reg("g02_williams_r", {f"williams_r_{w}": f"-100 * {G.div(G.full('max', 'high', w) + ' - ' + CL, G.full('max', 'high', w) + ' - ' + G.full('min', 'low', w))}"
                        for w in (14, 21)}, _df(GI.williams_r))
_reg("g03_roc", {f"roc_{n}": f"100 * ({G.div(CL, G.lag(CL, n))} - 1)" for n in (5, 10, 20)}, _df(GI.roc))

_TP = f"((high + low + {CL}) / 3)"
query("g04_cci", _spec(["cci_20"]),
      "select symbol, ts, " + G.div("tp - m", "0.015 * (list_sum(list_transform(l, lambda x: abs(x - m))) / 20)") + " as cci_20 from "
      f"(select symbol, ts, tp, {G.sma('tp', 20)} as m, list(tp) over {G.fr(20)} as l from "
      f"(select symbol, ts, {_TP} as tp from bars_brand) as _t) as _c")(_df(GI.cci))


def _bb_sql(w, k, ddof, suffix):
    fn = "stddev_pop" if ddof == 0 else "stddev_samp"
    m, sd = G.sma(CL, w), G.full(fn, CL, w)
    up, lo = f"({m} + {k} * {sd})", f"({m} - {k} * {sd})"
    out = {f"bb_middle{suffix}": m, f"bb_upper{suffix}": up, f"bb_lower{suffix}": lo,
           f"bb_position{suffix}": G.div(f"{CL} - {lo}", f"{up} - {lo}")}
    if suffix:
        out[f"bb_squeeze{suffix}"] = G.div(f"{up} - {lo}", m)
    else:
        out["bb_width"] = f"{up} - {lo}"
    return out


_reg("g05_bollinger", _bb_sql(20, 2.0, 0, ""), _df(GI.bollinger))
_bbs = {}
for _w, _k, _sfx in ((20, 2.0, "_20_2"), (20, 1.5, "_20_1_5"), (10, 2.0, "_10_2")):
    _bbs.update(_bb_sql(_w, _k, 1, _sfx))


def _bb_multi(b):
    for w, k, sfx in ((20, 2.0, "_20_2"), (20, 1.5, "_20_1_5"), (10, 2.0, "_10_2")):
        b = GI.bollinger(b, w, k, ddof=1, suffix=sfx)
    return b


_reg("g05_bollinger_sample", _bbs, _df(_bb_multi))
_reg("g06_keltner", {"kc_middle": G.sma("m", 20), "kc_upper": G.sma("u", 20), "kc_lower": G.sma("d", 20)}, _df(GI.keltner),
     src=f"(select symbol, ts, {_TP} as m, (4 * high - 2 * low + {CL}) / 3 as u, (-2 * high + 4 * low + {CL}) / 3 as d from bars_brand) as _k")
_reg("g07_donchian", {"dc_upper": G.full("max", "high", 20), "dc_lower": G.full("min", "low", 20),
                      "dc_middle": f"({G.full('max', 'high', 20)} + {G.full('min', 'low', 20)}) / 2"}, _df(GI.donchian))

_F26 = G.fr(26)
_AUP = f"arg_max(rn, row(high, rn)) over {_F26}"
_ADN = f"arg_max(rn, row(-low, rn)) over {_F26}"
_OK26 = f"count(high) over {_F26} = 26 and count(low) over {_F26} = 26"
query("g08_aroon", _spec(["aroon_up", "aroon_down", "aroon_oscillator"]),
      f"select symbol, ts, up as aroon_up, dn as aroon_down, up - dn as aroon_oscillator from ("
      f"select symbol, ts, case when {_OK26} then 100.0 * (25 - (rn - {_AUP})) / 25 end as up, "
      f"case when {_OK26} then 100.0 * (25 - (rn - {_ADN})) / 25 end as dn from "
      f"(select *, row_number() over (partition by symbol order by ts) as rn from bars_brand) as _r) as _a")(_df(GI.aroon))


def _mid(w):
    return f"(({G.full('max', 'high', w)} + {G.full('min', 'low', w)}) / 2)"


_reg("g09_ichimoku", {"ichimoku_conversion": _mid(9), "ichimoku_base": _mid(26), "ichimoku_b": _mid(52),
                      "ichimoku_a": f"(({_mid(9)} + {_mid(26)}) / 2)"}, _df(GI.ichimoku))
_reg("g10_vwap", {"vwap_14": G.div(G.full("sum", "tpv", 14), G.full("sum", "volume", 14))}, _df(GI.vwap),
     src=f"(select symbol, ts, volume, {_TP} * volume as tpv from bars_brand) as _v")
_reg("g11_obv", {"obv": f"sum(st) over {_CUM}"}, _line("obv"),
     src=f"(select symbol, ts, {_OBV_STEP} as st from bars_brand) as _s")
_reg("g12_vpt", {"vpt": f"sum(st) over {_CUM}"}, _line("vpt"), kinds={"vpt": "d4"},
     src=f"(select symbol, ts, coalesce(volume * ({G.div(CL, PC)} - 1), 0) as st from bars_brand) as _s")
_MFV = f"coalesce(volume * {G.div(f'({CL} - low) - (high - {CL})', 'high - low')}, 0)"
_reg("g13_ad_line", {"ad_line": f"sum(st) over {_CUM}"}, _line("ad_line"), kinds={"ad_line": "d4"},
     src=f"(select symbol, ts, {_MFV} as st from bars_brand) as _s")
_reg("g14_cmf", {"cmf_20": G.div(G.full("sum", "mfv", 20), G.full("sum", "volume", 20))}, _df(GI.cmf),
     src=f"(select symbol, ts, volume, {_MFV} as mfv from bars_brand) as _s")
_PTP = G.lag(_TP)
_P14, _N14 = G.full("sum", "pos", 14), G.full("sum", "neg", 14)
_reg("g15_mfi", {"mfi_14": f"case when {_N14} = 0 then (case when {_P14} is not null then 100.0 end) "
                            f"else 100 - 100 / (1 + {G.div(_P14, _N14)}) end"}, _df(GI.mfi),
     src=(f"(select symbol, ts, case when {_PTP} is null then null when {_TP} > {_PTP} then {_TP} * volume else 0 end as pos, "
          f"case when {_PTP} is null then null when {_TP} < {_PTP} then {_TP} * volume else 0 end as neg from bars_brand) as _m"))


# ------------------------------------------------------------------------ H
def _guard(x):
    return f"coalesce(case when {x} > {G.lit(1e-6)} then {x} end, {G.lit(1e-6)})"


_ML = f"coalesce(case when abs({G.sma(CL, 50)}) > {G.lit(1e-6)} then {G.sma(CL, 50)} end, {G.lit(1e-6)})"
_reg("h01_market_state", {"market_state": f"case when {G.sma(CL, 10)} > {_ML} * 1.02 then 1 "
                                          f"when {G.sma(CL, 10)} < {_ML} * 0.98 then -1 else 0 end"},
     _df(H.market_state), ints=("market_state",))
_RSRC = f"(select symbol, ts, {RET} as r from bars_brand) as _r"
query("h02_vol_regime", _spec(["vol_regime"], {"vol_regime": "i"}),
      f"select symbol, ts, case when vol > vm * 1.5 then 1 when vol < vm * 0.5 then -1 else 0 end as vol_regime from "
      f"(select symbol, ts, vol, {_guard(G.sma('vol', 50))} as vm from "
      f"(select symbol, ts, {G.full('stddev_samp', 'r', 20)} as vol from {_RSRC}) as _v) as _m")(_df(H.vol_regime))
query("h03_realized_vol", _spec([f"realized_vol_{w}" for w in (5, 10, 20)] + [f"vol_of_vol_{w}" for w in (5, 10, 20)]),
      "select symbol, ts, " + ", ".join(f"rv{w} as realized_vol_{w}" for w in (5, 10, 20)) + ", "
      + ", ".join(f"{G.full('stddev_samp', f'rv{w}', w)} as vol_of_vol_{w}" for w in (5, 10, 20))
      + " from (select symbol, ts, " + ", ".join(f"{G.full('stddev_samp', 'r', w)} as rv{w}" for w in (5, 10, 20))
      + f" from {_RSRC}) as _v")(_df(H.realized_vol))
query("h04_vol_cluster", _spec(["vol_cluster"], {"vol_cluster": "i"}),
      f"select symbol, ts, {G.flag('rv > ' + G.sma('rv', 50))} as vol_cluster from "
      f"(select symbol, ts, {G.full('stddev_samp', 'r', 20)} as rv from {_RSRC}) as _v")(_df(H.vol_cluster))
query("h05_jump", _spec(["jump_indicator"], {"jump_indicator": "i"}),
      f"select symbol, ts, {G.flag('abs(r) > th')} as jump_indicator from "
      f"(select symbol, ts, r, {_guard(G.full('stddev_samp', 'r', 20) + ' * 3')} as th from {_RSRC}) as _j")(_df(H.jump))
_reg("h06_price_volume", {"price_volume_interaction": f"{CL} * volume",
                          "price_volume_ratio": f"{CL} / (volume + {G.lit(1e-8)})",
                          "price_volume_ratio_adv": f"{CL} / (volume + {G.lit(1e-6)})"}, _df(H.price_volume))
_reg("h09_volume_return", {"volume_price_momentum": f"{G.div(V, G.sma(V, 20))} * {RET}",
                           "volume_price_trend": f"volume * {RET}"}, _df(H.volume_return))
