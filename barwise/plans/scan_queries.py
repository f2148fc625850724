"""Registered queries for the recursive smoothers (F) - oracle: DuckDB recursive CTEs."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwise.operators import scan as S
from barwise.plans import sqlgen as G
from barwise.operators.segments import segmented
from barwise.plans.featuresets import CORE_BACK
from barwise.plans.registry import query
from barwise.sources.bars import bars_brand

KEY = "symbol:s, ts:t"
BASE = "b as (select *, row_number() over (partition by symbol order by ts) as rn from bars_brand)"


def _join(ctes: list[str], names: list[str], extra_select: str = "") -> str:
    joins = " ".join(f"left join {n} using (symbol, rn)" for n in names)
    sel = ", ".join(f'{n}."{n}"' for n in names)
    return (f"with recursive {BASE},\n" + ",\n".join(ctes) +
            f"\nselect b.symbol, b.ts, {sel}{extra_select} from b {joins}")


# F01 -----------------------------------------------------------------------------
_F01 = [12, 26, 50]


@query("f01_ema", KEY + "".join(f", ema_{w}:d" for w in _F01),
       _join([G.ema(f"ema_{w}", "b", '"close"', w) for w in _F01], [f"ema_{w}" for w in _F01]))
def _f01(spark, d):
    return segmented(bars_brand(spark, d), lambda b: S.emas(b, "close", _F01), lookback=S.ema_memory(50))


@query("f01_ema_segmented", KEY + "".join(f", ema_{w}:d" for w in _F01),
       _join([G.ema(f"ema_{w}", "b", '"close"', w) for w in _F01], [f"ema_{w}" for w in _F01]))
def _f01s(spark, d):
    # the operator's own block form
    return S.emas_segmented(bars_brand(spark, d), "close", _F01)


# F02 -----------------------------------------------------------------------------
_F02 = [5, 10, 20, 50, 100, 200]


@query("f02_ema_adjusted", KEY + "".join(f", ema_adj_{w}:d" for w in _F02) + ", ema_adj_a01:d",
       _join([G.ema(f"ema_adj_{w}", "b", '"close"', w, adjust=True) for w in _F02]
             + [G.ema("ema_adj_a01", "b", '"close"', None, adjust=True, alpha=0.1)],
             [f"ema_adj_{w}" for w in _F02] + ["ema_adj_a01"]))
def _f02(spark, d):
    def run(b):
        return S.ema(S.emas(b, "close", _F02, adjust=True), "close", None, "ema_adj_a01", adjust=True, alpha=0.1)
    return segmented(bars_brand(spark, d), run, lookback=S.ema_memory(200))


# F03 -----------------------------------------------------------------------------
_F03 = [7, 14, 21, 30]


def _rsi_wilder_sql() -> str:
    d = f'"close" - lag("close") over (partition by symbol order by rn)'
    base = (f"g as (select symbol, rn, ts, case when d is null then null else greatest(d, 0) end as gp,"
            f" case when d is null then null else greatest(-d, 0) end as gn from (select *, {d} as d from b) as _x)")
    ctes = [base]
    for n in _F03:
        ctes += [G.wilder(f"gm_{n}", "g", "gp", n), G.wilder(f"bm_{n}", "g", "gn", n)]
    sel = []
    joins = []
    for n in _F03:
        joins.append(f"left join gm_{n} using (symbol, rn) left join bm_{n} using (symbol, rn)")
        gm, bm = f'gm_{n}."gm_{n}"', f'bm_{n}."bm_{n}"'
        sel.append(f"case when {bm} > 0 then 100 - 100 / (1 + {gm} / {bm}) when {gm} is not null then 100 end as rsi_{n}")
        sel.append(G.flag(f"(case when {bm} > 0 then 100 - 100 / (1 + {gm} / {bm}) when {gm} is not null then 100 end) < 30")
                   + f" as rsi_{n}_oversold")
        sel.append(G.flag(f"(case when {bm} > 0 then 100 - 100 / (1 + {gm} / {bm}) when {gm} is not null then 100 end) > 70")
                   + f" as rsi_{n}_overbought")
    return (f"with recursive {BASE},\n" + ",\n".join(ctes) +
            f"\nselect b.symbol, b.ts, {', '.join(sel)} from b {' '.join(joins)}")


@query("f03_rsi_wilder", KEY + "".join(f", rsi_{n}:d, rsi_{n}_oversold:i, rsi_{n}_overbought:i" for n in _F03),
       _rsi_wilder_sql())
def _f03(spark, d):
    def run(df):
        for n in _F03:
            df = S.rsi_flags(S.rsi(df, n), n)
        return df
    return segmented(bars_brand(spark, d), run, lookback=S.wilder_memory(max(_F03)))


def _rsi_sma_sql(method: str) -> str:
    sel = []
    if method == "sma":
        dd = f'("close" - {G.lag(chr(34) + "close" + chr(34))})'
        g = f"case when {dd} > 0 then {dd} else 0 end"
        bl = f"case when {dd} < 0 then -{dd} else 0 end"
    else:
        r = f'({G.div(chr(34) + "close" + chr(34), G.lag(chr(34) + "close" + chr(34)))} - 1)'
        g = f"case when {r} is null then null when {r} > 0 then {r} else 0 end"
        bl = f"case when {r} is null then null when {r} < 0 then -{r} else 0 end"
    inner = f"select symbol, ts, {g} as gp, {bl} as gn from bars_brand"
    for n in _F03:
        gm, bm = G.sma("gp", n), G.sma("gn", n)
        if method == "sma":
            sel.append(f"case when {bm} > 0 then 100 - 100 / (1 + {gm} / {bm}) when {gm} > 0 then 100 end as rsi_sma_{n}")
        else:
            sel.append(f"100 - 100 / (1 + {gm} / ({bm} + {G.lit(1e-8)})) as rsi_pct_{n}")
    return f"select symbol, ts, {', '.join(sel)} from ({inner}) as _g"


@query("f03_rsi_sma", KEY + "".join(f", rsi_sma_{n}:d" for n in _F03), _rsi_sma_sql("sma"))
def _f03b(spark, d):
    def run(df):
        for n in _F03:
            df = S.rsi(df, n, method="sma")
        return df
    return segmented(bars_brand(spark, d), run, lookback=max(_F03) + 1)


@query("f03_rsi_pct", KEY + "".join(f", rsi_pct_{n}:d" for n in _F03), _rsi_sma_sql("pct"))
def _f03c(spark, d):
    def run(df):
        for n in _F03:
            df = S.rsi(df, n, method="pct")
        return df
    return segmented(bars_brand(spark, d), run, lookback=max(_F03) + 1)


# F04 -----------------------------------------------------------------------------
_F04 = [(12, 26, 9, False), (5, 35, 5, False), (19, 39, 9, False), (12, 26, 9, True)]


def _macd_name(f, s, g, adj):
    return "macd" if (f, s, g) == (12, 26, 9) and not adj else f"macd_{f}_{s}_{g}" + ("_adj" if adj else "")


def _macd_sql(settings=_F04) -> str:
    ctes, joins, sel = [], [], []
    for f, s, g, adj in settings:
        p = _macd_name(f, s, g, adj)
        ctes.append(G.ema(f"{p}_f", "b", '"close"', f, adjust=adj))
        ctes.append(G.ema(f"{p}_s", "b", '"close"', s, adjust=adj))
        ctes.append(f'{p}_l as (select b.symbol, b.rn, "{p}_f" - "{p}_s" as line from b '
                    f"left join {p}_f using (symbol, rn) left join {p}_s using (symbol, rn))")
        ctes.append(G.ema(f"{p}_g", f"{p}_l", "line", g, adjust=adj))
        joins.append(f"left join {p}_l using (symbol, rn) left join {p}_g using (symbol, rn)")
        line, sig = f"{p}_l.line", f'{p}_g."{p}_g"'
        sel += [f"{line} as {p}", f"{sig} as {p}_signal", f"{line} - {sig} as {p}_histogram",
                G.flag(f"{line} > {sig}") + f" as {p}_bullish"]
    return (f"with recursive {BASE},\n" + ",\n".join(ctes) +
            f"\nselect b.symbol, b.ts, {', '.join(sel)} from b {' '.join(joins)}")


def _macd_spec(settings=_F04) -> str:
    out = KEY
    for f, s, g, adj in settings:
        p = _macd_name(f, s, g, adj)
        # a difference of two large EMAs: compared at 1e-4 (scan error ~1e-15 relative)
        out += f", {p}:d4, {p}_signal:d4, {p}_histogram:d4, {p}_bullish:i"
    return out


def _macds(settings):
    def run(df):
        for f, s, g, adj in settings:
            df = S.macd(df, f, s, g, adjust=adj)
        return df

    back = max(S.ema_memory(max(f, s), g) for f, s, g, _ in settings)
    return lambda spark, d: segmented(bars_brand(spark, d), run, lookback=back)


query("f04_macd", _macd_spec(), _macd_sql())(_macds(_F04))

# the other settings of the extended set
_F04_ADJ = [(5, 35, 5, True), (19, 39, 9, True)]
query("f04_macd_adjusted", _macd_spec(_F04_ADJ), _macd_sql(_F04_ADJ))(_macds(_F04_ADJ))


# F05 -----------------------------------------------------------------------------
_F05 = [5, 10, 20, 50]


@query("f05_close_ema_ratio", KEY + "".join(f", close_ema_{w}_ratio:d" for w in _F05),
       f"with recursive {BASE},\n" + ",\n".join(G.ema(f"e{w}", "b", '"close"', w, adjust=True) for w in _F05)
       + "\nselect b.symbol, b.ts, " + ", ".join(f'{G.div(chr(34) + "close" + chr(34), f"e{w}.e{w}")} as close_ema_{w}_ratio' for w in _F05)
       + " from b " + " ".join(f"left join e{w} using (symbol, rn)" for w in _F05))
def _f05(spark, d):
    return segmented(bars_brand(spark, d), lambda b: S.close_ema_ratio(b, tuple(_F05)), lookback=S.ema_memory(max(_F05)))


# F06 -----------------------------------------------------------------------------
_F06 = [14, 20, 21]
_TRB = (f"t as (select symbol, rn, ts, \"close\", "
        + G.gmax("high - low", 'abs(high - lag("close") over (partition by symbol order by rn))',
                 'abs(low - lag("close") over (partition by symbol order by rn))') + " as tr from b)")


@query("f06_atr", KEY + "".join(f", atr_{n}:d, atr_{n}_ratio:d" for n in _F06),
       f"with recursive {BASE},\n{_TRB},\n" + ",\n".join(G.wilder(f"atr_{n}", "t", "tr", n) for n in _F06)
       + "\nselect t.symbol, t.ts, " + ", ".join(f'atr_{n}."atr_{n}" as atr_{n}, {G.div(f"atr_{n}.atr_{n}", chr(34) + "close" + chr(34))} as atr_{n}_ratio' for n in _F06)
       + " from t " + " ".join(f"left join atr_{n} using (symbol, rn)" for n in _F06))
def _f06(spark, d):
    return segmented(bars_brand(spark, d), lambda b: S.atr(b, tuple(_F06), ratio=True), lookback=S.wilder_memory(max(_F06)))


# F07 -----------------------------------------------------------------------------
def _adx_sql(n: int = 14) -> str:
    lagp = "over (partition by symbol order by rn)"
    dm = (f"dm as (select symbol, rn, ts, tr, "
          f"case when up is null then null when up > dn and up > 0 then up else 0 end as pdm, "
          f"case when dn is null then null when dn > up and dn > 0 then dn else 0 end as mdm from "
          f"(select t.*, high - lag(high) {lagp} as up, lag(low) {lagp} - low as dn from "
          f"(select b.*, " + G.gmax("high - low", f'abs(high - lag("close") {lagp})', f'abs(low - lag("close") {lagp})')
          + f" as tr from b) as t) as _u)")
    ctes = [dm, G.wilder("s_tr", "dm", "tr", n), G.wilder("s_p", "dm", "pdm", n), G.wilder("s_m", "dm", "mdm", n),
            "di as (select dm.symbol, dm.rn, dm.ts, 100 * (s_p.s_p / nullif(s_tr.s_tr, 0)) as pdi, "
            "100 * (s_m.s_m / nullif(s_tr.s_tr, 0)) as mdi from dm left join s_tr using (symbol, rn) "
            "left join s_p using (symbol, rn) left join s_m using (symbol, rn))",
            "dx as (select *, case when pdi + mdi = 0 then 0 else 100 * (abs(pdi - mdi) / nullif(pdi + mdi, 0)) end as dx from di)",
            G.wilder("adx", "dx", "dx", n)]
    return (f"with recursive {BASE},\n" + ",\n".join(ctes) +
            "\nselect dx.symbol, dx.ts, pdi as adx_pos, mdi as adx_neg, adx.adx as adx from dx left join adx using (symbol, rn)")


@query("f07_adx", KEY + ", adx_pos:d, adx_neg:d, adx:d", _adx_sql())
def _f07(spark, d):
    return S.adx_segmented(bars_brand(spark, d), 14)


# F09 -----------------------------------------------------------------------------
@query("f09_garch_vol", KEY + ", returns_squared:d, garch_vol:d",
       f"with recursive {BASE},\n"
       "r as (select symbol, rn, ts, pow(\"close\" / nullif(lag(\"close\") over (partition by symbol order by rn), 0) - 1, 2) as rsq from b),\n"
       + G.ema("gv", "r", "rsq", None, adjust=True, alpha=0.1)
       + "\nselect r.symbol, r.ts, r.rsq as returns_squared, gv.gv as garch_vol from r left join gv using (symbol, rn)")
def _f09(spark, d):
    return S.garch_vol_segmented(bars_brand(spark, d))



# ------------------------------------------------------------------ shared CTE builders
def rsi_ctes(n: int = 14) -> tuple[list[str], str, str]:
    d = '"close" - lag("close") over (partition by symbol order by rn)'
    ctes = [f"g{n} as (select symbol, rn, case when d is null then null else greatest(d, 0) end as gp, "
            f"case when d is null then null else greatest(-d, 0) end as gn from (select symbol, rn, {d} as d from b) as _x)",
            G.wilder(f"gm{n}", f"g{n}", "gp", n), G.wilder(f"bm{n}", f"g{n}", "gn", n)]
    gm, bm = f'gm{n}."gm{n}"', f'bm{n}."bm{n}"'
    expr = f"(case when {bm} > 0 then 100 - 100 / (1 + {gm} / {bm}) when {gm} is not null then 100 end)"
    return ctes, f"left join gm{n} using (symbol, rn) left join bm{n} using (symbol, rn)", expr


def macd_ctes(f: int = 12, s: int = 26, g: int = 9) -> tuple[list[str], str, str, str]:
    p = f"m{f}_{s}_{g}"
    ctes = [G.ema(f"{p}_f", "b", '"close"', f), G.ema(f"{p}_s", "b", '"close"', s),
            f'{p}_l as (select b.symbol, b.rn, "{p}_f" - "{p}_s" as line from b '
            f"left join {p}_f using (symbol, rn) left join {p}_s using (symbol, rn))",
            G.ema(f"{p}_g", f"{p}_l", "line", g)]
    return ctes, f"left join {p}_l using (symbol, rn) left join {p}_g using (symbol, rn)", f"{p}_l.line", f'{p}_g."{p}_g"'


def atr_ctes(n: int = 14) -> tuple[list[str], str, str]:
    lagp = "over (partition by symbol order by rn)"
    ctes = [f"tr{n} as (select symbol, rn, " + G.gmax("high - low", f'abs(high - lag("close") {lagp})',
                                                    f'abs(low - lag("close") {lagp})') + " as tr from b)",
            G.wilder(f"atr{n}", f"tr{n}", "tr", n)]
    return ctes, f"left join atr{n} using (symbol, rn)", f'atr{n}."atr{n}"'


def adx_ctes(n: int = 14) -> tuple[list[str], str, str]:
    sql = _adx_sql(n)
    body = sql[len(f"with recursive {BASE},\n"):sql.index("\nselect dx.symbol")]
    return [body], "left join dx using (symbol, rn) left join adx using (symbol, rn)", "adx.adx"


def _bbpos(ddof: int, w: int = 20, k: float = 2.0) -> str:
    fn = "stddev_pop" if ddof == 0 else "stddev_samp"
    fr = f"(partition by symbol order by rn rows between {w - 1} preceding and current row)"
    m = f"(case when count(\"close\") over {fr} = {w} then avg(\"close\") over {fr} end)"
    sd = f"(case when count(\"close\") over {fr} = {w} then {fn}(\"close\") over {fr} end)"
    return f"(\"close\" - ({m} - {k} * {sd})) / nullif(({m} + {k} * {sd}) - ({m} - {k} * {sd}), 0)"


# H07 ------------------------------------------------------------------------------
def _h07_sql() -> str:
    c1, j1, atr = atr_ctes(14)
    c2, j2, rsi = rsi_ctes(14)
    c3, j3, line, _sig = macd_ctes()
    c4, j4, adx = adx_ctes(14)
    bb = f"bbp as (select symbol, rn, {_bbpos(0)} as bb_position from b)"
    return (f"with recursive {BASE},\n" + ",\n".join(c1 + c2 + c3 + c4 + [bb]) +
            f"\nselect b.symbol, b.ts, {atr} * {rsi} as volatility_momentum, {line} * {adx} as trend_momentum, "
            f"bbp.bb_position * {rsi} as bb_rsi_interaction from b {j1} {j2} {j3} {j4} left join bbp using (symbol, rn)")


@query("h07_indicator_products", KEY + ", volatility_momentum:d4, trend_momentum:d2, bb_rsi_interaction:d4", _h07_sql())
def _h07(spark, d):
    from barwise.operators.regime import indicator_products
    return segmented(bars_brand(spark, d), indicator_products, lookback=CORE_BACK)


def _h08_sql() -> str:
    c2, j2, rsi = rsi_ctes(14)
    c3, j3, line, sig = macd_ctes()
    bb = f"bbp as (select symbol, rn, {_bbpos(1)} as bbp from b)"
    f = G.flag
    return (f"with recursive {BASE},\n" + ",\n".join(c2 + c3 + [bb]) +
            f"\nselect b.symbol, b.ts, {f(f'{rsi} > 50 and {line} > 0')} as rsi_macd_signal, "
            f"{f(f'bbp.bbp < 0.2 and {rsi} < 30')} as bb_rsi_oversold, {f(f'bbp.bbp > 0.8 and {rsi} > 70')} as bb_rsi_overbought, "
            f"{f(f'{rsi} > 50 and {line} > {sig}')} as rsi_macd_bullish from b {j2} {j3} left join bbp using (symbol, rn)")


@query("h08_joint_signals", KEY + ", rsi_macd_signal:i, bb_rsi_oversold:i, bb_rsi_overbought:i, rsi_macd_bullish:i", _h08_sql())
def _h08(spark, d):
    from barwise.operators.regime import joint_signals
    return segmented(bars_brand(spark, d), joint_signals, lookback=CORE_BACK)


# F08 ------------------------------------------------------------------------------
_PSAR_SQL = (
    f"with recursive {BASE},\n"
    "p as (select symbol, rn, ts, high, low, lag(low) over w as l1, coalesce(lag(low, 2) over w, lag(low) over w) as l2, "
    "lag(high) over w as h1, coalesce(lag(high, 2) over w, lag(high) over w) as h2 from b "
    "window w as (partition by symbol order by rn)),\n"
    "r as (select symbol, rn, low as sar, high as ep, cast(0.02 as double) as af, 1 as trend from p where rn = 1\n"
    "  union all\n"
    "  select p.symbol, p.rn,\n"
    "    case when r.trend = 1 then (case when p.low < least(r.sar + r.af * (r.ep - r.sar), p.l1, p.l2) then r.ep "
    "else least(r.sar + r.af * (r.ep - r.sar), p.l1, p.l2) end)\n"
    "         else (case when p.high > greatest(r.sar + r.af * (r.ep - r.sar), p.h1, p.h2) then r.ep "
    "else greatest(r.sar + r.af * (r.ep - r.sar), p.h1, p.h2) end) end,\n"
    "    case when r.trend = 1 then (case when p.low < least(r.sar + r.af * (r.ep - r.sar), p.l1, p.l2) then p.low "
    "when p.high > r.ep then p.high else r.ep end)\n"
    "         else (case when p.high > greatest(r.sar + r.af * (r.ep - r.sar), p.h1, p.h2) then p.high "
    "when p.low < r.ep then p.low else r.ep end) end,\n"
    "    case when r.trend = 1 then (case when p.low < least(r.sar + r.af * (r.ep - r.sar), p.l1, p.l2) then cast(0.02 as double) "
    "when p.high > r.ep then least(r.af + cast(0.02 as double), cast(0.2 as double)) else r.af end)\n"
    "         else (case when p.high > greatest(r.sar + r.af * (r.ep - r.sar), p.h1, p.h2) then cast(0.02 as double) "
    "when p.low < r.ep then least(r.af + cast(0.02 as double), cast(0.2 as double)) else r.af end) end,\n"
    "    case when r.trend = 1 then (case when p.low < least(r.sar + r.af * (r.ep - r.sar), p.l1, p.l2) then -1 else 1 end)\n"
    "         else (case when p.high > greatest(r.sar + r.af * (r.ep - r.sar), p.h1, p.h2) then 1 else -1 end) end\n"
    "  from r join p on p.symbol = r.symbol and p.rn = r.rn + 1)\n"
    "select b.symbol, b.ts, r.sar as psar, case when r.trend = 1 then r.sar end as psar_up, "
    "case when r.trend = -1 then r.sar end as psar_down, r.trend as psar_trend from b join r using (symbol, rn)")


@query("f08_psar", KEY + ", psar:d, psar_up:d, psar_down:d, psar_trend:i", _PSAR_SQL)
def _f08(spark, d):
    from barwise.operators.path import psar
    return psar(bars_brand(spark, d), skew_safe=True)


@query("f08_psar_blocked", KEY + ", psar:d, psar_up:d, psar_down:d, psar_trend:i", _PSAR_SQL)
def _f08b(spark, d):
    # small blocks and halos: many blocks per symbol, boundaries checked and repaired
    from barwise.operators.path import psar
    return psar(bars_brand(spark, d), block=200, halo=40)


@query("f08_psar_fallback", KEY + ", psar_sma_20:d, psar_trend_simple:i",
       "select symbol, ts, case when count(\"close\") over f = 20 then avg(\"close\") over f end as psar_sma_20, "
       "cast(coalesce(\"close\" > case when count(\"close\") over f = 20 then avg(\"close\") over f end, false) as integer) "
       "as psar_trend_simple from bars_brand window f as (partition by symbol order by ts rows between 19 preceding and current row)")
def _f08c(spark, d):
    from barwise.functions.core import flag, sma
    b = segmented(bars_brand(spark, d), lambda b: b.withColumn("psar_sma_20", sma("close", 20)), lookback=19)
    return b.withColumn("psar_trend_simple", flag(F.col("close") > F.col("psar_sma_20")))


# F10 ------------------------------------------------------------------------------
@query("f10_lookback_scan", "symbol:s, best_window:i, best_rate:d",
       "with t as (select symbol, ts, cast(nx > \"close\" as double) as y, row_number() over (partition by symbol order by ts) - 1 as i, "
       "count(*) over (partition by symbol) as n from (select *, lead(\"close\") over (partition by symbol order by ts) as nx "
       "from bars_brand) as _a where nx is not null), "
       "r as (select symbol, wnd, avg(y) as p from t, (select unnest([5, 10, 15, 20]) as wnd) as _w "
       "where n - wnd > 50 and i >= wnd and i < wnd + floor((n - wnd) * 0.8) group by symbol, wnd), "
       "s as (select symbol, wnd, greatest(p, 1 - p) as rate from r) "
       "select symbol, arg_max(wnd, row(rate, -wnd)) as best_window, max(rate) as best_rate from s group by symbol")
def _f10(spark, d):
    from barwise.operators.labels import targets
    from barwise.operators.path import lookback_scan
    return lookback_scan(targets(bars_brand(spark, d)))


# flagship ------------------------------------------------------------------------
def _flagship_sql() -> str:
    c3, j3, line, sig = macd_ctes()
    fr = lambda n: f"(partition by symbol order by rn rows between {n - 1} preceding and current row)"
    return (f"with recursive {BASE},\n" + ",\n".join(c3) + ",\n"
            f"f as (select b.symbol, b.ts, b.rn, b.\"close\", case when count(\"close\") over {fr(5)} = 5 then avg(\"close\") over {fr(5)} end as sma_5, "
            f"case when count(\"close\") over {fr(20)} = 20 then avg(\"close\") over {fr(20)} end as sma_20, {line} as macd, {sig} as macd_signal, "
            "case when lead(\"close\") over (partition by symbol order by rn) is not null then "
            "cast(lead(\"close\") over (partition by symbol order by rn) > \"close\" as integer) end as target_direction "
            f"from b {j3}),\n"
            "g as (select *, case when macd > macd_signal and sma_5 > sma_20 then 'BUY' "
            "when macd < macd_signal and sma_5 < sma_20 then 'SELL' else 'HOLD' end as signal from f),\n"
            "h as (select *, signal <> 'HOLD' and target_direction is not null as called, "
            "cast(coalesce((signal = 'BUY' and target_direction = 1) or (signal = 'SELL' and target_direction = 0), false) as integer) as hit from g)\n"
            "select symbol, arg_max(ts, rn) as ts, arg_max(\"close\", rn) as \"close\", arg_max(sma_5, rn) as sma_5, "
            "arg_max(sma_20, rn) as sma_20, arg_max(macd, rn) as macd, arg_max(macd_signal, rn) as macd_signal, "
            "arg_max(signal, rn) as signal, count(*) filter (where called) as n_signals, "
            "sum(case when called then hit end) / nullif(count(*) filter (where called), 0) as hit_rate from h group by symbol")


@query("flagship_signal", "symbol:s, ts:t, close:d, sma_5:d, sma_20:d, macd:d4, macd_signal:d4, signal:s, n_signals:l, hit_rate:d",
       _flagship_sql())
def _flag(spark, d):
    from barwise.plans.flagship import flagship
    return flagship(spark, d)


# warm-up-aware range read -------------------------------------------
def _range_sql() -> str:
    c2, j2, rsi = rsi_ctes(14)
    c1, j1, atr = atr_ctes(14)
    c3, j3, line, _sig = macd_ctes()
    e12 = G.ema("ema12", "b", '"close"', 12)
    fr = "(partition by symbol order by rn rows between 19 preceding and current row)"
    sel = (f"select b.symbol, b.ts, case when count(\"close\") over {fr} = 20 then avg(\"close\") over {fr} end as sma_20, "
           f"ema12.ema12 as ema_12, {rsi} as rsi_14, {atr} as atr_14, {line} as macd from b {j2} {j1} {j3} "
           "left join ema12 using (symbol, rn)")
    return (f"with recursive {BASE},\n" + ",\n".join(c2 + c1 + c3 + [e12]) +
            f"\nselect * from ({sel}) as _r where ts >= timestamp '2000-01-01' and ts <= timestamp '2000-12-31'")


@query("e01_range_read", KEY + ", sma_20:d, ema_12:d, rsi_14:d, atr_14:d, macd:d4", _range_sql())
def _range(spark, d):
    import datetime as dt
    from barwise.plans.feature_registry import features
    return features(bars_brand(spark, d), ["sma_20", "ema_12", "rsi_14", "atr_14", "macd"],
                    dt.datetime(2000, 1, 1), dt.datetime(2000, 12, 31))
