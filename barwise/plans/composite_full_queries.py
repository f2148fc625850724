"""Every column of the composites I01-I04 against the oracles of the single operators.

A composite column is what its single operator gives on the same bars.  So the oracle of a
whole set is the join of the operators' own oracle texts on (symbol, ts), some columns
renamed, and expressions over the joined columns (lags, ratios, joint flags) on top.
"""

from __future__ import annotations

from barwise.plans import featuresets as I
from barwise.plans import registry as R
from barwise.plans import sqlgen as G
from barwise.plans.spec import parse
from barwise.sources.bars import bars_brand

KEY = "symbol:s, ts:t"


class Wide:
    """Spec and oracle of a wide set, gathered operator by operator."""

    def __init__(self):
        self.parts: list[str] = []
        self.kinds: dict[str, str] = {}
        self.exprs: dict[str, str] = {}
        self.n = 0

    def take(self, name: str, *cols: str, rename: dict[str, str] | None = None,
             source: str = "bars_brand") -> "Wide":
        """Columns of a registered query (all without ``cols``), read from ``source``."""
        q = R.REGISTRY[name]
        kinds = {c: k for c, k in parse(q.spec) if c not in ("symbol", "ts")}
        rename = rename or {}
        got = []
        for c in cols or list(kinds):
            out = rename.get(c, c)
            if out not in self.kinds:
                self.kinds[out] = kinds[c]
                got.append(f'"{c}" as "{out}"')
        sql = q.sql.replace("bars_event", source)
        self.parts.append(f"(select symbol, ts, {', '.join(got)} from ({sql}) as _s{self.n}) as _p{self.n}")
        self.n += 1
        return self

    def add(self, kind: str = "d", **exprs: str) -> "Wide":
        """Expressions over the joined columns."""
        for name, e in exprs.items():
            self.kinds[name] = kind
            self.exprs[name] = e
        return self

    def spec(self) -> str:
        return KEY + "".join(f", {c}:{k}" for c, k in self.kinds.items())

    def sql(self) -> str:
        bars = "(select symbol, ts, \"close\" as _close, volume as _volume from bars_brand) as _b"
        joins = "".join(f"\nleft join {p} using (symbol, ts)" for p in self.parts)
        extra = "".join(f", {e} as {G.q(n)}" for n, e in self.exprs.items())
        return f"select *{extra} from (select * from {bars}{joins}) as _j"


def _lags(w: Wide, feats, ks) -> Wide:
    for f in feats:
        w.add(w.kinds[f], **{f"{f}_lag_{k}": G.lag(G.q(f), k) for k in ks})
    return w


def _core() -> Wide:
    w = Wide()
    w.take("e01_sma", "sma_5", "sma_10", "sma_20", "sma_50").take("f01_ema")
    w.take("e02_volume_sma", "volume_sma_10", "volume_sma_20", "volume_ratio_10", "volume_ratio_20")
    w.take("e03_price_sma_ratios", "close_sma_5_ratio", "close_sma_20_ratio", "sma_5_20_ratio")
    w.take("f03_rsi_wilder", "rsi_7", "rsi_14").take("g01_stochastic").take("g02_williams_r", "williams_r_14")
    w.take("g03_roc", "roc_10", "roc_20").take("g04_cci").take("g05_bollinger")
    w.take("f06_atr", "atr_14", "atr_20").take("g06_keltner").take("g07_donchian")
    w.take("f04_macd", "macd", "macd_signal", "macd_histogram", "macd_bullish").take("f07_adx").take("f08_psar")
    w.take("g08_aroon").take("g09_ichimoku").take("g10_vwap").take("g11_obv").take("g12_vpt").take("g13_ad_line")
    w.take("g14_cmf").take("g15_mfi").take("c01_returns", "returns").take("c04_shadows").take("c06_close_position")
    w.take("c08_gaps").take("c12_doji").take("c13_hammer", "hammer").take("c14_shooting_star")
    w.take("c15_true_range").take("e10_momentum").take("e11_support_resistance")
    return w


def _full() -> Wide:
    w = _core()
    for name in ("d01_calendar_parts", "d02_cyclical", "d03_weekday_flags", "d04_month_flags", "e09_lags",
                 "e05_rolling_pack", "h06_price_volume", "h07_indicator_products", "e18_ma_cross",
                 "e17_volume_price_trend", "c10_gap_flags_2pct", "h01_market_state", "h02_vol_regime",
                 "h03_realized_vol", "h04_vol_cluster", "h05_jump", "e15_trend_slope", "f09_garch_vol"):
        w.take(name)
    w.take("e12_range_position_guarded", "price_position_20_guarded")
    return _lags(w, ("rsi_14", "macd", "bb_position"), (1, 2, 3, 5, 10))


_EXT = (5, 10, 20, 50, 100, 200)


def _close_ratios(w: Wide, ws) -> Wide:
    return w.add(**{f"close_{m}_{n}_ratio": G.div("_close", f"{m}_{n}") for m in ("sma", "ema") for n in ws})


def _extended() -> Wide:
    w = Wide()
    w.take("c01_returns").take("e01_sma", *[f"sma_{n}" for n in _EXT])
    w.take("f02_ema_adjusted", *[f"ema_adj_{n}" for n in _EXT], rename={f"ema_adj_{n}": f"ema_{n}" for n in _EXT})
    _close_ratios(w, _EXT)
    w.take("f03_rsi_sma")
    for n in (7, 14, 21, 30):
        w.add("i", **{f"rsi_sma_{n}_oversold": G.flag(f"rsi_sma_{n} < 30"),
                      f"rsi_sma_{n}_overbought": G.flag(f"rsi_sma_{n} > 70")})
    w.take("f04_macd", *[f"macd_12_26_9_adj{x}" for x in ("", "_signal", "_histogram", "_bullish")])
    w.take("f04_macd_adjusted").take("e13_high_low_ratio_short")
    w.take("g05_bollinger_sample").take("g01_stochastic_slow").take("g02_williams_r").take("g03_roc")
    w.take("f06_atr", "atr_14", "atr_14_ratio", "atr_21", "atr_21_ratio").take("e02_volume_sma")
    w.take("h09_volume_return").take("e19_obv_smoothed").take("g13_ad_line")
    w.take("e11_support_resistance").take("e12_range_position", "price_position_20")
    w.take("e12_range_position_guarded", "price_position_20_guarded").take("e16_trend_vs_atr", "trend_atr_20")
    w.take("c12_doji").take("c13_hammer", "hammer_v2").take("c09_gap_flags")
    w.take("e05_rolling_pack", *[f"close_{a}_{n}" for n in (5, 10, 20) for a in ("mean", "std", "min", "max", "median")])
    w.take("e07_rolling_skew").take("h08_joint_signals").take("f08_psar", "psar", "psar_trend")
    return _lags(w, ("rsi_sma_14", "macd_12_26_9_adj", "bb_position_20_2", "volume_ratio_20"), (1, 2, 3, 5))


def _simple() -> Wide:
    w = Wide()
    ws = (5, 10, 20, 50, 100)
    w.take("c01_returns", rename={"returns": "return_1"})
    w.take("e13_high_low_ratio_short").take("e12_range_position_short").take("e01_sma", *[f"sma_{n}" for n in ws])
    w.take("f02_ema_adjusted", *[f"ema_adj_{n}" for n in ws], rename={f"ema_adj_{n}": f"ema_{n}" for n in ws})
    _close_ratios(w, ws)
    w.add("d4", **{f"sma_slope_{n}": f"sma_{n} - {G.lag(f'sma_{n}', 5)}" for n in ws})
    w.take("e08_volatility").take("e14_mean_ranges", *[f"avg_{x}_{n}" for x in ("range", "true_range") for n in (5, 10, 20)])
    w.take("f03_rsi_sma", "rsi_sma_7", "rsi_sma_14", "rsi_sma_21", rename={f"rsi_sma_{n}": f"rsi_{n}" for n in (7, 14, 21)})
    for n in (7, 14, 21):
        w.add("i", **{f"rsi_{n}_oversold": G.flag(f"rsi_{n} < 30"), f"rsi_{n}_overbought": G.flag(f"rsi_{n} > 70")})
    macd = {f"macd_12_26_9_adj{x}": f"macd{x}" for x in ("", "_signal", "_histogram", "_bullish")}
    w.take("f04_macd", *macd, rename=macd)
    bb = {f"bb_{x}_{n}_2": f"bb_{x}_{n}" for n in (10, 20) for x in ("middle", "upper", "lower", "position", "squeeze")}
    w.take("g05_bollinger_sample", *bb, rename=bb)
    w.take("e02_volume_sma", *[f"volume_{x}_{n}" for x in ("sma", "ratio") for n in (5, 10, 20)])
    w.take("h09_volume_return", "volume_price_trend").take("c05_shadow_ratios").take("c12_doji").take("c09_gap_flags")
    w.take("c16_trend_flags").take("e11_support_resistance")
    _lags(w, ("rsi_14", "macd", "bb_position_20", "volume_ratio_20"), (1, 2, 3, 5))
    w.add("i", rsi_macd_bullish=G.flag("rsi_14 > 50 and macd_bullish = 1"),
          bb_rsi_oversold=G.flag("bb_position_20 < 0.2 and rsi_14 < 30"),
          bb_rsi_overbought=G.flag("bb_position_20 > 0.8 and rsi_14 > 70"))
    return w.add(volume_momentum="volume_ratio_20 * return_1")


#: Columns of each set that the spec compares.
COMPARED: dict[str, list[str]] = {}


def _register(name: str, wide: Wide, build) -> None:
    COMPARED[name] = list(wide.kinds)
    R.query(name, wide.spec(), wide.sql())(lambda spark, d: build(bars_brand(spark, d)))


_register("i01_core_set_all_columns", _core(), lambda b: I.core_set(b, trim=None))
_register("i02_full_set_all_columns", _full(), lambda b: I.full_set(b, trim=None))
_register("i03_extended_set_all_columns", _extended(), I.extended_set)
_register("i04_simple_set_all_columns", _simple(), I.simple_set)
