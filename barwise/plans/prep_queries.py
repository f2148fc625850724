"""Registered queries for cleaning (J), targets/scaling/sequences/splits (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwise.operators import clean as J
from barwise.operators import labels as K
from barwise.plans.registry import query
from barwise.sources.bars import bars_brand, bars_user, feat_dirty

FEATS = ["f_close", "f_volume", "f_sparse", "f_const", "f_big", "f_ratio"]
TRAIN_CUT = "2000-01-01"


def _train():
    return F.col("ts") < F.lit(TRAIN_CUT).cast("timestamp_ntz")


TRAIN_SQL = f"ts < timestamp '{TRAIN_CUT}'"


def _union(parts: list[str]) -> str:
    return "\nunion all\n".join(parts)


# ------------------------------------------------------------------------ J
@query("j01_inf_to_null", "symbol:s, ts:t, f_ratio:d, f_close:d",
       "select symbol, ts, case when isinf(f_ratio) or isnan(f_ratio) then null else f_ratio end as f_ratio, "
       "f_close from feat_dirty")
def _j01(spark, d):
    return J.inf_to_null(feat_dirty(spark, d), ["f_ratio", "f_close"]).select("symbol", "ts", "f_ratio", "f_close")


@query("j02_null_ratio", "feature:s, null_ratio:d, dropped:i",
       _union([f"select '{c}' as feature, avg(case when {c} is null then 1.0 else 0.0 end) as null_ratio, "
               f"cast(avg(case when {c} is null then 1.0 else 0.0 end) > 0.5 as integer) as dropped from feat_dirty"
               for c in FEATS]))
def _j02(spark, d):
    return J.null_ratio_report(feat_dirty(spark, d), FEATS)


@query("j03_constant", "feature:s, constant:i",
       _union([f"select '{c}' as feature, cast(coalesce(min({c}) = max({c}), true) as integer) as constant "
               f"from feat_dirty" for c in FEATS]))
def _j03(spark, d):
    return J.constant_report(feat_dirty(spark, d), FEATS)


def _clip_sql(cols) -> str:
    parts = []
    for c in cols:
        q = (f"select quantile_cont({c}, 0.001) as p001, quantile_cont({c}, 0.25) as q1, "
             f"quantile_cont({c}, 0.75) as q3, quantile_cont({c}, 0.999) as p999 from feat_dirty where {TRAIN_SQL}")
        b = (f"select greatest(q1 - 3 * (q3 - q1), p001) as lo, least(q3 + 3 * (q3 - q1), p999) as hi from ({q}) as _q")
        parts.append(f"select '{c}' as feature, b.lo as lower, b.hi as upper, count(*) filter (where {c} < b.lo) as n_low, "
                     f"count(*) filter (where {c} > b.hi) as n_high from feat_dirty, ({b}) as b group by b.lo, b.hi")
    return _union(parts)


@query("j04_clip_bounds", "feature:s, lower:d, upper:d, n_low:l, n_high:l", _clip_sql(["f_close", "f_volume"]))
def _j04(spark, d):
    f = feat_dirty(spark, d)
    bounds = J.clip_bounds(f, ["f_close", "f_volume"], fit_where=_train())
    return J.clip_counts(f, bounds)


@query("j04_clip", "symbol:s, ts:t, f_close:d, f_volume:d",
       "with b as (" + _union([f"select '{c}' as feature, greatest(q1 - 3 * (q3 - q1), p001) as lo, "
                               f"least(q3 + 3 * (q3 - q1), p999) as hi from (select quantile_cont({c}, 0.001) as p001, "
                               f"quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3, "
                               f"quantile_cont({c}, 0.999) as p999 from feat_dirty where {TRAIN_SQL}) as _q"
                               for c in ("f_close", "f_volume")]) + ")\n"
       "select symbol, ts, case when f_close is not null then least(greatest(f_close, (select lo from b where feature = 'f_close')), "
       "(select hi from b where feature = 'f_close')) end as f_close, "
       "case when f_volume is not null then least(greatest(f_volume, (select lo from b where feature = 'f_volume')), "
       "(select hi from b where feature = 'f_volume')) end as f_volume from feat_dirty")
def _j04b(spark, d):
    f = feat_dirty(spark, d)
    return J.clip(f, J.clip_bounds(f, ["f_close", "f_volume"], fit_where=_train())).select("symbol", "ts", "f_close", "f_volume")


_CUMF = "(partition by symbol order by ts rows between unbounded preceding and current row)"
_FWD = "(partition by symbol order by ts rows between current row and unbounded following)"


@query("j05_ffill", "symbol:s, ts:t, f_close:d, f_sparse:d",
       f"select symbol, ts, last_value(f_close ignore nulls) over {_CUMF} as f_close, "
       f"last_value(f_sparse ignore nulls) over {_CUMF} as f_sparse from feat_dirty")
def _j05(spark, d):
    return J.ffill(feat_dirty(spark, d), ["f_close", "f_sparse"]).select("symbol", "ts", "f_close", "f_sparse")


@query("j06_bfill", "symbol:s, ts:t, f_close:d, f_sparse:d",
       f"select symbol, ts, first_value(f_close ignore nulls) over {_FWD} as f_close, "
       f"first_value(f_sparse ignore nulls) over {_FWD} as f_sparse from feat_dirty")
def _j06(spark, d):
    return J.bfill(feat_dirty(spark, d), ["f_close", "f_sparse"]).select("symbol", "ts", "f_close", "f_sparse")


@query("j07_median_fill", "symbol:s, ts:t, f_close:d, f_sparse:d",
       f"select symbol, ts, coalesce(f_close, (select median(f_close) from feat_dirty where {TRAIN_SQL}), 0) as f_close, "
       f"coalesce(f_sparse, (select median(f_sparse) from feat_dirty where {TRAIN_SQL}), 0) as f_sparse from feat_dirty")
def _j07(spark, d):
    return J.median_fill(feat_dirty(spark, d), ["f_close", "f_sparse"], fit_where=_train()).select(
        "symbol", "ts", "f_close", "f_sparse")


@query("j08_rescale_large", "symbol:s, ts:t, f_big:d, f_close:d2",
       "select symbol, ts, case when m > 1e10 then f_big / (m / 1e6) else f_big end as f_big, "
       "case when mc > 1e10 then f_close / (mc / 1e6) else f_close end as f_close "
       "from feat_dirty, (select max(abs(f_big)) as m, max(abs(f_close)) as mc from feat_dirty) as _m")
def _j08(spark, d):
    return J.rescale_large(feat_dirty(spark, d), ["f_big", "f_close"]).select("symbol", "ts", "f_big", "f_close")


@query("j09_complete_rows", "symbol:s, ts:t, f_close:d2, f_volume:d2",
       "select symbol, ts, f_close, f_volume from feat_dirty where f_close is not null and f_volume is not null")
def _j09(spark, d):
    return J.complete_rows(feat_dirty(spark, d), ["f_close", "f_volume"]).select("symbol", "ts", "f_close", "f_volume")


_J10F = ["f_close", "f_volume", "f_ratio"]
_INF = " or ".join(f"coalesce(isinf({c}), false)" for c in _J10F)
_NUL = " or ".join(f"{c} is null or coalesce(isnan({c}), false)" for c in _J10F)


@query("j10_row_masks", "n_rows:l, n_infinite:l, n_null_feature:l, n_null_target:l, n_kept:l",
       f"select count(*) as n_rows, count(*) filter (where {_INF}) as n_infinite, "
       f"count(*) filter (where {_NUL}) as n_null_feature, count(*) filter (where t is null) as n_null_target, "
       f"count(*) filter (where not ({_INF}) and not ({_NUL}) and t is not null) as n_kept from "
       f"(select *, lead(\"close\") over (partition by symbol order by ts) as t from feat_dirty) as _f")
def _j10(spark, d):
    f = K.targets(feat_dirty(spark, d), drop_last=False)
    return J.row_masks(f, _J10F, "target_price")


@query("j11_input_guard", "n_rows:l, n_nan:l, n_inf:l, ok:i",
       "select count(*) as n_rows, count(*) filter (where f_close is null or f_ratio is null "
       "or coalesce(isnan(f_close), false) or coalesce(isnan(f_ratio), false)) as n_nan, "
       "count(*) filter (where coalesce(isinf(f_close), false) or coalesce(isinf(f_ratio), false)) as n_inf, "
       "cast(count(*) > 0 and count(*) filter (where f_close is null or f_ratio is null) = 0 "
       "and count(*) filter (where coalesce(isinf(f_close), false) or coalesce(isinf(f_ratio), false)) = 0 as integer) as ok "
       "from feat_dirty")
def _j11(spark, d):
    return J.input_guard(feat_dirty(spark, d), ["f_close", "f_ratio"])


# ------------------------------------------------------------------------ K
_LEAD = 'lead("close") over (partition by symbol order by ts)'


@query("k01_targets", "symbol:s, ts:t, target_price:d, target_direction:i, target_return:d",
       f"select symbol, ts, t as target_price, cast(t > \"close\" as integer) as target_direction, "
       f"(t - \"close\") / nullif(\"close\", 0) as target_return from (select *, {_LEAD} as t from bars_brand) as _t "
       "where t is not null")
def _k01(spark, d):
    return K.targets(bars_brand(spark, d))


def _scaled_sql(kind: str, by_symbol: bool) -> str:
    grp = "group by symbol" if by_symbol else ""
    sel = "symbol," if by_symbol else ""
    if kind == "minmax":
        p = f"select {sel} min(\"close\") as c_min, max(\"close\") as c_max, min(volume) as v_min, max(volume) as v_max " \
            f"from bars_brand where {TRAIN_SQL} {grp}"
        ex = ("case when c_max - c_min = 0 then 0 else (\"close\" - c_min) / (c_max - c_min) end as \"close\", "
              "case when v_max - v_min = 0 then 0 else (volume - v_min) / (v_max - v_min) end as volume")
    elif kind == "standard":
        p = f"select {sel} avg(\"close\") as c_m, stddev_pop(\"close\") as c_s, avg(volume) as v_m, stddev_pop(volume) as v_s " \
            f"from bars_brand where {TRAIN_SQL} {grp}"
        ex = ("case when c_s = 0 then 0 else (\"close\" - c_m) / c_s end as \"close\", "
              "case when v_s = 0 then 0 else (volume - v_m) / v_s end as volume")
    else:
        p = (f"select {sel} quantile_cont(\"close\", 0.25) as c25, median(\"close\") as c50, quantile_cont(\"close\", 0.75) as c75, "
             f"quantile_cont(volume, 0.25) as v25, median(volume) as v50, quantile_cont(volume, 0.75) as v75 "
             f"from bars_brand where {TRAIN_SQL} {grp}")
        ex = ("(\"close\" - c50) / case when c75 - c25 = 0 then 1 else c75 - c25 end as \"close\", "
              "(volume - v50) / case when v75 - v25 = 0 then 1 else v75 - v25 end as volume")
    join = "left join p using (symbol)" if by_symbol else ", p"
    return f"with p as ({p}) select symbol, ts, {ex} from bars_brand {join}"


SC = "symbol:s, ts:t, close:d, volume:d"


@query("k02_minmax", SC, _scaled_sql("minmax", False))
def _k02(spark, d):
    b = bars_brand(spark, d)
    p = K.fit_scaler(b, ["close", "volume"], "minmax", fit_where=_train())
    return K.apply_scaler(b, p, "minmax").select("symbol", "ts", "close", "volume")


@query("k02_minmax_by_symbol", SC, _scaled_sql("minmax", True))
def _k02b(spark, d):
    b = bars_brand(spark, d)
    p = K.fit_scaler(b, ["close", "volume"], "minmax", fit_where=_train(), by=["symbol"])
    return K.apply_scaler(b, p, "minmax", by=["symbol"]).select("symbol", "ts", "close", "volume")


@query("k03_standard_by_symbol", SC, _scaled_sql("standard", True))
def _k03(spark, d):
    b = bars_brand(spark, d)
    p = K.fit_scaler(b, ["close", "volume"], "standard", fit_where=_train(), by=["symbol"])
    return K.apply_scaler(b, p, "standard", by=["symbol"]).select("symbol", "ts", "close", "volume")


@query("k04_robust", SC, _scaled_sql("robust", False))
def _k04(spark, d):
    b = bars_brand(spark, d)
    p = K.fit_scaler(b, ["close", "volume"], "robust", fit_where=_train())
    return K.apply_scaler(b, p, "robust").select("symbol", "ts", "close", "volume")


@query("k04_robust_by_symbol", SC, _scaled_sql("robust", True))
def _k04b(spark, d):
    b = bars_brand(spark, d)
    p = K.fit_scaler(b, ["close", "volume"], "robust", fit_where=_train(), by=["symbol"])
    return K.apply_scaler(b, p, "robust", by=["symbol"]).select("symbol", "ts", "close", "volume")


@query("k05_inverse_scaling", "symbol:s, ts:t, close_z:d, close_error:d, target_error:d",
       f"with p as (select symbol, avg(\"close\") as m, stddev_pop(\"close\") as sd from bars_brand where {TRAIN_SQL} "
       "group by symbol) select symbol, ts, case when sd = 0 then 0 else (\"close\" - m) / sd end as close_z, "
       "0.0 as close_error, case when t is null then null else 0.0 end as target_error "
       f"from (select *, {_LEAD} as t from bars_brand) as _b left join p using (symbol)")
def _k05(spark, d):
    b = K.targets(bars_brand(spark, d), drop_last=False).select("symbol", "ts", "close", "target_price")
    p = K.fit_scaler(b, ["close", "target_price"], "standard", fit_where=_train(), by=["symbol"])
    scaled = K.apply_scaler(b, p, "standard", by=["symbol"])
    back = K.inverse_scaler(scaled, p, "standard", by=["symbol"])
    # the round trip restores the inputs up to float noise: report scaled value and error
    return back.join(b.select("symbol", "ts", F.col("close").alias("_c0"), F.col("target_price").alias("_t0")),
                     ["symbol", "ts"]).join(scaled.select("symbol", "ts", F.col("close").alias("close_z")),
                                            ["symbol", "ts"]).select(
        "symbol", "ts", "close_z", (F.col("close") - F.col("_c0")).alias("close_error"),
        (F.col("target_price") - F.col("_t0")).alias("target_error"))


SEQ = "symbol:s, ts:t, n_values:l, first:d, last:d, total:d4, target:i"


def _seq_sql(src: str, lb_lo: int, lb_hi: int, extra_filter: str) -> str:
    fr = f"(partition by symbol order by ts rows between {lb_lo} preceding and {lb_hi} preceding)"
    return (f"select symbol, ts, len(flatten(s)) as n_values, flatten(s)[1] as first, flatten(s)[-1] as last, "
            f"list_sum(flatten(s)) as total, target from (select symbol, ts, "
            f"list(list_value(\"close\", volume)) over {fr} as s, target from {src}) as _s where {extra_filter}")


_TGT = (f"(select *, case when {_LEAD} is not null then cast({_LEAD} > \"close\" as integer) end as target "
        f"from bars_brand) as _t")


@query("k06_sequences", SEQ, _seq_sql(_TGT, 10, 1, "len(s) = 10 and target is not null"))
def _k06(spark, d):
    # sequences are cut from all bars; the last bar (no target) gives no sample
    b = K.targets(bars_brand(spark, d), drop_last=False)
    return K.seq_summary(K.sequences(b, ["close", "volume"], "target_direction", lookback=10)
                         .filter(F.col("target").isNotNull()))


@query("k07_adaptive_sequences", SEQ + ", lookback:i",
       "select symbol, ts, len(flatten(s)) as n_values, flatten(s)[1] as first, flatten(s)[-1] as last, "
       "list_sum(flatten(s)) as total, target, lb as lookback from ("
       "select symbol, ts, target, lb, i, n, case when n = 1 then [list_value(\"close\", volume)] "
       "else list_slice(prev, len(prev) - lb + 1, len(prev)) end as s from ("
       "select *, least(60, greatest(1, n - 1)) as lb, "
       "list(list_value(\"close\", volume)) over (partition by symbol order by ts rows between 60 preceding and 1 preceding) as prev "
       "from (select *, count(*) over (partition by symbol) as n, row_number() over (partition by symbol order by ts) - 1 as i "
       f"from (select *, cast(t > \"close\" as integer) as target from (select *, {_LEAD} as t from bars_user) as _x "
       "where t is not null) as _y) as _a) as _b) as _c "
       "where n = 1 or i >= lb")
def _k07(spark, d):
    # targets first (the last bar of each symbol has none), then the per-symbol look-back
    b = K.targets(bars_user(spark, d), drop_last=True)
    s = K.adaptive_sequences(b, ["close", "volume"], "target_direction", lookback=60)
    return K.seq_summary(s).join(s.select("symbol", "ts", "lookback"), ["symbol", "ts"])


@query("k08_latest_sequence", "symbol:s, ts:t, n_values:l, first:d, last:d, total:d4",
       "select symbol, ts, len(flatten(s)) as n_values, flatten(s)[1] as first, flatten(s)[-1] as last, "
       "list_sum(flatten(s)) as total from (select symbol, ts, "
       "list(list_value(\"close\", volume)) over (partition by symbol order by ts rows between 9 preceding and current row) as s, "
       "row_number() over (partition by symbol order by ts desc) as r from bars_brand) as _s where r = 1 and len(s) = 10")
def _k08(spark, d):
    s = K.latest_sequence(bars_brand(spark, d), ["close", "volume"], 10).withColumn("target", F.lit(None).cast("int"))
    return K.seq_summary(s)


_SPLIT_SQL = ("select symbol, ts, case when pos > n - ceil(n * 0.2) then 'test' "
              "when pos > (n - ceil(n * 0.2)) - ceil((n - ceil(n * 0.2)) * 0.2) then 'validation' else 'train' end as split "
              "from (select *, count(*) over (partition by symbol) as n, row_number() over (partition by symbol order by ts) as pos "
              "from bars_brand) as _s")


@query("k09_chrono_split", "symbol:s, ts:t, split:s", _SPLIT_SQL)
def _k09(spark, d):
    return K.chrono_split(bars_brand(spark, d)).select("symbol", "ts", "split")


@query("k10_stratified_split", "target_direction:i, split:s, n_rows:l",
       "with t as (select cast(t > \"close\" as integer) as target_direction from "
       f"(select *, {_LEAD} as t from bars_brand) as _t where t is not null), "
       "c as (select target_direction, count(*) as n from t group by 1), "
       "s as (select target_direction, n, ceil(n * 0.7) as ntr, ceil((n - ceil(n * 0.7)) / 2) as nva from c) "
       "select target_direction, 'train' as split, ntr as n_rows from s "
       "union all select target_direction, 'validation', nva from s "
       "union all select target_direction, 'test', n - ntr - nva from s")
def _k10(spark, d):
    t = K.targets(bars_brand(spark, d))
    s = K.stratified_split(t, "target_direction", ["symbol", "ts"])
    return s.groupBy("target_direction", "split").agg(F.count(F.lit(1)).alias("n_rows"))


@query("k10_split_assignment", "symbol:s, ts:t, split:s",
       f"with t as (select symbol, ts, cast(t > \"close\" as integer) as y from (select *, {_LEAD} as t from bars_brand) as _t where t is not null), "
       "r as (select *, count(*) over (partition by y) as n, row_number() over (partition by y order by "
       "cast(('0x' || substr(md5(symbol || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '|42'), 1, 15)) as bigint), symbol, ts) as k from t) "
       "select symbol, ts, case when k <= ceil(n * 0.7) then 'train' when k <= ceil(n * 0.7) + ceil((n - ceil(n * 0.7)) / 2) "
       "then 'validation' else 'test' end as split from r")
def _k10b(spark, d):
    t = K.targets(bars_brand(spark, d))
    return K.stratified_split(t, "target_direction", ["symbol", "ts"]).select("symbol", "ts", "split")


@query("k11_split_gate", "split:s, n_rows:l, pos_rate:d, enough:i",
       f"select split, count(*) as n_rows, avg(cast(target_direction as double)) as pos_rate, "
       f"cast(count(*) >= 10 as integer) as enough from (select s.split, t.target_direction from ({_SPLIT_SQL}) as s "
       f"join (select symbol, ts, cast({_LEAD} > \"close\" as integer) as target_direction from bars_brand) as t "
       "using (symbol, ts)) as _j group by split")
def _k11(spark, d):
    b = K.chrono_split(K.targets(bars_brand(spark, d), drop_last=False))
    return K.split_gate(b, "target_direction")


def _noise_sql() -> str:
    def u(i, j, k):
        text = f"symbol || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '|7|' || ({i}) || '|' || {j} || '|{k}'"
        return f"((cast(('0x' || substr(md5({text}), 1, 7)) as bigint) + 1) / cast({(1 << 28) + 1} as double))"

    def z(i, j):
        return f"0.01 * sqrt(-2 * ln({u(i, j, 1)})) * cos(2 * pi() * {u(i, j, 2)})"

    fr = "(partition by symbol order by ts rows between 10 preceding and 1 preceding)"
    total = " + ".join(f"(s[{i + 1}][{j + 1}] + {z(i, j)})" for i in range(10) for j in (0, 1))
    return (f"select symbol, ts, 20 as n_values, s[1][1] + {z(0, 0)} as first, s[10][2] + {z(9, 1)} as last, {total} as total, target "
            f"from (select symbol, ts, list(list_value(\"close\", volume)) over {fr} as s, target from {_TGT}) as _s where len(s) = 10")


# the last bar has no target: a column with nulls, compared as a double
@query("k12_noise_augment", "symbol:s, ts:t, n_values:l, first:d, last:d, total:d4, target:d", _noise_sql())
def _k12(spark, d):
    b = K.targets(bars_brand(spark, d), drop_last=False)
    s = K.sequences(b, ["close", "volume"], "target_direction", lookback=10)
    return K.seq_summary(K.augment_noise(s))

