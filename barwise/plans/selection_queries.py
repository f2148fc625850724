"""Registered queries for feature selection (L) and the column coverage check."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwise.functions.core import div, lag, lead, rmax, rmin, rstd, sma
from barwise.operators import select as L
from barwise.operators.segments import segmented
from barwise.plans.registry import query
from barwise.sources import dims as D
from barwise.sources.bars import bars_brand

FEATS = ["ret_1", "ret_5", "ret_10", "close_sma_20_ratio", "volume_ratio_20", "volatility_10", "price_position_20"]


def selection_frame(spark, d):
    """bars_brand features + targets, complete rows only."""
    c, v = F.col("close"), F.col("volume")

    def features(b):
        b = b.withColumns({"ret_1": div(c, lag(c, 1)) - 1, "ret_5": div(c, lag(c, 5)) - 1, "ret_10": div(c, lag(c, 10)) - 1,
                           "close_sma_20_ratio": div(c, sma("close", 20)), "volume_ratio_20": div(v, sma("volume", 20)),
                           "price_position_20": div(c - rmin("low", 20), rmax("high", 20) - rmin("low", 20)),
                           "_next": lead(c)})
        return b.withColumns({"volatility_10": rstd("ret_1", 10),
                              "target_direction": (F.col("_next") > c).cast("int"),
                              "target_return": div(F.col("_next") - c, c)})

    b = segmented(bars_brand(spark, d), features, lookback=20, ahead=1)
    return b.dropna(subset=FEATS + ["target_direction"]).select("symbol", "ts", *FEATS, "target_direction", "target_return")


_W = "(partition by symbol order by ts)"


def _fr(n):
    return f"(partition by symbol order by ts rows between {n - 1} preceding and current row)"


SF = ("sf as (select * from (select *, case when count(ret_1) over " + _fr(10) + " = 10 then stddev_samp(ret_1) over "
      + _fr(10) + " end as volatility_10 from (select symbol, ts, "
      f"\"close\" / nullif(lag(\"close\", 1) over {_W}, 0) - 1 as ret_1, "
      f"\"close\" / nullif(lag(\"close\", 5) over {_W}, 0) - 1 as ret_5, "
      f"\"close\" / nullif(lag(\"close\", 10) over {_W}, 0) - 1 as ret_10, "
      f"\"close\" / nullif(case when count(\"close\") over {_fr(20)} = 20 then avg(\"close\") over {_fr(20)} end, 0) as close_sma_20_ratio, "
      f"volume / nullif(case when count(volume) over {_fr(20)} = 20 then avg(volume) over {_fr(20)} end, 0) as volume_ratio_20, "
      f"(\"close\" - case when count(low) over {_fr(20)} = 20 then min(low) over {_fr(20)} end) / nullif("
      f"case when count(high) over {_fr(20)} = 20 then max(high) over {_fr(20)} end - "
      f"case when count(low) over {_fr(20)} = 20 then min(low) over {_fr(20)} end, 0) as price_position_20, "
      f"cast(lead(\"close\") over {_W} > \"close\" as integer) as target_direction, "
      f"(lead(\"close\") over {_W} - \"close\") / nullif(\"close\", 0) as target_return from bars_brand) as _a) as _b "
      "where " + " and ".join(f"{f} is not null" for f in FEATS + ["target_direction"]) + ")")

RANKED = "feature:s, score:d, rank:i"


def _rank_sql(scores: str, k: int | None = None) -> str:
    lim = f" where rank <= {k}" if k else ""
    return (f"with {SF}, s as ({scores}) select * from (select feature, score, row_number() over "
            f"(order by score desc nulls last, feature) as rank from s) as _r{lim}")


def _u(parts):
    return " union all ".join(parts)


@query("l01_corr_topk", RANKED, _rank_sql(_u(f"select '{f}' as feature, abs(corr({f}, target_direction)) as score from sf"
                                             for f in FEATS), 5))
def _l01(spark, d):
    return L.ranked(L.corr_scores(selection_frame(spark, d), FEATS, "target_direction"), 5)


_ANOVA = _u(
    f"select '{f}' as feature, (sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / nullif(sum(n * v) / (sum(n) - count(*)), 0) as score "
    f"from (select *, sum(n * m) over () / sum(n) over () as gm from (select target_direction, count(*) as n, avg({f}) as m, "
    f"var_pop({f}) as v from sf group by target_direction) as _c) as _g" for f in FEATS)


@query("l02_f_classif", RANKED, _rank_sql(_ANOVA))
def _l02(spark, d):
    return L.ranked(L.f_classif(selection_frame(spark, d), FEATS, "target_direction"))


@query("l03_f_regression", RANKED, _rank_sql(_u(
    f"select '{f}' as feature, (corr({f}, target_return) * corr({f}, target_return)) / "
    f"nullif(1 - corr({f}, target_return) * corr({f}, target_return), 0) * (count(*) - 2) as score from sf" for f in FEATS)))
def _l03(spark, d):
    return L.ranked(L.f_regression(selection_frame(spark, d), FEATS, "target_return"))


def _mi_sql(target_binned: bool) -> str:
    yexpr = "yb" if target_binned else "target_direction"
    yb = ", ntile(10) over (order by target_return, symbol, ts) as yb" if target_binned else ""
    parts = []
    for f in FEATS:
        parts.append(
            f"select '{f}' as feature, sum((nxy / n) * ln(nxy * n / (nx * ny))) as score from ("
            f"select *, sum(nxy) over () as n, sum(nxy) over (partition by bin) as nx, sum(nxy) over (partition by y) as ny from ("
            f"select bin, y, count(*) as nxy from (select ntile(10) over (order by {f}, symbol, ts) as bin, {yexpr} as y "
            f"from (select *{yb} from sf) as _t) as _b group by bin, y) as _j) as _k")
    return _u(parts)


@query("l04_mutual_info", RANKED, _rank_sql(_mi_sql(False)))
def _l04(spark, d):
    return L.ranked(L.mutual_info(selection_frame(spark, d), FEATS, "target_direction"))


@query("l05_mutual_info_regression", RANKED, _rank_sql(_mi_sql(True)))
def _l05(spark, d):
    return L.ranked(L.mutual_info(selection_frame(spark, d), FEATS, "target_return", bin_target=True))


@query("l06_variance_topk", RANKED, _rank_sql(_u(f"select '{f}' as feature, var_samp({f}) as score from sf" for f in FEATS), 4))
def _l06(spark, d):
    return L.ranked(L.variance_scores(selection_frame(spark, d), FEATS), 4)


@query("l07_importance_top3", RANKED, _rank_sql(_u(f"select '{f}' as feature, abs(corr({f}, target_return)) as score from sf"
                                                   for f in FEATS), 3))
def _l07(spark, d):
    return L.ranked(L.corr_scores(selection_frame(spark, d), FEATS, "target_return"), 3)


@query("l08_pca", "symbol:s, ts:t, pc_1:d, pc_2:d, pc_3:d")
def _l08(spark, d):
    _, proj = L.pca(selection_frame(spark, d), FEATS, k=3)
    return proj


@query("b12_coverage", "n_selected:l, n_missing:l, n_available:l, coverage:d, warn:i, usable:i",
       _rank_sql(_u(f"select '{f}' as feature, abs(corr({f}, target_direction)) as score from sf" for f in FEATS), 5)
       .replace("select * from (select feature, score,", "select count(*) as n_selected, "
                "count(*) filter (where feature not in ('ret_1', 'ret_5', 'ret_10', 'volume_ratio_20')) as n_missing, "
                "count(*) filter (where feature in ('ret_1', 'ret_5', 'ret_10', 'volume_ratio_20')) as n_available, "
                "count(*) filter (where feature in ('ret_1', 'ret_5', 'ret_10', 'volume_ratio_20')) / count(*) as coverage, "
                "cast(count(*) filter (where feature in ('ret_1', 'ret_5', 'ret_10', 'volume_ratio_20')) / count(*) < 0.8 as integer) as warn, "
                "cast(count(*) filter (where feature in ('ret_1', 'ret_5', 'ret_10', 'volume_ratio_20')) >= 10 as integer) as usable "
                "from (select feature, score,", 1))
def _b12(spark, d):
    # selected: the top 5 by correlation; present: the columns a serving frame provides
    sel = L.ranked(L.corr_scores(selection_frame(spark, d), FEATS, "target_direction"), 5).select("feature")
    present = spark.createDataFrame([(f,) for f in ("ret_1", "ret_5", "ret_10", "volume_ratio_20")], "feature string")
    return D.coverage(sel, present)
