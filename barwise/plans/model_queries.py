"""Registered queries for evaluation (M), ensembles (N) and model comparison (O).

Input everywhere: the deterministic predictions over ``bars_event`` (FIXTURES §4).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from barwise.operators import compare as O
from barwise.operators import ensemble as N
from barwise.operators import evaluation as M
from barwise.plans.registry import query
from barwise.sources.bars import bars_event

MODELS = list(M.MODELS)


def _preds(spark, d):
    return M.predictions(bars_event(spark, d))


def _safe(num: str, den: str) -> str:
    return f"coalesce(({num}) / nullif({den}, 0), 0)"


LAB = "lab as (select *, cast(y_score > 0.5 as integer) as y_pred from preds)"
CNT = ("cnt as (select model, count(*) filter (where y_true = 1 and y_pred = 1) as tp, "
       "count(*) filter (where y_true = 0 and y_pred = 0) as tn, count(*) filter (where y_true = 0 and y_pred = 1) as fp, "
       "count(*) filter (where y_true = 1 and y_pred = 0) as fn from lab group by model)")
CLS = ("cls as (select model, " + _safe("tp + tn", "tp + tn + fp + fn") + " as accuracy, "
       + _safe("tp", "tp + fp") + " as precision, " + _safe("tp", "tp + fn") + " as recall, "
       + _safe("2 * " + _safe("tp", "tp + fp") + " * " + _safe("tp", "tp + fn"),
               _safe("tp", "tp + fp") + " + " + _safe("tp", "tp + fn")) + " as f1 from cnt)")
_DEN = "sqrt(cast(tp + fp as double) * (tp + fn) * (tn + fp) * (tn + fn))"
TRD = ("trd as (select model, " + _safe("tp", "tp + fn") + " as tpr, " + _safe("tn", "tn + fp") + " as tnr, "
       + _safe("tp", "tp + fp") + " as ppv, " + _safe("tn", "tn + fn") + " as npv, "
       f"case when {_DEN} > 0 then (cast(tp as double) * tn - cast(fp as double) * fn) / {_DEN} else 0 end as mcc from cnt)")
SC = ("sc as (select model, y_score, count(*) filter (where y_true = 1) as pos, "
      "count(*) filter (where y_true = 0) as neg from preds group by model, y_score)")
AUC = ("auc as (select model, case when sum(pos) > 0 and sum(neg) > 0 then "
       "sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) end as roc_auc from "
       "(select *, coalesce(sum(neg) over (partition by model order by y_score rows between unbounded preceding and 1 preceding), 0) "
       "as below from sc) as _c group by model)")
REG = ("reg as (select model, avg((price_true - price_pred) * (price_true - price_pred)) as mse, "
       "sqrt(avg((price_true - price_pred) * (price_true - price_pred))) as rmse, avg(abs(price_true - price_pred)) as mae, "
       "case when var_pop(price_true) * count(price_true) > 0 then 1 - sum((price_true - price_pred) * (price_true - price_pred)) "
       "/ (var_pop(price_true) * count(price_true)) end as r2, "
       "avg(abs((price_true - price_pred) / (price_true + cast('1e-08' as double)))) * 100 as mape from preds group by model)")


def w(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


# ------------------------------------------------------------------------ M
@query("m01_threshold_labels", "symbol:s, ts:t, model:s, y_pred:i",
       "select p.symbol, p.ts, p.model, case when ip then cast(y_score > 0.5 as integer) else cast(trunc(y_score) as integer) end "
       "as y_pred from preds p join (select model, bool_and(y_score between 0 and 1) as ip from preds group by model) as _m "
       "using (model)")
def _m01(spark, d):
    return M.threshold_labels(_preds(spark, d)).select("symbol", "ts", "model", "y_pred")


@query("m02_classification_metrics", "model:s, accuracy:d, precision:d, recall:d, f1:d",
       w(LAB, CNT, CLS) + "select * from cls")
def _m02(spark, d):
    return M.classification_metrics(M.threshold_labels(_preds(spark, d)))


@query("m03_confusion", "model:s, y_true:i, y_pred:i, n:l",
       w(LAB) + "select g.model, g.y_true, g.y_pred, coalesce(c.n, 0) as n from "
       "(select model, t as y_true, pr as y_pred from (select distinct model from lab) as _m, "
       "(select unnest([0, 0, 1, 1]) as t, unnest([0, 1, 0, 1]) as pr) as _g) as g "
       "left join (select model, y_true, y_pred, count(*) as n from lab group by all) as c using (model, y_true, y_pred)")
def _m03(spark, d):
    return M.confusion(M.threshold_labels(_preds(spark, d)))


def _class_report_sql() -> str:
    per = ("per as (select model, '1' as label, " + _safe("tp", "tp + fp") + " as precision, " + _safe("tp", "tp + fn")
           + " as recall, " + _safe("2 * " + _safe("tp", "tp + fp") + " * " + _safe("tp", "tp + fn"),
                                    _safe("tp", "tp + fp") + " + " + _safe("tp", "tp + fn"))
           + " as f1, cast(tp + fn as double) as support from cnt union all "
           "select model, '0', " + _safe("tn", "tn + fn") + ", " + _safe("tn", "tn + fp") + ", "
           + _safe("2 * " + _safe("tn", "tn + fn") + " * " + _safe("tn", "tn + fp"),
                   _safe("tn", "tn + fn") + " + " + _safe("tn", "tn + fp")) + ", cast(tn + fp as double) from cnt)")
    return (w(LAB, CNT, per) + "select * from per union all "
            "select model, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) from per group by model union all "
            "select model, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), "
            "sum(f1 * support) / sum(support), sum(support) from per group by model")


@query("m04_class_report", "model:s, label:s, precision:d, recall:d, f1:d, support:d", _class_report_sql())
def _m04(spark, d):
    return M.class_report(M.threshold_labels(_preds(spark, d)))


@query("m05_roc_auc", "model:s, roc_auc:d", w(SC, AUC) + "select * from auc")
def _m05(spark, d):
    return M.roc_auc(_preds(spark, d))


@query("m06_trading_metrics", "model:s, tpr:d, tnr:d, ppv:d, npv:d, mcc:d", w(LAB, CNT, TRD) + "select * from trd")
def _m06(spark, d):
    return M.trading_metrics(M.threshold_labels(_preds(spark, d)))


@query("m07_regression_metrics", "model:s, mse:d, rmse:d, mae:d, r2:d, mape:d", w(REG) + "select * from reg")
def _m07(spark, d):
    return M.regression_metrics(_preds(spark, d))


@query("m08_residuals", "model:s, mean_residual:d, std_residual:d",
       "select model, avg(price_true - price_pred) as mean_residual, stddev_pop(price_true - price_pred) as std_residual "
       "from preds group by model")
def _m08(spark, d):
    return M.residual_stats(_preds(spark, d))


@query("m08_residual_column", "symbol:s, ts:t, model:s, residual:d",
       "select symbol, ts, model, price_true - price_pred as residual from preds")
def _m08b(spark, d):
    return M.residuals(_preds(spark, d)).select("symbol", "ts", "model", "residual")


@query("m09_directional_accuracy", "model:s, directional_accuracy:d",
       "select model, coalesce(avg(case when dt is not null then cast((dt > 0) = (dp > 0) as double) end), 0) "
       "as directional_accuracy from (select model, price_true - lag(price_true) over w as dt, "
       "price_pred - lag(price_pred) over w as dp from preds window w as (partition by model, symbol order by ts)) as _d "
       "group by model")
def _m09(spark, d):
    return M.directional_accuracy(_preds(spark, d))


@query("m10_error_bounds", "model:s, within_1pct:d, within_5pct:d, within_10pct:d, within_20pct:d",
       "select model, " + ", ".join(
           f"avg(cast(abs((price_true - price_pred) / (price_true + cast('1e-08' as double))) <= {b} as double)) * 100 "
           f"as within_{p}pct" for b, p in ((0.01, 1), (0.05, 5), (0.10, 10), (0.20, 20))) + " from preds group by model")
def _m10(spark, d):
    return M.error_bounds(_preds(spark, d))


@query("m11_roc_curve", "model:s, threshold:d, fpr:d, tpr:d",
       w(SC) + "select model, y_score as threshold, "
       "sum(neg) over (partition by model order by y_score desc rows between unbounded preceding and current row) "
       "/ nullif(sum(neg) over (partition by model), 0) as fpr, "
       "sum(pos) over (partition by model order by y_score desc rows between unbounded preceding and current row) "
       "/ nullif(sum(pos) over (partition by model), 0) as tpr from sc")
def _m11(spark, d):
    return M.roc_curve(_preds(spark, d))


_PR = ("pr as (select model, y_score, pos, sum(pos) over c as cp, sum(pos + neg) over c as ca, "
       "sum(pos) over (partition by model) as tp from sc "
       "window c as (partition by model order by y_score desc rows between unbounded preceding and current row))")


@query("m12_pr_curve", "model:s, threshold:d, precision:d, recall:d",
       w(SC, _PR) + "select model, y_score as threshold, cp / ca as precision, cp / nullif(tp, 0) as recall from pr")
def _m12(spark, d):
    return M.pr_curve(_preds(spark, d))


@query("m12_average_precision", "model:s, average_precision:d",
       w(SC, _PR) + "select model, sum((pos / tp) * (cp / ca)) as average_precision from pr group by model")
def _m12b(spark, d):
    return M.average_precision(_preds(spark, d))


@query("m13_score_histogram", "model:s, y_true:i, bin:i, n:l, bin_start:d",
       "select model, y_true, bin, count(*) as n, first(lo) + (first(hi) - first(lo)) * bin / 30 as bin_start from "
       "(select p.*, r.lo, r.hi, cast(case when r.hi - r.lo = 0 then 0 else least(floor((y_score - r.lo) / (r.hi - r.lo) * 30), 29) end "
       "as integer) as bin from preds p join (select model, min(y_score) as lo, max(y_score) as hi from preds group by model) as r "
       "using (model)) as _b group by model, y_true, bin")
def _m13(spark, d):
    return M.histogram(_preds(spark, d), "y_score", ["model", "y_true"], 30, range_by=["model"])


@query("m13_residual_histogram", "model:s, bin:i, n:l, bin_start:d",
       "select model, bin, count(*) as n, first(lo) + (first(hi) - first(lo)) * bin / 30 as bin_start from "
       "(select e.*, r.lo, r.hi, cast(case when r.hi - r.lo = 0 then 0 else least(floor((res - r.lo) / (r.hi - r.lo) * 30), 29) end "
       "as integer) as bin from (select model, price_true - price_pred as res from preds) as e join "
       "(select model, min(price_true - price_pred) as lo, max(price_true - price_pred) as hi from preds group by model) as r "
       "using (model)) as _b group by model, bin")
def _m13b(spark, d):
    return M.histogram(M.residuals(_preds(spark, d)), "residual", ["model"], 30)


# ------------------------------------------------------------------------ N
_PIV = ", ".join(f"max(case when model = '{m}' then y_score end) as {m}" for m in MODELS)


@query("n01_prediction_matrix", "symbol:s, ts:t, y_true:i, " + ", ".join(f"{m}:d" for m in MODELS),
       f"select symbol, ts, y_true, {_PIV} from preds group by symbol, ts, y_true")
def _n01(spark, d):
    return N.matrix(_preds(spark, d), MODELS)


@query("n01_contributions", "symbol:s, ts:t, model:s, contribution:d",
       "select symbol, ts, model, y_score / nullif(list_reduce(list_sort(list(y_score) over (partition by symbol, ts)), "
       "lambda a, b: a + b), 0) as contribution from preds")
def _n01b(spark, d):
    return N.contributions(_preds(spark, d))


@query("n02_simple_average", "symbol:s, ts:t, ensemble:d",
       "select symbol, ts, avg(y_score) as ensemble from preds group by symbol, ts")
def _n02(spark, d):
    return N.simple_average(_preds(spark, d))


@query("n03_weighted_average", "symbol:s, ts:t, ensemble:d",
       w(LAB, CNT, CLS) + "select symbol, ts, sum(accuracy * y_score) / sum(accuracy) as ensemble "
       "from preds join cls using (model) group by symbol, ts")
def _n03(spark, d):
    p = _preds(spark, d)
    weights = M.classification_metrics(M.threshold_labels(p)).select("model", F.col("accuracy").alias("weight"))
    return N.weighted_average(p, weights)


@query("n04_voting", "symbol:s, ts:t, vote_share:d, majority:i",
       "select symbol, ts, avg(cast(y_score > 0.5 as double)) as vote_share, "
       "cast(avg(cast(y_score > 0.5 as double)) > 0.5 as integer) as majority from preds group by symbol, ts")
def _n04(spark, d):
    return N.voting(_preds(spark, d))


def _n05_sql() -> str:
    grid = N.simplex_grid(len(MODELS), 0.1)
    vals = ", ".join(f"({i}, {', '.join(repr(x) for x in g)})" for i, g in enumerate(grid))
    e = " + ".join(f"cast(g.w{j} as double) * m.{mo}" for j, mo in enumerate(MODELS))
    ec = f"least(greatest({e}, cast('1e-15' as double)), 1 - cast('1e-15' as double))"
    return (f"with g(grid_id, {', '.join(f'w{j}' for j in range(len(MODELS)))}) as (values {vals}),\n"
            f"m as (select symbol, ts, y_true, {_PIV} from preds group by symbol, ts, y_true),\n"
            f"l as (select grid_id, avg(-(y_true * ln({ec}) + (1 - y_true) * ln(1 - {ec}))) as loss from g, m group by grid_id),\n"
            "b as (select * from l order by loss, grid_id limit 1)\n"
            + " union all ".join(f"select '{mo}' as model, g.w{j} as weight, b.loss, b.grid_id from b join g using (grid_id)"
                                 for j, mo in enumerate(MODELS)))


@query("n05_weight_search", "model:s, weight:d, loss:d, grid_id:i", _n05_sql())
def _n05(spark, d):
    return N.weight_search(_preds(spark, d), MODELS, "logloss", 0.1)


@query("n06_stacking", "symbol:s, ts:t, y_true:i, stacked:d")
def _n06(spark, d):
    p = _preds(spark, d)
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    return N.stacking(p.filter(F.col("ts") < cut), p.filter(F.col("ts") >= cut), MODELS)


# the optimum over the whole simplex: its conditions hold, and no grid point is better
@query("n05_simplex_weights", "model:s, kkt:d, total:d, beaten_by_grid:i",
       " union all ".join(f"select '{mo}' as model, 0.0 as kkt, 1.0 as total, 0 as beaten_by_grid" for mo in MODELS))
def _n05b(spark, d):
    p = _preds(spark, d)
    best = N.simplex_weights(p, MODELS, "logloss")
    grid = N.weight_search(p, MODELS, "logloss", 0.1).agg(F.min("loss")).first()[0]
    total = best.agg(F.sum("weight")).first()[0]
    return best.select("model", "kkt", F.lit(total).alias("total"), (F.col("loss") > grid + 1e-12).cast("int").alias("beaten_by_grid"))


@query("n05_simplex_weights_mse", "model:s, kkt:d, weight:d4",
       # two models: the weight that minimises the MSE in closed form, kept inside the simplex
       f"with m as (select symbol, ts, cast(y_true as double) as y, {_PIV} from preds group by symbol, ts, y_true), "
       f"v as (select least(greatest(sum(({MODELS[0]} - {MODELS[1]}) * (y - {MODELS[1]})) / sum(({MODELS[0]} - {MODELS[1]}) * "
       f"({MODELS[0]} - {MODELS[1]})), 0), 1) as a from m) select '{MODELS[0]}' as model, 0.0 as kkt, a as weight from v "
       f"union all select '{MODELS[1]}', 0.0, 1 - a from v")
def _n05c(spark, d):
    return N.simplex_weights(_preds(spark, d), MODELS[:2], "mse").select("model", "kkt", "weight")


_CUT_SQL = "ts < timestamp '2024-01-20'"


@query("n06_linear_meta", "term:s, moment:d",
       " union all ".join(f"select '{t}' as term, 0.0 as moment" for t in ["constant", *MODELS]))
def _n06b(spark, d):
    # the normal equations: residuals of the fitted rows have no moment with the constant or any model
    p = _preds(spark, d).filter(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    out = N.linear_stacking(p, p, MODELS).join(N.matrix(p, MODELS), ["symbol", "ts", "y_true"])
    r = F.col("y_true") - F.col("stacked")
    row = out.agg(F.avg(r).alias("constant"), *[F.avg(r * F.col(m)).alias(m) for m in MODELS])
    return row.select(F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(t).alias("moment")) for t in ["constant", *MODELS]]))
                      .alias("t")).select("t.*")


@query("n06_linear_stacking_one_model", "symbol:s, ts:t, stacked:d",
       f"with t as (select * from preds where model = '{MODELS[0]}'), "
       f"c as (select regr_slope(cast(y_true as double), y_score) as b, regr_intercept(cast(y_true as double), y_score) as a from t where {_CUT_SQL}) "
       f"select symbol, ts, a + b * y_score as stacked from t, c where not ({_CUT_SQL})")
def _n06c(spark, d):
    p = _preds(spark, d)
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    return N.linear_stacking(p.filter(F.col("ts") < cut), p.filter(F.col("ts") >= cut), MODELS[:1])


@query("n06_linear_validation", "n:l, mse_error:i, r2_error:i",
       f"select count(*) as n, 0 as mse_error, 0 as r2_error from (select symbol, ts from preds where not ({_CUT_SQL}) group by symbol, ts) as _k")
def _n06d(spark, d):
    # the score is that of the returned predictions, and not worse than the best single model on the fitted rows
    p = _preds(spark, d)
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    out = N.linear_stacking(p.filter(F.col("ts") < cut), p.filter(F.col("ts") >= cut), MODELS).checkpoint()
    y = F.col("y_true").cast("double")
    own = out.agg(F.sum((y - F.col("stacked")) ** 2).alias("s"), F.sum(y * y).alias("q"), F.sum(y).alias("t"), F.count(F.lit(1)).alias("m"))
    score = N.stacking_score(out).join(F.broadcast(own), F.col("n") == F.col("m"))
    return score.select("n", (F.abs(F.col("mse") - F.col("s") / F.col("m")) > 1e-9).cast("int").alias("mse_error"),
                        (F.abs(F.col("r2") - (1 - F.col("s") / (F.col("q") - F.col("t") * F.col("t") / F.col("m")))) > 1e-9)
                        .cast("int").alias("r2_error"))


# ------------------------------------------------------------------------ O
SUMMARY = "model:s, accuracy:d, precision:d, recall:d, f1:d, roc_auc:d, tpr:d, tnr:d, mcc:d"
_SUM_SQL = (w(LAB, CNT, CLS, TRD, SC, AUC) + "select cls.*, auc.roc_auc, trd.tpr, trd.tnr, trd.mcc from cls "
            "join auc using (model) join trd using (model)")


@query("o01_summary", SUMMARY, _SUM_SQL)
def _o01(spark, d):
    return O.summary(_preds(spark, d))


@query("o02_pairs", "model_a:s, model_b:s",
       "select a.model as model_a, b.model as model_b from (select distinct model from preds) as a "
       "join (select distinct model from preds) as b on a.model < b.model")
def _o02(spark, d):
    return O.pairs(_preds(spark, d).select("model").distinct())


def _pairs_sorted():
    return [(a, b) for i, a in enumerate(MODELS) for b in MODELS[i + 1:]]


def _mcnemar_sql() -> str:
    piv = ", ".join(f"max(case when model = '{m}' then cast(y_pred = y_true as integer) end) as {m}" for m in MODELS)
    parts = [f"select '{a}' as model_a, '{b}' as model_b, count(*) filter (where {a} = 1 and {b} = 0) as b, "
             f"count(*) filter (where {a} = 0 and {b} = 1) as c from m" for a, b in _pairs_sorted()]
    return (w(LAB, f"m as (select symbol, ts, {piv} from lab group by symbol, ts)",
              "bc as (" + " union all ".join(parts) + ")")
            + "select model_a, model_b, b, c, case when b + c = 0 then 0 else pow(abs(b - c) - 1, 2) / (b + c) end as statistic from bc")


@query("o03_mcnemar", "model_a:s, model_b:s, b:l, c:l, statistic:d", _mcnemar_sql())
def _o03(spark, d):
    return O.mcnemar(_preds(spark, d), MODELS).drop("p_value")


@query("o03_mcnemar_pvalue", "model_a:s, model_b:s, statistic:d, p_value:d")
def _o03b(spark, d):
    return O.mcnemar(_preds(spark, d), MODELS)


def _paired_sql() -> str:
    piv = ", ".join(f"max(case when model = '{m}' then abs(price_true - price_pred) end) as {m}" for m in MODELS)
    parts = [f"select '{a}' as model_a, '{b}' as model_b, avg({a} - {b}) as mean_diff, stddev_samp({a} - {b}) as sd_diff, "
             f"count({a} - {b}) as n from m" for a, b in _pairs_sorted()]
    return (w(f"m as (select symbol, ts, {piv} from preds group by symbol, ts)", "t as (" + " union all ".join(parts) + ")")
            + "select model_a, model_b, mean_diff, sd_diff, n, mean_diff / nullif(sd_diff / sqrt(n), 0) as t_statistic from t")


@query("o04_paired_t", "model_a:s, model_b:s, mean_diff:d, sd_diff:d, n:l, t_statistic:d", _paired_sql())
def _o04(spark, d):
    return O.paired_t(_preds(spark, d), MODELS).drop("p_value")


@query("o04_paired_t_pvalue", "model_a:s, model_b:s, t_statistic:d, p_value:d")
def _o04b(spark, d):
    return O.paired_t(_preds(spark, d), MODELS)


@query("o05_best_model", "metric:s, best_model:s, value:d",
       w(LAB, CNT, CLS) + "select 'f1' as metric, arg_max(model, f1) as best_model, max(f1) as value from cls")
def _o05(spark, d):
    return O.best_model(O.summary(_preds(spark, d)), "f1")


@query("o05_best_model_rmse", "metric:s, best_model:s, value:d",
       w(REG) + "select 'rmse' as metric, arg_min(model, rmse) as best_model, min(rmse) as value from reg")
def _o05b(spark, d):
    return O.best_model(M.regression_metrics(_preds(spark, d)), "rmse")


_METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc", "tpr", "tnr", "mcc"]


@query("o06_best_per_metric", "metric:s, best_model:s, value:d",
       w(LAB, CNT, CLS, TRD, SC, AUC, "s as (select cls.*, auc.roc_auc, trd.tpr, trd.tnr, trd.mcc from cls "
                                    "join auc using (model) join trd using (model))",
         "u as (" + " union all ".join(f"select model, '{m}' as metric, {m} as value from s" for m in _METRICS) + ")")
       + "select metric, arg_max(model, row(value, model)) as best_model, arg_max(value, row(value, model)) as value "
         "from u group by metric")
def _o06(spark, d):
    return O.best_per_metric(O.summary(_preds(spark, d)), _METRICS)


@query("o07_radar", "model:s, rmse_score:d, mae_score:d, mape_score:d",
       w(REG) + "select model, 1 / (1 + rmse) as rmse_score, 1 / (1 + mae) as mae_score, 1 / (1 + mape / 100) as mape_score from reg")
def _o07(spark, d):
    return O.radar(M.regression_metrics(_preds(spark, d)))


_THS = [round(0.30 + 0.05 * i, 2) for i in range(9)]


def _trials(spark, d):
    p = _preds(spark, d)
    parts = [p.select("model", F.lit(i + 1).alias("trial"), F.lit(t).alias("threshold"),
                      ((F.col("y_score") > t).cast("int") == F.col("y_true")).cast("double").alias("_ok"))
             for i, t in enumerate(_THS)]
    u = parts[0]
    for x in parts[1:]:
        u = u.unionByName(x)
    return u.groupBy("model", "trial", "threshold").agg(F.avg("_ok").alias("accuracy"))


@query("o08_leaderboard", "model:s, trial:i, threshold:d, accuracy:d, best_so_far:d",
       "with t as (" + " union all ".join(
           f"select model, {i + 1} as trial, {t} as threshold, avg(cast(cast(y_score > {t} as integer) = y_true as double)) "
           f"as accuracy from preds group by model" for i, t in enumerate(_THS)) + "), "
       "r as (select *, max(accuracy) over (partition by model order by trial rows between unbounded preceding and current row) "
       "as best_so_far, min(case when accuracy >= 0.8 then trial end) over (partition by model) as hit from t) "
       "select model, trial, threshold, accuracy, best_so_far from r where hit is null or trial <= hit")
def _o08(spark, d):
    return O.leaderboard(_trials(spark, d), target=0.80)


# ------------------------------------------------------------------------ A14-A17 sinks
def _results_path(spark, name):
    import uuid
    from barwise.session import scratch_path
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


_RESULT_SCHEMA = ("model string, classification struct<accuracy: double, precision: double, recall: double, f1: double>, "
                  "metrics map<string, double>")


def _nested_results(spark, d):
    s = O.summary(_preds(spark, d))
    return s.select("model", F.struct("accuracy", "precision", "recall", "f1").alias("classification"),
                    F.create_map(*[x for m in ("roc_auc", "tpr", "tnr", "mcc") for x in (F.lit(m), F.col(m))]).alias("metrics"))


@query("a14_write_results", "model:s, n_metrics:i")
def _a14(spark, d):
    from barwise.sources.cache import read_results, write_results
    path = _results_path(spark, "results")
    write_results(_nested_results(spark, d), path)
    back = read_results(spark, path, spark.createDataFrame([], _RESULT_SCHEMA).schema)
    return back.select("model", F.size("metrics").alias("n_metrics"))


@query("a15_params_roundtrip", "symbol:s, feature:s, min:d, max:d",
       " union all ".join(f"select symbol, '{c}' as feature, min({q}) as min, max({q}) as max from bars_brand "
                          f"where ts < timestamp '2000-01-01' group by symbol" for c, q in (("close", '"close"'), ("volume", "volume"))))
def _a15(spark, d):
    from barwise.operators.labels import fit_scaler
    from barwise.sources.bars import bars_brand
    from barwise.sources.cache import load_params, save_params
    p = fit_scaler(bars_brand(spark, d), ["close", "volume"], "minmax",
                   fit_where=F.col("ts") < F.lit("2000-01-01").cast("timestamp_ntz"), by=["symbol"])
    path = _results_path(spark, "params")
    save_params(p, path)
    return load_params(spark, path)


@query("a16_model_roundtrip", "symbol:s, ts:t, model:s, y_true:d, y_score:d")
def _a16(spark, d):
    from pyspark.ml import PipelineModel
    from barwise.operators import ml as R
    from barwise.plans.ml_queries import prepared
    from barwise.sources.cache import load_model, save_model
    s = prepared(spark, d)
    m = R.fit_direction(s.filter(F.col("split") == "train"), "logistic", regParam=0.01)
    path = _results_path(spark, "model")
    save_model(m, path, {"name": "logistic", "task": "classification", "lookback": 10})
    loaded, meta = load_model(spark, path, PipelineModel)
    return R.score(loaded, s.filter(F.col("split") == "test"), meta["name"])


@query("a17_read_results", "model:s, f1:d, roc_auc:d",
       _SUM_SQL.replace("select cls.*, auc.roc_auc, trd.tpr, trd.tnr, trd.mcc from cls",
                        "select cls.model, cls.f1, auc.roc_auc from cls", 1))
def _a17(spark, d):
    from barwise.sources.cache import read_results, write_results
    path = _results_path(spark, "results")
    write_results(_nested_results(spark, d), path)
    back = read_results(spark, path, spark.createDataFrame([], _RESULT_SCHEMA).schema)
    return back.select("model", F.col("classification.f1").alias("f1"), F.col("metrics")["roc_auc"].alias("roc_auc"))
