"""Registered queries for model fitting and scoring on Spark ML (R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwise.operators import evaluation as M
from barwise.operators import labels as K
from barwise.operators import ml as R
from barwise.operators.segments import last_rows, segmented
from barwise.plans import sqlgen as G
from barwise.plans.registry import query
from barwise.plans.selection_queries import FEATS, selection_frame
from barwise.sources.bars import bars_brand

PRED = "symbol:s, ts:t, model:s, y_true:d, y_score:d"
LOOKBACK = 10


def prepared(spark, d, target: str = "target_direction"):
    """features -> chronological split -> per-symbol standard scaling fitted on train rows
    -> look-back sequences (features of the 10 previous bars, target of the bar)."""
    bars = bars_brand(spark, d)                 # what follows has no bar more
    f = K.chrono_split(selection_frame(spark, d), rows=bars)
    params = K.fit_scaler(f, FEATS, "standard", fit_where=F.col("split") == "train", by=["symbol"])
    scaled = K.apply_scaler(f, params, "standard", by=["symbol"])
    out = K.sequences(scaled, FEATS, target, lookback=LOOKBACK, keep=("split",), rows=bars)
    # iterative estimators read the training table many times: materialise it once in the
    # shared checkpoint folder (reliable checkpoint, lineage cut; survives executor loss)
    from barwise.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    return out.checkpoint()


@query("r01_direction_classifier", PRED)
def _r01(spark, d):
    s = prepared(spark, d)
    m = R.fit_direction(s.filter(F.col("split") == "train"), "logistic", regParam=0.01)
    return R.score(m, s.filter(F.col("split") == "test"), "logistic")


@query("r02_price_regressor", PRED)
def _r02(spark, d):
    s = prepared(spark, d, target="target_return")
    m = R.fit_price(s.filter(F.col("split") == "train"), "linear", regParam=0.01)
    return R.score(m, s.filter(F.col("split") == "test"), "linear", classification=False)


@query("r03_score_latest", PRED)
def _r03(spark, d):
    s = prepared(spark, d)
    m = R.fit_direction(s.filter(F.col("split") == "train"), "logistic", regParam=0.01)
    return R.score(m, last_rows(s, 1).drop("_k"), "logistic")


# it scores exactly the last sequence (with a known target) of each symbol
@query("r03_scored_keys", "symbol:s, ts:t, in_range:i",
       "select symbol, max(ts) as ts, 1 as in_range from (select symbol, ts, "
       "lead(\"close\") over (partition by symbol order by ts) as nx from bars_brand) as _b where nx is not null group by symbol")
def _r03b(spark, d):
    p = _r03(spark, d)
    return p.select("symbol", "ts", F.col("y_score").between(0, 1).cast("int").alias("in_range"))


_W = (0.5, 0.3, 0.2)
_D = (1, 2, 4)


def _conv_sql() -> str:
    c = '"close"'
    convs = ", ".join(
        "(" + " + ".join(f"{G.lit(w)} * " + (c if k == 0 else f"coalesce(lag({c}, {dl * k}) over (partition by symbol order by ts), 0)")
                         for k, w in enumerate(_W)) + f") as conv_d{dl}" for dl in _D)
    pools = ", ".join(f"{G.full('max', f'conv_d{dl}', LOOKBACK)} as conv_d{dl}_max, "
                      f"{G.full('avg', f'conv_d{dl}', LOOKBACK)} as conv_d{dl}_mean" for dl in _D)
    return (f"select symbol, ts, {', '.join(f'conv_d{dl}' for dl in _D)}, {pools} from "
            f"(select symbol, ts, {convs} from bars_brand) as _c")


@query("r04_dilated_conv", "symbol:s, ts:t, " + ", ".join(f"conv_d{dl}:d, conv_d{dl}_max:d, conv_d{dl}_mean:d" for dl in _D),
       _conv_sql())
def _r04(spark, d):
    back = max(_D) * (len(_W) - 1) + LOOKBACK
    return segmented(bars_brand(spark, d), lambda b: R.dilated_conv(b, "close", _W, _D, LOOKBACK), lookback=back)


@query("r05_sweep", "trial:i, params:s, accuracy:d, roc_auc:d, status:s")
def _r05(spark, d):
    s = prepared(spark, d)
    grid = [{"regParam": r, "elasticNetParam": e} for r in (0.0, 0.01, 0.1) for e in (0.0, 0.5)]
    return R.sweep(s.filter(F.col("split") == "train"), s.filter(F.col("split") == "validation"), grid)


@query("r06_pipeline", "model:s, accuracy:d, precision:d, recall:d, f1:d, roc_auc:d")
def _r06(spark, d):
    from barwise.operators import evaluation as M
    from barwise.sources.bars import validate
    bars = bars_brand(spark, d)
    ok = validate(bars).filter(F.col("valid") == 1).select("symbol")
    s = prepared(spark, d).join(ok, "symbol", "left_semi")
    train, test = s.filter(F.col("split") == "train"), s.filter(F.col("split") == "test")
    preds = None
    for name, kind, params in (("logistic", "logistic", {"regParam": 0.01}), ("gbt", "gbt", {"maxIter": 20, "maxDepth": 4})):
        p = R.score(R.fit_direction(train, kind, **params), test, name)
        preds = p if preds is None else preds.unionByName(p)
    preds = preds.withColumn("y_true", F.col("y_true").cast("int"))
    lab = M.threshold_labels(preds)
    return M.classification_metrics(lab).join(M.roc_auc(preds), "model")
