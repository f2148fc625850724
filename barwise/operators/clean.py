"""Cleaning (J01-J11): fit statistics in one aggregate pass, apply as projections.

Profiles (null share, constants, quantiles, max abs) are aggregates whose result is
one row per feature: bounded by the schema, so they may come back to the driver and
be applied as literals.  ``fit_where`` restricts the fit to training rows (the
reference fits on all rows; ``fit_where=None`` reproduces that).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwise.operators.ranking import exact_quantiles
from barwise.operators.segments import carried

INF = float("inf")


def numeric_cols(df: DataFrame, exclude=("symbol", "ts")) -> list[str]:
    from pyspark.sql.types import NumericType
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]


def _fit_rows(df: DataFrame, fit_where: Column | None) -> DataFrame:
    return df if fit_where is None else df.filter(fit_where)


def inf_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """+-inf and NaN -> null."""
    cols = cols or numeric_cols(df)
    return df.withColumns({c: F.when(F.isnan(c) | (F.abs(c) == INF), None).otherwise(F.col(c)) for c in cols})


def profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One pass: per feature null share, non-null min/max, max |x| (long, one row per feature)."""
    cols = cols or numeric_cols(df)
    aggs = []
    for c in cols:
        x = F.col(c)
        aggs += [F.avg(x.isNull().cast("double")).alias(f"{c}__null"), F.min(x).alias(f"{c}__min"),
                 F.max(x).alias(f"{c}__max"), F.max(F.abs(x)).alias(f"{c}__absmax")]
    row = df.agg(*aggs)
    return row.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("feature"), F.col(f"{c}__null").alias("null_ratio"),
        F.col(f"{c}__min").cast("double").alias("min"), F.col(f"{c}__max").cast("double").alias("max"),
        F.col(f"{c}__absmax").cast("double").alias("max_abs")) for c in cols])).alias("p")).select("p.*")


def null_ratio_report(df: DataFrame, cols=None, threshold: float = 0.5) -> DataFrame:
    """Columns with more than 50 % nulls are dropped."""
    return profile(df, cols).select("feature", "null_ratio",
                                    (F.col("null_ratio") > threshold).cast("int").alias("dropped"))


def constant_report(df: DataFrame, cols=None) -> DataFrame:
    """At most one distinct non-null value (min = max, or all null)."""
    p = profile(df, cols)
    return p.select("feature", F.coalesce(F.col("min") == F.col("max"), F.lit(True)).cast("int").alias("constant"))


def prune(df: DataFrame, cols=None, threshold: float = 0.5) -> DataFrame:
    """J02 + J03 applied: drop the reported columns (report is one row per feature)."""
    rep = profile(df, cols).collect()
    drop = [r["feature"] for r in rep if (r["null_ratio"] > threshold) or r["min"] is None or r["min"] == r["max"]]
    return df.drop(*drop)


def _nan_to_null(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def clip_bounds(df: DataFrame, cols: list[str], fit_where: Column | None = None, k: float = 3.0) -> DataFrame:
    """J04 fit: lower = max(q1 - 3 IQR, p0.1), upper = min(q3 + 3 IQR, p99.9) per feature.

    NaN counts as missing.  A side that is no number gives way to the other one of its pair; a
    bound that is not finite then is the column's least or greatest value.  A quantile that falls
    on a value is that value, also beside an infinite one (where pandas gives NaN).
    """
    rows = _fit_rows(df, fit_where).select(*[_nan_to_null(c).alias(c) for c in cols])
    q = exact_quantiles(rows, cols, [0.001, 0.25, 0.75, 0.999])
    w = q.groupBy("feature").agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n)
                                   for p, n in ((0.001, "p001"), (0.25, "q1"), (0.75, "q3"), (0.999, "p999"))])
    w = w.join(profile(rows, cols).select("feature", "min", "max"), "feature")
    iqr = F.col("q3") - F.col("q1")

    def bound(pick, side: Column, backup: Column, extreme: Column) -> Column:
        both = F.when(F.isnan(side), backup).when(F.isnan(backup), side).otherwise(pick(side, backup))
        return F.when(F.isnan(both) | (F.abs(both) == INF), extreme).otherwise(both)

    return w.select("feature",
                    bound(F.greatest, F.col("q1") - k * iqr, F.col("p001"), F.col("min")).alias("lower"),
                    bound(F.least, F.col("q3") + k * iqr, F.col("p999"), F.col("max")).alias("upper"))


def clip(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """J04 apply: values go to the bounds, which are one row per feature (literals); infinite
    ones too, while null and NaN stay."""
    b = {r["feature"]: (r["lower"], r["upper"]) for r in bounds.collect()}
    cols = {}
    for c, (lo, hi) in b.items():
        x = F.col(c)
        cols[c] = F.when(x.isNull() | F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))
    return df.withColumns(cols)


def clip_counts(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """J04 report: number of values below / above the bounds per feature."""
    b = {r["feature"]: (r["lower"], r["upper"]) for r in bounds.collect()}
    aggs = []
    for c, (lo, hi) in b.items():
        aggs += [F.count_if(F.col(c) < lo).alias(f"{c}__lo"),
                 F.count_if((F.col(c) > hi) & ~F.isnan(c)).alias(f"{c}__hi")]
    row = df.agg(*aggs)
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(lo).alias("lower"),
                                                   F.lit(hi).alias("upper"), F.col(f"{c}__lo").alias("n_low"),
                                                   F.col(f"{c}__hi").alias("n_high"))
                                          for c, (lo, hi) in b.items()])).alias("r")).select("r.*")


def ffill(df: DataFrame, cols: list[str]) -> DataFrame:
    """Last non-null value so far, per symbol in time order."""
    return carried(df, cols)


def bfill(df: DataFrame, cols: list[str]) -> DataFrame:
    """Next non-null value (uses the future; the reference applies it before the split)."""
    return carried(df, cols, backward=True)


def median_fill(df: DataFrame, cols: list[str], fit_where: Column | None = None) -> DataFrame:
    """Remaining nulls -> fitted median, then 0 (a column with no value at all)."""
    med = {r["feature"]: r["value"] for r in exact_quantiles(_fit_rows(df, fit_where), cols, [0.5]).collect()}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(med.get(c)).cast("double"), F.lit(0.0)) for c in cols})


def rescale_large(df: DataFrame, cols: list[str], limit: float = 1e10, target: float = 1e6) -> DataFrame:
    """A column whose max |x| exceeds 1e10 is divided by max/1e6."""
    row = df.agg(*[F.max(F.abs(c)).alias(c) for c in cols]).first()
    out = {}
    for c in cols:
        m = row[c]
        if m is not None and m > limit:
            out[c] = F.col(c) / F.lit(m / target)
    return df.withColumns(out) if out else df


def complete_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """J09."""
    return df.dropna(subset=cols)


def row_masks(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """J10 report: rows with an infinite feature, a null feature, a null target; rows kept."""
    inf_any = F.lit(False)
    null_any = F.lit(False)
    for c in features:
        inf_any = inf_any | F.coalesce(F.abs(c) == INF, F.lit(False))
        null_any = null_any | F.col(c).isNull() | F.isnan(c)
    nt = F.col(target).isNull()
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(inf_any).alias("n_infinite"),
                  F.count_if(null_any).alias("n_null_feature"), F.count_if(nt).alias("n_null_target"),
                  F.count_if(~inf_any & ~null_any & ~nt).alias("n_kept"))


def apply_masks(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """J10 apply: drop masked rows (an empty result is an error for the caller)."""
    keep = F.col(target).isNotNull()
    for c in features:
        keep = keep & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != INF)
    return df.filter(keep)


def input_guard(df: DataFrame, cols: list[str]) -> DataFrame:
    """One-row check; ``ok`` = non-empty and no NaN / inf.  ``assert_ok`` raises."""
    bad_nan = F.lit(False)
    bad_inf = F.lit(False)
    for c in cols:
        bad_nan = bad_nan | F.isnan(c) | F.col(c).isNull()
        bad_inf = bad_inf | F.coalesce(F.abs(c) == INF, F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad_nan).alias("n_nan"),
                  F.count_if(bad_inf).alias("n_inf")).withColumn(
        "ok", ((F.col("n_rows") > 0) & (F.col("n_nan") == 0) & (F.col("n_inf") == 0)).cast("int"))


def assert_ok(report: DataFrame) -> DataFrame:
    """Fail the job (on the executors) when the guard is not ok."""
    return report.withColumn("ok", F.when(F.col("ok") == 1, F.col("ok")).otherwise(
        F.raise_error(F.lit("input guard failed: empty input, NaN or inf"))))
