"""Feature selection and reduction.

Scores are one-pass aggregates (correlations, per-class moments, binned counts)
returning one row per feature: the ranking then runs over a table bounded by the
schema, never over the data rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwise.operators.ranking import global_rank


def _long(row: DataFrame, feats: list[str], suffix: str, name: str) -> DataFrame:
    return row.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{f}{suffix}").alias(name))
                                          for f in feats])).alias("r")).select("r.*")


def ranked(scores: DataFrame, k: int | None = None, col: str = "score") -> DataFrame:
    """Rank features by score (desc, ties by name) and keep the top k."""
    w = Window.orderBy(F.col(col).desc_nulls_last(), "feature")   # over features, not rows
    r = scores.withColumn("rank", F.row_number().over(w))
    return r if k is None else r.filter(F.col("rank") <= k)


def corr_scores(df: DataFrame, feats: list[str], target: str) -> DataFrame:
    """|Pearson correlation| with the target."""
    row = df.agg(*[F.abs(F.corr(f, target)).alias(f"{f}__s") for f in feats])
    return _long(row, feats, "__s", "score")


def f_classif(df: DataFrame, feats: list[str], target: str) -> DataFrame:
    """One-way ANOVA F from per-class counts, means and population variances."""
    per = df.groupBy(target).agg(F.count(F.lit(1)).alias("_n"),
                                 *[F.avg(f).alias(f"{f}__m") for f in feats],
                                 *[F.var_pop(f).alias(f"{f}__v") for f in feats])
    long = per.select(target, "_n", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"),
                                                                 F.col(f"{f}__m").alias("m"), F.col(f"{f}__v").alias("v"))
                                                        for f in feats])).alias("r")).select(target, "_n", "r.*")
    w = Window.partitionBy("feature")
    n_all = F.sum("_n").over(w)
    gm = F.sum(F.col("_n") * F.col("m")).over(w) / n_all
    long = long.withColumns({"_ntot": n_all, "_gm": gm, "_k": F.count(F.lit(1)).over(w)})
    a = long.groupBy("feature").agg(F.sum(F.col("_n") * F.pow(F.col("m") - F.col("_gm"), 2)).alias("ssb"),
                                    F.sum(F.col("_n") * F.col("v")).alias("ssw"), F.first("_ntot").alias("N"),
                                    F.first("_k").alias("k"))
    f = F.try_divide(F.col("ssb") / (F.col("k") - 1), F.col("ssw") / (F.col("N") - F.col("k")))
    return a.select("feature", f.alias("score"))


def f_regression(df: DataFrame, feats: list[str], target: str) -> DataFrame:
    """r^2 / (1 - r^2) * (n - 2)."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.corr(f, target).alias(f"{f}__r") for f in feats])
    long = row.select("_n", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{f}__r").alias("r"))
                                                for f in feats])).alias("x")).select("_n", "x.*")
    r2 = F.col("r") * F.col("r")
    return long.select("feature", (F.try_divide(r2, 1 - r2) * (F.col("_n") - 2)).alias("score"))


def _ntile_bins(long: DataFrame, value: str, order_tail: list[str], bins: int, group: str = "feature") -> DataFrame:
    """Equal-count bins (``ntile`` semantics) from the bucketed global rank."""
    r = global_rank(long, [group], [value, *order_tail])
    n, rk = F.col("n"), F.col("rank")
    q = F.floor(n / bins)
    rem = n - q * bins
    big = rem * (q + 1)
    b = F.when(rk <= big, F.ceil(rk / (q + 1))).otherwise(rem + F.ceil((rk - big) / q))
    return r.withColumn("bin", b.cast("int")).drop("rank", "n")


def mutual_info(df: DataFrame, feats: list[str], target: str, bins: int = 10, key=("symbol", "ts"),
                bin_target: bool = False) -> DataFrame:
    """Mutual information of binned features (10 equal-count bins, ties by key)
    with the class target, or with the binned target (natural log)."""
    key = list(key)
    items = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in feats]
    if bin_target:
        # the target is binned in the same pass, as one more "feature" (a data-driven group
        # key, so the bucket-bound join stays an equi-join)
        items.append(F.struct(F.lit("_target").alias("feature"), F.col(target).cast("double").alias("value")))
    long = df.select(*key, F.col(target).alias("_y"), F.explode(F.array(*items)).alias("kv")) \
        .select(*key, "_y", "kv.*")
    long = _ntile_bins(long, "value", key, bins)
    if bin_target:
        yb = long.filter(F.col("feature") == "_target").select(*key, F.col("bin").alias("_yb"))
        long = long.filter(F.col("feature") != "_target").join(yb, key).drop("_y").withColumnRenamed("_yb", "_y")
    joint = long.groupBy("feature", "bin", "_y").agg(F.count(F.lit(1)).alias("nxy"))
    w = Window.partitionBy("feature")
    joint = joint.withColumns({"n": F.sum("nxy").over(w),
                               "nx": F.sum("nxy").over(Window.partitionBy("feature", "bin")),
                               "ny": F.sum("nxy").over(Window.partitionBy("feature", "_y"))})
    term = (F.col("nxy") / F.col("n")) * F.log(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))
    return joint.groupBy("feature").agg(F.sum(term).alias("score"))


def variance_scores(df: DataFrame, feats: list[str]) -> DataFrame:
    """Sample variance."""
    row = df.agg(*[F.var_samp(f).alias(f"{f}__s") for f in feats])
    return _long(row, feats, "__s", "score")


def pca(df: DataFrame, feats: list[str], k: int | None = None, var_target: float = 0.95):
    """PCA on centred features (MLlib); k fixed or the smallest k reaching 95 % variance.

    Returns (explained table, projected DataFrame).  Signs are fixed so that the largest
    absolute loading of each component is positive.
    """
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    means = df.agg(*[F.avg(f).alias(f) for f in feats]).first()
    cen = df.withColumns({f: F.col(f) - F.lit(means[f]) for f in feats})
    va = VectorAssembler(inputCols=feats, outputCol="_x")
    vec = va.transform(cen)
    full = PCA(k=len(feats), inputCol="_x", outputCol="_p").fit(vec)
    ev = [float(x) for x in full.explainedVariance]
    if k is None:
        acc, k = 0.0, len(feats)
        for i, e in enumerate(ev):
            acc += e
            if acc >= var_target:
                k = i + 1
                break
    pc = full.pc.toArray()
    signs = [1.0 if pc[abs(pc[:, j]).argmax(), j] >= 0 else -1.0 for j in range(pc.shape[1])]
    proj = full.transform(vec).withColumn("_a", vector_to_array("_p"))
    proj = proj.select("symbol", "ts", *[(F.col("_a")[j] * signs[j]).alias(f"pc_{j + 1}") for j in range(k)])
    spark = df.sparkSession
    cum = 0.0
    rows = []
    for i, e in enumerate(ev):
        cum += e
        rows.append((i + 1, e, cum, int(i < k)))
    table = spark.createDataFrame(rows, "component int, explained_variance double, cumulative double, kept int")
    return table, proj
