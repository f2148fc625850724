"""Symbol dimension (FIXTURES §3) and its lookups.

The reference's lookups are dictionary scans; here they are joins.  The dimension
is a table that grows with the symbol universe, so joins are plain equi-joins
and AQE turns them into broadcast joins only when the measured side is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwise.functions.core import text_hash

from barwise.sources.bars import table


def dim_symbols(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    suffix = (F.when(F.col("c_nationkey") % 5 == 0, F.lit(".NS"))
              .when(F.col("c_nationkey") % 5 == 1, F.lit(".BO")).otherwise(F.lit("")))
    return c.select(k.cast("string").alias("symbol"), F.col("c_name").alias("name"),
                    F.col("c_mktsegment").alias("category"),
                    (k % 7 == 0).alias("popular"), (k % 11 == 0).alias("volatile"),
                    (k % 5 == 0).alias("stable"),
                    F.concat(k.cast("string"), suffix).alias("market_symbol"))


def enrich(df: DataFrame, dim: DataFrame, default_name: str = "Unknown",
           default_category: str = "Unknown") -> DataFrame:
    """Left join names/categories; unknown symbols get default text."""
    j = df.join(dim.select("symbol", "name", "category"), "symbol", "left")
    return j.withColumn("name", F.coalesce("name", F.lit(default_name))) \
            .withColumn("category", F.coalesce("category", F.lit(default_category)))


def flatten_dim(nested: DataFrame, map_col: str = "members") -> DataFrame:
    """Category -> map(symbol -> name) into rows (category, symbol, name)."""
    return nested.select("category", F.explode(F.col(map_col)).alias("symbol", "name"))


def search(dim: DataFrame, q: str) -> DataFrame:
    """Case-insensitive substring of symbol or name."""
    ql = q.lower()
    return dim.filter(F.lower("symbol").contains(ql) | F.lower("name").contains(ql))


#: Characters of the longest grams of the substring index.
GRAM = 8


def _grams(text, n: int):
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))),
                       lambda i: F.substring(text, i, F.lit(n)))


def substring_hits(queries: DataFrame, dim: DataFrame, q_col: str = "q", gram: int = GRAM) -> DataFrame:
    """Distinct queries that are a case-insensitive substring of some symbol or name.

    No query meets the strings one by one.  A query of up to ``gram`` characters hits if it is one of
    the distinct grams of the dimension's strings.  For a longer one, the place of its rarest gram says
    which piece of a string that holds this gram must equal it; a piece is cut once for all queries of
    the same gram, place and length.  The empty query hits if there is any string.
    """
    asked = queries.select(F.col(q_col), F.lower(F.col(q_col)).alias("_q")).filter(F.col("_q").isNotNull()).distinct()
    texts = dim.select(F.explode(F.array(F.lower("symbol"), F.lower("name"))).alias("_t")).filter(
        F.col("_t").isNotNull()).distinct()
    # both sides grow with the dimension: merge joins, nothing of them through the driver
    known = texts.select(F.explode(F.concat(F.array(F.lit("")), *[
        _grams(F.col("_t"), n) for n in range(1, gram + 1)])).alias("_q")).distinct()
    short = asked.filter(F.length("_q") <= gram).join(known.hint("merge"), "_q", "left_semi").select(q_col)
    index = texts.filter(F.length("_t") > gram).select("_t", F.posexplode(_grams(F.col("_t"), gram)).alias("_at", "_g"))
    counts = index.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    grams = asked.filter(F.length("_q") > gram).select(q_col, "_q", F.posexplode(_grams(F.col("_q"), gram)).alias("_from", "_g"))
    rare = (grams.join(counts.hint("merge"), "_g", "left").groupBy(q_col, "_q")
            .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_g").alias("g"), F.col("_from").alias("at"))).alias("_r"))
            .filter(F.col("_r.n") > 0).select(q_col, "_q", F.col("_r.g").alias("_g"), F.col("_r.at").alias("_from")))
    places = rare.select("_g", "_from", F.length("_q").alias("_len")).distinct()
    pieces = (index.join(places.hint("merge"), "_g").filter(F.col("_at") >= F.col("_from"))
              .select(F.substring("_t", F.col("_at") - F.col("_from") + 1, F.col("_len")).alias("_q")).distinct())
    long_ = rare.join(pieces.hint("merge"), "_q", "left_semi").select(q_col)
    return short.unionAll(long_).distinct()


def expand_candidates(queries: DataFrame, dim: DataFrame, q_col: str = "q") -> DataFrame:
    """For queries with no search hit, candidate market symbols.

    Alphabetic/numeric base query -> base + '.NS', base + '.BO'; suffixed query -> its base.
    Keeps candidates that exist in the dimension's market symbols.
    """
    hits = substring_hits(queries, dim, q_col)
    empty = queries.join(hits.hint("merge"), q_col, "left_anti")
    up = F.upper(F.col(q_col))
    suffixed = up.endswith(".NS") | up.endswith(".BO")
    base = F.regexp_replace(up, r"\.(NS|BO)$", "")
    cand = empty.select(q_col, F.explode(
        F.when(suffixed, F.array(base)).otherwise(F.array(F.concat(up, F.lit(".NS")),
                                                           F.concat(up, F.lit(".BO")))))
        .alias("candidate"))
    known = dim.select(F.upper("market_symbol").alias("candidate")).union(
        dim.select(F.upper("symbol").alias("candidate"))).distinct()
    return cand.join(known.hint("merge"), "candidate", "left_semi").distinct()


def by_category(dim: DataFrame, category: str) -> DataFrame:
    """B05."""
    return dim.filter(F.col("category") == category)


def sample_symbols(dim: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """N symbols without replacement, deterministic (hash order); n capped at size.

    ``orderBy + limit`` is a top-k: each partition keeps its n best, the driver merges.
    """
    return dim.orderBy(text_hash("symbol", F.lit(str(seed))), "symbol").limit(n)


def tag(dim: DataFrame, tags: dict[str, DataFrame]) -> DataFrame:
    """Tag membership through semi joins; returns (symbol, tag)."""
    out = None
    for t, members in tags.items():
        part = dim.select("symbol").join(members.select("symbol"), "symbol", "left_semi") \
                  .withColumn("tag", F.lit(t))
        out = part if out is None else out.unionByName(part)
    return out


def category_counts(dim: DataFrame) -> DataFrame:
    """Symbols per category."""
    return dim.groupBy("category").agg(F.count(F.lit(1)).alias("n_symbols"))


def peers(dim: DataFrame, symbols: DataFrame, n: int = 5) -> DataFrame:
    """Up to n other symbols of the same category (self join on category).

    The partner list is a top-n per requested symbol; a hot category is not expanded
    into all pairs: candidates are ranked by symbol inside the category first
    (``row_number`` over the category, bounded to n+1), then joined.
    """
    ranked = dim.select("category", F.col("symbol").alias("peer")).withColumn(
        "_r", F.row_number().over(Window.partitionBy("category").orderBy("peer"))).filter(
        F.col("_r") <= n + 1)
    req = symbols.join(dim.select("symbol", "category"), "symbol")
    j = req.join(ranked, "category").filter(F.col("peer") != F.col("symbol"))
    w = Window.partitionBy("symbol").orderBy("peer")
    return j.withColumn("peer_rank", F.row_number().over(w)).filter(F.col("peer_rank") <= n) \
            .select("symbol", "category", "peer", "peer_rank")


def listing(dim: DataFrame, n: int) -> DataFrame:
    """First n symbols of each category in sorted order."""
    w = Window.partitionBy("category").orderBy("symbol")
    return dim.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= n)


def currency(symbol) -> "F.Column":
    """INR for .NS/.BO market suffixes, else USD."""
    s = F.upper(F.col(symbol) if isinstance(symbol, str) else symbol)
    return F.when(s.endswith(".NS") | s.endswith(".BO"), F.lit("INR")).otherwise(F.lit("USD"))


def coverage(selected: DataFrame, present: DataFrame, warn_ratio: float = 0.8,
             floor: int = 10) -> DataFrame:
    """Selected feature names minus present ones; coverage ratio, warning, floor."""
    sel = selected.select("feature").distinct()
    pres = present.select("feature").distinct().withColumn("_present", F.lit(1))
    counts = sel.join(pres, "feature", "left").agg(
        F.count(F.lit(1)).alias("n_selected"),
        F.count_if(F.col("_present").isNull()).alias("n_missing"))
    return counts.select(
        "n_selected", "n_missing",
        (F.col("n_selected") - F.col("n_missing")).alias("n_available"),
        F.try_divide(F.col("n_selected") - F.col("n_missing"), F.col("n_selected")).alias("coverage"),
    ).withColumn("warn", (F.col("coverage") < warn_ratio).cast("int")) \
     .withColumn("usable", (F.col("n_available") >= floor).cast("int"))


def align(a: DataFrame, b: DataFrame, keys=("symbol", "ts")) -> DataFrame:
    """Inner equi-join of two frames on the row key."""
    return a.join(b, list(keys), "inner")
