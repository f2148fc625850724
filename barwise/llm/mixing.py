"""Operator 9: mixing sources to target weights by hash-threshold histograms.

A source that must give ``target`` of its ``size`` words gives every document
``floor(target / size)`` times, and those with a hash under the source's threshold once
more.  The threshold comes from nested histograms: words by (source, hash bucket), a running
sum over the buckets, and then only the bucket in which the budget runs out is cut again.
No document is ever sorted; a histogram has ``2 ** LEVEL_BITS`` buckets a source at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwise.llm.common import aliased, prepare, row_key, table, written

LEVEL_BITS = 12
LEVELS = 5
HASH_BITS = LEVEL_BITS * LEVELS
#: A source is repeated this often at most.
MOST = 3
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def row_hash(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Hash that decides about a row; equal (doc_id, text) have equal hashes."""
    return F.shiftrightunsigned(row_key(doc_id, text), 64 - HASH_BITS)


def targets(spark: SparkSession, sizes: DataFrame, weights=(1, 2, 3), most: int = MOST) -> DataFrame:
    """``sizes (source, size)``, a row a source, with ``target``: the total shared by weight.

    Weights repeat over the sources in code point order, null last.  A target stops at
    ``most`` times its source's size; the rest is shared again by weight among the others
    until none is above.  Sources of size 0 get 0.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    table_ = written(spark, sizes.withColumn("weight", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))), "weights")
    total = table_.agg(F.sum("size")).first()[0] or 0
    level, capped_before = 0.0, -1
    while True:
        capped = F.lit(False) if capped_before < 0 else F.col("weight") * level >= F.col("size") * most
        n, held, open_weight = table_.agg(
            F.count(F.when(capped, 1)), F.coalesce(F.sum(F.when(capped, F.col("size") * most)), F.lit(0)),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0))).first()
        if n == capped_before or not open_weight:
            break
        capped_before, level = n, (total - held) / open_weight
    share = F.least(F.col("weight") * level, (F.col("size") * most).cast("double"))
    return table_.select("source", "size", share.alias("target"))


def thresholds(spark: SparkSession, slim: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per source of ``wanted (source, size, target)``: ``whole``, the times every document is
    taken, and ``below``, the hash under which it is taken once more.

    ``slim (source, size, hash)`` has a row a document.  The bucket left at the end holds
    rows of equal hash prefix: it is taken if that comes nearer to the target.  Where it has several rows,
    ``take`` of those with hashes from ``edge`` to before ``edge_end`` come nearer still.
    """
    ratio = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0)
    whole = F.floor(ratio)
    state = written(spark, wanted.select("source", whole.alias("whole"),
                                         F.greatest(F.col("target") - whole * F.col("size"), F.lit(0.0)).alias("budget"),
                                         F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("words"),
                                         F.lit(0).cast("long").alias("rows")),
                    "thresholds")
    for level in range(LEVELS):
        left = HASH_BITS - LEVEL_BITS * level            # bits not yet decided
        inside = slim.join(state.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).filter(
            (F.col("budget") > 0) & (F.shiftrightunsigned("hash", left) == F.col("prefix")))
        bucket = F.shiftrightunsigned("hash", left - LEVEL_BITS).alias("bucket")
        sums = inside.groupBy("source", bucket).agg(
            F.sum("size").alias("n"), F.count(F.when(F.col("size") > 0, 1)).alias("rows"), F.first("budget").alias("budget"),
            F.min("hash").alias("lo"), F.max("hash").alias("hi"))
        running = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("n").over(running))
        # the first bucket in which the budget runs out; the last one if it never does
        edge = sums.groupBy("source").agg(
            F.min(F.when(F.col("upto") > F.col("budget"),
                         F.struct("bucket", "upto", "n", "rows", (F.col("lo") != F.col("hi")).alias("mixed")))).alias("e"))
        moved = state.join(edge.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
        state = written(spark, moved.select(
            "source", "whole",
            F.when(F.col("e").isNull(), F.col("budget")).otherwise(
                F.col("budget") - (F.col("e.upto") - F.col("e.n"))).alias("budget"),
            # no edge: the whole rest fits, so the threshold is the end of the prefix
            F.when(F.col("budget") <= 0, F.shiftleft("prefix", LEVEL_BITS)).when(
                F.col("e").isNull(), F.shiftleft(F.col("prefix") + 1, LEVEL_BITS)).otherwise(
                F.col("e.bucket")).alias("prefix"),
            F.when(F.col("budget") <= 0, F.lit(0)).when(F.col("e").isNull(), F.lit(0)).otherwise(
                F.col("e.n")).alias("words"),
            F.when((F.col("budget") <= 0) | F.col("e").isNull(), F.lit(0)).otherwise(F.col("e.rows")).alias("rows"),
            F.coalesce(F.col("e.mixed"), F.lit(False)).alias("mixed"),
            # decided: nothing left to refine
            F.when(F.col("e").isNull(), F.lit(0.0)).otherwise(F.lit(1.0)).alias("open")).withColumn(
                "budget", F.col("budget") * F.col("open")).drop("open"), "thresholds")
        if not state.filter("mixed").take(1):
            break
    bits = HASH_BITS - LEVEL_BITS * (level + 1)
    several = F.col("rows") > 1
    nearer = (F.col("words") > 0) & (F.col("budget") * 2 >= F.col("words"))
    below = F.shiftleft(F.col("prefix") + nearer.cast("long"), bits)
    edge = F.when(several, F.shiftleft("prefix", bits))
    take = F.when(several, F.floor(F.col("budget") * F.col("rows") / F.col("words") + 0.5)).otherwise(0)
    return state.select("source", "whole", below.alias("below"), edge.alias("edge"),
                        (edge + F.lit(1 << bits)).alias("edge_end"), take.alias("take"))


def _counted(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Rows of one hash a source, of which the first ``take`` are taken once more.  They are written, so
    that their places are the same whenever they are read, and counted by written part: a group of any size is
    many short lists."""
    rows = written(spark, rows.withColumns({"_part": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()}), "edge-rows")
    parts = rows.filter("_size > 0").groupBy("_source", "_part").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.select(F.col("_source").alias("_s"), F.col("_part").alias("_p"), (F.sum("_n").over(upto) - F.col("_n")).alias("_before"))
    here = Window.partitionBy("_source", "_part").orderBy(F.col("_size") == 0, "_seq")
    rows = rows.withColumn("_nth", F.row_number().over(here))
    rows = rows.join(parts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")), "left")
    more = (F.col("_size") > 0) & (F.col("_nth") + F.col("_before") <= F.col("take"))
    return rows.withColumn("_more", F.coalesce(more, F.lit(False)))


def _planned(spark: SparkSession, docs: DataFrame, weights, most: int) -> tuple[DataFrame, list[Column]]:
    """The rows of ``docs`` under other column names with what ``mix`` adds, and the columns back."""
    flat, at, back = aliased(docs)
    size, hash_ = word_count(F.col(at["text"])), row_hash(at["doc_id"], at["text"])
    source = F.col(at["source"]).cast("string")
    slim = written(spark, flat.select(source.alias("source"), size.alias("size"), hash_.alias("hash")), "sizes")
    wanted = written(spark, targets(spark, slim.groupBy("source").agg(F.sum("size").alias("size")), weights, most),
                     "targets")
    cut = thresholds(spark, slim, wanted)
    plan = wanted.join(cut.withColumnRenamed("source", "_c"), F.col("source").eqNullSafe(F.col("_c"))).select(
        F.col("source").alias("_source"), F.col("size").alias("_source_size"), F.col("target").alias("_target"),
        "whole", "below", "edge", "edge_end", "take")
    # a row a source: sent to every task while that is small (counted), else both sides meet
    plan = F.broadcast(plan) if wanted.count() <= BROADCAST_SOURCES else plan
    out = flat.withColumns({"_size": size, "_hash": hash_}).join(plan, source.eqNullSafe(F.col("_source")))
    out = out.withColumn("_more", F.col("_hash") < F.col("below"))
    if cut.filter("edge is not null").take(1):
        # equal rows at the threshold are few or many: they are told apart by their number
        edge = F.coalesce((F.col("_hash") >= F.col("edge")) & (F.col("_hash") < F.col("edge_end")), F.lit(False))
        out = out.filter(~edge).unionByName(_counted(spark, out.filter(edge)).select(*out.columns))
    times = F.least(F.col("whole") + F.col("_more").cast("long"), F.lit(most))
    return out.withColumn("_times", times.cast("int")), back


def mix(spark: SparkSession, docs: DataFrame, weights=(1, 2, 3), most: int = MOST) -> DataFrame:
    """Every row of ``docs`` (its columns first, whatever their names) with ``_size``,
    ``_source_size``, ``_target`` and ``_times``, how often the mix takes it (0 to ``most``).

    A null text has size 0; null sources are one source; rows of size 0 are taken like any
    other under the threshold; rows of equal doc_id and text are decided alike, but for those at the threshold,
    of which as many are taken as come nearest to the target.
    Only (source, size, hash) is shuffled; the documents themselves are read twice and stay
    where they are (but for more than ``BROADCAST_SOURCES`` sources).
    """
    out, back = _planned(spark, docs, weights, most)
    return out.select(*back, "_size", "_source_size", "_target", "_times")


def mixed(spark: SparkSession, docs: DataFrame, weights=(1, 2, 3), most: int = MOST) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    out, back = _planned(spark, docs, weights, most)
    return out.filter("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*back)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each of the ``documents``, in words; odd rows as in ``mix``."""
    prepare(spark)
    found = mix(spark, table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_size").alias("size"),
                        F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
                        (F.col("_size") * F.col("_times")).alias("taken"))
