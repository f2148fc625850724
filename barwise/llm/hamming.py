"""Operator 1: exact top-k search over binary codes by incremental multi-index hashing.

A 64-bit code is cut into ``SEGMENTS`` segments.  A code within distance ``d`` of a query
agrees with it in some segment up to ``floor(d / SEGMENTS)`` bits.  So the search grows the
segment radius r = 0, 1, ...: after radius r in all segments, every code within
``SEGMENTS * (r + 1) - 1`` has been seen, and a query ends once its kth verified distance is
that or less.

Segment tables are dealt out by segment and its leading bits into blocks of bounded size; a
query is sent only to blocks that its radius reaches, and looks the remaining bits up there.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwise.llm.common import prepare, table, written

BITS = 64
SEGMENTS = 4
WIDTH = BITS // SEGMENTS
K = 10
#: Codes in a block of a segment table, about; a larger block is split by code hash.
BLOCK_CODES = 8_192


def binary_codes(vectors: DataFrame) -> DataFrame:
    """``(vec_id, code)``: the signs of 64 components, or of 64 fixed random projections of a
    vector of another length.  Rows without a vector or id have no code; NaN counts as 0."""
    schema = pa.schema([("vec_id", pa.int64()), ("code", pa.int64())])

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            ids, codes = [], []
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("embedding")):
                x = np.array([np.nan if y is None else y for y in v.as_py()], np.float64)
                if len(x) != BITS:
                    if len(x) not in planes:
                        planes[len(x)] = np.random.default_rng(len(x)).standard_normal((len(x), BITS))
                    x = np.nan_to_num(x) @ planes[len(x)]
                ids.append(i)
                codes.append(int.from_bytes(np.packbits(x > 0).tobytes(), "big", signed=True))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(codes, pa.int64())], schema=schema)

    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
            .filter("vec_id is not null and embedding is not null and size(embedding) > 0")
            .mapInArrow(run, "vec_id long, code long"))


def _segment(seg):
    return F.shiftrightunsigned("code", 0) if seg is None else F.shiftrightunsigned(
        "code", BITS - WIDTH * (seg + 1)).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("long"))


def _balls(bits: int) -> list[np.ndarray]:
    """Masks of ``bits`` bits by the number of set ones."""
    masks = np.arange(1 << bits, dtype=np.int64)
    ones = np.bitwise_count(masks)
    return [masks[ones == j] for j in range(bits + 1)]


def _probe(radius: int, low_bits: int, k: int):
    """Search of one block: the queries that reach it at ``radius`` against its codes."""
    balls = _balls(low_bits)

    def run(queries: pd.DataFrame, codes: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"qid": pd.Series(dtype="int64"), "code": pd.Series(dtype="int64"),
                             "least": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64"),
                             "distance": pd.Series(dtype="int64")})
        if not len(queries) or not len(codes):
            return none
        shift = BITS - WIDTH * (int(queries["seg"].iloc[0]) + 1)
        low_mask = np.uint64((1 << low_bits) - 1)

        def low(c):
            return ((c.to_numpy(np.int64).view(np.uint64) >> np.uint64(shift)) & low_mask).astype(np.int64)

        codes = codes.iloc[np.argsort(low(codes["code"]), kind="stable")]
        values = codes["code"].to_numpy(np.int64).view(np.uint64)
        starts = np.searchsorted(low(codes["code"]), np.arange((1 << low_bits) + 1))
        least, count = codes["least"].to_numpy(np.int64), codes["n"].to_numpy(np.int64)
        out = []
        for hi, group in queries.groupby("flips", sort=True):
            rest = radius - int(hi)
            if rest < 0 or rest > low_bits:
                continue
            masks = balls[rest]
            step = max(1, (1 << 20) // len(masks))
            for at in range(0, len(group), step):
                q = group.iloc[at:at + step]
                cells = (low(q["code"])[:, None] ^ masks[None, :]).ravel()
                n = starts[cells + 1] - starts[cells]
                row = np.repeat(np.repeat(np.arange(len(q)), len(masks)), n)
                pos = np.repeat(starts[cells] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                d = np.bitwise_count(values[pos] ^ q["code"].to_numpy(np.int64).view(np.uint64)[row]).astype(np.int64)
                ok = d <= q["bound"].to_numpy(np.int64)[row]
                row, pos, d = row[ok], pos[ok], d[ok]
                order = np.lexsort((least[pos], d, row))
                row, pos, d = row[order], pos[order], d[order]
                nth = np.arange(len(row)) - np.searchsorted(row, row)
                top = nth <= k
                out.append(pd.DataFrame({"qid": q["qid"].to_numpy()[row[top]], "code": values[pos[top]].view(np.int64),
                                         "least": least[pos[top]], "n": count[pos[top]], "distance": d[top]}))
        return pd.concat(out) if out else none

    return run


def search(spark: SparkSession, index: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``(query_id, rank, vec_id, distance)``: for each of ``queries (vec_id, code)`` the k
    nearest rows of ``index (vec_id, code)`` other than itself, ties by vec_id.  Queries of
    equal code are searched once, with one neighbour more, and told apart at the end.

    Exact.  Repeated (vec_id, code) count once.  With fewer than k others all are returned; an
    empty side gives nothing.  Equal codes are one entry of the segment tables, with their
    number and least id; of a code's ids the k + 1 least are enough.
    """
    ids = written(spark, index.select("vec_id", "code").distinct().withColumn(
        "nth", F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))).filter(F.col("nth") <= k + 1), "ids")
    codes = written(spark, ids.groupBy("code").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")), "codes")
    total, held = codes.agg(F.count("*"), F.sum("n")).first()
    # leading bits that deal a segment table out
    high = min(12, max(0, math.ceil(math.log2(max(1, total / BLOCK_CODES)))))
    low = WIDTH - high
    segs = F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), F.shiftrightunsigned(_segment(s), low).alias("hi"))
                               for s in range(SEGMENTS)])).alias("s")
    placed = codes.select("code", "least", "n", segs).select("code", "least", "n", "s.seg", "s.hi")
    # large blocks are split by code hash, and their queries sent to every part
    parts = written(spark, placed.groupBy("seg", "hi").agg(F.ceil(F.count("*") / (4 * BLOCK_CODES)).cast("int").alias("parts")),
                    "blocks")
    table_ = written(spark, placed.join(parts, ["seg", "hi"]).select(
        "seg", "hi", F.pmod(F.xxhash64("code"), F.col("parts")).cast("int").alias("part"), "code", "least", "n"), "segments")
    wanted = written(spark, queries.select(F.col("vec_id").alias("query_id"), F.col("code").alias("qid")).distinct(),
                     "wanted")
    # a query's number is its code
    asked = written(spark, wanted.select("qid", F.col("qid").alias("code")).distinct().withColumn(
        "bound", F.lit(BITS).cast("long")), "queries")
    best, masks = None, _balls(high)
    done_best = []
    for radius in range(WIDTH + 1):
        near = [(int(m), j) for j in range(min(radius, high) + 1) for m in masks[j]]
        flips = F.explode(F.from_json(F.lit(str([{"m": m, "j": j} for m, j in near]).replace("'", '"')),
                                      "array<struct<m: long, j: long>>")).alias("f")
        routed = asked.select("qid", "code", "bound", segs).select(
            "qid", "code", "bound", "s.seg", "s.hi", flips).select(
            "qid", "code", "bound", "seg", F.col("hi").bitwiseXOR(F.col("f.m")).alias("hi"), F.col("f.j").alias("flips"))
        routed = routed.join(parts, ["seg", "hi"]).withColumn(
            "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        found = (routed.groupBy("seg", "hi", "part").cogroup(table_.groupBy("seg", "hi", "part"))
                 .applyInPandas(_probe(radius, low, k), "qid long, code long, least long, n long, distance long"))
        both = found if best is None else best.unionByName(found)
        nth = Window.partitionBy("qid").orderBy("distance", "least", "code")
        best = written(spark, both.dropDuplicates(["qid", "code"]).withColumn("nth", F.row_number().over(nth))
                       .filter(F.col("nth") <= k + 1).drop("nth"), "best")
        # the kth distance so far: a query's own row is among the ids found
        upto = best.withColumn("upto", F.sum("n").over(nth.rowsBetween(Window.unboundedPreceding, 0)))
        state = upto.groupBy("qid").agg(F.min(F.when(F.col("upto") > k, F.col("distance"))).alias("kth"),
                                        F.sum("n").alias("seen"))
        covered = SEGMENTS * (radius + 1) - 1
        state = asked.select("qid", "code").join(state, "qid", "left").select(
            "qid", "code", F.coalesce("kth", F.lit(BITS)).alias("bound"),
            (F.coalesce(F.col("kth") <= covered, F.lit(False)) | (F.coalesce("seen", F.lit(0)) >= F.lit(held or 0)))
            .alias("done"))
        state = written(spark, state, "queries")
        ended = state.filter("done").select("qid")
        done_best.append(best.join(ended, "qid", "left_semi"))
        asked = state.filter("not done").select("qid", "code", "bound")
        best = best.join(ended, "qid", "left_anti")
        if not asked.take(1):
            break
    else:
        done_best.append(best)
    final = done_best[0]
    for more in done_best[1:]:
        final = final.unionByName(more)
    near = (final.select("qid", "code", "distance").join(ids.select("code", "vec_id"), "code")
            .withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy("distance", "vec_id")))
            .filter(F.col("nth") <= k + 1).select("qid", "vec_id", "distance"))
    rank = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return (wanted.join(near, "qid").filter("query_id <> vec_id")
            .withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "distance"))


def op1_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every row whose id is divisible by 50, against all rows."""
    prepare(spark)
    codes = written(spark, binary_codes(table(spark, sf_dir, "embeddings")), "vectors")
    return search(spark, codes, codes.filter("vec_id % 50 = 0"))


OP1_SQL = f"""
with v as (select distinct vec_id, list_transform(embedding, lambda x: x > 0) as s from embeddings
           where vec_id is not null and embedding is not null and len(embedding) = {BITS}),
d as (select q.vec_id as query_id, v.vec_id,
      list_sum(list_transform(range(1, {BITS} + 1), lambda i: cast(q.s[i] <> v.s[i] as bigint))) as distance
      from v q, v where q.vec_id % 50 = 0 and q.vec_id <> v.vec_id),
r as (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from d)
select query_id, cast(rank as integer) as rank, vec_id, cast(distance as bigint) as distance from r where rank <= {K}
"""
