"""Operator 4: SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments.  Two fingerprints that differ in at
most two (even three) bits have a segment that differs in at most one bit, so they share
that segment or one of its 32 variants with one bit wiped out.  Equal variants meet in an
equality join and are verified on all 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwise.llm.common import aliased, prepare, row_key, table, text_groups, written
from barwise.llm.components import components

SHINGLE = 3
MAX_BITS = 2
#: Buckets up to this size are joined with themselves; larger ones are split by further
#: wildcards, which needs no pairs at all.  Both ways find the same components.
DENSE = 64


def text_fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles; 0 without words."""
    import xxhash

    words = text.lower().split()          # bytes: A-Z only, and exactly \x20 and \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size) - 1
    starts = (ends + 1 - size).tolist()
    ends = ends.tolist()
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 15):
        h = np.array([digest(joined[s:e], 42) for s, e in zip(starts[k:min(n, k + (1 << 15))], last[k:])], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, h, fp)`` per row: fp the fingerprint as a signed long, h a key of the text.
    A null text is empty; other columns are ignored."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for rows, texts in text_groups(batches):
            fps = np.array([text_fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("h"), pa.array(fps)], schema=schema)

    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key("text").alias("h"),
                        F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, h long, fp long"))


_LOW = 0xFFFFFFFF


def _segments(fp):
    return F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(_LOW).cast("long"))


def _bit(i):
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def _wiped(value, i):
    return value.bitwiseAND(F.bitwise_not(_bit(i)))


def _variants(fps: DataFrame) -> DataFrame:
    """(seg, wild, part, fp): the two segments whole (wild -1) and with each bit wiped."""
    hi, lo = _segments(F.col("fp"))
    seg = F.explode(F.array(F.struct(F.lit(0).alias("seg"), hi.alias("value"), lo.alias("other")),
                            F.struct(F.lit(1).alias("seg"), lo.alias("value"), hi.alias("other")))).alias("s")
    wild = F.explode(F.sequence(F.lit(-1), F.lit(31))).alias("wild")
    one = fps.select("fp", seg).select("fp", "s.*").select("fp", "seg", "value", wild)
    part = F.when(F.col("wild") < 0, F.col("value")).otherwise(_wiped(F.col("value"), F.greatest("wild", F.lit(0))))
    # one long: segment, wiped bit and rest
    key = part + F.lit(1 << 32) * (F.col("wild") + 1 + 64 * F.col("seg"))
    return one.select(key.alias("key"), "fp")


def links(spark: SparkSession, fps: DataFrame) -> DataFrame:
    """Links ``(u, v)`` between distinct fingerprints ``fps (fp)`` at ``MAX_BITS`` or fewer
    differing bits; enough of them to give the same components as all such links.

    A bucket holds the fingerprints that share a variant.  Small buckets are self-joined and
    verified (a pair that differs inside the bucket's segment must differ in the wiped bit,
    so a link is found once per segment).  In a bucket of more than ``DENSE`` fingerprints,
    members are told apart by wildcards of the other segment too: those that then agree
    differ in the wiped bits only, two at most, so each is linked to the least of them.
    """
    bucket = _variants(fps).withColumn("n", F.count("*").over(Window.partitionBy("key")))
    shared = written(spark, bucket.filter("n > 1"), "buckets")
    wild = F.floor(F.shiftrightunsigned("key", 32) % 64) - 1
    seg = F.floor(F.shiftrightunsigned("key", 38))
    value = F.when(seg == 0, _segments(F.col("fp"))[0]).otherwise(_segments(F.col("fp"))[1])
    other = F.when(seg == 0, _segments(F.col("fp"))[1]).otherwise(_segments(F.col("fp"))[0])
    rows = shared.select("key", "fp", "n", wild.alias("wild"), value.alias("value"), other.alias("other"))

    few = rows.filter(F.col("n") <= DENSE)
    a, b = few.alias("a"), few.alias("b")
    differ = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp")))
    own = F.col("a.value") == F.col("b.value")
    pairs = (a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))
                    & (own == (F.col("a.wild") < 0)) & (differ <= MAX_BITS))
             .select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")))

    many = rows.filter(F.col("n") > DENSE)
    # the bits of the other segment that may differ: two if the own segment is whole, else one
    first = F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i")
    second = F.explode(F.when(F.col("wild") < 0, F.sequence(F.col("i") + 1, F.greatest(F.lit(31), F.col("i") + 1)))
                       .otherwise(F.array("i"))).alias("j")
    fine = (many.select("key", "fp", "wild", "other", first).select("key", "fp", "other", "i", second)
            .filter("j < 32")
            .select("key", "fp", "i", "j", _wiped(_wiped(F.col("other"), F.col("i")), F.col("j")).alias("rest")))
    fine = fine.withColumn("least", F.min("fp").over(Window.partitionBy("key", "i", "j", "rest")))
    stars = fine.filter("fp <> least").select(F.col("least").alias("u"), F.col("fp").alias("v")).distinct()
    return pairs.unionAll(stars)


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, h, fp, root, component_id)`` per row of ``docs``.

    Rows whose fingerprints are linked, directly or through others, share ``root`` (a
    fingerprint) and ``component_id``, the least doc_id among them (null if all are null).
    Empty and null texts have fingerprint 0 and are linked like any other.  Repeated rows,
    ties and null ids are kept; an empty table gives an empty one.  Copies meet as one
    fingerprint before any join.
    """
    made = written(spark, fingerprints(docs, shingle), "fingerprints")
    distinct = made.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(spark, links(spark, distinct.select("fp")))
    joined = distinct.join(found, distinct.fp == found.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return made.join(joined.join(ids, "root").select("fp", "root", "component_id"), "fp")


def keep_one(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` with one document of every group: the one with the least doc_id
    (nulls last, then the least text key; of equal rows any one).  All columns stay, whatever
    their names, with types and values."""
    found = near_duplicates(spark, docs, shingle)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("k"))

    def key(doc_id, h):
        return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), h.cast("string"))

    kept = first.select(key(F.col("k.doc_id"), F.col("k.h")).alias("key"))
    flat, at, back = aliased(docs)
    rows = flat.withColumn("key", key(F.col(at["doc_id"]).cast("bigint"), row_key(at["text"]))).join(kept, "key")
    one = rows.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("key")))
    return one.filter("nth = 1").select(*back)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = near_duplicates(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
