"""Operator 5: document fingerprints as Merkle trees over sections and paragraphs.

A text is cut at content: sections end at blank lines and before lines that start with a
mark or with a letter of ``SECTION_STARTS``; paragraphs are lines; phrases end at white space
after a mark or after one of a few common last letters, and long ones, whatever their script,
also after runs of characters with a fixed hash residue.  So an edit moves no other border.
A paragraph's hash is SHA-256 of its text, a section's of its paragraphs' hashes, and the
root's of its sections': equal roots mean equal texts, and unequal branches lead to the
edits.  Phrase hashes, beside the tree, give the likeness of two texts.  All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwise.llm.common import prepare, row_key, table, written

# Cuts keep every character in a branch: a cut falls between characters, none is dropped.
SECTION = r"(?<=\n)(?=\n|[#*=A-EÀ-Ý])"
PARAGRAPH = r"(?<=\n)"
PHRASE = r"(?<=[.,;:!?|%&$*#ents>\]])(?=\s)|(?<=\n)"
SHORT = 200
#: A phrase of more code points is cut again after runs of three characters whose hash is a
#: multiple of ``FINER``: in scripts without white space or the marks and letters above.
LONG = 40
FINER = 8
#: Rows that are ordered together, about; and the number of such buckets at most.
ROWS_A_BUCKET = 1_024
MOST_BUCKETS = 1 << 16


def sections(text: Column) -> Column:
    """Per section the hashes of its paragraphs: array<array<binary>>."""
    return F.transform(F.split(text, SECTION), lambda s: F.transform(F.split(s, PARAGRAPH), lambda p: F.sha2(p, 256)))


def section_hashes(tree: Column) -> Column:
    return F.transform(tree, lambda s: F.sha2(F.concat_ws("", s), 256))


def root(tree: Column) -> Column:
    return F.sha2(F.concat_ws("", section_hashes(tree)), 256)


def runs(text: Column) -> Column:
    """Distinct hashes of the text's runs of three characters; none for an empty text."""
    def made(c: Column) -> Column:
        return F.transform(F.slice(c, F.lit(1), F.greatest(F.lit(1), F.size(c) - 2)), lambda x, i: F.xxhash64(
            F.concat_ws("", x, F.get(c, i + 1), F.get(c, i + 2))))
    return F.when(F.length(text) == 0, F.array().cast("array<bigint>")).otherwise(
        F.array_distinct(F.get(F.transform(F.array(F.split(text, "")), made), 0)))


def finer(phrase: Column) -> Column:
    """The pieces of a long phrase, in order; nothing is dropped."""
    def cut(c: Column) -> Column:
        ends = F.transform(c, lambda x, i: F.when(
            F.pmod(F.xxhash64(F.get(c, i - 2), F.get(c, i - 1), x), F.lit(FINER)) == 0, i + 1))
        ends = F.array_distinct(F.array_append(F.filter(ends, lambda e: e.isNotNull()), F.size(c)))
        return F.get(F.transform(F.array(ends), lambda es: F.transform(es, lambda e, k: between(c, es, e, k))), 0)

    def between(c: Column, es: Column, e: Column, k: Column) -> Column:
        start = F.coalesce(F.get(es, k - 1), F.lit(0))
        return F.array_join(F.slice(c, start + 1, e - start), "")
    return F.get(F.transform(F.array(F.split(phrase, "")), cut), 0)


def phrases(text: Column) -> Column:
    """Distinct phrase hashes of the text; none for an empty one."""
    def made(ps: Column) -> Column:
        return F.when(F.exists(ps, lambda x: F.length(x) > LONG), F.flatten(F.transform(
            ps, lambda x: F.when(F.length(x) > LONG, finer(x)).otherwise(F.array(x))))).otherwise(ps)
    cut = F.get(F.transform(F.array(F.split(text, PHRASE)), made), 0)
    return F.when(F.length(text) == 0, F.array().cast("array<bigint>")).otherwise(
        F.array_distinct(F.transform(cut, lambda x: F.xxhash64(F.trim(x)))))


def pieces(a: Column, b: Column) -> tuple[Column, Column]:
    """Hashes of two texts by the same kind of pieces: runs of three characters if either
    text is under ``SHORT`` code points, else phrases."""
    short = F.least(F.length(a), F.length(b)) < SHORT
    return F.when(short, runs(a)).otherwise(phrases(a)), F.when(short, runs(b)).otherwise(phrases(b))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal phrase hashes, 0 to 1; 1 for two empty texts."""
    n = F.size(a) + F.size(b)
    return F.when(n == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / n)


def fingerprint(text: Column) -> Column:
    return root(sections(F.coalesce(text, F.lit(""))))


def changed(left: Column, right: Column) -> Column:
    """Where two trees differ: ``(section, paragraphs)`` of every section of ``left`` whose
    hash ``right`` lacks, with the numbers of the paragraphs that ``right`` lacks."""
    missing = section_hashes(right)
    lost = F.flatten(right)
    marked = F.transform(left, lambda s, i: F.when(
        ~F.array_contains(missing, F.sha2(F.concat_ws("", s), 256)),
        F.struct(i.alias("section"),
                 F.filter(F.transform(s, lambda p, j: F.when(~F.array_contains(lost, p), j)),
                          lambda j: j.isNotNull()).alias("paragraphs"))))
    return F.filter(marked, lambda x: x.isNotNull())


def locate_edits(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """For the rows of ``old`` and ``new`` with the same ``key`` and different roots: the
    changed sections and paragraphs on either side.  Rows with null keys meet nothing."""
    a = old.select(F.col(key), sections(F.coalesce("text", F.lit(""))).alias("old"))
    b = new.select(F.col(key), sections(F.coalesce("text", F.lit(""))).alias("new"))
    return (a.join(b, key).filter(root(F.col("old")) != root(F.col("new")))
            .select(key, changed(F.col("old"), F.col("new")).alias("removed"),
                    changed(F.col("new"), F.col("old")).alias("added")))


def _bucket(cuts: list[int], again: list[int], doc_id: Column, h: Column) -> Column:
    """Number of a row's bucket; numbers ascend with (doc_id descending, nulls last, h).

    The cuts are looked up in two steps (a run of cuts, then inside it).  Rows of a doc_id in
    ``again`` (which fills buckets of its own) and of no doc_id are told apart by h.
    """
    runs = [cuts[k:k + 256] for k in range(0, len(cuts), 256)] + [[]]
    tops = F.from_json(F.lit(str([r[-1] for r in runs if r])), "array<bigint>")
    table_ = F.from_json(F.lit(str(runs)), "array<array<bigint>>")
    run = F.size(F.filter(tops, lambda c: c < doc_id))
    above = F.lit(256) * run + F.size(F.filter(F.element_at(table_, run + 1), lambda c: c < doc_id))
    place = F.when(doc_id.isNull(), F.lit(len(cuts) + 1)).otherwise(F.lit(len(cuts)) - above)
    often = F.array_contains(F.from_json(F.lit(str(again)), "array<bigint>"), doc_id) | doc_id.isNull()
    return place.cast("long") * 256 + F.when(often, F.shiftright(h, 56) + 128).otherwise(F.lit(0)).cast("long")


def with_next(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``(doc_id, text, next)``: each text (null: empty) and the next document's, descending
    doc_id (nulls last, ties by text key); after the last comes the first.

    Rows go to buckets of consecutive doc_ids, of about ``ROWS_A_BUCKET`` rows by approximate
    quantiles (which shape the buckets, not the result).  Inside a bucket the next row is a
    ``lead``; the last row of a bucket takes the first of the next bucket: one row a bucket
    is looked up, and every text is shuffled once.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    buckets = max(1, min(MOST_BUCKETS, base.count() // ROWS_A_BUCKET))
    found = base.filter("doc_id is not null").agg(F.percentile_approx(
        "doc_id", [(i + 1) / (buckets + 1) for i in range(buckets)], max(10_000, 4 * buckets)).alias("c")).first()["c"] or []
    again = sorted({a for a, b in zip(found, found[1:]) if a == b})
    cuts = sorted(set(found) | {a - 1 for a in again})
    rows = base.withColumn("h", row_key("text"))
    rows = rows.withColumn("bucket", _bucket(cuts, again, F.col("doc_id"), F.col("h")))
    inside = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), "h")
    led = rows.select("bucket", "doc_id", "text", "h", F.lead("text").over(inside).alias("next"))

    slim = rows.select("bucket", F.col("doc_id").isNull().alias("none"), F.negate(F.coalesce("doc_id", F.lit(0))).alias("down"), "h")
    first = written(spark, slim.groupBy("bucket").agg(F.min(F.struct("none", "down", "h")).alias("k")).select(
        "bucket", F.when(~F.col("k.none"), F.negate(F.col("k.down"))).alias("id"), F.col("k.h").alias("k")), "heads")
    # a row a bucket, MOST_BUCKETS * 258 at most and integers only
    line = Window.orderBy("bucket")
    after = first.select(F.lag("bucket").over(line).alias("of"), "id", "k").unionAll(
        first.groupBy().agg(F.max("bucket").alias("of"), F.min_by("id", "bucket").alias("id"),
                            F.min_by("k", "bucket").alias("k"))).filter("of is not null")
    keys = F.broadcast(after)
    heads = rows.select("doc_id", "text", "h").join(
        keys, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("k"))).groupBy("of").agg(
        F.first("text").alias("head"))
    return led.join(heads, F.col("next").isNull() & (F.col("bucket") == F.col("of")), "left").select(
        "doc_id", "text", F.coalesce("next", "head").alias("next"))


def edited(text: Column, following: Column) -> Column:
    """The text with its last third of code points replaced by as many first ones of the next."""
    n = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - n), F.substring(following, F.lit(1), n))


def op5_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    pairs = with_next(spark, table(spark, sf_dir, "documents"))
    made = pairs.withColumn("changed", edited(F.col("text"), F.col("next")))
    old, new = pieces(F.col("text"), F.col("changed"))
    here, there = pieces(F.col("text"), F.col("next"))
    trees = made.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("changed", 256).alias("edited_sha256"),
                        sections(F.col("text")).alias("tree"), sections(F.col("changed")).alias("edited_tree"),
                        old.alias("old"), new.alias("new"), here.alias("here"), there.alias("there"))
    return trees.select("doc_id", "n_chars", "edited_sha256", root(F.col("tree")).alias("fingerprint"),
                        root(F.col("edited_tree")).alias("edited_fingerprint"),
                        likeness(F.col("old"), F.col("new")).alias("near_edited"),
                        likeness(F.col("here"), F.col("there")).alias("near_next"))
