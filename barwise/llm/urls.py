"""Operator 2: URL filters with a blocked Bloom filter and an exact hash join.

A list holds rules (host, path) and canonical URLs, each with a verdict.  Every URL asks for
a few keys: one for each shape of listed rule (labels of the host, length of the path) that
fits it, and its canonical URL.  A blocked Bloom filter of the listed keys lets possible
hits pass; these are joined exactly with the list, which removes false positives.  All of it
is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise.llm.common import aliased, literal_rows, prepare, table, written

#: Rules of the contract: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
         ("allow", "org", "/fr/")]
#: Words that put a page's canonical URL on the block list of the query.
LISTED_WORDS = ["idiot", "scum", "worthless"]

BLOCK_BITS = 256
BITS_A_KEY = 12
#: The filter has this many blocks at most (8 MB of bits), whatever the list: beyond, more
#: false positives reach the exact join, never fewer hits.
MAX_BLOCKS = 1 << 18
#: Below this many listed keys (measured) the list goes to every task, else both sides are
#: shuffled; either way it is a hash join.
BROADCAST_KEYS = 200_000


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty
    for null or without ``://``."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host and path without scheme, a leading ``www.`` or ``m.``, ``.html``, trailing slashes,
    query and fragment; null without a host."""
    h = F.regexp_replace(host(url), r"^(?:www|m)\.", "")
    p = F.regexp_replace(F.regexp_replace(path(url), r"/+$", ""), r"\.html$", "")
    return F.when(F.length(h) > 0, F.concat(h, p))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(11), key), F.lit(blocks))


def _lanes(key: Column) -> list[Column]:
    """Four longs, each with two bits set: a key's 8 bits in its 256-bit block."""
    h = F.xxhash64(F.lit(12), key)
    bit = [F.shiftrightunsigned(h, 5 * i).bitwiseAND(F.lit(31)).cast("int") for i in range(8)]
    one = F.lit(1).cast("long")
    return [F.call_function("shiftleft", one, bit[2 * i]).bitwiseOR(
        F.call_function("shiftleft", one, bit[2 * i + 1] + 32)) for i in range(4)]


def bloom(listed: DataFrame, keys: int) -> tuple[DataFrame, int]:
    """Blocks ``(_block, w0..w3)`` of the filter over ``listed (key)``, and their number."""
    blocks = int(min(MAX_BLOCKS, max(1, -(-keys * BITS_A_KEY // BLOCK_BITS))))
    lanes = listed.select(_block(F.col("key"), blocks).alias("_block"),
                          *[c.alias(f"w{i}") for i, c in enumerate(_lanes(F.col("key")))])
    return lanes.groupBy("_block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)]), blocks


def _rule_key(host_: Column, path_: Column) -> Column:
    return F.concat(F.lit("r "), host_, path_)


def judge(spark: SparkSession, urls: DataFrame, rules: DataFrame, blocked: DataFrame) -> DataFrame:
    """``urls (url)``, distinct, with host, path, ``rule`` (null without one), ``listed`` (the
    canonical URL is blocked), ``verdict`` and ``possible`` (keys that passed the filter).

    ``rules (verdict, host, path)``: a rule fits its host and all subdomains if the path
    starts with the rule's; the longest wins (ties: the longer host).  Without a rule, a
    canonical URL in ``blocked (key)`` is blocked and any other allowed.  Null and odd URLs
    have empty parts and are allowed.  Rules with the same host and path: the least verdict.
    """
    of_rules = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict")).select(
        _rule_key(F.col("host"), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"), "verdict",
        F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("size"))
    of_urls = blocked.select(F.concat(F.lit("u "), "key").alias("key"), F.lit(None).cast("string").alias("rule"),
                             F.lit("block").alias("verdict"), F.lit(None).cast("int").alias("labels"),
                             F.lit(None).cast("int").alias("size")).distinct()
    listed = written(spark, of_rules.unionAll(of_urls), "listed")
    n = listed.count()
    blocks_table, blocks = bloom(listed, n)
    # shapes of rules: at most 127 labels times the lengths of listed paths
    shapes = [(r[0], r[1]) for r in listed.filter("labels is not null").select("labels", "size").distinct()
              .orderBy("labels", "size").collect()]

    parts = urls.select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    asked = [F.when((F.size(labels) >= a) & (F.length("path") >= b) & (F.length("host") > 0),
                    _rule_key(F.substring_index("host", ".", -a), F.substring(F.col("path"), 1, b))) for a, b in shapes]
    keys = F.array_compact(F.array(*asked, F.concat(F.lit("u "), canonical(F.col("url")))))
    wanted = parts.select("url", F.explode(keys).alias("key")).withColumn("_block", _block(F.col("key"), blocks))
    # the filter is at most MAX_BLOCKS rows of 40 bytes
    probe = wanted.join(F.broadcast(blocks_table), "_block")
    for i, lane in enumerate(_lanes(F.col("key"))):
        probe = probe.filter(F.col(f"w{i}").bitwiseAND(lane) == lane)
    hits = probe.select("url", "key")
    exact = F.broadcast(listed) if n <= BROADCAST_KEYS else listed.hint("shuffle_hash")
    found = hits.join(exact, "key", "left").withColumnRenamed("url", "_u").groupBy("_u").agg(
        F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), "labels", "rule", "verdict"))).alias("best"),
        F.max(F.col("rule").isNull() & F.col("verdict").isNotNull()).alias("listed"), F.count("*").alias("possible"))
    return parts.join(found, F.col("url").eqNullSafe(F.col("_u")), "left").select(
        "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("listed", F.lit(False)).alias("listed"),
        F.coalesce(F.col("best.verdict"), F.when(F.col("listed"), F.lit("block")), F.lit("allow")).alias("verdict"),
        F.coalesce("possible", F.lit(0)).alias("possible"))


def filter_pages(spark: SparkSession, pages: DataFrame, rules: DataFrame, blocked: DataFrame) -> DataFrame:
    """``pages`` (its columns first, whatever their names) with ``_host, _path, _rule,
    _verdict``; every row is judged by its URL, repeated URLs once."""
    flat, at, back = aliased(pages)
    urls = pages.select(F.col("url").cast("string").alias("url")).distinct()
    found = judge(spark, urls, rules, blocked).select(
        F.col("url").alias("_url"), F.col("host").alias("_host"), F.col("path").alias("_path"),
        F.col("rule").alias("_rule"), F.col("verdict").alias("_verdict"))
    return flat.join(found, F.col(at["url"]).cast("string").eqNullSafe(F.col("_url"))).select(
        *back, "_host", "_path", "_rule", "_verdict")


def listed_pages(pages: DataFrame, words=tuple(LISTED_WORDS)) -> DataFrame:
    """Canonical URLs of the pages whose HTML holds one of ``words``: (key)."""
    return (pages.filter(F.col("html").rlike("|".join(words)))
            .select(canonical(F.col("url")).alias("key")).filter("key is not null"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    pages = table(spark, sf_dir, "pages")
    rules = literal_rows(spark, RULES, "verdict string, host string, path string")
    found = filter_pages(spark, pages.select("page_id", "url"), rules, listed_pages(pages))
    return found.select(F.col("page_id").cast("long").alias("page_id"), F.col("_host").alias("host"),
                        F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))


_HOST = "translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
OP2_SQL = f"""
with p as (select page_id, html, {_HOST} as host, {_PATH} as path from pages),
k as (select *, case when host <> '' then regexp_replace(host, '^(www|m)\\.', '')
      || regexp_replace(regexp_replace(path, '/+$', ''), '\\.html$', '') end as canon from p),
bad as (select distinct canon from k where canon is not null and ({" or ".join(f"contains(html, '{w}')" for w in LISTED_WORDS)})),
rules(verdict, rhost, rpath) as (values {", ".join(str(r) for r in RULES)}),
hit as (select page_id, rhost || rpath as rule, r.verdict,
        row_number() over (partition by page_id order by length(rhost || rpath) desc) as n
        from k join rules r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select k.page_id, k.host, k.path, hit.rule,
       coalesce(hit.verdict, case when bad.canon is not null then 'block' else 'allow' end) as verdict
from k left join hit on hit.page_id = k.page_id and hit.n = 1 left join bad on bad.canon = k.canon
"""
