import random
import re
import string

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from barwise.llm import hamming, queries, urls


def oracle(sf, name, table):
    c = duckdb.connect()
    c.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    return sorted(map(str, c.execute(queries.ORACLES[name]).fetchall()))


@pytest.mark.parametrize("name, table", [("op1_hamming_topk", "embeddings"), ("op2_url_filter", "pages")])
def test_against_sql(spark, sf, name, table):
    got = queries.QUERIES[name](spark, sf)
    assert sorted(map(str, map(tuple, got.collect()))) == oracle(sf, name, table)


def nearest(rows, queried, k):
    rows, out = sorted(set(rows)), []
    for q, c in sorted(set(queried)):
        near = sorted(((c ^ d) & (2**64 - 1)).bit_count() * 10**6 + i for i, d in rows if i != q)[:k]
        out += [(q, n + 1, x % 10**6, x // 10**6) for n, x in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("block, k", [(8192, 3), (16, 5), (4, 1)])
def test_search_of_clusters_copies_and_ties(spark, monkeypatch, block, k):
    monkeypatch.setattr(hamming, "BLOCK_CODES", block)
    rnd = random.Random(block)
    centres = [rnd.getrandbits(64) for _ in range(8)]
    codes = [c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 9))) for c in centres for _ in range(25)]
    codes += [centres[0]] * 60 + [rnd.getrandbits(64) for _ in range(40)]
    rows = [(i, c - (1 << 64) if c >> 63 else c) for i, c in enumerate(codes)]
    index = spark.createDataFrame(rows + rows[:5], "vec_id long, code long")
    got = hamming.search(spark, index, index.filter("vec_id % 20 = 0"), k)
    assert sorted(map(tuple, got.collect())) == nearest(rows, [r for r in rows if r[0] % 20 == 0], k)


def test_search_of_few_and_no_rows(spark):
    few = spark.createDataFrame([(0, 5), (50, 5), (7, -1)], "vec_id long, code long")
    assert sorted(map(tuple, hamming.search(spark, few, few.filter("vec_id % 50 = 0")).collect())) == [
        (0, 1, 50, 0), (0, 2, 7, 62), (50, 1, 0, 0), (50, 2, 7, 62)]
    none = few.filter("false")
    assert hamming.search(spark, none, none).count() == 0
    assert hamming.search(spark, few, none).count() == 0


def test_codes_of_odd_vectors(spark):
    v = [(1, [1.0] * 64), (2, None), (3, []), (None, [1.0] * 64), (4, [float("nan")] * 64), (5, [0.5, -1.0, None]), (5, [0.5, -1.0, None])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").withColumn("code", F.lit("x"))
    got = hamming.binary_codes(df).collect()
    assert [(r["vec_id"], r["code"]) for r in got[:2]] == [(1, -1), (4, 0)] and [r["vec_id"] for r in got[2:]] == [5, 5]
    assert got[2] == got[3]


def judged(url, rules, bad):
    url = url or ""
    m = re.search(r"(?s)^.*?://([^/?#]*)([^?#]*)", url)
    host, path = (m.group(1).translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)), m.group(2)) if m else ("", "")
    fits = [(len(h + p), len(h.split(".")), h + p, v) for v, h, p in rules
            if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[2], max(fits)[3]
    canon = re.sub(r"\.html$", "", re.sub(r"/+$", "", path))
    key = re.sub(r"^(?:www|m)\.", "", host) + canon
    return host, path, None, "block" if host and key in bad else "allow"


ODD = [None, "", "x", "http://", "http://a", "HTTP://A.Example.NET/EN/x", "https://a.example.net/en/x?q#f", "https://example.net/en",
       "ftp://org/fr/1", "http://x.org/fr/#a", "http://xorg/fr/", "http://b.example.com/de/1/", "http://www.b.example.com/de", "://net/",
       "http://a://net/", "http://net?x", "http://net/", "http://my.net/\npath", "http://É.net/é", "http://m.bad.org/p.html?x=1",
       "https://www.bad.org/p/", "http://bad.org/p2", "http://a.b.c.d.example.net/en/" + "y" * 9000]


def test_odd_urls(spark):
    rows = [(i if i % 5 else None, u, "html") for i, u in enumerate(ODD)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ("host", "path", "rule", "key", "verdict", "n", "listed"):
        pages = pages.withColumn(c, F.lit(c))
    rules = spark.createDataFrame(urls.RULES, "verdict string, host string, path string")
    bad = spark.createDataFrame([("bad.org/p",), ("bad.org/p",)], "key string")
    got = urls.filter_pages(spark, pages, rules, bad)
    assert got.columns == pages.columns + ["_host", "_path", "_rule", "_verdict"]
    assert sorted((str(r["page_id"]), str(r["url"]), r["_host"], r["_path"], str(r["_rule"]), r["_verdict"]) for r in got.collect()) == sorted(
        (str(i), str(u), h, p, str(x), v) for i, u, _ in rows for h, p, x, v in [judged(u, urls.RULES, {"bad.org/p"})])
    none = pages.filter("false")
    assert urls.filter_pages(spark, none, rules, bad).count() == 0
    free = urls.filter_pages(spark, pages, rules.filter("false"), bad.filter("false"))
    assert free.count() == len(rows) and free.filter("_verdict = 'block'").count() == 0


@pytest.mark.parametrize("few", [0, 10**6])
def test_bloom_passes_every_hit_and_few_others(spark, monkeypatch, few):
    monkeypatch.setattr(urls, "BROADCAST_KEYS", few)
    keys = [f"h{i}.org/p{i}" for i in range(5000)]
    listed = spark.createDataFrame([(k,) for k in keys[:2500]], "key string")
    asked = spark.createDataFrame([("http://" + k,) for k in keys], "url string")
    rules = spark.createDataFrame([], "verdict string, host string, path string")
    got = urls.judge(spark, asked, rules, listed)
    assert got.filter("listed").count() == 2500
    assert 2500 <= got.agg(F.sum("possible")).first()[0] < 2700


def test_bloom_filter_has_a_size_bound(spark):
    listed = spark.range(1000).selectExpr("cast(id as string) key")
    blocks, n = urls.bloom(listed, 10**12)
    assert n == urls.MAX_BLOCKS and blocks.count() <= 1000
    assert np.log2(n * urls.BLOCK_BITS / 8) <= 23


def test_clashing_columns_of_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", "u1", "h1"), (2, None, "u2", "h2"), (2, None, "u2", "h2")],
                                  "page_id long, url string, _url string, host string")
    rules = spark.createDataFrame([("block", "net", "/")], "verdict string, host string, path string")
    got = urls.filter_pages(spark, pages, rules, spark.createDataFrame([], "key string"))
    assert got.columns == pages.columns + ["_host", "_path", "_rule", "_verdict"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [
        (1, "http://a.net/x", "u1", "h1", "a.net", "/x", "net/", "block"),
        (2, None, "u2", "h2", "", "", None, "allow"), (2, None, "u2", "h2", "", "", None, "allow")]))


def test_many_queries_of_one_code(spark):
    """Queries of equal code are searched once; each still leaves out itself alone."""
    rows = [(i, 7) for i in range(300)] + [(i, 7 ^ (1 << i % 60)) for i in range(300, 320)]
    index = spark.createDataFrame(rows, "vec_id long, code long")
    got = hamming.search(spark, index, index, 4)
    assert sorted(map(tuple, got.collect())) == nearest(rows, rows, 4)
