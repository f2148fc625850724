"""The substring search against brute force, without a broadcast or a comparison of queries with strings."""
from barwise.sources import dims as D


def test_substring_hits_equal_brute_force(spark):
    names = [("1", "Customer#000000001"), ("12", "Customer#000000012"), ("345678901", "aaaaaaaaaaaaaaaaaaaa"), ("x", None),
             (None, "İstanbul Straße"), ("", "abcabcabcabd"), ("1", "Customer#000000001"), ("twin", "TWIN"), ("z", "abcdefghijk")]
    asked = ["", "1", "2", "customer", "CUSTOMER#", "customer#0000000", "000000012", "0000000121", "aaaaaaaa", "aaaaaaaaaaaaaaaaaaa",
             "aaaaaaaaaaaaaaaaaaaaa", "bcabcabd", "bcabcabcabd", "abcabcabcabc", "cabcabca", "straße", "i̇stanbul straße", "İSTANBUL s",
             "345678901", "3456789012", "bcdefghij", "abcdefghijkl", "TWIN", None, "1", "abcde ghijk"]
    dim = spark.createDataFrame(names, "symbol string, name string")
    qs = spark.createDataFrame([(q,) for q in asked], "q string")
    texts = {r[0] for r in dim.selectExpr("lower(symbol)").union(dim.selectExpr("lower(name)")).collect() if r[0] is not None}
    want = sorted({r["q"] for r in qs.selectExpr("q", "lower(q) as l").collect() if r["q"] is not None and any(r["l"] in t for t in texts)})
    for gram in (1, 2, 3, D.GRAM):
        assert sorted(r["q"] for r in D.substring_hits(qs, dim, gram=gram).collect()) == want, gram
    assert D.substring_hits(qs, dim.limit(0)).count() == 0 and D.substring_hits(qs.limit(0), dim).count() == 0


def test_candidates_broadcast_nothing_and_compare_no_pairs(spark, sf):
    dim = D.dim_symbols(spark, sf)
    plan = D.expand_candidates(dim.selectExpr("market_symbol as q").distinct(), dim)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Contains" not in plan
