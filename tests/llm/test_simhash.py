import random
from collections import defaultdict

import pytest
import xxhash

from barwise.llm import simhash
from barwise.llm.components import components


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(fps):
    """root of each distinct fingerprint by brute force over all pairs"""
    fps = sorted(set(fps))
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def brute(rows):
    fp = [(r["doc_id"], fingerprint(r["text"])) for r in rows]
    root = groups(f for _, f in fp)
    least = defaultdict(list)
    for d, f in fp:
        if d is not None:
            least[root[f]].append(d)
    return sorted(((d, f"{f:016x}", min(least[root[f]], default=None)) for d, f in fp), key=str)


def test_op4_against_brute_force(spark, sf, docs):
    got = sorted(map(tuple, simhash.op4_simhash(spark, sf).collect()), key=str)
    assert got == brute(docs.collect())


def test_odd_rows(spark, odd, empty):
    got = simhash.near_duplicates(spark, odd).collect()
    want = brute(odd.collect())
    assert sorted(((r["doc_id"], f"{r['fp'] & (2**64 - 1):016x}", r["component_id"]) for r in got), key=str) == want
    kept = simhash.keep_one(spark, odd)
    assert kept.columns == odd.columns
    assert kept.count() == len({r["root"] for r in got})
    assert simhash.near_duplicates(spark, empty).count() == 0
    assert simhash.keep_one(spark, empty).count() == 0


@pytest.mark.parametrize("dense", [0, 3, 10_000])
def test_links_of_dense_clusters(spark, monkeypatch, dense):
    """Pairs and wildcard stars give the same components as all pairs."""
    monkeypatch.setattr(simhash, "DENSE", dense)
    rnd = random.Random(dense)
    fps = set()
    for _ in range(6):
        c = rnd.getrandbits(64)
        fps |= {c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))) for _ in range(40)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    found = components(spark, simhash.links(spark, spark.createDataFrame(signed, "fp long")))
    got = {r["node"] & (2**64 - 1): r["root"] & (2**64 - 1) for r in found.collect()}
    want = defaultdict(set)
    for f, r in groups(fps).items():
        want[r].add(f)
    mine = defaultdict(set)
    for f in fps:
        mine[got.get(f, f)].add(f)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, mine.values()))


def test_components_of_long_paths(spark):
    n = 300
    edges = [(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000), (7, 7)]
    random.Random(1).shuffle(edges)
    got = dict(map(tuple, components(spark, spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}
    assert components(spark, spark.createDataFrame([], "u long, v long")).count() == 0
