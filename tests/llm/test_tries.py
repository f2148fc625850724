"""Operator 12 against plain dictionaries of prefixes."""
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from barwise.llm import tries

TURNS = "conv_id long, turn long, role string, text string"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", hashlib.md5(
                f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    members = defaultdict(list)
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
        for d in range(len(paths[c]) + 1):
            members[paths[c][:d]].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += children[p] == 0
        saved[p] += (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        if p:
            children[p[:-1]] += 1
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(c for c in m if paths[c] == p))).encode()).hexdigest())
                   for p, m in members.items()), key=str)


def result(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=str)


def nodes(spark, rows):
    df = spark.createDataFrame(rows, TURNS)
    return result(tries.prefix_nodes(spark, tries.rebuilt(tries.paths_of(df))))


def test_query_equals_dictionaries(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(tries.op12_prefix_trie(spark, sf)) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_hot_prefixes_copies_and_shards_of_few_turns(spark, seed, monkeypatch):
    """Few distinct turns, long shared beginnings, hundreds of copies; shards so small that most nodes are shared."""
    r = random.Random(seed)
    monkeypatch.setattr(tries, "SHARD_TURNS", 12)
    monkeypatch.setattr(tries, "IDS_TOGETHER", 7)
    rows = []
    for c in range(400):
        if r.random() < 0.4:
            turns = ["same", "long talk", "of all", "in the end"]
        else:
            turns = ["same", "long talk"][:r.randint(0, 2)] + [r.choice(["a", "b b", "", "c c c"]) for _ in range(r.randint(0, 9))]
        rows += [(c, k, r.choice(["user", "user", "bot"]) if k > 3 else "user", t) for k, t in enumerate(turns)]
    assert nodes(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "no conversation"), (1, None, None, None), (1, None, "user", None), (1, 2, "user", "x"),
            (1, 2, "user", "x"), (1, 2, "bot", "tie"), (1, -5, "", ""), (2, 0, "a", "bc"), (3, 0, "ab", "c"), (-7, 1, "user", "neg"),
            (40, 0, "user", " \t "), (41, 0, "user", "gone"), (20, None, "user", "y" * 2_000_000 + " z"), (27, 3, None, "w")]
    rows += [(60, k, "user", "deep") for k in range(300)] + [(c, k, "user", "deep") for c in (61, 62, 63, 79) for k in range(250)]
    assert nodes(spark, rows) == brute(rows)
    assert nodes(spark, []) == []


def test_extra_columns_with_clashing_names(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet").selectExpr("*", "'x' as path", "1 as words", "2 as n", "3 as base", "4 as key", "5 as shard")
    got = tries.prefix_nodes(spark, tries.rebuilt(tries.paths_of(df)))
    assert result(got) == result(tries.op12_prefix_trie(spark, sf))


def test_double_array_holds_all_prefixes_and_no_other(spark):
    r = np.random.default_rng(3)
    digest = [hashlib.md5(bytes([k])).hexdigest().encode() for k in range(60)]
    paths = sorted({b"".join(digest[i] for i in r.integers(0, 60 if r.random() < .5 else 3, r.integers(0, 8))) for _ in range(500)})
    s = tries.Shard.of(paths)
    prefixes = {p[:k] for p in paths for k in range(0, len(p) + 1, tries.WIDE)}
    assert (s.trie.check >= 0).sum() == len(prefixes)          # one state a node
    assert sum(len(np.unique(states)) for _, _, states in s.walk()) == len(prefixes) - 1
    packed = {"turns": b"".join(s.turns.tolist()), "base": s.trie.base.tobytes(), "check": s.trie.check.tobytes()}
    assert len({tries.find(packed, p.decode()) for p in prefixes} - {-1}) == len(prefixes)
    other = [p + digest[k] for p in list(prefixes)[:50] for k in range(60)]
    assert all((tries.find(packed, p.decode()) >= 0) == (p in prefixes) for p in other)


def test_packed_tries_are_found_by_range(spark, sf):
    paths = tries.rebuilt(tries.paths_of(spark.read.parquet(f"{sf}/conversations.parquet")))
    distinct = tries.distinct_paths(spark, paths)
    rows = tries.packed_tries(distinct).collect()
    for p in distinct.select("path").limit(50).collect():
        at = [r for r in rows if r["first"] <= p["path"] <= r["last"]]
        assert len(at) == 1 and tries.find(at[0], p["path"]) >= 0
