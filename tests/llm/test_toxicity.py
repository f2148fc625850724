"""Operator 11: gradients by differences, windows and scores by plain loops, held-out labels."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwise.llm import toxicity as T


def corpus(n, seed):
    """Texts of invented words; a third hold words of two planted stems with any ending."""
    r = random.Random(seed)
    parts = ["ba", "lo", "mi", "ster", "ung", "en", "ra", "te", "vo", "ni", "sha", "er", "ko", "pli"]
    texts, labels = [], []
    for k in range(n):
        words = ["".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(r.randint(5, 300))]
        y = int(k % 3 == 0)
        if y:
            for _ in range(max(1, len(words) // 40)):
                words[r.randrange(len(words))] = r.choice(["grumz", "Fneck"]) + r.choice(parts) + r.choice(["", ",", "!"])
        texts.append(" ".join(words).encode())
        labels.append(y)
    return texts, np.array(labels)


@pytest.fixture(scope="module")
def net():
    return T.fit(*corpus(240, 1), rounds=3)


def test_held_out_texts_are_told_apart(net):
    texts, y = corpus(300, 2)
    score = net.score(T.Scorer(net).top(texts))
    assert ((score >= T.LEAST) == y).mean() > 0.95
    assert score[y == 1].mean() > 0.8 and score[y == 0].mean() < 0.2


def test_one_passage_in_a_long_text_is_found(net):
    texts, y = corpus(60, 3)
    clean = b"\n".join(t for t, l in zip(texts, y) if not l) * 60
    planted = clean[:len(clean) // 2] + b" grumzba fneckrate grumzlo grumzmi " + clean[len(clean) // 2:]
    assert len(planted) > 1_000_000
    top = T.Scorer(net).top([clean, planted], most=5_000)
    assert top[1] > net.cut > top[0]
    assert (top == T.Scorer(net).top([clean, planted])).all()


def test_gradients_equal_differences():
    r = np.random.default_rng(0)
    net = T.Network.new()
    for k in net.dense:
        net.dense[k] = net.dense[k].astype(np.float64)
    x = r.normal(0, 1, (40, 2 * T.WIDTH))
    at = r.integers(0, 39, (T.WINDOW, 5))
    real = np.ones((T.WINDOW, 5), bool)
    real[20:, 2] = False
    at[20:, 2] = 39
    x[39] = 0
    y, weight = np.array([1, 0, 1, 1, 0]), np.full(5, 0.3)

    def loss(x):
        logit, _ = net.pool(net.states(x, net.project(x), at), real)
        return float((weight * np.where(y == 1, np.log1p(np.exp(-logit)), np.log1p(np.exp(logit)))).sum())

    g, dx = T._backward(net, x, at, real, y, weight)
    for name, v in net.dense.items():
        for i in r.choice(v.size, min(6, v.size), replace=False):
            place, old = np.unravel_index(i, v.shape), v[np.unravel_index(i, v.shape)]
            v[place] = old + 1e-3
            up = loss(x)
            v[place] = old - 1e-3
            down = loss(x)
            v[place] = old
            assert math.isclose((up - down) / 2e-3, g[name][place], rel_tol=0.02, abs_tol=2e-4), name
    total = np.zeros_like(x)
    np.add.at(total, at.ravel(), dx.reshape(-1, 2 * T.WIDTH))
    for i in range(0, 39, 7):
        x[i, 3] += 1e-3
        up = loss(x)
        x[i, 3] -= 2e-3
        down = loss(x)
        x[i, 3] += 1e-3
        assert math.isclose((up - down) / 2e-3, total[i, 3], rel_tol=0.02, abs_tol=2e-4)


def slow_logit(net, xs):
    """One window, one word after the other."""
    d = {k: v.astype(np.float64) for k, v in net.dense.items()}
    sides = []
    for way in (0, 1):
        h, out = np.zeros(T.HIDDEN), []
        for x in xs[::-1] if way else xs:
            p, u = x @ d["W"][way] + d["c"][way], h @ d["U"][way]
            z, r = (1 / (1 + np.exp(-(p[k * T.HIDDEN:(k + 1) * T.HIDDEN] + u[k * T.HIDDEN:(k + 1) * T.HIDDEN]))) for k in (0, 1))
            n = np.tanh(p[2 * T.HIDDEN:] + r * u[2 * T.HIDDEN:])
            h = (1 - z) * n + z * h
            out.append(h)
        sides.append(out[::-1] if way else out)
    states = [np.concatenate([f, b, x]) for f, b, x in zip(*sides, xs)]
    s = np.array([np.tanh(e @ d["A"]) @ d["v"] for e in states])
    a = np.exp(s - s.max())
    return float((a / a.sum()) @ np.array(states) @ d["o"] + d["d"][0])


def test_scores_equal_plain_loops(net):
    texts, _ = corpus(12, 4)
    texts = [t for t in texts if len(t.split()) >= T.WINDOW]
    got = T.Scorer(net, memo=10).top(texts)
    for t, top in zip(texts, got):
        words = T.words_of(t)
        x = np.concatenate([net.embed(T.rows_of([w])) for w in words]).astype(np.float64)
        starts = [*range(0, len(words) - T.WINDOW, T.STRIDE), len(words) - T.WINDOW]
        assert starts == T.starts_of(len(words)).tolist()
        assert max(slow_logit(net, x[s:s + T.WINDOW]) for s in starts) == pytest.approx(float(top), abs=2e-3)


def test_words_rows_do_not_depend_on_company():
    words = ["the,", "The", "a", "überhaupt!", "!!", "\x00", "x" * 40, "日本"]
    together = T.rows_of([w.encode() for w in words])
    ends = np.append(together[2][1:], len(together[1]))
    for k, w in enumerate(words):
        alone = T.rows_of([w.encode()])
        assert alone[0][0] == together[0][k] and sorted(alone[1]) == sorted(together[1][together[2][k]:ends[k]])
    assert T.rows_of([b"the,"])[0] == T.rows_of([b"The"])[0]
    assert b"".join(w.ljust(0) for w in T.words_of(b"z" * 100))[:24] == b"z" * 24 and len(T.words_of(b"z" * 100)) == 5


def test_odd_rows_and_tables(spark, odd, empty, net):
    rows = {(r["doc_id"], round(r["score"], 6)) for r in T.scored(spark, odd, net).collect()}
    want = {(r["doc_id"], round(float(net.score(T.Scorer(net).top([(r["text"] or "").encode()]))[0]), 6)) for r in odd.select("doc_id", "text").collect()}
    assert {(d, round(s, 3)) for d, s in rows} == {(d, round(s, 3)) for d, s in want}
    assert T.scored(spark, odd, net).count() == odd.count() and T.scored(spark, empty, net).count() == 0
    assert float(net.score(T.Scorer(net).top([b"", b" \n"])).max()) < 1e-12
    labels = spark.createDataFrame([(1, None, 1), (2, 1, 7), (None, 1, 1), (3, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    texts, y = T.training_rows(odd, labels)
    assert (texts, y.tolist()) == ([b""], [1])            # doc 1: no text; other ids are contradictory, null or no label
    none = T.train(empty, labels)
    assert float(none.score(T.Scorer(none).top([b"any text at all"]))[0]) < T.LEAST


def test_query_learns_from_rows_not_held_out(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = T.op11_toxicity(spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(labels, "doc_id").filter("toxic is not null").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got.count() == docs.count()
    ids = labels.join(docs.select("doc_id"), "doc_id").filter(T.held_out(F.col("doc_id"))).count()
    assert 0 < ids < labels.count()
