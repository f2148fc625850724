"""Operator 6 learns from every labelled row that is not held out, in blocks."""
import zlib

import numpy as np
import pytest

from barwise.llm import quality


def _tables(spark, n, bad_every):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(60)]
    texts = []
    for d in range(n):
        bad = d % bad_every == 0
        k = int(rng.integers(3, 40)) if bad else int(rng.integers(20, 120))
        texts.append((d, " ".join(rng.choice(words[:6 if bad else 60], k)) + ("!" * int(rng.integers(0, 4)) if bad else "."), 1 - int(bad)))
    return (spark.createDataFrame([(d, t) for d, t, _ in texts], "doc_id long, text string"),
            spark.createDataFrame([(d, q) for d, _, q in texts], "doc_id long, quality int"))


def _learned(n):
    return [d for d in range(n) if zlib.crc32(str(d).encode()) % 3 != 1]


def test_every_labelled_row_is_learned_from(spark):
    n = 20_000
    docs = spark.range(n).selectExpr("id as doc_id", "concat('word', id % 7, ' and ', id % 5) as text")
    labels = spark.range(n).selectExpr("id as doc_id", "cast(id % 10 > 0 as int) as quality")
    _, y = quality.training_rows(docs, labels)
    assert len(y) == len(_learned(n)) and y.sum() == sum(d % 10 > 0 for d in _learned(n)) > 6_000


def test_one_block_is_the_fit_in_memory(spark):
    docs, labels = _tables(spark, 900, 4)
    want, got = quality.fit(*quality.training_rows(docs, labels)), quality.train(docs, labels)
    for field in ("mean", "scale", "weight", "cut", "slope"):
        np.testing.assert_allclose(getattr(got, field), getattr(want, field), rtol=1e-6, atol=1e-9)


@pytest.mark.parametrize("bad_every", [2, 15])
def test_blocks_count_each_row_once_and_pair_every_row(spark, bad_every):
    docs, labels = _tables(spark, 900, bad_every)
    x, y = quality.training_rows(docs, labels)
    rows = quality.training_table(docs, labels)
    n = {0: int((y == 0).sum()), 1: int((y == 1).sum())}
    found = quality._blocks(rows, n, (24, 48)).collect()
    assert len(found) > 4
    size = quality.FEATURES * 8
    assert sum(len(r["good"]) for r in found if r["own_good"]) == n[1] * size
    assert sum(len(r["bad"]) for r in found if r["own_bad"]) == n[0] * size
    assert all(r["good"] and r["bad"] and len(r["good"]) + len(r["bad"]) < 4 * 72 * size for r in found)
    whole, cut = quality.fit(x, y), quality.train(docs, labels, (24, 48))
    np.testing.assert_allclose(cut.mean, whole.mean, rtol=1e-9, atol=1e-12)
    assert ((cut.score(x) >= 0.5) == (whole.score(x) >= 0.5)).mean() > 0.97


def test_no_row_of_a_label_is_passed_by():
    for n_bad in (31, 62, 40):
        good = np.zeros((5, quality.FEATURES))
        used = set()
        for k in range(n_bad):
            one = np.zeros((n_bad, quality.FEATURES))
            one[k] = 1
            m = quality.Model(np.zeros(quality.FEATURES), np.ones(quality.FEATURES), np.zeros(quality.FEATURES))
            if quality._pair_sums(m, quality.PAIRS, good, one)[1]:
                used.add(k)
        assert len(used) == n_bad
