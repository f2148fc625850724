"""Operator 13 against plain loops over the libraries' own tokens."""
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from barwise.llm import alignment
from barwise.llm.common import tokenizer_bytes

from .conftest import ODD

A = tokenizer_bytes(public_tokenizers.path("byte_bpe_50k.json"))
B = tokenizer_bytes(public_tokenizers.path("piece_bpe_32k.model"))
WORK = alignment.Aligner(A, B)
ALPHABET = [*" \n  \t'sST.,!a ́̇\x1c\x85　\xa0KΣé<|>x", "the ", "word", " \n", "\n\n", "\r\n", "▁", "<0x0A>", "<s>"]


def brute(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, sha) of each text, one token after the other."""
    twin, docs = WORK.twin, []
    for t in texts:
        a, b = twin.whole(" " + t) if t else ([], [])
        left, right = [twin.a_bytes[i] for i in a], [twin.b_bytes[i] for i in b]
        if not t or not b"".join(left) == b"".join(right) == (" " + t).encode():
            docs.append(None)
            continue
        links, groups, i, j = [], [[[a[0]], [b[0]]]], 0, 0
        end_a, end_b = len(left[0]), len(right[0])
        while True:
            links.append((a[i], b[j]))
            step_a, step_b = end_a <= end_b, end_b <= end_a
            i, j = i + step_a, j + step_b
            if i == len(a):
                break
            if step_a and step_b:
                groups.append([[], []])
            if step_a:
                end_a += len(left[i])
                groups[-1][0].append(a[i])
            if step_b:
                end_b += len(right[j])
                groups[-1][1].append(b[j])
        docs.append((a, b, links, groups))
    count = Counter(x for d in docs if d for x in d[2])
    most = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, links, groups = d
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(count[x] == most[x[1]] for x in links),
                    sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


def test_texts_equal_plain_loops():
    r = random.Random(5)
    texts = [t for t in ODD if t] + ["".join(r.choice(ALPHABET) for _ in range(r.randint(1, 40))) for _ in range(1500)]
    want = [(*w[:4], w[6]) for w in brute(texts)]
    assert [x[:5] for x in WORK.short(texts)] == want
    assert [WORK.long(t, 7)[:5] for t in texts[:200]] == want[:200]      # span borders everywhere


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 64])
def test_pieces_of_any_size_give_the_same_merge(piece):
    r = np.random.default_rng(piece)
    for _ in range(50):
        a, b = (np.unique(np.append(r.integers(1, 60, r.integers(1, 40)), 60)) for _ in range(2))
        whole, cut = alignment.align(a, b, 1000), alignment.align(a, b, piece)
        assert all((x == y).all() for x, y in zip(whole, cut))
        assert len(cut[0]) == len(np.union1d(a, b)) and len(cut[2]) == len(np.intersect1d(a, b))


def test_query_equals_plain_loops(spark, sf, docs):
    rows = docs.select("doc_id", "text").collect()
    got = alignment.op13_alignment(spark, sf).collect()
    want = [(r["doc_id"], *w) for r, w in zip(rows, brute([r["text"] or "" for r in rows]))]
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(tuple(r[c] for c in names) for r in got) == sorted(want)


def test_odd_rows_blocks_and_empty_table(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 64)
    rows = odd.select("doc_id", "text").collect()
    got = alignment.alignment(spark, odd.repartition(3), A, B).collect()
    want = [(r["doc_id"], *w) for r, w in zip(rows, brute([r["text"] or "" for r in rows]))]
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted((tuple(r[c] for c in names) for r in got), key=str) == sorted(want, key=str)
    assert alignment.alignment(spark, empty, A, B).count() == 0


def test_megabytes_of_text(spark, docs):
    """A text of three megabytes is aligned span by span, as the library would whole."""
    base = " ".join(r["text"] for r in docs.filter(F.length("text") > 20).limit(60).collect())
    text = (base + " ") * (3_000_000 // len(base))
    want = brute([text])[0]
    assert WORK.long(text)[:5] == (*want[:4], want[6])
