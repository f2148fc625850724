"""Operator 11: toxicity by a bidirectional gated recurrent network with attention pooling.

A text is a row of words; a word's input is its own embedding beside the largest of its character
n-grams' embeddings (by coordinate), so stems count whatever their endings.  Windows of
``WINDOW`` words begin every ``STRIDE`` words and cover the whole text; a GRU reads each window in both
directions, attention pools the states, and a text's score is that of its most toxic window.

Labels belong to texts, not windows: every round finds each text's highest window with the present
weights and descends the logistic loss of those.  Everything is numpy; the fit uses a bounded sample.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise.llm.common import prepare, table, text_groups

#: Labelled rows used to fit, of label 1 and of label 0, and the most characters of such a row: the sample's bound.
SAMPLE = (1_200, 2_400)
SAMPLE_CHARS = 20_000
#: Words of a window, and from one window's start to the next.
WINDOW, STRIDE = 64, 32
#: Sizes of a state, of each embedding, and of the attention's layer.
HIDDEN, WIDTH, ATTEND = 8, 8, 8
STATE = 2 * HIDDEN + 2 * WIDTH
#: Rows of the hashed embeddings of words and of character n-grams; lengths of n-grams.
WORDS, GRAMS, SPANS = 1 << 15, 1 << 18, (3, 4, 6)
#: Parts of the training texts; each reads the excess of the others.
FOLDS = 4
#: Scores of this or more are toxic.
LEAST = 0.3
#: A chunk without white space longer than this is read as words of ``PIECE`` characters that overlap by one n-gram.
LONG_WORD, PIECE = 48, 24
#: Distinct chunks a worker remembers at most, and windows scored together; both bear on time only.
MEMO, BATCH = 300_000, 2_048


def words_of(text: bytes) -> list[bytes]:
    """Chunks between ASCII white space; long ones in overlapping pieces."""
    chunks = text.split()
    if chunks and max(map(len, chunks)) > LONG_WORD:
        out = []
        for c in chunks:
            s = c.decode("utf-8", "replace") if len(c) > LONG_WORD else ""
            if len(s) > LONG_WORD:
                out += [s[k:k + PIECE + SPANS[-1] - 1].encode() for k in range(0, len(s), PIECE)]
            else:
                out.append(c)
        return out
    return chunks


#: Marks that do not belong to the word they stand beside.
MARKS = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "¡¿«»“”„‘’…–—"


def _bare(chunk: bytes) -> str:
    """Lower case, without marks around it."""
    s = chunk.decode("utf-8", "replace").lower()
    return s.strip(MARKS) or s


def rows_of(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embedding row of each word, rows of all its character n-grams, and where each word's n-grams start."""
    bare = [f"<{_bare(c)}>" for c in chunks]
    code = np.frombuffer("".join(bare).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(b) for b in bare], np.int64)
    start = np.cumsum(size) - size
    left = np.repeat(start + size, size) - np.arange(len(code))           # characters to the word's end
    mixed, n = np.zeros(len(code), np.uint64), 0
    keys, places = [], []
    for span in SPANS:
        while n < span:
            nxt = np.zeros(len(code), np.uint64)
            nxt[:max(0, len(code) - n)] = code[n:]
            mixed = (mixed ^ nxt) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            n += 1
        at = np.flatnonzero(left >= span)
        keys.append(((mixed[at] ^ np.uint64(span)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % GRAMS)
        places.append(at)
    order = np.argsort(np.concatenate(places), kind="stable")
    grams, place = np.concatenate(keys)[order], np.concatenate(places)[order]
    whole = np.bitwise_xor.reduceat((code + np.uint64(1)) * (np.uint64(0x9E3779B97F4A7C15) * (np.arange(len(code), dtype=np.uint64)
                                    - np.repeat(start, size).astype(np.uint64) + np.uint64(1))), start)
    whole = (whole ^ (whole >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((whole >> np.uint64(40)).astype(np.int64) % WORDS, grams,
            np.searchsorted(place, start))                                # every word has a 3-gram at its start


def starts_of(n: int) -> np.ndarray:
    """Window starts over ``n`` words: every STRIDE, the last one at the end; a short text has one window."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


@dataclass
class Network:
    """Weights (float32), and how a window's logit becomes a score."""

    words: np.ndarray
    grams: np.ndarray
    dense: dict[str, np.ndarray] = field(default_factory=dict)
    cut: float = 0.0
    slope: float = 1.0

    @classmethod
    def new(cls, seed: int = 11) -> Network:
        r = np.random.default_rng(seed)
        normal = lambda *s: (r.normal(0, 1 / np.sqrt(s[0]), s)).astype(np.float32)
        n = cls((r.normal(0, 0.05, (WORDS, WIDTH))).astype(np.float32), (r.normal(0, 0.05, (GRAMS, WIDTH))).astype(np.float32))
        n.dense = {"W": np.stack([normal(2 * WIDTH, 3 * HIDDEN)] * 2), "U": np.stack([normal(HIDDEN, 3 * HIDDEN)] * 2),
                   "c": np.zeros((2, 3 * HIDDEN), np.float32), "A": normal(STATE, ATTEND), "v": normal(ATTEND),
                   "o": normal(STATE), "d": np.zeros(1, np.float32)}
        return n

    def embed(self, rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        word, grams, start = rows
        return np.concatenate([self.words[word], np.maximum.reduceat(self.grams[grams], start, axis=0)], 1)

    def read(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (words, windows, 2 * HIDDEN) over projected inputs ``x`` (words, 2, windows, 3 * HIDDEN); the second
        direction's inputs stand in reverse order, so both take their steps together."""
        u, half = self.dense["U"], np.float32(0.5)
        h = np.zeros((2, x.shape[2], HIDDEN), np.float32)
        out = np.empty((len(x), 2, x.shape[2], HIDDEN), np.float32)
        for t in range(len(x)):
            g = h @ u
            zr = x[t, :, :, :2 * HIDDEN] + g[:, :, :2 * HIDDEN]
            zr *= half
            np.tanh(zr, out=zr)
            zr *= half
            zr += half
            z, r = zr[:, :, :HIDDEN], zr[:, :, HIDDEN:]
            n = r * g[:, :, 2 * HIDDEN:]
            n += x[t, :, :, 2 * HIDDEN:]
            np.tanh(n, out=n)
            if keep is not None:
                keep.append((h, z, r, n, g[:, :, 2 * HIDDEN:]))
            h = out[t]
            np.subtract(keep[-1][0] if keep is not None else (out[t - 1] if t else 0), n, out=h)
            h *= z
            h += n
        return np.concatenate([out[:, 0], out[::-1, 1]], 2)

    def pool(self, states: np.ndarray, real: np.ndarray | None):
        """Attention over the words of each window (``real`` masks padding); logits and what backward needs."""
        k = np.tanh(states @ self.dense["A"])
        s = k @ self.dense["v"]
        if real is not None:
            s = np.where(real, s, np.float32(-30))
        a = np.exp(s - s.max(0))
        if real is not None:
            a = a * real
        a = a / np.maximum(a.sum(0), np.float32(1e-9))
        pooled = np.einsum("tb,tbh->bh", a, states)
        return pooled @ self.dense["o"] + self.dense["d"], (k, a, pooled)

    def states(self, x: np.ndarray, p: np.ndarray, at: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Both directions' states of every word beside its inputs ``x``; ``p`` are the inputs projected for each direction."""
        return np.concatenate([self.read(np.stack([p[0][at], p[1][at[::-1]]], 1), keep), x[at]], 2)

    def project(self, x: np.ndarray) -> np.ndarray:
        return x @ self.dense["W"] + self.dense["c"][:, None]

    def logits(self, x: np.ndarray, at: np.ndarray, real: np.ndarray | None) -> np.ndarray:
        """Logits of windows; ``x`` (words, 2 * WIDTH), ``at`` (WINDOW, windows) positions in it."""
        p = self.project(x)
        out = np.empty(at.shape[1], np.float32)
        for k in range(0, at.shape[1], BATCH):
            states = self.states(x, p, at[:, k:k + BATCH])
            out[k:k + BATCH] = self.pool(states, None if real is None else real[:, k:k + BATCH])[0]
        return out

    def score(self, top: np.ndarray) -> np.ndarray:
        """0 to 1 from the highest logit; LEAST at the cut."""
        return 1 / (1 + np.exp(-np.clip(self.slope * (top.astype(np.float64) - self.cut) + np.log(LEAST / (1 - LEAST)), -30, 30)))


def windows(counts: list[int]) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Word positions of all windows of texts that lie one after the other (texts of fewer words than WINDOW
    point to one padding position after the last), the mask of real words if any is padded, and each window's text."""
    starts, of, size, base = [], [], [], 0
    for k, n in enumerate(counts):
        s = starts_of(n)
        starts.append(s + base)
        of.append(np.full(len(s), k))
        size.append(np.full(len(s), min(n, WINDOW)))
        base += n
    start, size = np.concatenate(starts), np.concatenate(size)
    at = start[None] + np.arange(WINDOW)[:, None]
    if (size == WINDOW).all():
        return at, None, np.concatenate(of)
    real = np.arange(WINDOW)[:, None] < size[None]
    return np.where(real, at, base), real, np.concatenate(of)


# ---------------------------------------------------------------- fitting

def _backward(net: Network, x: np.ndarray, at: np.ndarray, real: np.ndarray | None, y: np.ndarray, weight: np.ndarray):
    """Gradients of the weighted logistic loss of windows, by dense weight and by input."""
    d, kept = net.dense, []
    g = {k: np.zeros_like(v) for k, v in d.items()}
    states = net.states(x, net.project(x), at, kept)
    xs = states[:, :, 2 * HIDDEN:]
    logit, (k, a, pooled) = net.pool(states, real)
    p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    e = (weight * (p - y)).astype(np.float32)
    g["o"], g["d"] = e @ pooled, e.sum(keepdims=True)
    dpool = e[:, None] * d["o"]
    da = (states * dpool).sum(2)
    dscore = a * (da - (a * da).sum(0))
    dk = dscore[:, :, None] * d["v"] * (1 - k * k)
    g["v"] = np.einsum("tb,tbk->k", dscore, k)
    g["A"] = np.einsum("tbh,tbk->hk", states, dk)
    ds = a[:, :, None] * dpool + dk @ d["A"].T
    dx = ds[:, :, 2 * HIDDEN:].copy()
    dboth = np.stack([ds[:, :, :HIDDEN], ds[::-1, :, HIDDEN:2 * HIDDEN]], 1)
    dh = np.zeros_like(dboth[0])
    for t in range(len(kept) - 1, -1, -1):
        h, z, r, n, gn = kept[t]
        dh = dh + dboth[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * gn * r * (1 - r)
        dp = np.concatenate([dz, dr, dn], 2)
        dg = np.concatenate([dz, dr, dn * r], 2)
        both = (t, len(kept) - 1 - t)
        g["U"] += h.transpose(0, 2, 1) @ dg
        g["c"] += dp.sum(1)
        for way in (0, 1):
            g["W"][way] += xs[both[way]].T @ dp[way]
            dx[both[way]] += dp[way] @ d["W"][way].T
        dh = dh * z + dg @ d["U"].transpose(0, 2, 1)
    return g, dx


class _Sample:
    """Texts of the sample as words of one list of distinct chunks."""

    def __init__(self, texts: list[bytes]):
        place: dict[bytes, int] = {}
        self.text = [np.array([place.setdefault(c, len(place)) for c in words_of(t)], np.int64) for t in texts]
        self.word, self.gram, self.start = rows_of(list(place) or [b""])
        self.size = np.diff(np.append(self.start, len(self.gram)))

    def some(self, chunks: np.ndarray):
        """Embedding rows of some chunks."""
        n = self.size[chunks]
        ends = np.cumsum(n)
        take = np.repeat(self.start[chunks] - (ends - n), n) + np.arange(int(ends[-1]))
        return self.word[chunks], self.gram[take], ends - n

    def excess(self, y: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By word row and by n-gram row, how many more of the texts that hold it are toxic than by chance, in standard deviations."""
        out = []
        for kind, size in (("word", WORDS), ("gram", GRAMS)):
            held = np.zeros((2, size), np.float64)
            for k in use.tolist():
                if len(self.text[k]):
                    rows = self.some(np.unique(self.text[k]))[0 if kind == "word" else 1]
                    held[y[k], np.unique(rows)] += 1
            share = np.bincount(y[use], minlength=2) / len(use)
            n = held.sum(0)
            more = (held[1] - n * share[1]) / np.sqrt(n * share[0] * share[1] + 1)
            out.append(np.clip(more, -8, 8).astype(np.float32) / 4)
        return tuple(out)


def _tops(net: Network, sample: _Sample, use: np.ndarray, hint: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For the texts ``use``, the highest logit and the place of its window (start).  ``hint`` asks the excess
    of the window's words instead, where the weights know nothing yet."""
    pool = net.embed((sample.word, sample.gram, sample.start))
    if hint:
        rank = np.maximum(pool[:, 0], 0) ** 2 + np.maximum(pool[:, WIDTH], 0) ** 2
    best, where = np.empty(len(use), np.float32), np.zeros(len(use), np.int64)
    for k in range(0, len(use), 200):
        some = use[k:k + 200].tolist()
        counts = [len(sample.text[i]) for i in some]
        x = np.concatenate([pool[sample.text[i]] for i in some] + [np.zeros((1, 2 * WIDTH), np.float32)])
        at, real, of = windows(counts)
        logit = np.append(np.concatenate([rank[sample.text[i]] for i in some]), 0)[at].sum(0) if hint else net.logits(x, at, real)
        for j in range(len(some)):
            own = np.flatnonzero(of == j)
            top = own[np.argmax(logit[own])]
            best[k + j], where[k + j] = logit[top], starts_of(counts[j])[top - own[0]]
    return best, where


def fit(texts: list[bytes], y: np.ndarray, rounds: int = 6, seed: int = 11) -> Network:
    """A network for labelled texts; without texts of both labels it scores everything LEAST / 2 or less.

    A quarter of the texts chooses the round and the cut; the others are descended on.
    """
    some = [k for k, t in enumerate(texts) if t.split()]
    texts, y = [texts[k] for k in some], np.asarray(y, np.int64)[some]
    net = Network.new(seed)
    if len(y) == 0 or y.min() == y.max():
        net.dense["o"][:] = 0
        net.cut = 2.0
        return net
    r = np.random.default_rng(seed)
    sample = _Sample(texts)
    test = np.concatenate([r.permutation(np.flatnonzero(y == c))[::4] for c in (0, 1)])
    train = np.setdiff1d(np.arange(len(y)), test)
    if len(np.unique(y[train])) < 2:
        train = np.arange(len(y))
    # a text's inputs never hold its own label: its fold reads the excess of the other folds
    fold = np.zeros(len(y), np.int64)
    for c in (0, 1):
        own = np.flatnonzero(y[train] == c)
        fold[train[own]] = np.arange(len(own)) % FOLDS
    excess = [sample.excess(y, train[fold[train] != k]) for k in range(FOLDS)] + [sample.excess(y, train)]

    def know(k: int) -> None:
        net.words[:, 0], net.grams[:, 0] = excess[k]

    share = np.bincount(y[train], minlength=2)
    weight = (len(train) / (2 * share[y])).astype(np.float32)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.dense.items()}
    spread = [np.full(len(t), 1e-8, np.float32) for t in (net.words, net.grams)]
    steps, best = 0, None
    size = 32
    rounds = max(rounds, min(30, -(-200 * size // len(train))))
    for turn in range(rounds):
        where = np.zeros(len(y), np.int64)
        for k in range(FOLDS):
            know(k)
            own = train[fold[train] == k]
            where[own] = _tops(net, sample, own, hint=turn == 0)[1]
        batches = [x for k in range(FOLDS) for x in _batches(r.permutation(train[fold[train] == k]), size)]
        for b in r.permutation(len(batches)).tolist():
            ids = batches[b]
            know(int(fold[ids[0]]))
            at, real = np.zeros((WINDOW, len(ids)), np.int64), np.zeros((WINDOW, len(ids)), bool)
            for j, (i, s) in enumerate(zip(ids.tolist(), where[ids].tolist())):
                own = sample.text[i][s:s + WINDOW]
                at[:len(own), j], real[:len(own), j] = own + 1, True
            chunks, at = np.unique(at, return_inverse=True)
            at = at.reshape(WINDOW, len(ids))
            pad = int(chunks[0] == 0)
            x = np.zeros((len(chunks), 2 * WIDTH), np.float32)
            if len(chunks) > pad:
                rows = sample.some(chunks[pad:] - 1)
                x[pad:] = net.embed(rows)
            g, dx = _backward(net, x, at, real, y[ids], weight[ids] / len(ids))
            steps += 1
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            for name, v in net.dense.items():
                m, s = moment[name]
                grad = g[name] * min(1.0, 1.0 / (norm + 1e-9))
                m += 0.1 * (grad - m)
                s += 0.001 * (grad * grad - s)
                v -= 0.01 * (m / (1 - 0.9 ** steps)) / (np.sqrt(s / (1 - 0.999 ** steps)) + 1e-7)
            if len(chunks) > pad:
                total = np.zeros_like(x)
                np.add.at(total, at.ravel(), dx.reshape(-1, 2 * WIDTH))
                _descend(net, rows, total[pad:], spread)
        know(FOLDS)
        top, _ = _tops(net, sample, test)
        loss = _loss(top, y[test])
        if best is None or loss < best[0]:
            best = (loss, net.words.copy(), net.grams.copy(), {k: v.copy() for k, v in net.dense.items()}, top)
    _, net.words, net.grams, net.dense, top = best
    net.cut, net.slope = _cut(top, y[test])
    return net


def _batches(ids: np.ndarray, size: int) -> list[np.ndarray]:
    return [ids[k:k + size] for k in range(0, len(ids), size)]


def _descend(net: Network, rows, dx: np.ndarray, spread: list[np.ndarray], rate: float = 0.004) -> None:
    """Steps of the embeddings but for their first column (by row, scaled by the squares so far); an n-gram moves
    where it was the largest."""
    word, grams, start = rows
    values = net.grams[grams]
    of = np.repeat(np.arange(len(word)), np.diff(np.append(start, len(grams))))
    largest = values == np.maximum.reduceat(values, start, axis=0)[of]
    for held, seen, ids, grad in ((net.words, spread[0], word, dx[:, :WIDTH]), (net.grams, spread[1], grams, largest * dx[of, WIDTH:])):
        rows_, inverse = np.unique(ids, return_inverse=True)
        total = np.zeros((len(rows_), WIDTH), np.float32)
        np.add.at(total, inverse, grad)
        total[:, 0] = 0                                  # the excess stay
        seen[rows_] += (total * total).mean(1)
        held[rows_] -= rate * total / np.sqrt(seen[rows_])[:, None]


def _loss(top: np.ndarray, y: np.ndarray) -> float:
    p = 1 / (1 + np.exp(-np.clip(top.astype(np.float64), -30, 30)))
    each = np.where(y == 1, -np.log(p + 1e-9), -np.log(1 - p + 1e-9))
    return float(sum(each[y == c].mean() for c in (0, 1) if (y == c).any()))


def _cut(top: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The logit that tells the labels apart with fewest mistakes (the middle of the widest such gap), and a slope."""
    s = np.sort(top.astype(np.float64))
    if len(s) < 2 or y.min() == y.max():
        return 0.0, 1.0
    mids = (s[1:] + s[:-1]) / 2
    wrong = np.array([((top >= m) & (y == 0)).sum() + ((top < m) & (y == 1)).sum() for m in mids])
    gaps = np.where(wrong == wrong.min(), s[1:] - s[:-1], -1)
    return float(mids[np.argmax(gaps)]), 1.0


# ---------------------------------------------------------------- scoring

class Scorer:
    """Scores texts; a worker's memo holds the inputs of the distinct chunks it has met."""

    def __init__(self, net: Network, memo: int = MEMO):
        self.net, self.most = net, memo
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.pool = np.zeros((1 << 12, 2 * WIDTH), np.float32)

    def _inputs(self, chunks: list[bytes]) -> np.ndarray:
        if len(self.place) > self.most:
            self._forget()
        found = list(map(self.place.get, chunks))
        if None in found:
            new = list({c for c, x in zip(chunks, found) if x is None})
            n = len(self.place)
            if n + len(new) > len(self.pool):
                more = np.zeros((max(2 * len(self.pool), n + len(new)), 2 * WIDTH), np.float32)
                more[:n] = self.pool[:n]
                self.pool = more
            for k in range(0, len(new), 5_000):
                some = new[k:k + 5_000]
                self.pool[n + k:n + k + len(some)] = self.net.embed(rows_of(some))
            self.place.update(zip(new, range(n, n + len(new))))
            found = list(map(self.place.__getitem__, chunks))
        return self.pool[np.array(found, np.int64)]

    def top(self, texts: list[bytes], most: int = 200_000) -> np.ndarray:
        """The highest logit over all windows of each text (none, -inf, without words); texts beyond ``most`` words are taken part by part,
        and parts share WINDOW words, so no window is left out."""
        out = np.full(len(texts), -np.inf, np.float32)
        for of, words in self._parts(texts, most):
            x = np.concatenate([self._inputs([c for ws in words for c in ws]), np.zeros((1, 2 * WIDTH), np.float32)])
            at, real, which = windows([len(ws) for ws in words])
            np.maximum.at(out, np.array(of)[which], self.net.logits(x, at, real))
        return out

    @staticmethod
    def _parts(texts: list[bytes], most: int) -> Iterator[tuple[list[int], list[list[bytes]]]]:
        of, words, size = [], [], 0
        for i, t in enumerate(texts):
            own = words_of(t)
            if not own:
                continue
            step = max(STRIDE, (most - WINDOW) // STRIDE * STRIDE)
            for k in range(0, max(1, len(own) - WINDOW), step):
                part = own[k:k + step + WINDOW]
                if words and size + len(part) > most:
                    yield of, words
                    of, words, size = [], [], 0
                of.append(i)
                words.append(part)
                size += len(part)
        if words:
            yield of, words


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> tuple[list[bytes], np.ndarray]:
    """Texts and labels of a bounded sample: of each label the ids with the least hash among those not held out, texts of
    up to ``SAMPLE_CHARS`` characters.  Labels other than 0 and 1, null ids and ids with both
    labels are left out; of several texts of an id the least counts."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .filter("toxic in (0, 1) and doc_id is not null").filter(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most").select("doc_id", "toxic"))
    # twice as many ids as wanted: some have no text, or a long one
    some = known.filter("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample[0]).unionAll(
        known.filter("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample[1]))
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
             .filter(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(some), "doc_id")      # a few thousand rows of two numbers
             .groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))
    rows = []
    for label, n in ((0, sample[1]), (1, sample[0])):     # bounded by the sample
        rows += texts.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()
    return [r["text"].encode() for r in rows], np.array([r["toxic"] for r in rows], np.int64)


def train(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> Network:
    return fit(*training_rows(docs, labels, sample))


_SCORERS: dict[str, Scorer] = {}


def scored(spark: SparkSession, docs: DataFrame, net: Network) -> DataFrame:
    """``doc_id, score`` of every row of ``docs``, from its whole text.

    Texts without words, null ones too, have the least score (under 1e-12); null ids and repeated rows are kept, have equal scores, other columns are ignored, an empty table gives no rows.
    """
    shipped, name = spark.sparkContext.broadcast(net), os.urandom(8).hex()      # 9 MB, fixed by the parameters

    def run(batches):
        if name not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[name] = Scorer(shipped.value)
        for rows, texts in text_groups(batches):
            score = shipped.value.score(_SCORERS[name].top(texts))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text of ``documents``, learned from ``labels.toxic`` of rows not held out; odd rows as in ``scored``."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scored(spark, docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                        (F.col("score") >= LEAST).cast("int").alias("predicted"))
