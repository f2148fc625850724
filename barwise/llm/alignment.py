"""Operator 13: alignment of two tokenizers over the same bytes, by merge-path partitioning.

A text's tokens under A and under B each cover all its bytes, so both lists of token ends are
sorted runs up to the same total.  Merging the two runs shows every overlap: each stretch between
neighbouring ends of the merged run lies in one A token and one B token (a *link*), and an end that
both have closes a *group*.  Diagonal binary searches cut the merge into pieces of equal work that
need nothing of each other; groups that reach over a piece's border are stitched afterwards.

Corpus-wide counts of linked id pairs never meet in one place: a *block* of documents (one
bounded slice of a task's input) sums its own pairs, the blocks' sums are added up by pair in a
shuffle, and each block takes back the counts of its own pairs.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwise.llm.common import prepare, table, text_groups, tokenizer_bytes, written
from barwise.llm.lexicon import _byte_of_char

#: Ends (of A and B together) that one piece of a merge holds.
PIECE = 1 << 15
#: Text worked on at once, in bytes; longer texts are taken in spans cut before white space.
SPAN = 1 << 20
#: Text of one block of documents, in bytes (a longer document is a block of its own).
BLOCK_BYTES = 24 << 20
#: Chunks a worker remembers at most; it bears on time only.
MEMO = 400_000

#: Bits of an id pair (vocabularies of up to a million entries each).
PAIR_BITS = 40

#: White space other than a space and a newline; texts with it are cut with more care.
_OTHER_SPACE = re.compile(r"[^\S \n]")
_CHUNK = re.compile(r"[ \n]+[^ \n]*")
#: Before a space or newline that follows no white space neither tokenizer joins anything.
_SAFE_CUT = re.compile(r"(?<=\S)(?=[ \n])")


def diagonals(a: np.ndarray, b: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every number of steps k the pair (i, j), i + j = k, so that ``a[:i]`` and ``b[:j]`` are
    the k least of both sorted runs (of equal values those of ``a`` come first)."""
    low, high = np.maximum(0, steps - len(b)), np.minimum(steps, len(a))
    while (todo := low < high).any():
        mid = (low[todo] + high[todo]) // 2
        more = a[mid] <= b[steps[todo] - mid - 1]
        low[todo] = np.where(more, mid + 1, low[todo])
        high[todo] = np.where(more, high[todo], mid)
    return low, steps - low


def overlaps(a: np.ndarray, b: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One piece of a merge: positions in ``a`` and ``b`` of the tokens that overlap, and how many
    ends of each run are passed where both have one.  ``before`` is the end just before the piece."""
    ends = np.concatenate([a, b])
    ends.sort(kind="stable")
    ends = ends[np.diff(ends, prepend=before) > 0]
    at, bt = np.searchsorted(a, ends), np.searchsorted(b, ends)
    both = np.zeros(len(ends), bool)
    inside = (at < len(a)) & (bt < len(b))
    both[inside] = a[at[inside]] == b[bt[inside]]
    return at, bt, at[both] + 1, bt[both] + 1


def align(a: np.ndarray, b: np.ndarray, piece: int = PIECE):
    """Links and groups of two runs of token ends with the same last end.

    Returns the token positions of every link (two arrays, in text order) and, for every
    group, the number of A and of B tokens up to its end.
    """
    steps = np.arange(0, len(a) + len(b), piece)
    i, j = diagonals(a, b, steps)
    # an end of both stays on one side of a border
    tied = (i > 0) & (j < len(b))
    tied[tied] = a[i[tied] - 1] == b[j[tied]]
    i, j = np.append(i, len(a)), np.append(j + tied, len(b))
    found = []
    for k in range(len(steps)):
        before = max(a[i[k] - 1] if i[k] else 0, b[j[k] - 1] if j[k] else 0)
        la, lb, ga, gb = overlaps(a[i[k]:i[k + 1]], b[j[k]:j[k + 1]], before)
        found.append((la + i[k], lb + j[k], ga + i[k], gb + j[k]))
    # a piece's first group may have begun in an earlier piece: only the ends are needed to stitch
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4


class Twin:
    """Both tokenizers of one worker, asked once per distinct chunk.

    A chunk begins at a space or newline that follows no white space and reaches to the next such place;
    no token of either tokenizer crosses it (checked for B when its pieces are read: none
    holds a newline, or a space anywhere but at its start).
    """

    def __init__(self, a_json: bytes, b_model: bytes, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json.decode())
        self.a.no_padding()
        self.a.no_truncation()
        self.a.encode_special_tokens = True
        vocab = self.a.get_vocab(with_added_tokens=True)
        chars = _byte_of_char()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        kind = json.loads(a_json).get("pre_tokenizer") or {}
        self.cuts = (kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not json.loads(a_json).get("normalizer")
                     and len(self.b.encode("x")) == 1
                     and not any(b"\n" in p and len(p) > 1 or b" " in p.lstrip(b" ") for p in self.b_bytes))
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        self.lead = len(self.b.encode("x"))
        self.most = memo
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.pool = [[np.zeros(0, np.int32)], [np.zeros(0, np.int32)]]
        self.size = [[], []]
        self.good: list[bool] = []
        self.flat = None

    def chunks(self, text: str) -> list[str]:
        """Chunks of a space and the text, joined they are it; one chunk if none may be cut."""
        if not self.cuts:
            return [" " + text]
        if _OTHER_SPACE.search(text):
            return _SAFE_CUT.split(" " + text)
        return _CHUNK.findall(" " + text)

    def whole(self, spaced: str) -> tuple[list[int], list[int]]:
        """ids of A and B of a space and a text, by the libraries."""
        return (self.a.encode_batch_fast([spaced], add_special_tokens=False)[0].ids, self.b.encode(spaced[1:], num_threads=1))

    def _one(self, chunk: str) -> tuple[list[int], list[int]]:
        if not self.cuts:
            return self.whole(chunk)
        a = self.a.encode_batch_fast([chunk], add_special_tokens=False)[0].ids
        return a, self.b.encode("x" + chunk, num_threads=1)[self.lead:]

    def _learn(self, new: list[str]) -> None:
        """Ask for chunks not seen: many at a time where each ends without white space, cut again by bytes."""
        plain = [c for c in new if self.cuts and c[-1:] > " " and not c[-1].isspace()]
        rest = set(new).difference(plain) if len(plain) < len(new) else ()
        for k in range(0, len(plain), 500):
            some = plain[k:k + 500]
            joined = "".join(some)
            ids = (np.array(self.a.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int32),
                   np.array(self.b.encode("x" + joined, num_threads=1)[self.lead:], np.int32))
            sizes = np.array([len(c.encode()) for c in some])
            cuts = [self._cut(x, n, sizes) for x, n in zip(ids, (self.a_len, self.b_len))]
            text = joined.encode()
            if any(c is None for c in cuts) or any(b"".join(map(p.__getitem__, x.tolist())) != text
                                                   for p, x in zip((self.a_bytes, self.b_bytes), ids)):
                rest = [*rest, *some]
                continue
            self._keep(some, ids, cuts, [True] * len(some))
        for c in rest:
            a, b = (np.array(x, np.int32) for x in self._one(c))
            good = all(b"".join(map(p.__getitem__, x.tolist())) == c.encode()
                       for p, x in ((self.a_bytes, a), (self.b_bytes, b)))
            self._keep([c], (a, b), ([len(a)], [len(b)]), [good])

    @staticmethod
    def _cut(ids: np.ndarray, length: np.ndarray, sizes: np.ndarray) -> np.ndarray | None:
        """Number of ids of each chunk, or none if a token reaches over a chunk's end."""
        ends, want = np.cumsum(length[ids]), np.cumsum(sizes)
        at = np.searchsorted(ends, want)
        if not len(ends) or at[-1] != len(ends) - 1 or (ends[at] != want).any():
            return None
        return np.diff(at + 1, prepend=0)

    def _keep(self, chunks, ids, sizes, good) -> None:
        n = len(self.good)
        self.place.update(zip(chunks, range(n, n + len(chunks))))
        for k in (0, 1):
            self.pool[k].append(ids[k])
            self.size[k].extend(np.asarray(sizes[k]).tolist())
        self.good.extend(good)
        self.flat = None

    def _pools(self):
        if self.flat is None:
            self.pool = [[np.concatenate(p)] for p in self.pool]
            sizes = [np.array(s, np.int64) for s in self.size]
            self.flat = [(p[0], np.cumsum(s) - s, s) for p, s in zip(self.pool, sizes)] + [np.array(self.good, bool)]
        return self.flat

    def encode(self, chunks: list[str]):
        """(ids of A, number in each chunk), (ids of B, number in each chunk), which chunks kept their bytes."""
        if len(self.good) > self.most:
            self._forget()
        found = list(map(self.place.get, chunks))
        if None in found:
            self._learn(list({c for c, x in zip(chunks, found) if x is None}))
            found = list(map(self.place.__getitem__, chunks))
        at = np.array(found, np.int64)
        a, b, good = self._pools()
        return _gather(*a, at), _gather(*b, at), good[at]


def _gather(pool, start, size, at):
    n = size[at]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(start[at] - (ends - n), n) + np.arange(total)], n


def _digits(count: int) -> np.ndarray:
    """Rows of five ASCII digits (zero bytes in front) and a place for the separator."""
    width = max(5, len(str(max(0, count - 1))))
    out = np.zeros((count, width + 1), np.uint8)
    n = np.arange(count)
    for k in range(width):
        tens = 10 ** (width - 1 - k)
        out[:, k] = np.where((n >= tens) | (tens == 1), 48 + n // tens % 10, 0)
    return out


class Writer:
    """The text form of groups, ``a1,a2|b1;a3|b2,b3``, every group ended by ``;``."""

    def __init__(self, count: int):
        self.digits = _digits(count)
        self.lengths = (self.digits != 0).sum(1) + 1

    def write(self, a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all groups, and where each group's bytes end."""
        na, nb = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        out = np.empty(len(a) + len(b), np.int32)
        mark = np.full(len(out), ord(","), np.uint8)
        out[np.arange(len(a)) + np.repeat(to_b - nb, na)] = a
        out[np.arange(len(b)) + np.repeat(to_a, nb)] = b
        mark[to_a + to_b - nb - 1] = ord("|")
        mark[to_a + to_b - 1] = ord(";")
        rows = self.digits[out]
        rows[:, -1] = mark
        flat = rows.ravel()
        return flat[flat != 0], np.cumsum(self.lengths[out])[to_a + to_b - 1]


#: One row a document: its block, its own numbers, and its distinct linked id pairs with their numbers.
ALIGNED = ("block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
           "groups_sha256 string, n_pairs long, pairs binary, times binary")


def _summed(codes: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order and how often each is there."""
    if times is None:
        codes = np.sort(codes)
        times = np.ones(len(codes), np.int64)
    else:
        order = np.argsort(codes, kind="stable")
        codes, times = codes[order], times[order]
    first = np.flatnonzero(np.diff(codes, prepend=codes[:1] - 1) != 0) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(times, first) if len(first) else times


def _packed(codes: np.ndarray, times: np.ndarray) -> tuple[bytes, bytes]:
    """Gaps between sorted codes, byte plane by byte plane, and times, both compressed."""
    gaps = np.diff(codes, prepend=0).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return pa.compress(gaps, "zstd", asbytes=True), pa.compress(times.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(data, 8 * n, "zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view("<i8").ravel()


def _spans(chunks: list[str], limit: int) -> Iterator[list[str]]:
    start = size = 0
    for k, c in enumerate(chunks):
        size += len(c)
        if size >= limit:
            yield chunks[start:k + 1]
            start, size = k + 1, 0
    if start < len(chunks):
        yield chunks[start:]


class Aligner:
    """Aligns texts, many short ones at once and a long one in spans."""

    def __init__(self, a_json: bytes, b_model: bytes, memo: int = MEMO):
        self.twin = Twin(a_json, b_model, memo)
        self.wide = len(self.twin.b_bytes)
        if len(self.twin.a_bytes) * self.wide > 1 << PAIR_BITS:
            raise ValueError("vocabularies too large: an id pair must fit PAIR_BITS")
        self.writer = Writer(max(len(self.twin.a_bytes), self.wide))

    def _align(self, a, b):
        ends = np.cumsum(self.twin.a_len[a]), np.cumsum(self.twin.b_len[b])
        la, lb, to_a, to_b = align(*ends)
        return a[la].astype(np.int64) * self.wide + b[lb], la, to_a, to_b

    def short(self, texts: list[str]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, sha256, codes, times) of each text; texts without tokens are all zeros."""
        cut = [self.twin.chunks(t) if t else [] for t in texts]
        (a, na), (b, nb), good = self.twin.encode([c for cs in cut for c in cs])
        n = np.array([len(c) for c in cut])
        of = np.repeat(np.arange(len(texts)), n)
        bad = np.bincount(of[~good], minlength=len(texts)) > 0
        out = [(0, 0, 0, 0, "", b"", b"", 0)] * len(texts)
        for k in np.flatnonzero(bad).tolist():
            out[k] = self.long(texts[k])
        if bad.any():
            stays = ~bad[of]
            a, b = a[np.repeat(stays, na)], b[np.repeat(stays, nb)]
            na, nb, of = na[stays], nb[stays], of[stays]
        if not len(of):
            return out
        codes, la, to_a, to_b = self._align(a, b)
        text, ends = self.writer.write(a, b, to_a, to_b)
        raw = text.tobytes()
        per = [np.bincount(of, weights=x, minlength=len(texts)).astype(np.int64) for x in (na, nb)]
        last_a, some = np.cumsum(per[0]), np.flatnonzero(per[0])
        link_to = np.searchsorted(la, last_a)             # links of a text's tokens stand together
        group_to = np.searchsorted(to_a, last_a, "right")
        # every text's distinct pairs by one sort
        doc_of = np.repeat(np.arange(len(texts)), np.diff(link_to, prepend=0))
        keyed, times = _summed((doc_of << PAIR_BITS) + codes)
        to = np.searchsorted(keyed, (np.arange(len(texts)) + 1) << PAIR_BITS)
        for k in some.tolist():
            g0, l0, p0 = (group_to[k - 1], link_to[k - 1], to[k - 1]) if k else (0, 0, 0)
            start = int(ends[g0 - 1]) if g0 else 0
            sha = hashlib.sha256(raw[start:int(ends[group_to[k] - 1]) - 1]).hexdigest()
            pairs = keyed[p0:to[k]] - (k << PAIR_BITS)
            out[k] = (int(per[0][k]), int(per[1][k]), int(group_to[k] - g0), int(link_to[k] - l0), sha, pairs, times[p0:to[k]], 1)
        return out

    def long(self, text: str, span: int = SPAN) -> tuple:
        """As ``short`` for one text, span after span; bytes are compared as a whole where a chunk's differ."""
        sums = np.zeros(4, np.int64)
        digest, first = hashlib.sha256(), True
        codes, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for some in _spans(self.twin.chunks(text), span):
            (a, _), (b, _), good = self.twin.encode(some)
            if not good.all():
                return self._uneven(text)
            found, _, to_a, to_b = self._align(a, b)
            raw = self.writer.write(a, b, to_a, to_b)[0].tobytes()
            digest.update(raw[:-1] if first else b";" + raw[:-1])
            first = False
            sums += [len(a), len(b), len(to_a), len(found)]
            more = _summed(found)
            codes, times = _summed(np.concatenate([codes, more[0]]), np.concatenate([times, more[1]]))
        return (*map(int, sums), digest.hexdigest(), codes, times, 1)

    def _uneven(self, text: str) -> tuple:
        """A text of which some chunk's bytes differ: tokens count only if all its bytes agree."""
        a, b = (np.array(x, np.int64) for x in self.twin.whole(" " + text))
        want = (" " + text).encode()
        if any(b"".join(map(p.__getitem__, x.tolist())) != want for p, x in ((self.twin.a_bytes, a), (self.twin.b_bytes, b))):
            return (0, 0, 0, 0, "", b"", b"", 0)
        codes, _, to_a, to_b = self._align(a, b)
        raw = self.writer.write(a, b, to_a, to_b)[0].tobytes()[:-1]
        return (len(a), len(b), len(to_a), len(codes), hashlib.sha256(raw).hexdigest(), *_summed(codes), 1)


_ALIGNERS: dict[tuple, Aligner] = {}


def aligner(a_json: bytes, b_model: bytes) -> Aligner:
    """The worker's aligner; Spark reuses Python workers, so its memo outlives a task."""
    key = (hash(a_json), hash(b_model))
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(a_json, b_model)
    return _ALIGNERS[key]


def aligned(spark: SparkSession, docs: DataFrame, a_json: bytes, b_model: bytes) -> DataFrame:
    """``docs (doc_id, text)`` aligned, a row a document (``ALIGNED``), and for every block a row
    without sha whose pairs are the block's sums.

    Null and empty texts, and texts whose bytes a tokenizer changes, have no tokens.  Null ids and
    repeated rows are kept, other columns ignored; an empty table gives no rows.
    """
    shipped = spark.sparkContext.broadcast((a_json, b_model))      # two vocabulary files, a few MB
    names = [f.split()[0] for f in ALIGNED.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.string(), pa.int64(), pa.binary(), pa.binary()]

    def rows_of(block, ids, found):
        cells = [_packed(x[5], x[6]) if x[7] else (b"", b"") for x in found]
        counts = [np.array([x[k] for x in found], np.int64) for k in range(4)]
        return pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(
                ([block] * len(found), ids, *counts, [x[4] for x in found], [len(x[5]) for x in found],
                 [c[0] for c in cells], [c[1] for c in cells]), kinds)], names=names)

    def total(block, held):
        codes, times = _summed(*(np.concatenate(x) for x in zip(*held)))
        pairs, counts = _packed(codes, times)
        return pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in zip((block, None, 0, 0, 0, 0, None, len(codes), pairs, counts), kinds)], names=names)

    def run(batches):
        work = aligner(*shipped.value)
        part, k, size, held = TaskContext.get().partitionId(), 0, 0, []
        for rows, texts in text_groups(batches, limit=SPAN):
            block = (part << 32) + k
            if len(texts) == 1 and len(texts[0]) > SPAN:
                found = [work.long(texts[0].decode())]
            else:
                found = work.short([t.decode() for t in texts])
            yield rows_of(block, rows.column("doc_id").to_pylist(), found)
            if some := [(x[5], x[6]) for x in found if x[7]]:
                held.append(tuple(np.concatenate(x) for x in zip(*some)))
            if len(held) >= 8:
                held = [_summed(*(np.concatenate(x) for x in zip(*held)))]
            size += sum(map(len, texts))
            if size >= BLOCK_BYTES:
                if held:
                    yield total(block, held)
                k, size, held = k + 1, 0, []
        if held:
            yield total((part << 32) + k, held)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, ALIGNED)


def _block_pairs(blocks: DataFrame) -> DataFrame:
    """``(block, pair, n)`` of the blocks' rows."""
    def run(batches):
        for batch in batches:
            for block, n, pairs, times in zip(*(batch.column(c).to_pylist() for c in ("block", "n_pairs", "pairs", "times"))):
                codes, counts = np.cumsum(_unpacked(pairs, n)), _unpacked(times, n)
                for k in range(0, n, 1 << 16):
                    c = codes[k:k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(c), block)), pa.array(c), pa.array(counts[k:k + (1 << 16)])],
                        names=["block", "pair", "n"])

    return blocks.select("block", "n_pairs", "pairs", "times").mapInArrow(run, "block long, pair long, n long")


def pair_counts(blocks: DataFrame, wide: int) -> DataFrame:
    """``(pair, total, best)``: links of an id pair in all documents, and whether no other A id
    has more with its B id.  ``pair`` is A id * ``wide`` + B id."""
    total = blocks.groupBy("pair").agg(F.sum("n").alias("total"))
    # A partners of a B id are at most the vocabulary of A
    most = Window.partitionBy(F.col("pair") % wide)
    return total.select("pair", "total", (F.col("total") == F.max("total").over(most)).alias("best"))


def _with_counts(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows of documents with ``n_best`` and ``count_sum`` from the counts of their block's pairs."""
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pair, total, best = (right.column(c).to_numpy() for c in ("pair", "total", "best"))
        order = np.argsort(pair)
        pair, total, best = pair[order], total[order], best[order]
        sums, bests = [], []
        for n, pairs, times in zip(*(left.column(c).to_pylist() for c in ("n_pairs", "pairs", "times"))):
            at = np.searchsorted(pair, np.cumsum(_unpacked(pairs, n)))
            t = _unpacked(times, n)
            sums.append(int((t * total[at]).sum()))
            bests.append(int(t[best[at]].sum()))
        cols = {c: left.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
        cols |= {"n_best": pa.array(bests, pa.int64()), "count_sum": pa.array(sums, pa.int64())}
        return pa.table({f.split()[0]: cols[f.split()[0]] for f in schema.split(", ")})

    return docs.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(run, schema)


def alignment(spark: SparkSession, docs: DataFrame, a_json: bytes, b_model: bytes) -> DataFrame:
    """Per document n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 (see ``aligned`` for odd rows)."""
    import sentencepiece
    wide = sentencepiece.SentencePieceProcessor(model_proto=b_model).get_piece_size()
    found = written(spark, aligned(spark, docs, a_json, b_model), "aligned")
    blocks = _block_pairs(found.filter("groups_sha256 is null"))
    counts = blocks.join(pair_counts(blocks, wide), "pair").select("block", "pair", "total", "best")
    plain = found.filter("groups_sha256 is not null")
    none = plain.filter("n_a = 0").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.lit(0).cast("long").alias("n_best"),
                                          F.lit(0).cast("long").alias("count_sum"), "groups_sha256")
    return _with_counts(plain.filter("n_a > 0"), counts).unionByName(none)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` under ``byte_bpe_50k.json`` (A) and ``piece_bpe_32k.model`` (B); odd rows as in ``aligned``."""
    import public_tokenizers
    prepare(spark)
    return alignment(spark, table(spark, sf_dir, "documents"), tokenizer_bytes(public_tokenizers.path("byte_bpe_50k.json")),
                     tokenizer_bytes(public_tokenizers.path("piece_bpe_32k.model")))
