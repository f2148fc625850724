"""Operator 3: byte-level BPE encoding and decoding through a lexicon automaton.

The corpus' frequent units (a word with the one space before it, its tail of punctuation, or a
run of white space) are compiled, with the token ids of each, into a minimal acyclic automaton
that shares suffixes.  Every edge carries the number of words that sort before it, so a walk
gives a word's rank, and the rank its ids.  Executors map the file into memory and walk all
distinct units of a group of texts together; units that the automaton does not hold are
merged by the tokenizers library itself.  The choice of words affects time, never ids.
"""

from __future__ import annotations

import gc
import hashlib
import json
import mmap
import os
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwise.llm.chunks import TAIL, plain_end
from barwise.llm.common import prepare, shared_file, table, text_slices, tokenizer_bytes, written

#: Words compiled into the automaton at most: the most frequent of the whole corpus (of words
#: that tie at the limit, none).
LEXICON_WORDS = 65_536
#: Chunks seen less often than this are not compiled.
LEAST_COUNT = 2
#: Chunks a counting task holds before it hands them on; bounds its memory, not the counts.
COUNT_HELD = 400_000

# A byte-level pre-token never spans the border before a run of white space whose last space
# goes with the next word; these are the coarsest pieces whose ids do not depend on context.
CHUNK = re.compile(rb" ?[^\t-\r ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
# Where a space stands beside other white space, a text is not cut at its spaces alone.
SPACED = re.compile(rb"[\t-\r]")
SPACES = r"[\t-\r ] | [\t-\r]"
# White space beyond ASCII (and the four separators that some engines count as such): a text
# that holds any is encoded whole.
OTHER_SPACE = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def numbered_runs(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct runs of chunks, the number of each run of the texts in order, and the borders
    of the texts in it.  A run is a piece between two spaces (with the space before it) or,
    for texts with other spacing, one chunk."""
    odd = pc.match_substring_regex(texts, SPACES).to_numpy(zero_copy_only=False)
    plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
    split = pc.split_pattern(plain, " ")
    offsets = split.offsets.to_numpy().astype(np.int64)
    pieces = split.flatten()
    inner = pieces.dictionary_encode()
    first = pieces.take(pa.array(offsets[:-1])).dictionary_encode()
    runs = pc.binary_join_element_wise("", inner.dictionary, " ").cast(pa.binary()).to_pylist()
    place = inner.indices.to_numpy().astype(np.int64)
    place[offsets[:-1]] = first.indices.to_numpy() + len(runs)
    runs += first.dictionary.cast(pa.binary()).to_pylist()
    if not odd.any():
        return runs, place, offsets
    # texts with other spacing: their chunks one by one, in their places
    number: dict[bytes, int] = {}
    parts = []
    for i, o in enumerate(odd.tolist()):
        if o:
            parts.append(np.array([number.setdefault(c, len(number)) for c in CHUNK.findall(texts[i].as_py().encode())],
                                  np.int64) + len(runs))
        else:
            parts.append(place[offsets[i]:offsets[i + 1]])
    return runs + list(number), np.concatenate(parts), np.cumsum([0, *map(len, parts)])


def units(run: bytes) -> tuple[bytes, ...]:
    """A run's chunks, a word's tail of ASCII punctuation apart: these are pre-tokens of their
    own after a letter or digit.  The ids of a run are those of its units in order."""
    if SPACED.search(run, 1) or run[:1].isspace() and len(run) == 1:
        return tuple(u for c in CHUNK.findall(run) for u in _word(c))
    return _word(run)


def _word(chunk: bytes) -> tuple[bytes, ...]:
    stem = chunk.rstrip(TAIL)
    if len(stem) == len(chunk) or not plain_end(stem):
        return (chunk,)
    return stem, chunk[len(stem):]


def spread(pool: np.ndarray, at: np.ndarray, size: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries ``place`` of a pool of entries (start, size), in a row, and their ends."""
    n = size[place]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(at[place] - (ends - n), n) + np.arange(total)], ends


# ---------------------------------------------------------------- automaton

_PARTS = [("edge", "<i8"), ("target", "<i4"), ("skip", "<i4"), ("final", "|u1"), ("offset", "<i4"), ("ids", "<u4")]


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The automaton of ``words`` (word -> ids) as one block of bytes for ``Lexicon``.

    Words are added in order; a state is frozen once no later word can pass it, and frozen
    states with equal endings and edges are one state.
    """
    register: dict[tuple, int] = {}
    states: list[tuple] = []
    holds: list[int] = []                      # words below a state

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
            holds.append(node[0] + sum(holds[t] for _, t in node[1]))
        return register[key]

    path: list[list] = [[0, []]]               # open states along the last word
    last = b""
    order = sorted(w for w in words if w)
    for word in order:
        same = len(os.path.commonprefix([last, word]))
        while len(path) > same + 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], freeze(node)))
        path.extend([0, []] for _ in word[same:])
        path[-1][0] = 1
        last = word
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((last[len(path) - 1], freeze(node)))
    root = freeze(path[0])
    edge, target, skip = [], [], []
    for i, (final, edges) in enumerate(states):
        before = final
        for byte, t in edges:
            edge.append(i << 8 | byte)
            target.append(t)
            skip.append(before)
            before += holds[t]
    sizes = [len(words[w]) for w in order]
    parts = {"edge": edge, "target": target, "skip": skip, "final": [s[0] for s in states],
             "offset": np.concatenate([[0], np.cumsum(sizes)]) if sizes else [0],
             "ids": [i for w in order for i in words[w]]}
    arrays = [np.asarray(parts[n], t) for n, t in _PARTS]
    head = json.dumps({"root": root, "lengths": [len(a) for a in arrays]}).encode().ljust(256)
    return head + b"".join(a.tobytes().ljust(-(-a.nbytes // 8) * 8, b"\0") for a in arrays)


class Lexicon:
    """A compiled automaton, mapped into memory from its file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        head = json.loads(data[:256])
        self.root, at = head["root"], 256
        for (name, kind), n in zip(_PARTS, head["lengths"]):
            setattr(self, name, np.frombuffer(data, kind, n, at))
            at += -(-n * np.dtype(kind).itemsize // 8) * 8

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word among the lexicon's, -1 for words it does not hold; all words
        take a step together."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.edge) or not words:
            return out
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size) - size
        text = np.frombuffer(b"".join(words), np.uint8)
        live = np.flatnonzero(size > 0)
        state, rank, step = np.full(len(live), self.root, np.int64), np.zeros(len(live), np.int64), 0
        while len(live):
            key = state << 8 | text[start[live] + step]
            at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            ok = self.edge[at] == key
            live, at = live[ok], at[ok]
            state, rank = self.target[at].astype(np.int64), rank[ok] + self.skip[at]
            step += 1
            done = size[live] == step
            ended = done & (self.final[state] == 1)
            out[live[ended]] = rank[ended]
            live, state, rank = live[~done], state[~done], rank[~done]
        return out

    def word_ids(self, rank: int) -> bytes:
        return self.ids[self.offset[rank]:self.offset[rank + 1]].tobytes()


# ---------------------------------------------------------------- codec of a worker

def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the
    characters from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Exact encoding and decoding of whole texts by one byte-level tokenizer.

    ``memo`` bounds the remembered chunks; a full memo is emptied.
    """

    def __init__(self, tokenizer_json: bytes, lexicon: Lexicon | None, memo: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        config = json.loads(tokenizer_json)
        pre = config.get("pre_tokenizer") or {}
        if (config["model"]["type"] != "BPE" or config.get("normalizer") or pre.get("type") != "ByteLevel"
                or pre.get("add_prefix_space") or not pre.get("use_regex", True)):
            raise ValueError("a byte-level BPE tokenizer without normaliser or prefix space is needed")
        self.lib = Tokenizer.from_str(tokenizer_json.decode())
        self.lib.no_padding()
        self.lib.no_truncation()
        self.lexicon = lexicon
        self.specials = [t["content"] for t in config.get("added_tokens", [])]
        chars = _byte_of_char()
        count = self.lib.get_vocab_size(with_added_tokens=True)
        pieces = [b""] * count
        for token, i in self.lib.get_vocab(with_added_tokens=True).items():
            pieces[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()
        self.pieces = self._pool(pieces)
        self.decimal = self._pool([b"%d," % i for i in range(count)])
        self.memo: dict[bytes, bytes] = {}       # of runs
        self.units: dict[bytes, bytes] = {}
        self.most = memo

    @staticmethod
    def _pool(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.array([len(e) for e in entries], np.int64)
        return np.frombuffer(b"".join(entries), np.uint8), np.cumsum(size) - size, size

    def _ask(self, texts: list[bytes]) -> list[bytes]:
        out = []
        for k in range(0, len(texts), 20_000):
            got = self.lib.encode_batch_fast([t.decode() for t in texts[k:k + 20_000]], add_special_tokens=False)
            out += [np.array(e.ids, "<u4").tobytes() for e in got]
        return out

    def merge(self, chunks: list[bytes]) -> list[bytes]:
        """ids of unseen chunks by the library.  Those that are a space and a word keep their
        ids side by side, so many are merged as one text and cut by their bytes."""
        words = [c for c in chunks if len(c) > 1 and c[:1] == b" " and c[1:2] not in b"\t\n\x0b\x0c\r "]
        held = dict(zip(rest := list(set(chunks).difference(words)), self._ask(rest)))
        for k in range(0, len(words), 1_000):
            some = words[k:k + 1_000]
            ids = np.frombuffer(self._ask([b"".join(some)])[0], "<u4")
            ends = np.cumsum(self.pieces[2][ids])
            want = np.cumsum([len(w) for w in some])
            cuts = np.searchsorted(ends, want)
            if len(ends) and cuts[-1] < len(ends) and (ends[cuts] == want).all():
                flat, at = ids.tobytes(), (4 * (cuts + 1)).tolist()
                held.update((w, flat[a:b]) for w, a, b in zip(some, [0, *at], at))
            else:
                held.update(zip(some, self._ask(some)))
        return [held[c] for c in chunks]

    def _learn(self, runs: list[bytes]) -> dict[bytes, bytes]:
        """ids of new runs: of their units, remembered, the automaton's, or merged."""
        if len(self.units) > self.most:
            self.units.clear()
        cut = list(map(units, runs))
        new = list(set().union(*cut).difference(self.units))
        if self.lexicon is not None:
            ranks = self.lexicon.ranks(new)
            for i in np.flatnonzero(ranks >= 0).tolist():
                self.units[new[i]] = self.lexicon.word_ids(ranks[i])
            new = [new[i] for i in np.flatnonzero(ranks < 0).tolist()]
        self.units.update(zip(new, self.merge(new)))
        known = self.units
        return {r: known[c[0]] if len(c) == 1 else b"".join([known[u] for u in c]) for r, c in zip(runs, cut)}

    def _whole(self, texts: pa.Array) -> np.ndarray:
        """Which texts must be asked whole: special tokens, or white space beyond ASCII."""
        odd = pc.match_substring_regex(texts, OTHER_SPACE).to_numpy(zero_copy_only=False)
        for s in self.specials:
            odd = odd | pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        return odd

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts (strings without nulls) in a row, and the number of each."""
        whole = self._whole(texts)
        if not whole.any():
            return self._by_chunk(texts)
        parts = [np.frombuffer(self._ask([texts[i].as_py().encode()])[0], "<u4") if w
                 else self._by_chunk(texts.slice(i, 1))[0] for i, w in enumerate(whole.tolist())]
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def _by_chunk(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.memo) > self.most:
            self.memo.clear()
        runs, place, borders = numbered_runs(texts)
        found = list(map(self.memo.get, runs))
        gaps = [i for i, x in enumerate(found) if x is None]
        self.memo.update(self._learn(list({runs[i] for i in gaps})))
        for i in gaps:
            found[i] = self.memo[runs[i]]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, ends = spread(np.frombuffer(b"".join(found), "<u4"), np.cumsum(size) - size, size, place)
        return flat, np.diff(np.concatenate([[0], ends])[borders])

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8; bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(spread(*self.pieces, ids[k:k + (1 << 20)].astype(np.int64))[0].tobytes()
                       for k in range(0, len(ids), 1 << 20))
        return raw.decode("utf-8", "replace").encode()

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return b"".join(spread(*self.decimal, ids[k:k + (1 << 20)].astype(np.int64))[0].tobytes()
                        for k in range(0, len(ids), 1 << 20))[:-1]


_CODECS: dict[str, Codec] = {}


def _codec(file: str | None, tokenizer_json: bytes, memo: int = 250_000) -> Codec:
    key = f"{file}-{hash(tokenizer_json)}-{memo}"
    if key not in _CODECS:
        _CODECS.clear()
        gc.set_threshold(200_000, 20, 20)     # millions of small objects here, and no cycles
        _CODECS[key] = Codec(tokenizer_json, Lexicon(SparkFiles.get(file)) if file else None, memo)
    return _CODECS[key]


# ---------------------------------------------------------------- Spark side

def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def count_units(docs: DataFrame) -> DataFrame:
    """``(chunk, n)``: units of all texts: counted inside tasks first, then by one shuffle."""
    def count(batches):
        held: Counter = Counter()
        schema = pa.schema([("chunk", pa.binary()), ("n", pa.int64())])

        def rows():
            keys = list(held)
            for k in range(0, len(keys), 50_000):
                some = keys[k:k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()),
                                                  pa.array([held[c] for c in some], pa.int64())], schema=schema)
            held.clear()

        for _, texts in text_slices(batches):
            runs, place, _ = numbered_runs(texts)
            for run, n in zip(runs, np.bincount(place, minlength=len(runs)).tolist()):
                for c in units(run):
                    held[c] += n
            if len(held) > COUNT_HELD:
                yield from rows()
        yield from rows()

    return (_texts(docs).select("text").mapInArrow(count, "chunk binary, n long")
            .groupBy("chunk").agg(F.sum("n").alias("n")))


def ship_lexicon(spark: SparkSession, docs: DataFrame, tokenizer_json: bytes,
                 words: int = LEXICON_WORDS) -> str | None:
    """Compile the corpus' most frequent chunks and hand the file to every executor; returns
    its name for ``SparkFiles`` (None when there is nothing to compile)."""
    counts = written(spark, count_units(docs).filter((F.col("n") >= LEAST_COUNT) & (F.length("chunk") <= 64)), "chunks")
    # how many chunks have each count: as many rows as there are different counts
    line = counts.groupBy("n").agg(F.count("*").alias("m")).withColumn(
        "upto", F.sum("m").over(Window.orderBy(F.desc("n"))))
    least = line.filter(F.col("upto") <= words).agg(F.min("n")).first()[0]
    if least is None:
        return None
    chunks = sorted(bytes(r[0]) for r in counts.filter(F.col("n") >= least).select("chunk").collect())
    asked = Codec(tokenizer_json, None).merge(chunks)
    data = compile_lexicon({c: np.frombuffer(i, "<u4").tolist() for c, i in zip(chunks, asked)})
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    if not any(str(f).endswith(name) for f in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(shared_file(spark, f"lexicon-{uuid.uuid4().hex}/{name}", data))
    return name


def _mapped(spark: SparkSession, docs: DataFrame, tokenizer_json: bytes, words: int, schema: str, columns, row,
            memo: int = 250_000):
    name = ship_lexicon(spark, docs, tokenizer_json, words)
    shipped = spark.sparkContext.broadcast(tokenizer_json)
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *columns])

    def run(batches):
        codec = _codec(name, shipped.value, memo)
        for rows, texts in text_slices(batches):
            ids, n = codec.encode(texts)
            cells = [row(codec, i) for i in np.split(ids, np.cumsum(n)[:-1])]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(n, pa.int64()),
                 *(pa.array([c[k] for c in cells], t) for k, (_, t) in enumerate(columns))], schema=out)

    return _texts(docs).mapInArrow(run, schema)


def encode(spark: SparkSession, docs: DataFrame, tokenizer_json: bytes,
           words: int = LEXICON_WORDS) -> DataFrame:
    """``doc_id, n_tokens, ids array<int>`` of every row of ``docs``, whole texts.

    A null or empty text has no ids; null doc_ids and repeated rows are kept, other columns
    are ignored, an empty table gives an empty one.
    """
    return _mapped(spark, docs, tokenizer_json, words, "doc_id long, n_tokens long, ids array<int>",
                   [("ids", pa.list_(pa.int32()))], lambda c, i: (i.astype(np.int32),))


def decode(spark: SparkSession, encoded: DataFrame, tokenizer_json: bytes) -> DataFrame:
    """``doc_id, text`` from the rows of ``encode``."""
    shipped = spark.sparkContext.broadcast(tokenizer_json)

    def run(batches):
        codec = _codec(None, shipped.value)
        for b in batches:
            texts = [codec.decode(np.asarray(x.as_py() or [], np.int64)).decode() for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())],
                                             schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(spark: SparkSession, docs: DataFrame, tokenizer_json: bytes,
                       words: int = LEXICON_WORDS) -> DataFrame:
    """Per row the digests of the ids (decimal, comma-joined) and of the text decoded from them."""
    def digests(codec, ids):
        return (hashlib.sha256(codec.decimals(ids)).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest())

    return _mapped(spark, docs, tokenizer_json, words,
                   "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
                   [("ids_sha256", pa.string()), ("decoded_sha256", pa.string())], digests, memo=400_000)


def op3_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    prepare(spark)
    return round_trip_digests(spark, table(spark, sf_dir, "documents"),
                              tokenizer_bytes(public_tokenizers.path("byte_bpe_50k.json")))
