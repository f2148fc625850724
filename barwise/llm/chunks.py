"""Whole-text ids of a white-space-dropping tokenizer, by distinct chunks.

The tokenizer's normaliser and pre-tokenizer never join or reorder anything across ASCII
white space, and drop it: the ids of a text are the ids of its chunks in order.  So a
worker asks the tokenizers library once per distinct chunk and keeps a bounded memo; a
tokenizer of another kind is asked for whole texts.
"""

from __future__ import annotations

import gc
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def drops_white_space(config: dict) -> bool:
    """True for the one kind of configuration for which ids of chunks may be joined."""
    norm = config.get("normalizer") or {}
    parts = norm.get("normalizers", [norm] if norm else [])
    if any(p.get("type") not in ("NFC", "Lowercase", "Replace") for p in parts):
        return False
    if any(p.get("type") == "Replace" and (p["pattern"].get("Regex") != r"\s+" or p["content"] != " ")
           for p in parts):
        return False
    pre = config.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    return (first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert"))
            and r"\s" not in first["pattern"].get("Regex", r"\s").replace(r"[^\s", "")
            and not any(t["single_word"] or t["normalized"] for t in config.get("added_tokens", [])))


def lower_cases(config: dict) -> bool:
    norm = config.get("normalizer") or {}
    return any(p.get("type") == "Lowercase" for p in norm.get("normalizers", [norm]))


#: An ASCII capital before a combining mark: the library composes the two before it lower-cases,
#: and some composed forms have lower case only.
COMPOSES = r"[A-Z]\p{M}"

#: ASCII punctuation that may follow a letter or digit without touching its ids (no
#: apostrophe: it binds to letters).
TAIL = b".,!?;:|*$%&#"


def plain_end(stem: bytes) -> bool:
    """Does the stem end with an ASCII digit or a Latin letter?"""
    if not stem:
        return False
    if stem[-1] < 128:
        return stem[-1:].isalnum()
    last = stem[-8:].decode(errors="ignore")[-1:]
    return last.isalpha() and last < "\u0250"


class ChunkEncoder:
    """ids (little-endian 32 bit) of UTF-8 texts, equal to the library's for the whole text.

    ``specials_as_text``: strings of special tokens inside a text are ordinary text.
    ``memo``: chunks remembered at most; a full memo is emptied, which costs time only.

    A chunk not seen before is asked for as its stem and its tail of punctuation, which are
    pre-tokens apart.  Stems of letters only are single pre-tokens: they go to the library
    many at a time, as one text, and its ids are cut after each end-of-word token.
    """

    def __init__(self, tokenizer_json: bytes, specials_as_text: bool = False, memo: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        config = json.loads(tokenizer_json)
        self.lib = Tokenizer.from_str(tokenizer_json.decode())
        self.lib.no_padding()
        self.lib.no_truncation()
        self.lib.encode_special_tokens = specials_as_text
        self.by_chunk = drops_white_space(config)
        #: a text that may hold one of these, in whatever case, is asked whole
        self.guard = [t["content"].encode().lower() for t in config.get("added_tokens", [])]
        self.lower = lower_cases(config)
        suffix = config["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.lib.get_vocab_size(with_added_tokens=True), bool)
        for token, i in self.lib.get_vocab(with_added_tokens=True).items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        self.memo: dict[bytes, bytes] = {}
        self.stems: dict[bytes, bytes] = {}
        self.most = memo

    def _ask(self, texts: list[bytes]) -> list[bytes]:
        found = self.lib.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _ask_stems(self, stems: list[bytes]) -> list[bytes]:
        """ids of stems of letters, asked as one text; one by one if any is no single pre-token."""
        ids = np.array(self.lib.encode_batch_fast([b" ".join(stems).decode()], add_special_tokens=False)[0].ids, "<u4")
        cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(cuts) != len(stems):
            return self._ask(stems)
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip([0, *cuts], cuts)]

    def _learn(self, chunks: set[bytes]) -> dict[bytes, bytes]:
        """ids of chunks that the memo does not hold."""
        if len(self.stems) > self.most:
            self.stems.clear()
        whole, apart = [], []
        for c in chunks:
            stem = c.rstrip(TAIL)
            n = len(stem)
            if n != len(c) and plain_end(stem):
                apart.append((c, stem, c[n:]))
            else:
                whole.append(c)
        unseen = {x for _, a, b in apart for x in (a, b)}
        unseen.update(whole)
        unseen.difference_update(self.stems)
        simple = [u for u in unseen if u.isalpha() or u.decode().isalpha()]
        other = list(unseen.difference(simple))
        for k in range(0, len(simple), 1_000):
            some = simple[k:k + 1_000]
            self.stems.update(zip(some, self._ask_stems(some)))
        for k in range(0, len(other), 20_000):
            some = other[k:k + 20_000]
            self.stems.update(zip(some, self._ask(some)))
        stems = self.stems
        learned = {c: stems[c] for c in whole}
        learned.update([(c, stems[a] + stems[b]) for c, a, b in apart])
        return learned

    def _held(self, low: pa.Array) -> np.ndarray:
        """Which texts may hold a special token and must be asked whole."""
        held = np.zeros(len(low), bool)
        for g in self.guard:
            held |= pc.match_substring(low, g.decode()).to_numpy(zero_copy_only=False)
        return held

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts (strings without nulls) in a row, and the number of each."""
        low = pc.ascii_lower(texts)
        held = np.ones(len(texts), bool) if not self.by_chunk else self._held(low)
        # lower-cased early for more hits of the memo, where that changes no id
        asked = pc.if_else(pc.match_substring_regex(texts, COMPOSES), texts, low) if self.lower else texts
        if not held.any():
            return self._by_chunk(asked)
        # texts one after the other, those that are asked whole in their places
        parts = []
        for i, whole in enumerate(held.tolist()):
            if whole:
                parts.append(np.frombuffer(self._ask([texts[i].as_py().encode()])[0], "<u4"))
            else:
                parts.append(self._by_chunk(asked.slice(i, 1))[0])
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def _by_chunk(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Arrow splits the texts and numbers the distinct chunks; ids are gathered by number."""
        if len(self.memo) > self.most:
            self.memo.clear()
        split = pc.ascii_split_whitespace(texts)
        numbered = split.flatten().dictionary_encode()
        chunks = numbered.dictionary.cast(pa.binary()).to_pylist()
        found = list(map(self.memo.get, chunks))
        gaps = [i for i, x in enumerate(found) if x is None]
        self.memo.update(self._learn({chunks[i] for i in gaps}))
        for i in gaps:
            found[i] = self.memo[chunks[i]]
        pool = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        at = np.cumsum(size) - size
        place = numbered.indices.to_numpy()
        n = size[place]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.repeat(at[place] - ends[:-1], n) + np.arange(ends[-1])]
        of_text = ends[split.offsets.to_numpy()]
        return ids, np.diff(of_text)


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(tokenizer_json: bytes, specials_as_text: bool = False, memo: int = 400_000) -> ChunkEncoder:
    """The worker's encoder; Spark reuses Python workers, so its memo outlives a task."""
    key = (hash(tokenizer_json), specials_as_text, memo)
    if key not in _ENCODERS:
        gc.set_threshold(200_000, 20, 20)     # millions of small objects here, and no cycles
        _ENCODERS[key] = ChunkEncoder(tokenizer_json, specials_as_text, memo)
    return _ENCODERS[key]
