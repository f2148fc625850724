import functools
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from barwise.llm import lexicon, separators, simple8b
from barwise.llm.chunks import ChunkEncoder
from barwise.llm.common import tokenizer_bytes

from .conftest import ODD

WORD = tokenizer_bytes(public_tokenizers.path("word_bpe_49k.json"))
BYTE = tokenizer_bytes(public_tokenizers.path("byte_bpe_50k.json"))


@functools.lru_cache
def library(data, specials_as_text=False):
    t = Tokenizer.from_str(data.decode())
    t.no_padding()
    t.no_truncation()
    t.encode_special_tokens = specials_as_text
    return t


def key(r):
    return (r["doc_id"] is not None, r["doc_id"] or 0, str(tuple(r)))


TEXT = st.text(st.one_of(st.sampled_from(list(" \n\t'sST.,!a  ́̇\x1c\x85KΣé<|>")), st.characters(codec="utf-8")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_chunk_ids_equal_the_librarys(t):
    want = library(WORD).encode(t, add_special_tokens=False).ids
    ids, n = ENC.encode(pa.array(["", t, "the <|endoftext|>", t + " "]))
    assert n.tolist() == [0, len(want), 2, len(want)]
    assert ids.tolist() == [*want, *library(WORD).encode("the <|endoftext|>").ids, *want]


ENC, CODEC = ChunkEncoder(WORD), lexicon.Codec(BYTE, None)


def test_capitals_before_combining_marks_keep_the_library_s_ids():
    lib = Tokenizer.from_str(WORD.decode())
    texts = [f"{c}{mark}{end}" for c in "AHIJKTWYZ" for mark in "\u0301\u0307\u0308\u030a\u030c\u0331\u0308\u0301"
             for end in ("", "arim Plain WORDS", ".", "\u0323 x")] + ["J\u030carir Plain", "PLAIN Ünd TH\u0331"]
    ids, n = ENC.encode(pa.array(texts))
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]



@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_codec_equals_the_library(t):
    lib = library(BYTE)
    want = lib.encode(t, add_special_tokens=False).ids
    ids, n = CODEC.encode(pa.array(["", t, "a  b", t + " x"]))
    got = np.split(ids, np.cumsum(n)[:-1])
    assert [x.tolist() for x in got] == [lib.encode(x, add_special_tokens=False).ids for x in ("", t, "a  b", t + " x")]
    assert CODEC.decode(got[1]).decode() == lib.decode(want, skip_special_tokens=False)
    assert CODEC.decimals(got[1]).decode() == ",".join(map(str, want))


def test_decode_of_broken_utf8():
    lib = library(BYTE)
    rng = np.random.default_rng(1)
    for _ in range(200):
        ids = rng.integers(0, 50257, 12)
        assert CODEC.decode(ids).decode() == lib.decode(ids.tolist(), skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 2**32 - 1), max_size=4), max_size=40))
def test_automaton_holds_its_words_only(tmp_path_factory, words):
    f = tmp_path_factory.mktemp("lex") / "x.bin"
    f.write_bytes(lexicon.compile_lexicon(words))
    lex = lexicon.Lexicon(str(f))
    asked = list(words) + [w + b"x" for w in words] + [w[:-1] for w in words] + [b""]
    for w, r in zip(asked, lex.ranks(asked)):
        assert (r >= 0) == (w in words)
        if r >= 0:
            assert np.frombuffer(lex.word_ids(r), "<u4").tolist() == words[w]


def test_automaton_shares_suffixes(tmp_path):
    stems, ends = [b"walk", b"talk", b"jump"], [b"", b"s", b"ed", b"ing"]
    data = lexicon.compile_lexicon({a + e: [1] for a in stems for e in ends})
    (tmp_path / "x").write_bytes(data)
    assert len(lexicon.Lexicon(str(tmp_path / "x")).final) == 4 + 3 + 1 + 4  # stems share all that follows


def test_op3_against_the_library(spark, sf, docs):
    lib = library(BYTE)
    got = {r["doc_id"]: r for r in lexicon.op3_bpe_lexicon(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        g = got[r["doc_id"]]
        assert g["n_tokens"] == len(ids)
        assert g["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        text = lib.decode(ids, skip_special_tokens=False)
        assert g["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_encode_decode_round_trip_of_odd_rows(spark, odd, empty):
    lib = library(BYTE)
    enc = lexicon.encode(spark, odd, BYTE, words=20)
    want = sorted(((r["doc_id"], lib.encode(r["text"] or "", add_special_tokens=False).ids) for r in odd.collect()), key=str)
    assert sorted(((r["doc_id"], r["ids"]) for r in enc.collect()), key=str) == want
    back = lexicon.decode(spark, enc, BYTE).collect()
    assert sorted(map(str, ((r[0], r[1]) for r in back))) == sorted(
        str((r["doc_id"], r["text"] or "")) for r in odd.collect())
    assert lexicon.encode(spark, empty, BYTE).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 40), st.integers(0, 60000), st.integers(0, 2**60 + 5),
                          st.integers(0, 2**64 - 1)), max_size=300), st.integers(1, 12))
def test_simple8b_round_trip(ids, times):
    x = np.array(ids * times, np.uint64)
    words, offsets = simple8b.pack(x)
    assert len(offsets) == -(-len(x) // simple8b.BLOCK)
    assert (simple8b.unpack(words, offsets, len(x)) == x).all()


def test_simple8b_is_dense():
    words, _ = simple8b.pack(np.full(6000, 7, np.uint64))
    assert len(words) == 6 * -(-1024 // 20) - (1024 * 6 - 6000) // 20 or len(words) <= 6 * 52
    assert len(simple8b.pack(np.zeros(1024, np.uint64))[0]) == 10  # 8 of 120 ids, 60 and 4


def _brute8(rows):
    lib, start, out = library(WORD), 0, []
    for r in rows:
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        out.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_op8_against_the_library(spark, sf, docs):
    got = [tuple(r) for r in simple8b.op8_simple8b(spark, sf).orderBy("start").collect()]
    assert got == _brute8(docs.orderBy("doc_id").collect())


def test_simple8b_files_of_odd_rows(spark, odd, empty):
    files = simple8b.write_ids(spark, odd, WORD, end_id=2)
    got = simple8b.read_ids(files).orderBy("start").collect()
    lib = library(WORD)
    assert [r["doc_id"] for r in got] == sorted([r["doc_id"] for r in odd.collect()], key=lambda i: (i is not None, i or 0))
    assert sorted(np.frombuffer(r["ids"], "<u4").tolist() for r in got) == sorted(
        lib.encode(r["text"] or "", add_special_tokens=False).ids + [2] for r in odd.collect())
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert simple8b.read_digests(simple8b.write_ids(spark, empty, WORD, end_id=2)).count() == 0


@pytest.mark.parametrize("size", [7, 64, 1 << 18])
def test_separator_scan_of_odd_rows(spark, odd, docs, empty, monkeypatch, size):
    monkeypatch.setattr(separators, "BLOCK_IDS", size)
    monkeypatch.setattr(separators, "SUPER", 3)
    lib = library(WORD, True)
    table = odd.select(docs.columns).unionAll(docs.limit(40)).repartition(3)
    blocks, manifest = separators.write_flat(spark, table, WORD, 49407)
    counted = separators.stitch(separators.find_separators(blocks, 49407))
    names = manifest.selectExpr("file", "block", "posexplode(doc_ids) as (nth, doc_id)")
    got = names.join(counted, ["file", "block", "nth"], "left").select("doc_id", "n_tokens").collect()
    want = [(r["doc_id"], len(lib.encode(r["text"] or "", add_special_tokens=False).ids)) for r in table.collect()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert counted.filter("not closed").count() == 0
    b0, _ = separators.write_flat(spark, empty, WORD, 49407)
    assert separators.stitch(separators.find_separators(b0, 49407)).count() == 0


def test_separator_scan_of_a_large_vocabulary(spark):
    """Ids over 65,535 take four bytes; none is mistaken for the separator whose lower bits it shares."""
    import json
    vocab = {f"w{k}": k for k in range(100_000)} | {"[UNK]": 100_000}
    big = json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None,
                      "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "decoder": None,
                      "model": {"type": "WordLevel", "vocab": vocab, "unk_token": "[UNK]"}}).encode()
    texts = ["w65541 w5 w99999", "", "w131 w65541", None, "w70000 " * 50]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    blocks, manifest = separators.write_flat(spark, table, big, 5 + 100_000)
    assert separators.id_width(big, 5) == 4 and separators.id_width(WORD, 49407) == 2
    counted = separators.stitch(separators.find_separators(blocks, 5 + 100_000, 4))
    names = manifest.selectExpr("file", "block", "posexplode(doc_ids) as (nth, doc_id)")
    got = dict(map(tuple, names.join(counted, ["file", "block", "nth"], "left").select("doc_id", "n_tokens").collect()))
    assert got == {k: len((t or "").split()) for k, t in enumerate(texts)}
    with pytest.raises(ValueError):
        separators.id_width(WORD, 1 << 33)


def test_separator_scan_leaves_open_ends(spark):
    flat = [5, 9, 1, 1, 9, 7, 7, 7, 7, 9, 9, 3, 3]
    blocks = spark.createDataFrame([(0, k, np.array(flat[4 * k:4 * k + 4], "<u2").tobytes()) for k in range(4)]
                                   + [(1, 0, np.array([3, 3], "<u2").tobytes())], "file int, block long, ids binary")
    got = separators.stitch(separators.find_separators(blocks, 9)).orderBy("file", "closed", "block", "nth").collect()
    assert [(r["file"], r["n_tokens"], r["closed"]) for r in got] == [
        (0, 2, False), (0, 1, True), (0, 2, True), (0, 4, True), (0, 0, True), (1, 2, False)]


def test_op10_covers_all_documents(spark, sf, docs):
    lib = library(WORD)
    got = dict(map(tuple, separators.op10_separator_scan(spark, sf).collect()))
    assert got == {r["doc_id"]: len(lib.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect()}


def test_odd_texts_are_odd():
    assert CODEC._whole(pa.array([t or "" for t in ODD])).sum() >= 4
