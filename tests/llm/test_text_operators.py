import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from barwise.llm import licenses, merkle, mixing, quality, queries


# ---- 5: Merkle fingerprints

def edits(rows):
    """(doc_id, n_chars, sha of the edited text) by the contract, descending doc_id, nulls last"""
    out = []
    for i, (k, x) in enumerate(rows):
        nx, n = rows[(i + 1) % len(rows)][1], len(x) // 3
        out.append((k, len(x), hashlib.sha256((x[:len(x) - n] + nx[:n]).encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("size", [4, 1024])
def test_op5_edits(spark, sf, docs, monkeypatch, size):
    monkeypatch.setattr(merkle, "ROWS_A_BUCKET", size)
    got = merkle.op5_merkle(spark, sf).collect()
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    assert sorted(str((r["doc_id"], r["n_chars"], r["edited_sha256"])) for r in got) == edits(rows)
    text = dict(rows)
    root = {}
    for r in got:
        assert root.setdefault(text[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if r["edited_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest():
            assert r["fingerprint"] == r["edited_fingerprint"] and r["near_edited"] == 1
        else:
            assert r["fingerprint"] != r["edited_fingerprint"]
    assert len(set(root.values())) == len(root)
    assert np.mean([r["near_edited"] > r["near_next"] for r in got]) > 0.97


def near(spark, a, b):
    left, right = merkle.pieces(F.col("a"), F.col("b"))
    return spark.createDataFrame([(a, b)], "a string, b string").select(merkle.likeness(left, right)).first()[0]


def test_texts_on_either_side_of_the_short_length_are_compared(spark):
    text = "".join(f"word{i} and more, " for i in range(20))[:229]
    assert near(spark, text, text[:165]) > 0.7 and near(spark, text[:205], text[:195]) > 0.9
    assert near(spark, text, "QQQ") == 0 and near(spark, text, "") == 0 and near(spark, "", "") == 1
    got = spark.createDataFrame([("äb😀d",), ("ab",), ("",)], "t string").select(merkle.runs(F.col("t")), F.array(
        F.xxhash64(F.lit("äb😀")), F.xxhash64(F.lit("b😀d"))), F.array(F.xxhash64("t"))).collect()
    assert got[0][0] == got[0][1] and got[1][0] == got[1][2] and got[2][0] == []


@pytest.mark.parametrize("alphabet", ["的一是不了人我在有他这为之大来以个中上们", "のにはをたがでてとしれさあいうえお", "αβγδεζηθικλμ",
                                      "бвгдежзиклмн ", "ACGT", "0123456789abcdf"])
def test_likeness_of_long_texts_without_latin_phrases(spark, alphabet):
    drawn = np.random.default_rng(5).integers(0, len(alphabet), (2, 600))
    text, other = ("".join(alphabet[i] for i in row) for row in drawn)
    assert near(spark, text, text[:400] + other[:200]) > 0.4
    assert near(spark, text, text[:250] + "!" + text[251:]) > 0.9
    assert near(spark, text, other) < near(spark, text, text[:400] + other[:200])
    assert "".join(spark.createDataFrame([(text,)], "t string").select(merkle.finer(F.col("t"))).first()[0]) == text


@pytest.mark.parametrize("size", [2, 1024])
def test_next_of_odd_rows(spark, odd, empty, monkeypatch, size):
    monkeypatch.setattr(merkle, "ROWS_A_BUCKET", size)
    many = odd.select("doc_id", "text").unionAll(spark.range(40).selectExpr("5L", "concat('hot ', id)"))
    got = merkle.with_next(spark, many).collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in got) == sorted(str((r["doc_id"], r["text"] or "")) for r in many.collect())
    # every row is the next of exactly one, and ids never ascend along the chain but at its end
    assert sorted(r["next"] for r in got) == sorted(r["text"] for r in got)
    ids = {}
    for r in got:
        ids.setdefault(r["text"], set()).add(r["doc_id"])
    down = [r for r in got if r["doc_id"] is not None and len(ids[r["next"]]) == 1
            and (n := next(iter(ids[r["next"]]))) is not None and n > r["doc_id"]]
    assert not down
    assert merkle.with_next(spark, empty).count() == 0
    one = merkle.with_next(spark, odd.limit(1).select("doc_id", F.lit("abc").alias("text"))).collect()
    assert [r["next"] for r in one] == ["abc"]


def test_differing_branches_locate_edits(spark):
    paragraphs = [f"{'A' if i % 4 == 0 else 'x'} paragraph number {i}, of the text." for i in range(20)]
    new = paragraphs[:]
    new[9] = "x something else here."
    del new[14]
    old = spark.createDataFrame([(1, "\n".join(paragraphs)), (2, "same"), (None, "a")], "doc_id long, text string")
    now = spark.createDataFrame([(1, "\n".join(new)), (2, "same"), (None, "b")], "doc_id long, text string")
    got = merkle.locate_edits(old, now).collect()
    assert [r["doc_id"] for r in got] == [1]
    assert [(s["section"], s["paragraphs"]) for s in got[0]["removed"]] == [(2, [1]), (3, [2])]
    assert [(s["section"], s["paragraphs"]) for s in got[0]["added"]] == [(2, [1]), (3, [])]


# ---- 6: quality

def test_op6_learns_from_its_folds_and_holds_out(spark, docs, sf):
    sf = sf.replace("0.001", "0.1")
    got = {r["doc_id"]: r for r in quality.op6_quality(spark, sf).collect()}
    import zlib
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    rows = duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall()
    held = [(got[d]["score"], q) for d, q in rows if got[d]["held_out"]]
    assert np.mean([(s >= 0.5) == (q == 1) for s, q in held]) > 0.98
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    assert np.mean([[g > b for g in good[:300]] for b in bad[:300]]) > 0.99


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 7)], "doc_id long, quality int")
    model = quality.train(odd, labels)
    got = quality.scored(spark, odd, model)
    assert got.columns == odd.columns + ["_score"] and dict(got.drop("_score").dtypes) == dict(odd.dtypes)
    assert got.count() == odd.count() and got.filter("_score = 0.5").count() == odd.count()
    assert sorted(map(str, got.drop("_score").collect())) == sorted(map(str, odd.collect()))
    assert quality.scored(spark, empty, model).count() == 0
    assert quality.train(empty, labels).weight.any() == False  # noqa: E712


def test_pairs_rank_a_single_feature():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, quality.FEATURES))
    y = (x[:, 3] + 0.1 * rng.normal(size=600) > 0.8).astype(int)
    m = quality.fit(x, y)
    assert np.argmax(np.abs(m.weight)) == 3
    assert ((m.score(x) >= 0.5) == (y == 1)).mean() > 0.95


# ---- 7: licences

@pytest.fixture(scope="module")
def model(spark, docs):
    return licenses.train(spark, docs)


def test_licence_lines_are_named(spark, docs, model):
    want = {"MIT License": "mit", "GNU General Public License": "gpl", "Apache License": "apache", "CC BY-NC": "cc-by-nc"}
    got = {r["doc_id"]: r for r in licenses.document_licenses(spark, docs, model).collect()}
    for r in docs.collect():
        names = sorted({n for k, n in want.items() if k in (r["text"] or "")})
        assert got[r["doc_id"]]["licenses"] == ",".join(names)


def test_licences_of_odd_rows_and_unknown_paragraphs(spark, odd, empty, model):
    texts = [(100 + i, "Some words.\n" + t + "\nMore words") for i, (_, t) in enumerate(licenses.TEMPLATES)]
    texts += [(200 + i, t) for i, t in enumerate(licenses.OTHERS)]
    texts += [(300, "We talked about the license of the old house and the public library."),
              (301, "  LICENSED under the  apache license, VERSION 2.0 !"), (302, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("family", F.lit("x")).withColumn("h", F.lit(1))
    got = {r["doc_id"]: r for r in licenses.document_licenses(spark, df, model).collect()}
    for i, (family, _) in enumerate(licenses.TEMPLATES):
        assert got[100 + i]["licenses"] == family, i
    assert all(got[200 + i]["licenses"] == "" for i in range(len(licenses.OTHERS)))
    assert [got[i]["licenses"] for i in (300, 301, 302)] == ["", "apache", ""]
    assert licenses.document_licenses(spark, odd, model).count() == odd.count()
    assert licenses.document_licenses(spark, empty, model).count() == 0
    assert licenses.document_licenses(spark, odd, licenses.train(spark, empty)).filter("licenses <> ''").count() == 0


def test_every_confirmable_licence_is_a_candidate():
    known = set(licenses.features(licenses.TEMPLATES))
    for _, t in licenses.TEMPLATES:
        ws = licenses._python_words(t)
        two = {f"{a} {b}" for a, b in zip(ws, ws[1:])}
        # a paragraph with the confirming share of the 2-grams holds a feature: its 2-gram or one of its words
        bare = {g for g in two if g not in known and not known.intersection(g.split(" "))}
        assert len(bare) < licenses.CONFIRM * len(two), t


WRAPPED = [
    ("gpl", """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""),
    ("lgpl", """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either"""),
    ("bsd", """// Redistribution and use in source and binary forms, with or without
// modification, are permitted provided that the following conditions
// are met:"""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any\r
purpose with or without fee is hereby granted, provided that the above\r
copyright notice and this permission notice appear in all copies."""),
    ("mit", """Permission is hereby granted, free of charge, to any person
obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software"""),
]


def test_wrapped_notices_are_put_together(spark, model):
    before, after = "int main() { return 0; }\n\nSome prose above.\n", "\nProse below.\n \nThe end."
    texts = [(i, before + t + after) for i, (_, t) in enumerate(WRAPPED)]
    texts += [(10, "Prose.\nReleased under the MIT License.\nLicensed under the Apache License, Version 2.0.\nProse."),
              (11, "This program is free software: you can redistribute\n\nit under the terms of the harbour office")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.document_licenses(spark, df, model).collect()}
    assert [(got[i]["licenses"], got[i]["n_confirmed"]) for i in range(len(WRAPPED))] == [(f, 1) for f, _ in WRAPPED]
    assert (got[10]["licenses"], got[10]["n_confirmed"]) == ("apache,mit", 2) and got[11]["licenses"] == ""


@pytest.mark.parametrize("notices", [1, 400])
def test_licences_are_found_however_few_or_many_texts_speak_of_them(spark, notices):
    texts = [f"Plain prose number {i} about rivers and hills." for i in range(9)]
    texts += [f"Tool {i} is licensed under the MIT license of its author." for i in range(notices - 1)]
    texts += ["Released under the MIT License."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in licenses.document_licenses(spark, df, licenses.train(spark, df)).collect()}
    assert [got[i] for i in range(9)] == [""] * 9
    assert [got[i] for i in range(9, len(texts))] == ["mit"] * notices


# ---- 9: mixing

def water(sizes, weights=(1, 2, 3), most=3):
    """targets by resharing the excess among the sources below their limit"""
    w = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, open_, left = {}, set(sizes), float(sum(sizes.values()))
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total >= most * sizes[s]}
        if not over:
            target.update((s, left * w[s] / total) for s in open_)
            break
        for s in over:
            target[s] = float(most * sizes[s])
        open_ -= over
        left = sum(sizes.values()) - sum(target.values())
    return target


def check_mix(rows):
    words = re.compile("[^\x20\x09-\x0d]+")
    sizes, taken, longest = {}, {}, {}
    for r in rows:
        n = len(words.findall(r["text"] or ""))
        assert r["_size"] == n and 0 <= r["_times"] <= 3
        sizes[r["source"]] = sizes.get(r["source"], 0) + n
        taken[r["source"]] = taken.get(r["source"], 0) + n * r["_times"]
        longest[r["source"]] = max(longest.get(r["source"], 0), n)
    target = water(sizes)
    for r in rows:
        assert r["_source_size"] == sizes[r["source"]] and r["_target"] == pytest.approx(target[r["source"]])
    return sizes, taken, target, longest


def test_mix_of_documents(spark, docs):
    got = mixing.mix(spark, docs)
    rows = got.collect()
    sizes, taken, target, longest = check_mix(rows)
    assert all(abs(taken[s] - target[s]) <= longest[s] / 2 + 1 for s in sizes)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(spark, docs.repartition(5)).collect()))
    mixed = mixing.mixed(spark, docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["_times"] for r in rows)


def test_mix_of_odd_rows(spark, odd, empty):
    got = mixing.mix(spark, odd)
    assert got.columns == odd.columns + ["_size", "_source_size", "_target", "_times"]
    assert got.count() == odd.count()
    check_mix(got.collect())
    same = [r["_times"] for r in got.filter("text = 'same row twice'").collect()]
    assert len(same) == 2 and len(set(same)) == 1
    assert mixing.mix(spark, empty).count() == 0 and mixing.mixed(spark, empty).count() == 0
    blank = spark.createDataFrame([(1, "", None), (2, None, "a")], "doc_id long, text string, source string")
    assert sorted(r["_target"] for r in mixing.mix(spark, blank).collect()) == [0.0, 0.0]


@pytest.mark.parametrize("parts", [1, 6])
def test_equal_rows_come_near_their_target(spark, parts):
    """Two sources of 2,000 words each: the one of 20 equal rows should give 1,333 words, the other 2,667."""
    rows = [(None, "word " * 100, "a")] * 20 + [(k, f"w{k} " * 100, "b") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
    got = mixing.mix(spark, df).collect()
    sizes, taken, target, _ = check_mix(got)
    assert target["a"] == pytest.approx(4000 / 3) and taken["a"] == 1300
    assert abs(taken["b"] - target["b"]) <= 51
    assert len(got) == 40 and mixing.mixed(spark, df).count() == sum(r["_times"] for r in got)


@pytest.mark.parametrize("bits, levels", [(2, 5), (12, 5), (3, 1)])
def test_thresholds_come_near_any_target(spark, monkeypatch, bits, levels):
    monkeypatch.setattr(mixing, "LEVEL_BITS", bits)
    monkeypatch.setattr(mixing, "LEVELS", levels)
    monkeypatch.setattr(mixing, "HASH_BITS", bits * levels)
    slim = spark.range(4000).select(F.concat(F.lit("s"), F.col("id") % 3).alias("source"), (F.col("id") % 17).alias("size"),
                                    F.shiftrightunsigned(F.xxhash64("id"), 64 - bits * levels).alias("hash"))
    sizes = {r[0]: r[1] for r in slim.groupBy("source").agg(F.sum("size")).collect()}
    for share in (0.0, 0.25, 0.5, 0.9, 1.0, 1.7, 3.0):
        wanted = spark.createDataFrame([(s, n, n * share) for s, n in sizes.items()], "source string, size long, target double")
        cut = mixing.thresholds(spark, slim, wanted)
        got = slim.join(cut, "source").groupBy("source").agg(
            F.sum(F.col("size") * (F.col("whole") + (F.col("hash") < F.col("below")).cast("int")))).collect()
        coarse = max(17, sizes["s0"] * 2 / 2 ** (bits * levels)) * (1 if bits * levels > 20 else 2)
        assert all(abs(n - sizes[s] * share) <= coarse for s, n in got), (share, got)


# ---- the pipeline

def test_pipeline(spark, sf, docs):
    import corpus_pipeline
    kept, table = docs, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, sf)
        assert table.columns == docs.columns and dict(table.dtypes) == dict(docs.dtypes), name
        if name == "simhash":
            kept = table
    assert kept.count() == kept.select("doc_id").distinct().count()
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids"]
    assert sorted(r[0] for r in got.select("doc_id").collect()) == sorted(r[0] for r in table.select("doc_id").collect())
    assert got.filter("n_tokens <> size(ids)").count() == 0


def test_stages_of_odd_and_empty_rows(spark, odd, empty, sf):
    import corpus_pipeline
    for rows in (odd, empty):
        docs = rows
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
            docs.collect()


def test_registered(spark):
    import __spark_entry__ as E
    assert set(queries.QUERIES) | {"pipeline"} <= set(E.queries())
    assert set(queries.ORACLES) <= set(E.oracle_sql())
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 11))


CLASHING = ["_key", "_score", "_size", "_hash", "_times", "_copy", "_source", "c0", "key", "nth", "quality", "x"]


def test_clashing_columns_keep_their_values(spark, odd, sf):
    """Stages and operators that return documents leave every column as it was."""
    import corpus_pipeline
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(c), F.col("text")).alias(c) for c in CLASHING])
    rows = set(map(str, docs.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns, name
        assert got.count() > 0 and set(map(str, got.collect())) <= rows, name
    plain = quality.fit(np.zeros((0, quality.FEATURES)), np.zeros(0, np.int64))
    scored = quality.scored(spark, docs, plain)
    assert {str(tuple(r)[:-1]) for r in scored.collect()} == set(map(str, map(tuple, docs.collect())))
    assert mixing.mix(spark, docs).toDF(*[f"a{i}" for i in range(len(docs.columns) + 4)]).count() == docs.count()


def test_training_sample_has_a_row_an_id(spark):
    top = 2**63 - 1
    docs = spark.createDataFrame([(top, "good text here")] * 3 + [(top, "another text"), (2, "bad")], "doc_id long, text string")
    labels = spark.createDataFrame([(top, 1), (top, 1), (2, 0)], "doc_id long, quality int")
    x, y = quality.training_rows(docs, labels)
    import zlib
    learned = [d for d in (2, top) if zlib.crc32(str(d).encode()) % 3 != 1]
    assert len(x) == len(y) == len(learned)
