"""Operator 10: token counts of documents in flat, unindexed token files.

A token file is a run of ids with an end-of-document id after every document and no index.
Files are cut into blocks; each block is searched for separators with numpy on its own, and
documents that cross block borders are stitched by a prefix scan over block summaries.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwise.llm.common import prepare, table, text_slices, tokenizer_bytes, written

BLOCK_IDS = 1 << 18
#: blocks summed up together before the scan over a whole file
SUPER = 256


def id_width(tokenizer_json: bytes, end_id: int) -> int:
    """Bytes of an id in the files: two if all ids of the vocabulary and ``end_id`` fit, else four."""
    config = json.loads(tokenizer_json)
    most = max([end_id, *config["model"]["vocab"].values(), *(t["id"] for t in config.get("added_tokens", []))])
    if not 0 <= end_id < 1 << 32 or most >= 1 << 32:
        raise ValueError(f"ids up to {most} and the separator {end_id} do not fit four bytes")
    return 2 if most < 1 << 16 else 4


def write_flat(spark: SparkSession, docs: DataFrame, tokenizer_json: bytes, end_id: int,
               name: str = "flat") -> tuple[DataFrame, DataFrame]:
    """Token files of ``docs``: one per partition, blocks of ``BLOCK_IDS`` ids.

    Returns the blocks ``(file, block, ids)`` and the manifest ``(file, block, doc_ids)``,
    the ids of the documents that end in a block, in order and without lengths.  Strings of
    special tokens inside a text are ordinary text, so only real separators have ``end_id``.
    Null texts are empty (a separator alone); null ids and repeated rows are kept; an empty
    table gives no files.  Ids have two bytes, or four for a vocabulary that needs them (:func:`id_width`).
    """
    width = id_width(tokenizer_json, end_id)
    shipped = spark.sparkContext.broadcast(tokenizer_json)
    schema = pa.schema([("file", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()),
                        ("doc_ids", pa.list_(pa.int64()))])

    def encode(batches):
        from barwise.llm.chunks import encoder
        enc = encoder(shipped.value, specials_as_text=True)
        file, block, size = TaskContext.get().partitionId(), 0, width * BLOCK_IDS
        rest, ended = bytearray(), []
        for rows, texts in text_slices(batches):
            ids, n = enc.encode(texts)
            ids = np.insert(ids.astype(f"<u{width}"), np.cumsum(n), end_id)
            ends = np.cumsum(n + 1).tolist()
            for doc, a, b in zip(rows.column("doc_id").to_pylist(), [0, *ends], ends):
                rest += ids[a:b].tobytes()
                cut = 0
                while len(rest) - cut > size:
                    yield pa.RecordBatch.from_pylist([{"file": file, "block": block, "doc_ids": ended,
                                                       "ids": bytes(rest[cut:cut + size])}], schema)
                    block, ended, cut = block + 1, [], cut + size
                del rest[:cut]
                ended.append(doc)
        if rest:
            yield pa.RecordBatch.from_pylist([{"file": file, "block": block, "doc_ids": ended,
                                               "ids": bytes(rest)}], schema)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    files = written(spark, rows.mapInArrow(encode, "file int, block long, ids binary, doc_ids array<bigint>"), name)
    return files.select("file", "block", "ids"), files.select("file", "block", "doc_ids")


def find_separators(blocks: DataFrame, end_id: int, width: int = 2) -> DataFrame:
    """Per block: number of ids and the positions of its separators (one numpy pass)."""
    schema = pa.schema([("file", pa.int32()), ("block", pa.int64()), ("n_ids", pa.int64()),
                        ("seps", pa.list_(pa.int64()))])

    def scan(batches):
        for batch in batches:
            for f, b, ids in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(),
                                 batch.column("ids")):
                buf = ids.as_buffer()
                flat = np.frombuffer(buf if buf is not None else b"", f"<u{width}")
                yield pa.RecordBatch.from_pylist(
                    [{"file": f, "block": b, "n_ids": len(flat), "seps": np.flatnonzero(flat == end_id).tolist()}],
                    schema)

    return blocks.mapInArrow(scan, "file int, block long, n_ids long, seps array<bigint>")


def stitch(found: DataFrame) -> DataFrame:
    """Documents ``(file, block, nth, n_tokens, closed)`` from the separators of the blocks.

    Two-level prefix scan: sums and last separators inside runs of ``SUPER`` blocks, then
    over the runs of a file, so no window holds more than a file's blocks / ``SUPER`` rows.
    ``n_tokens`` counts a document's ids without its separator.  Ids after a file's last
    separator are an open document (``closed`` false, ``nth`` null).
    """
    one = found.withColumn("super", F.floor(F.col("block") / SUPER))
    inner = Window.partitionBy("file", "super").orderBy("block")
    before = inner.rowsBetween(Window.unboundedPreceding, -1)
    one = one.withColumn("at", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    one = (one.withColumn("last", F.when(F.size("seps") > 0, F.col("at") + F.element_at("seps", -1)))
           .withColumn("prev", F.max("last").over(before)))
    runs = one.groupBy("file", "super").agg(F.sum("n_ids").alias("n"), F.max("last").alias("run_last"))
    upto = Window.partitionBy("file").orderBy("super").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("base", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    runs = runs.withColumn("base_last", F.max(F.col("base") + F.col("run_last")).over(upto))
    ends = runs.groupBy("file").agg(F.max(F.col("base") + F.col("n")).alias("end"),
                                    F.max(F.col("base") + F.col("run_last")).alias("end_last"))
    full = one.join(runs.select("file", "super", "base", "base_last"), ["file", "super"])
    start = F.col("base") + F.col("at")
    closed = (full.withColumn("prev", F.coalesce(F.col("base") + F.col("prev"), "base_last", F.lit(-1)))
              .withColumn("ends", F.concat(F.array("prev"), F.transform("seps", lambda p: p + start)))
              .select("file", "block", F.posexplode(F.transform(F.slice("ends", 2, F.size("seps")),
                                                                lambda e, i: e - F.get("ends", i) - 1))
                      .alias("nth", "n_tokens")).withColumn("closed", F.lit(True)))
    rest = F.col("end") - F.coalesce("end_last", F.lit(-1)) - 1
    open_ = ends.filter(rest > 0).select("file", F.lit(None).cast("long").alias("block"),
                                         F.lit(None).cast("int").alias("nth"), rest.alias("n_tokens"),
                                         F.lit(False).alias("closed"))
    return closed.unionByName(open_)


def op10_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id and its token count, by scanning the flat token files."""
    import public_tokenizers
    prepare(spark)
    blocks, manifest = write_flat(spark, table(spark, sf_dir, "documents"),
                                  tokens := tokenizer_bytes(public_tokenizers.path("word_bpe_49k.json")), end_id=49407)
    counted = stitch(written(spark, find_separators(blocks, 49407, id_width(tokens, 49407)), "separators"))
    names = manifest.select("file", "block", F.posexplode("doc_ids").alias("nth", "doc_id"))
    return names.join(counted, ["file", "block", "nth"], "left").select("doc_id", "n_tokens")
