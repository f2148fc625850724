"""Operator 8: token ids in Simple-8b words.

File format (one Parquet row per *segment* of whole documents, written by Spark's own
committer so that retries and lost executors leave no partial file):

* ``words``: 64-bit little-endian words.  The top four bits select how many ids of how many
  bits the lower 60 bits hold (lowest bits first; always all of them); selector 1 stands for 120 zero ids, and
  selector 0 is an escape: the next word is one raw 64-bit id.
* every block of ``BLOCK`` ids starts a new word at ``block_offsets[b]`` (words), the last
  block is shorter; all blocks of a segment decode at once without a sequential scan.
* ``doc_ids`` and ``doc_lengths``: the documents of the segment in ascending doc_id order.
* ``part``, ``seg`` and ``before``: place of the segment in the file set, and the ids of its
  part before it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwise.llm.common import prepare, row_key, table, text_slices, tokenizer_bytes, written

# Fixed values of the published Simple-8b layout: ids per word and bits per id, by selector.
COUNT = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])

BLOCK = 1024
_PAD = 64          # no window of a selector in use reaches further
#: A segment is closed at this many ids (a longer document makes a longer segment).
SEGMENT_IDS = 1 << 18
#: Distinct chunks a worker remembers (about 200 bytes each); it bears on time only.
MEMO = 800_000


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bit length of each id (0 for 0)."""
    out = np.zeros(ids.shape, np.uint8)
    top = int(ids.max()) if ids.size else 0
    for b in range(top.bit_length()):
        out += ids >= ids.dtype.type(1 << b)
    return out


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and the word offset of every block, for unsigned ids of up to 64 bits.

    No ids give no words.  Greedy: each word takes the densest selector that its ids fill.
    """
    ids = np.asarray(ids)
    if ids.dtype.kind != "u":
        ids = ids.astype(np.uint64)
    if not len(ids):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blocks = -(-len(ids) // BLOCK)
    grid = np.zeros((blocks, BLOCK), ids.dtype)
    grid.reshape(-1)[:len(ids)] = ids
    counts = np.full(blocks, BLOCK)
    counts[-1] = len(ids) - (blocks - 1) * BLOCK
    # past a block's end nothing fits, so words never reach over it
    width = np.full((blocks, BLOCK + _PAD), 255, np.uint8)
    width[:, :BLOCK] = _widths(grid)
    width[-1, counts[-1]:] = 255

    choice = np.where(width > 60, 0, 15).astype(np.uint8)
    # ``windows``: largest width among the next ``reach`` ids
    windows, reach = width, 1
    for sel in range(14, 0, -1):
        n, b = int(COUNT[sel]), int(BITS[sel])
        while 2 * reach <= n:
            after = np.full_like(windows, 255)
            np.maximum(windows[:, :-reach], windows[:, reach:], out=after[:, :-reach])
            windows, reach = after, 2 * reach
        fits = windows <= b
        if n > reach:
            fits[:, :reach - n] &= windows[:, n - reach:] <= b
            fits[:, reach - n:] = False
        if sel > 1 and not fits.any():      # denser selectors fit where this one does at most
            break
        np.putmask(choice, fits, np.uint8(sel))
    # where each word starts: all blocks advance together, one word a step
    pos, rows, starts, sels = np.zeros(blocks, np.int64), [], [], []
    alive = np.arange(blocks)
    while len(alive):
        s = choice[alive, pos[alive]]
        rows.append(alive)
        starts.append(pos[alive])
        sels.append(s)
        pos[alive] += COUNT[s]
        alive = alive[pos[alive] < counts[alive]]
    row, start, sel = np.concatenate(rows), np.concatenate(starts), np.concatenate(sels)
    order = np.lexsort((start, row))
    row, start, sel = row[order], start[order], sel[order]
    size = np.where(sel == 0, 2, 1)
    at = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for s in np.unique(sel):
        mine = np.flatnonzero(sel == s)
        if s == 0:
            words[at[mine] + 1] = grid[row[mine], start[mine]]
            continue
        word = np.full(len(mine), np.uint64(int(s) << 60))
        if BITS[s]:
            r, c = row[mine], start[mine]
            for j in range(COUNT[s]):
                word |= grid[r, c + j].astype(np.uint64) << np.uint64(j * int(BITS[s]))
        words[at[mine]] = word
    return words, at[np.searchsorted(row, np.arange(blocks))]


def _starts_with_escapes(words: np.ndarray, offsets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Indices of selector words when raw words lie between them: blocks advance together."""
    pos, found = offsets.copy(), []
    alive = np.arange(len(offsets))
    while len(alive):
        found.append(pos[alive])
        pos[alive] += np.where(words[pos[alive]] >> np.uint64(60) == 0, 2, 1)
        alive = alive[pos[alive] < ends[alive]]
    return np.sort(np.concatenate(found))


def unpack(words: np.ndarray, offsets: np.ndarray, n_ids: int) -> np.ndarray:
    """The ids again, all blocks at once."""
    if not n_ids:
        return np.zeros(0, np.uint64)
    blocks = len(offsets)
    ends = np.append(offsets[1:], len(words))
    if (words >> np.uint64(60) == 0).any():
        at = _starts_with_escapes(words, offsets, ends)
    else:
        at = np.arange(len(words))
    sel = (words[at] >> np.uint64(60)).astype(np.int64)
    n = COUNT[sel]
    first = np.searchsorted(at, offsets)          # first selector word of each block
    run = np.cumsum(n) - n
    block = np.repeat(np.arange(blocks), np.diff(np.append(first, len(at))))
    place = run - run[first][block] + block * BLOCK
    out = np.zeros(blocks * BLOCK, np.uint64)
    for s in np.unique(sel):
        mine = np.flatnonzero(sel == s)
        if s == 0:
            out[place[mine]] = words[at[mine] + 1]
        elif BITS[s]:
            b, w, p = int(BITS[s]), words[at[mine]], place[mine]
            mask = np.uint64((1 << b) - 1)
            for j in range(COUNT[s]):
                out[p + j] = (w >> np.uint64(j * b)) & mask
    return out[:n_ids]


SEGMENTS = ("part int, seg int, before long, n_ids long, words binary, block_offsets array<int>, "
            "doc_ids array<bigint>, doc_lengths array<bigint>")


def _segment(part: int, seg: int, before: int, doc_ids: list, lengths: list[int], ids: list[np.ndarray]) -> dict:
    words, offsets = pack(np.concatenate(ids))
    return {"part": part, "seg": seg, "before": before, "n_ids": int(sum(lengths)), "words": words.astype("<u8").tobytes(),
            "block_offsets": offsets.tolist(), "doc_ids": doc_ids, "doc_lengths": lengths}


def _arrow_schema(columns: list[tuple[str, pa.DataType]]) -> pa.Schema:
    return pa.schema([pa.field(n, t) for n, t in columns])


_SEGMENT_ARROW = _arrow_schema([
    ("part", pa.int32()), ("seg", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("words", pa.binary()),
    ("block_offsets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())),
    ("doc_lengths", pa.list_(pa.int64()))])


def write_ids(spark: SparkSession, docs: DataFrame, tokenizer_json: bytes, end_id: int | None = None,
              name: str = "simple8b") -> DataFrame:
    """Encode whole texts and write the segments; returns the files as read back.

    Documents are range-partitioned and sorted by (doc_id, hash of the text), nulls first;
    a null text is empty, rows with equal doc_id and text stay as many rows.  Other columns
    are ignored.  Empty input gives an empty file set.
    """
    shipped = spark.sparkContext.broadcast(tokenizer_json)
    tail = np.array([] if end_id is None else [end_id], "<u4")

    def encode(batches):
        from barwise.llm.chunks import encoder
        enc = encoder(shipped.value, memo=MEMO)
        part, seg, before = TaskContext.get().partitionId(), 0, 0
        doc_ids, lengths, held, total = [], [], [], 0
        for rows, texts in text_slices(batches):
            ids, n = enc.encode(texts)
            ids = np.insert(ids, np.cumsum(n), tail) if len(tail) else ids
            n = n + len(tail)
            names, ends, done = rows.column("doc_id").to_pylist(), np.cumsum(n), 0
            while done < len(n):
                # documents up to the one that fills the segment
                base = int(ends[done - 1]) if done else 0
                stop = min(len(n), int(np.searchsorted(ends, base + SEGMENT_IDS - total)) + 1)
                doc_ids += names[done:stop]
                lengths += n[done:stop].tolist()
                held.append(ids[base:ends[stop - 1]])
                total, done = total + int(ends[stop - 1]) - base, stop
                if total >= SEGMENT_IDS:
                    yield pa.RecordBatch.from_pylist([_segment(part, seg, before, doc_ids, lengths, held)], _SEGMENT_ARROW)
                    doc_ids, lengths, held, total, seg, before = [], [], [], 0, seg + 1, before + total
        if doc_ids:
            yield pa.RecordBatch.from_pylist([_segment(part, seg, before, doc_ids, lengths, held)], _SEGMENT_ARROW)

    ordered = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
               .withColumn("_h", row_key("text"))
               .repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h")
               .select("doc_id", "text"))
    return written(spark, ordered.mapInArrow(encode, SEGMENTS), name)


def read_ids(segments: DataFrame) -> DataFrame:
    """Documents of a segment table: doc_id, start, n_tokens, ids (32-bit little-endian binary).

    ``start`` counts the ids of all documents before: those of the part's segments before,
    written with them, and of the parts before (a sum over one row a part).
    """
    return _decoded(segments, "doc_id long, start long, n_tokens long, ids binary",
                    lambda ids: ids, pa.binary(), "ids")


def read_digests(segments: DataFrame) -> DataFrame:
    """As ``read_ids`` with the unsigned crc32 of the ids in their place."""
    return _decoded(segments, "doc_id long, start long, n_tokens long, ids_crc32 long",
                    zlib.crc32, pa.int64(), "ids_crc32")


def _decoded(segments: DataFrame, schema: str, of_ids, kind: pa.DataType, column: str) -> DataFrame:
    # a row a part (a partition of the writer): their running sum goes to every task
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    out = _arrow_schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), (column, kind)])

    def decode(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i] for c in batch.schema.names}
                words = np.frombuffer(r["words"].as_py(), "<u8")
                offsets = r["block_offsets"].values.to_numpy(zero_copy_only=False).astype(np.int64)
                lengths = r["doc_lengths"].values.to_numpy(zero_copy_only=False).astype(np.int64)
                ids = unpack(words, offsets, r["n_ids"].as_py()).astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                starts = ends - lengths
                cells = [of_ids(ids[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [r["doc_ids"].values.cast(pa.int64()), pa.array(starts + r["first"].as_py(), pa.int64()),
                     pa.array(lengths, pa.int64()), pa.array(cells, kind)], schema=out)

    placed = segments.join(F.broadcast(base), "part").withColumn("first", F.col("base") + F.col("before"))
    return placed.drop("part", "seg", "n", "base", "before").mapInArrow(decode, schema)


def op8_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    prepare(spark)
    files = write_ids(spark, table(spark, sf_dir, "documents"),
                      tokenizer_bytes(public_tokenizers.path("word_bpe_49k.json")), end_id=2)
    return read_digests(files)
