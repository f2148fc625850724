"""Shared helpers of the text operators: tables, scratch tables, tokenizer shipping."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise.session import ensure_checkpoint_dir, scratch_path, ship_package

#: Text handled at once inside a Python task, in bytes; bounds a worker's memory.
GROUP_BYTES = 2 << 20


def prepare(spark: SparkSession) -> None:
    """Shared folder and package shipping for a session built elsewhere."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage,
    and a lost executor only costs the tasks it was running."""
    path = scratch_path(spark, f"llm/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Write a small file into the shared folder, whatever store that is; returns its full path."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, f"llm/{name}"))
    store = path.getFileSystem(sc._jsc.hadoopConfiguration())
    out = store.create(path, True)
    out.write(bytearray(data))
    out.close()
    return store.makeQualified(path).toString()


def aliased(df: DataFrame) -> tuple[DataFrame, dict[str, str], list[Column]]:
    """``df`` with its columns called c0, c1, ...; the new name of each; and what selects them
    back.  Columns that an operator adds in between clash with none, whatever they are called."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names)), [F.col(n).alias(c) for n, c in zip(names, df.columns)]


def literal_rows(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A small table of given values, as a literal of the plan (no Python on executors)."""
    fields = [f.split() for f in schema.split(", ")]
    data = json.dumps([dict(zip((n for n, _ in fields), r)) for r in rows])
    kind = "array<struct<" + ",".join(f"{n}:{t}" for n, t in fields) + ">>"
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(data), kind)))


def text_groups(batches: Iterable[pa.RecordBatch], column: str = "text",
                limit: int = GROUP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the Arrow batches with at most ``limit`` bytes of text each (one row at
    least), and their texts as UTF-8; null texts are empty."""
    for batch in batches:
        texts = [b"" if t is None else t
                 for t in batch.column(column).cast(pa.binary()).to_pylist()] if batch.num_rows else []
        start, size = 0, 0
        for i, t in enumerate(texts):
            if i > start and size + len(t) > limit:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t)
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text",
                limit: int = 2 * GROUP_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """As ``text_groups``, with the texts as an Arrow string array (nulls filled)."""
    for batch in batches:
        texts = batch.column(column).cast(pa.string()).fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(texts):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start), texts.slice(start, stop - start)
            start = stop


def row_key(*cols: str):
    """Deterministic 64-bit key of a row's columns (equal rows have equal keys)."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in cols])


def tokenizer_bytes(path: str) -> bytes:
    """A tokenizer file's content; executors get it by broadcast (a few MB, fixed size)."""
    with open(path, "rb") as f:
        return f.read()
