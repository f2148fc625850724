"""Operator 6: document quality by Bradley-Terry pairwise ranking.

A document's score is linear in surface features of its whole text.  It is learned from
preference pairs (a document of label 1 over one of label 0) by logistic loss on the
difference of their features, and cut at a quantile of the scores of the labelled rows.
Every labelled row that is not held out is learned from, in blocks of rows of both labels.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise.llm.common import prepare, table, text_groups, written

#: Rows of the rarer and of the commoner label in a block, about; pairs are made inside blocks.
BLOCK = (4_096, 8_192)
#: Steps of the scores' range in which its quantiles are counted.
STEPS = 65_536
#: Documents of label 0 that each document of label 1 is compared with, and back.
PAIRS = 8
RIDGE = 1e-3
FEATURES = 15

_CLASS = np.zeros(256, np.uint8)                      # 0 other
_CLASS[list(b" \t\n\r\x0b\x0c")] = 1
_CLASS[list(range(65, 91))] = 2                       # upper case
_CLASS[list(range(97, 123))] = 3
_CLASS[list(range(48, 58))] = 4
_CLASS[list(b".,;:'\"-()?")] = 5
_CLASS[list(b"!")] = 6
_CLASS[list(b"|#$%&*+/<=>@[\\]^_`{}~")] = 7
_CLASS[128:] = 8                                      # bytes of non-ASCII letters mostly


def features(text: bytes) -> np.ndarray:
    """Shares and logarithms of the whole text; zeros for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(FEATURES)
    counts = np.zeros(9, np.int64)
    for k in range(0, len(text), 1 << 20):
        counts += np.bincount(_CLASS[np.frombuffer(text, np.uint8, min(1 << 20, len(text) - k), k)], minlength=9)
    marks = len(text) - int(counts[1])
    letters = max(1, int(counts[2] + counts[3] + counts[8]))
    seen = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    again = sum(map(bytes.__eq__, words[1:], words))
    sizes = np.fromiter(map(len, words), np.int64, n)
    return np.array([
        math.log1p(n), len(seen) / n, math.log(len(seen) + 1) / math.log(n + 1), again / n,
        max(seen.values()) / n, float(sizes.mean()) / 10, float(sizes.std()) / 10, counts[2] / letters,
        counts[4] / marks, counts[5] / marks, counts[6] / marks, min(1.0, 5 * counts[7] / marks),
        counts[8] / marks, len(set(lines)) / max(1, len(lines)), math.log1p(n / max(1, len(lines)))])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cut: float = 0.0        # score at the threshold quantile
    slope: float = 1.0

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, 0.5 at the threshold."""
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.raw(x) - self.cut), -30, 30)))


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _features_of(df: DataFrame) -> DataFrame:
    """``doc_id`` and the features of every text, in Arrow batches."""
    def run(batches):
        for rows, texts in text_groups(batches):
            x = np.array([features(t) for t in texts])
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(list(x), pa.list_(pa.float64()))],
                                             names=["doc_id", "x"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


def training_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``quality`` and features ``x`` of every labelled row that is not held out, a row an id.
    Labels other than 0 and 1, null ids and ids with both labels are left out; of several texts
    of an id the one with the least features counts."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
             .filter("quality in (0, 1) and doc_id is not null").filter(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
             .filter("quality = most").select("doc_id", F.col("quality").cast("long").alias("quality")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(
        F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # features before the join: no text is shuffled
    return _features_of(texts).join(known, "doc_id").groupBy("doc_id", "quality").agg(F.min("x").alias("x"))


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """``training_table`` as arrays, for ``fit`` on tables that fit the driver; ``train`` never collects it."""
    rows = sorted((r["doc_id"], r["quality"], tuple(r["x"])) for r in training_table(docs, labels).collect())
    return (np.array([r[2] for r in rows]).reshape(len(rows), FEATURES),
            np.array([r[1] for r in rows], np.int64))


def _unfitted() -> Model:
    """The model without rows of both labels: it scores everything 0.5."""
    return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES))


def _pair_sums(model: Model, pairs: int, good: np.ndarray, bad: np.ndarray, *_) -> np.ndarray:
    """Number, gradient and Hessian of the preference pairs of a block, summed; every row of a block
    with rows of both labels is in ``pairs`` pairs at least."""
    out = np.zeros(1 + FEATURES + FEATURES ** 2)
    if len(good) == 0 or len(bad) == 0:
        return out
    good, bad = model.scaled(good), model.scaled(bad)
    n = max(len(good), len(bad))
    i = np.arange(n)
    stride = 31 if len(bad) % 31 else 1       # else it would pass rows by
    for k in range(pairs):
        d = good[i % len(good)] - bad[(i * stride + k * 7919 + 1) % len(bad)]
        p = 1 / (1 + np.exp(-np.clip(d @ model.weight, -30, 30)))
        out += np.concatenate([[n], d.T @ (p - 1), ((d * (p * (1 - p))[:, None]).T @ d).ravel()])
    return out


def _learn(over: Callable, quantiles: Callable, pairs: int = PAIRS, ridge: float = RIDGE) -> Model:
    """Newton steps on the Bradley-Terry likelihood of the preference pairs, then the cut.

    ``over(f)`` sums ``f(good, bad, own_good, own_bad)`` over the blocks: features of the rows to pair,
    and of those counted in this block.  ``quantiles(model, probs)`` are those of all rows' scores.
    """
    n, n_good, *total = over(lambda g, b, good, bad: np.concatenate([[len(good) + len(bad), len(good)], good.sum(0) + bad.sum(0)]))
    mean = np.array(total) / n
    var = over(lambda g, b, good, bad: ((good - mean) ** 2).sum(0) + ((bad - mean) ** 2).sum(0)) / n
    model = Model(mean, np.maximum(np.sqrt(var), 1e-6), np.zeros(FEATURES))
    for _ in range(40):
        held = Model(model.mean, model.scale, model.weight)
        sums = over(lambda *block: _pair_sums(held, pairs, *block))
        if not sums[0]:
            break
        grad = sums[1:1 + FEATURES] / sums[0] + ridge * model.weight
        hess = sums[1 + FEATURES:].reshape(FEATURES, FEATURES) / sums[0] + ridge * np.eye(FEATURES)
        move = np.linalg.solve(hess, grad)
        model.weight = model.weight - move
        if np.abs(move).max() < 1e-8:
            break
    # the quantile of all scores that tells the labels apart best
    fitted = Model(model.mean, model.scale, model.weight)
    qs = np.unique(np.concatenate([np.linspace(0, 1, 401), [(n - n_good) / n]]))
    cuts = np.maximum.accumulate(quantiles(fitted, qs))

    def reached(g, b, good, bad):
        return np.concatenate([np.bincount(np.searchsorted(cuts, fitted.raw(x), "right"), minlength=len(cuts) + 1)
                               for x in (good, bad)])

    good, bad = over(reached).reshape(2, -1)
    right = good[::-1].cumsum()[::-1][1:] / n_good + bad.cumsum()[:-1] / (n - n_good)
    model.cut = float(cuts[np.isclose(right, max(right))].mean())
    middle = over(lambda g, b, good, bad: np.array([fitted.raw(good).sum() + fitted.raw(bad).sum()]))[0] / n
    square = over(lambda g, b, good, bad: np.array([((fitted.raw(good) - middle) ** 2).sum() + ((fitted.raw(bad) - middle) ** 2).sum()]))
    spread = math.sqrt(square[0] / n)
    model.slope = 2.0 / spread if spread > 0 else 1.0
    return model


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE) -> Model:
    """The model of rows in memory, as one block."""
    if len(x) == 0 or y.min() == y.max():
        return _unfitted()
    good, bad = x[y == 1], x[y == 0]
    return _learn(lambda f: f(good, bad, good, bad), lambda m, qs: np.quantile(m.raw(x), qs), pairs, ridge)


def _blocks(rows: DataFrame, n: dict[int, int], size: tuple[int, int]) -> DataFrame:
    """A row a block: the features of its rows of both labels, in order of id, and which of them
    this block counts.  The rarer label is cut into blocks; the commoner one is dealt out to them,
    and to several parts of a block where it is far commoner: the rarer rows are repeated in each part."""
    rare = min(n, key=lambda q: (n[q], q))
    blocks = -(-n[rare] // size[0])
    parts = -(-n[1 - rare] // (blocks * size[1]))

    def deal(salt: str, into: int) -> Column:
        return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(into)).cast("int")

    dealt = rows.select("doc_id", "quality", "x", deal("block", blocks).alias("block"), F.explode(
        F.when(F.col("quality") == rare, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(deal("part", parts)))).alias("part"))

    def gather(group: pa.Table) -> pa.Table:
        group = group.sort_by("doc_id")
        x = group["x"].combine_chunks().flatten().to_numpy().reshape(-1, FEATURES)
        y = group["quality"].to_numpy()
        first = group["part"][0].as_py() == 0
        return pa.table({"good": pa.array([x[y == 1].tobytes()], pa.binary()), "bad": pa.array([x[y == 0].tobytes()], pa.binary()),
                         "own_good": [first or rare != 1], "own_bad": [first or rare != 0]})

    return dealt.groupBy("block", "part").applyInArrow(gather, "good binary, bad binary, own_good boolean, own_bad boolean")


def _each(batches):
    """The arrays of every block, as ``_learn`` takes them."""
    for batch in batches:
        for k in range(batch.num_rows):
            r = batch.slice(k, 1).to_pylist()[0]
            good, bad = (np.frombuffer(r[c]).reshape(-1, FEATURES) for c in ("good", "bad"))
            yield good, bad, good if r["own_good"] else good[:0], bad if r["own_bad"] else bad[:0]


def _sum_over(blocks: DataFrame, f: Callable) -> np.ndarray:
    """The sum of ``f`` over the blocks: a row of sums a task comes to the driver."""
    def run(batches):
        total = None
        for block in _each(batches):
            total = f(*block) if total is None else total + f(*block)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()),
                                              pa.array([total.astype(float)], pa.list_(pa.float64()))], names=["task", "sums"])

    rows = sorted(blocks.mapInArrow(run, "task int, sums array<double>").collect())
    return sum(np.array(r["sums"]) for r in rows)


def _score_quantiles(blocks: DataFrame, model: Model, probs: np.ndarray) -> np.ndarray:
    """Linear-interpolation quantiles of all rows' scores, from the rows, least and greatest score
    counted in each of ``STEPS`` steps of their range: exact but for rows that share a step with two
    others or more, where they are off by less than a step."""
    def run(batches):
        for _, _, good, bad in _each(batches):
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(np.concatenate([good, bad])))], names=["s"])

    scores = blocks.mapInArrow(run, "s double")
    lo, hi = scores.agg(F.min("s"), F.max("s")).first()
    step = F.floor((F.col("s") - lo) / (hi - lo) * STEPS) if hi > lo else F.lit(0)
    # STEPS + 1 rows at most
    steps = sorted(scores.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("s"), F.max("s")).collect())
    _, n, least, most = (np.array(c) for c in zip(*steps))
    before = np.cumsum(n) - n

    def value(rank: np.ndarray) -> np.ndarray:
        k = np.searchsorted(before, rank, "right") - 1
        return least[k] + (most[k] - least[k]) * (rank - before[k]) / np.maximum(1, n[k] - 1)

    at = probs * (n.sum() - 1)
    below, above = value(np.floor(at)), value(np.ceil(at))
    return below + (above - below) * (at - np.floor(at))


def train(docs: DataFrame, labels: DataFrame, size: tuple[int, int] = BLOCK) -> Model:
    """The model of all rows of ``training_table``; rows stay on the executors, in blocks."""
    spark = docs.sparkSession
    rows = written(spark, training_table(docs, labels), "quality-rows")
    n = {0: 0, 1: 0} | {r["quality"]: r["count"] for r in rows.groupBy("quality").count().collect()}
    if not n[0] or not n[1]:
        return _unfitted()
    blocks = written(spark, _blocks(rows, n, size), "quality-blocks")
    return _learn(lambda f: _sum_over(blocks, f), lambda model, probs: _score_quantiles(blocks, model, probs))


def _scored(spark: SparkSession, docs: DataFrame, model: Model) -> tuple[DataFrame, list[Column]]:
    """The rows of ``docs`` under other column names with ``_score``, and the columns back."""
    shipped = spark.sparkContext.broadcast(model)
    held = [c for c in docs.columns if c != "text"]
    names = [f"c{i}" for i in range(len(held))]
    flat = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(held, names)],
                       F.col("text").cast("string").alias("text"))
    schema = flat.select(*names, F.lit(0.0).alias("_score"), "text").schema

    def run(batches):
        for rows, texts in text_groups(batches):
            score = shipped.value.score(np.array([features(t) for t in texts]))
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(n) for n in names), pa.array(score, pa.float64()), rows.column("text")],
                names=[*names, "_score", "text"])

    back = dict(zip(held, names)) | {"text": "text"}
    types = dict(docs.dtypes)
    return flat.mapInArrow(run, schema), [F.col(back[c]).cast(types[c]).alias(c) for c in docs.columns]


def scored(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``_score`` (0 to 1) as last column; empty and null texts have the score of
    no words.  Rows, columns and types are kept, whatever their names."""
    found, back = _scored(spark, docs, model)
    return found.select(*back, "_score")


def accepted(spark: SparkSession, docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score of ``least`` or more; columns as in ``scored``."""
    found, back = _scored(spark, docs, model)
    return found.filter(F.col("_score") >= least).select(*back)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    found = scored(spark, docs, model)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
                        F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
