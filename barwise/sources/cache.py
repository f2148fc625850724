"""Bar cache and result sinks.

The cache is a parquet table partitioned by (source, interval, bucket of the symbol), sorted by
symbol inside: a read for one key prunes to its bucket's folder and row groups; a refetch replaces
the keys it writes and keeps the others.  Folders and files do not multiply with the symbols.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwise.sources.bars import BAR_COLS, BAR_SCHEMA

#: Folders of one (source, interval); a cache must be read and written with the same number.
BUCKETS = 128

CACHE_SCHEMA = T.StructType(list(BAR_SCHEMA.fields) + [
    T.StructField("source", T.StringType()), T.StructField("interval", T.StringType()),
    T.StructField("bucket", T.IntegerType())])


def _bucket(symbol) -> Column:
    return F.pmod(F.xxhash64(symbol), F.lit(BUCKETS)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _stored(spark: SparkSession, path: str, source: str, interval: str) -> DataFrame:
    df = spark.read.schema(CACHE_SCHEMA).option("basePath", path).parquet(path)
    return df.filter((F.col("source") == source) & (F.col("interval") == interval))


def write_cache(bars: DataFrame, path: str, source: str, interval: str) -> None:
    """A09 write: replaces the written keys only.

    Dynamic partition overwrite of their buckets, with the buckets' other symbols carried over.  The rows are
    dealt out by bucket; large buckets are split over tasks and small ones share one.
    """
    spark = bars.sparkSession
    rows = bars.select(*BAR_COLS, F.lit(source).alias("source"), F.lit(interval).alias("interval"),
                       _bucket(F.col("symbol")).alias("bucket"))
    if _exists(spark, path):
        written = rows.select(F.col("bucket").alias("_b"), F.col("symbol").alias("_s")).distinct()
        held = _stored(spark, path, source, interval)
        held = (held.join(written, F.col("bucket") == F.col("_b"), "left_semi")
                .join(written, (F.col("bucket") == F.col("_b")) & F.col("symbol").eqNullSafe(F.col("_s")), "left_anti"))
        rows = rows.unionByName(held)
    (rows.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "symbol", "ts")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("source", "interval", "bucket").parquet(path))


def read_cache(spark: SparkSession, path: str, source: str, interval: str,
               symbols: list[str] | None = None) -> DataFrame:
    """A09 read: explicit schema; key filters prune buckets and, inside, row groups."""
    df = _stored(spark, path, source, interval)
    if symbols is not None:
        df = df.filter(F.col("bucket").isin([_bucket(F.lit(s)) for s in symbols]) & F.col("symbol").isin(symbols))
    return df.select(*BAR_COLS)


def write_results(df: DataFrame, path: str) -> None:
    """Nested results (structs, maps) as JSON lines."""
    df.write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read results back with an explicit schema."""
    return spark.read.schema(schema).json(path)


def save_params(params: DataFrame, path: str) -> None:
    """Fitted parameter table (feature, stat, value[, symbol]) as parquet."""
    params.write.mode("overwrite").parquet(path)


def load_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_model(model, path: str, metadata: dict) -> None:
    """Spark ML model plus a metadata JSON next to it."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "meta string") \
         .coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_model(spark: SparkSession, path: str, loader):
    meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    return loader.load(f"{path}/model"), meta
