"""Registry of named queries: Spark builder + output spec + DuckDB oracle text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from barwise.plans import spec as S
from barwise.plans.fixtures_sql import with_fixtures


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    spec: str
    sql: str | None

    def spark(self, spark: SparkSession, d: str) -> DataFrame:
        prepare(spark)
        return S.finalize(self.build(spark, d), self.spec)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        return S.wrap_sql(with_fixtures(self.sql), self.spec)


REGISTRY: dict[str, Query] = {}


def prepare(spark: SparkSession) -> None:
    """Session settings every query relies on, applied to a session built elsewhere.

    Bar timestamps are zone-naive: bucket, window and epoch arithmetic assume the UTC
    session zone (a zone with daylight saving would fold an hour twice a year).  The
    shared checkpoint folder is read from the session (set only when unset).
    """
    from barwise.session import ensure_checkpoint_dir, ship_package
    if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def query(name: str, spec: str, sql: str | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, spec, sql)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # importing the modules registers their queries
    from barwise.plans import (  # noqa: F401
        ingest_queries, feature_queries, scan_queries, prep_queries, model_queries,
        decision_queries, stream_queries, selection_queries, composite_queries, ml_queries)
    from barwise.plans import composite_full_queries  # noqa: F401  (reads the others' oracles)
    return REGISTRY
