"""A sample of registered queries against their DuckDB oracle at sf0.001 (the full
gate runs at sf0.01 through tools/check.py)."""

import duckdb
import pytest

import __spark_entry__ as E
from tools.check import TABLES, _hash, _norm

SAMPLE = ["a02_to_bars_daily", "c15_true_range", "e05_rolling_pack", "f01_ema", "f07_adx", "g08_aroon",
          "j04_clip_bounds", "k06_sequences", "l04_mutual_info", "m05_roc_auc", "n05_weight_search",
          "o03_mcnemar", "p08_regression_decision", "f08_psar_blocked", "s05_incremental_ema"]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, sf, con, name):
    sp = _norm(E.queries()[name](spark, sf).toPandas())
    du = _norm(con.execute(E.oracle_sql()[name]).df())
    assert list(sp.columns) == list(du.columns)
    assert len(sp) == len(du)
    assert _hash(sp) == _hash(du)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() == 25
    assert "signal" in df.columns
