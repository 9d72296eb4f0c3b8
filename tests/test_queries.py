import datetime

import duckdb
import pytest

from sembra import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"q_topk_heap", "q_topk_quick", "q_dedup", "q_filter_cascade_learned"}


def norm(v):
    if isinstance(v, float):
        return round(v, 9)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(set(catalogue.ORACLES)))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(catalogue.ORACLES[name])
    got = catalogue.QUERIES[name](spark, sf)
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    a = sorted(repr([norm(r[c]) for c in cols]) for r in got.collect())
    b = sorted(repr([norm(v) for _, v in sorted(zip(want.columns, r))]) for r in want.fetchall())
    assert a == b


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
