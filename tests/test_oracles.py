"""Every registered query against its DuckDB oracle on sf0.001 (the driver
runs the same comparison at sf0.01); queries without an oracle must run."""

import math
from collections import Counter

import duckdb
import pytest

from conftest import SF_SMALL
from rivulet.plans.registry import load_all

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
#: Run in full by the registered queries that check their lists and scores.
RUN_BY_CHECKS = {"recommend": "recommend_checks", "rank_candidates": "rank_candidates_checks"}
REG = load_all()


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return str(v)
    return v


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in recs)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(n for n, q in REG.items() if q.sql))
def test_oracle(spark, duck, name):
    q = REG[name]
    sdf = q.build(spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    res = duck.execute(q.sql)
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert _rows(sdf.columns, srows) == _rows(dcols, res.fetchall())


@pytest.mark.parametrize("name", sorted(n for n, q in REG.items() if not q.sql and RUN_BY_CHECKS.get(n) not in REG))
def test_runs_without_oracle(spark, name):
    assert REG[name].build(spark, SF_SMALL).count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
