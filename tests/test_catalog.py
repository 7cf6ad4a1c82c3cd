"""Every query with SQL gives the same rows on another engine; the others run."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(columns, data):
    def told(v):
        if v is None or isinstance(v, float) and v != v:
            return "null"
        return f"{v + 0.0:.5f}" if isinstance(v, float) else str(v)

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted([tuple(told(r[k]) for k in order) for r in data])


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, sf, duck, name):
    got = catalog.queries()[name](spark, sf)
    want = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", ["average_precision", "confusion_curve", "confusion_metrics", "predictions_with_labels"])
def test_same_rows_where_scores_are_ties(spark, tmp_path, name):
    """Prices in the middle between two scores: 114,000 / 400,000 is 0.285, which is 0.29."""
    con = duckdb.connect()
    con.execute(
        f"""COPY (SELECT k AS o_orderkey, k AS o_custkey, CASE WHEN k % 3 = 0 THEN 'F' ELSE 'O' END AS o_orderstatus, (4000 * k + 2000)::DOUBLE AS o_totalprice,
        TIMESTAMP '1999-01-01' + INTERVAL (10 * k) DAY AS o_orderdate, '1-URGENT' AS o_orderpriority FROM range(130) t(k)) TO '{tmp_path}/orders.parquet'"""
    )
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    got, want = catalog.queries()[name](spark, str(tmp_path)), con.execute(catalog.oracle_sql()[name])
    assert rows(got.columns, got.collect()) == rows([d[0] for d in want.description], want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    found = entry.entry(spark)
    assert {r["column"] for r in found.where("drift_detected").collect()} >= {"shifted", "moved"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_without_what_some_operators_need():
    """Where a library of the training-data operators is missing, the engine's own queries stay."""
    import subprocess
    import sys

    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    told = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert [int(x) for x in told] == [len(catalog.queries()), len(catalog.oracle_sql())]
