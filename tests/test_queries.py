"""Every registered query against its SQL on the same files."""

import math
import re

import duckdb
import pytest

import __spark_entry__ as entry_point

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
OWN = lambda found: {k: v for k, v in found.items() if k != "pipeline" and not re.match(r"op\d+_", k)}  # tests/llm has the rest
QUERIES = OWN(entry_point.queries())
ORACLE = OWN(entry_point.oracle_sql())


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else (v + 0.0 if isinstance(v, float) else v)
    table = [tuple(clean(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(table, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = canonical(df.columns, df.collect())
    cursor = duck.execute(ORACLE[name])
    want = canonical([c[0] for c in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_without_sql(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["dataset", "metric", "score_mean", "se", "ymin", "ymax"]
    assert df.count() == 9
