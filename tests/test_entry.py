import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from colloquy.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the supplied tables")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return int(v) if isinstance(v, float) and v == int(v) else v


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.oracle_sql()) == set(catalog.queries())


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.queries()[name](spark, SF)
    cursor = con.execute(catalog.oracle_sql()[name])
    columns = sorted(df.columns)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = [tuple(plain(row[names.index(c)]) for c in columns) for row in cursor.fetchall()]
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
