import datetime as dt
import math

import duckdb
import pytest

import __spark_entry__ as entry
from kinloom.plans import graphs, ingest

SMALL = "/root/testdata/sf0.001"
NAMES = [n for part in (ingest.reg, graphs.reg) for n in part.queries]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return [plain(x) for x in v] if isinstance(v, list) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def test_names():
    assert set(NAMES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert len(NAMES) == len(set(NAMES))


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    if (sql := entry.oracle_sql().get(name)) is None:
        assert got
        return
    cur = duck.execute(sql)
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    assert got == sorted(str([plain(r[i]) for i in at]) for r in cur.fetchall())


def test_flagship(spark):
    assert entry.entry(spark).columns
