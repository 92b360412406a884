"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from maskwright.plans import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_equals_sql(spark, duck, name):
    frame = QUERIES[name].run(spark, SF)
    names = sorted(frame.columns)
    key = lambda row: tuple((v is None, str(v)) for v in row)
    got = sorted((tuple(r) for r in frame.select(names).collect()), key=key)
    want = sorted(duck.execute("select " + ", ".join(f'"{n}"' for n in names) + f" from ({QUERIES[name].oracle()})").fetchall(), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=2e-6) if any(isinstance(x, float) for x in a) and None not in a else a == b
