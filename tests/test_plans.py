"""Every registered query of the reference's operators against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from presswork.plans import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, tmp_path, name):
    QUERIES[name](spark, FOLDER).write.parquet(str(tmp_path / "out"))
    con.execute(f"create or replace temp view got as select * from '{tmp_path}/out/*.parquet'")
    if name not in SQL:
        assert con.execute("select count(*) from got").fetchone()[0] > 0
        return
    con.execute(f"create or replace temp table want as {SQL[name]}")
    columns = [dict((r[0], r[1]) for r in con.execute(f"describe {t}").fetchall()) for t in ("got", "want")]
    assert columns[0] == columns[1]
    names = ", ".join(f'"{c}"' for c in sorted(columns[0]))
    for a, b in (("got", "want"), ("want", "got")):
        assert con.execute(f"select {names} from {a} except all select {names} from {b} limit 3").fetchall() == []


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
