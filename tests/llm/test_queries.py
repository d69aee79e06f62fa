"""The registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from presswork.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tmp_path, name):
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    QUERIES[name](spark, FOLDER).write.parquet(str(tmp_path / "out"))
    con.execute(f"create temp table got as select * from '{tmp_path}/out/*.parquet'")
    assert con.execute("select count(*) from got").fetchone()[0] > 0
    if name in SQL:
        con.execute(f"create temp table want as {SQL[name]}")
        columns = [dict((r[0], r[1]) for r in con.execute(f"describe {t}").fetchall()) for t in ("got", "want")]
        assert columns[0] == columns[1]
        names = ", ".join(f'"{c}"' for c in sorted(columns[0]))
        for a, b in (("got", "want"), ("want", "got")):
            assert con.execute(f"select {names} from {a} except all select {names} from {b} limit 3").fetchall() == []
