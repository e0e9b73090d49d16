"""The training-data queries that SQL can say, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

pytest.importorskip("lodestone.llm")
from lodestone.llm import queries  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE[name]})").fetchall()
    plain = lambda rows: sorted((tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    got = [tuple(r) for r in df.select(*cols).collect()]
    assert plain(got) == plain(want) and got
