"""Every registered query of the engine against its SQL on the smallest tables."""

import math
import os
import time

import duckdb
import pytest

from lodestone.plans import catalog_queries as C

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(rows):
    out = [tuple(round(v, 4) if isinstance(v, float) and not math.isnan(v) else v for v in r) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(C.queries()))
def test_query(spark, con, name):
    df = C.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = plain([tuple(r) for r in df.select(*cols).collect()])
    sql = C.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert got == plain([tuple(r[i] for i in order) for r in want.fetchall()])


def test_term_vectors_of_every_document(spark, con):
    got = {r["doc_id"] for r in C.queries()["term_vectors"](spark, SF).select("doc_id").distinct().collect()}
    assert got >= {r[0] for r in con.execute("SELECT doc_id FROM documents WHERE regexp_matches(text, '[a-z]')").fetchall()} and max(got) >= 40


def test_term_vectors_of_long_texts(spark, tmp_path):
    """Many distinct words in a text: the work does not grow with the square."""
    texts = [(0, "b A b. c"), (1, None), (2, ""), (3, "..."), (4, " ".join(f"w{i}" for i in range(40_000)) + " W1 w39999 w39999")]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "length(text) AS n_chars")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    began = time.time()
    assert same_as_sql(spark, tmp_path, "term_vectors") == 40_003
    assert time.time() - began < 30


def test_term_vectors_are_made_once(spark):
    plan = C.queries()["term_vectors"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(lower(") == 1


def same_as_sql(spark, tables, name):
    """The query against its SQL over the tables in a folder."""
    c = duckdb.connect()
    for f in os.listdir(tables):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{tables}/{f}/*.parquet'")
    want = c.execute(C.oracle_sql()[name])
    names = [x[0] for x in want.description]
    want = plain(want.fetchall())
    return plain([tuple(r[n] for n in names) for r in C.queries()[name](spark, str(tables)).collect()]) == want and len(want)


@pytest.mark.parametrize("name", ["fc_minhit", "fc_multi", "fc_path", "fc_path_child"])
def test_facets_of_more_than_1000_values(spark, tmp_path, name):
    spark.read.parquet(f"{SF}/orders.parquet").selectExpr("* EXCEPT (o_custkey)", "o_orderkey % 1100 AS o_custkey", "explode(sequence(1, 15))").drop("col").write.parquet(str(tmp_path / "orders.parquet"))
    part = spark.read.parquet(f"{SF}/part.parquet").selectExpr("* EXCEPT (p_name, p_type, p_brand)", "explode(sequence(1, 6)) AS k")
    part.selectExpr("* EXCEPT (k)", "concat('n', p_partkey * 6 + k, ' cold') AS p_name", "'PROMO' AS p_type", "concat('b', p_partkey * 6 + k) AS p_brand").unionByName(
        part.selectExpr("* EXCEPT (k)", "'cold' AS p_name", "concat('t', p_partkey * 6 + k) AS p_type", "'b' AS p_brand")
    ).write.parquet(str(tmp_path / "part.parquet"))
    assert same_as_sql(spark, tmp_path, name) > 1000
