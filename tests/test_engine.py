"""Statements, errors, nulls, JSON results and streaming forms."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone import bql
from lodestone.catalog import EngineError, Facet, Table
from lodestone.engine import Engine
from lodestone.operators import updates
from lodestone.sources import readers
from lodestone.streaming import ingest


@pytest.fixture(scope="module")
def engine(spark):
    rows = [(1, "red", 10, ["a", "b"], "x/y/z", None), (2, None, 20, ["b"], "x/y", "t"), (3, "blue", None, [], "x/w", "t"), (4, "red", 40, None, "q", "")]
    df = spark.createDataFrame(rows, "id long, color string, n int, tags array<string>, path string, contents string")
    return Engine(Table.of(df, "id", [Facet("n", "range", ranges=("[0 TO 15]", "[10 TO *]")), Facet("tags", "multi"), Facet("path", "path")]))


def ids(engine, where):
    return sorted(r["id"] for r in engine.bql(f"SELECT id FROM t WHERE {where} LIMIT 100").hits.collect())


@pytest.mark.parametrize(
    ("where", "want"),
    [("color = 'red'", [1, 4]), ("color <> 'red'", [2, 3]), ("color NOT IN ('red')", [2, 3]), ("n <> 20", [1, 4]), ("n < 25", [1, 2]), ("tags IS NULL", [3, 4]), ("tags = 'b'", [1, 2]), ("tags NOT IN ('a')", [2, 3, 4]),
     ("path = 'x/y'", [1, 2]), ("color = 'red' AND n > 5 AND n <= 10", [1]), ("NOT MATCH(contents) AGAINST('t')", [1, 4]), ("color IS NOT NULL OR n = 20", [1, 2, 3, 4]), ("color LIKE 'b%'", [3])],
)
def test_nulls_and_excludes(engine, where, want):
    assert ids(engine, where) == want


@pytest.mark.parametrize(
    ("statement", "message"),
    [("SELECT * FROM t WHERE n > 5 AND n < 3", "Inconsistent ranges"), ("SELECT * FROM t LIMIT 1 LIMIT 2", "can only appear once"), ("SELECT * FROM t WHERE nope = 1", "not defined"), ("SELECT * FROM t WHERE n = 'x'", "does not match"),
     ("SELECT * FROM t WHERE path <> 'x'", "cannot be used"), ("SELECT * FROM t WHERE color = $v", "Variable is not defined"), ("SELECT * FROM t WHERE color CONTAINS ALL ('a')", "CONTAINS ALL"), ("SELECT * FROM t DISTINCT tags", "DISTINCT"), ("SELECT median(n) FROM t", "Unknown aggregate"), ("SELECT * FROM t WHERE n = 99999999999999999999", "out of range")],
)
def test_errors(engine, statement, message):
    with pytest.raises(EngineError, match=message):
        engine.bql(statement)


def test_error_has_a_place():
    with pytest.raises(EngineError, match=r"\[line:2, col:6\]"):
        bql.parse("SELECT *\nFROM  = 3")


def test_clause_order_and_comments(engine):
    a = bql.parse("SELECT id FROM t LIMIT 3 ORDER BY id DESC -- note\n BROWSE BY color(true, 2, 5, value)")
    b = bql.parse("select id /* x */ from t browse by color(true, 2, 5, value) order by id desc limit 3;")
    assert a == b and a["facets"]["color"] == {"expand": True, "minHit": 2, "max": 5, "order": "val"}


def test_result_json(engine):
    out = json.loads(engine.bql("SELECT id, _srcdata FROM t WHERE color = 'red' ORDER BY n DESC BROWSE BY color, n").to_json())
    assert out["numhits"] == 2 and out["totaldocs"] == 4 and [h["id"] for h in out["hits"]] == [4, 1]
    assert {x["value"]: x["hits"] for x in out["facets"]["n"]} == {"[0 TO 15]": 1, "[10 TO *]": 2}


def test_strict_mode_refuses_queries(engine):
    with pytest.raises(EngineError, match="not supported"):
        Engine(engine.table, strict=True).request({"query": {"match_all": {}}})


def test_groups_cover_all_hits(engine):
    hits = engine.bql("SELECT id FROM t GROUP BY color LIMIT 100").hits.collect()
    assert sum(h["_grouphitscount"] for h in hits) == 4


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i % 5, (i * 7) % 31, i) for i in range(60)]
    df = spark.createDataFrame(rows, "uid long, version long, value long").repartition(3)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    total = ingest.run_once(ingest.counters(stream, "uid", "value"), "totals")
    assert sorted(map(tuple, total.collect())) == sorted(map(tuple, df.groupBy("uid").agg(F.sum("value")).collect()))
    write = ingest.merge_into(str(tmp_path / "out"), "uid", "version")
    stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    merged = ingest.read_merged(spark, str(tmp_path / "out"), "uid", "version")
    want = updates.last_write_wins(df, "uid", "version", F.lit("add"))
    assert sorted(r["uid"] for r in merged.collect()) == sorted(r["uid"] for r in want.collect())
    assert {r["uid"]: r["version"] for r in merged.collect()} == {r["uid"]: r["version"] for r in want.collect()}


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("i,l,f,s\n1,5000000000,1.5,x\nN/A,2,3,y\n")
    assert readers.csv(spark, str(tmp_path / "a.csv")).dtypes == [("i", "int"), ("l", "bigint"), ("f", "double"), ("s", "string")]
    df = spark.range(50).withColumn("x", F.col("id") % 3)
    readers.write_segments(df, str(tmp_path / "seg"), "id", 4, sort=["x"], bloom=["id"])
    back = spark.read.parquet(str(tmp_path / "seg"))
    assert back.count() == 50 and {r["shard"] for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}
    with pytest.raises(RuntimeError, match="class path"):
        readers.connector(spark, "kafka", subscribe="t")


def test_split_multi_keeps_escaped_delimiters(spark):
    from lodestone.catalog import split_multi

    df = spark.createDataFrame([("a\\,b,c",), ("x\\\\,y",), (" p , q ",), ("",), (None,)], "v string")
    assert [r.s for r in df.select(split_multi(F.col("v")).alias("s")).collect()] == [["a,b", "c"], ["x\\", "y"], ["p", "q"], [], None]


def test_limit_all_and_large_limits(engine):
    assert engine.bql("SELECT id FROM t LIMIT ALL").hits.count() == 4
    plan = engine.bql("SELECT id FROM t ORDER BY n LIMIT 0, 1000000000").hits._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" in plan


def test_shard_of_the_least_long(spark):
    df = spark.createDataFrame([(-(2**63),), (-5,), (7,), (None,)], "k long")
    assert [r.s for r in df.select(updates.shard(F.col("k"), 4).alias("s")).collect()] == [0, 1, 3, 0]


@pytest.mark.parametrize(("like", "want"), [("%lu%", [3]), ("r%", [1, 4]), ("%e", [3]), ("red", [1, 4]), ("b_ue", [3]), ("%", [1, 3, 4])])
def test_like_forms(engine, like, want):
    assert ids(engine, f"color LIKE '{like}'") == want


def test_group_hits(engine):
    rows = {r["groupvalue"]: r for r in engine.bql("SELECT id FROM t ORDER BY n DESC GROUP BY color TOP 1 LIMIT ALL").hits.collect()}
    assert rows["red"]["_grouphitscount"] == 2 and rows["red"]["grouphits"] == [4] and rows[None]["grouphits"] == [2]


def test_respond_lists_typed_errors(engine):
    number = lambda text: json.loads(engine.respond(text))["errors"][0]["errorCode"]
    assert number("{") == 100 and number('{"query": {"nope": {}}}') == 101 and number('{"bql": "SELECT"}') == 150
    where = json.loads(engine.respond('{"bql": "SELECT *\\nFROM  = 3"}'))["errors"][0]
    assert (where["line"], where["col"]) == (2, 6)
    assert [h["id"] for h in json.loads(engine.respond('{"bql": "SELECT id FROM t WHERE color = $c", "templateMapping": {"c": "blue"}}'))["hits"]] == [3]
    assert {c["name"] for c in json.loads(engine.respond('{"bql": "DESCRIBE t"}'))["columns"]} >= {"id", "tags"}


def test_counters_are_joined_only_where_they_are_asked_for(spark, engine):
    likes = spark.createDataFrame([(1, 5), (3, 9), (77, 9)], "id long, likes long")
    e = Engine(engine.table.extended(likes, [Facet("likes", "range", ranges=("[1 TO 5]",))], activity=True))
    assert e.table.activity == ("likes",)
    assert sorted(r.id for r in e.bql("SELECT id FROM t WHERE likes >= 5 LIMIT ALL").hits.collect()) == [1, 3]
    assert sorted(r.id for r in e.bql("SELECT id FROM t WHERE likes IS NULL LIMIT ALL").hits.collect()) == [2, 4]
    plan = lambda ask: e.bql(ask).hits._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan("SELECT id FROM t WHERE likes > 1") and "Join" not in plan("SELECT id FROM t WHERE color = 'red'")
    assert "likes" in e.bql("SELECT * FROM t").hits.columns


def test_rewritten_aggregates_stand_among_the_facets(engine):
    out = json.loads(engine.bql("SELECT sum(n), count(*) FROM t GROUP BY color").to_json())
    assert out["facets"]["_sumGroupBy"] == [{"value": "red", "hits": 50}, {"value": "blue", "hits": None}] and "aggregates" not in out
    assert {x["value"]: x["hits"] for x in out["facets"]["color"]} == {"red": 2, "blue": 1}
    assert "aggregates" in json.loads(engine.bql("SELECT sum(n), avg(n) FROM t GROUP BY color").to_json())


def test_explanation_is_json(engine):
    ask = {"query": {"bool": {"should": [{"term": {"contents": "t"}}, {"term": {"color": {"value": "red", "boost": 3.0}}}]}}, "explain": True, "size": None}
    rows = {r["id"]: json.loads(r["_explanation"]) for r in engine.request(ask).hits.collect()}
    assert rows[1]["value"] == 3 and [d["value"] for d in rows[1]["details"]] == [0, 3] and rows[2]["value"] == 1


def _upsert_events():
    #      uid version kind a b
    return [(1, 1, "add", "x", 1), (1, 3, "update", None, 7), (1, 2, "update", "y", None), (2, 5, "add", "p", 1), (2, 6, "delete", None, None), (2, 4, "add", "stale", 9), (3, 1, "update", "none", 1), (4, 1, None, "q", None), (4, 2, "skip", "r", 2), (2, 9, "add", "back", 3), (None, 1, "add", "z", 1)]


@pytest.mark.parametrize("files", [1, 11])
def test_upserts(spark, tmp_path, files):
    schema = "uid long, version long, type string, a string, b long"
    rows = _upsert_events() if files == 1 else sorted(_upsert_events(), key=lambda r: (r[1], r[0] or 0))
    for i, at in enumerate(range(0, len(rows), -(-len(rows) // files))):
        spark.createDataFrame(rows[at : at + -(-len(rows) // files)], schema).coalesce(1).write.json(str(tmp_path / f"in/{i:02}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(str(tmp_path / "in"))
    got = ingest.run_once(ingest.upserts(stream, "uid", "version"), f"upserts_{files}", "update")
    last = {}
    for r in sorted(got.collect(), key=lambda r: r["version"]):
        last[r["uid"]] = (r["version"], r["a"], r["b"], r["_deleted"])
    assert last == {1: (3, "y", 7, False), 2: (9, "back", 3, False), 4: (1, "q", None, False)}


def test_parts_roll_into_segments(spark, tmp_path):
    parts, segments = str(tmp_path / "parts"), str(tmp_path / "segments")
    write = ingest.roll_at(parts, segments, "uid", "version", 40, ["value"])
    frames = [spark.range(20).select(F.col("id").alias("uid"), F.lit(e).alias("version"), (F.col("id") * e % 7).alias("value")) for e in range(5)]
    for e, df in enumerate(frames):
        write(df, e)
    write(frames[4], 4)  # repeated
    assert sorted(p.name for p in (tmp_path / "segments").iterdir() if p.is_dir()) == ["segment=1", "segment=3"]
    got = ingest.read_rolled(spark, parts, segments, "uid", "version").collect()
    assert {(r["uid"], r["version"], r["value"]) for r in got} == {(i, 4, i * 4 % 7) for i in range(20)} and len(got) == 20
