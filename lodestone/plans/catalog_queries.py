"""The engine's operators over the test tables: for each key a statement or request and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.catalog import Facet, Table
from lodestone.engine import Engine
from lodestone.operators import aggregates, facets, federation, fulltext, predicates, updates
from lodestone.streaming import ingest

NOW = 904_694_400_000  # 1998-09-02
ALL = "LIMIT ALL"
_Q: dict[str, tuple[Callable, str | None]] = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark, d) -> Table:
    df = _read(spark, d, "orders").withColumns({"o_ms": F.unix_millis(F.col("o_orderdate").cast("timestamp")), "pri": F.expr("nullif(o_orderpriority, '5-LOW')")})
    ranges = ("[0 TO 100000]", "[50000 TO 200000)", "[200000 TO *)")
    return Table.of(df, "o_orderkey", [Facet("o_orderstatus"), Facet("o_orderpriority"), Facet("price", "range", "o_totalprice", ranges=ranges), Facet("hist", "histogram", "o_totalprice", start=0, end=400000, unit=50000), Facet("age", "dynamicTimeRange", "o_ms", ranges=("030000000", "365000000", "900000000")), Facet("virtual", "custom", derive=lambda: F.col("o_custkey") % 7)])


def lineitem(spark, d) -> Table:
    return Table.of(_read(spark, d, "lineitem"), None, [Facet("l_quantity", "range", ranges=("[1 TO 10]", "[11 TO 20]", "[21 TO *]"))])


def part(spark, d) -> Table:
    df = _read(spark, d, "part")
    tags = F.split("p_name", " ")
    df = df.withColumns({"tags": tags, "path": F.concat_ws("/", "p_type", "p_brand", "p_name"), "attrs": F.array(F.concat(F.lit("brand="), "p_brand"), F.concat(F.lit("type="), "p_type"), F.concat(F.lit("size="), F.col("p_size").cast("string"))), "wtags": F.transform(tags, lambda w: F.struct(w.alias("v"), F.col("p_size").alias("w"))), "sizes": F.array(F.col("p_size"), F.col("p_size") + 100)})
    return Table.of(df, "p_partkey", [Facet("p_brand"), Facet("tags", "multi"), Facet("path", "path"), Facet("attrs", "attribute", separator="=", per_key=3), Facet("wtags", "weighted-multi"), Facet("sizes", "multi-range", ranges=("[1 TO 10]", "[105 TO 120]"))])


def documents(spark, d) -> Table:
    return Table.of(_read(spark, d, "documents"), "doc_id", [Facet("lang"), Facet("source")], text="text")


def events(spark, d) -> DataFrame:
    return _read(spark, d, "events").withColumns({"minute": F.expr("unix_seconds(cast(ts as timestamp)) div 60"), "delta": F.col("value").cast("long")})


_VIEWS = {
    "orders": "(SELECT *, epoch_ms(o_orderdate) AS o_ms, nullif(o_orderpriority, '5-LOW') AS pri FROM orders)",
    "lineitem": "lineitem",
    "part": "(SELECT *, string_split(p_name, ' ') AS tags, concat_ws('/', p_type, p_brand, p_name) AS path FROM part)",
    "documents": r"(SELECT doc_id, lang, source, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') || ' ' AS t, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)",
}


def customers(spark, d) -> Table:
    """Customers with a counter of their events."""
    likes = events(spark, d).groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("likes"))
    return Table.of(_read(spark, d, "customer"), "c_custkey").extended(likes, [Facet("likes", "range", ranges=("[1 TO 3]", "[4 TO *]"))], activity=True)


def plugged(spark, d) -> Table:
    """Orders beside which another engine keeps their largest quantity."""
    most = lineitem(spark, d).df.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_quantity").cast("double").alias("most"))
    return orders(spark, d).extended(most, [Facet("most", "range", ranges=("[1 TO 25]", "(25 TO *]"))])


_TABLES = {"customer": customers, "plugged": plugged, "orders": orders, "lineitem": lineitem, "part": part, "documents": documents}


def _run(table: str, ask, part_of: str = "hits", fix: Callable | None = None, **engine):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine(_TABLES[table](spark, sf_dir), now_ms=NOW, **engine)
        r = e.bql(ask) if isinstance(ask, str) else e.request(ask)
        if isinstance(r, DataFrame):
            out = r
        else:
            kind, _, name = part_of.partition(":")
            out = {"hits": lambda: r.hits, "counts": lambda: r.counts, "agg": lambda: r.aggregates, "mr": lambda: r.map_reduce, "facet": lambda: r.facets[name]}[kind]()
        return fix(out) if fix else out

    return query


def _add(key: str, fn: Callable, sql: str | None = None) -> None:
    _Q[key] = (fn, sql)


def _where(key: str, table: str, where: str, sql: str, cols: str = "o_orderkey") -> None:
    _add(key, _run(table, f"SELECT {cols} FROM {table} WHERE {where} {ALL}"), f"SELECT {cols} FROM {_VIEWS[table]} v WHERE {sql}")


def _req(key: str, table: str, request: dict, sql: str, cols: str) -> None:
    _add(key, _run(table, {"select": cols.split(", "), "size": None, **request}), f"SELECT {cols} FROM {_VIEWS[table]} v WHERE {sql}")


# -- projection and predicates
_add("project_cols", _run("orders", f"SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders {ALL}"), "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
_add("project_star", _run("lineitem", f"SELECT * FROM lineitem {ALL}"), "SELECT * FROM lineitem")
_where("p_eq", "orders", "o_orderstatus = 'F'", "o_orderstatus = 'F'")
_where("p_neq", "orders", "pri <> '1-URGENT'", "pri <> '1-URGENT' OR pri IS NULL")
_where("p_neq_range", "orders", "price <> 1000.5", "o_totalprice <> 1000.5")
_where("p_in", "orders", "o_orderpriority IN ('1-URGENT', '2-HIGH')", "o_orderpriority IN ('1-URGENT', '2-HIGH')")
_where("p_not_in", "orders", "pri NOT IN ('1-URGENT', '2-HIGH')", "pri NOT IN ('1-URGENT', '2-HIGH') OR pri IS NULL")
_where("p_in_except", "orders", "pri IN ('1-URGENT', '2-HIGH') EXCEPT ('2-HIGH')", "pri = '1-URGENT'")
_where("p_in_empty", "orders", "pri IN ()", "false")
_where("p_between", "orders", "o_totalprice BETWEEN 1000 AND 90000", "o_totalprice BETWEEN 1000 AND 90000")
_where("p_not_between", "orders", "o_totalprice NOT BETWEEN 1000 AND 90000", "NOT o_totalprice BETWEEN 1000 AND 90000")
_where("p_range", "orders", "o_totalprice > 50000 AND o_custkey <= 90", "o_totalprice > 50000 AND o_custkey <= 90")
_where("p_range_merge", "orders", "o_totalprice > 50000 AND o_totalprice <= 150000 AND o_totalprice >= 60000", "o_totalprice >= 60000 AND o_totalprice <= 150000")
_where("p_since", "orders", "o_ms SINCE 1997-01-01", "o_orderdate > TIMESTAMP '1997-01-01'")
_where("p_before", "orders", "o_ms BEFORE 1995-06-17", "o_orderdate < TIMESTAMP '1995-06-17'")
_where("p_in_last", "orders", "o_ms IN LAST 52 weeks", f"o_ms > {NOW - 52 * 604800000}")
_where("p_not_in_last", "orders", "o_ms NOT IN LAST 3 days, 2 hours", f"o_ms <= {NOW - 3 * 86400000 - 2 * 3600000}")
_where("p_ago", "orders", "o_ms > 400 days AGO", f"o_ms > {NOW - 400 * 86400000}")
_where("p_like", "part", "p_name LIKE '%widget%'", "p_name LIKE '%widget%'", "p_partkey")
_where("p_not_like", "part", "p_name NOT LIKE 'c_ld%'", "p_name NOT LIKE 'c_ld%'", "p_partkey")
_where("p_null", "orders", "pri IS NULL", "pri IS NULL")
_where("p_not_null", "orders", "pri IS NOT NULL", "pri IS NOT NULL")
_where("p_and_or", "orders", "o_orderstatus = 'F' AND (o_totalprice < 20000 OR o_orderpriority = '1-URGENT') OR o_custkey = 7", "o_orderstatus = 'F' AND (o_totalprice < 20000 OR o_orderpriority = '1-URGENT') OR o_custkey = 7")
_where("p_empty", "orders", "[] IS EMPTY AND o_orderstatus = 'P'", "o_orderstatus = 'P'")
_where("p_contains_all", "part", "tags CONTAINS ALL ('cold', 'widget')", "list_has_all(tags, ['cold', 'widget'])", "p_partkey")
_where("p_multi_in", "part", "tags IN ('cold', 'hot') EXCEPT ('widget')", "list_has_any(tags, ['cold', 'hot']) AND NOT list_contains(tags, 'widget')", "p_partkey")
_req("p_ids", "orders", {"filter": {"ids": {"values": [1, 2, 3, 500], "excludes": [2]}}}, "o_orderkey IN (1, 3, 500)", "o_orderkey")
_req("p_bool", "orders", {"filter": {"bool": {"must": [{"term": {"o_orderstatus": "F"}}], "must_not": [{"term": {"pri": "1-URGENT"}}], "should": [{"range": {"o_totalprice": {"lt": 30000}}}, {"range": {"o_totalprice": {"gte": 100000}}}]}}}, "o_orderstatus = 'F' AND (pri <> '1-URGENT' OR pri IS NULL) AND (o_totalprice < 30000 OR o_totalprice >= 100000)", "o_orderkey")
_req("p_range_json", "orders", {"filter": {"range": {"o_totalprice": {"from": 1000, "to": 50000, "include_lower": False, "include_upper": True}}}}, "o_totalprice > 1000 AND o_totalprice <= 50000", "o_orderkey")
_req("p_sel_range_str", "orders", {"selections": [{"terms": {"price": {"values": ["[0 TO 40000)", "(300000 TO *]"]}}}]}, "(o_totalprice >= 0 AND o_totalprice < 40000) OR o_totalprice > 300000", "o_orderkey")
_req("p_const_exp", "orders", {"filter": {"const_exp": {"lvalue": [1, 2], "operator": "in", "rvalue": [1, 2, 3]}}}, "true", "o_orderkey")
_req("p_retention", "orders", {"filter": {"retention": {"column": "o_ms", "now": NOW, "days": 300}}}, f"o_ms >= {NOW - 300 * 86400000}", "o_orderkey")
_req("p_selection", "orders", {"selections": [{"term": {"o_orderstatus": {"value": "O"}}}, {"terms": {"pri": {"values": [], "excludes": ["3-MEDIUM"]}}}]}, "o_orderstatus = 'O' AND (pri <> '3-MEDIUM' OR pri IS NULL)", "o_orderkey")
_req("partitions", "orders", {"partitions": [1]}, "abs(o_orderkey) % 2 = 1", "o_orderkey")


def _variables(spark, d):
    e = Engine(orders(spark, d), NOW)
    return e.bql(f"SELECT o_orderkey FROM orders WHERE o_orderstatus = $s AND o_totalprice > $p {ALL}", {"s": "F", "p": 1000}, extra_filter="o_custkey < 50").hits


_add("p_variables", _variables, "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 AND o_custkey < 50")
_add("p_extra_filter", lambda s, d: Engine(orders(s, d), NOW).bql(f"SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' {ALL}", extra_filter="o_totalprice > 100000 OR o_custkey < 9").hits, "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND (o_totalprice > 100000 OR o_custkey < 9)")

# -- facet-kind predicates
_where("f_path_select", "part", "path = 'PROMO'", "path = 'PROMO' OR starts_with(path, 'PROMO/')", "p_partkey")
_req("f_path_strict", "part", {"filter": {"path": {"path": {"value": "PROMO", "strict": True, "depth": 2}}}}, "starts_with(path, 'PROMO/') AND len(string_split(path, '/')) = 3", "p_partkey")
_where("f_attr_select", "part", "attrs IN ('size=5', 'size=7')", "p_size IN (5, 7)", "p_partkey")
_where("f_attr_key", "part", "attrs = 'brand'", "p_brand IS NOT NULL", "p_partkey")
_req("f_multi_range", "part", {"selections": [{"terms": {"sizes": {"values": ["[1 TO 3]", "[110 TO 112]"]}}}]}, "p_size BETWEEN 1 AND 3 OR p_size BETWEEN 110 AND 112 OR p_size + 100 BETWEEN 1 AND 3 OR p_size + 100 BETWEEN 110 AND 112", "p_partkey")
_where("f_weighted", "part", "wtags = 'cold'", "list_contains(tags, 'cold')", "p_partkey")

# -- facet counts
_V = lambda df: df.select(F.col("value").cast("string").alias("value"), "hits")


def _facet(key: str, table: str, name: str, spec: str, sql: str, where: str = "") -> None:
    _add(key, _run(table, f"SELECT * FROM {table} {where} BROWSE BY {name}{spec}", f"facet:{name}", _V), sql)


_facet("fc_count", "orders", "o_orderpriority", "(false, 1, 100, hits)", "SELECT o_orderpriority AS value, count(*) AS hits FROM orders WHERE o_orderstatus = 'F' GROUP BY 1", "WHERE o_orderstatus = 'F'")
_facet("fc_minhit", "orders", "o_custkey", "(false, 15, 0, hits)", "SELECT CAST(o_custkey AS VARCHAR) AS value, count(*) AS hits FROM orders GROUP BY 1 HAVING count(*) >= 15")
_facet("fc_order_hits", "orders", "o_custkey", "(false, 1, 7, hits)", "SELECT CAST(o_custkey AS VARCHAR) AS value, count(*) AS hits FROM orders GROUP BY o_custkey ORDER BY hits DESC, o_custkey LIMIT 7")
_facet("fc_order_val", "orders", "o_custkey", "(false, 1, 7, value)", "SELECT CAST(o_custkey AS VARCHAR) AS value, count(*) AS hits FROM orders GROUP BY o_custkey ORDER BY o_custkey LIMIT 7")
_facet("fc_expand", "orders", "o_orderpriority", "(true, 1, 100, hits)", "SELECT o_orderpriority AS value, count(*) AS hits FROM orders WHERE o_orderstatus = 'F' GROUP BY 1", "WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
_facet("fc_selected", "orders", "o_custkey", "(true, 1, 3, value)", "SELECT CAST(o_custkey AS VARCHAR) AS value, hits FROM (SELECT o_custkey, count(*) AS hits FROM orders GROUP BY 1 ORDER BY 1 LIMIT 3) UNION SELECT CAST(k AS VARCHAR), (SELECT count(*) FROM orders WHERE o_custkey = k) FROM (VALUES (70), (-5)) x(k)", "WHERE o_custkey IN (70, -5)")
_facet("fc_range", "orders", "price", "(false, 1, 10, hits)", "SELECT '[0 TO 100000]' AS value, count(*) AS hits FROM orders WHERE o_totalprice BETWEEN 0 AND 100000 HAVING count(*) > 0 UNION ALL SELECT '[50000 TO 200000)', count(*) FROM orders WHERE o_totalprice >= 50000 AND o_totalprice < 200000 HAVING count(*) > 0 UNION ALL SELECT '[200000 TO *)', count(*) FROM orders WHERE o_totalprice >= 200000 HAVING count(*) > 0")
_facet("fc_multi", "part", "tags", "(false, 1, 0, hits)", "SELECT t AS value, count(*) AS hits FROM (SELECT unnest(list_distinct(string_split(p_name, ' '))) AS t FROM part) GROUP BY 1")
_facet("fc_path", "part", "path", "(false, 1, 0, hits)", "SELECT p_type AS value, count(*) AS hits FROM part GROUP BY 1")
_facet("fc_path_child", "part", "path", "(false, 1, 0, hits)", "SELECT p_type || '/' || p_brand AS value, count(*) AS hits FROM part WHERE p_type = 'PROMO' GROUP BY 1", "WHERE path = 'PROMO'")
_facet("fc_attr", "part", "attrs", "(false, 1, 1000, hits)", "SELECT value, hits FROM (SELECT value, hits, row_number() OVER (PARTITION BY split_part(value, '=', 1) ORDER BY hits DESC, value) AS r FROM (SELECT a AS value, count(*) AS hits FROM (SELECT unnest(['brand=' || p_brand, 'type=' || p_type, 'size=' || p_size]) AS a FROM part) GROUP BY 1)) WHERE r <= 3")
_facet("fc_hist", "orders", "hist", "(false, 1, 1000, hits)", "SELECT CAST(CAST(floor(o_totalprice / 50000) AS BIGINT) AS VARCHAR) AS value, count(*) AS hits FROM orders WHERE o_totalprice >= 0 AND o_totalprice < 400000 GROUP BY 1")
_add("fc_dyn", _run("orders", {"facets": {"age": {"max": 10}}, "facetInit": {"age": {"now": NOW}}}, "facet:age", _V), "".join(f"{' UNION ALL ' if i else ''}SELECT '{r}' AS value, count(*) AS hits FROM orders WHERE epoch_ms(o_orderdate) > {NOW} - {int(r[:3])} * 86400000::BIGINT AND epoch_ms(o_orderdate) <= {NOW} HAVING count(*) > 0" for i, r in enumerate(("030000000", "365000000", "900000000"))))
_add("fc_sum_groupby", lambda s, d: _V(facets.sum_group_by(part(s, d).df, Facet("tags", "multi"), "p_size")), "SELECT t AS value, CAST(sum(p_size) AS BIGINT) AS hits FROM (SELECT unnest(list_distinct(string_split(p_name, ' '))) AS t, p_size FROM part) GROUP BY 1")
_add("fc_sum", lambda s, d: facets.sum_of(part(s, d).df, "p_size"), "SELECT 'p_size' AS value, CAST(sum(p_size) AS BIGINT) AS hits FROM part")
_add("fc_custom", _run("orders", {"facets": {"virtual": {"max": 100}}}, "facet:virtual", _V), "SELECT CAST(o_custkey % 7 AS VARCHAR) AS value, count(*) AS hits FROM orders GROUP BY 1")
_add("res_counts", _run("orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey", "counts"), "SELECT count(*) FILTER (o_orderstatus = 'F') AS numhits, count(*) AS totaldocs, count(DISTINCT o_custkey) FILTER (o_orderstatus = 'F') AS numgroups FROM orders")


# -- aggregates
def _round(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 2).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _agg(key: str, table: str, ask: str, sql: str) -> None:
    _add(key, _run(table, ask, "agg", _round), sql)


_agg("a_count", "lineitem", "SELECT count(*) FROM lineitem WHERE l_returnflag = 'R'", "SELECT count(*) AS count_all FROM lineitem WHERE l_returnflag = 'R'")
_agg("a_sum", "lineitem", "SELECT sum(l_extendedprice) FROM lineitem WHERE l_returnflag = 'R'", "SELECT round(sum(l_extendedprice), 2) AS sum_l_extendedprice FROM lineitem WHERE l_returnflag = 'R'")
_agg("a_avg", "lineitem", "SELECT avg(l_discount) FROM lineitem", "SELECT round(avg(l_discount), 2) AS avg_l_discount, count(*) AS avg_l_discount_count FROM lineitem")
_agg("a_min_uid", "orders", "SELECT min(o_totalprice) FROM orders", "SELECT round(min(o_totalprice), 2) AS min_o_totalprice, (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1) AS min_o_totalprice_uid FROM orders")
_agg("a_max_uid", "orders", "SELECT max(o_totalprice) FROM orders", "SELECT round(max(o_totalprice), 2) AS max_o_totalprice, (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS max_o_totalprice_uid FROM orders")
_agg("a_distinct", "orders", "SELECT distinctCount(o_custkey) FROM orders", "SELECT count(DISTINCT o_custkey) AS distinctcount_o_custkey FROM orders")
for _fn, _dir in (("sum", "DESC"), ("count", "DESC"), ("avg", "DESC"), ("min", "ASC"), ("max", "DESC")):
    _col = f"{_fn}_o_totalprice"
    _extra = ", count(*) AS avg_o_totalprice_count" if _fn == "avg" else ""
    _agg(f"a_groupby_{_fn}", "orders", f"SELECT {_fn}(o_totalprice) FROM orders GROUP BY o_custkey TOP 20", f"SELECT o_custkey, {'count(*)' if _fn == 'count' else f'round({_fn}(o_totalprice), 2)'} AS {_col}{_extra} FROM orders GROUP BY o_custkey ORDER BY {'count(*)' if _fn == 'count' else f'{_fn}(o_totalprice)'} {_dir}, o_custkey LIMIT 20")
_agg("a_groupby_multi", "lineitem", "SELECT sum(l_quantity), count(*), min(l_discount) FROM lineitem WHERE l_quantity BETWEEN 5 AND 40 GROUP BY l_returnflag, l_linestatus TOP 100", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_l_quantity, count(*) AS count_all, round(min(l_discount), 2) AS min_l_discount FROM lineitem WHERE l_quantity BETWEEN 5 AND 40 GROUP BY 1, 2")
_agg("a_composite", "orders", "SELECT sum(o_totalprice), count(*), distinctCount(o_orderpriority) FROM orders", "SELECT round(sum(o_totalprice), 2) AS sum_o_totalprice, count(*) AS count_all, count(DISTINCT o_orderpriority) AS distinctcount_o_orderpriority FROM orders")
_agg("a_groupby_tags", "part", "SELECT count(*) FROM part GROUP BY tags TOP 1000", "SELECT tags, count(*) AS count_all FROM (SELECT unnest(list_distinct(string_split(p_name, ' '))) AS tags FROM part) GROUP BY 1")
_add("a_sorted_unique", _run("orders", "SELECT * FROM orders EXECUTE(sorted_unique_values, {'valueColumn': 'o_custkey', 'sortColumn': 'o_totalprice', 'offset': 2, 'size': 9})", "mr"), "SELECT o_custkey AS value, max(o_totalprice) AS sort_value FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 9 OFFSET 2")
_add("a_execute", _run("orders", "SELECT * FROM orders WHERE o_orderstatus = 'O' EXECUTE(count_group_by, 'columns': ['o_orderstatus', 'o_orderpriority'])", "mr"), "SELECT concat_ws(':', o_orderstatus, o_orderpriority) AS \"group\", count(*) AS count FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
_add("a_distinct_uid", _run("orders", "SELECT * FROM orders EXECUTE(distinct_uid, 'column': 'o_orderkey')", "mr"), 'SELECT count(DISTINCT o_orderkey) AS "distinct" FROM orders')
_add("a_list_uids", _run("orders", "SELECT * FROM orders WHERE o_custkey = 7 EXECUTE(list_uids, 'column': 'o_orderkey')", "mr"), "SELECT o_orderkey AS uid FROM orders WHERE o_custkey = 7")
_add("a_column_stats", _run("orders", {"mapReduce": {"function": "column_stats", "parameters": {"columns": ["o_orderstatus", "pri"]}}}, "mr"), None)

# -- sort, page, groups
_add("s_order", _run("orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT 25"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
_add("s_order_multi", _run("orders", "SELECT o_orderkey, pri FROM orders ORDER BY pri, o_totalprice DESC LIMIT 50"), f"SELECT o_orderkey, pri FROM {_VIEWS['orders']} ORDER BY pri NULLS FIRST, o_totalprice DESC, o_orderkey LIMIT 50")
_add("s_limit", _run("orders", "SELECT o_orderkey FROM orders ORDER BY o_custkey LIMIT 30, 15"), "SELECT o_orderkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 15 OFFSET 30")
_GH = lambda df: df.select("o_orderkey", "groupvalue", "_grouphitscount", F.array_join(F.transform("grouphits", lambda x: x.cast("string")), ",").alias("uids"))
_add("g_collapse", _run("orders", f"SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC GROUP BY o_custkey {ALL}", "hits", lambda df: df.select("o_orderkey", "groupvalue", "_grouphitscount")), "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS groupvalue, n AS _grouphitscount FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE r = 1")
_add("g_collapse_top", _run("orders", f"SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC GROUP BY o_custkey TOP 3 {ALL}", "hits", _GH), "SELECT min(o_orderkey) FILTER (r = 1) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS groupvalue, any_value(n) AS _grouphitscount, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY r) FILTER (r <= 3) AS uids FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_orderstatus = 'F') GROUP BY o_custkey")
_add("g_fallback", _run("orders", f"SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 ORDER BY o_totalprice GROUP BY o_custkey OR o_orderpriority {ALL}", "hits", lambda df: df.select("o_orderkey", "groupfield", "groupvalue", "_grouphitscount")), "WITH a AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS c1, count(*) OVER (PARTITION BY o_orderpriority) AS c2 FROM orders WHERE o_totalprice > 100000), b AS (SELECT *, CASE WHEN c1 > 1 THEN 'o_custkey' WHEN c2 > 1 THEN 'o_orderpriority' ELSE 'o_custkey' END AS groupfield FROM a), c AS (SELECT *, CASE groupfield WHEN 'o_custkey' THEN CAST(o_custkey AS VARCHAR) ELSE o_orderpriority END AS groupvalue FROM b), d AS (SELECT *, row_number() OVER (PARTITION BY groupfield, groupvalue ORDER BY o_totalprice, o_orderkey) AS r, count(*) OVER (PARTITION BY groupfield, groupvalue) AS n FROM c) SELECT o_orderkey, groupfield, groupvalue, n AS _grouphitscount FROM d WHERE r = 1")
_add("g_virtual", _run("orders", {"select": ["o_orderkey"], "groupBy": {"columns": ["virtual"]}, "size": 1000}, "hits", lambda df: df.select("o_orderkey", "groupvalue", "_grouphitscount")), "SELECT min(o_orderkey) AS o_orderkey, CAST(o_custkey % 7 AS VARCHAR) AS groupvalue, count(*) AS _grouphitscount FROM orders GROUP BY 2")
_add("d_distinct", _run("orders", f"SELECT o_orderkey FROM orders ORDER BY o_totalprice DISTINCT o_custkey {ALL}", "hits", lambda df: df.select("o_orderkey")), "SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS r FROM orders) WHERE r = 1")
_add("d_in_group", _run("orders", f"SELECT o_orderkey FROM orders ORDER BY o_totalprice GROUP BY o_custkey TOP 3 DISTINCT o_orderpriority {ALL}", "hits", _GH), "WITH a AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders), b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY r) AS p FROM a), c AS (SELECT *, CASE WHEN p = 1 THEN row_number() OVER (PARTITION BY o_custkey, p ORDER BY r) END AS k FROM b) SELECT min(o_orderkey) FILTER (r = 1) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS groupvalue, any_value(n) AS _grouphitscount, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY r) FILTER (k <= 3) AS uids FROM c GROUP BY o_custkey")


# -- text
def _text(key: str, query: dict, sql: str) -> None:
    _req(key, "documents", {"query": query}, sql, "doc_id")


_text("q_match_all", {"match_all": {}}, "true")
_text("q_term", {"term": {"text": "hand"}}, "list_contains(w, 'hand')")
_text("q_terms_minmatch", {"terms": {"text": {"values": ["the", "of", "la", "der"], "minimum_match": 2, "excludes": ["which"]}}}, "(list_contains(w, 'the')::INT + list_contains(w, 'of')::INT + list_contains(w, 'la')::INT + list_contains(w, 'der')::INT) >= 2 AND NOT list_contains(w, 'which')")
_text("q_prefix", {"prefix": {"text": "anbl"}}, "contains(t, ' anbl')")
_text("q_wildcard", {"wildcard": {"text": "th?th*"}}, "regexp_matches(t, ' th[^ ]th[^ ]* ')")
_text("q_bool", {"bool": {"must": [{"term": {"text": "the"}}], "must_not": [{"term": {"text": "from"}}], "should": [{"term": {"text": "by"}}, {"term": {"text": "with"}}, {"term": {"text": "that"}}], "minimum_number_should_match": 2}}, "list_contains(w, 'the') AND NOT list_contains(w, 'from') AND (list_contains(w, 'by')::INT + list_contains(w, 'with')::INT + list_contains(w, 'that')::INT) >= 2")
_text("q_text_and", {"text": {"text": {"value": "the of and", "operator": "and"}}}, "list_has_all(w, ['the', 'of', 'and'])")
_text("q_phrase", {"text": {"text": {"value": "of the", "type": "phrase"}}}, "contains(t, ' of the ')")
_text("q_filtered", {"filtered": {"query": {"term": {"text": "the"}}, "filter": {"term": {"lang": "fr"}}}}, "list_contains(w, 'the') AND lang = 'fr'")
_text("q_string", {"query_string": {"query": '+the -"of the" (by OR with*)'}}, "list_contains(w, 'the') AND NOT contains(t, ' of the ')")
_text("q_string_and", {"query_string": {"query": "the AND of AND NOT lang:fr"}}, "list_contains(w, 'the') AND list_contains(w, 'of') AND NOT lang = 'fr'")
_text("q_span_near", {"span_near": {"clauses": [{"span_term": {"text": "of"}}, {"span_term": {"text": "the"}}], "slop": 1, "in_order": True}}, "regexp_matches(t, ' of ([^ ]+ )?the ')")
_text("q_span_first", {"span_first": {"match": {"span_term": {"text": "the"}}, "end": 5}}, "list_contains(w[1:5], 'the')")
_text("q_span_or", {"span_or": {"clauses": [{"span_term": {"text": "warum"}}, {"span_term": {"text": "nicht"}}]}}, "list_has_any(w, ['warum', 'nicht'])")
_text("q_span_not", {"span_not": {"include": {"span_term": {"text": "hand"}}, "exclude": {"span_near": {"clauses": [{"span_term": {"text": "the"}}, {"span_term": {"text": "hand"}}], "slop": 0, "in_order": True}}}}, "len(list_filter(range(1, len(w) + 1), lambda i: w[i] = 'hand' AND (i = 1 OR w[i - 1] <> 'the'))) > 0")
_where("p_match", "documents", "MATCH(text) AGAINST('hand AND the')", "list_contains(w, 'hand') AND list_contains(w, 'the')", "doc_id")
_where("p_not_match", "documents", "NOT MATCH(text) AGAINST('the')", "NOT list_contains(w, 'the')", "doc_id")
_where("p_query_is", "documents", "QUERY IS 'of AND and' AND lang = 'en'", "list_contains(w, 'of') AND list_contains(w, 'and') AND lang = 'en'", "doc_id")
_add("q_dis_max", _run("documents", {"select": ["doc_id", "_score"], "size": None, "query": {"dis_max": {"queries": [{"term": {"text": {"term": "the", "boost": 2.0}}}, {"term": {"text": "of"}}], "tie_breaker": 0.5}}}), f"SELECT doc_id, CASE WHEN list_contains(w, 'the') AND list_contains(w, 'of') THEN 2.5 WHEN list_contains(w, 'the') THEN 2.0 ELSE 1.0 END::DOUBLE AS _score FROM {_VIEWS['documents']} WHERE list_has_any(w, ['the', 'of'])")
# the plain explode would filter by the vectors' sizes before the sort, which makes them several times
_add("term_vectors", lambda s, d: Engine(documents(s, d)).request({"select": ["doc_id"], "size": None, "termVectors": ["text"]}).hits.select("doc_id", F.explode_outer("_termvector_text").alias("x")).where("x IS NOT NULL").select("doc_id", "x.term", "x.freq"), f"SELECT doc_id, term, count(*)::INT AS freq FROM (SELECT doc_id, unnest(w) AS term FROM {_VIEWS['documents']}) GROUP BY 1, 2")


# -- relevance
def _score(key: str, table: str, cols: str, model: str, sql: str | None) -> None:
    _add(key, _run(table, f"SELECT {cols}, \"_score\" FROM {table} USING RELEVANCE MODEL {model} ORDER BY RELEVANCE {ALL}", "hits", lambda df: df.withColumn("_score", F.round("_score", 6))), sql)


_score("r_math", "orders", "o_orderkey", "m (k:2.5) DEFINED AS (double k, int o_custkey, double o_totalprice) BEGIN double x = o_totalprice / 1000.0; if (o_custkey > 50) x *= k; else { x += 1; } return x > 100 ? Math.log(x) : x; END", "SELECT o_orderkey, round(CASE WHEN x > 100 THEN ln(x) ELSE x END, 6) AS _score FROM (SELECT o_orderkey, CASE WHEN o_custkey > 50 THEN o_totalprice / 1000.0::DOUBLE * 2.5::DOUBLE ELSE o_totalprice / 1000.0::DOUBLE + 1 END AS x FROM orders)")
_score("r_set_lookup", "orders", "o_orderkey", "m (s:['1-URGENT', '2-HIGH']) DEFINED AS (set_string s, string o_orderpriority) BEGIN if (s.contains(o_orderpriority)) return 10; return 1; END", "SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 10.0 ELSE 1.0 END::DOUBLE AS _score FROM orders")
_score("r_map_lookup", "orders", "o_orderkey", "m (w:{'F':3, 'O':2}) DEFINED AS (map_string_int w, string o_orderstatus) BEGIN if (w.containsKey(o_orderstatus)) return w.get(o_orderstatus) * 2; return 0.5; END", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 6.0 WHEN 'O' THEN 4.0 ELSE 0.5 END::DOUBLE AS _score FROM orders")
_score("r_switch", "orders", "o_orderkey", "m () DEFINED AS (string o_orderstatus) BEGIN double r = 0; switch (o_orderstatus) { case \"F\": r = 1; break; case \"O\": r = 2; break; default: r = 3; } return r * _INNER_SCORE; END", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 2.0 ELSE 3.0 END::DOUBLE AS _score FROM orders")
_score("r_multi_contains", "part", "p_partkey", "m (a:['cold', 'hot']) DEFINED AS (set_string a, mstring tags) BEGIN if (tags.containsAny(a)) return 2; if (tags.contains(\"widget\")) return 1; return 0; END", "SELECT p_partkey, CASE WHEN list_has_any(string_split(p_name, ' '), ['cold', 'hot']) THEN 2.0 WHEN list_contains(string_split(p_name, ' '), 'widget') THEN 1.0 ELSE 0.0 END::DOUBLE AS _score FROM part")
_score("r_weighted", "part", "p_partkey", "m () DEFINED AS (wmint wtags) BEGIN if (wtags.hasWeight(\"cold\")) return wtags.getWeight(\"cold\"); return -1; END", "SELECT p_partkey, CASE WHEN list_contains(string_split(p_name, ' '), 'cold') THEN p_size ELSE -1 END::DOUBLE AS _score FROM part")
_score("r_loop", "part", "p_partkey", "m () DEFINED AS (int p_size) BEGIN double s = 0; for (int i = 1; i <= p_size; i++) { s += i; } return s; END", "SELECT p_partkey, (p_size * (p_size + 1) / 2)::DOUBLE AS _score FROM part")


# -- updates, counters, federation
def _lww(s, d):
    kind = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "skip").otherwise("add")
    return updates.last_write_wins(events(s, d).select("user_id", "event_id", "event_type", "value"), "user_id", "event_id", kind)


_add("t_lww", _lww, "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_type <> 'view') WHERE r = 1 AND event_type <> 'error'")
_add("t_partial_update", lambda s, d: updates.partial_update(_read(s, d, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal", "c_mktsegment"), events(s, d).select(F.col("user_id").alias("k"), F.col("event_id").alias("v"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("c_acctbal"), F.when(F.col("event_type") == "click", F.lit("CLICKED")).alias("c_mktsegment")), "k", "v"), "SELECT c_custkey AS k, coalesce(b, c_acctbal) AS c_acctbal, coalesce(m, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN (SELECT user_id, arg_max(value, event_id) FILTER (event_type = 'purchase') AS b, arg_max('CLICKED', event_id) FILTER (event_type = 'click') AS m FROM events GROUP BY 1) ON user_id = c_custkey")
_add("t_activity_sum", lambda s, d: updates.fold_counter(events(s, d).withColumn("ds", F.when(F.col("event_type") == "signup", F.col("delta").cast("string")).otherwise(F.concat(F.lit("+"), F.col("delta").cast("string")))), "user_id", "event_id", "ds", "likes"), "WITH e AS (SELECT user_id, event_id, trunc(value)::BIGINT AS delta, event_type = 'signup' AS is_set FROM events), l AS (SELECT user_id AS u, max(event_id) FILTER (is_set) AS set_at FROM e GROUP BY 1) SELECT user_id, sum(delta)::DOUBLE AS likes FROM e JOIN l ON u = user_id WHERE set_at IS NULL OR event_id >= set_at GROUP BY 1")
_NOW_MIN = 28_430_000  # inside January 2024
_add("t_trailing", lambda s, d: updates.trailing(events(s, d), "user_id", "minute", "delta", ["1h", "1d", "7d", "2w"], _NOW_MIN), f"SELECT user_id, sum(x)::BIGINT AS total, {', '.join(f'coalesce(sum(x) FILTER ({_NOW_MIN} - m >= 0 AND {_NOW_MIN} - m < {p}), 0)::BIGINT AS last_{n}' for n, p in (('1h', 60), ('1d', 1440), ('7d', 10080), ('2w', 20160)))} FROM (SELECT user_id, epoch_ms(ts) // 60000 AS m, trunc(value)::BIGINT AS x FROM events) GROUP BY 1")
_add("t_trailing_running", lambda s, d: updates.trailing_running(events(s, d), "user_id", "minute", "delta", "1d").select("event_id", "last_1d"), "SELECT event_id, CAST(sum(x) OVER (PARTITION BY user_id ORDER BY m RANGE BETWEEN 1439 PRECEDING AND CURRENT ROW) AS BIGINT) AS last_1d FROM (SELECT *, epoch_ms(ts) // 60000 AS m, trunc(value)::BIGINT AS x FROM events)")
_add("t_version", lambda s, d: updates.reject_stale(events(s, d).withColumn("v", (F.col("event_id") * 7919) % 1009), "user_id", "v", "event_id").select("event_id", "v"), "SELECT event_id, v FROM (SELECT event_id, v, max(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM (SELECT *, (event_id * 7919) % 1009 AS v FROM events)) WHERE s IS NULL OR v >= s")
_add("t_purge", lambda s, d: updates.purge(events(s, d).groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("n")), _read(s, d, "customer").where("c_acctbal > 0"), "c_custkey"), "SELECT user_id AS c_custkey, count(*) AS n FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1")
_add("j_activity", lambda s, d: updates.with_activity(_read(s, d, "customer").select("c_custkey", "c_name"), events(s, d).groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("likes")), "c_custkey"), "SELECT c_custkey, c_name, likes FROM customer LEFT JOIN (SELECT user_id, count(*) AS likes FROM events GROUP BY 1) ON user_id = c_custkey")
_add("t_retention", lambda s, d: updates.retain(orders(s, d).df, "o_ms", 365, NOW).select("o_orderkey"), f"SELECT o_orderkey FROM orders WHERE epoch_ms(o_orderdate) >= {NOW} - 365 * 86400000::BIGINT")
_add("t_hourglass", lambda s, d: updates.hourglass(events(s, d), "ts", "day", 5).groupBy(F.col("slice").cast("date").alias("day")).agg(F.count("*").alias("n")), "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 5")
_add("src_shard", lambda s, d: _read(s, d, "orders").groupBy(updates.shard(F.col("o_orderkey"), 7).alias("shard")).agg(F.count("*").alias("n")), "SELECT CAST(abs(o_orderkey) % 7 AS INT) AS shard, count(*) AS n FROM orders GROUP BY 1")
_add("scan_get", lambda s, d: Engine(orders(s, d)).get([1, 2, 77]).select(F.col("_uid").alias("uid"), F.get_json_object("_srcdata", "$.o_orderstatus").alias("status")), "SELECT o_orderkey AS uid, o_orderstatus AS status FROM orders WHERE o_orderkey IN (1, 2, 77)")
_add("describe", _run("orders", "DESCRIBE orders"), None)


def _split(s, d):
    o = orders(s, d).df.select("o_orderkey", "o_ms", "o_totalprice")
    return o.where("o_ms < 883612800000"), o.where("o_ms >= 852076800000")


_add("fed_union", lambda s, d: federation.union(list(_split(s, d))).groupBy("o_orderkey").agg(F.count("*").alias("n")), "SELECT o_orderkey, (epoch_ms(o_orderdate) < 883612800000)::BIGINT + (epoch_ms(o_orderdate) >= 852076800000)::BIGINT AS n FROM orders")
_add("fed_lambda", lambda s, d: federation.split_at_boundary(*_split(s, d), "o_ms", 868000000000).select("o_orderkey"), "SELECT o_orderkey FROM orders")
_add("fed_layered", lambda s, d: federation.layered([orders(s, d).df.where("o_orderstatus = 'P'"), orders(s, d).df.where("o_orderstatus = 'F'")], 500, ["o_orderkey"]).select("o_orderkey"), "SELECT o_orderkey FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 0 ELSE 1 END AS l FROM orders WHERE o_orderstatus IN ('P', 'F')) ORDER BY l, o_orderkey LIMIT 500")
_add("api_url", lambda s, d: Engine(orders(s, d)).url("start=5&rows=20&sort=o_totalprice:desc&select.o_orderstatus.val=F").hits.select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")


# -- counters and other engines' fields in requests
_LIKES = "(SELECT c_custkey, likes FROM customer LEFT JOIN (SELECT user_id, count(*) AS likes FROM events GROUP BY 1) ON user_id = c_custkey)"
_add("f_activity_range", _run("customer", f"SELECT c_custkey, likes FROM customer WHERE likes >= 2 AND likes < 9 {ALL}"), f"SELECT c_custkey, likes FROM {_LIKES} WHERE likes >= 2 AND likes < 9")
_facet("fc_activity", "customer", "likes", "(false, 1, 10, hits)", f"SELECT '[1 TO 3]' AS value, count(*) AS hits FROM {_LIKES} WHERE likes BETWEEN 1 AND 3 HAVING count(*) > 0 UNION ALL SELECT '[4 TO *]', count(*) FROM {_LIKES} WHERE likes >= 4 HAVING count(*) > 0")
_add("u_engine", _run("plugged", f"SELECT o_orderkey, most FROM orders WHERE most > 45 AND o_orderstatus = 'F' {ALL}"), "SELECT o_orderkey, CAST(most AS DOUBLE) AS most FROM orders JOIN (SELECT l_orderkey, max(l_quantity) AS most FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE most > 45 AND o_orderstatus = 'F'")
_facet("u_engine_facet", "plugged", "most", "(false, 1, 10, hits)", "SELECT CASE WHEN most <= 25 THEN '[1 TO 25]' ELSE '(25 TO *]' END AS value, count(*) AS hits FROM (SELECT l_orderkey, max(l_quantity) AS most FROM lineitem GROUP BY 1) JOIN orders ON l_orderkey = o_orderkey WHERE most >= 1 GROUP BY 1")

# -- results of one group column as facets, accessors, user aggregates in batches
_add("a_rewrite_sum", _run("orders", "SELECT sum(o_totalprice) FROM orders GROUP BY o_custkey TOP 20", "facet:_sumGroupBy", lambda df: df.select(F.col("value").cast("string").alias("value"), F.round("hits", 2).alias("hits"))), "SELECT CAST(o_custkey AS VARCHAR) AS value, round(sum(o_totalprice), 2) AS hits FROM orders GROUP BY o_custkey ORDER BY sum(o_totalprice) DESC LIMIT 20")
_add("a_rewrite_count", _run("orders", "SELECT count(*) FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey TOP 20", "facet:o_custkey", _V), "SELECT CAST(o_custkey AS VARCHAR) AS value, count(*) AS hits FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey ORDER BY hits DESC, o_custkey LIMIT 20")
_add("fc_accessor", _run("orders", "SELECT * FROM orders WHERE o_orderstatus = 'F' EXECUTE(facet_counts, 'column': 'o_orderpriority')", "mr", lambda df: df.withColumn("share", F.round("share", 4))), "SELECT o_orderpriority AS value, count(*) AS hits, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
_add("u_field_accessor", _run("orders", "SELECT * FROM orders WHERE o_orderstatus = 'F' EXECUTE(fields_by_uid, 'reference': 'o_custkey', 'columns': ['o_orderpriority', 'o_totalprice'])", "mr"), "SELECT k AS uid, o_orderpriority, o_totalprice FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') LEFT JOIN orders ON o_orderkey = k")


def _sums(pdf, params):
    """Sums of ``of`` by ``by``; the same step maps, combines and reduces."""
    return pdf.rename(columns={params["by"]: "key", params["of"]: "total"})[["key", "total"]].groupby("key", as_index=False).sum()


aggregates.REGISTRY["sums_in_batches"] = aggregates.map_reduce(_sums, lambda pdf, _: pdf.groupby("key", as_index=False).sum(), lambda pdf, _: pdf.groupby("key", as_index=False).sum(), "key string, total double")
_add("a_batching", _run("orders", "SELECT * FROM orders EXECUTE(sums_in_batches, 'by': 'o_orderpriority', 'of': 'o_totalprice')", "mr", _round), "SELECT o_orderpriority AS key, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
_add("fc_order_custom", lambda s, d: _V(facets.browse(orders(s, d).df, Facet("o_orderpriority"), {"max": 2}, order=F.substring("value", 3, 20))), "SELECT o_orderpriority AS value, count(*) AS hits FROM orders GROUP BY 1 ORDER BY substr(o_orderpriority, 3) LIMIT 2")
_facet("f_given_param", "orders", "hist", "(false, 1, 100, hits)", "SELECT CAST(CAST(floor(o_totalprice / 100000) AS BIGINT) AS VARCHAR) AS value, count(*) AS hits FROM orders WHERE o_totalprice >= 0 AND o_totalprice < 300000 GROUP BY 1", "GIVEN FACET PARAM (hist, 'unit', double, 100000.0), (hist, 'end', double, 300000.0)")

# -- queries, filters, clauses that the sections above leave out
_where("l_props", "part", "path = 'PROMO' WITH ('strict': true, 'depth': 2)", "starts_with(path, 'PROMO/') AND len(string_split(path, '/')) = 3", "p_partkey")
_where("l_clauses", "orders", "o_orderstatus = 'F' /* any order */ AND o_totalprice > 100000.0 -- of clauses\n", "o_orderstatus = 'F' AND o_totalprice > 100000")
_req("p_const_false", "orders", {"filter": {"or": [{"const_exp": {"lvalue": 3, "operator": "<", "rvalue": 2}}, {"term": {"o_orderstatus": "P"}}]}}, "o_orderstatus = 'P'", "o_orderkey")
_req("q_match_none", "orders", {"query": {"match_none": {}}}, "false", "o_orderkey")
_req("q_range", "orders", {"query": {"range": {"o_totalprice": {"from": 1000, "to": 50000, "include_lower": False, "include_upper": True}}}}, "o_totalprice > 1000 AND o_totalprice <= 50000", "o_orderkey")
_req("q_path", "part", {"query": {"path": {"path": {"value": "PROMO"}}}}, "path = 'PROMO' OR starts_with(path, 'PROMO/')", "p_partkey")
_req("q_ids", "orders", {"query": {"ids": {"values": [5, 6, 7, 8], "excludes": [7]}}}, "o_orderkey IN (5, 6, 8)", "o_orderkey")
_req("q_const_exp", "orders", {"query": {"bool": {"must": [{"const_exp": {"lvalue": "a", "operator": "==", "rvalue": "a"}}, {"term": {"o_orderstatus": "P"}}]}}}, "o_orderstatus = 'P'", "o_orderkey")
fulltext.CUSTOM_QUERIES["at_least"] = lambda table, spec: (table.facet(spec["column"]).expr >= spec["value"], F.lit(2.0))
predicates.CUSTOM_FILTERS["at_most"] = lambda table, spec: table.facet(spec["column"]).expr <= spec["value"]
_req("q_custom", "orders", {"query": {"custom": {"class": "at_least", "column": "o_totalprice", "value": 150000}}}, "o_totalprice >= 150000", "o_orderkey")
_req("p_custom_filter", "orders", {"filter": {"custom": {"class": "at_most", "column": "o_totalprice", "value": 20000}}}, "o_totalprice <= 20000", "o_orderkey")
_req("p_query_filter", "documents", {"filter": {"query": {"term": {"text": "hand"}}}}, "list_contains(w, 'hand')", "doc_id")
_add("s_docrev", _run("orders", {"select": ["o_orderkey"], "sort": ["docrev"], "size": 30}), "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 30")
_add("fetch_stored", _run("orders", f"SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' FETCHING STORED {ALL}", "hits", lambda df: df.select("o_orderkey", F.get_json_object("_srcdata", "$.o_orderpriority").alias("priority"))), "SELECT o_orderkey, o_orderpriority AS priority FROM orders WHERE o_orderstatus = 'P'")
_add("route_by", _run("orders", f"SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ROUTE BY 'a' {ALL}"), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
_EXPLAIN = {"bool": {"must": [{"term": {"text": {"term": "the", "boost": 2.0}}}], "should": [{"term": {"text": "of"}}, {"term": {"text": "hand"}}]}}
_part_of = lambda path: F.get_json_object("_explanation", path).cast("double")
_add("explain", _run("documents", {"select": ["doc_id"], "size": None, "query": _EXPLAIN, "explain": True}, "hits", lambda df: df.select("doc_id", _part_of("$.value").alias("score"), _part_of("$.details[0].value").alias("the"), _part_of("$.details[2].value").alias("hand"))), f"SELECT doc_id, (2 + list_contains(w, 'of')::INT + list_contains(w, 'hand')::INT)::DOUBLE AS score, 2.0::DOUBLE AS the, list_contains(w, 'hand')::INT::DOUBLE AS hand FROM {_VIEWS['documents']} v WHERE list_contains(w, 'the')")
_add("project_special", _run("documents", {"select": ["_uid", "_termvectors"], "size": None, "filter": {"term": {"lang": "fr"}}}, "hits", lambda df: df.select(F.col("_uid").alias("uid"), F.size("_termvectors").alias("terms"))), f"SELECT doc_id AS uid, CAST(len(list_distinct(w)) AS INT) AS terms FROM {_VIEWS['documents']} v WHERE lang = 'fr'")

# -- relevance: the JSON form, saved models, the clock
_SCORED = lambda df: df.withColumn("_score", F.round("_score", 6))
_TIMES = {"variables": {"double": ["k"]}, "facets": {"double": ["o_totalprice"]}, "function": "return o_totalprice * k;"}
_add("r_json_model", _run("orders", {"select": ["o_orderkey", "_score"], "size": None, "relevance": {"model": _TIMES, "values": {"k": 0.5}}}, "hits", _SCORED), "SELECT o_orderkey, round(o_totalprice * 0.5, 6) AS _score FROM orders")
_add("q_relevance", _run("orders", {"select": ["o_orderkey", "_score"], "size": None, "query": {"term": {"o_orderstatus": "F", "relevance": {"model": _TIMES, "values": {"k": 2.0}}}}}, "hits", _SCORED), "SELECT o_orderkey, round(o_totalprice * 2, 6) AS _score FROM orders WHERE o_orderstatus = 'F'")
_score("r_now", "orders", "o_orderkey", "m () DEFINED AS (long o_ms) BEGIN return (_NOW - o_ms) / 86400000.0; END", f"SELECT o_orderkey, round(({NOW} - epoch_ms(o_orderdate)) / 86400000.0, 6)::DOUBLE AS _score FROM orders")
_score("r_exp", "orders", "o_orderkey", "m () DEFINED AS (int o_custkey) BEGIN return Math.exp(0 - o_custkey / 100.0); END", "SELECT o_orderkey, round(exp(0 - o_custkey / 100.0), 6)::DOUBLE AS _score FROM orders")


def _saved(spark, d):
    e = Engine(orders(spark, d), NOW)
    e.request({"relevance": {"model": {**_TIMES, "save_as": {"name": "times_k"}}, "values": {"k": 1.0}}})
    return _SCORED(e.request({"select": ["o_orderkey", "_score"], "size": None, "relevance": {"predefined_model": "times_k", "values": {"k": 3.0}}}).hits)


_add("r_saved", _saved, "SELECT o_orderkey, round(o_totalprice * 3, 6) AS _score FROM orders")


# -- federation and time
def _by_status(s, d):
    o = orders(s, d).df.select("o_orderkey", "o_ms", "o_orderstatus")
    return o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'")


_add("fed_lambda_max", lambda s, d: federation.split_at_boundary(*_by_status(s, d), "o_ms").select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND epoch_ms(o_orderdate) < (SELECT max(epoch_ms(o_orderdate)) FROM orders WHERE o_orderstatus = 'F') OR o_orderstatus <> 'F' AND epoch_ms(o_orderdate) >= (SELECT max(epoch_ms(o_orderdate)) FROM orders WHERE o_orderstatus = 'F')")
_YEAR = 31_536_000_000


def _pruned(s, d):
    o = orders(s, d).df
    layers = [(i * _YEAR, (i + 1) * _YEAR - 1, o.where(F.col("o_ms").between(i * _YEAR, (i + 1) * _YEAR - 1))) for i in range(22, 29)]
    return federation.union(federation.prune_layers(layers, 25 * _YEAR, 27 * _YEAR - 1)).select("o_orderkey")


_add("fed_layer_prune", _pruned, f"SELECT o_orderkey FROM orders WHERE epoch_ms(o_orderdate) >= {25 * _YEAR} AND epoch_ms(o_orderdate) < {27 * _YEAR}")
_add("t_windows", lambda s, d: ingest.rolled(events(s, d), "ts", "1 day", "2 days", "event_type").select(F.col("slice").cast("date").alias("day"), "event_type", "n"), "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: fn for k, (fn, _) in _Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _Q.items() if sql}
