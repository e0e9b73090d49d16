"""Aggregates: named functions, group-by, several at once, and user functions by name.

A user aggregate is ``fn(df, params) -> DataFrame`` in ``REGISTRY``, or built by
``map_reduce`` from map, combine and reduce steps over Arrow batches.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.catalog import EngineError, Table

REGISTRY: dict[str, Callable[[DataFrame, dict], DataFrame]] = {}


def lookup(name: str) -> Callable[[DataFrame, dict], DataFrame]:
    """By exact name, then with the engine's prefix."""
    for key in (name, f"lodestone.{name}"):
        if key in REGISTRY:
            return REGISTRY[key]
    raise EngineError(f"Aggregate function is not registered: {name}", "mapreduce")


def register(name: str):
    def add(fn):
        REGISTRY[name] = fn
        return fn

    return add


@dataclass
class Accessor:
    """What a user aggregate may look up beside its rows: facet counts and fields, also by key.

    Every look-up is a DataFrame or a Column over the rows of the request.
    """

    rows: DataFrame
    table: Table
    params: dict

    def counts(self, facet: str) -> DataFrame:
        """(value, hits) of a facet over the matched rows."""
        from lodestone.operators.facets import counts

        return counts(self.rows, self.table.facet(facet), self.params.get(facet))

    def field(self, name: str) -> Column:
        return self.table.facet(name).expr

    def fields_of(self, uids: DataFrame, *names: str) -> DataFrame:
        """(uid, fields) of the keys in ``uids`` (one column), matched or not; keys without a row have nulls."""
        key = uids.columns[0]
        values = self.table.df.select(F.col(self.table.uid).alias("_k"), *[self.field(n).alias(n) for n in names])
        return uids.join(values, F.col(key) == F.col("_k"), "left").select(F.col(key).alias("uid"), *names)


def call(name: str, df: DataFrame, params: dict, access: Accessor) -> DataFrame:
    """A registered aggregate; those that take a third argument get the accessor."""
    fn = lookup(name)
    return fn(df, params, access) if len(inspect.signature(fn).parameters) > 2 else fn(df, params)


def _number(table: Table, name: str) -> Column:
    f = table.facet(name)
    kind = dict(table.df.dtypes).get(f.column or f.name, "double")
    if kind not in ("int", "bigint", "smallint", "tinyint", "double", "float") and not kind.startswith("decimal") and f.derive is None:
        raise EngineError(f"Column is not numeric: {name}", "mapreduce")
    return f.expr


def expression(table: Table, fn: str, column: str) -> Column:
    if fn == "count":
        return F.count("*")
    if fn in ("distinctcount", "distinctcounthashset"):
        return F.count_distinct(table.facet(column).expr)
    if fn == "approxdistinctcount":
        return F.approx_count_distinct(table.facet(column).expr)
    x = _number(table, column)
    return {"sum": lambda: F.sum(x.cast("double")), "avg": lambda: F.avg(x), "min": lambda: F.min(x), "max": lambda: F.max(x)}[fn]()


def name_of(fn: str, column: str) -> str:
    return f"{fn}_{'all' if column == '*' else column}"


def aggregate(df: DataFrame, table: Table, functions: list[dict], group: list[str] = (), top: int = 10) -> DataFrame:
    """One row of all functions, or the top groups by the first function: descending, for min ascending; then by group.

    Ungrouped min and max also give the uid of the first row that has the value.
    """
    exprs = []
    for f in functions:
        fn, c = f["function"].lower(), f["column"]
        exprs.append(expression(table, fn, c).alias(name_of(fn, c)))
        if fn in ("min", "max") and not group and table.uid:
            x, uid = _number(table, c), F.col(table.uid)
            pick = F.min(F.struct(x.alias("x"), uid.alias("u"))) if fn == "min" else F.min(F.when(x.isNotNull(), F.struct((-x).alias("x"), uid.alias("u"))))
            pick = F.min(F.when(x.isNotNull(), F.struct(x.alias("x"), uid.alias("u")))) if fn == "min" else pick
            exprs.append(pick["u"].alias(f"{name_of(fn, c)}_uid"))
        if fn == "avg":
            exprs.append(F.count("*").alias(f"{name_of(fn, c)}_count"))
    if not group:
        return df.agg(*exprs)
    rows, keys = df, []
    for g in group:
        f = table.facet(g)
        if f.is_multi:
            from lodestone.operators.facets import values_of

            rows = rows.withColumn(f"_{g}", F.explode(values_of(f)))
            keys.append(F.col(f"_{g}").alias(g))
        else:
            keys.append(f.expr.alias(g))
    first = functions[0]
    by = name_of(first["function"].lower(), first["column"])
    out = rows.groupBy(*keys).agg(*exprs).orderBy(F.asc(by) if first["function"].lower() == "min" else F.desc(by), *group)
    return out.limit(top) if top else out


def as_facets(df: DataFrame, table: Table, functions: list[dict], group: list[str], top: int) -> dict[str, DataFrame]:
    """The first sum and the counts over one group column as facets: ``_sumGroupBy`` and the column's own."""
    out: dict[str, DataFrame] = {}
    if len(group) != 1:
        return out
    from lodestone.operators.facets import browse, values_of

    f = table.facet(group[0])
    for x in functions:
        if x["function"].lower() == "sum" and "_sumGroupBy" not in out:
            rows = df.select(F.explode(values_of(f)).alias("value"), _number(table, x["column"]).alias("m"))
            sums = rows.groupBy("value").agg(F.sum("m").alias("hits")).orderBy(F.desc("hits"), "value")
            out["_sumGroupBy"] = sums.limit(top) if top else sums
        elif x["function"].lower() == "count" and group[0] not in out:
            out[group[0]] = browse(df, f, {"minHit": 0, "max": top, "order": "hits"})
    return out


def group_key(df: DataFrame, columns: list[str]) -> DataFrame:
    """The groups' values joined by ':' as one column ``group``."""
    return df.withColumn("group", F.concat_ws(":", *columns))


@register("sorted_unique_values")
def sorted_unique(df: DataFrame, params: dict) -> DataFrame:
    """Distinct values of ``valueColumn`` with their largest ``sortColumn``, descending; ``offset``, ``size``."""
    got = df.groupBy(F.col(params["valueColumn"]).alias("value")).agg(F.max(params["sortColumn"]).alias("sort_value"))
    return got.orderBy(F.desc("sort_value"), "value").offset(int(params.get("offset", 0))).limit(int(params.get("size", 10)))


@register("count_group_by")
def count_group_by(df: DataFrame, params: dict) -> DataFrame:
    cols = params["columns"] if isinstance(params["columns"], list) else [params["columns"]]
    return df.groupBy(F.concat_ws(":", *cols).alias("group")).agg(F.count("*").alias("count"))


@register("distinct_uid")
def distinct_uid(df: DataFrame, params: dict) -> DataFrame:
    return df.agg(F.count_distinct(params["column"]).alias("distinct"))


@register("list_uids")
def list_uids(df: DataFrame, params: dict) -> DataFrame:
    """All uids as rows; a list of them all would not fit one."""
    return df.select(F.col(params["column"]).alias("uid"))


@register("facet_counts")
def facet_counts(df: DataFrame, params: dict, access: Accessor) -> DataFrame:
    """(value, hits, share of the matched rows) of the facet ``column``, read through the accessor."""
    total = df.agg(F.count("*")).scalar()
    return access.counts(params["column"]).select("value", "hits", (F.col("hits") / total).alias("share"))


@register("fields_by_uid")
def fields_by_uid(df: DataFrame, params: dict, access: Accessor) -> DataFrame:
    """(uid, fields): ``columns`` of the rows that the matched rows' ``reference`` column points at."""
    return access.fields_of(df.select(access.field(params["reference"]).alias("uid")).distinct(), *params["columns"])


@register("column_stats")
def column_stats(df: DataFrame, params: dict) -> DataFrame:
    """Rows, values and distinct values of each column."""
    cols = params.get("columns") or df.columns
    aggs = [F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count(c).alias("values"), F.approx_count_distinct(c).alias("distinct")) for c in cols]
    return df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("a")).select("a.*")


def map_reduce(mapper: Callable, combiner: Callable, reducer: Callable, schema: str, key: str | None = None) -> Callable[[DataFrame, dict], DataFrame]:
    """A user aggregate: mapper(pandas, params) and combiner(pandas, params) give partial rows, reducer the result.

    Partial rows have the result's schema; with ``key`` they are reduced by key,
    else a fixed number of combined groups is reduced at last.
    """

    def run(df: DataFrame, params: dict) -> DataFrame:
        part = df.mapInPandas(lambda it: (mapper(pdf, params) for pdf in it), schema)
        if key:
            return part.groupBy(key).applyInPandas(lambda pdf: reducer(pdf, params), schema)
        some = part.groupBy((F.spark_partition_id() % 64).alias("_p")).applyInPandas(lambda pdf: combiner(pdf, params), schema)
        return some.groupBy(F.lit(1).alias("_p")).applyInPandas(lambda pdf: reducer(pdf, params), schema)

    return run
