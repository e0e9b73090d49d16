"""The engine: statements and requests over a table -> lazily built DataFrames."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from urllib.parse import parse_qs

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import bql
from lodestone.catalog import EngineError, Table
from lodestone.operators import aggregates, facets, hits, relevance
from lodestone.operators.fulltext import compile_query, explanation
from lodestone.operators.predicates import all_of, compile_filter, compile_selection


@dataclass
class Result:
    """What a request asks for; every part is a DataFrame that runs when it is used."""

    hits: DataFrame
    counts: DataFrame
    facets: dict[str, DataFrame] = field(default_factory=dict)
    aggregates: DataFrame | None = None
    map_reduce: DataFrame | None = None
    #: All aggregates stand among the facets too, as (value, hits).
    rewritten: bool = False

    def to_json(self) -> str:
        """The result object of one page as text."""
        rows = lambda df: [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
        out = {**rows(self.counts)[0], "hits": rows(self.hits), "facets": {k: rows(v) for k, v in self.facets.items()}, "errors": []}
        if self.aggregates is not None and not self.rewritten:
            out["aggregates"] = rows(self.aggregates)
        if self.map_reduce is not None:
            out["mapReduceResult"] = rows(self.map_reduce)
        return json.dumps(out)


class Engine:
    """Runs BQL (``bql``), the JSON request form (``request``) and URL parameters (``url``) over one table.

    ``now_ms`` fixes the clock.  ``strict`` is the columnar mode: queries are
    refused, hit grouping is dropped and pages are capped.
    """

    STRICT_SIZE = 20_000

    def __init__(self, table: Table, now_ms: int = 0, strict: bool = False, shards: int = 2):
        self.table, self.now_ms, self.strict, self.shards = table, now_ms, strict, shards

    def compile(self, statement: str, variables: dict | None = None, extra_filter: str | None = None) -> dict:
        r = bql.parse(statement, self.table, self.now_ms)
        if extra_filter:
            more = bql.predicate(extra_filter, self.table, self.now_ms)
            r["filter"] = {"and": [r["filter"], more]} if "filter" in r else more
        return bql.substitute(r, variables or {})

    def bql(self, statement: str, variables: dict | None = None, extra_filter: str | None = None) -> Result | DataFrame:
        r = self.compile(statement, variables, extra_filter)
        return self.table.describe() if r.get("describe") else self.request(r)

    def where(self, r: dict, skip: str | None = None):
        """The predicate and score of a request; ``skip`` leaves out one facet's selections."""
        parts, score = [], F.lit(1.0)
        if q := r.get("query"):
            pred, score = compile_query(self.table, q)
            parts.append(pred)
        if f := r.get("filter"):
            parts.append(compile_filter(self.table, f))
        for s in r.get("selections") or []:
            name, pred = compile_selection(self.table, s)
            if skip is None or name != skip:
                parts.append(pred)
        if p := r.get("partitions"):
            from lodestone.operators.updates import shard

            parts.append(shard(F.col(self.table.uid), self.shards).isin(list(p)))
        return all_of(parts), score

    def base(self, r: dict, skip: str | None = None, table: Table | None = None) -> DataFrame:
        return (table or self.table).df.where(self.where(r, skip)[0])

    def respond(self, text: str) -> str:
        """A request as JSON text, or {"bql": statement}, to a result as text; what fails is listed under ``errors``."""
        try:
            try:
                r = json.loads(text)
            except ValueError as e:
                raise EngineError(str(e), "json.parse") from e
            if not isinstance(r, dict):
                raise EngineError("A request is an object", "json.parse")
            got = self.bql(r["bql"], r.get("templateMapping")) if "bql" in r else self.request(r)
            if isinstance(got, Result):
                return got.to_json()
            return json.dumps({"columns": [x.asDict() for x in got.collect()], "errors": []})  # one row for each column
        except EngineError as e:
            return json.dumps({"hits": [], "errors": [e.to_dict()]})
        except PySparkException as e:
            return json.dumps({"hits": [], "errors": [EngineError(str(e).split("\n")[0], "execution").to_dict()]})

    def request(self, r: dict) -> Result:
        r = bql.substitute({k: v for k, v in r.items() if k != "templateMapping"}, r.get("templateMapping") or {})
        if self.strict:
            if r.get("query"):
                raise EngineError("Queries are not supported", "json.query")
            r = {k: v for k, v in r.items() if k != "groupBy"} | {"size": min(int(self.STRICT_SIZE if r.get("size", 10) is None else r.get("size", 10)), self.STRICT_SIZE)}
        everything = not r.get("select") or "*" in r["select"] or r.get("fetchStored")
        t = self.table if everything else self.table.without(json.dumps(r, default=str))
        pred, score = self.where(r)
        matched = t.df.where(pred)
        scored = matched.withColumn("_score", score)
        model = r.get("relevance") or next((q.get("relevance") for q in (r.get("query") or {}).values() if isinstance(q, dict) and q.get("relevance")), None)
        if model:
            scored = relevance.apply(scored, t, model, self.now_ms)
        if r.get("explain") or "_explanation" in (r.get("select") or []):
            scored = scored.withColumn("_explanation", explanation(t, r.get("query") or {"match_all": {}}, F.col("_score") if model else None))
        sort = r.get("sort") or ([{"_score": "desc"}] if r.get("query") or model else None)
        keys = hits.sort_keys(t, sort)
        group = r.get("groupBy")
        grouped = scored
        if group and group.get("columns"):
            grouped = hits.collapse(scored, t, list(group["columns"]), keys, group.get("top"), (r.get("distinct") or [None])[0] if group["columns"] != r.get("distinct") else None)
        shown = hits.page(grouped, keys, int(r.get("from", 0)), None if r.get("size", 10) is None else int(r.get("size", 10)))
        columns = r.get("select")
        if r.get("explain") and "_explanation" not in (columns or []):
            columns = [*(columns or ["*"]), "_explanation"]
        shown = hits.project(shown, t, columns, bool(r.get("fetchStored")), list((r.get("termVectors") or [])))
        f = F.coalesce(pred, F.lit(False))
        counted = [F.sum(f.cast("long")).alias("numhits"), F.count("*").alias("totaldocs")]
        if group and group.get("columns"):
            counted.append(F.count_distinct(F.when(f, t.facet(group["columns"][0]).expr)).alias("numgroups"))
        out = Result(shown, t.df.agg(*counted))
        for name, spec in (r.get("facets") or {}).items():
            facet = t.facet(name)
            chosen = [v for s in r.get("selections") or [] for v in _chosen(s, name)]
            rows = self.base(r, name, t) if spec.get("expand") else matched
            out.facets[name] = facets.browse(rows, facet, spec, chosen, (r.get("facetInit") or {}).get(name))
        if a := r.get("aggregates"):
            out.aggregates = aggregates.aggregate(matched, t, a["functions"], a.get("groupBy") or [], a.get("top", 10))
            found = aggregates.as_facets(matched, t, a["functions"], a.get("groupBy") or [], a.get("top", 10))
            out.facets |= found
            out.rewritten = len(found) == len(a["functions"])
        if m := r.get("mapReduce"):
            calls = m if isinstance(m, list) else [m]
            access = aggregates.Accessor(matched, t, r.get("facetInit") or {})
            frames = [aggregates.call(c["function"], matched, c.get("parameters") or {}, access) for c in calls]
            out.map_reduce = frames[0] if len(frames) == 1 else _composite(frames)
        return out

    def get(self, uids: Sequence[int]) -> DataFrame:
        return hits.get(self.table, list(uids))

    def sysinfo(self) -> DataFrame:
        return self.table.describe()

    def url(self, query: str) -> Result:
        """GET parameters: q, start, rows, sort (name[:desc], relevance, relrev, doc, docrev), select.F.val|not|op, facet.F.show|max|minhit|expand|order, dyn.F.P.type|vals, groupby."""
        p = {k: v[0] for k, v in parse_qs(query).items()}
        r: dict = {"from": int(p.get("start", 0)), "size": int(p.get("rows", 10))}
        if p.get("q"):
            r["query"] = {"query_string": {"query": p["q"]}}
        if p.get("sort"):
            r["sort"] = [{n: how or "asc"} if how or n not in ("relevance", "relrev", "doc", "docrev") else n for n, _, how in (s.partition(":") for s in p["sort"].split(","))]
        if p.get("groupby"):
            r["groupBy"] = {"columns": p["groupby"].split(","), "top": int(p["maxpergroup"]) if "maxpergroup" in p else None}
        for key, v in p.items():
            kind, _, rest = key.partition(".")
            name, _, what = rest.rpartition(".")
            if kind == "select" and what in ("val", "not"):
                kind_of = self._literal(name)
                values = [kind_of(x) for x in v.split(",")]
                r.setdefault("selections", []).append({"terms": {name: {"values": values if what == "val" else [], "excludes": values if what == "not" else [], "operator": p.get(f"select.{name}.op", "or")}}})
            elif kind == "facet":
                spec = r.setdefault("facets", {}).setdefault(name, {})
                spec |= {"max": {"max": int(v)}, "minhit": {"minHit": int(v)}, "expand": {"expand": v == "true"}, "order": {"order": v}}.get(what, {}) if what != "show" and (v.isdigit() or what in ("expand", "order")) else {}
            elif kind == "dyn" and what == "vals":
                facet, _, param = name.partition(".")
                r.setdefault("facetInit", {}).setdefault(facet, {})[param] = {"type": p.get(f"dyn.{name}.type", "string"), "value": v}
        return self.request(r)

    def _literal(self, name: str):
        f = self.table.facet(name)
        kind = dict(self.table.df.dtypes).get(f.column or f.name, "string").replace("array<", "").rstrip(">")
        return int if kind in ("int", "bigint", "smallint") and f.kind != "range" else float if kind in ("double", "float") and f.kind != "range" else str


def _chosen(selection: dict, name: str) -> list:
    op, spec = next(iter(selection.items()))
    if op not in ("term", "terms", "path") or name not in spec:
        return []
    body = spec[name]
    return list(body.get("values") or []) if op == "terms" else [body["value"] if isinstance(body, dict) else body]


def _composite(frames: list[DataFrame]) -> DataFrame:
    """(i, result as JSON) of several user aggregates."""
    each = [df.select(F.lit(i).alias("i"), F.to_json(F.struct("*")).alias("result")) for i, df in enumerate(frames)]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out
