"""Text and scored queries -> (predicate, score).

Text columns are read as arrays of lower-case tokens (letters and digits);
phrases and spans work on positions with higher-order functions.  The base
score is 1 times the boosts; membership is exact.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.catalog import EngineError, Table
from lodestone.operators.predicates import all_of, any_of, exclude

#: Custom queries by name: (table, spec) -> (predicate, score).
CUSTOM_QUERIES: dict[str, Callable] = {}


def tokens(col: Column) -> Column:
    return F.filter(F.split(F.lower(col), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def term_vector(col: Column) -> Column:
    """Each distinct token with its frequency; the work grows with n log n of the text's tokens."""

    def runs(all_: Column) -> Column:  # of the sorted tokens
        starts = F.filter(F.sequence(F.lit(1), F.size(all_)), lambda i: (i == 1) | (F.get(all_, i - 1) != F.get(all_, i - 2)))
        return F.transform(F.array(starts), lambda s: F.transform(s, lambda at, k: F.struct(F.get(all_, at - 1).alias("term"), (F.coalesce(F.get(s, k + 1), F.size(all_) + 1) - at).alias("freq"))))

    empty = F.array().cast("array<struct<term: string, freq: int>>")
    return F.flatten(F.flatten(F.transform(F.array(F.sort_array(tokens(col))), lambda all_: F.when(F.size(all_) == 0, F.array(empty)).otherwise(runs(all_)))))


def _is_text(table: Table, field: str) -> bool:
    return field == table.text or (field in table.df.columns and field not in table.facets and dict(table.df.dtypes)[field] == "string" and field in getattr(table, "text_columns", (table.text,)))


def _value(table: Table, field: str, value) -> Column:
    if _is_text(table, field):
        return F.array_contains(tokens(F.col(field)), str(value).lower())
    from lodestone.operators.predicates import equals

    return equals(table.facet(field), value)


def _glob(pattern: str) -> str:
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


def _wildcard(table: Table, field: str, pattern: str) -> Column:
    """``*`` and ``?``; a pattern with stars at its ends only is a comparison that sources can take over."""
    if _is_text(table, field):
        return F.exists(tokens(F.col(field)), lambda x: _like(x, pattern.lower()))
    f = table.facet(field)
    return F.exists(f.expr, lambda x: _like(x.cast("string"), pattern)) if f.is_multi else _like(f.expr.cast("string"), pattern)


def _like(x: Column, pattern: str) -> Column:
    inner = pattern.strip("*")
    if "*" in inner or "?" in inner:
        return x.rlike("(?s)" + _glob(pattern))
    if not inner:
        return x.isNotNull() if pattern else x == ""
    first, last = pattern.startswith("*"), pattern.endswith("*")
    return x.contains(inner) if first and last else x.startswith(inner) if last else x.endswith(inner) if first else x == inner


def _phrase(col: Column, words: list[str]) -> Column:
    """Consecutive tokens; as one containment test on the tokens' text, so a row costs one pass."""
    if not words:
        return F.lit(False)
    return F.concat(F.lit(" "), F.array_join(tokens(col), " "), F.lit(" ")).contains(f" {' '.join(words)} ")


# -- spans: arrays of struct<s: start, e: end (exclusive)>


def _term(col: Column, word: str) -> Column:
    at = F.transform(tokens(col), lambda x, i: F.struct(x.alias("w"), i.alias("s"), (i + 1).alias("e")))
    return F.transform(F.filter(at, lambda y: y["w"] == word.lower()), lambda y: F.struct(y["s"], y["e"]))


def _bound(parts: list[Column], build: Callable[[list[Column]], Column]) -> Column:
    """Works out each part once in a row, then an array built from them."""
    named = F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])
    return F.flatten(F.transform(F.array(named), lambda b: build([b[f"p{i}"] for i in range(len(parts))])))


def _pairing(spans: Column, in_order: bool) -> Callable[[Column], Column]:
    """From one span so far to all that the next part's spans make of it."""

    def pair(x: Column) -> Column:
        fits = (lambda y: y["s"] >= x["last"] + 1) if in_order else (lambda y: (y["s"] >= x["e"]) | (y["e"] <= x["s"]))
        return F.transform(F.filter(spans, fits), lambda y: F.struct(F.least(x["s"], y["s"]).alias("s"), F.greatest(x["e"], y["e"]).alias("e"), (x["n"] + y["e"] - y["s"]).alias("n"), y["s"].alias("last")))

    return pair


def _near(parts: list[Column], slop: int, in_order: bool, longest: int | None = 1) -> Column:
    """Spans that hold one span of each part, with at most ``slop`` positions between them in all.

    longest: what a part's span can be at most.  A further part can fill no more
    than that of the positions between, so what is too wide goes at once.
    """

    def build(p: list[Column]) -> Column:
        made = F.transform(p[0], lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), (x["e"] - x["s"]).alias("n"), x["s"].alias("last")))
        for k, other in enumerate(p[1:]):
            made = F.flatten(F.transform(made, _pairing(other, in_order)))
            if longest is not None and k < len(p) - 2:
                spare = slop + longest * (len(p) - 2 - k)
                made = F.filter(made, lambda x: x["e"] - x["s"] - x["n"] <= spare)  # noqa: B023
        return F.transform(F.filter(made, lambda x: x["e"] - x["s"] - x["n"] <= slop), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))

    return _bound(parts, build)


def spans_exist(spans: Column) -> Column:
    return F.coalesce(F.size(spans) > 0, F.lit(False))


def _may_match(node: dict) -> Column:
    """What a text must contain for a span query to match: a cheap test before its tokens are looked at."""
    op, spec = next(iter(node.items()))
    if op == "span_term":
        field, v = next((k, v) for k, v in spec.items() if k != "boost")
        return F.coalesce(F.lower(F.col(field)).contains((v["value"] if isinstance(v, dict) else v).lower()), F.lit(False))
    if op in ("span_or", "span_near"):
        return reduce(lambda a, b: a | b if op == "span_or" else a & b, map(_may_match, spec["clauses"]))
    return _may_match(spec["include" if op == "span_not" else "match"])


def compile_span(table: Table, node: dict) -> tuple[str, Column]:
    """(field, spans); no spans where the text cannot match."""
    field, spans = _compile_span(table, node)
    return field, F.when(_may_match(node), spans).otherwise(F.array().cast("array<struct<s:int,e:int>>"))


def _compile_span(table: Table, node: dict) -> tuple[str, Column]:
    op, spec = next(iter(node.items()))
    if op == "span_term":
        field, v = next((k, v) for k, v in spec.items() if k != "boost")
        return field, _term(F.col(field), v["value"] if isinstance(v, dict) else v)
    if op in ("span_or", "span_near"):
        parts = [_compile_span(table, c) for c in spec["clauses"]]
        if len({f for f, _ in parts}) != 1:
            raise EngineError("Clauses must have same field.", "json.query")
        field = parts[0][0]
        if op == "span_or":
            return field, F.array_distinct(F.concat(*(s for _, s in parts)))
        return field, _near([s for _, s in parts], int(spec.get("slop", 12)), bool(spec.get("in_order", False)), 1 if all("span_term" in c for c in spec["clauses"]) else None)
    if op == "span_not":
        (field, keep), (_, out) = _compile_span(table, spec["include"]), _compile_span(table, spec["exclude"])
        return field, _bound([keep, out], lambda p: F.filter(p[0], lambda x: ~F.exists(p[1], lambda y: (y["s"] < x["e"]) & (y["e"] > x["s"]))))
    if op == "span_first":
        field, spans = _compile_span(table, spec["match"])
        return field, F.filter(spans, lambda x: x["e"] <= int(spec.get("end", 3)))
    raise EngineError(f"Unknown span query: {op}", "json.query")


# -- the query_string syntax: words, "phrases", field:, + - ! NOT, AND OR && ||, ( ), * ? and [a TO b]

_Q = re.compile(r'\s*(?:(?P<op>AND\b|OR\b|NOT\b|&&|\|\||[()+\-!])|(?P<field>[\w.]+):(?=\S)|(?P<phrase>"[^"]*")|(?P<range>[\[{][^\]}]+ TO [^\]}]+[\]}])|(?P<word>[^\s()"]+))(?:\^(?P<boost>[\d.]+))?(?:~[\d.]*)?')


class QueryString:
    def __init__(self, table: Table, text: str, fields: list[str], default: str = "or"):
        self.table, self.fields, self.default = table, fields, default.lower()
        self.toks = [(m.lastgroup if m.lastgroup != "boost" else next(k for k in ("op", "field", "phrase", "range", "word") if m[k]), m) for m in _Q.finditer(text)]
        self.i = 0

    def peek(self, *ops: str) -> bool:
        return self.i < len(self.toks) and self.toks[self.i][0] == "op" and self.toks[self.i][1]["op"] in ops

    def parse(self, fields: list[str] | None = None) -> Column:
        """Clauses as the classic parser reads them: + and AND make must, - and NOT must_not, the rest should."""
        clauses: list[list] = []
        joiner = None
        while self.i < len(self.toks) and not self.peek(")"):
            if self.peek("AND", "&&", "OR", "||"):
                joiner = "and" if self.toks[self.i][1]["op"] in ("AND", "&&") else "or"
                self.i += 1
                continue
            mark = "must" if self.default == "and" else "should"
            if self.peek("+", "-", "!", "NOT"):
                mark = "must" if self.toks[self.i][1]["op"] == "+" else "must_not"
                self.i += 1
            if joiner == "and":
                if clauses and clauses[-1][0] == "should":
                    clauses[-1][0] = "must"
                mark = "must" if mark == "should" else mark
            elif joiner == "or" and self.default == "and":
                if clauses and clauses[-1][0] == "must":
                    clauses[-1][0] = "should"
                mark = "should" if mark == "must" else mark
            clauses.append([mark, self.clause(fields or self.fields)])
            joiner = None
        by = {k: [c for m, c in clauses if m == k] for k in ("must", "should", "must_not")}
        if not by["must"] and not by["should"]:
            return F.lit(False) if by["must_not"] else F.lit(True)
        return all_of([*by["must"], *([any_of(by["should"])] if by["should"] and not by["must"] else []), *(exclude(c) for c in by["must_not"])])

    def clause(self, fields: list[str]) -> Column:
        kind, m = self.toks[self.i]
        self.i += 1
        if kind == "field":
            return self.clause([m["field"]])
        if kind == "op":
            inner = self.parse(fields)
            if self.peek(")"):
                self.i += 1
            return inner
        return any_of([self.leaf(f, kind, m[kind]) for f in fields])

    def leaf(self, field: str, kind: str, text: str) -> Column:
        if text == "*":
            return F.lit(True)
        if kind == "phrase":
            words = re.findall(r"[^\W_]+", text.lower())
            return _phrase(F.col(field), words) if _is_text(self.table, field) else _value(self.table, field, text.strip('"'))
        if kind == "range":
            from lodestone.operators.predicates import in_range, range_spec

            return in_range(self.table.facet(field), range_spec(text.replace("{", "(").replace("}", ")")) or {})
        if "*" in text or "?" in text:
            return _wildcard(self.table, field, text)
        if _is_text(self.table, field):
            words = re.findall(r"[^\W_]+", text.lower())
            return _phrase(F.col(field), words)
        return _value(self.table, field, _typed(self.table, field, text))


def _typed(table: Table, field: str, text: str):
    f = table.facet(field)
    kind = dict(table.df.dtypes).get(f.column or f.name, "string")
    return int(text) if kind in ("int", "bigint", "smallint") and re.fullmatch(r"-?\d+", text) else float(text) if kind in ("double", "float") else text


def compile_query(table: Table, node: dict) -> tuple[Column, Column]:
    """(predicate, score) of a query; several entries are AND-ed."""
    from lodestone.operators.predicates import compile_filter, constant, in_range, terms
    from lodestone.operators.predicates import path as path_of

    op, spec = next(iter(node.items()))
    boost = F.lit(float(spec.get("boost", 1.0)) if isinstance(spec, dict) else 1.0)
    field = value = None
    if isinstance(spec, dict):
        field, value = next(((k, v) for k, v in spec.items() if k not in ("boost", "relevance")), (None, None))
        if isinstance(value, dict) and "boost" in value:
            boost = F.lit(float(value["boost"]))
    plain = value.get("value", value.get("term", value.get("prefix", value.get("query")))) if isinstance(value, dict) else value
    if op == "match_all":
        return F.lit(True), boost
    if op == "match_none":
        return F.lit(False), boost
    if op == "query_string":
        text = spec.get("query") or ""
        fields = spec.get("fields") or [spec.get("default_field", table.text)]
        return (QueryString(table, text, list(fields), spec.get("default_operator", "or")).parse() if text.strip() else F.lit(True)), boost
    if op == "text":
        spec2 = value if isinstance(value, dict) else {"value": value}
        words = re.findall(r"[^\W_]+", str(spec2["value"]).lower())
        if spec2.get("type") in ("phrase", "phrase_prefix"):
            return _phrase(F.col(field), words), boost
        parts = [_value(table, field, w) for w in words]
        return (all_of if spec2.get("operator", "or") == "and" else any_of)(parts), boost
    if op == "term":
        return _value(table, field, plain), boost
    if op == "terms":
        if _is_text(table, field):
            vals = [_value(table, field, v) for v in value.get("values", [])]
            need = int(value.get("minimum_match", 1))
            keep = all_of(vals) if value.get("operator") == "and" else sum((F.coalesce(v, F.lit(False)).cast("int") for v in vals), F.lit(0)) >= need
            return keep & exclude(any_of([_value(table, field, v) for v in value.get("excludes", [])])), boost
        return terms(table.facet(field), value if isinstance(value, dict) else {"values": value}), boost
    if op == "prefix":
        return _wildcard(table, field, str(plain) + "*"), boost
    if op == "wildcard":
        return _wildcard(table, field, str(plain if plain is not None else value.get("wildcard"))), boost
    if op == "range":
        return in_range(table.facet(field), value), boost
    if op == "path":
        return path_of(table.facet(field), value if isinstance(value, dict) else {"value": value}), boost
    if op == "ids":
        return compile_filter(table, {"ids": spec}), boost
    if op == "const_exp":
        return F.lit(constant(spec)), boost
    if op == "filtered":
        keep, score = compile_query(table, spec["query"])
        return keep & compile_filter(table, spec["filter"]), score
    if op == "constant_score":
        return compile_filter(table, spec["filter"]), boost
    if op == "dis_max":
        subs = [compile_query(table, q) for q in spec["queries"]]
        each = [F.when(F.coalesce(p, F.lit(False)), s).otherwise(F.lit(0.0)) for p, s in subs]
        top = F.greatest(*each) if len(each) > 1 else each[0]
        return any_of([p for p, _ in subs]), (top + F.lit(float(spec.get("tie_breaker", 0.0))) * (sum(each[1:], each[0]) - top)) * boost
    if op == "bool":
        part = lambda k: [compile_query(table, q) for q in (spec[k] if isinstance(spec[k], list) else [spec[k]])] if spec.get(k) else []
        must, no, should = part("must"), part("must_not"), part("should")
        need = int(spec.get("minimum_number_should_match", 0)) or (1 if should and not must else 0)
        hits = sum((F.coalesce(p, F.lit(False)).cast("int") for p, _ in should), F.lit(0))
        keep = all_of([*(p for p, _ in must), *([hits >= need] if need else []), *(exclude(p) for p, _ in no)])
        score = sum((F.when(F.coalesce(p, F.lit(False)), s).otherwise(F.lit(0.0)) for p, s in [*must, *should]), F.lit(0.0))
        return keep, score * F.lit(float(spec.get("boost", 1.0)))
    if op.startswith("span_"):
        return spans_exist(compile_span(table, node)[1]), boost
    if op == "custom":
        return CUSTOM_QUERIES[spec["class"]](table, spec)
    raise EngineError(f"Unknown query: {op}", "json.query")


def explanation(table: Table, node: dict, final: Column | None = None) -> Column:
    """How a row's score came about, as JSON text: {"value", "description", "details"} for each clause of the query.

    A clause that a row does not meet has the value 0; ``final`` is the score a relevance model gave instead.
    """
    inner = _explained(table, node)
    return inner if final is None else _entry(final, "relevance model", [inner])


def _entry(value: Column, description: str, details: list[Column]) -> Column:
    head = F.concat(F.lit('{"value":'), F.coalesce(value, F.lit(0.0)).cast("double").cast("string"), F.lit(f',"description":{json.dumps(description)},"details":['))
    return F.concat(head, F.concat_ws(",", *details) if details else F.lit(""), F.lit("]}"))


def _explained(table: Table, node: dict) -> Column:
    keep, score = compile_query(table, node)
    op, spec = next(iter(node.items()))
    subs: list[dict] = []
    if op == "bool":
        subs = [q for k in ("must", "should", "must_not") if spec.get(k) for q in (spec[k] if isinstance(spec[k], list) else [spec[k]])]
    elif op == "dis_max":
        subs = list(spec["queries"])
    elif op == "filtered":
        subs = [spec["query"]]
    text = op if subs else f"{op} {json.dumps(spec, default=str)}"
    return _entry(F.when(F.coalesce(keep, F.lit(False)), score).otherwise(0.0), text, [_explained(table, q) for q in subs])
