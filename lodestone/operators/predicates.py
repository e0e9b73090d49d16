"""Filters and selections of a request -> Columns.

Excludes keep rows without a value; ranges never match them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.catalog import EngineError, Facet, Table

#: Custom filters by name: (table, spec) -> Column.
CUSTOM_FILTERS: dict[str, Callable[[Table, dict], Column]] = {}


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def exclude(pred: Column) -> Column:
    return ~F.coalesce(pred, F.lit(False))


def equals(f: Facet, v: Any) -> Column:
    """A facet has a value; on attributes a bare key is any of its values, on paths a prefix."""
    if f.kind == "attribute":
        sep = f.separator if f.separator != "/" else "="
        return F.exists(f.expr, lambda x: (x == v) | x.startswith(f"{v}{sep}"))
    if f.kind == "weighted-multi":
        return F.exists(f.expr, lambda x: x["v"] == v)
    if f.kind == "path":
        return path(f, {"value": v})
    if f.kind in ("range", "multi-range") and isinstance(v, str) and (r := range_spec(v)):
        return in_range(f, r)
    return F.array_contains(f.expr, F.lit(v)) if f.is_multi or f.kind == "multi-path" else f.expr == F.lit(v)


def range_spec(text: str) -> dict | None:
    """``[a TO b]``, ``(a TO *)``, ``a-b`` or ``a,b`` as a range; None if it is neither."""
    m = re.fullmatch(r"\s*([\[(])\s*(\S+)\s+TO\s+(\S+)\s*([\])])\s*", text)
    lo, hi, low_in, high_in = (m[2], m[3], m[1] == "[", m[4] == "]") if m else (*([None] * 2), True, True)
    if not m:
        m = re.fullmatch(r"\s*(-?[\d.]+|\*)\s*[-,]\s*(-?[\d.]+|\*)\s*", text)
        if not m:
            return None
        lo, hi = m[1], m[2]
    num = lambda s: float(s) if "." in s else int(s)
    out: dict = {}
    if lo != "*":
        out |= {"from": num(lo) if re.fullmatch(r"-?[\d.]+", lo) else lo, "include_lower": low_in}
    if hi != "*":
        out |= {"to": num(hi) if re.fullmatch(r"-?[\d.]+", hi) else hi, "include_upper": high_in}
    return out


def in_range(f: Facet, spec: dict) -> Column:
    s = dict(spec)
    for old, side, inc in (("gt", "from", False), ("gte", "from", True), ("lt", "to", False), ("lte", "to", True)):
        if old in s:
            s[side], s[{"from": "include_lower", "to": "include_upper"}[side]] = s[old], inc

    def test(x: Column) -> Column:
        parts = []
        if s.get("from") is not None:
            parts.append(x >= F.lit(s["from"]) if s.get("include_lower", True) else x > F.lit(s["from"]))
        if s.get("to") is not None:
            parts.append(x <= F.lit(s["to"]) if s.get("include_upper", True) else x < F.lit(s["to"]))
        return all_of(parts) if parts else x.isNotNull()

    return F.exists(f.expr, test) if f.is_multi else test(f.expr)


def path(f: Facet, spec: dict) -> Column:
    """A prefix of the hierarchy; ``strict`` asks for exactly ``depth`` levels below it."""
    v, sep = str(spec["value"]).rstrip(f.separator), f.separator

    def test(x: Column) -> Column:
        under = (x == v) | x.startswith(v + sep)
        if spec.get("strict"):
            return under & (F.size(F.split(x, re.escape(sep))) == len(v.split(sep)) + int(spec.get("depth", 0)))
        return under

    return F.exists(f.expr, test) if f.kind == "multi-path" else test(f.expr)


def terms(f: Facet, spec: dict) -> Column:
    values, excludes = list(spec.get("values") or []), list(spec.get("excludes") or [])
    if not values and not excludes:
        return F.lit(False)
    need = int(spec.get("minimum_match", 1))
    if not values:
        keep = F.lit(True)
    elif spec.get("operator", "or") == "and":
        keep = all_of([equals(f, v) for v in values])
    elif need > 1:
        keep = sum((F.coalesce(equals(f, v), F.lit(False)).cast("int") for v in values), F.lit(0)) >= need
    elif f.kind in ("simple", "custom"):
        keep = f.expr.isin(values)
    else:
        keep = any_of([equals(f, v) for v in values])
    return keep & exclude(any_of([equals(f, v) for v in excludes])) if excludes else keep


def constant(spec: dict) -> bool:
    def value(x):
        return len(x["params"][0]) if isinstance(x, dict) and x.get("function") == "length" else x

    a, b, op = value(spec["lvalue"]), value(spec["rvalue"]), spec["operator"]
    if op in ("in", "not_in"):
        inside = all(x in b for x in a) if isinstance(a, list) else a in b
        return inside == (op == "in")
    if isinstance(a, list) and isinstance(b, list):
        same = len(a) == len(b) and set(a) == set(b)
        return {"==": same, "!=": not same}[op]
    return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op] if op in ("==", "!=") or type(a) is type(b) or not isinstance(a, str) else False


def compile_filter(table: Table, node: dict) -> Column:
    from lodestone.operators.fulltext import compile_query

    (op, spec), *more = node.items()
    if more:
        return all_of([compile_filter(table, {k: v}) for k, v in node.items()])
    if op in ("and", "or"):
        return (all_of if op == "and" else any_of)([compile_filter(table, p) for p in spec])
    if op == "not":
        return exclude(compile_filter(table, spec))
    if op == "bool":
        part = lambda k: [compile_filter(table, p) for p in (spec.get(k) or []) if p] if isinstance(spec.get(k), list) else [compile_filter(table, spec[k])] if spec.get(k) else []
        out = [*part("must"), *(exclude(p) for p in part("must_not"))]
        if should := part("should"):
            out.append(any_of(should))
        return all_of(out)
    if op == "isNull":
        f = table.facet(spec if isinstance(spec, str) else spec["field"])
        return f.expr.isNull() | (F.size(f.expr) == 0) if f.is_multi else f.expr.isNull()
    if op == "ids":
        uid = F.col(table.uid)
        keep = uid.isin(spec["values"]) if spec.get("values") else F.lit(True)
        return keep & ~uid.isin(spec["excludes"]) if spec.get("excludes") else keep
    if op == "const_exp":
        return F.lit(constant(spec))
    if op in ("query", "match_all", "match_none"):
        return compile_query(table, spec if op == "query" else {op: spec})[0]
    if op == "custom":
        return CUSTOM_FILTERS[spec["class"]](table, spec)
    if op == "retention":
        return F.col(spec["column"]) >= F.lit(spec["now"] - spec["days"] * 86_400_000)
    col, body = next(iter(spec.items()))
    f = table.facet(col)
    if op == "term":
        return equals(f, body["value"] if isinstance(body, dict) else body)
    if op == "terms":
        return terms(f, body if isinstance(body, dict) else {"values": body})
    if op == "range":
        return in_range(f, body)
    if op == "path":
        return path(f, body if isinstance(body, dict) else {"value": body})
    raise EngineError(f"Unknown filter: {op}", "json.filter")


def compile_selection(table: Table, node: dict) -> tuple[str | None, Column]:
    """(facet name, predicate); selections on ``custom`` or ``default`` are accepted and ignored."""
    op, spec = next(iter(node.items()))
    if op in ("custom", "default"):
        return None, F.lit(True)
    return next(iter(spec)), compile_filter(table, node)
