"""The query language: text -> request dict.

    SELECT list [FROM name] [WHERE ..] [GIVEN FACET PARAM (..)] clauses

The clauses (ORDER BY, LIMIT, GROUP BY, DISTINCT, EXECUTE, BROWSE BY, FETCHING
STORED, ROUTE BY, USING RELEVANCE MODEL) come in any order, each once.  Facet
predicates of the top conjunction become ``selections``, the rest ``filter``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from lodestone.catalog import EngineError, Table
from lodestone.functions.times import date_ms, span_ms

_TOKEN = re.compile(
    r"""(?P<ws>\s+|--[^\n]*|/\*.*?\*/)
      | (?P<date>\d{4}[-/]\d{1,2}[-/]\d{1,2}(?:\s+\d{1,2}:\d{2}:\d{2})?)
      | (?P<real>\d+\.\d+(?:[eE][-+]?\d+)?)
      | (?P<int>\d+[lL]?)(?![A-Za-z_])
      | (?P<str>'(?:[^']|'')*'|"(?:[^"]|"")*")
      | (?P<var>\$\$?[A-Za-z_][\w]*)
      | (?P<id>[A-Za-z_][\w]*(?:-[A-Za-z_]\w*)*)
      | (?P<op><>|!=|<=|>=|==|&&|\|\||\+\+|--|\+=|-=|\*=|[-+*/%=<>(),.;:?\[\]{}!&|])""",
    re.X | re.S,
)
_LONG_MAX = (1 << 63) - 1
AGGREGATES = ("sum", "count", "avg", "min", "max", "distinctcount", "distinctcounthashset")


@dataclass
class Token:
    kind: str
    text: str
    value: Any
    line: int
    col: int
    at: int


def lex(text: str) -> list[Token]:
    out, at, line, begin = [], 0, 1, 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise EngineError(f"Unexpected character: {text[at]!r}", "bql.lex", line, at - begin)
        kind, s = m.lastgroup, m[0]
        if kind != "ws":
            value: Any = s
            if kind == "str":
                value = s[1:-1].replace(s[0] * 2, s[0])
            elif kind == "int":
                value = int(s.rstrip("lL"))
                if value > _LONG_MAX:
                    raise EngineError(f"Integer value is out of range: {s}", "bql.lex", line, at - begin)
            elif kind == "real":
                value = float(s)
            elif kind == "date":
                value = date_ms(s)
                if value is None:
                    raise EngineError(f"Invalid date: {s}", "bql.lex", line, at - begin)
            out.append(Token(kind, s, value, line, at - begin, at))
        if "\n" in s:
            line += s.count("\n")
            begin = at + s.rindex("\n") + 1
        at = m.end()
    out.append(Token("end", "", None, line, at - begin, at))
    return out


@dataclass(frozen=True)
class Var:
    name: str


class Parser:
    def __init__(self, text: str, table: Table | None = None, now_ms: int = 0):
        self.text, self.toks, self.i, self.table, self.now = text, lex(text), 0, table, now_ms

    # -- tokens
    @property
    def tok(self) -> Token:
        return self.toks[self.i]

    def fail(self, message: str, tok: Token | None = None, code: str = "bql.parse"):
        t = tok or self.tok
        raise EngineError(message, code, t.line, t.col)

    def word(self, *names: str) -> bool:
        return self.tok.kind == "id" and self.tok.text.upper() in names

    def accept(self, *names: str) -> Token | None:
        t = self.tok
        if (t.kind == "id" and t.text.upper() in names) or (t.kind == "op" and t.text in names):
            self.i += 1
            return t
        return None

    def phrase(self, *names: str) -> bool:
        """Accepts a run of words, or nothing."""
        ahead = self.toks[self.i : self.i + len(names)]
        if [t.text.upper() for t in ahead] == list(names) and all(t.kind == "id" for t in ahead):
            self.i += len(names)
            return True
        return False

    def expect(self, *names: str) -> Token:
        return self.accept(*names) or self.fail(f"Expecting {' or '.join(names)}, got {self.tok.text or 'the end'!r}")

    def column(self) -> str:
        t = self.tok
        if t.kind == "str" or t.kind == "id":
            self.i += 1
            name = t.value
            while t.kind == "id" and self.accept("."):
                name += "." + self.column()
            return name
        return self.fail(f"Expecting a column, got {t.text or 'the end'!r}")

    def integer(self) -> int:
        t = self.tok
        if t.kind == "var":
            self.i += 1
            return Var(t.text[1:])
        if t.kind != "int":
            self.fail("Expecting an integer")
        self.i += 1
        return t.value

    # -- statement
    def statement(self) -> dict:
        if self.accept("DESC", "DESCRIBE"):
            self.column()
            self.accept(";")
            return {"describe": True}
        self.expect("SELECT")
        r: dict = {"from": 0, "size": 10}
        columns, aggs = self._select()
        if self.accept("FROM"):
            self.column()
        where = None
        seen: set[str] = set()
        if self.accept("WHERE"):
            where = self._or()
        if self.phrase("GIVEN", "FACET", "PARAM"):
            r["facetInit"] = self._given()
        while not self.accept(";") and self.tok.kind != "end":
            start = self.tok
            name = self._clause(r, aggs)
            if name in seen:
                self.fail(f"{name} clause can only appear once", start)
            seen.add(name)
        if self.tok.kind != "end":
            self.fail(f"Unexpected {self.tok.text!r}")
        if where is not None:
            self._split(where, r)
        if "_srcdata" in columns and r.get("fetchStored") is False:
            self.fail("FETCHING STORED cannot be false when _srcdata is selected.", self.toks[0], "bql.semantic")
        if "_srcdata" in columns:
            r["fetchStored"] = True
        if columns != ["*"]:
            r["select"] = columns
        if aggs:
            self._aggregate(r, aggs)
        if "distinct" in r and "groupBy" not in r:
            r["groupBy"] = {"columns": r["distinct"], "top": 0}
        return r

    def _select(self) -> tuple[list[str], list[tuple[str, str]]]:
        columns, aggs = [], []
        while True:
            if self.accept("*"):
                columns.append("*")
            elif self.tok.kind == "id" and self.toks[self.i + 1].text == "(":
                fn = self.column()
                self.expect("(")
                aggs.append((fn, "*" if self.accept("*") else self.column()))
                self.expect(")")
            else:
                columns.append(self.column())
            if not self.accept(","):
                break
        return columns or ["*"], aggs

    def _clause(self, r: dict, aggs: list) -> str:
        if self.phrase("ORDER", "BY"):
            r["sort"] = []
            while True:
                if self.accept("RELEVANCE"):
                    r["sort"].append({"_score": "desc"})
                else:
                    col = self.column()
                    self._known(col)
                    t = self.accept("ASC", "DESC")
                    r["sort"].append({col: t.text.lower() if t else "asc"})
                if not self.accept(","):
                    return "ORDER BY"
        if self.accept("LIMIT"):
            if self.accept("ALL"):
                r["from"], r["size"] = 0, None
                return "LIMIT"
            a = self.integer()
            r["from"], r["size"] = (a, self.integer()) if self.accept(",") else (0, a)
            return "LIMIT"
        if self.phrase("GROUP", "BY"):
            columns = [self.column()]
            while self.accept(",", "OR"):
                columns.append(self.column())
            for c in columns:
                kind = self._kind(c)
                if not aggs and kind == "range":
                    self.fail(f'Range facet "{c}" cannot be used in the GROUP BY clause.', code="bql.semantic")
            r["groupBy"] = {"columns": columns, "top": self.integer() if self.accept("TOP") else None}
            return "GROUP BY"
        if self.accept("DISTINCT"):
            c = self.column()
            if self.accept(","):
                self.fail("DISTINCT only supports a single column.", code="bql.semantic")
            if self._kind(c) not in (None, "simple", "custom"):
                self.fail(f'{self._kind(c)} facet "{c}" cannot be used in the DISTINCT clause.', code="bql.semantic")
            r["distinct"] = [c]
            return "DISTINCT"
        if self.accept("EXECUTE"):
            self.expect("(")
            fn, params = self.column(), {}
            if self.accept(","):
                params = self._value() if self.tok.text == "{" else self._pairs(")")
            self.expect(")")
            r["mapReduce"] = {"function": fn, "parameters": params}
            return "EXECUTE"
        if self.phrase("BROWSE", "BY"):
            r["facets"] = {}
            while True:
                name = self.column()
                self._known(name)
                spec = {"expand": False, "minHit": 1, "max": 10, "order": "hits"}
                if self.accept("("):
                    spec["expand"] = bool(self.expect("TRUE", "FALSE").text.upper() == "TRUE")
                    self.expect(",")
                    spec["minHit"] = self.integer()
                    self.expect(",")
                    spec["max"] = self.integer()
                    self.expect(",")
                    spec["order"] = "hits" if self.expect("HITS", "VALUE").text.upper() == "HITS" else "val"
                    self.expect(")")
                r["facets"][name] = spec
                if not self.accept(","):
                    return "BROWSE BY"
        if self.phrase("FETCHING", "STORED"):
            t = self.accept("TRUE", "FALSE")
            r["fetchStored"] = not t or t.text.upper() == "TRUE"
            return "FETCHING STORED"
        if self.phrase("ROUTE", "BY"):
            r["routeParam"] = self._value()
            return "ROUTE BY"
        if self.phrase("USING", "RELEVANCE", "MODEL"):
            r["relevance"] = self._relevance()
            return "USING RELEVANCE MODEL"
        return self.fail(f"Unexpected {self.tok.text!r}")

    def _given(self) -> dict:
        out: dict = {}
        while True:
            self.expect("(")
            facet = self.column()
            self.expect(",")
            name = self._value()
            self.expect(",")
            kind = self.expect("BOOLEAN", "INT", "LONG", "STRING", "BYTEARRAY", "DOUBLE").text.lower()
            self.expect(",")
            out.setdefault(facet, {})[name] = {"type": kind, "value": self._value()}
            self.expect(")")
            if not self.accept(","):
                return out

    def _pairs(self, end: str) -> dict:
        out = {}
        while self.tok.text != end:
            key = self.tok.value
            if self.tok.kind not in ("str", "id"):
                self.fail("Expecting a name")
            self.i += 1
            self.expect(":")
            out[key] = self._value()
            if not self.accept(","):
                break
        return out

    def _value(self) -> Any:
        t = self.tok
        if t.kind in ("int", "real", "str", "date"):
            self.i += 1
            return t.value
        if t.kind == "var":
            self.i += 1
            return Var(t.text[1:])
        if self.accept("-"):
            return -self._value()
        if self.accept("TRUE", "FALSE"):
            return t.text.upper() == "TRUE"
        if self.accept("["):
            out = []
            while not self.accept("]"):
                out.append(self._value())
                self.accept(",")
            return out
        if self.accept("{"):
            out = self._pairs("}")
            self.expect("}")
            return out
        if self.accept("NOW"):
            return self.now
        return self.fail(f"Expecting a value, got {t.text or 'the end'!r}")

    def _list(self) -> Any:
        if self.tok.kind == "var":
            return self._value()
        self.expect("(")
        out = []
        while not self.accept(")"):
            out.append(self._value())
            if not self.accept(","):
                self.expect(")")
                break
        return out

    # -- predicates
    def _or(self) -> dict:
        parts = [self._and()]
        while self.accept("OR"):
            parts.append(self._and())
        return parts[0] if len(parts) == 1 else {"or": parts}

    def _and(self) -> dict:
        start = self.tok
        parts = [self._predicate()]
        while self.accept("AND"):
            parts.append(self._predicate())
        return merge_ranges(parts, lambda c: self.fail(f"Inconsistent ranges detected for column: {c}", start, "bql.semantic"))

    def _span(self) -> int:
        total, any_ = 0, False
        while self.tok.kind == "int" and self.toks[self.i + 1].kind == "id" and span_ms(self.toks[self.i + 1].text):
            total += self.tok.value * span_ms(self.toks[self.i + 1].text)
            self.i += 2
            any_ = True
            self.accept(",")
        return total if any_ else self.fail("Expecting a time span")

    def _time(self) -> Any:
        after = self.toks[self.i + 1] if self.tok.kind == "int" else self.tok
        if after.kind == "id" and self.tok.kind == "int" and span_ms(after.text):
            span = self._span()
            self.expect("AGO")
            return self.now - span
        return self._value()

    def _predicate(self) -> dict:
        if self.accept("("):
            p = self._or()
            self.expect(")")
            return p
        if self.phrase("QUERY", "IS"):
            return {"query": {"query_string": {"query": self._value()}}}
        negated = bool(self.phrase("NOT", "MATCH"))
        if negated or self.accept("MATCH"):
            self.expect("(")
            fields = [self.column()]
            while self.accept(","):
                fields.append(self.column())
            self.expect(")")
            self.expect("AGAINST")
            self.expect("(")
            q = {"query": {"query_string": {"fields": fields, "query": self._value()}}}
            self.expect(")")
            return {"bool": {"must_not": [q]}} if negated else q
        if self.tok.kind == "var" or self.tok.text in ("(", "["):
            values = self._value()
            self.expect("IS")
            no = bool(self.accept("NOT"))
            self.expect("EMPTY")
            return {"const_exp": {"lvalue": {"function": "length", "params": [values]}, "operator": "!=" if no else "==", "rvalue": 0}}
        at = self.tok
        col = self.column()
        self._known(col, at)
        kind = self._kind(col)
        no = bool(self.accept("NOT"))
        if self.accept("IN"):
            if self.accept("LAST"):
                cut = self.now - self._span()
                return _range(col, **({"to": cut, "include_upper": True} if no else {"from": cut, "include_lower": False}))
            values, excludes = self._list(), self._list() if self.accept("EXCEPT") else []
            self._typed(col, [*(values if isinstance(values, list) else []), *(excludes if isinstance(excludes, list) else [])], at)
            return {"terms": {col: {"values": excludes if no else values, "excludes": values if no else excludes, "operator": "or"}}}
        if self.accept("BETWEEN"):
            if kind in ("path", "multi-path", "multi", "attribute"):
                self.fail(f'BETWEEN cannot be used on {kind} column "{col}"', at, "bql.semantic")
            a = self._time()
            self.expect("AND")
            b = self._time()
            self._typed(col, [a, b], at)
            if no:
                return {"or": [_range(col, to=a, include_upper=False), _range(col, **{"from": b}, include_lower=False)]}
            return _range(col, **{"from": a}, to=b, include_lower=True, include_upper=True)
        if self.accept("LIKE"):
            p = {"query": {"wildcard": {col: self._value().replace("%", "*").replace("_", "?")}}}
            return {"bool": {"must_not": [p]}} if no else p
        if t := self.accept("SINCE", "AFTER", "BEFORE"):
            v, up = self._time(), (t.text.upper() != "BEFORE") != no
            return _range(col, **({"from": v, "include_lower": False} if up else {"to": v, "include_upper": False}))
        if no:
            self.fail("Unexpected NOT")
        if self.phrase("CONTAINS", "ALL"):
            if self.table and not self.table.facet(col).is_multi:
                self.fail(f'CONTAINS ALL cannot be used on column "{col}"', at, "bql.semantic")
            values, excludes = self._list(), self._list() if self.accept("EXCEPT") else []
            return {"terms": {col: {"values": values, "excludes": excludes, "operator": "and"}}}
        if self.accept("IS"):
            no = bool(self.accept("NOT"))
            self.expect("NULL")
            return {"bool": {"must_not": [{"isNull": col}]}} if no else {"isNull": col}
        t = self.accept("=", "<>", "!=", "<", ">", "<=", ">=")
        if not t:
            self.fail(f"Expecting a predicate on {col}")
        v, props = self._time(), {}
        if self.accept("WITH"):
            self.expect("(")
            props = self._pairs(")")
            self.expect(")")
        self._typed(col, [v], at)
        if t.text == "=":
            if kind in ("path", "multi-path"):
                return {"path": {col: {"value": v, **props}}}
            return _range(col, **{"from": v}, to=v, include_lower=True, include_upper=True) if kind == "range" else {"term": {col: {"value": v}}}
        if t.text in ("<>", "!="):
            if kind in ("path", "multi-path"):
                self.fail(f'Operator "<>" cannot be used on path column "{col}"', at, "bql.semantic")
            if kind == "range":
                return {"or": [_range(col, to=v, include_upper=False), _range(col, **{"from": v}, include_lower=False)]}
            return {"terms": {col: {"values": [], "excludes": [v], "operator": "or"}}}
        if kind in ("path", "multi-path", "multi", "attribute"):
            self.fail(f'Operator "{t.text}" cannot be used on {kind} column "{col}"', at, "bql.semantic")
        side, edge = ("from", "include_lower") if t.text[0] == ">" else ("to", "include_upper")
        return _range(col, **{side: v, edge: t.text.endswith("=")})

    # -- checks
    def _kind(self, col: str) -> str | None:
        return self.table.facet(col).kind if self.table else None

    def _known(self, col: str, tok: Token | None = None) -> None:
        if self.table:
            try:
                self.table.facet(col)
            except EngineError as e:
                self.fail(str(e), tok, "bql.semantic")

    def _typed(self, col: str, values: list, tok: Token) -> None:
        if not self.table:
            return
        f = self.table.facet(col)
        kind = dict(self.table.df.dtypes).get(f.column or f.name, "")
        inner = re.sub(r"array<(.*)>", r"\1", kind)
        numeric = inner in ("int", "bigint", "smallint", "tinyint", "double", "float")
        for v in values:
            if isinstance(v, Var) or (numeric and isinstance(v, (int, float)) and not isinstance(v, bool)) or (not numeric and (isinstance(v, str) or inner not in ("string", "boolean"))) or (inner == "boolean" and isinstance(v, bool)):
                continue
            self.fail(f"Value {v!r} of column {col} does not match its type {inner}", tok, "bql.semantic")

    # -- assembly
    def _split(self, where: dict, r: dict) -> None:
        parts, rest = where["and"] if set(where) == {"and"} else [where], []
        for p in parts:
            op = next(iter(p))
            if op == "query" and "query" not in r and next(iter(p["query"])) == "query_string":
                r["query"] = p["query"]
            elif op in ("term", "terms", "path") or (op == "range" and self._kind(next(iter(p["range"]))) in ("range", "multi-range")):
                r.setdefault("selections", []).append(p)
            else:
                rest.append(p)
        if rest:
            r["filter"] = rest[0] if len(rest) == 1 else {"and": rest}

    def _aggregate(self, r: dict, aggs: list[tuple[str, str]]) -> None:
        group = r.pop("groupBy", None)
        for fn, _ in aggs:
            if fn.lower() not in AGGREGATES:
                self.fail(f"Unknown aggregate function: {fn}", self.toks[0], "bql.semantic")
        r["aggregates"] = {"functions": [{"function": fn.lower(), "column": c} for fn, c in aggs], "groupBy": group["columns"] if group else [], "top": (group or {}).get("top") or 10}

    def _relevance(self) -> dict:
        name, values = self.column(), {}
        self.expect("(")
        values = self._pairs(")")
        self.expect(")")
        if not self.phrase("DEFINED", "AS"):
            return {"predefined_model": name, "values": values}
        self.expect("(")
        params = []
        while not self.accept(")"):
            kind = self.column()
            params.append((kind, self.column()))
            self.accept(",")
        start = self.expect("BEGIN")
        depth = 0
        while not (self.word("END") and depth == 0):
            if self.tok.kind == "end":
                self.fail("Expecting END")
            depth += {"{": 1, "}": -1}.get(self.tok.text, 0)
            self.i += 1
        body = self.text[start.at + len("BEGIN") : self.tok.at]
        self.i += 1
        return {"model": {"name": name, "params": params, "function": body}, "values": values}


def _range(col: str, **spec) -> dict:
    return {"range": {col: spec}}


def merge_ranges(parts: list[dict], fail) -> dict:
    """Intersects the ranges on one column of a conjunction; an empty intersection is an error."""
    flat = [q for p in parts for q in (p["and"] if set(p) == {"and"} else [p])]
    out: list[dict] = []
    at: dict[str, int] = {}
    for p in flat:
        col = next(iter(p["range"])) if set(p) == {"range"} else None
        if col is None or any(isinstance(v, Var) for v in p["range"][col].values()):
            out.append(p)
            continue
        if col not in at:
            at[col] = len(out)
            out.append(p)
            continue
        a, b = dict(out[at[col]]["range"][col]), p["range"][col]
        if "from" in b and ("from" not in a or b["from"] > a["from"] or (b["from"] == a["from"] and not b.get("include_lower", True))):
            a["from"], a["include_lower"] = b["from"], b.get("include_lower", True)
        if "to" in b and ("to" not in a or b["to"] < a["to"] or (b["to"] == a["to"] and not b.get("include_upper", True))):
            a["to"], a["include_upper"] = b["to"], b.get("include_upper", True)
        if "from" in a and "to" in a and (a["from"] > a["to"] or (a["from"] == a["to"] and not (a.get("include_lower", True) and a.get("include_upper", True)))):
            fail(col)
        out[at[col]] = _range(col, **a)
    return out[0] if len(out) == 1 else {"and": out}


def parse(text: str, table: Table | None = None, now_ms: int = 0) -> dict:
    return Parser(text, table, now_ms).statement()


def predicate(text: str, table: Table | None = None, now_ms: int = 0) -> dict:
    """A WHERE expression alone, as an extra filter."""
    p = Parser(text, table, now_ms)
    out = p._or()
    if p.tok.kind != "end":
        p.fail(f"Unexpected {p.tok.text!r}")
    return out


def substitute(value: Any, variables: dict) -> Any:
    """Replaces variables everywhere in a request: ``$name`` as a whole string, too; ``$$`` is a dollar."""
    if isinstance(value, Var):
        if value.name not in variables:
            raise EngineError(f"Variable is not defined: ${value.name}", "bql.variable")
        return variables[value.name]
    if isinstance(value, str) and value.startswith("$") and len(value) > 1:
        return value[1:] if value.startswith("$$") else substitute(Var(value[1:]), variables)
    if isinstance(value, dict):
        return {k: substitute(v, variables) for k, v in value.items()}
    if isinstance(value, list):
        return [substitute(v, variables) for v in value]
    return value
