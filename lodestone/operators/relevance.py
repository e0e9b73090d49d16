"""Relevance models: a typed script -> a score.

Scripts are parsed into a small tree; nothing of them is ever executed as code.
A script without loops becomes a Column (if/else, ternary, switch, assignments
and return as CASE expressions).  A script with loops is interpreted over Arrow
batches by the same tree, all rows of a batch at once.
"""

from __future__ import annotations

import math
import re
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.catalog import EngineError, Table

_T = re.compile(r"""\s+|//[^\n]*|/\*.*?\*/|(?P<num>\d+\.?\d*(?:[eE][-+]?\d+)?[fFlLdD]?)|(?P<str>"[^"]*")|(?P<id>[A-Za-z_]\w*)|(?P<op>\+\+|--|&&|\|\||[<>=!]=|[-+*/]=|[-+*/%<>=!?:;,.(){}\[\]])""", re.S)
_TYPES = ("int", "long", "short", "float", "double", "boolean", "String", "string", "Integer", "Long", "Double", "Float")
#: Saved and predefined models by name.
MODELS: dict[str, dict] = {}
LOOP_LIMIT = 100_000


class Script:
    """Parses statements to tuples: ("return", e), ("set", name, e), ("if", c, a, b), ("for", init, c, step, body), ("each", name, e, body), ("while", c, body), ("do", body, c)."""

    def __init__(self, text: str):
        self.toks: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _T.match(text, at)
            if not m:
                raise EngineError(f"Unexpected character in relevance function: {text[at]!r}", "relevance")
            if m.lastgroup:
                self.toks.append((m.lastgroup, m[0]))
            at = m.end()
        self.toks.append(("end", ""))
        self.i = 0
        self.body = self.block_until("")

    def peek(self, *texts: str) -> bool:
        return self.toks[self.i][1] in texts and self.toks[self.i][0] != "str"

    def take(self, *texts: str) -> str | None:
        if self.peek(*texts):
            self.i += 1
            return self.toks[self.i - 1][1]
        return None

    def need(self, text: str) -> None:
        if not self.take(text):
            raise EngineError(f"Expecting {text!r} in relevance function, got {self.toks[self.i][1]!r}", "relevance")

    def block_until(self, end: str) -> list:
        out = []
        while not self.peek(end) and self.toks[self.i][0] != "end":
            out += self.statement()
        return out

    def block(self) -> list:
        if self.take("{"):
            out = self.block_until("}")
            self.need("}")
            return out
        return self.statement()

    def statement(self) -> list:
        if self.take(";"):
            return []
        if self.peek("{"):
            return self.block()
        if self.take("return"):
            e = self.expr()
            self.need(";")
            return [("return", e)]
        if self.take("if"):
            self.need("(")
            c = self.expr()
            self.need(")")
            a = self.block()
            return [("if", c, a, self.block() if self.take("else") else [])]
        if self.take("while"):
            self.need("(")
            c = self.expr()
            self.need(")")
            return [("while", c, self.block())]
        if self.take("do"):
            b = self.block()
            self.need("while")
            self.need("(")
            c = self.expr()
            self.need(")")
            self.need(";")
            return [("do", b, c)]
        if self.take("switch"):
            self.need("(")
            e = self.expr()
            self.need(")")
            self.need("{")
            cases = []
            while not self.take("}"):
                v = None if self.take("default") else (self.need("case"), self.expr())[1]
                self.need(":")
                b = []
                while not self.peek("case", "default", "}"):
                    if self.take("break"):
                        self.need(";")
                        break
                    b += self.statement()
                cases.append((v, b))
            out = next((b for v, b in cases if v is None), [])
            for v, b in reversed([c for c in cases if c[0] is not None]):
                out = [("if", ("bin", "==", e, v), b, out)]
            return out
        if self.take("for"):
            self.need("(")
            if self.toks[self.i][0] == "id" and self.toks[self.i + 1][0] == "id" and self.toks[self.i + 2][1] == ":":
                name = self.toks[self.i + 1][1]
                self.i += 3
                e = self.expr()
                self.need(")")
                return [("each", name, e, self.block())]
            init = self.simple() if not self.peek(";") else []
            self.need(";")
            c = self.expr()
            self.need(";")
            step = self.simple() if not self.peek(")") else []
            self.need(")")
            return [("for", init, c, step, self.block())]
        out = self.simple()
        self.need(";")
        return out

    def simple(self) -> list:
        if self.toks[self.i][1] in _TYPES and self.toks[self.i + 1][0] == "id":
            self.i += 1
        name = self.toks[self.i][1]
        nxt = self.toks[self.i + 1][1]
        if self.toks[self.i][0] == "id" and nxt in ("=", "+=", "-=", "*=", "/=", "++", "--"):
            self.i += 2
            if nxt in ("++", "--"):
                return [("set", name, ("bin", nxt[0], ("name", name), ("lit", 1)))]
            e = self.expr()
            return [("set", name, e if nxt == "=" else ("bin", nxt[0], ("name", name), e))]
        if self.toks[self.i][0] == "id" and nxt == ";":  # a declaration without a value
            self.i += 1
            return [("set", name, ("lit", 0))]
        self.expr()
        return []

    LEVELS = (("||",), ("&&",), ("==", "!="), ("<", ">", "<=", ">="), ("+", "-"), ("*", "/", "%"))

    def expr(self) -> tuple:
        c = self.binary(0)
        if self.take("?"):
            a = self.expr()
            self.need(":")
            return ("cond", c, a, self.expr())
        return c

    def binary(self, level: int) -> tuple:
        if level == len(self.LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while op := self.take(*self.LEVELS[level]):
            left = ("bin", op, left, self.binary(level + 1))
        return left

    def unary(self) -> tuple:
        if self.take("-"):
            return ("bin", "-", ("lit", 0), self.unary())
        if self.take("!"):
            return ("not", self.unary())
        if self.peek("(") and self.toks[self.i + 1][1] in _TYPES and self.toks[self.i + 2][1] == ")":
            kind = self.toks[self.i + 1][1]
            self.i += 3
            return ("cast", kind, self.unary())
        return self.postfix()

    def postfix(self) -> tuple:
        kind, text = self.toks[self.i]
        self.i += 1
        if kind == "num":
            s = text.rstrip("fFlLdD")
            out: tuple = ("lit", float(s) if "." in s or "e" in s.lower() or text[-1:] in "fFdD" else int(s))
        elif kind == "str":
            out = ("lit", text[1:-1])
        elif text in ("true", "false"):
            out = ("lit", text == "true")
        elif text == "(":
            out = self.expr()
            self.need(")")
        elif kind == "id":
            out = ("name", text)
            if self.peek("("):
                out = ("call", None, text, self.args())
        else:
            raise EngineError(f"Unexpected {text!r} in relevance function", "relevance")
        while self.take("."):
            name = self.toks[self.i][1]
            self.i += 1
            out = ("call", out, name, self.args()) if self.peek("(") else ("field", out, name)
        return out

    def args(self) -> list:
        self.need("(")
        out = []
        while not self.take(")"):
            out.append(self.expr())
            self.take(",")
        return out


def has_loops(body: list) -> bool:
    return any(s[0] in ("for", "each", "while", "do") or (s[0] == "if" and (has_loops(s[2]) or has_loops(s[3]))) for s in body)


_MATH = {"exp": F.exp, "log": F.log, "log10": F.log10, "sqrt": F.sqrt, "abs": F.abs, "floor": F.floor, "ceil": F.ceil, "sin": F.sin, "cos": F.cos, "tan": F.tan, "round": F.round}


class Compiler:
    """The tree -> a Column.  Sets and maps of the parameters are Python values; facets are Columns."""

    def __init__(self, env: dict[str, Any]):
        self.env = env

    def run(self, body: list, env: dict, rest: Column | None = None) -> Column:
        for i, s in enumerate(body):
            if s[0] == "return":
                return self.col(s[1], env)
            if s[0] == "set":
                env = {**env, s[1]: self.value(s[2], env)}
            elif s[0] == "if":
                tail = body[i + 1 :]
                c = self.col(s[1], env)
                return F.when(c, self.run([*s[2], *tail], env)).otherwise(self.run([*s[3], *tail], env))
        raise EngineError("A relevance function must return a value on every way", "relevance")

    def col(self, e: tuple, env: dict) -> Column:
        v = self.value(e, env)
        return v if isinstance(v, Column) else F.lit(v)

    def value(self, e: tuple, env: dict) -> Any:
        op = e[0]
        if op == "lit":
            return e[1]
        if op == "name":
            if e[1] not in env:
                raise EngineError(f'Variable or class "{e[1]}" is not defined.', "relevance")
            return env[e[1]]
        if op == "cond":
            return F.when(self.col(e[1], env), self.col(e[2], env)).otherwise(self.col(e[3], env))
        if op == "not":
            return ~self.col(e[1], env)
        if op == "cast":
            x = self.col(e[2], env)
            kind = e[1].lower()
            return {"int": lambda: x.cast("int"), "integer": lambda: x.cast("int"), "long": lambda: x.cast("long"), "short": lambda: x.cast("short"), "boolean": lambda: x.cast("boolean"), "string": lambda: x.cast("string")}.get(kind, lambda: x.cast("double"))()
        if op == "bin":
            a, b = self.col(e[2], env), self.col(e[3], env)
            whole = self.whole(e[2], env) and self.whole(e[3], env)
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "%": lambda: a % b, "/": lambda: (a / b).cast("long") if whole else a / b, "==": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b, "&&": lambda: a & b, "||": lambda: a | b}[e[1]]()
        if op == "call":
            return self.call(e, env)
        raise EngineError(f"Not supported in a relevance function: {op}", "relevance")

    def whole(self, e: tuple, env: dict) -> bool:
        return isinstance(e[1], int) if e[0] == "lit" else e[0] == "name" and (isinstance(env.get(e[1]), int) or e[1] in env.get("__whole__", ())) or (e[0] == "cast" and e[1].lower() in ("int", "long", "short"))

    def call(self, e: tuple, env: dict) -> Any:
        _, on, name, raw = e
        args = [self.value(a, env) for a in raw]
        cols = [a if isinstance(a, Column) else F.lit(a) for a in args if not isinstance(a, (dict, list, set))]
        if on is None or on == ("name", "Math"):
            if name in ("max", "min"):
                return (F.greatest if name == "max" else F.least)(*cols)
            if name == "pow":
                return F.pow(*cols)
            if name in _MATH:
                return _MATH[name](*cols)
            raise EngineError(f"Function is not allowed: {name}", "relevance")
        target = self.value(on, env)
        if isinstance(target, (set, list)) and name == "contains":
            return cols[0].isin(list(target))
        if isinstance(target, dict) and name in ("containsKey", "get"):
            if name == "containsKey":
                return cols[0].isin(list(target))
            pairs = [F.lit(x) for kv in target.items() for x in kv]
            return F.try_element_at(F.create_map(*pairs), cols[0]) if pairs else F.lit(None)
        if isinstance(target, (set, list, dict)) and name in ("size", "isEmpty"):
            return len(target) if name == "size" else not target
        if isinstance(target, Column):
            if name == "contains":
                return F.array_contains(target, cols[0])
            if name in ("containsAny", "containsAll"):
                values = F.array(*[F.lit(x) for x in args[0]])
                return F.arrays_overlap(target, values) if name == "containsAny" else F.size(F.array_except(values, target)) == 0
            if name in ("hasWeight", "getWeight"):
                w = F.get(F.filter(target, lambda x: x["v"] == cols[0]), 0)["w"]
                return w.isNotNull() if name == "hasWeight" else F.coalesce(w, F.lit(0))
            text = {"equals": lambda: target == cols[0], "startsWith": lambda: target.startswith(cols[0]), "endsWith": lambda: target.endswith(cols[0]), "length": lambda: F.length(target), "toLowerCase": lambda: F.lower(target), "toUpperCase": lambda: F.upper(target), "size": lambda: F.size(target)}
            if name in text:
                return text[name]()
        raise EngineError(f"Method is not allowed: {name}", "relevance")


class Interpreter:
    """The same tree over Python values of one row, for scripts with loops."""

    class Return(Exception):
        pass

    def run(self, body: list, env: dict) -> Any:
        self.steps = 0
        try:
            self.block(body, env)
        except Interpreter.Return as r:
            return r.args[0]
        return None

    def block(self, body: list, env: dict) -> None:
        for s in body:
            if s[0] == "return":
                raise Interpreter.Return(self.value(s[1], env))
            if s[0] == "set":
                env[s[1]] = self.value(s[2], env)
            elif s[0] == "if":
                self.block(s[2] if self.value(s[1], env) else s[3], env)
            elif s[0] == "each":
                for x in list(self.value(s[2], env) or []):
                    env[s[1]] = x
                    self.block(s[3], env)
            else:
                init, cond, step, inner = (s[1], s[2], s[3], s[4]) if s[0] == "for" else ([], s[1], [], s[2]) if s[0] == "while" else ([], s[2], [], s[1])
                self.block(init, env)
                if s[0] == "do":
                    self.block(inner, env)
                while self.value(cond, env):
                    self.steps += 1
                    if self.steps > LOOP_LIMIT:
                        raise EngineError("A relevance function looped too long", "relevance")
                    self.block(inner, env)
                    self.block(step, env)

    def value(self, e: tuple, env: dict) -> Any:
        op = e[0]
        if op == "lit":
            return e[1]
        if op == "name":
            if e[1] not in env:
                raise EngineError(f'Variable or class "{e[1]}" is not defined.', "relevance")
            return env[e[1]]
        if op == "cond":
            return self.value(e[2] if self.value(e[1], env) else e[3], env)
        if op == "not":
            return not self.value(e[1], env)
        if op == "cast":
            x = self.value(e[2], env)
            return int(x) if e[1].lower() in ("int", "long", "short", "integer") else str(x) if e[1].lower() == "string" else float(x)
        if op == "bin":
            if e[1] in ("&&", "||"):
                a = bool(self.value(e[2], env))
                return a and bool(self.value(e[3], env)) if e[1] == "&&" else a or bool(self.value(e[3], env))
            a, b = self.value(e[2], env), self.value(e[3], env)
            if e[1] == "/":
                return int(a / b) if isinstance(a, int) and isinstance(b, int) else a / b
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "%": lambda: math.fmod(a, b), "==": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b}[e[1]]()
        _, on, name, raw = e
        args = [self.value(a, env) for a in raw]
        if on is None or on == ("name", "Math"):
            return _function(name)(*args)
        return _method(name, self.value(on, env), args)


def _function(name: str) -> Any:
    allowed = {"exp": math.exp, "log": math.log, "log10": math.log10, "sqrt": math.sqrt, "abs": abs, "floor": math.floor, "ceil": math.ceil, "pow": pow, "max": max, "min": min, "sin": math.sin, "cos": math.cos, "tan": math.tan, "round": round}
    if name not in allowed:
        raise EngineError(f"Function is not allowed: {name}", "relevance")
    return allowed[name]


def _method(name: str, t: Any, args: list) -> Any:
    methods = {"contains": lambda: args[0] in t, "containsKey": lambda: args[0] in t, "get": lambda: t[args[0]], "size": lambda: len(t), "length": lambda: len(t), "isEmpty": lambda: not t, "containsAny": lambda: any(x in t for x in args[0]), "containsAll": lambda: all(x in t for x in args[0]), "equals": lambda: t == args[0], "startsWith": lambda: t.startswith(args[0]), "endsWith": lambda: t.endswith(args[0]), "toLowerCase": lambda: t.lower(), "toUpperCase": lambda: t.upper(), "hasWeight": lambda: any(x["v"] == args[0] for x in t), "getWeight": lambda: next((x["w"] for x in t if x["v"] == args[0]), 0)}
    if name not in methods:
        raise EngineError(f"Method is not allowed: {name}", "relevance")
    return methods[name]()


class ByRow(Exception):
    """What a batch asks for can only be said of single rows."""


_EXACT, _LARGE = 2**53, 2**62


class Columnwise:
    """The same tree over the columns of a batch: a statement runs once for all rows that reach it.

    A value is an array with an element for each of these rows: int64, float64,
    bool, or Python values.  Where a batch could come to another result than its
    rows one by one (whole numbers beyond 64 bits, errors, types that differ
    between rows where that matters), it ends in an exception; the caller then
    takes the rows one by one.
    """

    def run(self, body: list, env: dict, columns: dict, n: int) -> list:
        self.plain, self.env, self.n, self.mixed = env, columns, n, set()
        self.steps, self.live = np.zeros(n, np.int64), np.ones(n, bool)
        self.known: dict[str, np.ndarray] = {}  # rows in which a name has a value, where not in all
        self.out = np.full(n, None, object)
        with np.errstate(all="ignore"):
            self.block(body, np.arange(n))
        return self.out.tolist()

    def block(self, body: list, rows: np.ndarray) -> None:
        for s in body:
            rows = rows[self.live[rows]]
            if not len(rows):
                return
            if s[0] == "return":
                self.out[rows] = [float(x) if x is not None else None for x in self.value(s[1], rows).tolist()]
                self.live[rows] = False
            elif s[0] == "set":
                self.put(s[1], rows, self.value(s[2], rows), self.touched(s[2]))
            elif s[0] == "if":
                c = _truth(self.value(s[1], rows))
                self.block(s[2], rows[c])
                self.block(s[3], rows[~c])
            elif s[0] == "each":
                lists, at = [list(x or []) for x in self.value(s[2], rows).tolist()], 0
                left = np.arange(len(rows))
                while len(left := left[[len(lists[i]) > at and bool(self.live[rows[i]]) for i in left.tolist()]]):
                    self.put(s[1], rows[left], _array([lists[i][at] for i in left.tolist()]), False)
                    self.block(s[3], rows[left])
                    at += 1
            else:
                init, cond, step, inner = (s[1], s[2], s[3], s[4]) if s[0] == "for" else ([], s[1], [], s[2]) if s[0] == "while" else ([], s[2], [], s[1])
                self.block(init, rows)
                if s[0] == "do":
                    self.block(inner, rows)
                left = rows
                while len(left := left[self.live[left]]) and len(left := left[_truth(self.value(cond, left))]):
                    self.steps[left] += 1
                    if self.steps[left].max() > LOOP_LIMIT:
                        raise EngineError("A relevance function looped too long", "relevance")
                    self.block(inner, left)
                    self.block(step, left)

    def put(self, name: str, rows: np.ndarray, x: np.ndarray, mixed: bool) -> None:
        known = self.known.pop(name, np.full(self.n, name in self.env or name in self.plain))
        if name not in self.env and name in self.plain:
            self.env[name] = _array([self.plain[name]] * self.n)
        others = known & self.live
        others[rows] = False
        old = self.env.get(name)
        if not others.any():
            self.env[name] = np.zeros(self.n, x.dtype)
            self.mixed.discard(name)
        elif old.dtype != x.dtype:
            if {old.dtype.kind, x.dtype.kind} != {"i", "f"}:
                raise ByRow
            _small(old if old.dtype.kind == "i" else x, _EXACT)
            self.env[name] = old.astype(float)
            mixed = True
        self.env[name][rows] = x
        known[rows] = True
        if not known.all():
            self.known[name] = known
        if mixed:
            self.mixed.add(name)

    def touched(self, e) -> bool:
        """Whether an expression is of a name that is whole in some rows only."""
        return bool(self.mixed) and (e[0] == "name" and e[1] in self.mixed if isinstance(e, tuple) and e and e[0] in ("name", "lit") else isinstance(e, (tuple, list)) and any(map(self.touched, e)))

    def value(self, e: tuple, rows: np.ndarray) -> np.ndarray:
        op = e[0]
        if op == "lit":
            return _array([e[1]]).repeat(len(rows))
        if op == "name":
            if e[1] in self.env:
                if e[1] in self.known and not self.known[e[1]][rows].all():
                    raise ByRow
                return self.env[e[1]][rows]
            if e[1] not in self.plain:
                raise EngineError(f'Variable or class "{e[1]}" is not defined.', "relevance")
            return _array([self.plain[e[1]]] * len(rows))
        if op == "cond":
            c = _truth(self.value(e[1], rows))
            parts = [(k, self.value(x, rows[k])) for k, x in ((c, e[2]), (~c, e[3])) if k.any()]
            return _joined(parts, len(rows))
        if op == "not":
            return ~_truth(self.value(e[1], rows))
        if op == "cast":
            x, kind = self.value(e[2], rows), e[1].lower()
            if self.touched(e[2]):
                raise ByRow
            return _array(list(map(int if kind in ("int", "long", "short", "integer") else str if kind == "string" else float, x.tolist())))
        if op == "bin":
            return self.binary(e, rows)
        _, on, name, raw = e
        if self.touched(raw):
            raise ByRow
        args = [self.value(a, rows).tolist() for a in raw]
        if on is None or on == ("name", "Math"):
            return _array(list(map(_function(name), *args)))
        return _array([_method(name, t, list(a)) for t, *a in zip(self.value(on, rows).tolist(), *args)])

    def binary(self, e: tuple, rows: np.ndarray) -> np.ndarray:
        _, op, left, right = e
        a = self.value(left, rows)
        if op in ("&&", "||"):
            a = _truth(a)
            more = a if op == "&&" else ~a
            if more.any():
                a[more] = _truth(self.value(right, rows[more]))
            return a
        b = self.value(right, rows)
        if "O" in (a.dtype.kind, b.dtype.kind):
            if op not in ("==", "!="):
                raise ByRow
            return np.array([(x == y) == (op == "==") for x, y in zip(a.tolist(), b.tolist())], bool)
        if "b" in (a.dtype.kind, b.dtype.kind) and not (a.dtype == b.dtype and op in ("==", "!=")):
            raise ByRow
        whole = a.dtype.kind == b.dtype.kind == "i"
        if op in ("==", "!=", "<", "<=", ">", ">="):
            if a.dtype != b.dtype:
                _small(a if a.dtype.kind == "i" else b, _EXACT)
            return {"==": np.equal, "!=": np.not_equal, "<": np.less, "<=": np.less_equal, ">": np.greater, ">=": np.greater_equal}[op](a, b)
        if op in ("/", "%"):
            if not b.all() or self.touched(e) or (op == "%" and np.isinf(a).any()):
                raise ByRow
            if op == "%":
                return np.fmod(a.astype(float), b.astype(float))
            if whole:
                _small(a, _EXACT), _small(b, _EXACT)
            return (a / b).astype(np.int64) if whole else a / b
        do = {"+": np.add, "-": np.subtract, "*": np.multiply}[op]
        if whole:
            _small(do(a.astype(float), b.astype(float)), _LARGE)
        got = do(a, b)
        if self.touched(e):
            _small(got, _EXACT)
        return got


def _small(x: np.ndarray, limit: int) -> None:
    if len(x) and not (float(x.max()) < limit and float(x.min()) > -limit):
        raise ByRow


def _truth(x: np.ndarray) -> np.ndarray:
    return x.copy() if x.dtype.kind == "b" else np.array([bool(v) for v in x.tolist()], bool) if x.dtype.kind == "O" else x != 0


def _array(values: list) -> np.ndarray:
    """Values as an array of numbers or booleans if they are of one such type, else of Python values."""
    kinds = set(map(type, values))
    if kinds <= {int} or kinds <= {float} or kinds <= {bool}:
        return np.array(values, np.int64 if kinds == {int} else bool if kinds == {bool} else float)
    if kinds & {int, float, bool}:
        raise ByRow
    out = np.empty(len(values), object)
    for i, v in enumerate(values):
        out[i] = v
    return out


def _joined(parts: list, n: int) -> np.ndarray:
    if len({x.dtype for _, x in parts}) != 1:
        raise ByRow
    out = np.empty(n, parts[0][1].dtype)
    for k, x in parts:
        out[k] = x
    return out


def scores(rows: pd.DataFrame, body: list, plain: dict) -> pd.Series:
    """The score of each row of a batch."""
    single = lambda v: v.tolist() if hasattr(v, "tolist") else v
    try:
        columns = {}
        for k in rows.columns:
            x = rows[k].to_numpy()
            kind = {"i": np.int64, "f": float, "b": bool}.get(x.dtype.kind)
            columns[k] = x.astype(kind) if kind else _array([single(v) for v in x.tolist()])
        out = Columnwise().run(body, plain, columns, len(rows))
    except Exception:  # the rows one by one say what is wrong, if anything is
        out = []
        for row in rows.to_dict("records"):
            got = Interpreter().run(body, {**plain, **{k: single(v) for k, v in row.items()}})
            out.append(float(got) if got is not None else None)
    return pd.Series(out, dtype="float64")


def _parameter(kind: str, value: Any) -> Any:
    """Sets as lists, maps as dicts (also from {"key": [..], "value": [..]})."""
    if kind.startswith("map_") or (isinstance(value, dict) and set(value) == {"key", "value"}):
        return dict(zip(value["key"], value["value"])) if set(value) == {"key", "value"} else {(int(k) if kind.startswith(("map_int", "map_long")) else k): v for k, v in value.items()}
    return value


def apply(df: DataFrame, table: Table, spec: dict, now_ms: int = 0) -> DataFrame:
    """Rewrites ``_score`` of every row by a model: inline (params or JSON form), saved, or predefined."""
    values = spec.get("values", {})
    if "predefined_model" in spec:
        if spec["predefined_model"] not in MODELS:
            raise EngineError(f"Relevance model is not defined: {spec['predefined_model']}", "relevance")
        model = MODELS[spec["predefined_model"]]
    else:
        model = spec["model"]
    params = list(model.get("params", []))
    for kind, names in {**model.get("variables", {}), **{f"facet:{k}": v for k, v in model.get("facets", {}).items()}}.items():
        params += [(kind, n) for n in names]
    if model.get("save_as"):
        name = model["save_as"]["name"] if isinstance(model["save_as"], dict) else model["save_as"]
        MODELS[name] = {k: v for k, v in model.items() if k != "save_as"}
    env: dict[str, Any] = {"_INNER_SCORE": F.col("_score"), "_NOW": now_ms, "_RANDOM": F.rand()}
    whole = set()
    for kind, name in params:
        if name in values:
            env[name] = _parameter(kind, values[name])
        else:
            f = table.facet(name)
            env[name] = f.expr
            if dict(table.df.dtypes).get(f.column or f.name) in ("int", "bigint", "smallint"):
                whole.add(name)
    env["__whole__"] = whole
    body = Script(model["function"]).body
    if not has_loops(body):
        return df.withColumn("_score", Compiler(env).run(body, env).cast("double"))
    facets = {n: c for n, c in env.items() if isinstance(c, Column)}
    plain = {n: v for n, v in env.items() if n not in facets}
    names = list(facets)

    @F.pandas_udf("double")
    def score(rows: pd.DataFrame) -> pd.Series:
        return scores(rows, body, plain)

    return df.withColumn("_score", score(F.struct(*[facets[n].alias(n) for n in names])))
