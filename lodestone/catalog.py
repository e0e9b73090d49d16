"""Tables and facets: the metadata that decides how a predicate or a count compiles."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Numbers of the error types that results carry (fixed values), by the kinds of code that raise them.
ERROR_NUMBERS = {"json.parse": 100, "json": 101, "request": 101, "mapreduce": 101, "relevance": 101, "bql": 150, "execution": 200, "timeout": 250, "merge": 300, "partition": 350, "broker.timeout": 400, "internal": 450, "merge.partition": 500, "federation": 550, "unknown": 1000}


class EngineError(ValueError):
    """A statement or request that cannot be compiled; ``code`` names the kind of error, ``number`` its type."""

    @property
    def number(self) -> int:
        return ERROR_NUMBERS.get(self.code) or ERROR_NUMBERS.get(self.code.split(".")[0], ERROR_NUMBERS["unknown"])

    def to_dict(self) -> dict:
        return {"code": self.code, "errorCode": self.number, "message": str(self), "line": self.line, "col": self.col}

    def __init__(self, message: str, code: str = "request", line: int | None = None, col: int | None = None):
        super().__init__(f"[line:{line}, col:{col}] {message}" if line is not None else message)
        self.code, self.line, self.col = code, line, col


#: Facet kinds whose column holds several values.
MULTI_KINDS = ("multi", "compact-multi", "weighted-multi", "attribute", "multi-range")


@dataclass(frozen=True)
class Facet:
    """A named, typed view of a column.

    kind: simple, range, multi-range, path, multi-path, multi, compact-multi, weighted-multi
    (array of struct<v,w>), attribute (array of "key=value"), histogram, dynamicTimeRange,
    or custom (``derive`` gives the column).
    """

    name: str
    kind: str = "simple"
    column: str | None = None
    separator: str = "/"
    ranges: tuple[str, ...] = ()
    start: float = 0
    end: float = 0
    unit: float = 1
    per_key: int = 0
    derive: Callable[[], Column] | None = None

    @property
    def expr(self) -> Column:
        return self.derive() if self.derive else F.col(self.column or self.name)

    @property
    def is_multi(self) -> bool:
        return self.kind in MULTI_KINDS


@dataclass
class Table:
    """One flat DataFrame with a key column and its facets.  Columns without a facet are simple."""

    df: DataFrame
    uid: str | None = None
    facets: dict[str, Facet] = field(default_factory=dict)
    text: str = "contents"
    activity: tuple[str, ...] = ()
    plain: DataFrame | None = None

    @classmethod
    def of(cls, df: DataFrame, uid: str | None = None, facets: Sequence[Facet] = (), **more) -> Table:
        return cls(df, uid, {f.name: f for f in facets}, **more)

    def extended(self, extra: DataFrame, facets: Sequence[Facet] = (), activity: bool = False) -> Table:
        """This table with the columns of another one, joined by the key, and their facets.

        For counters of documents (``activity``: a row without one has null, which
        no range meets) and for any other engine that keeps fields beside the
        table.  ``extra`` has one row for each key.  Requests that name none of
        its columns or facets are run without the join.
        """
        names = tuple(c for c in extra.columns if c != self.uid)
        more = {f.name: f for f in facets}
        # what is joined earlier stays part of the plain table, so that one join can be left out without the other
        return Table(self.df.join(extra, self.uid, "left"), self.uid, self.facets | more, self.text, (*self.activity, *names) if activity else self.activity, self.df)

    def without(self, mentioned: str) -> Table:
        """The table as far as a request needs it, given the request's text."""
        if self.plain is None:
            return self
        own = set(self.plain.columns)
        added = [c for c in self.df.columns if c not in own]
        views = [f.name for f in self.facets.values() if f.derive is not None or (f.column or f.name) in added]
        if any(n in mentioned for n in (*added, *views)):
            return self
        return Table(self.plain, self.uid, self.facets, self.text, self.activity)

    @classmethod
    def from_dict(cls, spark: SparkSession, df: DataFrame, schema: dict) -> Table:
        """From a schema document: {"table": {"uid", "columns": [..]}, "facets": [..]}; ``from`` renames, ``multi`` splits."""
        table = schema.get("table", {})
        cols = []
        for c in table.get("columns", []):
            col = F.col(c.get("from", c["name"]))
            if c.get("multi"):
                col = split_multi(col, c.get("delimiter", ","))
            kind = {"int": "int", "short": "short", "long": "long", "float": "double", "double": "double", "boolean": "boolean", "date": "timestamp"}.get(c.get("type", "string"), "string")
            cols.append((col.cast(f"array<{kind}>") if c.get("multi") else col.cast(kind)).alias(c["name"]))
        uid = table.get("uid")
        if uid and uid not in [c["name"] for c in table.get("columns", [])]:
            cols.insert(0, F.col(uid).cast("long").alias(uid))
        facets = [Facet(f["name"], f.get("type", "simple"), f.get("column"), f.get("params", {}).get("separator", "=" if f.get("type") == "attribute" else "/"), tuple(f.get("params", {}).get("range", ()))) for f in schema.get("facets", [])]
        return cls.of(df.select(*cols), uid, facets, activity=tuple(c["name"] for c in table.get("columns", []) if c.get("activity")))

    def facet(self, name: str) -> Facet:
        if name in self.facets:
            return self.facets[name]
        if name == "_uid" and self.uid:
            return Facet("_uid", "simple", self.uid)
        head = name.split(".")[0]
        if head in self.df.columns:
            return Facet(name, "multi" if dict(self.df.dtypes)[head].startswith("array") else "simple", name)
        raise EngineError(f"Column or facet is not defined: {name}", "bql.semantic")

    def describe(self) -> DataFrame:
        """(name, type, facet) of every column, then facets that are no column."""
        rows = [(n, t, self.facets[n].kind if n in self.facets else None) for n, t in self.df.dtypes]
        rows += [(f.name, None, f.kind) for f in self.facets.values() if f.name not in self.df.columns]
        return self.df.sparkSession.createDataFrame(rows, "name string, type string, facet string")


def split_multi(col: Column, delimiter: str = ",") -> Column:
    r"""Values of a delimited column; a backslash before a delimiter or a backslash keeps that in the value."""
    bare = F.replace(F.replace(col, F.lit("\\\\"), F.lit("\x01")), F.lit("\\" + delimiter), F.lit("\x00"))
    value = lambda x: F.replace(F.replace(x, F.lit("\x00"), F.lit(delimiter)), F.lit("\x01"), F.lit("\\"))
    return F.filter(F.transform(F.split(bare, _quoted(delimiter)), lambda x: value(F.trim(x))), lambda x: x != "")


def _quoted(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in s)
