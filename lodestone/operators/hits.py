"""Hits: projection, sort, paging, collapsing into groups, distinct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.catalog import Table
from lodestone.operators.fulltext import term_vector


def sort_keys(table: Table, sort: list | str | None) -> list[Column]:
    """Missing values first ascending and last descending; the uid breaks ties."""
    keys, tie = [], True
    for s in [sort] if isinstance(sort, str) else sort or []:
        if isinstance(s, str):
            s = {"relevance": {"_score": "desc"}, "relrev": {"_score": "asc"}, "doc": {"_uid": "asc"}, "docrev": {"_uid": "desc"}}.get(s, {s: "asc"})
        for name, how in s.items():
            col = F.col("_score") if name == "_score" else table.facet(name).expr
            tie &= name not in ("_uid", table.uid)
            keys.append(col.desc_nulls_last() if str(how).lower().startswith("desc") else col.asc_nulls_first())
    return [*keys, *([F.col(table.uid).asc()] if table.uid and tie else [])]


def page(df: DataFrame, keys: list[Column], offset: int, size: int | None) -> DataFrame:
    """``size`` rows from ``offset`` on; None is all of them."""
    out = df.orderBy(*keys) if keys else df
    out = out.offset(offset) if offset else out
    return out if size is None else out.limit(size)


def collapse(df: DataFrame, table: Table, columns: list[str], keys: list[Column], top: int | None = None, distinct: str | None = None) -> DataFrame:
    """The best row of each group, with groupfield, groupvalue, _grouphitscount, and the uids of up to ``top`` grouphits.

    With several columns a row takes the first whose value occurs twice or more,
    else the first of all.  ``distinct`` makes the group hits unique by a column.
    A missing value is a group of its own.
    """
    df = df.withColumns({f"_g{i}": table.facet(c).expr.cast("string") for i, c in enumerate(columns)})
    which = F.lit(0)
    if len(columns) > 1:
        many = [F.col(f"_g{i}").isNotNull() & (F.count("*").over(Window.partitionBy(f"_g{i}")) > 1) for i in range(len(columns))]
        which = F.coalesce(*[F.when(m, i) for i, m in enumerate(many)], F.lit(0))
    df = df.withColumn("_which", which)
    value = F.coalesce(*[F.when(F.col("_which") == i, F.col(f"_g{i}")) for i in range(len(columns))])
    df = df.withColumns({"groupfield": F.element_at(F.array(*map(F.lit, columns)), F.col("_which") + 1), "groupvalue": value})
    group = ["_which", "groupvalue"]
    helpers = [f"_g{i}" for i in range(len(columns))] + ["_which", "_rank", "_first"]
    if not (top and table.uid):
        return _best_of(df, group, keys).drop(*helpers)
    w = Window.partitionBy(*group)
    ranked = df
    if distinct:  # of each value of the distinct column the group's first
        d = Window.partitionBy(*group, table.facet(distinct).expr)
        ranked = df.withColumn("_rank", F.row_number().over(d.orderBy(*keys))).where("_rank = 1")
    # a window that is cut at a rank keeps no more than so many rows of a group and task before the shuffle
    first = ranked.withColumn("_rank", F.row_number().over(w.orderBy(*keys))).where(F.col("_rank") <= top)
    shown = first.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("_rank", F.col(table.uid).alias("uid")))).alias("shown"))
    shown = shown.select(F.col("_which").alias("_w"), F.col("groupvalue").alias("_v"), F.transform("shown", lambda x: x["uid"]).alias("grouphits"))
    best = _best_of(df, group, keys)
    return best.join(shown, (F.col("_which") == F.col("_w")) & F.col("groupvalue").eqNullSafe(F.col("_v"))).drop(*helpers, "_w", "_v")


def _best_of(df: DataFrame, group: list[str], keys: list[Column]) -> DataFrame:
    """The first row of each group by the keys, with the group's size."""
    first = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*keys))).where("_rank = 1")
    sizes = df.groupBy(*group).agg(F.count("*").alias("_grouphitscount")).withColumnsRenamed({"_which": "_w", "groupvalue": "_v"})
    return first.join(sizes, (F.col("_which") == F.col("_w")) & F.col("groupvalue").eqNullSafe(F.col("_v"))).drop("_w", "_v")


def project(df: DataFrame, table: Table, columns: list[str] | None, stored: bool = False, vectors: list[str] = ()) -> DataFrame:
    """The selected columns; ``_uid``, ``_docid``, ``_score``, ``_srcdata`` and nested ``a.b`` are computed."""
    base = table.df.columns
    group = [c for c in ("groupfield", "groupvalue", "_grouphitscount", "grouphits") if c in df.columns]
    out = []
    for c in columns or ["*"]:
        if c == "*":
            out += [F.col(f"`{x}`") for x in base]
        elif c in ("_srcdata", "_stored"):
            out.append(F.to_json(F.struct(*[F.col(f"`{x}`") for x in base])).alias(c))
        elif c == "_termvectors":
            out.append(term_vector(F.col(table.text)).alias(c))
        elif c in ("_uid", "_docid"):
            out.append(F.col(table.uid).alias(c))
        elif c in df.columns:
            out.append(F.col(f"`{c}`"))
        elif c in table.facets:
            out.append(table.facet(c).expr.alias(c))
        else:
            head, _, rest = c.partition(".")
            kind = dict(table.df.dtypes)[head]
            out.append((F.get_json_object(head, f"$.{rest}") if kind == "string" else F.col(c)).alias(c))
    if stored and "_srcdata" not in (columns or []):
        out.append(F.to_json(F.struct(*[F.col(f"`{x}`") for x in base])).alias("_srcdata"))
    out += [term_vector(F.col(v)).alias(f"_termvector_{v}") for v in vectors]
    named = set(columns or [])
    return df.select(*out, *[F.col(g) for g in group if g not in named])


def get(table: Table, uids: list) -> DataFrame:
    """Stored documents by uid."""
    return project(table.df.where(F.col(table.uid).isin(uids)), table, ["_uid", "_srcdata"])
