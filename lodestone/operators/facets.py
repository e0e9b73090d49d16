"""Facet counts: (value, hits) of each facet over the filtered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.catalog import Facet
from lodestone.functions.times import ddhhmmss_ms
from lodestone.operators.predicates import in_range, range_spec


def _range_name(text: str) -> str:
    r = range_spec(text)
    if r is None or text.strip()[:1] in "[(":
        return text
    show = lambda k: str(r[k]) if k in r else "*"
    return f"[{show('from')} TO {show('to')}]"


def values_of(f: Facet, params: dict | None = None, selected: str | None = None) -> Column:
    """An array of the facet's values in a row; a value counts once for each row."""
    params = {k: (v["value"] if isinstance(v, dict) else v) for k, v in (params or {}).items()}
    if f.kind in ("range", "multi-range") and f.ranges:
        cases = [F.when(in_range(f, range_spec(r)), F.lit(_range_name(r))) for r in f.ranges]
        return F.filter(F.array(*cases), lambda x: x.isNotNull())
    if f.kind == "histogram":
        start, end, unit = (float(params.get(k, getattr(f, k))) for k in ("start", "end", "unit"))
        x = f.expr
        return F.when((x >= start) & (x < end), F.array((F.floor((x - start) / unit)).cast("string"))).otherwise(F.array().cast("array<string>"))
    if f.kind == "dynamicTimeRange":
        now = int(params.get("now", params.get("time", 0)))
        cases = [F.when((f.expr > now - ddhhmmss_ms(r)) & (f.expr <= now), F.lit(r)) for r in f.ranges]
        return F.filter(F.array(*cases), lambda x: x.isNotNull())
    if f.kind in ("path", "multi-path"):
        level = len(selected.split(f.separator)) + 1 if selected else 1
        cut = lambda x: F.when(F.size(F.split(x, _escape(f.separator))) >= level, F.substring_index(x, f.separator, level))
        paths = f.expr if f.kind == "multi-path" else F.array(f.expr)
        got = F.transform(paths, cut)
        under = (lambda x: x.startswith(selected + f.separator)) if selected else (lambda x: x.isNotNull())
        return F.array_distinct(F.filter(got, under))
    if f.kind == "weighted-multi":
        return F.array_distinct(F.transform(f.expr, lambda x: x["v"]))
    return F.array_distinct(f.expr) if f.is_multi else F.filter(F.array(f.expr), lambda x: x.isNotNull())


def _escape(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in s)


def counts(df: DataFrame, f: Facet, params: dict | None = None, selected: str | None = None) -> DataFrame:
    one = f.kind in ("simple", "range", "custom") and not f.ranges
    values = df.select(f.expr.alias("value")).where("value is not null") if one else df.select(F.explode(values_of(f, params, selected)).alias("value"))
    return values.groupBy("value").agg(F.count("*").alias("hits"))


def browse(df: DataFrame, f: Facet, spec: dict, selected: list | None = None, params: dict | None = None, order: Column | None = None) -> DataFrame:
    """(value, hits, selected): at least minHit, ordered by hits or value, at most max (0: all); selected values always come along."""
    chosen = [str(v) for v in selected or []]
    path = chosen[0] if chosen and f.kind in ("path", "multi-path") and len(chosen) == 1 else None
    got = counts(df, f, params, path)
    keys = [order] if order is not None else [F.desc("hits"), F.asc("value")] if spec.get("order", "hits") == "hits" else [F.asc("value")]
    top = got.where(F.col("hits") >= int(spec.get("minHit", 1)))
    if f.kind == "attribute" and f.per_key:
        sep = f.separator if f.separator != "/" else "="
        rank = F.row_number().over(Window.partitionBy(F.substring_index("value", sep, 1)).orderBy(*keys))
        top = top.withColumn("_r", rank).where(F.col("_r") <= f.per_key).drop("_r")
    top = top.orderBy(*keys)
    if int(spec.get("max", 10)) > 0:
        top = top.limit(int(spec["max"]) if "max" in spec else 10)
    if not chosen or path:
        return top.withColumn("selected", F.lit(False))
    wanted = df.sparkSession.createDataFrame([(c,) for c in chosen], "want string")  # as long as the selection
    kind = got.schema["value"].dataType.simpleString()
    always = wanted.join(got, got["value"].cast("string") == wanted["want"], "left").select(F.col("want").cast(kind).alias("value"), F.coalesce("hits", F.lit(0)).alias("hits"))
    return top.unionByName(always).distinct().withColumn("selected", F.col("value").cast("string").isin(chosen))


def sum_group_by(df: DataFrame, dim: Facet, metric: str) -> DataFrame:
    """(value, hits): the sum of a metric for each value of a dimension."""
    return df.select(F.explode(values_of(dim)).alias("value"), F.col(metric).alias("m")).groupBy("value").agg(F.sum("m").alias("hits"))


def sum_of(df: DataFrame, metric: str) -> DataFrame:
    return df.agg(F.sum(metric).alias("hits")).select(F.lit(metric).alias("value"), "hits")
