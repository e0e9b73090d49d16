"""Mixing sources to target weights by weighted fair queueing.

The documents of a source queue in an order shuffled by a hash of their key, as
many rounds as a document may be taken.  A copy's virtual finish time is the
number of its source's words up to and including it, divided by the source's
target.  All copies are put in the order of their finish times, and the mix is
what comes before the total budget is used up; the copy on the border is taken
if at least half of it fits.

Sums run in two levels: hash bins of about sqrt(rows) rows, then the bins of a
source, so neither a hot source nor the global order ever meets in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, stored

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) for a row (source, source_size) of each source.

    Weights go round the sources in code-point order, null last.  Targets split
    share * total by weight; none is above most * its source's size, and what a
    full source leaves goes to the others by weight (solved by the order in
    which sources fill up, not by iteration).
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    n = (F.row_number().over(order) - 1) % len(weights)
    weighed = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    fills = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, after = fills.rowsBetween(Window.unboundedPreceding, -1), fills.rowsBetween(0, Window.unboundedFollowing)
    level = weighed.withColumn("level", (F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    level = level.withColumn("full", F.col("cap") <= F.col("weight") * F.col("level")).withColumn("at", F.row_number().over(fills))
    line = F.min(F.when(~F.col("full"), F.struct("at", "level"))).over(Window.partitionBy())["level"]
    return level.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * line).alias("target"))


def _queued(docs: DataFrame, key: str, source: str, seed: str, weights: Sequence[float], share: float, most: int) -> DataFrame:
    """(_k, _s, _r, size, source_size, target, h, copy, finish, in): every copy of every row in the common queue, and whether it is taken."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col(key).alias("_k"), F.col(source).alias("_s"), F.xxhash64("text").alias("_r"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    rows = stored(rows, "sizes")
    bins = max(1, math.isqrt(rows.count()))
    tag = F.coalesce(F.concat(F.lit("s"), "_s"), F.lit("n"))
    name = F.coalesce(F.col("_k").cast("string"), F.concat(F.lit("#"), F.col("_r").cast("string")))  # rows without a key are shuffled by text
    rows = rows.withColumns({"tag": tag, "h": F.md5(F.concat_ws(":", F.lit(seed), name))})
    rows = rows.withColumn("bin", F.shiftright(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * bins, 32))  # keeps the order of h
    sums = rows.groupBy("tag", "_s", "bin").agg(F.sum("size").alias("n"))
    per_source = sums.groupBy("_s").agg(F.sum("n").alias("source_size")).withColumnRenamed("_s", "source")
    plan = stored(targets(per_source, weights, share, most), "targets").withColumn("tag", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("tag").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("ahead", ahead).drop("_s", "n").join(plan.select("tag", "source_size", "target"), "tag")
    inside = Window.partitionBy("tag", "bin").orderBy("h", "_k", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(sums, ["tag", "bin"]).withColumn("upto", F.col("ahead") + F.sum("size").over(inside))
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    finish = F.when(F.col("target") > 0, (F.col("upto") + F.col("copy") * F.col("source_size")) / F.col("target")).otherwise(F.lit(0.0))
    copies = stored(copies.select("_k", "_s", "_r", "size", "source_size", "target", "h", "copy", finish.alias("finish")).withColumn("slot", F.least(F.floor(F.col("finish") * bins), F.lit(2 * bins))), "finish")
    budget = plan.agg(F.sum("target")).first()[0] or 0.0
    slots = copies.groupBy("slot").agg(F.sum("size").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    edge = slots.where(F.col("ahead") <= budget).orderBy(F.desc("slot")).first()
    at, ahead = (edge["slot"], edge["ahead"]) if edge else (0, 0)
    narrow = Window.partitionBy("slot").orderBy("finish", "h", "_k", "size", "copy").rowsBetween(Window.unboundedPreceding, 0)
    border = copies.where(F.col("slot") == at).withColumn("sum", F.sum("size").over(narrow) + F.lit(ahead)).withColumn("in", 2 * F.col("sum") - F.col("size") <= F.lit(2 * budget)).drop("sum")
    return copies.where(F.col("slot") != at).withColumn("in", F.col("slot") < at).unionByName(border)


def mix_table(docs: DataFrame, key: str = "doc_id", source: str = "source", seed: str = "mix", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(key, source, size, source_size, target, taken, copies) for every row of ``docs``.

    size counts words, 0 for null; taken is copies * size.  Rows of size 0 take
    part (and give nothing).  A null source is a source, the last; rows without
    a key queue by their text.  Repeated rows are documents of their own.  An
    empty table gives an empty one; reruns agree; other columns are ignored.
    """
    # a row's copies differ in their number, so the first copies stand for the rows
    again = [F.sum(F.col("in").cast("int")).alias("taken"), F.sum((F.col("copy") == 0).cast("int")).alias("rows")]
    got = _queued(docs, key, source, seed, weights, share, most).groupBy("_k", "_s", "_r", "size", "source_size", "target", "h").agg(*again)
    # repeated rows are dealt their copies evenly
    got = got.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
    each = (F.floor(F.col("taken") / F.col("rows")) + (F.col("i") < F.col("taken") % F.col("rows")).cast("int")).cast("int")
    return got.select(F.col("_k").alias(key), F.col("_s").alias(source), "size", "source_size", "target", (each * F.col("size")).alias("taken"), each.alias("copies"))


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", seed: str = "mix", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself, range-sorted by virtual finish time: rows of ``docs``, those taken twice two times; all columns under their own names.

    Rows that share key, source and text are taken as often as the least taken of them.
    """
    # a copy's number is the same for repeated rows: of each number, all rows or none
    plan = _queued(docs, key, source, seed, weights, share, most).groupBy("_k", "_s", "_r", "copy").agg(F.min("in").alias("in"), F.min("finish").alias("_f")).where(F.col("in"))
    on = F.col(key).eqNullSafe(F.col("_k")) & F.col(source).eqNullSafe(F.col("_s")) & F.col("_row").eqNullSafe(F.col("_r"))
    taken = docs.withColumn("_row", F.xxhash64("text")).join(plan, on)
    return taken.repartitionByRange("_f", "_row").sortWithinPartitions("_f", "_row").select(*docs.columns)


ORACLE = r"""
WITH r AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, row_number() OVER f AS pos,
      ((SELECT sum(source_size)::DOUBLE FROM s) * 1.5::DOUBLE - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w WINDOW f AS (ORDER BY cap / weight, source NULLS LAST)),
t AS (SELECT source, source_size, CASE WHEN cap <= weight * level THEN cap
      ELSE weight * (SELECT arg_min(level, pos) FROM l WHERE cap > weight * level) END AS target FROM l),
c AS (SELECT r.*, t.source_size, t.target, k.copy,
      sum(r.size) OVER (PARTITION BY r.source, k.copy ORDER BY h, doc_id, r.size ROWS UNBOUNDED PRECEDING) AS upto
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source CROSS JOIN (VALUES (0), (1)) k(copy)),
f AS (SELECT *, CASE WHEN target > 0 THEN (upto + copy * source_size)::DOUBLE / target ELSE 0 END AS finish FROM c),
o AS (SELECT *, sum(size) OVER (ORDER BY finish, h, doc_id, size, copy ROWS UNBOUNDED PRECEDING) AS total FROM f)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN 2 * total - size <= 2 * (SELECT sum(target) FROM t) THEN size ELSE 0 END) AS BIGINT) AS taken
FROM o GROUP BY doc_id, source, size, source_size, target
"""
