"""Streaming forms of the updates; each equals its batch form on a finished stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def keep_latest(stream: DataFrame, uid: str, version: str, value: str) -> DataFrame:
    """(uid, version, value): a new row whenever a newer version of a uid comes; older ones are rejected."""
    kinds = dict(stream.dtypes)
    schema = f"{uid} {kinds[uid]}, {version} {kinds[version]}, {value} {kinds[value]}"

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        changed = False
        for pdf in batches:
            row = pdf.loc[pdf[version].idxmax()]
            if best is None or row[version] > best[0]:
                best, changed = (row[version].item() if hasattr(row[version], "item") else row[version], row[value].item() if hasattr(row[value], "item") else row[value]), True
        if changed:
            state.update(best)
            yield pd.DataFrame({uid: [key[0]], version: [best[0]], value: [best[1]]})

    return stream.select(uid, version, value).groupBy(uid).applyInPandasWithState(fold, schema, f"{version} {kinds[version]}, {value} {kinds[value]}", "update", GroupStateTimeout.NoTimeout)


def upserts(stream: DataFrame, uid: str, version: str, kind: str = "type") -> DataFrame:
    """The current row of each key a batch changed: add replaces, update overwrites what is not null, delete removes.

    ``kind`` names the column with add, update, delete or skip (null: add).  Events
    apply by version; one at or below its key's version is stale and counts for
    nothing, also after a delete.  An update of a key without a row is dropped.
    Rows have all columns but ``kind``, and ``_deleted``; run in update mode.
    State is one row a key, on disk with the RocksDB provider.
    """
    fields = [c for c in stream.columns if c not in (uid, version, kind)]
    types = dict(stream.dtypes)
    names = [version, *fields, "_deleted"]
    kept = ", ".join(f"`{c}` {types.get(c, 'boolean')}" for c in names)

    def plain(x):
        if x is None or (not hasattr(x, "__len__") and pd.isna(x)):
            return None
        return x.item() if hasattr(x, "item") and getattr(x, "size", 1) == 1 else x

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = dict(zip(names, state.get)) if state.exists else None
        changed = False
        events = [dict(zip(pdf.columns, row)) for pdf in batches for row in pdf.itertuples(index=False, name=None)]
        for e in sorted(events, key=lambda e: e[version]):
            what = (plain(e[kind]) or "add").lower()
            if what == "skip" or (now is not None and e[version] <= now[version]):
                continue
            gone = now is None or now["_deleted"]
            if what == "update" and gone or what == "delete" and now is None:
                continue
            new = {c: plain(e[c]) for c in fields}
            if what == "update":
                new = {c: now[c] if v is None else v for c, v in new.items()}
            if what == "delete":
                new = dict.fromkeys(fields)
            now, changed = {version: plain(e[version]), **new, "_deleted": what == "delete"}, True
        if changed:
            state.update(tuple(now[c] for c in names))
            yield pd.DataFrame({uid: [key[0]], **{c: pd.Series([now[c]], dtype="object") for c in names}})

    rows = stream.where(F.col(uid).isNotNull() & F.col(version).isNotNull())
    return rows.groupBy(uid).applyInPandasWithState(fold, f"`{uid}` {types[uid]}, {kept}", kept, "update", GroupStateTimeout.NoTimeout)


def counters(stream: DataFrame, uid: str, delta: str) -> DataFrame:
    """(uid, total) of relative deltas; run in complete or update mode."""
    return stream.groupBy(uid).agg(F.sum(delta).alias("total"))


def rolled(stream: DataFrame, ts: str, unit: str, late: str, *by: str) -> DataFrame:
    """Tumbling counts by slice, with a watermark for late events."""
    t = F.col(ts).cast("timestamp")
    return stream.withColumn("_t", t).withWatermark("_t", late).groupBy(F.window("_t", unit), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("slice"), *by, "n")


def merge_into(path: str, uid: str, version: str, kind: Callable[[DataFrame], object] | None = None):
    """A foreachBatch sink: each batch is appended as its own immutable part; ``read_merged`` gives the latest rows."""

    def write(batch: DataFrame, epoch: int) -> None:
        out = batch if kind is None else batch.withColumn("_kind", kind(batch))
        out.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")  # a repeated epoch replaces itself

    return write


def read_merged(spark, path: str, uid: str, version: str) -> DataFrame:
    from lodestone.operators.updates import last_write_wins

    rows = spark.read.parquet(path)
    kind = F.col("_kind") if "_kind" in rows.columns else F.lit("add")
    return last_write_wins(rows.drop("epoch"), uid, version, kind)


def compact(spark, path: str, to: str, uid: str, version: str, sort: list[str]) -> None:
    """The appended parts as one sorted immutable segment."""
    read_merged(spark, path, uid, version).sort(*sort).write.mode("overwrite").parquet(to)


def roll_at(path: str, segments: str, uid: str, version: str, capacity: int, sort: list[str]):
    """A foreachBatch sink as ``merge_into``; at ``capacity`` appended rows they become one more sorted segment.

    A segment is named after the last batch in it and is whole before the parts
    go, so a repeated batch or a lost driver can leave parts beside their
    segment, never neither.  ``read_rolled`` is right in both cases.
    """
    append = merge_into(path, uid, version)

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        append(batch, epoch)
        rows = spark.read.parquet(path)
        if rows.count() < capacity:  # from the files' footers
            return
        rows.drop("epoch").sort(*sort).write.mode("overwrite").parquet(f"{segments}/segment={epoch}")
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    return write


def read_rolled(spark, path: str, segments: str, uid: str, version: str) -> DataFrame:
    """The latest row of each key over the sorted segments and the parts that are still appended to."""
    from pyspark.errors import AnalysisException

    from lodestone.operators.updates import last_write_wins

    out = None
    for place in (segments, path):
        try:
            part = spark.read.parquet(place).drop("segment", "epoch")
        except AnalysisException:  # nothing there yet
            continue
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return last_write_wins(out, uid, version, F.lit("add"))


def run_once(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs what is available into an in-memory table (for tests and small results)."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
