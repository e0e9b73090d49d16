"""Mutable data in batch form: last write wins, partial updates, counters, trailing windows, retention, shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.times import period_minutes


def kind_of(df: DataFrame, type_col: str | None = "type", delete_field: str | None = None, skip_field: str | None = None) -> Column:
    """add, update, delete or skip: by the type column, else by boolean delete and skip fields, else add."""
    other = F.lit("add")
    if delete_field:
        other = F.when(F.coalesce(F.col(delete_field).cast("boolean"), F.lit(False)), "delete").otherwise(other)
    if skip_field:
        other = F.when(F.coalesce(F.col(skip_field).cast("boolean"), F.lit(False)), "skip").otherwise(other)
    return F.coalesce(F.lower(type_col), other) if type_col and type_col in df.columns else other


def last_write_wins(events: DataFrame, uid: str, version: str, kind: Column) -> DataFrame:
    """The row of each uid's latest event by version, unless it deletes; skipped events count for nothing."""
    rows = events.withColumn("_kind", kind).where("_kind <> 'skip'")
    last = rows.groupBy(uid).agg(F.max_by(F.struct(*rows.columns), version).alias("e")).select("e.*")
    return last.where("_kind <> 'delete'").drop("_kind")


def partial_update(base: DataFrame, changes: DataFrame, uid: str, version: str | None = None) -> DataFrame:
    """Overwrites the fields that changes have (later versions over earlier ones); changes without a base row are dropped."""
    fields = [c for c in changes.columns if c not in (uid, version)]
    last = changes.groupBy(uid).agg(*[(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(version))) if version else F.first(c, ignorenulls=True)).alias(f"_new_{c}") for c in fields])
    out = base.join(last, uid, "left")
    return out.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in base.columns])


def fold_counter(events: DataFrame, uid: str, version: str, delta: str, name: str = "value") -> DataFrame:
    """A counter for each uid: deltas are "+n" or "-n", anything else sets it; the sum after the last setting holds."""
    signed = F.col(delta).cast("string").rlike(r"^\s*[+-]")
    rows = events.select(uid, version, F.col(delta).cast("double").alias("d"), signed.alias("rel"))
    last = rows.groupBy(uid).agg(F.max(F.when(~F.col("rel"), F.col(version))).alias("set_at"))
    live = rows.join(last, uid).where(F.col("set_at").isNull() | (F.col(version) >= F.col("set_at")))
    return live.groupBy(uid).agg(F.sum("d").alias(name))


def reject_stale(events: DataFrame, uid: str, version: str, arrival: str) -> DataFrame:
    """Events whose version is not below one that arrived before for the same uid."""
    before = F.max(version).over(Window.partitionBy(uid).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("_seen", before).where(F.col("_seen").isNull() | (F.col(version) >= F.col("_seen"))).drop("_seen")


def trailing(events: DataFrame, uid: str, minute: str, delta: str, periods: list[str], now_minute: int) -> DataFrame:
    """(uid, total, one column for each period): an event is inside period p while fewer than p minutes have passed."""
    age = F.lit(now_minute) - F.col(minute)
    each = [F.sum(F.when((age >= 0) & (age < period_minutes(p)), F.col(delta)).otherwise(0)).alias(f"last_{p}") for p in periods]
    return events.groupBy(uid).agg(F.sum(delta).alias("total"), *each)


def trailing_running(events: DataFrame, uid: str, minute: str, delta: str, period: str) -> DataFrame:
    """The same as of each event's minute."""
    w = Window.partitionBy(uid).orderBy(minute).rangeBetween(-(period_minutes(period) - 1), 0)
    return events.withColumn(f"last_{period}", F.sum(delta).over(w))


def with_activity(docs: DataFrame, state: DataFrame, uid: str) -> DataFrame:
    """Documents with their counters; no activity is null."""
    return docs.join(state, uid, "left")


def purge(state: DataFrame, docs: DataFrame, uid: str) -> DataFrame:
    return state.join(docs.select(uid).distinct(), uid, "left_semi")


def retain(df: DataFrame, column: str, days: int, now_ms: int) -> DataFrame:
    return df.where(F.col(column) >= now_ms - days * 86_400_000)


def hourglass(df: DataFrame, ts: str, unit: str, keep: int | None = None) -> DataFrame:
    """Rows with the start of their slice (minute, hour, day); with ``keep``, only of that many latest slices."""
    out = df.withColumn("slice", F.date_trunc(unit, ts))
    if keep is None:
        return out
    slices = out.select("slice").distinct().orderBy(F.desc("slice")).limit(keep)
    return out.join(F.broadcast(slices), "slice", "left_semi")  # at most ``keep`` rows


def shard(col: Column, n: int) -> Column:
    """abs(key) mod n; null goes to 0.  The remainder loses its sign, not the key, so the least long is as good as any."""
    return F.coalesce(F.abs(col.cast("long") % F.lit(n)), F.lit(0)).cast("int")


def in_partitions(df: DataFrame, uid: str, n: int, ids: list[int]) -> DataFrame:
    return df.where(shard(F.col(uid), n).isin(ids))
