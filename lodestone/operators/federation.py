"""Several tables as one: union, priority layers, and a historical table continued by a realtime one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def layered(parts: list[DataFrame], size: int, keys: list) -> DataFrame:
    """Rows of the first layer, then of the next ones, until there are ``size``."""
    rows = union([p.withColumn("_layer", F.lit(i)) for i, p in enumerate(parts)])
    return rows.orderBy("_layer", *keys).limit(size)


def prune_layers(layers: list[tuple[int, int, DataFrame]], start: int, end: int) -> list[DataFrame]:
    """Of layers with their first and last time, those that the asked range meets."""
    return [df for low, high, df in layers if low <= end and high >= start]


def split_at_boundary(historical: DataFrame, realtime: DataFrame, time: str, boundary: int | None = None) -> DataFrame:
    """Historical rows before the boundary, realtime rows from it on; by default the historical table's last time."""
    if boundary is None:
        edge = F.broadcast(historical.agg(F.max(time).alias("_b")))  # one row
        old = historical.join(edge, F.col(time) < F.col("_b")).drop("_b")
        new = realtime.join(edge, F.col(time) >= F.coalesce("_b", F.col(time))).drop("_b")
        return old.unionByName(new, allowMissingColumns=True)
    return historical.where(F.col(time) < boundary).unionByName(realtime.where(F.col(time) >= boundary), allowMissingColumns=True)
