"""Sources and sinks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Transform = Callable[[DataFrame], DataFrame]


def filtered(df: DataFrame, *transforms: Transform) -> DataFrame:
    """Record transforms, one after another."""
    for t in transforms:
        df = df.transform(t)
    return df


def lined_json(spark: SparkSession, path: str, schema=None, skip: int = 0) -> DataFrame:
    """JSON lines; with ``skip``, a restart after that many lines (their order is the file's)."""
    if not skip:
        return (spark.read.schema(schema) if schema else spark.read).json(path)
    lines = spark.read.text(path).withColumn("_n", F.monotonically_increasing_id())
    first = lines.orderBy("_n").limit(skip).select("_n")
    rest = lines.join(first, "_n", "left_anti").select("value")
    kind = schema or spark.read.json(path).schema
    return rest.select(F.from_json("value", kind).alias("r")).select("r.*")


def csv(spark: SparkSession, path: str, sep: str = ",", schema=None) -> DataFrame:
    """Text with a header; types are the narrowest of int, long, float and string that fit, unless given; N/A and NA are null."""
    raw = spark.read.option("header", True).option("sep", sep).csv(path) if not schema else spark.read.option("header", True).option("sep", sep).schema(schema).csv(path)
    return raw if schema else sniff(raw)


def sniff(raw: DataFrame) -> DataFrame:
    """Casts string columns to the widest type that any of their cells needs; one pass over the data."""
    clean = raw.select(*[F.when(F.trim(c).isin("N/A", "NA", ""), None).otherwise(F.trim(c)).alias(c) for c in raw.columns])
    level = lambda c: F.when(F.col(c).isNull(), 0).when(F.col(c).rlike(r"^[+-]?\d+$") & F.expr(f"try_cast(`{c}` as int) is not null"), 0).when(F.expr(f"`{c}` rlike '^[+-]?[0-9]+$' and try_cast(`{c}` as bigint) is not null"), 1).when(F.expr(f"try_cast(`{c}` as double) is not null"), 2).otherwise(3)
    found = clean.agg(*[F.max(level(c)).alias(c) for c in raw.columns], *[F.count(c).alias(f"{c}#n") for c in raw.columns]).first()
    kinds = {c: "string" if not found[f"{c}#n"] else ("int", "bigint", "double", "string")[found[c]] for c in raw.columns}
    return raw.select(*[(F.col(c) if kinds[c] == "string" else F.expr(f"try_cast(trim(`{c}`) as {kinds[c]})")).alias(c) for c in raw.columns])


def jdbc(spark: SparkSession, url: str, table: str, version: str | None = None, after=None, **options) -> DataFrame:
    """A table, or what is newer than a version; give column, lowerBound, upperBound and numPartitions to split the read."""
    query = f"(SELECT * FROM {table} WHERE {version} > {after!r}) t" if version and after is not None else table
    return spark.read.format("jdbc").options(url=url, dbtable=query, **options).load()


def in_memory(spark: SparkSession, docs: Iterable[dict], schema=None) -> DataFrame:
    """A small list of documents."""
    docs = list(docs)
    return spark.createDataFrame(docs, schema) if schema else spark.read.json(spark.createDataFrame([(json.dumps(d),) for d in docs], "value string").rdd.map(lambda r: r[0]))


def connector(spark: SparkSession, name: str, streaming: bool = False, **options) -> DataFrame:
    """Any installed connector (kafka, avro, ..); a clear error where its jar is missing."""
    try:
        reader = (spark.readStream if streaming else spark.read).format(name)
        return reader.options(**options).load()
    except Exception as e:
        if "DATA_SOURCE_NOT_FOUND" in str(e) or "Failed to find" in str(e):
            raise RuntimeError(f"The {name} connector is not on the class path") from e
        raise


def kafka_json(spark: SparkSession, servers: str, topic: str, schema: T.StructType, streaming: bool = True) -> DataFrame:
    """JSON payloads of a topic, with partition and offset as the version."""
    raw = connector(spark, "kafka", streaming, **{"kafka.bootstrap.servers": servers, "subscribe": topic})
    return decode_json(raw, schema)


def decode_json(raw: DataFrame, schema: T.StructType) -> DataFrame:
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("r"), "partition", "offset").select("r.*", "partition", "offset")


def write_segments(df: DataFrame, path: str, key: str, shards: int, sort: list[str] | None = None, exclude: list[str] | None = None, bloom: list[str] | None = None, mode: str = "overwrite") -> None:
    """Immutable segments: sharded by key, sorted inside, with bloom filters for equality on some columns."""
    from lodestone.operators.updates import shard

    out = df.drop(*(exclude or [])).withColumn("shard", shard(F.col(key), shards)).repartition(shards, "shard")
    writer = out.sortWithinPartitions("shard", *(sort or [key])).write.mode(mode).partitionBy("shard")
    for c in bloom or []:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)


try:
    from pyspark.sql.datasource import DataSource, DataSourceReader

    class PolledSource(DataSource):
        """A pull source (HTTP or queue): option ``fetch`` names a registered function page -> list of JSON texts."""

        FETCHERS: dict[str, Callable[[int], list[str]]] = {}

        @classmethod
        def name(cls) -> str:
            return "lodestone_polled"

        def schema(self) -> str:
            return "page int, value string"

        def reader(self, schema) -> DataSourceReader:
            pages, fetch = int(self.options.get("pages", 1)), self.FETCHERS[self.options["fetch"]]

            class Reader(DataSourceReader):
                def partitions(self):
                    from pyspark.sql.datasource import InputPartition

                    return [InputPartition(i) for i in range(pages)]

                def read(self, partition):
                    for v in fetch(partition.value):
                        yield (partition.value, v)

            return Reader()
except ImportError:
    PolledSource = None
