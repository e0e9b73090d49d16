"""Words, hashes, shared storage and connected components.

A word is a maximal run of characters other than space and U+0009..U+000D.
Those separators are exactly the ones ``bytes.split()`` knows, so all word work
is done on UTF-8 bytes.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word pattern, for Spark SQL and DuckDB alike.
WORD = r"[^\x20\x09-\x0D]+"
#: Words handled at once inside a Python worker, so that numpy arrays stay small.
CHUNK_WORDS = 400_000
#: Distinct words that a worker's memo may hold before it starts afresh.
MEMO_WORDS = 250_000

_MIX_A, _MIX_B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters the bits of each 64-bit value (a bijection)."""
    x = (x ^ (x >> _S33)) * _MIX_A
    x = (x ^ (x >> _S33)) * _MIX_B
    return x ^ (x >> _S33)


class WordHashes(dict):
    """word -> 64-bit hash; kept between batches, emptied when it is large."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, tokens: list[bytes]) -> np.ndarray:
        if len(self) > MEMO_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


#: One memo for each Python worker.
HASHES = WordHashes()
#: All memos of this package's modules.
MEMOS: list[dict] = [HASHES]


def using(*memos: dict) -> None:
    """Empties the other memos: a worker goes on to other operators' tasks, and needs one operator's memory only."""
    others = [memo for memo in MEMOS if memo and not any(memo is m for m in memos)]
    for memo in others:
        memo.clear()
    if others:
        release()


@cache
def _trim() -> Callable[[int], int]:
    """The C library's malloc_trim; nothing where there is none."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda keep: 0)


def release() -> None:
    """Gives memory that is free back to the system: Arrow's pool and the C library keep what was freed, also in a worker that only waits."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def tidy(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """A worker's function that gives free memory back when its task ends."""

    @wraps(run)
    def tidied(batches: Iterable) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


@cache
def one_thread() -> bool:
    """Keeps this process's matrix products to one thread: a task has one core.  Whether a library was found that can be told so."""
    try:
        with open("/proc/self/maps") as f:
            paths = {line.split(maxsplit=5)[5].strip() for line in f if "openblas" in line}
        for path in paths:
            for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
                if hasattr(lib := ctypes.CDLL(path), name):
                    getattr(lib, name)(ctypes.c_int(1))
                    return True
    except OSError:
        pass
    return False


def windows(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hashes of all k consecutive values: a polynomial in an odd base modulo 2^64, by doubling."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, have, power = None, 0, h
    span, b = 1, np.uint64(base | 1)
    factor = b
    while True:  # power: hashes of `span` values; out: hashes of the `have` values before them
        if k & span:
            out = power if out is None else out[: len(out) - span] * factor + power[have : have + len(out) - span]
            have += span
        if span * 2 > k:
            break
        power = power[: len(power) - span] * factor + power[span:]
        with np.errstate(over="ignore"):
            factor = factor * factor
        span *= 2
    return mix(out[:n])


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_WORDS * 6) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` characters each; one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL: list[str] = []


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder that all executors share.

    It is ``spark.checkpoint.dir`` of the session.  Where that is unset, a
    single-process session (tests) takes a temporary folder and a cluster a
    folder in its warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            if not _LOCAL:
                _LOCAL.append(tempfile.mkdtemp(prefix="lodestone-"))
                atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
            base = f"file://{_LOCAL[0]}"
        else:
            base = spark.conf.get("spark.sql.warehouse.dir") + "/_lodestone"
    return f"{base}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: lineage ends here, whichever executor is lost."""
    path = shared_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the links; root is the smallest node it is connected with.

    Alternates taking the smallest neighbour's root with pointer jumping until
    nothing changes; all of it in tables, none of it on the driver.
    """
    edges = stored(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    roots = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")), "roots")
    while True:
        near = both.join(roots.withColumnsRenamed({"node": "v", "root": "r"}), "v").groupBy("u").agg(F.min("r").alias("r"))
        nxt = roots.join(near, F.col("node") == F.col("u")).select("node", "root", F.least("root", "r").alias("low"))
        # hooking: what one member of a tree has learnt holds for its root, and so for all of its members
        hook = nxt.groupBy("root").agg(F.min("low").alias("best"))
        nxt = stored(nxt.join(hook, "root").select("node", F.least("low", "best").alias("root"), F.col("root").alias("was")), "roots")
        jump = nxt.select(F.col("node").alias("root"), F.col("root").alias("up"))
        roots = stored(nxt.select("node", "root").join(jump, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
        if nxt.where("root <> was").isEmpty():
            return roots
