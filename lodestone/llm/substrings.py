"""Substring dedup on a log-structured fingerprint index.

A window is ``LENGTH`` consecutive words.  Each window has an anchor: of the
26 runs of 25 words inside it the one with the smallest hash (the first of
equals).  Neighbouring windows share anchors, so a document has about one anchor
for every 13 windows, and equal windows have equal anchors at equal places.  The
span of an anchor is all words of the windows that have it.

The index keeps, for each (anchor hash, span hash), the smallest doc_id it was
seen in.  It is log-structured: ``add`` merge-joins a batch with the sorted
immutable runs, writes what is new as one more sorted run (a table bucketed and
sorted by anchor hash), and merges runs of one level into one of the next.

Matching verifies: equal spans are the same words throughout.  Where an anchor
has several spans, the windows of each span's first document are hashed and
compared one by one; so results are exact for windows, not for anchors.

``dedup`` builds an index for one table and drops it.  ``dedup_batch`` takes one
that is kept in a folder between sessions, judges a batch by it, and adds the
batch.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import HASHES, chunks, mix, stored, windows, words

LENGTH, INNER = 50, 25
_BASE = 0x9E3779B97F4A7C15
BATCHES, RUNS_A_LEVEL = 4, 2


def _positions(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, windows) of each anchor of a document's word hashes, in order."""
    n = len(h) - LENGTH + 1
    if n <= 0:
        e = np.empty(0, np.int64)
        return e.astype(np.uint64), e, e
    inner = windows(h, INNER, _BASE)
    least = np.lib.stride_tricks.sliding_window_view(inner, LENGTH - INNER + 1)
    at = least.argmin(axis=1) + np.arange(n)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return inner[at[first]], first, np.diff(np.r_[first, n])


def _span_hashes(h: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Hash of words [start, start + count + LENGTH - 1) of each anchor, its length included."""
    size = count + LENGTH - 1
    powers = np.cumprod(np.full(len(h) + 1, np.uint64(0xD1342543DE82EF95)), dtype=np.uint64)
    sums = np.r_[np.uint64(0), np.cumsum(mix(h) * powers[:-1], dtype=np.uint64)]
    # a span's sum times a power that only depends on where it ends
    value = (sums[start + size] - sums[start]) * powers[len(h) - start]
    return mix(value + size.astype(np.uint64))


def _digest(tokens: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(tokens)).hexdigest()


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document: its words, its digest and its anchors."""
    for batch in chunks(batches):
        n, sha, hs, cs, starts, counts = [], [], [], [], [], []
        token_lists = [words(t) for t in batch.column("text").to_pylist()]
        flat = HASHES.of([w for t in token_lists for w in t])
        at = 0
        for t in token_lists:
            h = flat[at : at + len(t)]
            at += len(t)
            a, s, k = _positions(h)
            n.append(len(t)), sha.append(_digest(t))
            hs.append(a.astype(np.int64)), cs.append(_span_hashes(h, s, k).astype(np.int64) if len(s) else s), starts.append(s), counts.append(k)
        lists = [pa.ListArray.from_arrays(np.cumsum([0, *map(len, x)]).astype(np.int32), pa.array(np.concatenate(x) if x else [], t)) for x, t in ((hs, pa.int64()), (cs, pa.int64()), (starts, pa.int32()), (counts, pa.int32()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("rid"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), *lists], ["doc", "rid", "n_words", "sha", "h", "c", "s", "k"])


_SCAN = "doc long, rid long, n_words long, sha string, h array<long>, c array<long>, s array<int>, k array<int>"


def anchors(scanned: DataFrame) -> DataFrame:
    """(doc, rid, h, c, s, k) for each anchor; documents without an id have no order and stay out."""
    return scanned.where("doc is not null and n_words >= 50").select("doc", "rid", F.explode(F.arrays_zip("h", "c", "s", "k")).alias("a")).select("doc", "rid", "a.*")


class FingerprintIndex:
    """Sorted runs (h, c, doc) in the session's warehouse; of each (h, c) the smallest doc of those added first.

    With ``folder`` the runs are kept there (a path all executors share) and are
    found again by the next index of that folder.  A run counts once it is whole;
    merged runs go after the run that replaces them, and what is there twice in
    between changes nothing.  One index at a time may add to a folder.
    """

    def __init__(self, spark, name: str | None = None, folder: str | None = None):
        self.spark, self.name, self.folder, self.runs = spark, name or f"lodestone_fp_{uuid.uuid4().hex}", folder, []
        self._made, self.buckets, self._places = 0, int(spark.conf.get("spark.sql.shuffle.partitions")), {}
        if folder:
            self._open()

    def _path(self, place: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _open(self) -> None:
        path, fs = self._path(self.folder)
        names = sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []
        for name in names:
            if not (m := re.fullmatch(r"run-(\d+)-(\d+)-(\d+)", name)):
                continue
            made, level, buckets = map(int, m.groups())
            self._made = made + 1
            if not fs.exists(self._path(f"{self.folder}/{name}/_SUCCESS")[0]):  # its writer was lost
                continue
            table, place = f"{self.name}_{made}", f"{self.folder}/{name}"
            self.spark.sql(f"CREATE TABLE {table} (h BIGINT, c BIGINT, doc BIGINT) USING parquet CLUSTERED BY (h) SORTED BY (h, c) INTO {buckets} BUCKETS LOCATION '{place}'")
            self.runs.append((level, table))
            self._places[table], self.buckets = place, buckets

    def _write(self, rows: DataFrame, level: int) -> None:
        table = f"{self.name}_{self._made}"
        out = rows.repartition(self.buckets, "h").write.option("compression", "zstd").bucketBy(self.buckets, "h").sortBy("h", "c")
        if self.folder:
            self._places[table] = f"{self.folder}/run-{self._made:06}-{level}-{self.buckets}"
            out = out.option("path", self._places[table])
        self._made += 1
        out.saveAsTable(table)
        self.runs.append((level, table))

    def _discard(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        if place := self._places.pop(table, None):
            path, fs = self._path(place)
            fs.delete(path, True)

    def meeting(self, keys: DataFrame) -> DataFrame | None:
        """(h, c, doc) of the entries whose anchor hash is among ``keys`` (h): a merge join with each run, which stays where it lies."""
        out = None
        for _, table in self.runs:
            run = self.spark.table(table).join(keys, "h", "left_semi")
            out = run if out is None else out.unionByName(run)
        return None if out is None else out.groupBy("h", "c").agg(F.min("doc").alias("doc"))

    def entries(self) -> DataFrame | None:
        out = None
        for _, table in self.runs:
            run = self.spark.table(table)
            out = run if out is None else out.unionByName(run)
        return out

    def add(self, batch: DataFrame) -> None:
        """batch: (h, c, doc); batches come in ascending order of doc."""
        new = batch.groupBy("h", "c").agg(F.min("doc").alias("doc"))
        for _, table in self.runs:
            new = new.join(self.spark.table(table).select("h", "c"), ["h", "c"], "left_anti")
        self._write(new, 0)
        self.compact()

    def compact(self, whole: bool = False) -> None:
        """Merges runs of a level, or all."""
        while len(self.runs) > 1:
            level = self.runs[-1][0]
            same = [t for x, t in self.runs if whole or x == level]
            if len(same) < RUNS_A_LEVEL:
                break
            merged = None
            for t in same:
                run = self.spark.table(t)
                merged = run if merged is None else merged.unionByName(run)
            self.runs = [r for r in self.runs if r[1] not in same]
            self._write(merged.groupBy("h", "c").agg(F.min("doc").alias("doc")), level + 1)
            for t in same:
                self._discard(t)

    def drop(self) -> None:
        for _, t in self.runs:
            self._discard(t)
        self.runs = []


def _windows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, w, doc, rid, s) for each window of the anchors listed in ``look``."""
    for batch in chunks(batches):
        hs, ws, docs, rids, ss = [], [], [], [], []
        for doc, rid, text, look in zip(*(batch.column(c).to_pylist() for c in ("doc", "rid", "text", "look"))):
            if not look:
                continue
            w = windows(HASHES.of(words(text)), LENGTH, 0xA0761D6478BD642F)
            start, k, h = (np.array([x[f] for x in look], np.int64) for f in ("s", "k", "h"))
            at = np.repeat(start, k) + np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            hs.append(np.repeat(h, k)), ws.append(w[at].astype(np.int64)), ss.append(at)
            docs.append(np.full(len(at), doc, np.int64)), rids.append(np.full(len(at), rid, np.int64))
        if ss:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hs, ws, docs, rids, ss)], ["h", "w", "doc", "rid", "s"])


def _remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the words of all spans [s, s + k + LENGTH - 1) out of each text."""
    for batch in chunks(batches):
        n, gone, kept = [], [], []
        for text, *lists in zip(*(batch.column(c).to_pylist() for c in ("text", "full", "part"))):
            t = words(text)
            edge = np.zeros(len(t) + 1, np.int64)
            for x in (y for z in lists for y in z or ()):
                edge[x["s"]] += 1
                edge[x["s"] + x["k"] + LENGTH - 1] -= 1
            stay = np.cumsum(edge[:-1]) == 0
            left = [w for w, keep in zip(t, stay.tolist()) if keep]
            n.append(len(t)), gone.append(len(t) - len(left)), kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc", "n_words", "n_removed", "kept"])


def dedup(docs: DataFrame, key: str = "doc_id", batches: int = BATCHES) -> tuple[DataFrame, DataFrame]:
    """Removes each word that stands in a window which also starts in a row with a smaller key.

    Returns (doc, n_words, sha256 of the words) of the rows that lose nothing,
    and (doc, n_words, n_removed, kept text) of the others.  Texts that are null
    or shorter than a window lose nothing, nor do rows without a key; rows that
    share a key don't count as each other's history.
    """
    spark = docs.sparkSession
    rows = _keyed(docs, key)
    scanned = stored(rows.mapInArrow(_scan, _SCAN), "anchors")
    all_anchors = anchors(scanned)
    low, high = scanned.agg(F.min("doc"), F.max("doc")).first()
    index = FingerprintIndex(spark)
    if low is not None:
        step = max(1, -(-(high - low + 1) // batches))
        for start in range(low, high + 1, step):
            index.add(all_anchors.where(F.col("doc").between(start, start + step - 1)).select("h", "c", "doc"))
        index.compact(whole=True)
        texts = _matched(rows, all_anchors, spark.table(index.runs[0][1]), f"{index.name}_texts")
        index.drop()
        cut, gone = _cut(texts)
        whole = scanned.select("doc", "rid", "n_words", "sha").join(gone, ["doc", "rid"], "left_anti")
    else:
        cut = spark.createDataFrame([], "doc long, n_words long, n_removed long, kept string")
        whole = scanned
    return whole.select("doc", "n_words", "sha"), cut


def _keyed(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64("text").alias("rid"), "text")


def _spans(run: DataFrame) -> DataFrame:
    """(h, c, first document, how many spans the anchor hash has)."""
    spans = run.groupBy("h").agg(F.count("*").alias("spans")).where("spans > 1")
    return run.join(spans, "h", "left").select("h", "c", F.col("doc").alias("first"), F.coalesce("spans", F.lit(1)).alias("spans"))


def _matched(rows: DataFrame, all_anchors: DataFrame, run: DataFrame, name: str) -> DataFrame:
    """The texts that have spans of earlier ones (``full``) or spans to be compared window by window (``look``)."""
    spark = rows.sparkSession
    found = all_anchors.join(_spans(run), ["h", "c"]).where("first < doc or spans > 1")
    one = F.struct("h", "s", "k")
    found = found.groupBy("doc", "rid").agg(F.collect_set(F.when(F.col("first") < F.col("doc"), F.struct("s", "k"))).alias("full"), F.collect_set(F.when(F.col("first") == F.col("doc"), one)).alias("look"))
    # kept by document so that the last step needs no exchange
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.where("doc is not null").join(found, ["doc", "rid"]).repartition(parts, "doc").write.option("compression", "zstd").bucketBy(parts, "doc").saveAsTable(name)
    return spark.table(name)


def _cut(texts: DataFrame, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc, n_words, n_removed, kept) of the texts that lose words, and their (doc, rid); ``only``: of these (doc, rid)."""
    shown = stored(texts.where(F.size("look") > 0).select("doc", "rid", "text", "look").mapInArrow(_windows_of, "h long, w long, doc long, rid long, s long"), "windows")
    first = shown.groupBy("h", "w").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last")
    part = shown.join(first, ["h", "w"]).where("first < doc").groupBy("doc", "rid").agg(F.collect_set(F.struct(F.col("s"), F.lit(1).alias("k"))).alias("part"))
    both = texts.select("doc", "rid", "text", "full").join(part, ["doc", "rid"], "left").where("size(full) > 0 or part is not null")
    if only is not None:
        both = both.join(only, ["doc", "rid"], "left_semi")
    cut = both.select("doc", "text", "full", "part").mapInArrow(_remove, "doc long, n_words long, n_removed long, kept string")
    return cut, both.select("doc", "rid").distinct()


def dedup_batch(batch: DataFrame, index: FingerprintIndex, history: DataFrame | None = None, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """As ``dedup`` for a batch of new documents after those in the index, which then takes the batch in.

    history: the documents that the index has seen (key, text); of them only
    those are read whose spans differ from the batch's under a common anchor.
    Batches of ascending keys give what ``dedup`` gives for all of them at once.
    A batch that is judged again finds itself in the index, and the same result.
    """
    spark = batch.sparkSession
    rows = _keyed(batch, key)
    scanned = stored(rows.mapInArrow(_scan, _SCAN), "anchors")
    new = anchors(scanned)
    run = new.groupBy("h", "c").agg(F.min("doc").alias("doc"))
    all_anchors, met = new, index.meeting(new.select("h").distinct())
    if met is not None:
        met = stored(met, "met")
        run = stored(run.unionByName(met).groupBy("h", "c").agg(F.min("doc").alias("doc")), "met")
        if history is not None:
            look = _spans(run).where("spans > 1").select("h", "c", F.col("first").alias("doc")).join(met, ["h", "c", "doc"], "left_semi")
            past = _keyed(history, key).join(look.select("doc").distinct(), "doc", "left_semi").join(scanned.select("doc", "rid"), ["doc", "rid"], "left_anti")
            past = stored(past, "past")
            all_anchors = new.unionByName(anchors(past.mapInArrow(_scan, _SCAN)).join(look, ["h", "c", "doc"], "left_semi").select(*new.columns))
            rows = rows.unionByName(past)
    texts = _matched(rows, all_anchors, run, f"lodestone_fp_{uuid.uuid4().hex}_texts")
    cut, gone = _cut(texts, scanned.select("doc", "rid"))
    index.add(new.select("h", "c", "doc"))
    return scanned.select("doc", "rid", "n_words", "sha").join(gone, ["doc", "rid"], "left_anti").select("doc", "n_words", "sha"), cut


def dedup_digest(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) for every row."""
    return digest_of(*dedup(docs, key), key)


def digest_of(whole: DataFrame, cut: DataFrame, key: str = "doc_id") -> DataFrame:
    whole = whole.select(F.col("doc").alias(key), "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"))
    return whole.unionByName(cut.select(F.col("doc").alias(key), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")))


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT rid, doc_id, w, unnest(generate_series(1, greatest(len(w) - 49, 0))) AS i FROM d),
x AS (SELECT rid, doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM p),
f AS (SELECT k, min(doc_id) AS first FROM x GROUP BY k),
r AS (SELECT DISTINCT rid, unnest(generate_series(i, i + 49)) AS j FROM x JOIN f USING (k) WHERE first < doc_id),
e AS (SELECT rid, unnest(w) AS word, unnest(generate_series(1, len(w))) AS j FROM d),
k AS (SELECT rid, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n FROM e ANTI JOIN r USING (rid, j) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""
