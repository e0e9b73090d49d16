"""N-gram Jaccard join: a blocked sparse product of the document by shingle incidence with itself.

Documents with equal shingle sets are one class; the product is over classes.
Two sets that reach the threshold share at least r of the first n - ceil(t n) + r
shingles of each in one common order of all shingles, r being ``RESERVE`` percent
of the smaller.  The order puts shingles that many classes have last, so a common
passage seldom stands in a prefix; it decides how much is compared, never what
is found.

1. Columns (shingles) are dealt to blocks by hash; a block holds the prefix
   entries of all classes as packed arrays.  The classes of a column whose sizes
   fit one another are put in the family of one of them, the pivot: the class
   with the largest share of common shingles, as an original has among its
   edited copies.  Classes that can be linked share a column, so a family; a
   class with fewer columns of this kind than its size demands has no link.  Since
   linked classes share r columns, each may leave the families in which it has
   fewest columns, up to half of r in all: chance passages go.
2. Families that hang together are one, as long as that has at most ``CELL``
   classes and ``ENTRIES`` shingles.  The others are dealt by hash to parts of
   that size, each with the pivot.
3. Of each part the overlap counts of all pairs are accumulated over whole sets,
   column by column (rare columns pair by pair, others as a matrix product),
   and pairs below the bound of their sizes go.  A part returns its components
   as stars, so never more rows than it has classes.
4. Where a family has several parts, its classes are dealt anew by what they are
   linked with already, and all pairs of these parts that are not parts of one
   component are multiplied likewise.

So every pair that reaches the threshold is counted in some part, and none is
written but for a star.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import CHUNK_WORDS, chunks, components, mix, one_thread, stored, tidy, using, windows

SHINGLE = 5
PERCENT = 75
_BASE = 0xC2B2AE3D27D4EB4F
KEY = 10  # bytes of a class key
FLUSH = 4 * CHUNK_WORDS  # shingles that a task gathers before it emits blocks
BLOCK = 4_000_000  # prefix entries in a block, on average; a class has a row for each family of each block
CELL, ENTRIES = 2_000, 4_000_000  # classes and shingles of a part, on average
PEELS = 2
RESERVE = 12  # percent of a set that its prefix holds beyond the least
DENSE = 12  # a column that more than one in so many classes of a part have goes into the matrix product
LOCAL_HOT, HOT, HOT_LEAST = 4, 16, 200_000
BROADCAST_ROWS = 200_000


def _sets(batch: pa.RecordBatch, k: int = SHINGLE) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of all k-word shingles; of fewer words, of the whole sequence."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(batch.column("text"), "")))  # A-Z only; words are no Python objects
    coded = split.flatten().dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_pylist()
    index, stops = coded.indices.to_numpy(), split.offsets.to_numpy()
    there = np.fromiter(map(bool, distinct), bool, len(distinct))[index]  # white space at a text's ends leaves empty words
    flat = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))[index[there]]
    sizes = np.diff(np.r_[0, np.cumsum(there)][stops - stops[0]])
    rolled = windows(flat, k, _BASE)
    out, at = [], 0
    for n in sizes.tolist():
        if n >= k:
            s = np.sort(rolled[at : at + n - k + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        else:
            out.append(mix(windows(flat[at : at + n], n, _BASE) + np.uint64(n)) if n else np.empty(0, np.uint64))
        at += n
    return out


def _key(shingles: np.ndarray) -> bytes:
    return blake2b(shingles.tobytes(), digest_size=KEY).digest()


def prefix_size(n: int, percent: int = PERCENT) -> int:
    """How many of n shingles, in the common order, stand in the prefix."""
    return (100 - percent) * n // 100 + max(1, RESERVE * n // 100)


def least_shared(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """How many entries the prefixes of a set of n and of a partner, perhaps a smaller one, share at least."""
    return np.maximum(1, RESERVE * -(-percent * n // 100) // 100)


@tidy
def _classes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, rid, n, key) of each document, and rows of shingles that several classes of a task have."""
    seen: set[bytes] = set()
    waiting: list[np.ndarray] = []
    using()

    def hot(kind: pa.DataType) -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(waiting), return_counts=True)
        h, c = h[c >= LOCAL_HOT].astype(np.int64), c[c >= LOCAL_HOT].astype(np.int64)
        waiting.clear()
        nulls = [pa.nulls(1, t) for t in (kind, pa.int64(), pa.int64(), pa.binary())]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in (h, c)]
        return pa.RecordBatch.from_arrays([*nulls, *lists], ["doc", "rid", "n", "key", "h", "c"])

    kind = pa.int64()
    for batch in chunks(batches):
        kind = batch.schema.field("doc").type
        sets = _sets(batch)
        keys = [_key(s) for s in sets]
        for s, k in zip(sets, keys):
            if k not in seen:
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(k)
                waiting.append(s)
        n = batch.num_rows
        empty = [pa.nulls(n, pa.list_(pa.int64()))] * 2
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("rid"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), *empty], ["doc", "rid", "n", "key", "h", "c"])
        if sum(map(len, waiting)) > FLUSH:
            yield hot(kind)
    if waiting:
        yield hot(kind)


_POSTED = "block int, keys binary, sizes binary, scores binary, counts binary, hs binary"


def _poster(hot, blocks: int, percent: int):
    """Prefix entries by block: class keys, sizes, numbers of common shingles, entries of each class, and 32 bits of each entry's hash."""

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = hot.value  # sorted hashes and their ranks by frequency
        seen: set[bytes] = set()
        keys, sizes, scores, parts = [], [], [], []
        using()

        def flush() -> pa.RecordBatch:
            h = np.concatenate(parts)
            owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            block = ((h >> np.uint64(33)) % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            h, owner, block = h[order], owner[order], block[order]
            edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            size, score = np.array(sizes, np.uint32), np.array(scores, np.uint32)
            table = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, KEY)
            out: list[list] = [[] for _ in range(6)]
            for a, b in zip(edges, np.r_[edges[1:], len(h)]):
                who, counts = np.unique(owner[a:b], return_counts=True)
                for col, v in zip(out, (int(block[a]), table[who].tobytes(), size[who].tobytes(), score[who].tobytes(), counts.astype(np.uint32).tobytes(), h[a:b].astype(np.uint32).tobytes())):
                    col.append(v)
            keys.clear(), sizes.clear(), scores.clear(), parts.clear()
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], ["block", "keys", "sizes", "scores", "counts", "hs"])

        for batch in chunks(batches):
            for s in _sets(batch):
                if not len(s) or (k := _key(s)) in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(k)
                rank, common_ones = s >> np.uint64(1), 0
                if len(common[0]):
                    at = np.minimum(np.searchsorted(common[0], s), len(common[0]) - 1)
                    is_common = common[0][at] == s
                    rank, common_ones = np.where(is_common, np.uint64(1 << 63) + common[1][at], rank), int(is_common.sum())
                keys.append(k), sizes.append(len(s)), scores.append(common_ones)
                parts.append(s[np.argsort(rank, kind="stable")[: prefix_size(len(s), percent)]])
            if sum(map(len, parts)) > FLUSH // 3:
                yield flush()
        if parts:
            yield flush()

    return run


_MEMBERS = pa.schema([("pivot", pa.binary()), ("key", pa.binary()), ("n", pa.int64()), ("least", pa.int64()), ("shared", pa.int64())])


def _familiar(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """(pivot, key, n, least, shared): the families of the block's classes, and in how many entries.

        Different shingles with the same 32 bits make one column, which only
        makes families and counts larger.
        """
        read = lambda c, t: np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table.column(c)])
        keys, first, of = np.unique(np.array([bytes(k) + b"\1" for k in read("keys", f"V{KEY}").tolist()]), return_index=True, return_inverse=True)  # numpy drops trailing zeros
        sizes, scores = read("sizes", np.uint32)[first].astype(np.int64), read("scores", np.uint32)[first].astype(np.int64)
        order = np.argsort(sizes, kind="stable")  # classes by size from here on
        keys, sizes, scores = keys[order], sizes[order], scores[order]
        place = np.empty(len(order), np.uint64)
        place[order] = np.arange(len(order))
        # several tasks may have posted a class; a shingle's rows of one class are one entry
        entry = read("hs", np.uint32).astype(np.uint64) << np.uint64(32)
        entry |= np.repeat(place[of], read("counts", np.uint32))
        entry.sort()
        edge = np.flatnonzero(np.r_[True, entry[1:] != entry[:-1]])
        many = np.diff(np.r_[edge, len(entry)]).astype(np.int32)
        entry = entry[edge]
        h, cls = (entry >> np.uint64(32)).astype(np.uint32), (entry & np.uint64(0xFFFFFFFF)).astype(np.int32)
        del entry, edge
        n = sizes[cls]
        fits = (h[1:] == h[:-1]) & (100 * n[:-1] >= percent * n[1:])  # of next sizes; others are further apart
        keep = np.r_[fits, False] | np.r_[False, fits]
        h, cls, many = h[keep], cls[keep].astype(np.int64), many[keep]
        turn = np.empty(len(keys), np.int64)  # pivots first; the same in all blocks
        turn[np.lexsort((keys, -scores / sizes))] = np.arange(len(keys))
        if not len(h):
            return _MEMBERS.empty_table()
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        best = np.minimum.reduceat(turn[cls], starts)
        pivot = np.argsort(turn)[np.repeat(best, np.diff(np.r_[starts, len(h)]))]
        pairs, at = np.unique(pivot.astype(np.int64) << 32 | cls, return_inverse=True)
        x, y = pairs >> 32, pairs & 0xFFFFFFFF
        name = lambda at: pa.array([k[:KEY] for k in keys[at].tolist()], pa.binary())
        return pa.Table.from_arrays([name(x), name(y), pa.array(sizes[y]), pa.array(least_shared(sizes[y], percent)), pa.array(np.bincount(at, weights=many).astype(np.int64))], schema=_MEMBERS)

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The numbers of common elements of all pairs of sets (sorted arrays of distinct hashes); above the diagonal."""
    k = len(sets)
    h = np.concatenate(sets)
    owner = np.repeat(np.arange(k), [len(s) for s in sets])
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    df = np.diff(np.r_[edge, len(h)])
    out = np.zeros((k, k), np.float32)  # counts to 2 ** 24 are exact
    dense = np.flatnonzero((df > 1) & (df * DENSE > k))
    step = max(1, 4_000_000 // k)
    for i in range(0, len(dense), step):
        cols = dense[i : i + step]
        d = df[cols]
        at = np.repeat(edge[cols], d) + np.arange(int(d.sum())) - np.repeat(np.cumsum(d) - d, d)
        x = np.zeros((k, len(cols)), np.float32)
        x[owner[at], np.repeat(np.arange(len(cols)), d)] = 1
        out += x @ x.T
    rare = np.flatnonzero((df > 1) & (df * DENSE <= k))
    for i in range(0, len(rare), 200_000):
        cols = rare[i : i + 200_000]
        for gap in range(1, int(df[cols].max(initial=1))):
            cols = cols[df[cols] > gap]
            d = df[cols] - gap
            at = np.repeat(edge[cols], d) + np.arange(int(d.sum())) - np.repeat(np.cumsum(d) - d, d)
            pairs, n = np.unique(owner[at] * k + owner[at + gap], return_counts=True)
            out.ravel()[pairs] += n
    return out


def stars(sets: list[np.ndarray], percent: int) -> tuple[list[int], list[int]]:
    """Pairs (first, other) of each component of the sets' links."""
    if len(sets) < 2:
        return [], []
    k, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    counts, linked = overlaps(sets), np.zeros((len(sets), len(sets)), bool)
    for i in range(k - 1):
        both = counts[i, i + 1 :].astype(np.int64)
        linked[i, i + 1 :] = 100 * both >= percent * (sizes[i] + sizes[i + 1 :] - both)
    linked |= linked.T
    left, a, b = np.ones(k, bool), [], []
    for i in np.flatnonzero(linked.any(axis=0)).tolist():
        if not left[i]:
            continue
        left[i], front = False, np.array([i])
        while len(front):
            front = np.flatnonzero(linked[front].any(axis=0) & left)
            left[front] = False
            a += [i] * len(front)
            b += front.tolist()
    return a, b


def _multiplier(percent: int):
    """Links from the rows (part, key, set) of whole parts, sorted by part and key."""

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, sets = None, [], []
        using(), one_thread()

        def done() -> pa.RecordBatch:
            a, b = stars(sets, percent)
            out = pa.RecordBatch.from_arrays([pa.array([keys[i] for i in x], pa.binary()) for x in (a, b)], ["a", "b"])
            keys.clear(), sets.clear()
            return out

        for batch in batches:
            for part, key, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "key", "set"))):
                if part != now:
                    if len(keys) > 1:
                        yield done()
                    now = part
                    keys.clear(), sets.clear()
                if not keys or keys[-1] != key:  # a pivot may be its part's member too
                    keys.append(key), sets.append(np.frombuffer(raw, np.uint64))
        if len(keys) > 1:
            yield done()

    return run


@tidy
def _set_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    using()
    for batch in chunks(batches):
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("parts"), pa.array([s.tobytes() for s in _sets(batch)], pa.binary())], ["key", "parts", "set"])


def _multiply(members: DataFrame, rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within the parts of ``members`` (part, key)."""
    # a class is in one part or a few; a pivot in as many as its family has, so its rows are dealt too
    lists = stored(members.groupBy("key", F.pmod("part", F.lit(64)).alias("deal")).agg(F.collect_set("part").alias("parts")), "members")
    one = classes.join(lists.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min(F.struct("doc", "rid")).alias("x"))
    wanted = stored(lists.join(one, "key").select("key", "parts", F.col("x.doc").alias("_d"), F.col("x.rid").alias("_r")), "wanted")
    other = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = rows.join(other, (F.col("rid") == F.col("_r")) & F.col("doc").eqNullSafe(F.col("_d"))).select("key", "parts", "text")
    sets = texts.mapInArrow(_set_rows, "key binary, parts array<long>, set binary").select(F.explode("parts").alias("part"), "key", "set")
    return stored(sets.repartition("part").sortWithinPartitions("part", "key").mapInArrow(_multiplier(percent), "a binary, b binary"), "links")


def _parts(count: Column, shingles: Column) -> Column:
    """How many parts so many classes and shingles take."""
    return F.greatest(F.ceil(count / CELL), F.ceil(shingles / ENTRIES), F.lit(1)).cast("long")


def _trimmed(families: DataFrame) -> DataFrame:
    """(pivot, key, n) without classes that have too few shared entries, and without each class's weakest families."""
    for _ in range(PEELS):
        enough = families.groupBy("key", "least").agg(F.sum("shared").alias("all")).where("all >= least").select("key")
        families = families.join(enough, "key", "left_semi")
        families = stored(families.join(families.groupBy("pivot").count().where("count > 1").select("pivot"), "pivot", "left_semi"), "families")
    upto = F.sum("shared").over(Window.partitionBy("key").orderBy("shared", "pivot").rowsBetween(Window.unboundedPreceding, 0))
    families = families.withColumn("upto", upto).where(2 * F.col("upto") > F.col("least") - 1)
    return stored(families.join(families.groupBy("pivot").count().where("count > 1").select("pivot"), "pivot", "left_semi").select("pivot", "key", "n"), "families")


def _first_round(families: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((part, key) of all families; (pivot, key, n) of those of several parts)."""
    roots = components(families, "pivot", "key").withColumnRenamed("node", "key")
    each = stored(families.join(roots, "key"), "families")
    whole = each.select("root", "key", "n").distinct().groupBy("root").agg(F.count("*").alias("k"), F.sum("n").alias("s"))
    whole = whole.select("root", ((F.col("k") <= CELL) & (F.col("s") <= ENTRIES)).alias("small"), "k").where("k > 1").drop("k")
    each = stored(each.join(whole, "root"), "families")
    large = each.where("not small").select("pivot", "key", "n")
    sizes = large.groupBy("pivot").agg(_parts(F.count("*"), F.sum("n")).alias("of"))
    large = stored(large.join(sizes, "pivot"), "large")
    near = each.where("small").select(F.xxhash64("root").alias("part"), "key")
    far = large.select(F.xxhash64("pivot", F.pmod(F.xxhash64("key"), "of")).alias("part"), "key")
    pivots = large.where("of > 1").select("pivot", "of").distinct().withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)))
    pivots = pivots.select(F.xxhash64("pivot", "i").alias("part"), F.col("pivot").alias("key"))
    return near.unionByName(far).unionByName(pivots).distinct(), large.where("of > 1").drop("of")


def _second_round(large: DataFrame, roots: DataFrame) -> DataFrame:
    """(part, key) for each pair of parts of a family that may hold a link which is not known."""
    each = large.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    trees = each.groupBy("pivot", "root").agg(_parts(F.count("*"), F.sum("n")).alias("of"), F.count("*").alias("k"), F.sum("n").alias("s"))
    rest = trees.where("of = 1").groupBy("pivot").agg(_parts(F.sum("k"), F.sum("s")).alias("rest"))
    each = each.join(trees.drop("k", "s"), ["pivot", "root"]).join(rest, "pivot", "left")
    alone = F.col("of") > 1  # a component of several parts; the others share parts
    tag = F.struct(F.when(alone, F.col("root")).alias("tree"), F.when(alone, F.pmod(F.xxhash64("key"), "of")).otherwise(F.pmod(F.xxhash64("root"), "rest")).alias("i"))
    each = stored(each.select("pivot", "key", tag.alias("tag")), "dealt")
    tags = each.select("pivot", "tag").distinct()
    pairs = tags.join(tags.withColumnRenamed("tag", "to"), "pivot").where((F.col("tag") <= F.col("to")) & ~F.coalesce(F.col("tag.tree") == F.col("to.tree"), F.lit(False)))
    cells = stored(pairs.select("pivot", "tag", "to", F.xxhash64("pivot", "tag", "to").alias("part")), "cells")
    sides = cells.select("pivot", "tag", "part").unionByName(cells.select("pivot", F.col("to").alias("tag"), "part")).distinct()
    return each.join(sides, ["pivot", "tag"]).select("part", "key")


def join(docs: DataFrame, key: str = "doc_id", percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """((doc, rid, n, key) for every row of ``docs``; links (a, b) of class keys).

    The links connect exactly the classes that pairs with 100 * |A & B| >= percent * |A | B|
    connect.  The key may have any type that can be ordered.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc"), F.xxhash64("text").alias("rid"), "text")
    scanned = stored(rows.mapInArrow(_classes, f"doc {kind}, rid long, n long, key binary, h array<long>, c array<long>"), "classes")
    classes = scanned.where("key is not null").select("doc", "rid", "n", "key")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    most = max(HOT_LEAST, int(total**0.5))  # what is left out is only ordered as rare
    common = scanned.where("key is null").select(F.explode(F.arrays_zip("h", "c")).alias("x")).select("x.h", "x.c").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= HOT).orderBy(F.desc("c"), "h").limit(most).toArrow()
    h, c = common.column("h").to_numpy().astype(np.int64).view(np.uint64), common.column("c").to_numpy()
    order = np.argsort(h)
    rank = np.empty(len(h), np.uint64)
    rank[np.lexsort((h, c))] = np.arange(len(h), dtype=np.uint64)
    hot = spark.sparkContext.broadcast((h[order], rank[order]))
    blocks = max(2 * spark.sparkContext.defaultParallelism, -(-total * (100 - percent + RESERVE) // 100 // BLOCK))
    posted = rows.mapInArrow(_poster(hot, blocks, percent), _POSTED)
    families = posted.groupBy("block").applyInArrow(_familiar(percent), "pivot binary, key binary, n long, least long, shared long")
    families = stored(families.groupBy("pivot", "key", "n", "least").agg(F.sum("shared").alias("shared")), "families")
    families = _trimmed(families)
    members, large = _first_round(families)
    links = _multiply(members, rows, classes, percent)
    if not large.isEmpty():
        links = links.unionByName(_multiply(_second_round(large, components(links)), rows, classes, percent))
    return classes, links


def near_components(docs: DataFrame, key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """(key, rid, n_shingles, component_id) for every row; component_id is the smallest key reachable by links.

    Rows without words are linked with nothing and their own component.  Rows
    that share a key but not a text are different nodes.  A null key never is
    the smallest, unless it is alone.
    """
    classes, links = join(docs, key, percent)
    roots = components(links)
    least = classes.where("n > 0").groupBy("key").agg(F.min("doc").alias("doc"))
    least = least.join(roots, F.col("key") == F.col("node"), "left").select("key", F.coalesce("root", "key").alias("root"), "doc")
    lowest = least.groupBy("root").agg(F.min("doc").alias("component_id"))
    of = stored(least.join(lowest, "root").select("key", "component_id"), "component")
    out = classes.join(of, "key", "left").select(F.col("doc").alias(key), "rid", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"))
    return out


def one_of_each(docs: DataFrame, key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose key is their component's smallest, once each; all columns under their own names.

    Rows without a key stay only if no row with a key is in their component.
    """
    judged = stored(near_components(docs, key, percent), "near")
    first = F.col(key).eqNullSafe(F.col("component_id"))
    kept = judged.where(first).select(F.col(key).alias("_k"), F.col("rid").alias("_r"))
    out = docs.withColumn("_rid", F.xxhash64("text")).join(kept, F.col("_rid").eqNullSafe(F.col("_r")) & F.col(key).eqNullSafe(F.col("_k")), "left_semi")
    repeated = not judged.where(first).groupBy(key, "rid").count().where("count > 1").isEmpty()
    return (out.dropDuplicates([key, "_rid"]) if repeated else out).drop("_rid")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, least(len(w), 1)))) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
"""
