"""Benchmark decontamination by greedy string tiling.

Words are compared in lower case without punctuation.  A document and a
benchmark item that share a run of ``SEED`` words are tiled: the longest matches
that cover no word twice are marked one after another, longest first, down to
``SEED`` words.  Since tiles may lie in any order, a reordered passage is covered
as well as a copied one.  A pair is contaminated when tiles cover at least
``COVERAGE`` of the item's words.

1. Karp-Rabin hashes of all seeds of the benchmark make a bit filter of at most
   ``FILTER_BITS``, the only thing that goes to the workers; one pass over the
   documents keeps the seeds (their words) that pass it.  A benchmark too large
   for the filter lets more seeds through, and changes nothing else.
2. Documents and items meet by the words of seeds that are rare in the benchmark.
   Tiles that cover C words of an item cover C / SEED of its seeds at least, so so
   many less one of its most frequent seeds need not be looked up: wording that
   many items share seldom makes a candidate.
3. Candidates are tiled from their shared seeds.

Items of the same words are one class, tiled once.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import MEMO_WORDS, MEMOS, chunks, stored, tidy, using, windows, words

SEED, COVERAGE = 5, 0.5
FILTER_BITS = 1 << 27
BROADCAST_ROWS = 200_000
_BASE = 0x94D049BB133111EB
_NOT_LETTERS = re.compile(r"[\W_]+")


def plain(word: bytes) -> str:
    """A word's letters and digits in lower case."""
    return _NOT_LETTERS.sub("", word.decode("utf-8", "replace").lower())


class _Plain(dict):
    """word -> hash of its letters and digits in lower case; 0 if it has none."""

    def __missing__(self, word: bytes) -> int:
        text = plain(word)
        self[word] = h = xxhash.xxh64_intdigest(text) or 1 if text else 0
        return h


_PLAIN = _Plain()
MEMOS.append(_PLAIN)


def plain_words(text: str | None) -> tuple[list[bytes], np.ndarray]:
    """The words that have letters or digits, and their hashes."""
    if len(_PLAIN) > MEMO_WORDS:
        _PLAIN.clear()
    tokens = words(text)
    h = np.fromiter(map(_PLAIN.__getitem__, tokens), np.uint64, len(tokens))
    if h.all():
        return tokens, h
    at = np.flatnonzero(h)
    return [tokens[i] for i in at.tolist()], h[at]


def tiles(n: int, at_item: np.ndarray, at_doc: np.ndarray) -> list[tuple[int, int, int]]:
    """(length, place in item, place in doc) of the tiles of an item of n words; at_item and at_doc are the places of all shared seeds."""
    order = np.lexsort((at_doc, at_doc - at_item))
    i, j = at_item[order], at_doc[order]
    new = np.r_[True, (np.diff(j - i) != 0) | (np.diff(j) != 1)]
    starts = np.flatnonzero(new)
    runs = np.diff(np.r_[starts, len(i)])
    heap = [(-(int(k) + SEED - 1), int(i[s]), int(j[s])) for s, k in zip(starts, runs)]
    heapq.heapify(heap)
    used_item, used_doc, out = np.zeros(n, bool), defaultdict(bool), []
    while heap:
        n, a, b = heapq.heappop(heap)
        free = [not (used_item[a + k] or used_doc[b + k]) for k in range(-n)]
        if all(free):
            used_item[a : a - n] = True
            used_doc.update((b + k, True) for k in range(-n))
            out.append((-n, a, b))
            continue
        start = None
        for k, ok in enumerate([*free, False]):  # what is left of the match comes up again at its own length
            if ok and start is None:
                start = k
            elif not ok and start is not None:
                if k - start >= SEED:
                    heapq.heappush(heap, (start - k, a + start, b + start))
                start = None
    return out


@tidy
def _item_seeds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, cls, n, seeds, hs): a digest of an item's words, their number, and its seeds' words and hashes in order."""
    using(_PLAIN)
    for batch in chunks(batches):
        cls, sizes, seeds, hashes = [], [], [], []
        for text in batch.column("text").to_pylist():
            tokens, h = plain_words(text)
            w = [plain(t) for t in tokens]
            cls.append(blake2b(" ".join(w).encode("utf-8", "surrogatepass"), digest_size=16).digest()), sizes.append(len(w))
            seeds.append([" ".join(w[k : k + SEED]) for k in range(len(w) - SEED + 1)])
            hashes.append(windows(h, SEED, _BASE).astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(cls, pa.binary()), pa.array(sizes, pa.int64()), pa.array(seeds, pa.list_(pa.string())), pa.array(hashes, pa.list_(pa.int64()))], ["item", "cls", "n", "seeds", "hs"])


def _filter(classes: DataFrame) -> np.ndarray:
    """Bits (as 64-bit words, a power of two of them) at two places for each seed."""
    seeds = classes.select(F.explode("hs").alias("h"))
    bits = 64
    while bits < min(FILTER_BITS, 32 * seeds.count()):
        bits *= 2
    at = seeds.select(F.explode(F.array(F.col("h").bitwiseAND(F.lit(bits - 1)), F.shiftright("h", 32).bitwiseAND(F.lit(bits - 1)))).alias("at"))
    got = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()  # at most FILTER_BITS / 64 rows
    out = np.zeros(bits // 64, np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def _hits(bits):
    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using(_PLAIN)
        table = bits.value
        mask = np.uint64(len(table) * 64 - 1)

        def there(at: np.ndarray) -> np.ndarray:
            at = at & mask
            return (table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)

        for batch in chunks(batches):
            rows, seeds, places = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                tokens, h = plain_words(text)
                w = windows(h, SEED, _BASE)
                at = np.flatnonzero(there(w)) if len(w) else w
                if len(at):
                    at = at[there(w[at] >> np.uint64(32))]
                if len(at):
                    rows.append(i), places.append(at.astype(np.int32))
                    seeds.append([" ".join(map(plain, tokens[p : p + SEED])) for p in at.tolist()])
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(rows)), batch.column("rid").take(pa.array(rows)), pa.array(seeds, pa.list_(pa.string())), pa.array(places, pa.list_(pa.int32()))], ["k", "rid", "seeds", "places"])

    return run


def _tiler(coverage: float):
    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, found = [], []
            for i, (n, item, seeds, places) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n", "item_seeds", "seeds", "places")))):
                of = defaultdict(list)
                for k, seed in enumerate(item):
                    of[seed].append(k)
                pairs = [(a, b) for seed, b in zip(seeds, places) for a in of.get(seed, ())]
                got = tiles(n, *np.array(pairs, np.int64).T) if pairs else []
                covered = sum(t[0] for t in got)
                if got and covered >= coverage * n:
                    keep.append(i), found.append((n, covered, len(got), max(t[0] for t in got)))
            cols = list(zip(*found)) or [()] * 4
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("k", "rid", "cls")), *(pa.array(c, pa.int64()) for c in cols)], ["k", "rid", "cls", "item_words", "covered_words", "tiles", "longest_tile"])

    return run


def _found(docs: DataFrame, benchmark: DataFrame, key: str, item: str, coverage: float) -> tuple[DataFrame, DataFrame]:
    """((k, rid, cls, the four counts) of contaminated documents; (item, cls) of all items)."""
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((docs, key), (benchmark, item))]
    items = stored(benchmark.select(F.col(item).alias("item"), "text").mapInArrow(_item_seeds, f"item {kinds[1]}, cls binary, n long, seeds array<string>, hs array<long>"), "items")
    classes = stored(items.where(F.col("n") >= SEED).groupBy("cls").agg(*(F.first(c).alias(c) for c in ("n", "seeds", "hs"))), "classes")
    bits = docs.sparkSession.sparkContext.broadcast(_filter(classes))
    rows = docs.select(F.col(key).alias("k"), F.xxhash64("text").alias("rid"), "text")
    hits = rows.mapInArrow(_hits(bits), f"k {kinds[0]}, rid long, seeds array<string>, places array<int>")
    hits = stored(hits.withColumn("row", F.monotonically_increasing_id()), "hits")
    places = classes.select("cls", "n", F.posexplode("seeds").alias("at", "seed"))
    often = places.groupBy("seed").agg(F.count("*").alias("df"))
    spare = F.ceil(F.ceil(F.col("n") * F.lit(coverage)) / SEED) - 1  # as many seeds at least are covered, less one
    nth = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("df"), "at"))
    rare = stored(places.join(often, "seed").withColumn("nth", nth).where(F.col("nth") > spare).select("seed", "cls").distinct(), "rare")
    pairs = hits.select("row", F.explode(F.array_distinct("seeds")).alias("seed")).join(rare, "seed").select("row", "cls").distinct()
    both = pairs.join(hits, "row").join(classes.select("cls", "n", F.col("seeds").alias("item_seeds")), "cls").select("k", "rid", "cls", "n", "item_seeds", "seeds", "places")
    return both.mapInArrow(_tiler(coverage), f"k {kinds[0]}, rid long, cls binary, item_words long, covered_words long, tiles long, longest_tile long"), items.select("item", "cls")


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", coverage: float = COVERAGE) -> DataFrame:
    """(key, item, item_words, covered_words, coverage, tiles, longest_tile) for each contaminated pair.

    Null and empty texts and items under ``SEED`` words match nothing; a null key
    or item id is reported as it is; repeated rows, and items of the same words,
    are reported for each of them; an empty benchmark or table gives no rows.
    Keys may have any type; other columns are ignored.
    """
    found, items = _found(docs, benchmark, key, item, coverage)
    out = found.join(items, "cls").select(F.col("k").alias(key), F.col("item").alias(item), "item_words", "covered_words", "tiles", "longest_tile")
    return out.withColumn("coverage", F.col("covered_words") / F.col("item_words"))


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all of their columns.

    Rows go by key and text; a null key or text is one like any other.
    """
    found, _ = _found(docs, benchmark, key, item, coverage)
    gone = stored(found.select(F.col("k").alias("_k"), F.col("rid").alias("_r")).distinct(), "contaminated")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    same = F.col(key).eqNullSafe(F.col("_k")) & F.col("_rid").eqNullSafe(F.col("_r"))
    return docs.withColumn("_rid", F.xxhash64("text")).join(gone, same, "left_anti").drop("_rid")
