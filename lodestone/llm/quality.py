"""Quality rules: counting rules first, then bands of n-gram perplexity for each language.

The model is an interpolated modified Kneser-Ney model of order 4 over the
characters of words (with start and end marks), one for each language.  Spark
counts the n-grams of all documents that pass the counting rules; discounts,
continuation counts and back-off weights are DataFrame aggregates, and so is the
log probability of every n-gram that occurs in any document.  These go to the
workers as sorted arrays of 64-bit hashes of whole n-grams, one pair of arrays
for each language; where they are more than ``BROADCAST_GRAMS``, documents meet
them in a join instead.

A document is rejected when its log perplexity lies more than ``FENCE`` times the
interquartile range of its language (over all documents that pass the counting
rules), or ``LEAST_WIDTH`` where that is more, outside the quartiles.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import MEMO_WORDS, chunks, mix, stored, tidy, using, windows

ORDER = 4
BITS = 21  # of a symbol: any code point, and the two marks beyond them
MIN_WORDS, MAX_REPEAT = 50, 50
FENCE, LEAST_WIDTH = 4.0, 0.05
BROADCAST_ROWS = 10_000  # languages
BROADCAST_GRAMS = 5_000_000
_START, _END = 0x110000, 0x110001
_SPACES = " \t\n\x0b\x0c\r"
_IS_SPACE, _IS_SYMBOL = (np.isin(np.arange(256), list(x)) for x in (_SPACES.encode(), b"#*$%&|<>"))
_BLOCK = 1 << 17  # bytes whose words are hashed at once; a worker keeps the powers of so many
_CHARACTERS = 1_000_000  # of a slice of texts
_POWER = 0x9E3779B97F4A7C15
_INVERSE = pow(_POWER, -1, 1 << 64)
#: What a byte adds to a word's hash, and the power of its place.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_SLICE = 80_000  # words whose n-grams are worked out at once
_TASK_WORDS = 200_000  # distinct words that a counting task holds before it emits their n-grams


def _symbols(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First symbols, and the packed other three, of the 4-grams of all words: one for each character and one for the end; and the word each belongs to."""
    text = b"".join(tokens).decode("utf-8", "surrogatepass")
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    leads = np.cumsum(np.frombuffer(b"\x00".join([*tokens, b""]), np.uint8) & 0xC0 != 0x80)  # characters so far
    sizes = np.diff(leads[np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1], prepend=0) - 1
    pad = ORDER - 1
    total = sizes + pad + 1
    first = np.cumsum(total) - total
    seq = np.full(int(total.sum()), _START, np.int64)
    owner = np.repeat(np.arange(len(tokens)), sizes)
    seq[np.arange(len(cps)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[owner] + pad] = cps
    seq[first + total - 1] = _END
    packed = seq[1:-2] << 2 * BITS | seq[2:-1] << BITS | seq[3:]
    of = np.repeat(np.arange(len(tokens)), total)[pad:]
    whole = np.arange(pad, len(seq)) - first[of] >= pad
    return seq[:-pad][whole], packed[whole], of[whole]


def _hash(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix(y.astype(np.uint64) ^ mix(x.astype(np.uint64)))


def failed(n_words, n_repeat_words):
    """Whether the counting rules reject; of numbers, arrays or columns alike."""
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT * n_words)


@tidy
def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, x, y, c): the n-grams, and how often they occur in documents that pass the counting rules."""
    using()
    good: dict = defaultdict(Counter)
    bad: dict = defaultdict(set)

    def flush(lang: str) -> Iterator[pa.RecordBatch]:
        seen = good.pop(lang, Counter())
        tokens = [*seen, *(w for w in bad.pop(lang, ()) if w not in seen)]
        for i in range(0, len(tokens), _SLICE):
            part = tokens[i : i + _SLICE]
            x, y, of = _symbols(part)
            weights = np.array([seen[w] for w in part], np.int64)[of]  # 0 for words of failing documents only
            order = np.lexsort((x, y))
            x, y, weights = x[order], y[order], weights[order]
            edge = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(edge), pa.string()), pa.array(x[edge]), pa.array(y[edge]), pa.array(np.add.reduceat(weights, edge))], ["lang", "x", "y", "c"])

    for batch in chunks(batches, limit=_CHARACTERS):
        token_lists, counts = rules(batch.column("text").to_pylist())
        fails = failed(counts["n_words"], counts["n_repeat_words"]).tolist()
        for lang, tokens, fail in zip(batch.column("lang").to_pylist(), token_lists, fails):
            if tokens:
                (bad if fail else good)[lang or ""].update(tokens)
        if sum(map(len, good.values())) + sum(map(len, bad.values())) > _TASK_WORDS:
            for lang in {*good, *bad}:
                yield from flush(lang)
    for lang in {*good, *bad}:
        yield from flush(lang)


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, x, y, c) of all 4-grams of all documents; c counts those that pass the rules and may be 0."""
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), "text")
    return rows.mapInArrow(_count, "lang string, x long, y long, c long").groupBy("lang", "x", "y").agg(F.sum("c").alias("c"))


def _last(order: int) -> Column:
    """The packed last symbols of an n-gram of ``order`` symbols (of three for order 4)."""
    return F.col("y").bitwiseAND(F.lit((1 << BITS * min(order, 3)) - 1))


def probabilities(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(lang, x, y, p): the probability of the last symbol after the three before it, for each of ``wanted`` (lang, x, y).

    counts: (lang, x, y, c) of the training text.  The order below 1 is uniform
    over the symbols that stand last in any wanted n-gram of the language.
    """
    level = counts.where("c > 0")
    table: dict[int, tuple[DataFrame, DataFrame]] = {}
    for order in range(ORDER, 0, -1):
        if order == ORDER - 1:  # continuation counts: how many symbols stand before the shorter n-gram
            level = level.groupBy("lang", "y").agg(F.count("*").alias("c")).select("lang", F.lit(0).cast("long").alias("x"), "y", "c")
        elif order < ORDER:
            level = level.groupBy("lang", _last(order).alias("y")).agg(F.count("*").alias("c")).select("lang", F.lit(0).cast("long").alias("x"), "y", "c")
        level = stored(level, "grams")
        n = stored(level.groupBy("lang").agg(*[F.sum((F.col("c") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]), "discounts")
        share = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        cut = lambda k: F.when(F.col("n1") * F.col("n2") * F.col(f"n{k}") > 0, F.least(F.greatest(k - (k + 1) * share * F.col(f"n{k + 1}") / F.col(f"n{k}"), F.lit(0.05)), F.lit(k - 0.05))).otherwise(F.lit(0.5 * k))  # noqa: B023, E731
        few = n.count() <= BROADCAST_ROWS
        n = n.select("lang", *[cut(k).alias(f"d{k}") for k in (1, 2, 3)])
        rows = level.join(F.broadcast(n) if few else n, "lang").withColumn("ctx", F.shiftright("y", BITS))
        rows = rows.withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        ctx = stored(rows.groupBy("lang", "x", "ctx").agg(F.sum("c").alias("s"), F.sum("d").alias("cut")), "contexts")
        table[order] = (rows.select("lang", "x", "y", (F.col("c") - F.col("d")).alias("left")), ctx)
    last = wanted.select("lang", _last(1).alias("y")).distinct()
    sizes = last.groupBy("lang").agg((1.0 / F.count("*")).alias("p"))
    p = last.join(sizes, "lang").select("lang", F.lit(0).cast("long").alias("x"), "y", "p")
    for order in range(1, ORDER + 1):
        if order > 1:  # what the shorter n-gram has is the start
            x = F.col("x") if order == ORDER else F.lit(0).cast("long")
            longer = wanted.select("lang", x.alias("x"), _last(order).alias("y")).distinct() if order < ORDER else wanted.select("lang", "x", "y")
            p = longer.withColumn("z", _last(order - 1)).join(p.select("lang", F.col("y").alias("z"), "p"), ["lang", "z"]).drop("z")
        left, ctx = table[order]
        p = p.withColumn("ctx", F.shiftright("y", BITS)).join(left, ["lang", "x", "y"], "left").join(ctx, ["lang", "x", "ctx"], "left")
        own = F.when(F.col("s") > 0, (F.coalesce("left", F.lit(0.0)) + F.col("cut") * F.col("p")) / F.col("s")).otherwise(F.col("p"))
        p = stored(p.select("lang", "x", "y", own.alias("p")), "probabilities")
    return p


class Model(dict):
    """language -> (sorted hashes of n-grams, their log probabilities)."""

    def __init__(self, table: pa.Table):
        super().__init__()
        lang = np.array(table.column("lang").to_pylist(), object)
        h, p = _hash(*(table.column(c).to_numpy() for c in ("x", "y"))), np.log(table.column("p").to_numpy())
        for name in set(lang):
            mine = lang == name
            order = np.argsort(h[mine])
            self[name] = h[mine][order], p[mine][order]

    def log_probs(self, lang: str, tokens: list[bytes]) -> np.ndarray:
        """Natural log probability of each word, its end included; all of them occur in the documents that were counted."""
        if not tokens:
            return np.empty(0)
        x, y, of = _symbols(tokens)
        keys, logp = self[lang]
        return np.bincount(of, weights=logp[np.searchsorted(keys, _hash(x, y))], minlength=len(tokens))


def _word_hashes(a: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hash of each word a[start:stop]: a polynomial over its bytes modulo 2^64, from running sums."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(stops, base + _BLOCK, side="right")))
        n = int(stops[j - 1]) - base
        power, inverse = _powers(max(n, _BLOCK))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[a[base : base + n]] * power[:n], out=sums[1:])
        s, e = starts[i:j] - base, stops[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        i = j
    return out


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    one = lambda x: np.cumprod(np.r_[np.uint64(1), np.full(n - 1, np.uint64(x))])
    return one(_POWER), one(_INVERSE)


def rules(texts: list[str | None]) -> tuple[list[list[bytes]], dict[str, np.ndarray]]:
    """The words of each text, and its counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raws = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    token_lists = [x.split() for x in raws]
    n = np.array([len(x) for x in token_lists], np.int64)
    a = np.frombuffer(b" ".join([b"", *raws, b""]), np.uint8)  # a space before, between and after the texts
    ends = np.cumsum(np.array([len(x) for x in raws], np.int64) + 1)  # where the space after each text is
    begins = ends - np.array([len(x) for x in raws], np.int64)
    space = _IS_SPACE[a]
    inner = np.cumsum(~space & ((a & 0xC0) != 0x80), dtype=np.int64)  # a character's first byte, in a word
    marks = np.flatnonzero(_IS_SYMBOL[a])
    chars = inner[ends] - inner[begins - 1]
    symbols = np.searchsorted(marks, ends) - np.searchsorted(marks, begins)
    dups = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text and "\n" in text:
            lines = [x for x in text.split("\n") if x.strip(_SPACES)]
            dups[i] = len(lines) - len(set(lines))
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    h = _word_hashes(a, edges[0::2], edges[1::2])
    doc = np.repeat(np.arange(len(texts)), n)
    repeats = np.zeros(len(texts), np.int64)
    if len(h) >= 3:
        inside = np.flatnonzero(doc[2:] == doc[:-2])  # windows of one text
        keys = (windows(h, 3, 0x9E3779B97F4A7C15) + doc[:-2].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))[inside]
        ordered = np.sort(keys)
        several = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(several):
            at = np.minimum(np.searchsorted(several, keys), len(several) - 1)
            twice = np.zeros(len(h) - 2, bool)
            twice[inside] = several[at] == keys
            covered = np.zeros(len(h), bool)
            for k in range(3):
                covered[k : k + len(twice)] |= twice
            repeats = np.bincount(doc[covered], minlength=len(texts))
    return token_lists, {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dups, "n_repeat_words": repeats}


_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


@tidy
def _counter(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    using()
    for batch in chunks(batches, limit=_CHARACTERS):
        _, counts = rules(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts.values())], [batch.schema.names[0], *counts])


def counted(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, the five counts, base_failed) for every row: the counting rules alone."""
    rows = docs.select(F.col(key).alias("_key"), "text").mapInArrow(_counter, f"_key {docs.schema[key].dataType.simpleString()}, {_COUNTS}")
    return rows.withColumn("base_failed", failed(F.col("n_words"), F.col("n_repeat_words"))).withColumnRenamed("_key", key)


def _scorer(model):
    """The other columns, the five counts, and the log probability of the whole text; without a model, the text's n-grams instead."""

    def grams(tokens: list[bytes]) -> list[dict]:
        x, y, _ = _symbols(tokens)
        n = Counter(zip(x.tolist(), y.tolist()))
        return [{"x": a, "y": b, "f": f} for (a, b), f in n.items()]

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using()
        memo: dict = defaultdict(dict)
        for batch in chunks(batches, limit=_CHARACTERS):
            langs = [x or "" for x in batch.column("lang").to_pylist()]
            token_lists, counts = rules(batch.column("text").to_pylist())
            if model:
                if sum(map(len, memo.values())) > MEMO_WORDS:
                    memo.clear()
                for lang in set(langs):
                    known = memo[lang]
                    new = list(set().union(*[t for x, t in zip(langs, token_lists) if x == lang]).difference(known))
                    for i in range(0, len(new), 25_000):
                        part = new[i : i + 25_000]
                        known.update(zip(part, model.value.log_probs(lang, part).tolist()))
                last = pa.array([sum(map(memo[x].__getitem__, t)) for x, t in zip(langs, token_lists)], pa.float64())
            else:
                last = pa.array([grams(t) if t else [] for t in token_lists], pa.list_(pa.struct([("x", pa.int64()), ("y", pa.int64()), ("f", pa.int64())])))
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, counts.values()), last], [*kept, *counts, "last"])

    return run


def _log_probs(rows: DataFrame, p: DataFrame, kinds: str) -> DataFrame:
    """rows (key, lang, text) with the five counts and ``log_p`` in place of the text."""
    spark = rows.sparkSession
    if p.count() <= BROADCAST_GRAMS:
        model = spark.sparkContext.broadcast(Model(p.toArrow()))
        return rows.mapInArrow(_scorer(model), f"{kinds}, {_COUNTS}, last double").withColumnRenamed("last", "log_p")
    part = stored(rows.mapInArrow(_scorer(None), f"{kinds}, {_COUNTS}, last array<struct<x: long, y: long, f: long>>").withColumn("_row", F.expr("uuid()")), "grams")
    each = part.select("_row", F.coalesce("lang", F.lit("")).alias("lang"), F.explode("last").alias("g")).select("_row", "lang", "g.*")
    sums = each.join(p, ["lang", "x", "y"]).groupBy("_row").agg(F.sum(F.col("f") * F.log("p")).alias("log_p"))
    return part.drop("last").join(sums, "_row", "left").drop("_row").withColumn("log_p", F.coalesce("log_p", F.lit(0.0)))


def scored(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, lang, the five counts, log_ppl, base_failed, kept) for every row of ``docs`` (key, text, lang; more columns are ignored).

    A null or wordless text has null perplexity and fails the base rules; a null
    language is the language "".  An empty table gives an empty one.  Repeated
    rows stay and are judged alike.
    """
    rows = docs.select(F.col(key).alias("_key"), "lang", "text")
    counts = stored(count_grams(rows), "counts")
    p = probabilities(counts, counts.select("lang", "x", "y"))
    rows = _log_probs(rows, p, f"_key {docs.schema[key].dataType.simpleString()}, lang string")
    rows = stored(rows.withColumn("log_ppl", F.when(F.col("n_words") > 0, -F.col("log_p") / (F.col("word_chars") + F.col("n_words")))).drop("log_p"), "quality")
    rows = rows.withColumn("base_failed", failed(F.col("n_words"), F.col("n_repeat_words"))).withColumn("band", F.coalesce("lang", F.lit("")))
    bands = rows.where("not base_failed").groupBy("band").agg(F.percentile_approx("log_ppl", [0.25, 0.75], 10_000).alias("q"))
    wide = F.greatest(FENCE * (F.col("q")[1] - F.col("q")[0]), F.lit(LEAST_WIDTH))
    bands = stored(bands.select("band", (F.col("q")[0] - wide).alias("low"), (F.col("q")[1] + wide).alias("high")), "bands")
    bands = F.broadcast(bands) if bands.count() <= BROADCAST_ROWS else bands
    inside = F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(False))
    return rows.join(bands, "band", "left").withColumn("kept", ~F.col("base_failed") & inside).drop("band").withColumnRenamed("_key", key)


def filter_quality(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that pass; all of their columns, under their own names.

    Rows are judged by key, text and language, each of which may be null.
    """
    rows = docs.select(F.struct(F.col(key).alias("k"), F.xxhash64("text").alias("r")).alias("_id"), "lang", "text")
    good = scored(rows, "_id").where("kept").select(F.col("_id.k").alias("_k"), F.col("_id.r").alias("_r"), F.col("lang").alias("_l")).distinct()
    same = F.col(key).eqNullSafe(F.col("_k")) & (F.col("_rid") == F.col("_r")) & F.col("lang").eqNullSafe(F.col("_l"))
    return docs.withColumn("_rid", F.xxhash64("text")).join(good, same, "left_semi").drop("_rid")


#: The counting rules; the verdict of the model cannot be said in SQL.
ORACLE_COUNTS = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT rid, i, array_to_string(w[i:i + 2], ' ') AS k FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) > 2)),
m AS (SELECT rid, k FROM g GROUP BY rid, k HAVING count(*) > 1),
c AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(generate_series(i, i + 2)) AS j FROM g JOIN m USING (rid, k)) GROUP BY rid),
l AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
a AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
      CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
      FROM d LEFT JOIN c USING (rid) LEFT JOIN l USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a
"""
