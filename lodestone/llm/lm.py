"""Language-model scoring: a log-bilinear model trained with noise-contrastive estimation.

The model predicts a word from the two words before it.  The most frequent words
(``VECTORS``, or n ** ``GROWTH`` of n training tokens if that is more) and the end
of a text have vectors of their own, as contexts and as targets.  All other
words share vectors by a hash of their last ``SUFFIX`` bytes: each such class is a
context and a group of targets, within which a word has its smoothed relative
frequency.  The output is factored: words with vectors are dealt by frequency to
about as many groups as the square root of their number, and
P(w | u, v) = P(group | u, v) P(w | group, u, v), both softmaxes of
(C2[u] + C1[v]) . R[x] + b[x].  So every text has a probability.

Training words are counted by Spark.  Documents are dealt by hash to shards of a
size that only the counts decide, and sorted there; so the model depends on the
documents, not on how they lie in files or tasks.  In each of ``ROUNDS`` rounds
every shard is run over once, in numpy, from the common parameters, against noise
drawn from the groups' and the words' frequencies; a row of the parameters is
averaged over the shards by its uses.  Token log probabilities are exact: groups
and members are summed for each token, but for pairs of the most frequent
contexts, whose sums over groups are kept.

Counts of ``HEAD`` words (or n ** 0.6) go to the workers; those of all other words
meet the documents in a join.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import chunks, one_thread, stored, using

VOCAB, DIM, NOISE, BATCH, RATE = 512, 16, 32, 2048, 0.15
HEAD, COUNTED = 120_000, 0.6
VECTORS, GROWTH, SUFFIX, ROUNDS = 4096, 0.45, 3, 1
WORD_NOISE, SHARD, SHARD_SHARE, ROWS = 2, 2_000_000, 40, 512  # noise words of a target's group; tokens of a shard, and for each word with a vector, at least; parameter rows in a record (one task averages such records of all shards)
ROW_BLOCK = 1024  # tokens whose scores are worked out at once: they stay in the cache
STEP_BLOCK = 256  # the same of a training step's tokens over all groups
FOLD, FOLDS = 2, 7
_FLUSH = 300_000
_CRC = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], np.uint32)  # of one byte, from an empty register


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in lower case (A-Z only), each text's followed by the end (empty, as no word is), and their number in each text."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(texts, "", " "))  # what is after the last space is the end
    split = pc.ascii_split_whitespace(texts)
    return split.flatten().cast(pa.binary()), pc.list_value_length(split).to_numpy().astype(np.int64)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    add = lambda x, *of: x.group_by("w", use_threads=False).aggregate([of]).rename_columns(["w", "c"])
    parts: list[pa.Table] = []
    for batch in chunks(batches):
        words, _ = tokens(batch.column("text"))
        parts.append(add(pa.table({"w": words}), [], "count_all"))
        if sum(x.num_rows for x in parts) > 2 * _FLUSH:
            parts = [add(pa.concat_tables(parts), "c", "sum")]
            if parts[0].num_rows > _FLUSH:
                yield from parts.pop().to_batches()
    if parts:
        yield from add(pa.concat_tables(parts), "c", "sum").to_batches()


def word_counts(docs: DataFrame) -> DataFrame:
    """(w, c) over all texts; w is empty for the end."""
    return docs.select("text").mapInArrow(_count, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


def _head(counts: DataFrame, most: int) -> tuple[int, list]:
    """The least count that at most ``most`` words reach, and those words."""
    sizes = counts.groupBy("c").agg(F.count("*").alias("n"))
    total = sizes.withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0)))
    least = total.where(F.col("upto") <= most).agg(F.min("c")).first()[0]
    if least is None:
        return 1 << 62, []
    rows = counts.where(F.col("c") >= least).toArrow().to_pydict()
    return least, sorted(zip(rows["w"], rows["c"]), key=lambda x: (-x[1], x[0]))


def bucket(word: bytes, buckets: int) -> int:
    """The class of a word without vectors of its own."""
    return zlib.crc32(word[-SUFFIX:]) % buckets


def classes(words: pa.Array, buckets: int) -> np.ndarray:
    """``bucket`` of each word."""
    _, at, data = words.buffers()
    at = np.frombuffer(at, np.int32)[words.offset :][: len(words) + 1] if len(words) else np.zeros(1, np.int32)
    data = np.frombuffer(data or b"", np.uint8)
    crc = np.full(len(words), 0xFFFFFFFF, np.uint32)
    for back in range(SUFFIX, 0, -1):
        has = np.flatnonzero(at[1:] - at[:-1] >= back)
        crc[has] = _CRC[(crc[has] ^ data[at[1:][has] - back]) & 255] ^ (crc[has] >> 8)
    return (crc ^ np.uint32(0xFFFFFFFF)).astype(np.int64) % buckets


class Tables:
    """What a worker needs to know of the counts: contexts, groups and log frequencies of the head words.

    Contexts and output groups from 0 are the classes of words without vectors;
    then come words (as contexts) or groups of words.  tail: (words, tokens) of
    each class beyond the head.
    """

    def __init__(self, head: list, n: int, v: int, most: int, tail=lambda buckets: {}):
        self.head = pa.array([w for w, _ in head], pa.binary())
        c = np.array([c for _, c in head], float)
        words = next((w for w in range(min(most, len(head)), 0, -1) if w == len(head) or c[w - 1] > c[w]), 0)  # equal counts are treated alike
        self.buckets = max(16, math.ceil(math.sqrt(words)))
        self.words, self.unknown = words, len(head)
        of = np.array([bucket(w, self.buckets) for w, _ in head[words:]], np.int64)
        root = np.cumsum(np.sqrt(c[:words]))
        _, group = np.unique(np.floor(root / (root[-1] + 1) * math.ceil(math.sqrt(words))), return_inverse=True) if words else (None, np.empty(0, np.int64))
        self.group = np.r_[self.buckets + group, of].astype(np.int64)  # of each head word
        self.context = np.r_[self.buckets + np.arange(words), of].astype(np.int64)
        self.groups, self.contexts = int(self.group.max(initial=self.buckets - 1)) + 1, self.buckets + words + 1
        self.start = self.contexts - 1
        self.edges = np.searchsorted(self.group[:words], np.arange(self.groups + 1))  # the words of group g stand from edges[g] to edges[g + 1]
        far, near = tail(self.buckets), np.bincount(of, minlength=self.buckets)
        types = near + [far.get(k, (0, 0))[0] for k in range(self.buckets)]
        tokens = np.bincount(of, weights=c[words:], minlength=self.buckets) + [far.get(k, (0, 0))[1] for k in range(self.buckets)]
        in_group = np.r_[tokens, np.bincount(group, weights=c[:words], minlength=self.groups - self.buckets)]
        self.q = (in_group + 1) / (in_group.sum() + len(in_group))
        self.cum = np.r_[0.0, np.cumsum(c[:words])]
        self.ends = np.r_[self.cum[1:], np.inf]
        self.cell = self.cum[-1] / (4 * words + 1)
        self.guide = np.maximum(np.searchsorted(self.cum, np.arange(4 * words + 2) * self.cell, side="right") - 2, 0)  # not beyond the word at a cell's start, however that is rounded
        self.share = np.log(c[:words] / in_group[self.group[:words]]).astype(np.float32)
        self.rest = np.log10(tokens + types + 1)  # a word beyond has (count + 1) / (tokens + types + 1) of its class
        self.within = np.r_[np.zeros(words), np.log10(c[words:] + 1) - self.rest[of]]
        self.base = np.array([*np.log10((c + 1) / (n + v + 1)), 0.0])

    def at(self, x: np.ndarray) -> np.ndarray:
        """The word whose part of ``cum`` x is in: as searchsorted finds it, but from the cell's first word on."""
        word = self.guide.take((x / self.cell).astype(np.int64), mode="clip")
        while (more := self.ends.take(word) <= x).any():
            word += more
        return word

    @cached_property
    def index(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.head.to_pylist())}

    def look(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The tokens beyond the head, all tokens' head indices (the last for none), their contexts and groups, and their number in each text."""
        words, sizes = tokens(texts)
        flat = pc.fill_null(pc.index_in(words, value_set=self.head), self.unknown).to_numpy().astype(np.int64)
        far = np.flatnonzero(flat == self.unknown)
        beyond = words.take(pa.array(far))
        context, group = (np.append(x, 0).take(flat) for x in (self.context, self.group))
        context[far] = group[far] = classes(beyond, self.buckets)
        return beyond, flat, context, group, sizes


def _contexts(at: np.ndarray, sizes: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Context rows of the word before the last and of the last word, at each token."""
    one, two = np.r_[start, at[:-1]], np.r_[start, start, at[:-2]]
    first = np.cumsum(sizes) - sizes
    one[first] = start
    two[first] = start
    two[(first + 1)[sizes > 1]] = start
    return two[: len(at)], one[: len(at)]


def initial(q: np.ndarray, t: Tables | None = None) -> dict[str, np.ndarray]:
    """Parameters over the groups of frequencies q, and over the head words of t."""
    rng = np.random.default_rng(7)
    contexts = t.contexts if t else len(q) + 1
    of = lambda n: rng.normal(0, 0.1, (n, DIM)).astype(np.float32)
    p = {"R": of(len(q)), "C1": of(contexts), "C2": of(contexts), "b": np.log(q).astype(np.float32)}
    return p | ({"R2": of(t.words), "b2": t.share.copy()} if t else {})


class Trainer:
    """Noise-contrastive steps (with Adagrad for each row) from the common start."""

    def __init__(self, q: np.ndarray, seed: int, t: Tables | None = None, p: dict | None = None):
        self.p, self.t, self.rng = {k: v.copy() for k, v in p.items()} if p else initial(q, t), t, np.random.default_rng(seed)
        self.sq = {k: np.full(len(v), 1.0, np.float32) for k, v in self.p.items()}
        self.uses = {k: np.zeros(len(v), np.float32) for k, v in self.p.items()}
        self.block = np.empty((STEP_BLOCK, len(q)), np.float32)
        self.noise, self.weight, self.seen = np.log(NOISE * q).astype(np.float32), (NOISE * q).astype(np.float32), 0

    def _move(self, keys: tuple[str, ...], at: np.ndarray, grad: np.ndarray) -> None:
        """Moves the rows ``at`` of the keys along their gradients' sums; a row may come more than once.

        grad: the keys' gradients side by side.
        """
        uses = np.bincount(at, minlength=len(self.p[keys[0]]))
        rows = np.flatnonzero(uses > 0)
        place = np.empty(len(uses), np.int64)
        place[rows] = np.arange(len(rows))
        wide = grad.shape[1]  # bincount adds up far faster than reduceat over rows, without a sort
        cells = np.arange(len(rows) * wide).reshape(-1, wide).take(place.take(at), axis=0)
        g = np.bincount(cells.ravel(), weights=grad.ravel(), minlength=len(rows) * wide).astype(np.float32).reshape(-1, wide)
        uses, start = uses[rows].astype(np.float32), 0
        for key in keys:
            stop = start + self.p[key][:1].size
            self._along(key, rows, g[:, start:stop], uses)
            start = stop

    def _along(self, key: str, rows: np.ndarray, g: np.ndarray, uses: np.ndarray) -> None:
        p = self.p[key]
        sq = self.sq[key].take(rows) + np.einsum("ij,ij->i", g, g) / np.float32(g.shape[1])
        self.sq[key][rows] = sq
        p[rows] = p.take(rows, axis=0) + (g * (RATE / np.sqrt(sq))[:, None]).reshape(-1, *p.shape[1:])
        self.uses[key][rows] += uses

    def step(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, x: np.ndarray | None = None) -> None:
        """Contexts u, v; groups w; head words x.

        The noise over groups is taken at its expectation, so no group's share of
        it depends on the draw; that over the words of a group is drawn.
        """
        p, n = self.p, len(w)
        ctx = np.ones((n, DIM + 1), np.float32)  # the last column is the biases'
        np.add(p["C2"].take(u, axis=0), p["C1"].take(v, axis=0), out=ctx[:, :DIM])
        minus = -np.concatenate([p["R"].T, (p["b"] - self.noise)[None]])
        noise = -self.weight[:, None] * p["R"]
        d_ctx, d_r = np.empty((n, DIM), np.float32), np.zeros((len(self.weight), DIM + 1), np.float32)
        for i in range(0, n, STEP_BLOCK):
            c = ctx[i : i + STEP_BLOCK]
            taken, own = self.block[: len(c)], w[i : i + STEP_BLOCK]
            with np.errstate(over="ignore"):  # to infinity, which is never taken for true
                np.exp(np.matmul(c, minus, out=taken), out=taken)
            taken += 1
            np.reciprocal(taken, out=taken)  # how likely each group is taken for true; its noise is weight times that
            at = np.arange(0, taken.size, taken.shape[1]) + own
            true = taken.ravel().take(at)
            taken.ravel()[at] = true - (1 - true) / self.weight.take(own)
            np.matmul(taken, noise, out=d_ctx[i : i + STEP_BLOCK])
            d_r += taken.T @ c
        d_r *= -self.weight[:, None]
        every, groups = np.bincount(w, minlength=len(self.weight)).astype(np.float32), np.arange(len(self.weight))
        inner = None
        if x is not None and len(inner := np.flatnonzero(x < self.t.words)):
            t, y, c, group = self.t, x.take(inner), ctx.take(inner, axis=0), w.take(inner)
            first, last = t.edges.take(group)[:, None], t.edges.take(group + 1)[:, None]
            low, high = t.cum.take(first), t.cum.take(last)
            drawn = t.at(low + self.rng.random((len(y), WORD_NOISE)) * (high - low))
            at = np.concatenate([y[:, None], np.minimum(np.maximum(drawn, first), last - 1)], axis=1)
            known = p["R2"].take(at, axis=0)
            s = np.einsum("ikj,ij->ik", known, c[:, :DIM]) + p["b2"].take(at) - t.share.take(at) - np.float32(math.log(WORD_NOISE))
            pulls = -1 / (1 + np.exp(-np.clip(s, -30, 30)))
            pulls[:, 0] += 1
            d_ctx[inner] += np.einsum("ik,ikj->ij", pulls, known)
        self._along("R", groups, d_r[:, :DIM], every)
        self._along("b", groups, d_r[:, DIM:], every)
        self._move(("C1",), v, d_ctx)
        self._move(("C2",), u, d_ctx)
        if inner is not None and len(inner):
            self._move(("R2", "b2"), at.ravel(), (pulls[:, :, None] * c[:, None, :]).reshape(-1, DIM + 1))
        self.seen += n


def train(docs: DataFrame, tables, n_tokens: int = 0) -> dict[str, np.ndarray]:
    """Rounds over all shards; each ends in the mean of each row of the parameters by its uses in the shards.

    docs: (k, text).
    """
    t, spark = tables.value, docs.sparkSession
    shards = max(1, n_tokens // max(SHARD, SHARD_SHARE * (t.words + 1)))
    rows = docs.select("text", F.xxhash64(F.col("k").cast("string"), "text").alias("h")).repartition(shards, "h").sortWithinPartitions("h")

    def run(start, turn: int):
        def steps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            using(), one_thread()
            t = tables.value
            trainer, rest = Trainer(t.q, 1000 * turn + TaskContext.get().partitionId(), t, start.value if start else None), [np.empty(0, np.int64)] * 4
            for batch in chunks(batches):
                _, flat, context, group, sizes = t.look(batch.column("text"))
                all_ = [np.concatenate(x) for x in zip(rest, (*_contexts(context, sizes, t.start), group, flat))]
                whole = len(all_[0]) - len(all_[0]) % BATCH
                for i in range(0, whole, BATCH):
                    trainer.step(*(x[i : i + BATCH] for x in all_))
                rest = [x[whole:] for x in all_]
            if len(rest[0]):
                trainer.step(*rest)
            if trainer.seen:
                for k, a in trainer.p.items():
                    for i in range(0, len(a), ROWS):
                        n = trainer.uses[k][i : i + ROWS] + np.float32(1e-6)  # a row without uses keeps its start
                        yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([i], pa.int64()), pa.array([n.tobytes()], pa.binary()), pa.array([a[i : i + ROWS].tobytes()], pa.binary())], ["k", "at", "n", "p"])

        return steps

    def mean(table: pa.Table) -> pa.Table:
        total = uses = 0.0
        for n, p in sorted(zip(table.column("n").to_pylist(), table.column("p").to_pylist())):  # sums in one order
            n = np.frombuffer(n, np.float32).astype(float)
            total, uses = total + np.frombuffer(p, np.float32).reshape(len(n), -1) * n[:, None], uses + n
        return pa.table({"k": table.column("k")[:1], "at": table.column("at")[:1], "n": pa.array([uses.astype(np.float32).tobytes()], pa.binary()), "p": pa.array([(total / uses[:, None]).astype(np.float32).tobytes()], pa.binary())})

    ddl, start, out = "k string, at long, n binary, p binary", None, initial(t.q, t)
    for turn in range(ROUNDS):
        done = stored(rows.mapInArrow(run(start, turn), ddl), "parameters")
        out = {k: v.copy() for k, v in out.items()}
        for r in done.groupBy("k", "at").applyInArrow(mean, ddl).toArrow().to_pylist():  # as much as one model
            a = np.frombuffer(r["p"], np.float32)
            out[r["k"]].reshape(-1)[r["at"] * out[r["k"]][:1].size :][: len(a)] = a
        start = spark.sparkContext.broadcast(out)
    return out


def _log_sum(s: np.ndarray) -> np.ndarray:
    """log of the sum of exp over each row of a small array."""
    if s.size and -60 < float(s.min()) and float(s.max()) < 60:
        return np.log(np.exp(s).sum(axis=1))  # a product with ones would be faster, but a row's sum would depend on the rows beside it
    top = s.max(axis=1)
    return top + np.log(np.exp(s - top[:, None]).sum(axis=1))


def normalisers(p: dict[str, np.ndarray]) -> np.ndarray:
    """log of the sum over all groups, for each pair of the first VOCAB + 1 contexts."""
    n = min(VOCAB + 1, len(p["C1"]))
    return np.array([_log_sum((p["C2"][u] + p["C1"][:n]) @ p["R"].T + p["b"]) for u in range(n)], np.float32)


def class_log_probs(p, z: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """log10 probability of each group w after the contexts u, v."""
    out = np.empty(len(w))
    for i in range(0, len(w), ROW_BLOCK):
        s = slice(i, i + ROW_BLOCK)
        ctx, norm = p["C2"].take(u[s], axis=0) + p["C1"].take(v[s], axis=0), np.empty(len(w[s]))
        kept = (u[s] < len(z)) & (v[s] < len(z))
        norm[kept] = z[u[s][kept], v[s][kept]]
        if not kept.all():
            norm[~kept] = _log_sum(ctx[~kept] @ p["R"].T + p["b"])
        out[s] = np.einsum("ij,ij->i", ctx, p["R"].take(w[s], axis=0)) + p["b"].take(w[s]) - norm
    return out / math.log(10)


def word_log_probs(p, t: Tables, u: np.ndarray, v: np.ndarray, x: np.ndarray) -> np.ndarray:
    """log10 probability of each head word x within its group after the contexts u, v; 0 for words beyond the head."""
    out = np.r_[t.within, 0.0][x]
    own = np.flatnonzero(x < t.words)
    own = own[np.argsort(x[own].astype(np.min_scalar_type(t.words)), kind="stable")]  # two bytes are sorted by radix
    stops = np.searchsorted(t.group[x[own]], np.arange(t.groups + 1))
    for g in np.flatnonzero(np.diff(stops)).tolist():
        a, b = t.edges[g], t.edges[g + 1]
        for i in range(stops[g], stops[g + 1], ROW_BLOCK) if b - a > 1 else ():
            at = own[i : min(i + ROW_BLOCK, stops[g + 1])]
            s = (p["C2"].take(u[at], axis=0) + p["C1"].take(v[at], axis=0)) @ p["R2"][a:b].T + p["b2"][a:b]
            out[at] = (s[np.arange(len(at)), x[at] - a] - _log_sum(s)) / math.log(10)
    return out


def _scorer(tables, model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using(), one_thread()
        t, (p, z) = tables.value, model.value
        none, row = t.unknown, TaskContext.get().partitionId() << 36
        for batch in chunks(batches):
            beyond, flat, context, group, sizes = t.look(batch.column("text"))
            near = _contexts(context, sizes, t.start)
            logp = class_log_probs(p, z, *near, group) + word_log_probs(p, t, *near, flat)
            logp[flat == none] -= t.rest[group[flat == none]]  # and the join adds log10(count + 1)
            first = np.cumsum(sizes) - sizes
            add = lambda x: np.add.reduceat(x, first) if len(first) else np.empty(0)  # noqa: B023, E731
            doc, words = np.repeat(np.arange(len(sizes)), sizes)[flat == none], beyond.dictionary_encode()
            pairs, times = np.unique(doc * len(words.dictionary) + words.indices.to_numpy(), return_counts=True) if len(doc) else (doc, doc)
            doc, word = np.divmod(pairs, max(1, len(words.dictionary)))
            n = batch.num_rows
            tail = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), pa.StructArray.from_arrays([words.dictionary.take(pa.array(word)), pa.array(times, pa.int64())], ["w", "f"]))
            known = add((flat != none).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("held_out"), pa.array(np.arange(row, row + n)), pa.array(sizes, pa.int64()), pa.array(known.astype(np.int64)), pa.array(add(t.base[flat])), pa.array(add(logp)), tail], ["k", "held_out", "row", "n_tokens", "known", "base", "logp", "tail"])
            row += n

    return run


def scored(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Rows whose crc32(key as text) mod 7 is 2 are held out of training (a null
    key counts as empty text).  A null text is the end alone.  Repeated rows
    count and are scored each.  Without training rows every word is unknown.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("k"), "text", (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % FOLDS == FOLD).alias("held_out"))
    learn = rows.where("not held_out")
    counts = stored(word_counts(learn), "counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    least, head = _head(counts, max(HEAD, int(n**COUNTED)))

    def tail(buckets: int) -> dict:
        each = counts.where(F.col("c") < least).groupBy((F.crc32(F.expr(f"substring(w, -{SUFFIX}, {SUFFIX})")) % buckets).alias("b"))
        return {r["b"]: (r["v"], r["n"]) for r in each.agg(F.count("*").alias("v"), F.sum("c").alias("n")).collect()}  # a row for each class

    tables = spark.sparkContext.broadcast(Tables(head, n, v, max(VECTORS, int(n**GROWTH)), tail))
    p = train(learn, tables, n)
    model = spark.sparkContext.broadcast((p, normalisers(p)))
    ddl = f"k {kind}, held_out boolean, row long, n_tokens long, known long, base double, logp double, tail array<struct<w: binary, f: long>>"
    part = stored(rows.mapInArrow(_scorer(tables, model), ddl), "scores")
    words = part.select("row", F.explode("tail").alias("x")).select("row", "x.w", "x.f")
    c = F.coalesce("c", F.lit(0))
    rare = words.join(counts.where(F.col("c") < least), "w", "left").groupBy("row").agg(F.sum(F.when(c > 0, F.col("f")).otherwise(0)).alias("k2"), F.sum(F.col("f") * F.log10((c + 1) / F.lit(float(n + v + 1)))).alias("b2"), F.sum(F.col("f") * F.log10(c + F.lit(1.0))).alias("s2"))
    add = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return part.drop("tail").join(rare, "row", "left").select(F.col("k").alias(key), "held_out", "n_tokens", add("known", "k2").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), add("base", "b2").alias("base_score"), add("logp", "s2").alias("score"))
