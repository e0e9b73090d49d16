"""Token-ID output: a content-addressed store of chunks, document recipes and Merkle manifests.

Each document's id stream (its end id included) is cut where a rolling hash of
``WINDOW`` ids has its lowest bits zero, within a least and a largest length.
A chunk's address is the BLAKE2b digest of its ids.  The store is three Parquet
tables under one folder:

* ``objects``: rows of kind 0 are chunks (digest, n, payload), each digest once;
  the payload is little-endian ids, two bytes each where
  they fit, after their width as a digit.  Rows of kind 1 are documents in no order, from which
  recipes are made;
* ``recipes``: (index, doc_id, doc, start, n_tokens, leaf, chunks), files and rows
  in ascending doc_id order, nulls first; ``start`` counts all ids before it;
* ``manifest``: (level, node, hash), a Merkle tree of fan-in ``FAN`` over the
  recipes; a leaf is the hash of all that its recipe says.

``doc`` is a digest of the whole id stream; documents that share a doc_id are in
its order.  Readers put documents together by their recipes, and verify: chunks
against their addresses, sums against recipes, recipes against the manifest.
"""

from __future__ import annotations

import gc
import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lodestone.llm.common import MEMOS, chunks, mix, release, shared_path, stored, tidy, using, windows

END_ID = 1
WINDOW, LEAST, MASK, LARGEST = 16, 64, 0xFF, 2048
MEMO, MEMO_BYTES, SEEN, FAN = 400_000, 64_000_000, 100_000, 1024
CHARACTERS, PIECE = 8_000_000, 65_536
_MARKS, RUN = b".,!?;:$%&*#|", 8
_IS_MARK = np.zeros(256, bool)
_IS_MARK[list(_MARKS)] = True
_ENCODERS: dict = {}
MEMOS.append(_ENCODERS)


class Encoder:
    """Ids of texts, little-endian 32-bit; keeps the ids of up to ``MEMO`` words and ``MEMO_BYTES``.

    The tokenizer (NFC, lower case, letters or digits or others as pieces, BPE
    within a piece) never joins characters across white space, so a text's ids
    are those of its words one after another; the library encodes each distinct
    word once, and Arrow splits texts, numbers their words, finds them in the
    memo and strings ids together: a word is no Python object on the way.
    ``by_word=False`` encodes whole texts, for tokenizers that see white space.
    """

    def __init__(self, path: str, by_word: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads only cost on short words
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.by_word = Tokenizer.from_file(path), by_word
        #: The memo: words, their ids, and in how many lookups each was met lately.
        self.words, self.ids, self.uses = pa.array([], pa.binary()), pa.array([], pa.large_binary()), np.empty(0, np.int64)
        #: Words that are being learnt, and their ids.
        self.fresh: list[tuple[pa.Array, pa.Array]] = []
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.mark = (ids("|") or [-1])[0]
        #: The same model for words of ``_plain``, as bytes, between spaces: they need no normalising.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer, self.plain.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        #: Whether letters are lowered and marks between white space or after a letter are a piece of their own.
        self.lowers = by_word and ids("a, | b") == ids("a,") + [self.mark] + ids("b") and ids("Abc") == ids("abc") and ids("a b") == ids("a") + ids("b")
        marks = [m + n for m in _MARKS.decode() for n in ("", *_MARKS.decode(), ",***", "###")]
        self.lowers = self.lowers and all(ids(t + m) == ids(t) + ids(m) for t in ("abc", "ab\u00e9", "a\u0101") for m in marks)
        wide = [chr(c) for c in range(0xDF, 0x100) if c != 0xF7]
        text = " ".join(["lower case ascii letters qxzjv", "".join(wide), *wide, *(f"a{c}b" for c in wide)])
        self.lowers = self.lowers and self.plain.encode(_as_characters(text.encode()), add_special_tokens=False).ids == ids(text) and self.last[ids(text)].sum() == len(text.split())

    def streams(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: none), each with the end id after it, and where each text's stop."""
        if self.by_word:
            split = pc.ascii_split_whitespace(self._lowered(pc.fill_null(texts, "")))
            coded, stops = split.flatten().dictionary_encode(), split.offsets.to_numpy()
            table, index, stops = self._lookup(coded.dictionary), coded.indices.to_numpy(), stops[1:] - stops[0]
        else:
            encoded = self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)
            table, index, stops = pa.array([_raw(e.ids) for e in encoded], pa.large_binary()), np.arange(len(texts)), np.arange(1, len(texts) + 1)
        at = stops + np.arange(len(texts))
        places = np.full(len(index) + len(texts), len(table), np.int32)  # the end id is one word more
        inner = np.ones(len(places), bool)
        inner[at] = False
        places[inner] = index
        flat, bounds = _flat(pa.concat_arrays([table, pa.array([_raw([end])], pa.large_binary())]).take(pa.array(places)))
        return flat, bounds[at + 1]

    def _lowered(self, texts: pa.Array) -> pa.Array:
        """Texts in lower case where the tokenizer lowers them anyway; not if a special token's brackets are about."""
        if not self.lowers:
            return texts
        special = pc.match_substring(texts, "<|")
        lowered = pc.ascii_lower(texts)
        return pc.if_else(special, texts, lowered) if pc.any(special).as_py() else lowered

    @property
    def places(self) -> dict[bytes, int]:
        """The memo's words and their places in ``ids``."""
        return {w: i for i, w in enumerate(self.words.to_pylist())}

    def _lookup(self, distinct: pa.Array) -> pa.Array:
        """The ids of each of these words; those not in the memo are learnt."""
        if not self.lowers:
            return self._ids_of(distinct.cast(pa.binary()))
        words, marks, on = _unmarked(distinct)
        coded = marks.dictionary_encode()  # a few runs of marks are words too
        ids = self._ids_of(pa.concat_arrays([words, coded.dictionary]))
        index = np.full(len(words), len(ids))
        index[on] = len(words) + coded.indices.to_numpy()
        after = pa.concat_arrays([ids, pa.array([b""], pa.large_binary())]).take(pa.array(index))
        return pc.binary_join_element_wise(ids.slice(0, len(words)), after, pa.scalar(b"", pa.large_binary()))

    def _ids_of(self, words: pa.Array) -> pa.Array:
        coded = words.dictionary_encode()
        cores = coded.dictionary
        found = pc.fill_null(pc.index_in(cores, value_set=self.words), -1).to_numpy().astype(np.int64)
        fresh = np.flatnonzero(found < 0)
        if len(fresh):
            found[fresh] = self._learn(cores.take(pa.array(fresh)))
        self.uses[found] += 1
        out = self.ids.take(pa.array(found[coded.indices.to_numpy()]))
        if len(self.words) > MEMO or self.words.nbytes + self.ids.nbytes > MEMO_BYTES:
            self._forget()
        return out

    def _forget(self) -> None:
        """Half of the memo stays: words met most often, the latest of equals."""
        keep = np.sort(np.lexsort((np.arange(len(self.uses)), self.uses))[len(self.uses) - min(len(self.uses), MEMO) // 2 :])
        self.words, self.ids, self.uses = self.words.take(pa.array(keep)), self.ids.take(pa.array(keep)), self.uses[keep] // 2

    def _learn(self, new: pa.Array) -> np.ndarray:
        """Puts words into the memo; their places."""
        plain, had = _plain(new) if self.lowers else np.zeros(len(new), bool), len(self.words)
        kinds: tuple[list, ...] = [], [], []
        order = [np.flatnonzero(plain)]
        simple = new.take(pa.array(order[0]))
        for i in range(0, len(simple), 2_000):
            part = simple.slice(i, 2_000)
            text = pc.binary_join(pa.ListArray.from_arrays([0, len(part)], part), b" ")[0].as_py()
            ids = np.array(self.plain.encode_batch_fast([_as_characters(text)], add_special_tokens=False)[0].ids, "<u4")
            if not self._put(part, ids, np.flatnonzero(self.last[ids]) + 1):
                kinds[2].extend(part.to_pylist())
        for w in new.filter(pa.array(~plain)).to_pylist():
            kinds[2 if not self.lowers or not w else 0 if w.decode("utf-8", "replace").isalpha() else 1 if b"|" not in w else 2].append(w)
        for kind, learn in ((0, self._learn_letters), (1, self._learn_marked)):
            for i in range(0, len(kinds[kind]), 2_000):
                part = kinds[kind][i : i + 2_000]
                if not learn(part):
                    kinds[2].extend(part)
        for i in range(0, len(kinds[2]), 20_000):
            part = kinds[2][i : i + 20_000]
            encoded = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)
            self.fresh.append((pa.array(part, pa.binary()), pa.array([_raw(e.ids) for e in encoded], pa.large_binary())))
        learnt = pa.concat_arrays([w for w, _ in self.fresh])
        self.words, self.ids = pa.concat_arrays([self.words, learnt]), pa.concat_arrays([self.ids, *(x for _, x in self.fresh)])
        self.uses = np.r_[self.uses, np.zeros(len(new), np.int64)]
        self.fresh.clear()
        return had + pc.index_in(new, value_set=learnt).to_numpy()

    def _ids(self, part: list[bytes], between: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([between.join(part).decode("utf-8", "replace")], add_special_tokens=False)[0].ids, "<u4")

    def _put(self, part: pa.Array, ids: np.ndarray, stops: np.ndarray) -> bool:
        """Ids of several words: whether there are as many pieces as words; if so, they are kept."""
        if len(stops) != len(part):
            return False
        self.fresh.append((part, pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(4 * np.r_[0, stops].astype(np.int64)), pa.py_buffer(ids)])))
        return True

    def _learn_letters(self, part: list[bytes]) -> bool:
        """Words of letters only: each is one piece, whose last id ends a word."""
        ids = self._ids(part, b" ")
        return self._put(pa.array(part, pa.binary()), ids, np.flatnonzero(self.last[ids]) + 1)

    def _learn_marked(self, part: list[bytes]) -> bool:
        """Words without a bar, with a bar between them."""
        ids = self._ids(part, b" | ")
        bar = ids == self.mark
        at = np.flatnonzero(bar)
        return self._put(pa.array(part, pa.binary()), ids[~bar], np.r_[at - np.arange(len(at)), len(ids) - len(at)])


def _raw(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _flat(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows one after another, and where each row's begin, with the end."""
    bounds = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1] // 4
    raw = ids.buffers()[2]
    return np.frombuffer(raw, "<u4", count=int(bounds[-1])) if raw else np.empty(0, "<u4"), bounds


def _bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words one after another, and where each word's begin, with the end."""
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    return np.frombuffer(words.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def _unmarked(words: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Words without the marks that follow their last letter, those runs of marks, and whose they are: a run is a piece of its own.

    Letters are those of ASCII and of U+00C0 to U+024F but U+0130, whose lower case ends in a combining dot.  Words that
    end in more than ``RUN`` marks stay as they are.
    """
    raw, at = _bytes(words)
    first, stop, n = at[:-1], at[1:], np.zeros(len(words), np.int64)
    back = lambda i, k: np.where(stop[i] - first[i] >= k, raw[np.maximum(stop[i] - k, 0)], 0) if len(raw) else np.zeros(len(i), np.uint8)
    left = np.arange(len(words))
    for k in range(1, RUN + 1):
        left = left[_IS_MARK[back(left, k)]]
        n[left] = k
    on = np.flatnonzero(n)
    x, lead = back(on, n[on] + 1), back(on, n[on] + 2)
    wide = (x >= 0x80) & (x < 0xC0) & (((lead >= 0xC3) & (lead <= 0xC8)) | ((lead == 0xC9) & (x < 0x90))) & ~((lead == 0xC3) & ((x == 0x97) | (x == 0xB7))) & ~((lead == 0xC4) & (x == 0xB0))
    letter = ((x >= 97) & (x <= 122)) | ((x >= 65) & (x <= 90)) | wide
    n[on[~letter]] = 0
    on = on[letter]
    off = np.r_[0, np.cumsum(n)]
    runs = np.r_[0, np.cumsum(n[on])]
    mark = np.arange(runs[-1]) - np.repeat(runs[:-1] - stop[on] + n[on], n[on])  # where the marks are
    kept = np.ones(len(raw), bool)
    kept[mark] = False
    return _binary(at - off, raw[kept]), _binary(runs, raw[mark]), on


def _binary(at: np.ndarray, raw: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])


def _plain(words: pa.Array) -> np.ndarray:
    """Which words are of a to z and U+00DF to U+00FF but U+00F7: one piece each that no normaliser changes."""
    raw, at = _bytes(words)
    inner = np.zeros(len(raw) + 1, bool)  # whether a byte's left neighbour is in its word
    inner[:-1] = True
    inner[at] = False
    wide = np.zeros(len(raw) + 1, bool)  # second bytes of two
    wide[1:-1] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x9F) & (raw[1:] <= 0xBF) & (raw[1:] != 0xB7)
    wide &= inner
    good = np.r_[0, np.cumsum(((raw >= 97) & (raw <= 122)) | wide[:-1] | wide[1:])]
    size = np.diff(at)
    return (good[at[1:]] - good[at[:-1]] == size) & (size > 0)


#: The characters that byte-level models have for bytes of words of ``_plain``, where they are not Latin-1's.
_CHARACTERS = {"\x9f": "\u0141", "\xa0": "\u0142", "\xad": "\u0143"}


def _as_characters(text: bytes) -> str:
    out = text.decode("latin-1")
    for byte, character in _CHARACTERS.items() if not text.isascii() else ():
        out = out.replace(byte, character)
    return out


def encoder(path: str, by_word: bool) -> Encoder:
    if (path, by_word) not in _ENCODERS:
        _ENCODERS[path, by_word] = Encoder(path, by_word)
    return _ENCODERS[path, by_word]


def breaks(ids: np.ndarray) -> np.ndarray:
    """Places after a window of ids whose rolling hash has its lowest bits zero; a window may reach over documents."""
    found = []
    for i in range(0, max(len(ids) - WINDOW + 1, 0), PIECE):  # the windows that start in a piece; eight bytes an id and step are much for all
        rolled = windows(mix(ids[i : i + PIECE + WINDOW - 1].astype(np.uint64)), WINDOW, 0x2545F4914F6CDD1D)
        found.append(np.flatnonzero((rolled & np.uint64(MASK)) == 0) + (i + WINDOW))
    return np.concatenate(found) if found else np.empty(0, np.int64)


def cuts(n: int, at: Iterable[int]) -> list[int]:
    """Where the chunks of a stream of n ids end; at: its breaks, ascending."""
    out, last = [], 0
    for x in at:
        while x - last > LARGEST:
            last += LARGEST
            out.append(last)
        if x - last >= LEAST:
            out.append(x)
            last = x
    while n - last > LARGEST:
        last += LARGEST
        out.append(last)
    if last < n:
        out.append(n)
    return out


def pack(ids: bytes) -> tuple[bytes, int]:
    """The ids at the width they need, and that width."""
    a = np.frombuffer(ids, "<u4")
    return (a.astype("<u2").tobytes(), 2) if not len(a) or int(a.max()) < 65536 else (ids, 4)


def unpack(payload: bytes) -> bytes:
    return np.frombuffer(payload, "<u2", offset=1).astype("<u4").tobytes() if payload[:1] == b"2" else payload[1:]


def _unpacked(payloads: pa.Array) -> Iterator[bytes | memoryview]:
    """``unpack`` of each payload; of all at once where all ids are of two bytes."""
    raw, at = _bytes(payloads)
    size = np.diff(at)
    if not len(size) or (size % 2 == 0).any() or (raw[at[:-1]] != ord("2")).any():
        yield from map(unpack, payloads.to_pylist())
        return
    inner = np.ones(len(raw), bool)
    inner[at[:-1]] = False
    ids = memoryview(raw[inner].view("<u2").astype("<u4")).cast("B")
    stops = (2 * (at - np.arange(len(at)))).tolist()
    yield from (ids[a:b] for a, b in zip(stops, stops[1:]))


def _placer(path: str, by_word: bool, end_id: int, schema: pa.Schema):
    """A row for each chunk that is new to the task, and one for each document; ``deal`` spreads the rows."""

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using(_ENCODERS)
        gc.disable()  # nothing here is cyclic, and the memo is large
        enc, seen = encoder(path, by_word), set()
        task, row = TaskContext.get().partitionId(), 0
        for batch in chunks(batches, limit=CHARACTERS):
            digests, sizes, payloads, docs, lists = ([] for _ in range(5))
            stream, ends = enc.streams(batch.column("text"), end_id)
            at, starts = breaks(stream), np.r_[0, ends[:-1]]
            firsts = np.searchsorted(at, starts + WINDOW), np.searchsorted(at, ends, side="right")  # breaks of windows within a document
            ids = memoryview(stream).cast("B")
            short = memoryview(stream.astype("<u2")).cast("B") if not len(stream) or int(stream.max()) < 65536 else None
            for first, last, low, high in zip(starts.tolist(), ends.tolist(), *(x.tolist() for x in firsts)):
                start, parts = first, []
                packed, width = (short[2 * first : 2 * last], 2) if short else pack(ids[4 * first : 4 * last])
                for stop in cuts(last - first, (at[low:high] - first).tolist()) if last - first > LEAST else (last - first,):
                    stop += first
                    digest = blake2b(ids[4 * start : 4 * stop], digest_size=16).digest()
                    parts.append(digest)
                    if digest not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(digest)
                        digests.append(digest), sizes.append(stop - start), payloads.append(b"%d" % width + packed[width * (start - first) : width * (stop - first)])
                    start = stop
                docs.append(blake2b(ids[4 * first : 4 * last], digest_size=16).digest()), lists.append(parts)
            none = lambda k, i: pa.nulls(k, schema.types[i])
            k = len(digests)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), pa.array(digests, pa.binary()), none(k, 2), none(k, 3), pa.array(sizes, pa.int64()), none(k, 5), pa.array(payloads, pa.binary())], schema=schema)
            k = batch.num_rows
            names = _binary(np.arange(k + 1) * 16, np.c_[np.full(k, task), row + 1 + np.arange(k)].astype("<i8").reshape(-1).view(np.uint8))
            row += k
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), names, batch.column(0), pa.array(docs, pa.binary()), pa.array(ends - starts, pa.int64()), pa.array(lists, pa.list_(pa.binary())), none(k, 6)], schema=schema)
            ids = short = packed = stream = None
            release()  # else what each batch freed stays beside what the next one takes
        gc.enable()

    return run


@tidy
def _first_of_each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of equal chunks of a partition the first; all documents."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for name in batch.column("deal").to_pylist():
            keep.append(name not in seen)
            seen.add(name)
        yield batch.filter(pa.array(keep, pa.bool_()))


@tidy
def _number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to the rows of a sorted part its number, and the ids and documents of it before each row."""
    ids = docs = 0
    part = TaskContext.get().partitionId()
    for batch in batches:
        upto = ids + np.cumsum(batch.column("n").to_numpy())
        n = batch.num_rows
        extra = [np.full(n, part, np.int64), upto - batch.column("n").to_numpy(), docs + np.arange(n)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, extra)], [*batch.schema.names, "part", "ids_before", "docs_before"])
        ids, docs = int(upto[-1]) if n else ids, docs + n


@tidy
def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = []
        for digest, n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _unpacked(batch.column(2))):
            if blake2b(ids, digest_size=16).digest() != digest or len(ids) != 4 * n:
                raise ValueError(f"chunk {digest.hex()} is damaged")
            sums.append(zlib.crc32(ids))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.int64())], ["digest", "read", "crc"])


@cache
def _zeros_matrices() -> np.ndarray:
    """matrices[i][b]: what bit b of a CRC-32 becomes after 2**i further zero bytes."""
    one = [0xEDB88320] + [1 << b for b in range(31)]  # one zero bit: bit 0 gives the polynomial
    apply = lambda m, v: np.bitwise_xor.reduce([m[b] for b in range(32) if v >> b & 1] or [0])
    square = lambda m: [int(apply(m, m[b])) for b in range(32)]
    m = square(square(square(one)))
    out = []
    for _ in range(40):
        out.append(m)
        m = square(m)
    return np.array(out, np.uint32)


def shift_crc(crc: np.ndarray, zero_bytes: np.ndarray) -> np.ndarray:
    """Each CRC-32 after so many more zero bytes: crc(A + B) = shift_crc(crc(A), len(B)) ^ crc(B)."""
    crc, left = crc.astype(np.uint32), zero_bytes.astype(np.int64)
    for m in _zeros_matrices():
        on = np.flatnonzero(left & 1)
        if len(on):
            v, out = crc[on], np.zeros(len(on), np.uint32)
            for b in range(32):
                out ^= np.where(v >> np.uint32(b) & np.uint32(1), m[b], np.uint32(0))
            crc[on] = out
        left >>= 1
        if not left.any():
            break
    return crc


@tidy
def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the lengths and checksums of a document's chunks, in order, together."""
    for batch in batches:
        lists = batch.column("parts")
        sizes = pc.list_value_length(lists).to_numpy()
        flat = lists.flatten()
        n, crc = (pc.struct_field(flat, i).to_numpy().astype(np.int64) for i in (1, 2))
        doc = np.repeat(np.arange(len(sizes)), sizes)
        upto = np.cumsum(n)
        ends = np.cumsum(sizes)
        left = upto[ends - 1][doc] - upto if len(n) else n
        moved = shift_crc(crc, 4 * left)
        total = np.bincount(doc, weights=n, minlength=len(sizes)).astype(np.int64)
        whole = np.bitwise_xor.reduceat(moved, ends - sizes).astype(np.int64) if len(n) else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "parts"), pa.array(total), pa.array(whole)], [*(c for c in batch.schema.names if c != "parts"), "got", "ids_crc32"])


def _leaf() -> Column:
    """What a recipe says, hashed."""
    return F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00")), "index", "start", "n_tokens", F.hex("doc"), F.array_join(F.transform("chunks", F.hex), ",")), 256)


def _parents(nodes: DataFrame) -> DataFrame:
    """The next level of (node, hash)."""
    return nodes.groupBy(F.floor(F.col("node") / FAN).alias("node")).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", "hash"))), lambda x: x["hash"]), ""), 256).alias("hash"))


def write_store(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", by_word: bool = True, end_id: int = END_ID) -> None:
    """Encodes every whole text (null: empty) and writes objects, recipes and manifest under ``path``."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    ddl = f"kind int, deal binary, doc_id {kind}, doc binary, n long, chunks array<binary>, payload binary"
    schema = to_arrow_schema(spark.createDataFrame([], ddl).schema)
    made = docs.select(key, "text").mapInArrow(_placer(tokenizer, by_word, end_id, schema), ddl)
    made = made.repartition("deal").mapInArrow(_first_of_each, ddl)
    made.write.option("compression", "snappy").parquet(f"{path}/objects")

    order = [F.col("doc_id").asc_nulls_first(), F.col("doc")]
    lists = spark.read.schema(ddl).parquet(f"{path}/objects").where("kind = 1").select("doc_id", "doc", "n", "chunks")
    lists = lists.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_number, f"doc_id {kind}, doc binary, n long, chunks array<binary>, part long, ids_before long, docs_before long")
    lists = stored(lists, "lists")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = lists.groupBy("part").agg(F.sum("n").alias("ids"), F.count("*").alias("docs"))
    parts = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("ids"), F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("docs"))
    recipes = lists.join(F.broadcast(parts), "part")  # a row for each partition
    recipes = recipes.select((F.col("docs") + F.col("docs_before")).alias("index"), "doc_id", "doc", (F.col("ids") + F.col("ids_before")).alias("start"), F.col("n").alias("n_tokens"), "chunks").withColumn("leaf", _leaf())
    recipes.repartitionByRange("index").sortWithinPartitions("index").write.option("compression", "zstd").parquet(f"{path}/recipes")

    level, nodes, rows = 0, spark.read.parquet(f"{path}/recipes").select(F.col("index").alias("node"), F.col("leaf").alias("hash")), None
    while rows is None or rows > 1:
        level += 1
        _parents(nodes).select(F.lit(level).alias("level"), "node", "hash").write.mode("append").parquet(f"{path}/manifest")
        nodes = spark.read.parquet(f"{path}/manifest").where(F.col("level") == level).drop("level")
        rows = nodes.count()


def verify_recipes(spark: SparkSession, path: str) -> str | None:
    """Works the Merkle tree out again from the recipes; raises ValueError if it is not the manifest's, else returns the root (None without recipes)."""
    nodes = spark.read.parquet(f"{path}/recipes").select(F.col("index").alias("node"), _leaf().alias("hash"))
    manifest = stored(spark.read.parquet(f"{path}/manifest"), "manifest")
    top = manifest.agg(F.max("level")).first()[0] or 0
    for level in range(1, top + 1):
        nodes = stored(_parents(nodes), "nodes")
        there = manifest.where(F.col("level") == level).select("node", F.col("hash").alias("want"))
        if not nodes.join(there, "node", "full").where(~F.col("hash").eqNullSafe(F.col("want"))).isEmpty():
            raise ValueError(f"recipes and manifest differ at level {level}")
    root = nodes.limit(2).collect() if top else []
    if len(root) > 1 or (not top and not nodes.isEmpty()):
        raise ValueError("the manifest has no root")
    return root[0]["hash"] if root else None


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, merkle_leaf) of each document, from the files alone.

    Every stored chunk is unpacked and held against its address, and the recipes
    against the manifest; a document's checksum is put together from those of
    the chunks its recipe names.
    """
    verify_recipes(spark, path)
    sums = spark.read.parquet(f"{path}/objects").where("kind = 0").select(F.col("deal").alias("digest"), "n", "payload").mapInArrow(_verify, "digest binary, read long, crc long")
    recipes = spark.read.parquet(f"{path}/recipes")
    kind = recipes.schema["doc_id"].dataType.simpleString()
    each = recipes.select("index", F.posexplode("chunks").alias("seq", "digest")).join(sums, "digest", "left")
    each = each.groupBy("index").agg(F.sort_array(F.collect_list(F.struct("seq", F.coalesce("read", F.lit(-1)).alias("read"), F.coalesce("crc", F.lit(0)).alias("crc")))).alias("parts"))
    each = recipes.select("index", "doc_id", "start", "n_tokens", F.col("leaf").alias("merkle_leaf")).join(each, "index", "left")
    each = each.mapInArrow(_sums, f"index long, doc_id {kind}, start long, n_tokens long, merkle_leaf string, got long, ids_crc32 long")
    right = F.when(F.col("got") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a recipe's chunk is missing")).cast("long"))
    return each.select("doc_id", "start", right.alias("n_tokens"), "ids_crc32", "merkle_leaf")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids array<int>): every document put together again from its recipe."""
    verify_recipes(spark, path)
    payloads = spark.read.parquet(f"{path}/objects").where("kind = 0").select(F.col("deal").alias("digest"), "payload")
    recipes = spark.read.parquet(f"{path}/recipes")
    parts = recipes.select("index", F.posexplode("chunks").alias("seq", "digest")).join(payloads, "digest")

    def build(batches):
        for batch in batches:
            ids = [[i for p in row for i in np.frombuffer(unpack(p["payload"]), "<u4").tolist()] for row in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("index"), pa.array(ids, pa.list_(pa.int32()))], ["index", "ids"])

    whole = parts.groupBy("index").agg(F.sort_array(F.collect_list(F.struct("seq", "payload"))).alias("parts")).mapInArrow(build, "index long, ids array<int>")
    return recipes.join(whole, "index").select("doc_id", "start", "ids")


def token_table(docs: DataFrame, tokenizer: str, key: str = "doc_id", **how) -> DataFrame:
    """Writes the store in the shared folder and reads it back; a null text is the end id alone, repeated rows stay."""
    path = shared_path(docs.sparkSession, "tokens")
    write_store(docs, path, tokenizer, key, **how)
    return read_store(docs.sparkSession, path)
