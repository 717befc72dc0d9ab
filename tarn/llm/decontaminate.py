"""Benchmark decontamination: documents that hold a benchmark item, exactly or with a few edits.

Texts are compared as their ASCII letters and digits in lower case plus all non-ASCII bytes, so case,
spaces and punctuation do not count. A document is contaminated by an item of n such bytes if some
stretch of it is within ``max_edits(n)`` edits (a tenth of n, rounded down) of the item.

1. Item-sized windows. Items fall into classes of like length. A stretch within k edits holds one of the item's
   k + 1 equal pieces unchanged, so windows of a class are laid where such a piece stands, at the distance that
   the piece has from its item's start. This loses nothing; it says where a window lies, not whose it is. With
   ``sieve=False`` every offset gets a window of every class instead.
2. CGK. Each window and item walks through ``WALKS`` random walks that copy a byte and step on or stay by
   a shared random bit; edit distance becomes Hamming distance between walks.
3. Bit sampling. ``TABLES`` tables a walk hash ``SAMPLED`` steps each (fewer of short walks), from the first quarter, the first half or
   all of the walk; a window meets the items of its class that are in its buckets, and no others. The tests
   measure the share of pairs at the bound that meet: 0.95 or more.
4. Each pair that met is verified: its stretch must have as many of the item's runs of ``_GAP`` bytes as k edits
   leave at least (n + 1 - 8 * (k + 1)), and then be within k edits by exact distance with free ends.

Rows are independent: no shuffle. Items are broadcast in blocks of at most ``BLOCK_BYTES``; a larger
benchmark takes more passes over the documents, never a larger broadcast.

Defined results: null or empty texts and items match nothing, nor do items of fewer than ``LEAST`` bytes, which
any text holds by chance; equal items all report; each row of a repeated document reports; of several stretches
the one of fewest edits counts, then the first; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

LEAST = 8
RATIO = 0.10
#: Lengths of a class: from a bound up to ``GROWTH`` times that.
GROWTH = 1.25
WALKS, TABLES, SAMPLED = 6, 40, 5
BLOCK_BYTES = 4 << 20
#: Windows, and places of pieces, looked at together; bounds on memory, not on what is looked at.
CHUNK, SPREAD_CHUNK = 1 << 13, 1 << 20
_GAP = 8  # bytes between texts in a buffer, and of the runs that a check counts

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_DROP = bytes(b for b in range(128) if not chr(b).isalnum())


def squeeze(text: bytes) -> bytes:
    """Lower-case letters and digits, and all bytes beyond ASCII."""
    return text.translate(_LOWER, _DROP)


def max_edits(n: int) -> int:
    """Edits that an item of n bytes may be away."""
    return int(n * RATIO + 1e-9)


def class_of(n: int) -> int:
    return int(math.log(n / LEAST) / math.log(GROWTH) + 1e-9)


def class_size(c: int) -> int:
    """The least length of a class."""
    return math.ceil(LEAST * GROWTH**c - 1e-9)


def edit_distance(item: bytes, text: bytes) -> tuple[int, int]:
    """(least distance of the item to any stretch of the text, end of that stretch); bit-parallel."""
    n = len(item)
    if not n:
        return 0, 0
    peq: dict[int, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score, best, end = mask, 0, n, n, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & mask, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & mask, (mh << 1) & mask
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def coins(steps: int, walk: int) -> np.ndarray:
    """The shared random bits: for each step and byte, whether the walk goes on."""
    return np.random.default_rng([7, walk]).integers(0, 2, (steps, 256), dtype=np.int8)


def cgk(buffer: np.ndarray, start: np.ndarray, steps: int, walk: int) -> np.ndarray:
    """Walks (step, window) from places of a buffer, side by side; its last byte goes on for ever."""
    go = coins(steps, walk)
    at = start.astype(np.int64)
    out = np.empty((steps, start.size), np.uint8)
    for j in range(steps):
        c = buffer.take(at, mode="clip", out=out[j])
        at += go[j].take(c)
    return out


_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def grams(b: np.ndarray, q: int) -> np.ndarray:
    """A value for each run of q bytes, 9 at most: the bytes themselves, of 9 a hash."""
    if b.size < q:
        return np.empty(0, np.uint64)
    v = np.zeros(b.size - q + 1, np.uint64)
    for k in range(min(q, 8)):
        v |= b[k : b.size - q + 1 + k].astype(np.uint64) << np.uint64(8 * k)
    return v if q < 9 else longer(v, b)


def longer(v: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The values of runs of 9 bytes from those of 8."""
    n = max(0, b.size - 8)
    return v[:n] * _SPREAD + b[8 : 8 + n]


class Known:
    """Sorted distinct numbers with a bitmap before them."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.shift = np.uint64(64 - min(26, max(16, int(values.size * 64 + 1).bit_length())))
        self.bits = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bits[(values * _SPREAD) >> self.shift] = True

    def find(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in v of known numbers, their numbers here)."""
        at = np.flatnonzero(self.bits[(v * _SPREAD) >> self.shift])
        i = np.minimum(np.searchsorted(self.values, v[at]), max(0, self.values.size - 1))
        ok = self.values[i] == v[at] if self.values.size else np.zeros(at.size, bool)
        return at[ok], i[ok]


class Pieces:
    """Unchanged pieces of q bytes: in which classes, and how far from the start, items have them."""

    def __init__(self, q: int, rows: list[tuple[int, int, int]]):
        value, cls, offset = zip(*sorted(set(rows)))
        self.q, self.cls, self.offset = q, np.array(cls, np.int64), np.array(offset, np.int64)
        names, first = np.unique(np.array(value, np.uint64), return_index=True)
        self.known, self.first = Known(names), np.append(first, len(value))

    def windows(self, buffer: np.ndarray, runs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(class, place, start) of the windows that pieces in the buffer ask for; ``runs`` are its 8-byte values."""
        at, value = self.known.find(runs if self.q == 8 else longer(runs, buffer) if self.q == 9 else grams(buffer, self.q))
        many = int(np.diff(self.first).max())
        for lo in range(0, at.size, max(1, SPREAD_CHUNK // many)):
            hi = lo + max(1, SPREAD_CHUNK // many)
            n = self.first[value[lo:hi] + 1] - self.first[value[lo:hi]]
            slot = np.repeat(self.first[value[lo:hi]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            place = np.repeat(at[lo:hi], n)
            yield self.cls[slot], place, place - self.offset[slot]


class Items:
    """One block of items: pieces, walks and buckets."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        rows = [(i, t) for i, t in ((i, squeeze(t or b"")) for i, t in rows) if len(t) >= LEAST]
        self.ids, self.texts = [i for i, _ in rows], [t for _, t in rows]
        self.sizes = [len(t) for t in self.texts]
        self.edits = [max_edits(n) for n in self.sizes]
        self.runs = [np.unique(grams(np.frombuffer(t, np.uint8), _GAP)) for t in self.texts]
        self.left = [n + 1 - _GAP * (k + 1) for n, k in zip(self.sizes, self.edits)]
        of = np.array([class_of(n) for n in self.sizes], np.int64)
        self.classes = np.unique(of).tolist()
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for t, k, c in zip(self.texts, self.edits, of.tolist()):
            q = min(9, len(t) // (k + 1))
            for i in range(k + 1):
                at = i * len(t) // (k + 1)
                pieces.setdefault(q, []).append((int(grams(np.frombuffer(t[at : at + q], np.uint8), q)[0]), c, at))
        self.pieces = [Pieces(q, x) for q, x in sorted(pieces.items())]
        self.buckets: dict[int, tuple[Known, np.ndarray, np.ndarray]] = {}
        for c in self.classes:
            own = np.flatnonzero(of == c)
            buffer, starts = joined([self.texts[i] for i in own])
            keys = np.concatenate([k.astype(np.uint64) | np.uint64(t << 32) for t, k in self.keys(buffer, starts, c)])
            item = np.tile(own, WALKS * TABLES)
            order = np.argsort(keys, kind="stable")
            values, first = np.unique(keys[order], return_index=True)
            self.buckets[c] = Known(values), np.append(first, keys.size), item[order]

    def keys(self, buffer: np.ndarray, starts: np.ndarray, c: int) -> Iterator[tuple[int, np.ndarray]]:
        """(table, bucket of each window) of windows of a class; steps reach about 3/4 of the least item."""
        steps = int(1.5 * class_size(c))
        sampled = min(SAMPLED, steps // 8 + 1)  # of few steps, an edit changes a larger share
        rng = np.random.default_rng([11, c])
        for w in range(WALKS):
            walked = cgk(buffer, starts, steps, w)
            for r in range(TABLES):
                reach = max(sampled, steps >> (2, 1, 0)[r % 3])
                key = np.full(starts.size, rng.integers(0, 1 << 32, dtype=np.uint32), np.uint32)
                for s in rng.choice(reach, sampled, replace=False).tolist():
                    key = (key ^ walked[s]) * np.uint32(0x9E3779B1)
                    key ^= key >> np.uint32(15)
                yield w * TABLES + r, key

    def windows(self, buffer: np.ndarray, runs: np.ndarray, begins: np.ndarray, ends: np.ndarray, sieve: bool) -> dict[int, np.ndarray]:
        """The starts of each class's windows in a buffer of texts."""
        if not sieve:
            every = np.concatenate([np.arange(a, b) for a, b in zip(begins, ends)]) if begins.size else begins
            return {c: every for c in self.classes}
        found: dict[int, list[np.ndarray]] = {}
        for piece in self.pieces:
            for cls, place, start in piece.windows(buffer, runs):
                text = np.searchsorted(begins, place, side="right") - 1
                start = np.maximum(start, begins[text])
                for c in np.unique(cls).tolist():
                    found.setdefault(c, []).append(np.unique(start[cls == c]))
        return {c: np.unique(np.concatenate(x)) for c, x in found.items()}

    def meetings(self, buffer: np.ndarray, starts: np.ndarray, c: int) -> np.ndarray:
        """Distinct (start, item) rows that share a bucket."""
        known, first, item = self.buckets[c]
        out = [np.empty((0, 2), np.int64)]
        for lo in range(0, starts.size, CHUNK):
            some = starts[lo : lo + CHUNK]
            for table, key in self.keys(buffer, some, c):
                at, i = known.find(key.astype(np.uint64) | np.uint64(table << 32))
                if at.size:
                    n = first[i + 1] - first[i]
                    slot = np.repeat(first[i] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                    out.append(np.stack([np.repeat(some[at], n), item[slot]], axis=1))
        return np.unique(np.concatenate(out), axis=0)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(texts side by side with a gap after each, where each begins)."""
    begins = np.cumsum([0] + [len(t) + _GAP for t in texts])[:-1]
    return np.frombuffer(b"".join(t + b"\0" * _GAP for t in texts), np.uint8), begins


def _match(items: Items, texts: list[bytes], sieve: bool = True) -> list[tuple[int, int, int, int, int]]:
    """(row, item, edits, start, end) of the best verified window of each (row, item)."""
    squeezed = [squeeze(t) for t in texts]
    buffer, begins = joined(squeezed)
    runs = grams(buffer, _GAP)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for c, starts in items.windows(buffer, runs, begins, begins + [len(t) for t in squeezed], sieve).items():
        met = items.meetings(buffer, starts, c)
        rows = np.searchsorted(begins, met[:, 0], side="right") - 1
        for r, s, i in zip(rows.tolist(), (met[:, 0] - begins[rows]).tolist(), met[:, 1].tolist()):
            n, k = items.sizes[i], items.edits[i]
            a = max(0, s - 2 * k)
            if items.left[i] > 0:
                own, has = items.runs[i], runs[begins[r] + a : begins[r] + s + n + 3 * k]
                if np.count_nonzero(own[np.minimum(np.searchsorted(own, has), own.size - 1)] == has) < items.left[i]:
                    continue
            d, end = edit_distance(items.texts[i], squeezed[r][a : s + n + 3 * k])
            if d <= k:
                found = d, a + max(0, end - n), a + end
                best[r, i] = min(best.get((r, i), found), found)
    return [(r, i, *v) for (r, i), v in sorted(best.items())]


def _blocks(docs: DataFrame, benchmark: DataFrame) -> list:
    """Broadcasts of item lists, each of about ``BLOCK_BYTES`` at most."""
    items = benchmark.select(F.col("item_id").cast("long").alias("i"), utf8(benchmark["text"]).alias("b")).filter("i is not null").distinct()
    size = items.agg(F.sum(F.length("b")).alias("s")).first()["s"] or 0
    n = max(1, math.ceil(1.25 * size / BLOCK_BYTES))
    sc = docs.sparkSession.sparkContext
    one = lambda b: items.filter(F.pmod(F.xxhash64("i", "b"), F.lit(n)) == b).collect()
    return [sc.broadcast(sorted((r["i"], bytes(r["b"])) for r in one(b))) for b in range(n)]


_MADE: dict = {}


def _items(shipped) -> Items:
    """The block's index, built once a worker."""
    key = id(shipped.value)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = (shipped, Items(shipped.value))
    return _MADE[key][1]


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", sieve: bool = True) -> DataFrame:
    """doc_id, item_id, edits, start, end (in squeezed bytes): one row a document and item found in it."""
    names = ["doc_id", "item_id", "edits", "start", "end"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    src = docs.select(docs[key].cast("long").alias("doc_id"), utf8(docs[text]).alias("b"))

    def one(shipped) -> DataFrame:
        def run(batches):
            own = _items(shipped)
            for batch in slices(batches, "b", 4 << 20):
                ids = batch.column("doc_id").to_pylist()
                found = _match(own, batch.column("b").to_pylist(), sieve) if own.texts else []
                if found:
                    rows = [(ids[r], own.ids[i], d, s, e) for r, i, d, s, e in found]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        return src.mapInArrow(run, "doc_id long, item_id long, edits int, start long, end long")

    return reduce(DataFrame.unionByName, [one(x) for x in _blocks(docs, benchmark)])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns; no shuffle."""
    out = docs
    for shipped in _blocks(docs, benchmark):

        def run(batches, shipped=shipped):
            own = _items(shipped)
            for batch in slices(batches, text, 4 << 20):
                raw = [(x or "").encode() for x in batch.column(text).to_pylist()]
                bad = {r for r, *_ in _match(own, raw)} if own.texts else set()
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
