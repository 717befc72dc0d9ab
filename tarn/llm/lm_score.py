"""Language-model scores from a log-frequency Bloom filter of quantised bigram counts.

Packs. The texts go to the shared folder in rows of about ``PACK_BYTES``, so that what is read twice is the
same both times, however it is split. Learning. Each pack sends every bucket of hashes one block of its distinct
words and one of its distinct bigrams, with their counts in training texts: a hot word is one entry a pack.
Buckets follow from the table's bytes alone (``BUCKET_BYTES`` each), so results do not depend on partitions,
and a bucket is as large at any size of the corpus. A bucket adds its counts up. A bigram bucket makes them a
segment of the filter: a bigram seen once has level 1, one seen c > 1 times level q = 2 + floor(log(c / 2) /
log(BASE)), and it is inserted q times, as (bigram, 0) .. (bigram, q - 1).

Scoring. The filter grows with the corpus, and a broadcast must not; so bigrams come to their segment instead.
There a bigram's level is found by probing (bigram, 0), (bigram, 1), .. until a miss, and each pack gets one
byte a distinct bigram back, and the counts of its words, exact for all words. P(w | h) = MIX * count / c(h) +
(1 - MIX) * P0(w), with P0 the unigram probability of the base score; an unseen context gives P0(w).

Error. ``PROBES`` probes at ``BITS`` bits an entry give an absent (bigram, level) a hit with a probability of
7e-5. Words are told apart by 64 bits, bigrams by 40 bits and their bucket.

Defined results: null, empty and blank texts have the end token only; each input row gives one row, also
when ids repeat; rows with a null id are scored, not held out and not learned from; with no training rows
every count is 0; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, slices, stage, utf8, word_hashes

BASE, PROBES, BITS = math.sqrt(2.0), 14, 20
MIX = 0.3
PACK_BYTES, BUCKET_BYTES = 8 << 20, 8 << 20
LEAST_BUCKETS = 8

_U = np.uint64
END = xxhash.xxh64_intdigest(b"")
_PAIR = _U(0x9E3779B97F4A7C15)
_SHORT = 5  # bytes of a bigram's hash that are sent


def held_out(key: int | None) -> bool:
    return key is not None and zlib.crc32(str(key).encode()) % 10 == 0


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, each followed by an end token; tokens of each text)."""
    h, n = word_hashes(texts)
    return np.insert(h, np.cumsum(n), _U(END)), n + 1


def pair_hashes(h: np.ndarray) -> np.ndarray:
    """Each token's bigram with the token before it; an end token stands before each text."""
    return mix(np.concatenate([h[-1:], h[:-1]]) * _PAIR + h)


def levels_of(count: np.ndarray) -> np.ndarray:
    """Levels as the filter holds them: 0 for none, 1 for a count of 1, then bins a factor of ``BASE`` wide."""
    more = 2 + np.floor(np.log(np.maximum(count, 2) / 2) / math.log(BASE) + 1e-9).astype(np.int64)
    return np.where(count > 1, more, np.minimum(count, 1))


def count_of(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of the whole numbers in its bin."""
    table = [0.0, 1.0]
    for q in range(2, int(level.max(initial=0)) + 1):
        a, b = math.ceil(2 * BASE ** (q - 2) - 1e-9), math.ceil(2 * BASE ** (q - 1) - 1e-9) - 1
        table.append((a + max(a, b)) / 2)
    return np.array(table)[level]


class Filter:
    """A segment of the filter: ``size`` bits."""

    def __init__(self, entries: int):
        self.size = max(64, math.ceil(entries * BITS))
        self.bits = np.zeros(self.size, bool)

    def _seeds(self, h: np.ndarray, level: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = mix(h ^ np.asarray(level, np.uint64) * _U(0xD6E8FEB86659FD93))
        return x >> _U(32), (x & _U(0xFFFFFFFF)) | _U(1)

    def _place(self, a: np.ndarray, b: np.ndarray, probe: int) -> np.ndarray:
        return (((a + b * _U(probe)) & _U(0xFFFFFFFF)) * _U(self.size)) >> _U(32)

    def insert(self, h: np.ndarray, level: int | np.ndarray) -> None:
        a, b = self._seeds(h, level)
        for p in range(PROBES):
            self.bits[self._place(a, b, p)] = True

    def has(self, h: np.ndarray, level: int) -> np.ndarray:
        """Places of the hashes that the filter holds at a level."""
        left = np.arange(h.size)
        a, b = self._seeds(h, level)
        for p in range(PROBES):
            ok = self.bits[self._place(a, b, p)]
            left, a, b = left[ok], a[ok], b[ok]
        return left

    def insert_counts(self, h: np.ndarray, count: np.ndarray) -> None:
        q = levels_of(count)
        for level in range(int(q.max(initial=0))):
            self.insert(h[q > level], level)

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The level of each hash: probes until a miss."""
        out = np.zeros(h.size, np.uint8)
        where, q = np.arange(h.size), 0
        while where.size and q < 255:
            where = where[self.has(h[where], q)]
            q += 1
            out[where] = q
        return out


def _packs(src: DataFrame) -> DataFrame:
    """(pack, size, keys, ends, texts) of rows (k, b): texts side by side, compressed."""
    kinds = pa.schema([("pack", pa.int64()), ("size", pa.int64()), ("keys", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("texts", pa.binary())])

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        keys, texts, size = [], [], 0

        def close():
            whole = b"".join(texts)
            return pa.RecordBatch.from_pylist([{"pack": number, "size": size, "keys": keys, "ends": np.cumsum([len(t) for t in texts]).tolist(), "texts": zstandard.compress(whole, 3)}], schema=kinds)

        for batch in slices(batches, "b", PACK_BYTES):
            for k, b in zip(batch.column("k").to_pylist(), batch.column("b").to_pylist()):
                if texts and size + len(b) > PACK_BYTES:
                    yield close()
                    number, keys, texts, size = number + 1, [], [], 0
                keys.append(k)
                texts.append(b)
                size += len(b)
        if texts:
            yield close()

    return src.mapInArrow(run, "pack long, size long, keys array<long>, ends array<long>, texts binary")


def _texts(row: dict) -> list[bytes]:
    whole = zstandard.decompress(row["texts"], max_output_size=max(1, row["size"])) if row["size"] else b""
    return [whole[a:b] for a, b in zip([0, *row["ends"]], row["ends"])]


def _rows(batches, columns: list[str]):
    """Rows of Arrow batches as dictionaries, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.select(columns).slice(i, 1).to_pylist()[0]


def _distinct(h: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, and how often each stands in ``h`` beyond ``other``, a part of it."""
    u, c = np.unique(h, return_counts=True)
    x, n = np.unique(other, return_counts=True)
    c[np.searchsorted(u, x)] -= n
    return u, c


def _blocks(packs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, pack, hashes, counts): a pack's distinct words (bucket < buckets) and bigrams (from buckets on)."""
    kinds = pa.schema([("bucket", pa.int32()), ("pack", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        for row in _rows(batches, ["pack", "size", "keys", "ends", "texts"]):
            h, n = token_hashes(_texts(row))
            unlearned = np.repeat(np.array([k is None or held_out(k) for k in row["keys"]]), n)
            for first, values in ((0, h), (buckets, pair_hashes(h))):
                u, c = _distinct(values, values[unlearned])
                edges = np.searchsorted((u >> _U(32)) * _U(buckets) >> _U(32), np.arange(buckets + 1, dtype=np.uint64))
                short = u if not first else u.view(np.uint8).reshape(-1, 8)[:, :_SHORT]
                c = c.astype(np.uint32)
                out = [{"bucket": first + b, "pack": row["pack"], "hashes": short[edges[b] : edges[b + 1]].tobytes(), "counts": c[edges[b] : edges[b + 1]].tobytes()} for b in np.flatnonzero(np.diff(edges)).tolist()]
                yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return packs.mapInArrow(run, "bucket int, pack long, hashes binary, counts binary")


def _answers(blocks: DataFrame, buckets: int) -> DataFrame:
    """(pack, bucket, answer): counts of a pack's words, levels of its bigrams, in the order of its block.

    Pack -1 has a word bucket's number of learned words in ``kinds`` and of tokens in ``total``.
    """
    kinds = pa.schema([("pack", pa.int64()), ("bucket", pa.int32()), ("answer", pa.binary()), ("kinds", pa.int64()), ("total", pa.int64())])

    def reduce(key, group):
        bucket = key[0].as_py()
        hs, packs = [], group.column("pack").to_pylist()
        for raw in group.column("hashes").to_pylist():
            if bucket < buckets:
                hs.append(np.frombuffer(raw, np.uint64))
            else:
                wide = np.zeros((len(raw) // _SHORT, 8), np.uint8)
                wide[:, :_SHORT] = np.frombuffer(raw, np.uint8).reshape(-1, _SHORT)
                hs.append(wide.view(np.uint64)[:, 0])
        counts = np.concatenate([np.frombuffer(x, np.uint32) for x in group.column("counts").to_pylist()])
        h, where = np.unique(np.concatenate(hs), return_inverse=True)
        c = np.bincount(where, counts, h.size).astype(np.int64)
        if bucket < buckets:
            value, rows = c, [{"pack": -1, "bucket": bucket, "kinds": int((c > 0).sum()), "total": int(c.sum())}]
        else:
            segment = Filter(int(levels_of(c).sum()))
            segment.insert_counts(h[c > 0], c[c > 0])
            value, rows = segment.levels(h), []
        ends = np.cumsum([x.size for x in hs]).tolist()
        rows += [{"pack": p, "bucket": bucket, "answer": value[where[a:b]].tobytes()} for p, a, b in zip(packs, [0, *ends], ends)]
        return pa.Table.from_pylist(rows, schema=kinds)

    return blocks.groupBy("bucket").applyInArrow(reduce, "pack long, bucket int, answer binary, kinds long, total long")


def lm_scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    packs = stage(_packs(docs.select(docs[key].cast("long").alias("k"), utf8(docs[text]).alias("b"))), "packs")
    size = packs.agg(F.sum("size")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, math.ceil(size / BUCKET_BYTES))
    answers = stage(_answers(_blocks(packs, buckets), buckets), "answers")
    got = answers.filter("pack < 0").agg(F.sum("kinds").alias("v"), F.sum("total").alias("n")).first()
    total = int(got["n"] or 0)
    norm = total + 0.1 * (int(got["v"] or 0) + 1)
    kinds = pa.schema([(key, pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def score(left, right):
        if not left.num_rows:
            return kinds.empty_table()
        row = left.select(["size", "keys", "ends", "texts"]).to_pylist()[0]
        h, n = token_hashes(_texts(row))
        found = sorted(zip(right.column("bucket").to_pylist(), right.column("answer").to_pylist()))

        def spread(values, answers, kind):
            return np.frombuffer(b"".join(answers), kind)[np.unique(values, return_inverse=True)[1]]

        c = spread(h, [a for b, a in found if b < buckets], np.int64)
        seen = count_of(spread(pair_hashes(h), [a for b, a in found if b >= buckets], np.uint8).astype(np.int64))
        context = np.concatenate([c[-1:], c[:-1]])
        p0 = (c + 0.1) / norm
        usable = context > 0
        p = np.where(usable, MIX * np.minimum(seen, context) / np.maximum(context, 1) + (1 - MIX) * p0, p0)
        first = np.cumsum(n) - n
        add = lambda x: np.add.reduceat(x, first)
        data = [row["keys"], [held_out(k) for k in row["keys"]], n, add((c > 0).astype(np.int64)), np.full(n.size, total), add(np.log10(p0)), add(np.log10(p))]
        return pa.table([pa.array(x, f.type) for x, f in zip(data, kinds)], schema=kinds)

    both = packs.groupBy("pack").cogroup(answers.filter("pack >= 0").select("pack", "bucket", "answer").groupBy("pack"))
    return both.applyInArrow(score, f"`{key}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
