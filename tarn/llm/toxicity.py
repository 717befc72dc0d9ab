"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Examples are a bounded sample of the labelled rows that may be learned from: at most ``PER_CLASS`` of each
label, those of least hash. Every example is in the index over all its words; document frequencies are counted
over all documents. A term weighs (1 + log count) * idf * the square
root of 1 + G, where G is the likelihood ratio by which the term tells the labels of the examples apart (a
factor of the weight; it chooses no terms). Terms that no example has count in a text's norm only.

The index holds postings by term, examples in blocks of ``BLOCK``, and each block's greatest weight by term.
Terms that one in ``COMMON`` examples has keep their weights as rows of a matrix, since hardly a block lacks
them: their part of the cosines is known for every example, and makes the bounds of the blocks tighter. A text
visits blocks in order of their upper bounds and stops when the next bound can't beat the ``NEIGHBOURS``-th
best cosine, which is exact. Votes weigh the squared cosine and the class's share in the
sample; a monotone fit to the leave-one-out votes of the examples turns them into probabilities. The
nearest examples are the evidence.

Only the text is scored; labels, language, source and ids never enter. Documents stream past the
broadcast model (bounded by the examples' terms): no shuffle of texts.

Defined results: null and empty texts and those that share no term with an example get the weighted share of
label 1 among the examples, without evidence; with no examples every score is 0; equal texts get equal scores;
a document labelled twice counts as toxic if any label says so; labels other than 0 and 1 and null ids are not
learned from; rows with a null id are scored and not held out; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8, word_hashes

PER_CLASS = 1000
BLOCK = 128
NEIGHBOURS = 25
PRIOR_VOTES = 0.1
THRESHOLD = 0.3
COMMON = 16

#: Lower case; ASCII other than letters and digits parts words.
_CLEAN = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def text_terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit terms of all texts, number of terms of each)."""
    return word_hashes([t.translate(_CLEAN) for t in texts])


def doc_terms(texts: list[bytes]):
    """(distinct terms in order, counts) of each text."""
    h, n = text_terms(texts)
    at = 0
    for x in n.tolist():
        yield np.unique(h[at : at + x], return_counts=True)
        at += x


def may_learn(key):
    """Rows that labels are learned from."""
    return F.crc32(F.encode(key.cast("string"), "UTF-8")) % 4 != 2


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers from each first up to its last, how many of each)."""
    n = last - first
    return np.arange(int(n.sum())) + np.repeat(first - np.cumsum(n) + n, n), n


class Model:
    """Terms, weights and the block-max index of the examples (id, toxic, terms, counts)."""

    def __init__(self, examples: list[tuple[int, int, np.ndarray, np.ndarray]], share: tuple[float, float] = (1.0, 1.0), frequency: tuple[np.ndarray, int] | None = None):
        self.block, self.neighbours = BLOCK, NEIGHBOURS
        self.vocabulary = np.unique(np.concatenate([e[2] for e in examples])) if examples else np.empty(0, np.uint64)
        toxic = np.array([e[1] for e in examples], float)
        of = np.where(toxic == 1, share[1], share[0])
        self.base = float((of * toxic).sum() / of.sum()) if examples else 0.0
        v = self.vocabulary.size
        seen = np.zeros((2, v))
        for _, y, t, _ in examples:
            seen[y, np.searchsorted(self.vocabulary, t)] += 1
        df, n = frequency or (seen.sum(0), len(examples))
        idf = np.log((1 + n) / (1 + df)) + 1
        self.weight = idf * np.sqrt(1 + likelihood_ratio(seen, np.array([(toxic == 0).sum(), (toxic == 1).sum()])))
        self.unknown = math.log(1 + n) + 1
        unit = [self.vector(t, c) for _, _, t, c in examples]
        # like examples stand together: by their heaviest term
        order = sorted((i for i in range(len(examples)) if unit[i][0].size), key=lambda i: (int(unit[i][0][np.argmax(unit[i][1])]), examples[i][0], i))
        self.ids = np.array([examples[i][0] for i in order], np.int64)
        self.toxic, self.share = toxic[order], (of / of.mean() if examples else of)[order]
        self.blocks = -(-len(order) // self.block)
        term = np.concatenate([unit[i][0] for i in order]) if order else np.empty(0, np.int64)
        place = np.repeat(np.arange(len(order)), [unit[i][0].size for i in order])
        w = np.concatenate([unit[i][1] for i in order]) if order else np.empty(0)
        by = np.lexsort((place, term))
        term, self.places, self.weights = term[by], place[by].astype(np.int32), w[by]
        # block entries: one a term and block that has it, with the first of its postings and their greatest weight
        # common terms: a row of weights each
        often = np.flatnonzero(np.bincount(term, minlength=v) * COMMON > len(order)) if order else np.empty(0, np.int64)
        self.row = np.full(v, -1, np.int64)
        self.row[often] = np.arange(often.size)
        self.rows = np.zeros((often.size, self.blocks * self.block))
        common = self.row[term] >= 0
        self.rows[self.row[term[common]], self.places[common]] = self.weights[common]
        term, self.places, self.weights = term[~common], self.places[~common], self.weights[~common]
        block = self.places // self.block
        new = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1]))) if term.size else term
        self.entry_first = np.append(new, term.size)
        self.entry_block = block[new]
        self.entry_most = np.maximum.reduceat(self.weights, new) * (1 + 1e-9) if new.size else np.empty(0)
        self.term_first = np.searchsorted(term[new], np.arange(v + 1))
        self.fit = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        if order:
            raw = np.array([self._vote(*self.nearest(*unit[i], skip=at)) for at, i in enumerate(order)])
            self.fit = monotone(raw, self.toxic, self.share)

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, weights) of the known terms in the text's unit vector."""
        if not self.vocabulary.size:
            return np.empty(0, np.int64), np.empty(0)
        at = np.minimum(np.searchsorted(self.vocabulary, terms), self.vocabulary.size - 1)
        known = self.vocabulary[at] == terms
        w = 1 + np.log(counts)
        t, rest = at[known], w[~known] * self.unknown
        w = w[known] * self.weight[t]
        norm = math.sqrt(float(w @ w) + float(rest @ rest))
        return t, w / norm if norm else w

    def nearest(self, t: np.ndarray, w: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the exact nearest examples; ties go to the lesser place."""
        row = self.row[t]
        common = row >= 0
        got = w[common] @ self.rows[row[common]]
        t, w = t[~common], w[~common]
        entry, n = _ranges(self.term_first[t], self.term_first[t + 1])
        of = np.repeat(w, n)
        block = self.entry_block[entry]
        bound = (np.bincount(block, of * self.entry_most[entry], self.blocks) + got.reshape(self.blocks, self.block).max(axis=1)) * (1 + 1e-9)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        # common terms alone give a lower bound of the cosines
        floor = np.partition(got, -self.neighbours - 1)[-self.neighbours - 1] if got.size > self.neighbours else 0.0
        at, wave = 0, 4
        while at < order.size and bound[order[at]] >= floor:
            visit = np.zeros(self.blocks, bool)
            now = order[at : at + wave]
            visit[now[bound[now] >= floor]] = True
            hit = visit[block]
            post, n = _ranges(self.entry_first[entry[hit]], self.entry_first[entry[hit] + 1])
            got += np.bincount(self.places[post], np.repeat(of[hit], n) * self.weights[post], got.size)
            if skip >= 0:
                got[skip] = 0.0
            if got.size > self.neighbours:
                floor = max(floor, np.partition(got, -self.neighbours)[-self.neighbours])
            at, wave = at + wave, 2 * wave
        p = np.flatnonzero(got >= max(floor - 1e-9, 1e-300))
        c = got[p]
        top = np.lexsort((p, -np.round(c, 12)))[:self.neighbours]
        return p[top], c[top]

    def _vote(self, p: np.ndarray, c: np.ndarray) -> float:
        weight = c * c * self.share[p]
        return float(((weight * self.toxic[p]).sum() + PRIOR_VOTES * self.base) / (weight.sum() + PRIOR_VOTES))

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, list[int]]:
        t, w = self.vector(terms, counts)
        p, c = self.nearest(t, w) if t.size else (np.empty(0, np.int64), np.empty(0))
        if not p.size:
            return self.base, []
        return float(np.clip(np.interp(self._vote(p, c), *self.fit), 0, 1)), self.ids[p[:5]].tolist()


def likelihood_ratio(seen: np.ndarray, size: np.ndarray) -> np.ndarray:
    """G of each term for its examples by label (2 rows) against the labels' numbers of examples."""
    total = seen.sum(0)
    out = np.zeros(total.size)
    for y in (0, 1):
        expect = total * size[y] / max(1, size.sum())
        out += np.where(seen[y] > 0, seen[y] * np.log(np.maximum(seen[y], 1) / np.maximum(expect, 1e-300)), 0.0)
    return np.maximum(2 * out, 0.0)


def monotone(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (raw votes, probabilities) for interpolation."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []  # weight, weighted raw, weighted y
    for r, t, w in zip(raw[order], y[order], weight[order]):
        pools.append([w, w * r, w * t])
        while len(pools) > 1 and pools[-2][2] / pools[-2][0] >= pools[-1][2] / pools[-1][0]:
            a = pools.pop()
            pools[-1] = [x + z for x, z in zip(pools[-1], a)]
    return np.array([p[1] / p[0] for p in pools]), np.array([p[2] / p[0] for p in pools])


def document_frequency(docs: DataFrame, terms: np.ndarray, text: str = "text") -> tuple[np.ndarray, int]:
    """(in how many of all rows each term stands, number of rows), one pass; terms sorted."""
    shipped = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        known = shipped.value
        count, n = np.zeros(known.size, np.int64), 0
        for batch in slices(batches, "b"):
            h, size = text_terms(batch.column("b").to_pylist())
            n += size.size
            if not known.size or not h.size:
                continue
            at = np.minimum(np.searchsorted(known, h), known.size - 1)
            row = np.repeat(np.arange(size.size), size)
            ok = known[at] == h
            once = np.unique(row[ok] * known.size + at[ok])
            count += np.bincount(once % known.size, minlength=known.size)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(count[at], n))], names=["term", "n"])

    rows = docs.select(utf8(docs[text]).alias("b")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    at, n = rows.column("term").to_numpy(), rows.column("n").to_numpy()
    out = np.zeros(terms.size, np.int64)
    out[at[at >= 0]] = n[at >= 0]
    return out, int(n[at < 0].sum())


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Learn from a bounded sample of the labelled rows; ``docs`` supplies the texts and the document frequencies."""
    spark = docs.sparkSession
    told = labels.filter(labels["toxic"].isin(0, 1) & labels["doc_id"].isNotNull()).filter(may_learn(labels["doc_id"])).groupBy(labels["doc_id"].alias("id")).agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("id"))
    classes = {r["toxic"]: r["n"] for r in told.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [told.filter(F.col("toxic") == c).orderBy("h", "id").limit(PER_CLASS) for c in (0, 1)]
    chosen = [(r["id"], r["toxic"]) for p in picked for r in p.select("id", "toxic").collect()]
    sample = spark.createDataFrame(chosen, "id long, toxic int")
    src = docs.select(docs[key].cast("long").alias("id"), utf8(docs[text]).alias("b")).join(F.broadcast(sample), "id")

    def describe(batches):
        for batch in slices(batches, "b"):
            made = list(doc_terms(batch.column("b").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic"), pa.array([t.tobytes() for t, _ in made], pa.binary()), pa.array([c.astype(np.uint32).tobytes() for _, c in made], pa.binary())], names=["id", "toxic", "t", "n"])

    rows = src.select("id", "toxic", "b").mapInArrow(describe, "id long, toxic int, t binary, n binary").collect()
    rows = sorted((r["id"], r["toxic"], bytes(r["t"]), bytes(r["n"])) for r in rows)
    examples = [(i, y, np.frombuffer(t, np.uint64), np.frombuffer(n, np.uint32).astype(np.int64)) for i, y, t, n in rows]
    if not examples:
        return Model([])
    vocabulary = np.unique(np.concatenate([e[2] for e in examples]))
    used = [sum(e[1] == c for e in examples) for c in (0, 1)]
    share = tuple(classes.get(c, 0) / max(1, used[c]) for c in (0, 1))
    return Model(examples, share, document_frequency(docs, vocabulary, text))


def toxicity_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (ids of the nearest examples) of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model or fit(docs, labels, key, text))

    def run(batches):
        m = shipped.value
        for batch in slices(batches, "b"):
            got = [m.score(t, c) for t, c in doc_terms(batch.column("b").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array([s for s, _ in got], pa.float64()), pa.array([int(s >= THRESHOLD) for s, _ in got], pa.int32()), pa.array([e for _, e in got], pa.list_(pa.int64()))], names=["doc_id", "held_out", "score", "predicted", "evidence"])

    k = docs[key].cast("long")
    src = docs.select(k.alias("id"), F.coalesce(~may_learn(k), F.lit(False)).alias("held_out"), utf8(docs[text]).alias("b"))
    return src.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, evidence array<long>")


def without_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is under ``THRESHOLD``, with all their columns; no shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, key, text))

    def run(batches):
        m = shipped.value
        for batch in slices(batches, text):
            keep = [m.score(t, c)[0] < THRESHOLD for t, c in doc_terms([(x or "").encode() for x in batch.column(text).to_pylist()])]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
