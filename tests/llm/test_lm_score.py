import math
import random
import zlib
from collections import Counter

import numpy as np

from tarn.llm import lm_score as m


def learn(rows):
    """Brute-force counts of the training rows."""
    words, pairs = Counter(), Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 10 == 0:
            continue
        w = (t or "").encode().lower().split() + [None]
        words.update(w)
        pairs.update(zip([None, *w[:-1]], w))
    return words, pairs


def level_count(c):
    """The middle of the whole numbers that share a bin with c: 1, then bins from 2 on, a factor of BASE wide."""
    if c < 2:
        return c
    q = math.floor(math.log(c / 2) / math.log(m.BASE) + 1e-9)
    inside = [x for x in range(max(2, c // 4), 4 * c + 8) if math.floor(math.log(x / 2) / math.log(m.BASE) + 1e-9) == q]
    return (inside[0] + inside[-1]) / 2


def scores(rows, i, t):
    words, pairs = learn(rows)
    n, v = sum(words.values()), len(words)
    w = (t or "").encode().lower().split() + [None]
    p0 = lambda x: (words[x] + 0.1) / (n + 0.1 * (v + 1))
    base = sum(math.log10(p0(x)) for x in w)
    full = 0.0
    for h, x in zip([None, *w[:-1]], w):
        c = min(level_count(pairs[h, x]), words[h])
        full += math.log10(m.MIX * c / words[h] + (1 - m.MIX) * p0(x) if words[h] else p0(x))
    return len(w), sum(words[x] > 0 for x in w), n, base, full


def corpus(n=160, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    weights = [1 / (k + 1) for k in range(400)]
    return [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 60)))) for i in range(n)]


def check(spark, rows, parts=3):
    """All rows against brute force; a false positive of the filter may move the score of one document in 100."""
    out = m.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
    assert len(out) == len(rows)
    texts = dict(rows)
    off = 0
    for r in out:
        tokens, known, n, base, full = scores(rows, r["doc_id"], texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (tokens, known, n)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9, abs_tol=1e-9)
        off += not math.isclose(r["score"], full, rel_tol=1e-9, abs_tol=1e-9)
    assert off <= 0.01 * len(rows)
    return {r["doc_id"]: round(r["score"], 9) for r in out}


def test_against_brute_force_for_any_partitions(spark):
    rows = corpus()
    assert check(spark, rows, 3) == check(spark, rows, 8) == check(spark, rows, 1)


def test_many_packs_and_buckets(spark, monkeypatch):
    """Blocks of each pack meet in each bucket; the number of buckets follows the bytes."""
    rows = corpus(150, 2)
    monkeypatch.setattr(m, "LEAST_BUCKETS", 1)
    monkeypatch.setattr(m, "BUCKET_BYTES", 700)
    check(spark, rows, 6)


def test_filter_has_no_false_negatives_and_the_stated_error():
    rng = np.random.default_rng(0)
    h, other = (rng.integers(0, 2**40, 100_000, dtype=np.uint64) for _ in range(2))
    count = rng.integers(1, 30, h.size)
    h, first = np.unique(h, return_index=True)
    count = count[first]
    f = m.Filter(int(m.levels_of(count).sum()))
    f.insert_counts(h, count)
    got = f.levels(h)
    assert (got >= m.levels_of(count)).all() and (got > m.levels_of(count)).mean() < 3e-4
    assert (f.levels(other) > 0).mean() < 3e-4
    assert m.Filter(0).levels(h[:5]).max() == 0


def test_levels():
    c = np.arange(0, 400)
    q = m.levels_of(c)
    assert q[:3].tolist() == [0, 1, 2] and (np.diff(q) >= 0).all()
    table = m.count_of(q)
    assert table[:4].tolist() == [0, 1, 2, 3] and (np.abs(table - c)[1:] / c[1:] < 0.25).all()
    assert [level_count(int(x)) for x in c] == table.tolist()


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t", None), (4, "A a b", "x"), (4, "A a b", "x"), (5, "word " * 40000, "x"), (None, "b", "x"), (17, "zzz", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    out = m.lm_scores(df).collect()
    assert len(out) == len(rows) and sorted(r["n_tokens"] for r in out) == [1, 1, 1, 2, 2, 4, 4, 40001]
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in out)
    assert m.lm_scores(df.limit(0)).count() == 0


def test_bigrams_seen_once_are_in_the_model(spark):
    """A phrase that stands in one training document scores above the same words in an order never seen."""
    keys = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10]
    words = [f"w{j}" for j in range(40)]
    rows = [(k, f"{words[j]} {words[j + 1]}") for k, j in zip(keys, range(0, 40, 2))]
    new = next(i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows += [(new, "w1 w0"), (keys[30], "w0 w1 w2 w3")]
    check(spark, rows)
    _, pairs = learn(rows)
    assert list(pairs.values()).count(1) >= 20
    out = {r["doc_id"]: r["score"] for r in m.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[keys[2]] > out[new] + 1
