import random

import numpy as np
from pyspark.sql import functions as F

from tarn.llm import near_dedup as n


def sets_of(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """{id: (size, component)} by comparing all pairs."""
    sets = {i: sets_of(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(rng, singles=60, groups=8, size=9, hub=70):
    words = [f"w{i}" for i in range(3000)]
    make = lambda k: [rng.choice(words) for _ in range(k)]
    texts = [" ".join(make(rng.randint(0, 80))) for _ in range(singles)]
    for _ in range(groups):
        base = make(rng.randint(60, 200))
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    base = make(150)  # a large group with some stragglers near the threshold
    for _ in range(hub):
        t = list(base)
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    texts += [texts[5], texts[5].upper(), texts[70], "a b", "A  b", "a b c d", "", " \n"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_against_brute_force(spark):
    rows = corpus(random.Random(4))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = n.near_duplicates(df)
    assert result(out) == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out.collect()) and out.count() == len(rows)


def test_every_way_gives_the_same(spark, monkeypatch):
    """Distributed components, shuffled ids, small chunks and recursion of nodes change nothing."""
    rows = corpus(random.Random(5), 30, 5, 6, 50)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name, value in (("UNION_EDGES", 0), ("BROADCAST_IDS", 0), ("CHUNK", 4)):
        monkeypatch.setattr(n, name, value)
    assert result(n.near_duplicates(df)) == brute(rows)


def test_components_agree(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1090)]
    df = spark.createDataFrame(edges, "a long, b long")
    one, two = (sorted(map(tuple, n.components(df, small=s).select("node", "root").collect())) for s in (10**6, 0))
    assert one == two and dict(one)[1090] == 1000


def test_union_find():
    node, root = n.union_find(np.array([5, 3, 9]), np.array([3, 1, 8]))
    assert dict(zip(node.tolist(), root.tolist())) == {1: 1, 3: 1, 5: 1, 8: 8, 9: 8}


def test_recall_is_what_the_formula_says():
    assert n.miss_probability(0.85) < 1e-6 and n.miss_probability(0.95) < 1e-9 and n.miss_probability(0.3) > 0.5
    assert n.miss_probability(1.0) == 0 and n.miss_probability(0.85, n.ROUNDS) < 1e-4


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.unique(np.concatenate([a[:900], rng.integers(0, 2**63, 100, dtype=np.uint64)]))
    same = (n.sketch(np.unique(a)) == n.sketch(b)).mean()
    assert abs(same - 900 / 1100) < 0.12


def test_edges(spark):
    long = " ".join(f"t{i}" for i in range(30000))
    rows = [(1, None, "x"), (2, "", "x"), (3, "one two three four five six", None), (3, "one two three four five six", None), (4, "ONE two three four five six", "y"), (5, long, "z"), (6, long + " more", "z"), (7, "a b", "q"), (8, "b a", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string").withColumn("kept", F.lit("clash"))
    out = n.near_duplicates(df)
    assert sorted(map(tuple, out.select("doc_id", "n_shingles", "component_id", "kept").collect())) == [(1, 0, 1, True), (2, 0, 2, True), (3, 2, 3, True), (4, 2, 3, False), (5, 29996, 5, True), (6, 29997, 5, False), (7, 1, 7, True), (8, 1, 8, True)]
    assert n.near_duplicates(df.limit(0)).count() == 0
    kept = n.without_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 5, 7, 8]


def test_large_group_of_copies_is_one_class(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text again and again for everyone here")).otherwise(F.concat_ws(" ", *[F.concat(F.lit(c), F.col("id")) for c in "abcdefgh"])).alias("text"))
    out = n.near_duplicates(df)
    assert out.filter("not kept").count() == 666 and out.filter("component_id = 0").count() == 667


def test_null_and_repeated_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(None, a), (None, a), (None, ""), (1, a), (2, a), (3, b), (3, "other words that stand alone here"), (3, b), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted(((r["doc_id"] or 0), r["n_shingles"], r["component_id"], r["kept"]) for r in n.near_duplicates(df).collect())
    assert got == [(0, 0, None, True), (0, 26, None, True), (1, 26, 1, True), (2, 26, 1, False), (3, 2, 3, True), (3, 26, 3, True), (4, 0, 4, True)]
    left = n.without_near_duplicates(df).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left) == sorted([(0, a), (0, a), (0, ""), (1, a), (3, b), (3, "other words that stand alone here"), (4, "")])
