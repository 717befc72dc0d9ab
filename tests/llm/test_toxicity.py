import random
import zlib

import numpy as np

from tarn.llm import toxicity as t

BAD = ["grumble", "snarlish", "vexoid"]
GOOD = [f"{a}{b}{c}" for a in "bdfklmnprst" for b in "aeiou" for c in ("n", "r", "st", "ll")]


def corpus(n=700, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(GOOD) for _ in range(rng.randint(5, 60))]
        toxic = i % 6 == 0
        for _ in range(rng.randint(2, 4) * toxic):
            w = rng.choice(BAD)
            words.insert(rng.randrange(len(words)), w if rng.random() < 0.5 else w + rng.choice(["en", "ed", "s"]))
        rows.append((i, " ".join(words).capitalize() + "."))
        labels.append((i, int(toxic)))
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    d, l = frames(spark, rows, labels)
    truth = dict(labels)
    got = t.toxicity_scores(d, l).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 100 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    learned = {i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 != 2}
    assert all(set(r["evidence"]) <= learned for r in got)


def test_held_out_labels_do_not_matter(spark):
    rows, labels = corpus(300, 2)
    d, l = frames(spark, rows, labels)
    flipped = [(i, y if zlib.crc32(str(i).encode()) % 4 != 2 else 1 - y) for i, y in labels]
    a, b = ({r["doc_id"]: r["score"] for r in t.toxicity_scores(d, x).collect()} for x in (l, frames(spark, rows, flipped)[1]))
    assert a == b


def dense_cosines(examples, frequency, n):
    """Cosines of all pairs by the formulas of the docstring, in plain Python."""
    import math

    sets = [dict(zip(t.tolist(), c.tolist())) for _, _, t, c in examples]
    seen = {}
    for (_, y, *_), own in zip(examples, sets):
        for w in own:
            seen.setdefault(w, [0, 0])[y] += 1
    size = [sum(e[1] == y for e in examples) for y in (0, 1)]

    def weight(w):
        if w not in seen:
            return math.log(1 + n) + 1
        g = 2 * sum(x * math.log(x * len(examples) / (sum(seen[w]) * size[y])) for y, x in enumerate(seen[w]) if x)
        return (math.log((1 + n) / (1 + frequency[w])) + 1) * math.sqrt(1 + max(g, 0.0))

    def unit(own):
        v = {w: (1 + math.log(c)) * weight(w) for w, c in own.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()} if norm else {}

    return unit, [unit(own) for own in sets]


def test_scores_and_evidence_equal_brute_force(spark, monkeypatch):
    """Every document's vote, fit and evidence, without an index, against the query's."""
    monkeypatch.setattr(t, "BLOCK", 8)
    monkeypatch.setattr(t, "NEIGHBOURS", 7)
    monkeypatch.setattr(t, "PER_CLASS", 30)
    rows, labels = corpus(300, 5)
    rows += [(1000, "unheard words only"), (1001, None), (1002, rows[6][1])]
    d, l = frames(spark, rows, labels)
    model = t.fit(d, l)
    truth = dict(labels)
    texts = {i: (x or "").encode() for i, x in rows}
    terms = dict(zip(texts, t.doc_terms(list(texts.values()))))
    by_place = [(int(i), truth[int(i)], *terms[int(i)]) for i in model.ids]
    assert [e[1] for e in by_place] == model.toxic.tolist() and all(zlib.crc32(str(e[0]).encode()) % 4 != 2 for e in by_place)
    assert sum(e[1] for e in by_place) == 30 and len(by_place) == 60
    frequency = {}
    for own, _ in terms.values():
        for w in own.tolist():
            frequency[w] = frequency.get(w, 0) + 1
    unit, known = dense_cosines(by_place, frequency, len(rows))

    def vote(v, skip=-1):
        cosine = [sum(x * u.get(w, 0.0) for w, x in v.items()) if i != skip else 0.0 for i, u in enumerate(known)]
        best = sorted((-round(c, 12), i, c) for i, c in enumerate(cosine) if c > 0)[:7]
        c, at = np.array([c for _, _, c in best]), [i for _, i, _ in best]
        weight = c * c * model.share[at]
        return (float((weight * model.toxic[at]).sum()) + 0.1 * model.base) / (float(weight.sum()) + 0.1), at

    fit = t.monotone(np.array([vote(u, i)[0] for i, u in enumerate(known)]), model.toxic, model.share)
    got = {r["doc_id"]: r for r in t.toxicity_scores(d, l, model=model).collect()}
    for i, (own, count) in terms.items():
        raw, at = vote(unit(dict(zip(own.tolist(), count.tolist()))))
        want = np.interp(raw, *fit) if at else model.base
        assert abs(got[i]["score"] - want) < 1e-6 and got[i]["evidence"] == [by_place[k][0] for k in at[:5]]
    assert got[1002]["score"] == got[6]["score"] and got[1000]["evidence"] == []
    assert all(got[i]["evidence"] for i in range(300))


def test_frequencies_cover_all_documents(spark):
    rows, labels = corpus(240, 9)
    d, l = frames(spark, rows, labels)
    terms = np.unique(np.concatenate([x for x, _ in t.doc_terms([x.encode() for _, x in rows[:50]])]))
    count, n = t.document_frequency(d, terms)
    want = np.zeros(terms.size, int)
    for own, _ in t.doc_terms([x.encode() for _, x in rows]):
        at = np.searchsorted(terms, own)
        at = np.minimum(at, terms.size - 1)
        want[at[terms[at] == own]] += 1
    assert n == 240 and count.tolist() == want.tolist()


def test_monotone_fit():
    x, y = t.monotone(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]), np.ones(4))
    assert (np.diff(y) >= 0).all() and len(x) == 3 and y[1] == 0.5


def test_edges(spark):
    rows, labels = corpus(240, 4)
    d, l = frames(spark, rows, labels)
    model = t.fit(d, l)
    schema = "doc_id long, text string, label string, score string"
    odd = spark.createDataFrame([(1, None, "1", "x"), (2, "", "1", None), (3, "Grumble snarlish!", "0", "x"), (3, "Grumble snarlish!", "0", "x"), (4, "badan " * 60000 + "vexoid grumble", "0", "x"), (None, "benst", None, "x")], schema)
    got = t.toxicity_scores(odd, l, model=model).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 6 and by[1]["score"] == by[2]["score"] == model.base and by[3]["predicted"] == 1 and by[None]["held_out"] is False
    assert t.toxicity_scores(d.limit(0), l).count() == 0
    none = t.toxicity_scores(odd, l.limit(0)).collect()
    assert {r["score"] for r in none} == {0.0} and {r["predicted"] for r in none} == {0}
    kept = t.without_toxic(d, l)
    assert kept.columns == d.columns and abs(kept.count() - 200) <= 3
    twice = l.unionByName(l.limit(3)).unionByName(spark.createDataFrame([(None, 1), (0, None), (1, 7)], "doc_id long, toxic int"))
    again = t.fit(d, twice)
    assert again.ids.tolist() == model.ids.tolist() and np.allclose(again.weight, model.weight)
