import random

import numpy as np
import pytest

from tarn.llm import decontaminate as d

WORDS = [a + b + c for a in "bcdfgklm" for b in "aeio" for c in ("r", "nt", "sh", "l", "")]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, s, k):
    """Exactly k edits of squeezed characters."""
    s = list(s)
    for _ in range(k):
        i = rng.randrange(len(s))
        how = rng.choice("sid")
        if how == "s":
            s[i] = rng.choice("xyzqw")
        elif how == "i":
            s.insert(i, rng.choice("xyzqw"))
        else:
            del s[i]
    return "".join(s)


def brute(item, doc):
    """Least edit distance of the item to any stretch of the document, by the plain table."""
    row = np.zeros(len(doc) + 1, int)
    for c in item:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        for j, x in enumerate(doc):
            new[j + 1] = min(row[j] + (x != c), row[j + 1] + 1, new[j] + 1)
        row = new
    return int(row.min())


def test_edit_distance_against_the_table():
    rng = random.Random(1)
    for _ in range(300):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        b = "".join(rng.choice("abc") for _ in range(rng.randint(0, 20)))
        got, end = d.edit_distance(a.encode(), b.encode())
        assert got == brute(a, b) and 0 <= end <= len(b)


def test_squeeze_and_bounds():
    assert d.squeeze("A b-C.\n9é!".encode()) == "abc9é".encode()
    assert [d.max_edits(n) for n in (7, 9, 10, 16, 20, 29, 30, 200)] == [0, 0, 1, 1, 2, 2, 3, 20]
    assert all(d.class_size(d.class_of(n)) <= n < d.class_size(d.class_of(n) + 1) for n in range(8, 3000))


def test_cgk_maps_equal_strings_alike_and_keeps_near_ones_near():
    rng = random.Random(2)
    a = d.squeeze(text(rng, 40).encode())
    b = edited(rng, a.decode(), 4).encode()
    c = d.squeeze(text(rng, 40).encode())
    buffer, starts = d.joined([a, a, b, c])
    near, far = [], []
    for w in range(4):
        v = d.cgk(buffer, starts, len(a), w)
        assert (v[:, 0] == v[:, 1]).all()
        near.append((v[:, 0] != v[:, 2]).mean())
        far.append((v[:, 0] != v[:, 3]).mean())
    assert min(near) < 0.5 < min(far)


@pytest.mark.parametrize("sieve", [True, False])
def test_recall_at_the_bound(sieve):
    """Copies with as many edits as the bound allows, with and without the sieve of windows: what the buckets find."""
    rng = random.Random(11)
    items = [(i, text(rng, rng.randint(10, 50)).encode()) for i in range(30)]
    own = d.Items(items)
    docs, want = [], set()
    for k in range(240 if sieve else 60):
        i = rng.randrange(len(items))
        leak = edited(rng, own.texts[i].decode(), own.edits[i])
        docs.append(f"{text(rng, 25)} {leak} {text(rng, 25)}".encode())
        want.add((k, i))
    met = set()
    buffer, begins = d.joined([d.squeeze(t) for t in docs])
    ends = begins + [len(d.squeeze(t)) for t in docs]
    for c, starts in own.windows(buffer, d.grams(buffer, 8), begins, ends, sieve).items():
        got = own.meetings(buffer, starts, c)
        met |= set(zip((np.searchsorted(begins, got[:, 0], side="right") - 1).tolist(), got[:, 1].tolist()))
    found = {(r, i) for r, i, *_ in d._match(own, docs, sieve)}
    assert len(want & found) >= 0.95 * len(want) and found <= met


def test_short_items_have_the_same_bound(spark):
    rng = random.Random(6)
    for n in (8, 9, 10, 12, 15, 20, 23, 30, 31):
        items = [(i, d.squeeze(text(rng, 14).encode())[:n]) for i in range(40)]
        own = d.Items(items)
        docs = [("zz " + edited(rng, t.decode(), d.max_edits(n)) + " zz").encode() for _, t in items]
        found = {(r, own.ids[i]) for r, i, *_ in d._match(own, docs)}
        assert sum((i, i) in found for i in range(40)) >= 36, n


def test_pairs_against_brute_force(spark):
    rng = random.Random(7)
    items = [(i, text(rng, rng.randint(12, 45))) for i in range(12)]
    docs, planted = [], set()
    for k in range(90):
        body = text(rng, rng.randint(0, 120))
        if k % 3 == 0:
            i, t = items[rng.randrange(12)]
            leak = edited(rng, d.squeeze(t.encode()).decode(), rng.randint(0, d.max_edits(len(d.squeeze(t.encode())))))
            body = f"{body} {leak.upper()} {text(rng, 30)}"
            planted.add((k, i))
        docs.append((k, body))
    truth = {(k, i) for k, b in docs for i, t in items if (q := d.squeeze(t.encode()).decode()) and brute(q, d.squeeze(b.encode()).decode()) <= d.max_edits(len(q))}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in d.contaminated_pairs(df, bench).collect()}
    assert got <= truth and len(got) >= 0.97 * len(truth) and len(truth & planted) >= 28
    kept = {r["doc_id"] for r in d.decontaminate(df, bench).collect()}
    assert kept == {k for k, _ in docs} - {k for k, _ in got}


def test_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(9)
    items = [(i, text(rng, 20)) for i in range(9)]
    df = spark.createDataFrame([(i, f"so {t} then") for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, d.contaminated_pairs(df, bench).collect()))
    monkeypatch.setattr(d, "BLOCK_BYTES", 300)
    assert sorted(map(tuple, d.contaminated_pairs(df, bench).collect())) == one and len(one) == 9
    assert d.decontaminate(df, bench).count() == 0


def test_edges(spark):
    rng = random.Random(3)
    item = text(rng, 25)
    schema = "doc_id long, text string, item_id string, b int, start string"
    rows = [(1, None, "x", 1, "y"), (2, "", None, None, None), (None, item, "x", 1, "y"), (4, item, "x", 1, "y"), (4, item, "x", 1, "y"), (5, ("the " * 40000) + item, None, 2, None), (6, "short", None, 2, None), (7, "é" * 50, None, 2, None)]
    df = spark.createDataFrame(rows, schema)
    bench = spark.createDataFrame([(1, item, "z"), (2, None, "z"), (3, "", "z"), (4, "tiny", "z"), (5, item, "z"), (None, item, "z")], "item_id long, text string, doc_id string")
    got = sorted((r["doc_id"] or 0, r["item_id"]) for r in d.contaminated_pairs(df, bench).collect())
    assert got == sorted([(0, 1), (0, 5), (4, 1), (4, 1), (4, 5), (4, 5), (5, 1), (5, 5)])
    kept = d.decontaminate(df, bench)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 6, 7}
    assert d.contaminated_pairs(df.limit(0), bench).count() == 0 and d.contaminated_pairs(df, bench.limit(0)).count() == 0 and d.decontaminate(df, bench.limit(0)).count() == 8


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9])
def test_grams(n):
    b = np.frombuffer(bytes(range(n)), np.uint8)
    assert d.grams(b, 8).size == max(0, n - 7) and d.grams(b, 5).size == max(0, n - 4)


def test_first_of_the_nearest_stretches():
    own = d.Items([(1, b"thequickbrownfoxjumpsoverthelazydog")])
    t = "the quick brown fox jumps over the lazy dog"
    (hit,) = d._match(own, [f"{t.replace('fox', 'fax')} and {t} or {t}".encode()])
    assert hit == (0, 0, 0, 38, 73)
