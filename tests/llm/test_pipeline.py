import random

import numpy as np
import pytest

import corpus_pipeline as p
from tarn.llm import decontaminate, near_dedup, toxicity

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rng = random.Random(8)
    words = [f"{a}{b}{c}{d}" for a in "bdfgklmnprst" for b in "aeiou" for c in "bdklmnrst" for d in ("", "in", "o")]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(make(40))) for i in range(3)]
    docs, labels = [], []
    for i in range(240):
        body = make(rng.randint(30, 80))
        toxic = i % 8 == 0
        if toxic:
            body += ["grumbler", "snarlish", "grumbler"]
        docs.append((i, " ".join(body), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(toxic)))
    docs.append((1000, docs[1][1] + " tail", "en", "s", 0))
    docs.append((1001, docs[1][1].upper(), "en", "s", 0))
    docs.append((1002, " ".join(make(20)) + " " + items[1][1], "en", "s", 0))
    docs.append((1003, None, "en", "s", 0))
    path = str(tmp_path_factory.mktemp("data"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_take_effect(spark, data):
    docs = p.table(spark, data, "documents")
    whole = docs.columns
    assert [n for n, _ in p.STAGES] == ["toxicity", "near_dedup", "decontamination", "bpe"]
    seen, frame = [], docs
    for _, step in p.STAGES:
        frame = p.stage(step(spark, frame, data), "test")
        seen.append({r["doc_id"] for r in frame.select("doc_id").collect()})
    assert all(i % 8 or i >= 1000 for i in seen[0]) and len(seen[0]) >= 210
    assert not {1000, 1001} & seen[1] and 1 in seen[1] and {1002, 1003} <= seen[1]
    assert 1002 not in seen[2] and len(seen[1]) - len(seen[2]) == 1 and seen[3] == seen[2]
    for _, step in p.STAGES[:-1]:
        assert step(spark, docs, data).columns == whole


def test_run_equals_the_operators_by_hand(spark, data):
    out = {r["doc_id"]: r["n_tokens"] for r in p.run(spark, data).collect()}
    docs = p.table(spark, data, "documents")
    scores = {r["doc_id"] for r in toxicity.toxicity_scores(docs, p.table(spark, data, "labels")).filter("predicted = 0").collect()}
    left = docs.filter(docs["doc_id"].isin(*scores))
    kept = {r["doc_id"] for r in near_dedup.near_duplicates(left).filter("kept").collect()}
    bad = {r["doc_id"] for r in decontaminate.contaminated_pairs(left, p.table(spark, data, "benchmark")).collect()}
    assert set(out) == kept - bad and out[1003] == 0


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def least_edits(item, text):
    """Least edit distance of the item to any stretch of the text, by the plain table."""
    row = np.zeros(len(text) + 1, int)
    codes = np.array([ord(c) for c in text])
    for c in item:
        new = np.minimum(row[1:] + 1, row[:-1] + (codes != ord(c)))
        row = np.minimum.accumulate(np.concatenate([[row[0] + 1], new]) - np.arange(len(text) + 1)) + np.arange(len(text) + 1)
    return int(row.min())


def test_run_equals_brute_force(spark, data):
    """Toxic by the planted words, all pairs of sets, edit distances by the table, ids by the library."""
    import tokenizers

    rows = {r["doc_id"]: r["text"] for r in p.table(spark, data, "documents").select("doc_id", "text").collect()}
    items = [r["text"] for r in p.table(spark, data, "benchmark").collect()]
    clean = {i: t for i, t in rows.items() if "snarlish" not in (t or "")}
    sets, root = {i: shingle_set(t) for i, t in clean.items()}, {i: i for i in clean}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(clean)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    one = {i for i in clean if find(i) == i}
    squeeze = lambda t: "".join(c for c in (t or "").lower() if c.isalnum())
    held = {i for i in one if any(least_edits(squeeze(x), squeeze(clean[i])) <= len(squeeze(x)) // 10 for x in items)}
    library = tokenizers.Tokenizer.from_file(p.tokenizer_path())
    want = {i: library.encode(clean[i] or "", add_special_tokens=False).ids for i in one - held}
    got = {r["doc_id"]: list(r["ids"]) for r in p.run(spark, data).collect()}
    assert got == want and held and len(one) < len(clean)


def test_odd_rows_of_every_stage(spark, data):
    """Null ids, null and very long texts, repeated rows, and extra columns of clashing names."""
    long = "word " * 60_000
    rows = [(None, "a text of no id at all", "x"), (None, "a text of no id at all", "x"), (1, None, "y"), (2, "", None), (3, long, "z"), (4, "five plain words stand here", "x"), (4, "five plain words stand here", "x")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, ids string").selectExpr("*", "doc_id AS n_tokens", "'en' AS score", "1 AS kept", "2 AS b")
    for name, step in p.STAGES:
        out = step(spark, odd, data)
        got = out.collect()
        if name == "bpe":
            assert set(out.columns) == {"doc_id", "ids", "n_tokens", "score", "kept", "b"} and len(got) == 7 and sorted(r["n_tokens"] for r in got)[:2] == [0, 0]
            continue
        assert out.columns == odd.columns
        texts = sorted((r["doc_id"] or 0, r["text"] or "") for r in got)
        every = sorted((i or 0, t or "") for i, t, _ in rows)
        assert texts == (every if name != "near_dedup" else sorted([*every[:2], *dict.fromkeys(every[2:])]))


def test_staged_tables_go(spark, data, tmp_path):
    """Of what a run stages, its last input alone stays."""
    import os

    folder = f"{p.shared_dir(spark)}/tarn-stage"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = p.run(spark, data)
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and next(iter(left)).startswith("decontamination") and out.count() > 100


def test_empty_documents(spark, data, tmp_path):
    docs = p.table(spark, data, "documents").limit(0)
    for _, step in p.STAGES:
        assert step(spark, docs, data).count() == 0
