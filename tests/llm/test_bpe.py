import hashlib
import random

import numpy as np
import pytest

from tarn.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return bpe.codec(bpe.load_spec(PATH)), tokenizers.Tokenizer.from_file(PATH)


CASES = ["", " ", "a", "Hello, world's  end\n\n\tnow", "a" * 5000, "ab" * 4000, " " * 3000, " \n\t" * 900 + "x", "<|endoftext|>", "x<|endoftext|>" * 3 + " y", "é" * 3000, "😀" * 900, "don't'll's 12345" * 200, "x  y\x85z  q", "the" * 2000, "=-" * 3000, "\0\x01", "﻿�" * 10, "\n" * 1500 + "a"]


@pytest.mark.parametrize("text", CASES, ids=range(len(CASES)))
def test_ids_equal_the_library(both, text):
    mine, theirs = both
    ids = mine.encode(text)
    assert ids.tolist() == theirs.encode(text, add_special_tokens=False).ids
    assert mine.decode(ids) == theirs.decode(ids.tolist(), skip_special_tokens=False) == text


def test_random_texts(both):
    mine, theirs = both
    rng = random.Random(1)
    for _ in range(250):
        alphabet = rng.choice(["ab", "the ", "acgt", "0123456789", "lorem ipsum", "éàü", "aeiou rstln\n", "'stdmrelv "])
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 4000)))
        assert mine.encode(text).tolist() == theirs.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("leaf", [1, 2, 3, 7, 64])
def test_tree_concatenation_with_any_leaf(both, leaf):
    mine, _ = both
    rng = random.Random(leaf)
    for alphabet in ("ab", "the", "acgt", "abcdefghijklmnopqrstuvwxyz", "éa", "😀x日"):
        for n in (1, 2, 33, 700):
            piece = "".join(rng.choice(alphabet) for _ in range(n))
            assert mine.tree(piece, leaf) == mine.whole.encode_ordinary(piece)


def test_leaves_side_by_side_give_the_same(both, monkeypatch):
    mine, theirs = both
    piece = "".join(random.Random(3).choice("lorem") for _ in range(60_000))
    want = theirs.encode(piece, add_special_tokens=False).ids
    assert mine.encode(piece).tolist() == want
    monkeypatch.setattr(bpe, "MANY", 10**9)
    assert mine.encode(piece).tolist() == want


def test_long_words_go_through_the_tree(both, monkeypatch):
    mine, theirs = both
    seen = []
    tree = type(mine).tree
    monkeypatch.setattr(type(mine), "tree", lambda self, piece, *a: seen.append(piece) or tree(self, piece, *a))
    text = "short words and antidisestablishmentarianismistically " + "x" * 40 + " \n" + "y" * 33 + "  end"
    assert mine.encode(text).tolist() == theirs.encode(text, add_special_tokens=False).ids
    assert len(seen) == 3


def test_digests(spark, both):
    _, theirs = both
    rows = [(1, "hello  world", "x"), (2, None, "x"), (3, "", None), (3, "", None), (4, "q" * 200000, "x"), (None, "é", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.bpe_digests(df, PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t, _ in rows if i == r["doc_id"]) or ""
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.bpe_digests(df.limit(0), PATH).count() == 0
    encoded = bpe.encode_texts(df, PATH)
    assert sorted((r["text"] for r in bpe.decode_ids(encoded, PATH).collect())) == sorted(t or "" for _, t, _ in rows)
    plain = bpe.with_ids(df.withColumn("n_tokens", df["doc_id"]), PATH, decoded=None)
    assert plain.columns == ["doc_id", "text", "ids", "n_tokens"] and sorted(r["n_tokens"] for r in plain.collect()) == sorted(r["n_tokens"] for r in got)
    wide = bpe.with_ids(df, PATH)
    assert wide.columns == ["doc_id", "text", "ids", "n_tokens", "decoded"] and all(r["decoded"] == (r["text"] or "") for r in wide.collect())
