import hashlib
import random

import pytest

from tarn.llm import warc as w


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree_merges(k):
    rng = random.Random(k)
    runs = [sorted((rng.randrange(50), rng.randrange(5)) for _ in range(rng.randrange(30))) for _ in range(k)]
    assert list(w.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_loser_tree_is_stable_for_ties():
    runs = [[(1, "a"), (1, "b")], [(1, "c")], [(0, "d")]]
    assert [x[1] for x in w.LoserTree([iter(r) for r in runs], lambda x: x[0])] == ["d", "a", "b", "c"]


def test_url_keys():
    assert w.url_key("HTTP://www.Example.com/A?b=C") == "com,example)/a?b=c"
    assert w.url_key(None) == "" and w.url_key("http://[bad") == "http://[bad" and w.url_key("http://a.b") == "b,a)/"


def expected(rows):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= w.LEAST:
            k = hashlib.sha256(b).hexdigest()
            first[k] = min(first.get(k, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        k = hashlib.sha256(b).hexdigest()
        to = first.get(k, i)
        out.append((i, len(b), k, "response" if to == i else "revisit", None if to == i else to))
    return sorted(out)


ROWS = [(7, "http://a.com/x", "p" * 100), (3, "http://a.com/y", "p" * 100), (9, "http://b.com", "p" * 99), (10, "http://b.com", "p" * 99), (1, None, None), (2, "", ""), (5, "http://a.com/é\nq", "é" * 60), (6, "http://A.com/z", "é" * 60), (6, "http://A.com/z", "é" * 60), (3, "http://a.com/y", "p" * 100), (11, "http://c.com", "<p>" * 90000)]


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(w, "ARCHIVE_BYTES", 900)
    df = spark.createDataFrame([(*r, "extra", 1) for r in ROWS], "page_id long, url string, html string, digest string, first int").repartition(3)
    got = w.warc_round_trip(df).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == expected(ROWS)
    by_place = sorted(got, key=lambda r: (r["key_range"], r["place"]))
    assert [(r["url_key"], r["ts"]) for r in by_place] == sorted((r["url_key"], r["ts"]) for r in got)
    assert [r["history"] for r in by_place] == histories([r["url_key"] for r in by_place])
    monkeypatch.setattr(w, "BROADCAST_ROWS", 0)
    again = w.warc_round_trip(df)
    assert sorted(tuple(r) for r in again.select("page_id", "record_type", "refers_to").collect()) == sorted((a, d, e) for a, _, _, d, e in expected(ROWS))
    assert w.warc_round_trip(df.limit(0)).count() == 0


def histories(keys):
    count = {}
    return [count.setdefault(k, []).append(0) or len(count[k]) for k in keys]


@pytest.mark.parametrize("size", [3, 17, 10_000])
def test_ranges_are_one_global_order_with_histories(spark, monkeypatch, size):
    """Many ranges; one URL holds a third of the captures, and rows repeat altogether."""
    monkeypatch.setattr(w, "ARCHIVE_BYTES", 2000)
    monkeypatch.setattr(w, "RANGE_ROWS", size)
    rng = random.Random(4)
    rows = [(rng.choice([None, i, i % 9]), rng.choice(["http://hot.org/x", f"http://h{rng.randint(0, 9)}.org/{rng.randint(0, 3)}", f"http://a.b/{i}"]), "p") for i in range(150)] + [(77, "http://hot.org/x", "p")] * 20
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    archives = w.write_archives(w.with_revisits(df))
    got = sorted(w.merge_index(archives).collect(), key=lambda r: (r["key_range"], r["place"]))
    order = [w.capture_key((r["url_key"], r["ts"], r["page_id"], r["archive"], r["offset"])) for r in got]
    assert order == sorted(order) and len(set(order)) == 170
    assert [r["history"] for r in got] == histories([r["url_key"] for r in got])
    assert len({r["key_range"] for r in got}) >= min(20, 170 // size // 3)
    assert w.warc_round_trip(df).count() == 170


def test_unsorted_runs_are_noticed():
    with pytest.raises(ValueError):
        list(w.LoserTree([iter([2, 1]), iter([1, 5])], lambda x: x))


def test_null_ids_share_no_payload(spark):
    df = spark.createDataFrame([(None, "http://a", "p" * 200), (4, "http://a", "p" * 200), (5, "http://a", "p" * 200)], "page_id long, url string, html string")
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in w.warc_round_trip(df).collect())
    assert got == [(0, "response", None), (4, "response", None), (5, "revisit", 4)]


def test_archives_hold_whole_records(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1)
    archives = w.write_archives(w.with_revisits(df))
    seen = {}
    for a in archives.collect():
        offsets = {x["offset"]: x["length"] for x in a["run"]}
        keys = [(x["url_key"], x["ts"], x["page_id"]) for x in a["run"]]
        assert keys == sorted(keys)
        for at, h, block in w.read_records(bytes(a["data"])):
            assert at in offsets
            if h["WARC-Type"] == "response":
                seen[int(h["Page-Id"])] = block.partition(b"\r\n\r\n")[2].decode()
    assert seen == {i: h or "" for i, _, h in ROWS if (i, "response") in {(a, d) for a, _, _, d, _ in expected(ROWS)}}


def test_damage_is_noticed():
    good, _ = w.record(1, "http://a", b"body", hashlib.sha256(b"other").hexdigest(), None)
    assert [h["Page-Id"] for _, h, _ in w.read_records(good + good)] == ["1", "1"]
    with pytest.raises(Exception):
        list(w.read_records(good[:-20] + b"garbage"))
