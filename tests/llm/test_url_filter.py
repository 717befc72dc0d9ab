import datetime as dt

from pyspark.sql import functions as F

from tarn.llm import url_filter as u

D = dt.date
ENTRIES = [("l", "bad.org", "add", D(2024, 1, 10)), ("l", "bad.org", "drop", D(2024, 2, 1)), ("l", "bad.org", "add", D(2024, 3, 1)), ("m", "ok.com/x/y", "add", D(2024, 1, 1)), ("m", "bad.org", "add", D(2024, 1, 1)), ("m", "bad.org", "drop", D(2024, 1, 1)), ("n", None, "add", D(2024, 1, 1)), ("n", "q.com", "add", None)]


def active(host, path, day):
    found = []
    for name in {e[:2] for e in ENTRIES if e[1] and e[3]}:
        history = sorted((e[3], e[2] == "drop") for e in ENTRIES if e[:2] == name and e[3] and e[3] <= day)
        if not history or history[-1][1]:
            continue
        h, _, p = name[1].partition("/")
        if (not p and (host == h or host.endswith("." + h))) or (p and host == h and (path.strip("/") + "/").startswith(p + "/")):
            found.append(name)
    return found


def test_as_of_against_brute_force(spark):
    urls = ["http://bad.org/", "https://a.b.bad.org/x?q", "http://notbad.org/", "http://ok.com/x/y/z", "http://ok.com/x/yz", "http://ok.com/x/y#f", "HTTP://USER@Bad.ORG:80/q", "http://q.com"]
    rows = [(i * 100 + k, url, day) for i, url in enumerate(urls) for k, day in enumerate([D(2023, 12, 31), D(2024, 1, 1), D(2024, 1, 10), D(2024, 1, 31), D(2024, 2, 1), D(2024, 2, 29), D(2024, 3, 1), D(2030, 1, 1)])]
    caps = spark.createDataFrame(rows, "page_id long, url string, fetched_on date")
    entries = spark.createDataFrame(ENTRIES, "list string, pattern string, action string, day date")
    for bound in (u.BROADCAST_ROWS, 0):
        u_bound, u.BROADCAST_ROWS = u.BROADCAST_ROWS, bound
        got = {r["page_id"]: r for r in u.judge_captures(caps, entries).collect()}
        u.BROADCAST_ROWS = u_bound
        assert len(got) == len(rows)
        for i, url, day in rows:
            rest = url.split("://")[1].split("@")[-1].lower()
            host, _, path = rest.partition("/")
            want = active(host.split(":")[0], path.split("?")[0].split("#")[0], day)
            assert got[i]["n_entries"] == len(want) and got[i]["blocked"] == bool(want), (url, day)
            assert got[i]["lists"] == ",".join(sorted({w[0] for w in want}))


def test_edges(spark):
    entries = spark.createDataFrame(ENTRIES, "list string, pattern string, action string, day date")
    rows = [(1, None, D(2024, 1, 15), "x"), (2, "", D(2024, 1, 15), "x"), (3, "no url", D(2024, 1, 15), None), (4, "http://bad.org", None, "x"), (5, "http://bad.org/" + "a/" * 3000, D(2024, 1, 15), "x"), (5, "http://bad.org/" + "a/" * 3000, D(2024, 1, 15), "x"), (None, "http://bad.org", D(2024, 1, 15), "x")]
    caps = spark.createDataFrame(rows, "page_id long, url string, fetched_on date, lists string").withColumn("pattern", F.lit("clash"))
    got = {r["page_id"]: r for r in u.judge_captures(caps, entries).collect()}
    assert {k: r["blocked"] for k, r in got.items()} == {1: False, 2: False, 3: False, 4: False, 5: True, None: True}
    assert u.judge_captures(caps.limit(0), entries).count() == 0
    assert u.judge_captures(caps, entries.limit(0)).filter("blocked").count() == 0


def test_plan_is_native(spark, tmp_path):
    spark.createDataFrame([(1, "http://bad.org", "h")], "page_id long, url string, html string").write.parquet(str(tmp_path / "p"))
    pages = spark.read.parquet(str(tmp_path / "p"))
    caps = u.captures_of(pages)
    plan = u.judge_captures(caps, u.entries_table(spark, pages))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "html" not in plan


def test_repeats_stay_and_one_label_patterns_match(spark):
    entries = spark.createDataFrame([("l", "zip", "add", D(2024, 1, 1)), ("m", "b.zip", "add", D(2024, 1, 1))], "list string, pattern string, action string, day date")
    day = D(2024, 2, 1)
    rows = [(1, "http://a.b.zip/x", day)] * 3 + [(None, "http://c.zip", day)] * 2 + [(2, "http://zip/", day), (3, "http://zip.org/", day)]
    caps = spark.createDataFrame(rows, "page_id long, url string, fetched_on date")
    old = u.BROADCAST_ROWS
    for bound in (old, 0):
        u.BROADCAST_ROWS = bound
        got = sorted((r["page_id"] or 0, r["n_entries"], r["lists"]) for r in u.judge_captures(caps, entries).collect())
        u.BROADCAST_ROWS = old
        assert got == [(0, 1, "l"), (0, 1, "l"), (1, 2, "l,m"), (1, 2, "l,m"), (1, 2, "l,m"), (2, 1, "l"), (3, 0, "")]


def test_letter_case_long_urls_and_ties(spark):
    schema = "list string, pattern string, action string, day date"
    entries = spark.createDataFrame([("l", "Bad.org", "ADD", D(2024, 1, 1)), ("l", "bad.ORG", "Drop", D(2024, 2, 1)), ("l", "b.c/x", "add", D(2024, 1, 1)), ("m", "a.b.c", "add", D(2024, 1, 1))], schema)
    caps = spark.createDataFrame([(1, "http://bad.org/", D(2024, 1, 15)), (2, "http://BAD.org/", D(2024, 2, 15)), (3, "http://bad.org/" + "a/" * 50_000, D(2024, 1, 15)), (4, "http://" + "a." * 20_000 + "b.c/x", D(2024, 1, 15)), (5, "http://b.c/x/", D(2024, 1, 15))], "page_id long, url string, fetched_on date")
    old = u.BROADCAST_ROWS
    for bound in (old, 0):
        u.BROADCAST_ROWS = bound
        got = {r["page_id"]: (r["n_entries"], r["best_pattern"]) for r in u.judge_captures(caps, entries).collect()}
        u.BROADCAST_ROWS = old
        assert got == {1: (1, "bad.org"), 2: (0, None), 3: (1, "bad.org"), 4: (1, "a.b.c"), 5: (1, "b.c/x")}
    tied = spark.createDataFrame([("l", "b.c/x", "add", D(2024, 1, 1)), ("l", "b.c", "add", D(2024, 1, 1)), ("m", "b.c/x", "add", D(2024, 1, 1))], schema)
    (row,) = u.judge_captures(caps.filter("page_id = 5"), tied).collect()
    assert (row["n_entries"], row["lists"], row["best_pattern"]) == (3, "l,m", "b.c/x")
