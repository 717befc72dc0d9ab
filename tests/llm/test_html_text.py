import random

import pytest

from tarn.llm import html_text as h

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head>
<body class="home comments-open"><header class="site">Logo</header><nav><ul><li><a href="/a>b">Menu</a></li></ul></nav><!-- <p>c</p> -->
<div class="ad">Buy &amp; sell</div><article class="post"><header><h1>Head  line</h1></header><p><b>One&nbsp;two<br><p>Three <i>f</i>our &lt;5&gt;
 six</p><ul><li>x<li>y</ul><div class="ad-slot"><div>in</div>ad</div><form>f<input></form><p>Last</p><footer>by me</footer>
<section id="comments"><article class="comment"><p>Nice</p></article></section></article><aside>Side</aside>
<div role="dialog">Cookies</div><footer>&copy; me</footer></body></html>"""


def text(page, other=None):
    lines = h.page_lines(page)
    return h.difference(h.unpack_lines(h.pack_lines(lines)), h.line_hashes(lines), h.line_hashes(h.page_lines(other)) if other else None)


def test_article_only():
    assert text(PAGE).split("\n\n") == ["Head line", "One two", "Three four <5> six", "x", "y", "Last"]


@pytest.mark.parametrize("cut", range(0, len(PAGE), 7))
def test_any_prefix_is_read(cut):
    text(PAGE[:cut])


def test_shared_lines_go_where_markup_does_not_say():
    a = "<body><div>Menu</div><p>Own text</p><div>All rights</div></body>"
    b = "<body><div>Menu</div><p>Other text</p><p>More</p><div>All rights</div></body>"
    assert text(a, b) == "Own text" and text(b, a) == "Other text\n\nMore" and text(a) == "Menu\n\nOwn text\n\nAll rights"
    licensed = "<article><p>Own</p><p>Licence</p></article>"
    assert text(licensed, licensed.replace("Own", "Else")) == "Own\n\nLicence"


def test_unclosed_boilerplate_does_not_swallow_the_article():
    assert text('<div class="ad">x<article><p>Body</p></article>') == "Body"
    assert text("<nav>a<p>b</nav><main><p>c</p></main><p>tail") == "c"
    assert text("&am <p>a &amp") == "&am\n\na &"
    assert text("a < b <3 <p>c") == "a < b <3\n\nc"
    assert text('<p hidden>no</p><p style="display: none">no</p><p>yes') == "yes"


def lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_common_lines_are_longest():
    rng = random.Random(2)
    for _ in range(1500):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        got = sorted(h.common_lines(a, b))
        it = iter(b)
        assert len(got) == lcs(a, b) and all(any(x == a[i] for x in it) for i in got)


def brute_neighbour(rows, i):
    """The nearest page with other lines before and after row i on its host; the one that shares more of the path."""
    host, path, _, digest = rows[i]

    def first(order):
        return next((h.Beside(rows[k][1], rows[k][3]) for k in order if rows[k][0] == host and rows[k][3] != digest), None)

    got = h.nearer(path, first(range(i - 1, -1, -1)), first(range(i + 1, len(rows))))
    return got.digest if got else None


def test_nearer_shares_more_of_the_path():
    b, a = h.Beside("/en/1", b"b"), h.Beside("/de/2", b"a")
    assert h.nearer("/de/1", b, a) is a and h.nearer("/en/9", b, a) is b and h.nearer("/fr/1", b, a) is b
    assert h.nearer("/x", None, a) is a and h.nearer("/x", b, None) is b and h.nearer("/x", None, None) is None


def test_pages(spark):
    plain = lambda k: f"<div>Menu</div><p>Text {k}</p><div>End</div>"
    rows = [(1, "http://a.com/1", plain(1), "x"), (2, "http://a.com/2", plain(2), "x"), (3, "http://b.com/1", plain(3), "x"), (4, None, None, "x"), (5, "", "", None), (6, "http://c.com", "<article>" + "<p>w é</p>" * 30000 + "</article>", "x"), (6, "http://c.com", "<article><p>a</p></article>", "x"), (None, "http://d.com", "<p>z", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(2)
    got = h.extract_text(df).collect()
    by = sorted(((r["page_id"] or 0), r["n_chars"], r["text"][:20]) for r in got)
    assert by == [(0, 1, "z"), (1, 6, "Text 1"), (2, 6, "Text 2"), (3, 17, "Menu\n\nText 3\n\nEnd"), (4, 0, ""), (5, 0, ""), (6, 1, "a"), (6, 149998, "w é\n\nw é\n\nw é\n\nw é\n\n"[:20])]
    assert all(r["n_chars"] == len(r["text"]) for r in got) and h.extract_text(df.limit(0)).count() == 0


def test_neighbours_do_not_depend_on_ranges():
    """Any cut of the sorted pages into ranges gives the neighbours of the whole, and those of brute force."""
    rng = random.Random(5)
    for _ in range(1500):
        rows = sorted((rng.choice("gh"), rng.choice(["/a/", "/a/b/", "/c/"]) + str(rng.randint(0, 3)), i) for i in range(rng.randint(1, 14)))
        rows = [(*r, rng.choice([b"a", b"b", b"c"])) for r in rows]
        want = {r[2]: brute_neighbour(rows, i) for i, r in enumerate(rows)}
        cuts = sorted(rng.randint(0, len(rows)) for _ in range(rng.randint(0, 5)))
        got, late, edges = {}, [], []
        for part, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
            for kind, *x in h.pair_range(h.Page(host, path, i, None, d, d, d) for host, path, i, d in rows[a:b]):
                if kind == "page":
                    assert x[0].own == x[0].packed == x[0].digest
                    got[x[0].page_id] = x[1].digest if x[1] else None
                elif kind == "open":
                    late.append((part, *x))
                else:
                    edges.append((part, *x))
        over = h.over_edges(edges)
        for part, page, edge, before, after, missing in late:
            far = over[part, edge]
            x = h.nearer(page.path, far[0] if "b" in missing else before, far[1] if "a" in missing else after)
            got[page.page_id] = x.digest if x else None
        assert got == want


def pages_of_hosts(n=90):
    rng = random.Random(8)
    words = lambda k: " ".join(rng.choice(["tree", "river", "stone", "cloud", "lamp"]) for _ in range(k))
    rows = []
    for k in range(n):
        host = rng.choice(["a", "b", "c"])
        lines = [f"<div>Menu {host}</div>", *[f"<p>{words(6)}</p>" for _ in range(rng.randint(1, 4))], f"<div>Rights of {host}</div>"]
        if k % 3 == 0:
            lines.insert(1, f"<article><p>{words(3)}</p><p>Licence</p></article>")
        if k % 7 == 0:
            lines.append("<footer>Foot</footer>")
        rows.append((k, f"http://{host}.com/{rng.choice(['en', 'de', 'de/x'])}/{rng.randint(0, 50)}", "<body>" + "".join(lines) + "</body>"))
    return rows + [(200 + i, "http://a.com/same", "<div>Menu a</div><p>copy</p>") for i in range(20)]


def test_whole_results_equal_brute_force(spark, monkeypatch):
    """Neighbours sought among all pages, lines held against theirs, for several numbers of ranges."""
    rows = pages_of_hosts()
    lines = {i: h.page_lines(x) for i, _, x in rows}
    listed = sorted((u.split("/")[2], "/" + u.split("/", 3)[3], i, repr(lines[i]).encode()) for i, u, _ in rows)
    at = {r[3]: r[2] for r in listed}
    want, changed = {}, 0
    for k, (_, _, i, _) in enumerate(listed):
        other = brute_neighbour(listed, k)
        shared = h.common_lines([t for _, t in lines[i]], [t for _, t in lines[at[other]]]) if other else None
        want[i] = h.kept_text(lines[i], shared)
        changed += want[i] != "\n\n".join(t for z, t in lines[i] if z != h.MARKED)
    assert changed > 80  # differencing decides
    for parts, size in ((1, 4000), (5, 30), (3, 7), (8, 1)):
        monkeypatch.setattr(h, "RANGE_PAGES", size)
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
        assert {r["page_id"]: r["text"] for r in h.extract_text(df).collect()} == want


def test_unmarked_lines_beside_an_article_are_differenced(spark):
    page = lambda k: f"<div>Menu</div><article><p>Short {k}</p></article><div>Long text {k}</div><div>End</div>"
    assert text(page(1), page(2)) == "Short 1\n\nLong text 1"
    df = spark.createDataFrame([(k, f"http://a.com/{k}", page(k)) for k in (1, 2)] + [(3, "http://b.com/", "<article>x</article>")], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in h.extract_text(df).collect()} == {1: "Short 1\n\nLong text 1", 2: "Short 2\n\nLong text 2", 3: "x"}
