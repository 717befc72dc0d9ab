"""Main text of web pages by page differencing against the nearest URL, with markup as a check.

Each page is parsed once into lines, one a block element, marked by where they stand: inside the article,
inside a menu, header, footer, sidebar, notice, advert, form or reader comments, or elsewhere. Bounds from a
sample of keys deal the pages, with packed lines and a hash of each, to ranges of (host, path, id, hash of the
page), so a hot host and a repeated page spread; each range is sorted. Each page meets the nearest pages before and after it on its host that have other lines,
takes the one that shares more of the path (the one before when they share as much), and is aligned with it by
longest common subsequence: shared lines are deleted. The first and last pages of a range find their neighbour
over its edge by a short list of the ranges' first and last pages, so neighbours do not depend on the ranges.

Markup checks the result both ways: a shared line inside the article stays (licence lines and copied pages are
text too), and a line of a marked menu and the like goes even if it is not shared. Differencing alone decides
unmarked lines, beside an article too.

Defined results: null and empty pages give empty texts; an unfinished tag at the end is markup, an
unfinished character reference is text if it is none; rows that repeat are each returned; pages of equal lines
are no neighbours of each other; a page with no other page of its host is not differenced, and its unmarked
lines go if it has an article; null hosts and URLs sort first and form one host; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import html
import itertools
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stage, utf8

ARTICLE, MARKED, OTHER = 0, 1, 2
#: Pages of a range, about; SAMPLED keys a range choose the bounds.
RANGE_PAGES, SAMPLED = 4000, 20

# HTML element names by their part in a page.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
SPACES = frozenset("br td th wbr img".split()) - {"wbr", "img"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math textarea title head object canvas audio video select button".split())
MENUS = frozenset("nav aside form dialog menu".split())
# Words of class names, ids and roles that mark what is not the article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup sidebar sidebars widget widgets related recommended recommendations breadcrumb breadcrumbs menu menus nav navbar navigation toolbar footer comment comments commentlist disqus reply replies respond discussion share sharing social pagination pager login search searchbox navigation complementary contentinfo dialog".split()
)
HEADS = frozenset("header masthead topbar".split())
TALK = frozenset("comment comments commentlist disqus reply replies respond discussion".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


def _marks(name: str, attrs: str, in_article: bool) -> str | None:
    """What marks an element as outside the article: 'talk', 'part' or nothing."""
    if name in MENUS:
        return "part"
    if name in ("header", "footer"):
        return None if name == "header" and in_article else "part"
    if not attrs or name in ("html", "body", "main"):
        return None
    words: set[str] = set()
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), (a or b or c).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return "part"
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return "part"
        elif name == "article":
            words.update(value.split())
        else:
            words.update(re.split(r"[\s_-]+", value))
    if words & TALK:
        return "talk"
    if name != "article" and (words & NAMES or not in_article and words & HEADS):
        return "part"
    return None


def page_lines(page: str) -> list[tuple[int, str]]:
    """(place, text) of each non-empty block, in page order."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    zone, articles = OTHER, 0
    inside: tuple[str, str, int] | None = None  # the marked element: name, mark, articles open at its start
    depth = 0
    raw_end = None

    def close() -> None:
        if held:
            text = "".join(held)
            held.clear()
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                out.append((zone, text))

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if not m:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        name = m.group(2) or m.group(5)
        if not name:
            continue
        name = name.lower()
        closing = bool(m.group(1) or m.group(4))
        attrs = m.group(3) or ""
        if not closing and name in RAW:
            if attrs.rstrip().endswith("/") and name in ("svg", "math", "iframe"):
                continue
            stop = re.compile(rf"</{name}\s*>" if name != "head" else r"</head\s*>|<body[\s>]", re.I).search(page, at)
            if stop:
                at = stop.start() if stop.group().lower().startswith("<body") else stop.end()
            elif name not in ("head", "svg", "math", "button", "select", "object"):
                at = end
            continue
        if name in SPACES:
            held.append(" ")
            continue
        if name not in BLOCKS and not (not closing and attrs and name not in VOID and inside is None and _marks(name, attrs, articles > 0)) and not (inside and inside[0] == name):
            continue
        close()
        if inside:
            own, mark, opened = inside
            if closing:
                if name == own:
                    depth -= 1
                    if depth <= 0:
                        inside = None
                elif name == "body" or name == "article" and articles and mark != "talk":
                    inside = None
                    articles -= name == "article"
                elif name == "article" and articles > opened:
                    articles -= 1
            elif name == own:
                depth += name not in VOID
            elif mark == "part" and name in ("article", "main") and not opened and not _marks(name, attrs, False):
                inside = None
                articles += 1
        elif closing:
            if name in ("article", "main") and articles:
                articles -= 1
        else:
            mark = _marks(name, attrs, articles > 0) if name not in VOID else None
            if mark:
                inside, depth = (name, mark, articles), 1
            elif name in ("article", "main"):
                articles += 1
        zone = MARKED if inside else ARTICLE if articles else OTHER
    close()
    return out


def common_lines(a: list, b: list) -> set[int]:
    """Places in ``a`` of one longest common subsequence with ``b``; bit-parallel, ties to the last places."""
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    x, y = len(a), len(b)
    while x > lo and y > lo and a[x - 1] == b[y - 1]:
        x, y = x - 1, y - 1
    out = {*range(lo), *range(x, len(a))}
    n = y - lo
    if x == lo or not n:
        return out
    masks: dict = {}
    for j in range(n):
        masks[b[lo + j]] = masks.get(b[lo + j], 0) | 1 << j
    full = (1 << n) - 1
    v, rows = full, []
    for line in a[lo:x]:
        u = v & masks.get(line, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    # a zero bit in row i at j: the LCS of a[:i+1] grows at b[j]; walk back through the rows
    j = n - 1
    for i in range(x - lo - 1, -1, -1):
        while j >= 0 and rows[i] >> j & 1:
            j -= 1
        if j < 0:
            break
        if i == 0 or rows[i - 1] >> j & 1:
            out.add(lo + i)
            j -= 1
    return out


def kept_text(lines: list[tuple[int, str]], shared: set[int] | None) -> str:
    """Delete the lines shared with the other page (None: there is no other), and marked lines; the article's own stay."""
    if shared is None and any(z == ARTICLE for z, _ in lines):
        # nothing tells whether unmarked lines beside an article are text
        return "\n\n".join(t for z, t in lines if z == ARTICLE)
    gone = shared or ()
    return "\n\n".join(t for i, (z, t) in enumerate(lines) if z == ARTICLE or z == OTHER and i not in gone)


def pack_lines(lines: list[tuple[int, str]]) -> bytes:
    """Places and texts of lines, compressed; marked lines, which no result holds, are empty. No text holds a line end."""
    return zstandard.compress("\n".join(["".join(str(z) for z, _ in lines), *["" if z == MARKED else t for z, t in lines]]).encode(), 5)


def unpack_lines(packed: bytes) -> list[tuple[int, str]]:
    zones, *texts = zstandard.decompress(packed).decode().split("\n")
    return [(int(z), t) for z, t in zip(zones, texts)]


def line_hashes(lines: list[tuple[int, str]]) -> bytes:
    """A 64-bit hash of each line's text, side by side."""
    return np.array([xxhash.xxh64_intdigest(t) for _, t in lines], np.uint64).tobytes()


def difference(lines: list[tuple[int, str]], own: bytes, other: bytes | None) -> str:
    """The text of a page of line hashes ``own`` beside a page of line hashes ``other``."""
    if other is None:
        return kept_text(lines, None)
    return kept_text(lines, common_lines(np.frombuffer(own, np.uint64).tolist(), np.frombuffer(other, np.uint64).tolist()))


class Page(NamedTuple):
    """A parsed page; pages of the same ``digest`` have the same lines in the same places."""

    host: str
    path: str
    page_id: int | None
    url: str | None
    digest: bytes
    own: bytes
    packed: bytes


class Beside(NamedTuple):
    """What a page needs of a neighbour."""

    path: str
    digest: bytes
    own: bytes | None = None


def nearer(path: str, before: Beside | None, after: Beside | None) -> Beside | None:
    """The neighbour that shares more leading steps of the path; the one before when both share as many."""
    if before is None or after is None:
        return before or after
    steps = path.split("/")

    def shared(other: Beside) -> int:
        n = 0
        for x, y in zip(steps, other.path.split("/")):
            if x != y:
                break
            n += 1
        return n

    return after if shared(after) > shared(before) else before


class Run(NamedTuple):
    """Pages side by side that have the same lines: their digest, first path, last path and line hashes."""

    digest: bytes
    first: str
    last: str
    own: bytes = b""


def pair_range(pages: Iterable[Page]) -> Iterator[tuple]:
    """What one sorted range knows: ('page', page, neighbour), ('open', page, edge, before, after, missing) and ('edge', edge, host, runs).

    Only the first run of the range's first host and the last run of its last host can have a neighbour
    beyond the range; ``missing`` says on which sides ('b', 'a' or both), and ``edge`` is 0 for the first host and
    1 for another last one. 'edge' lists a host's first two and last two runs. Of a run's pages only the first is
    held whole, of the others id, URL and path: their lines are the same.
    """
    edge, host, runs, before = 0, None, [], None
    lead, held = None, []

    def close(after: Beside | None, last: bool):
        nonlocal before
        first = edge == 0 and before is None
        runs.append(Run(lead.digest, held[0].path, held[-1].path, lead.own))
        if len(runs) > 4:
            del runs[2:-2]
        for page in held:
            page = page._replace(own=lead.own, packed=lead.packed)
            if first or last:
                yield "open", page, edge, before, after, "b" * first + "a" * last
            else:
                yield "page", page, nearer(page.path, before, after)
        before = Beside(held[-1].path, lead.digest, lead.own)

    for page in pages:
        if lead is not None and (page.host != host or page.digest != lead.digest):
            same = page.host == host
            yield from close(Beside(page.path, page.digest, page.own) if same else None, False)
            held = []
            if not same:
                if edge == 0:
                    yield "edge", 0, host, list(runs)
                edge, runs, before = 1, [], None
        if not held:
            lead, host = page, page.host
        held.append(page if not held else page._replace(own=b"", packed=b""))
    if held:
        yield from close(None, True)
        yield "edge", edge, host, runs


def over_edges(edges: list[tuple[int, int, str, list[Run]]]) -> dict[tuple[int, int], tuple[Beside | None, Beside | None]]:
    """(part, edge) to the neighbours beyond the range: before its host's first run there, and after the last.

    ``edges`` has (part, edge, host, runs) of every range. A neighbour has other lines than the run it is for.
    """
    out: dict = {}
    seen: list[Run] = []
    host = None
    for part, edge, h, runs in sorted(edges, key=lambda e: e[:2]):
        seen = seen if h == host else []
        host = h
        out[part, edge] = next((Beside(r.last, r.digest) for r in reversed(seen) if r.digest != runs[0].digest), None), None
        for r in runs:
            seen = [*(seen[:-1] if seen and seen[-1].digest == r.digest else seen), r][-2:]
    seen, host = [], None
    for part, edge, h, runs in sorted(edges, key=lambda e: e[:2], reverse=True):
        seen = seen if h == host else []
        host = h
        out[part, edge] = out[part, edge][0], next((Beside(r.first, r.digest) for r in seen if r.digest != runs[-1].digest), None)
        for r in reversed(runs):
            seen = [r, *(seen[1:] if seen and seen[0].digest == r.digest else seen)][:2]
    return out


def _bounds(src: DataFrame) -> list[tuple]:
    """Keys that cut the pages into ranges of about ``RANGE_PAGES``; the sample has ``SAMPLED`` keys a range."""
    total = src.count()
    ranges = -(-total // RANGE_PAGES)
    if ranges < 2:
        return []
    some = src.select(*KEY).filter(F.pmod("salt", F.lit(max(1, total // (SAMPLED * ranges)))) == 0).collect()
    keys = sorted(map(_place, some))
    return [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []


KEY = ["host", "path", "page_id", "mark", "salt"]


def _place(key) -> tuple:
    host, path, page_id, mark, salt = key
    return host, path, -(1 << 64) if page_id is None else page_id, mark, salt


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    sc, url = pages.sparkSession.sparkContext, F.col("url")
    src = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        url.cast("string").alias("url"),
        F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("")).alias("host"),
        F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(.*)$", 1), F.lit("")).alias("path"),
        utf8(pages["html"]).alias("b"),
    )
    # like pages stand together whatever their partitions; the salt parts rows that repeat altogether
    src = src.withColumn("mark", F.xxhash64("b")).withColumn("salt", F.monotonically_increasing_id())
    bounds = sc.broadcast(_bounds(src))

    def parse(batches):
        for batch in slices(batches, "b"):
            made = [page_lines(raw.decode("utf-8", "replace")) for raw in batch.column("b").to_pylist()]
            packed, own = [pack_lines(x) for x in made], [line_hashes(x) for x in made]
            digest = [hashlib.blake2b(h + bytes(z for z, _ in x), digest_size=16).digest() for h, x in zip(own, made)]
            number = [bisect.bisect_right(bounds.value, _place(k)) for k in zip(*[batch.column(c).to_pylist() for c in KEY])]
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), *[batch.column(c) for c in (*KEY, "url")], *[pa.array(x, pa.binary()) for x in (digest, own, packed)]], names=["part", *KEY, "url", "digest", "own", "packed"])

    parsed = src.mapInArrow(parse, "part int, host string, path string, page_id long, mark long, salt long, url string, digest binary, own binary, packed binary")
    dealt = parsed.repartition("part").sortWithinPartitions("part", *KEY)
    beside = pa.struct([("path", pa.string()), ("digest", pa.binary())])
    run = pa.struct([("digest", pa.binary()), ("first", pa.string()), ("last", pa.string()), ("own", pa.binary())])
    shape = pa.schema([("part", pa.int32()), ("edge", pa.int32()), ("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("path", pa.string()), ("own", pa.binary()), ("packed", pa.binary()), ("before", beside), ("after", beside), ("missing", pa.string()), ("host", pa.string()), ("runs", pa.list_(run))])
    side = "struct<path:string,digest:binary>"

    def pair(batches):
        cells = lambda x: None if x is None else {"path": x.path, "digest": x.digest}

        def rows():
            for batch in batches:
                yield from zip(batch.column("part").to_pylist(), map(Page._make, zip(*[batch.column(c).to_pylist() for c in Page._fields])))

        out, size = [], 0
        for part, group in itertools.groupby(rows(), lambda r: r[0]):
            for kind, *got in pair_range(page for _, page in group):
                if kind == "page":
                    page, other = got
                    row = {"page_id": page.page_id, "url": page.url, "text": difference(unpack_lines(page.packed), page.own, other.own if other else None)}
                    size += len(row["text"])
                elif kind == "open":
                    page, edge, before, after, missing = got
                    row = {"part": part, "edge": edge, "page_id": page.page_id, "url": page.url, "path": page.path, "own": page.own, "packed": page.packed, "before": cells(before), "after": cells(after), "missing": missing}
                    size += len(page.packed)
                else:
                    row = {"part": part, "edge": got[0], "host": got[1], "runs": [r._asdict() for r in got[2]]}
                out.append(row)
                if len(out) == 2000 or size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema=shape)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=shape)

    met = stage(dealt.select("part", *Page._fields).mapInArrow(pair, f"part int, edge int, page_id long, url string, text string, path string, own binary, packed binary, before {side}, after {side}, missing string, host string, runs array<struct<digest:binary,first:string,last:string,own:binary>>"), "paired")
    ends = met.filter("runs is not null").select("part", "edge", "host", "runs")
    known = ends.select("part", "edge", "host", F.transform("runs", lambda x: F.struct(x["digest"], x["first"], x["last"])).alias("runs")).collect()
    # two paths an edge, two edges a range
    beyond = sc.broadcast(over_edges([(r["part"], r["edge"], r["host"], [Run(bytes(x[0]), x[1], x[2]) for x in r["runs"]]) for r in known]))

    def choose(batches):
        names = ["page_id", "url", "own", "packed", "other"]
        for batch in slices(batches, "packed"):
            others = []
            for r in batch.select(["part", "edge", "path", "before", "after", "missing"]).to_pylist():
                b, a = (Beside(x["path"], x["digest"]) if x else None for x in (r["before"], r["after"]))
                far = beyond.value[r["part"], r["edge"]]
                got = nearer(r["path"], far[0] if "b" in r["missing"] else b, far[1] if "a" in r["missing"] else a)
                others.append(got.digest if got else None)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:-1]], pa.array(others, pa.binary())], names=names)

    def settle(batches):
        for batch in slices(batches, "packed"):
            texts = [difference(unpack_lines(p), own, other) for p, own, other in zip(*[batch.column(c).to_pylist() for c in ("packed", "own", "far")])]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    left = met.filter("missing is not null").mapInArrow(choose, "page_id long, url string, own binary, packed binary, other binary")
    # a neighbour is the first or last run of its range, or beside the page
    far = ends.select(F.explode("runs").alias("r")).groupBy(F.col("r.digest").alias("other")).agg(F.first("r.own").alias("far"))
    late = left.join(far, "other", "left").select("page_id", "url", "own", "packed", "far").mapInArrow(settle, "page_id long, url string, text string")
    done = met.filter("text is not null").select("page_id", "url", "text").unionByName(late)
    return done.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
