"""WARC archives of pages, read back, with a capture index from an external k-way merge.

Writing. Payload digests come from JVM functions; of equal payloads of ``LEAST`` bytes or more the least
page_id is the response and the others are revisits of it (a partial aggregation by digest, then a join;
only digests that repeat take part). Each task packs records, one gzip member each, into archives of
about ``ARCHIVE_BYTES``; an archive is a row (name, bytes, run) of a table in the shared folder, so any
store and retried tasks work. Its run lists its captures sorted by URL key, timestamp and page id.

Index. Bounds from a sample of keys cut the key space (URL key, timestamp, page id, archive, offset, so a hot
host, a hot URL and a repeated capture are split too) into ranges of about ``RANGE_ROWS`` captures. Each run is cut
at the bounds into slices, which travel whole, and each range merges its slices through a loser tree, which
checks that each is sorted: the ranges in order are one global order, and the captures of a URL stand in their
history's order. A history that goes on in the next range is counted on over the edge, from one row a range.

Reading. Archives are walked member by member; lengths and digests are taken from what is read.

Defined results: a null html is an empty payload; payloads under ``LEAST`` bytes are always responses; rows
that repeat a page_id are each written, and all rows with the least page_id of a payload are responses; a
null URL has no target header and sorts first; rows with a null page_id are always responses and no payload's
first; captures of equal URL key and time are in page_id, archive and offset order; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timedelta, timezone
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stage, utf8

LEAST = 100
ARCHIVE_BYTES = 4 << 20
#: Captures of a key range, about; SAMPLED keys a range choose the bounds.
RANGE_ROWS, SAMPLED = 20_000, 20
BROADCAST_ROWS = 100_000
PIECE = 1 << 15
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
RUN = "array<struct<url_key:string,ts:string,page_id:bigint,offset:bigint,length:bigint>>"


class LoserTree:
    """Merge sorted iterators: each node keeps the loser of its match, the root the winner."""

    def __init__(self, runs: Sequence[Iterator], key: Callable):
        self.runs, self.key = [iter(r) for r in runs], key
        self.k = len(self.runs)
        self.heads: list = [None] * self.k
        self.keys: list = [None] * self.k
        for i in range(self.k):
            self._pull(i)
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _pull(self, i: int) -> None:
        """The next head of run i; an ended run has an infinite key."""
        row = next(self.runs[i], None)
        self.heads[i] = row
        key = (1, None, i) if row is None else (0, self.key(row), i)
        if row is not None and self.keys[i] is not None and key < self.keys[i]:
            raise ValueError(f"run {i} is not sorted")
        self.keys[i] = key

    def _play(self, i: int) -> None:
        """Run i against the losers on its way up; an empty node keeps it waiting."""
        node = (i + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other == -1:
                self.tree[node] = i
                return
            if self._less(other, i):
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i

    def _less(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return x < y if x[0] == y[0] == 0 else x[0] < y[0]

    def __iter__(self):
        while self.k:
            i = self.tree[0]
            if self.heads[i] is None:
                return
            yield self.heads[i]
            self._pull(i)
            self._play(i)


def url_key(url: str | None) -> str:
    """Sort key: host labels reversed, then path and query; lower case, without www."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").lower()
    except ValueError:
        return url.lower()
    host = re.sub(r"^www\d*\.", "", host)
    return f"{','.join(reversed(host.split('.')))}){(parts.path or '/').lower()}{'?' + parts.query.lower() if parts.query else ''}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> tuple[bytes, str]:
    """One gzip member and its timestamp."""
    when = (EPOCH + timedelta(seconds=(page_id or 0) % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")
    kind = "response" if refers_to is None else "revisit"
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {i}')}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + b"Content-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {when}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        lines.append(f"Page-Id: {page_id}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}", f"Refers-To-Page: {refers_to}"]
    whole = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(5, zlib.DEFLATED, 31)
    return pack.compress(whole) + pack.flush(), when


def read_records(archive: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of every record of an archive, member by member."""
    view, at = memoryview(archive), 0
    while at < len(archive):
        un, to, parts = zlib.decompressobj(31), at, []
        while not un.eof and to < len(archive):
            parts.append(un.decompress(view[to : to + PIECE]))
            to = min(len(archive), to + PIECE)
        if not un.eof:
            raise ValueError(f"the member at {at} is cut short")
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        headers = dict(x.split(": ", 1) for x in lines)
        yield at, headers, rest[: int(headers["Content-Length"])]
        at = to - len(un.unused_data)


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to."""
    body = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), utf8(pages["html"]).alias("payload"))
    body = body.withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload"))
    same = body.filter((F.col("n") >= LEAST) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("final")).filter("first < final").select("digest", "first")
    same = F.broadcast(same) if same.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else same
    return body.join(same, "digest", "left").select("page_id", "url", "payload", "digest", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))


def write_archives(captures: DataFrame) -> DataFrame:
    """The staged table of archives: archive, data, run."""
    kinds = pa.schema([("archive", pa.string()), ("data", pa.binary()), ("run", pa.list_(pa.struct([("url_key", pa.string()), ("ts", pa.string()), ("page_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])))])

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        made, size, listed = [], 0, []

        def close():
            nonlocal size, number
            listed.sort(key=lambda x: (x["url_key"], x["ts"], -1 if x["page_id"] is None else x["page_id"]))
            out = pa.RecordBatch.from_pylist([{"archive": f"{task:06d}-{number:05d}.warc.gz", "data": b"".join(made), "run": list(listed)}], schema=kinds)
            made.clear()
            listed.clear()
            size, number = 0, number + 1
            return out

        for batch in slices(batches, "payload"):
            for row in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")]):
                member, when = record(*row)
                listed.append({"url_key": url_key(row[1]), "ts": when, "page_id": row[0], "offset": size, "length": len(member)})
                made.append(member)
                size += len(member)
                if size >= ARCHIVE_BYTES:
                    yield close()
        if made:
            yield close()

    return stage(captures.mapInArrow(run, f"archive string, data binary, run {RUN}"), "warc")


def read_archives(archives: DataFrame) -> DataFrame:
    """archive, offset, page_id, url, payload_bytes, payload_digest, record_type, refers_to, from the stored bytes.

    A revisit's length and digest are those that its headers state for the full payload.
    """
    kinds = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    number = lambda x: None if x is None else int(x)

    def run(batches):
        for batch in slices(batches, "data"):
            for name, data in zip(batch.column("archive").to_pylist(), batch.column("data").to_pylist()):
                rows = []
                for at, h, block in read_records(data):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    if h["WARC-Type"] == "response":
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        if f"sha256:{digest}" != h["WARC-Payload-Digest"]:
                            raise ValueError(f"{name} at {at}: the payload doesn't have its digest")
                    else:
                        size, digest = int(re.search(rb"Content-Length: (\d+)", http)[1]), h["WARC-Payload-Digest"].removeprefix("sha256:")
                    rows.append({"archive": name, "offset": at, "page_id": number(h.get("Page-Id")), "url": h.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": h["WARC-Type"], "refers_to": number(h.get("Refers-To-Page"))})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return archives.select("archive", "data").mapInArrow(run, "archive string, offset long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def capture_key(r: tuple) -> tuple:
    """The global order of captures (url_key, ts, page_id, archive, offset); a null id comes first."""
    return r[0], r[1], -1 if r[2] is None else r[2], r[3], r[4]


def _bounds(archives: DataFrame) -> list[tuple]:
    """Keys that cut all captures into ranges of about ``RANGE_ROWS``; the sample has ``SAMPLED`` keys a range."""
    total = archives.agg(F.sum(F.size("run"))).first()[0] or 0
    ranges = -(-total // RANGE_ROWS)
    if ranges < 2:
        return []
    every = max(1, total // (SAMPLED * ranges))
    some = archives.select("archive", F.explode("run").alias("r")).filter(F.pmod(F.xxhash64("archive", "r.offset"), F.lit(every)) == 0)
    keys = sorted(capture_key((r["url_key"], r["ts"], r["page_id"], r["archive"], r["offset"])) for r in some.select("r.url_key", "r.ts", "r.page_id", "archive", "r.offset").collect())
    return [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []


def merge_index(archives: DataFrame) -> DataFrame:
    """The capture index: key_range, place (in the range), url_key, ts, page_id, archive, offset, length, history.

    In the order of (key_range, place) all captures are sorted; ``history`` counts the captures of a URL key from 1 on.
    """
    bounds = archives.sparkSession.sparkContext.broadcast(_bounds(archives))
    names = ["url_key", "ts", "page_id", "offset", "length"]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    piece = pa.schema([("key_range", pa.int32()), ("archive", pa.string()), ("slice", pa.list_(pa.struct(list(zip(names, types)))))])
    merged = pa.schema([("key_range", pa.int32()), ("place", pa.int64()), *zip(names[:3], types), ("archive", pa.string()), *zip(names[3:], types[3:]), ("seen", pa.int64())])
    keyed = lambda archive, x: capture_key((x["url_key"], x["ts"], x["page_id"], archive, x["offset"]))

    def cut(batches):
        for batch in batches:
            for archive, run in zip(batch.column("archive").to_pylist(), batch.column("run").to_pylist()):
                out, lo = [], 0
                keys = [keyed(archive, x) for x in run]
                while lo < len(run):
                    number = bisect.bisect_right(bounds.value, keys[lo])
                    hi = bisect.bisect_left(keys, bounds.value[number], lo) if number < len(bounds.value) else len(run)
                    out.append({"key_range": number, "archive": archive, "slice": run[lo:hi]})
                    lo = hi
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=piece)

    def merge(batches):
        held, at = [], None
        for batch in batches:
            for number, archive, part in zip(*[batch.column(c).to_pylist() for c in piece.names]):
                if number != at and held:
                    yield from one(at, held)
                    held = []
                at = number
                held.append((archive, part))
        if held:
            yield from one(at, held)

    def read_slice(archive: str, part: list[dict]):
        for x in part:
            yield x["url_key"], x["ts"], x["page_id"], archive, x["offset"], x["length"]

    def one(number: int, slices_: list[tuple[str, list[dict]]]):
        runs = [read_slice(archive, part) for archive, part in slices_]
        out, seen, last = [], 0, None
        for place, row in enumerate(LoserTree(runs, capture_key)):
            seen, last = (seen + 1 if row[0] == last else 1), row[0]
            out.append((number, place, *row, seen))
            if len(out) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), merged.types)], schema=merged)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), merged.types)], schema=merged)

    dealt = archives.select("archive", "run").mapInArrow(cut, f"key_range int, archive string, slice {RUN}")
    dealt = dealt.repartition("key_range").sortWithinPartitions("key_range")
    index = stage(dealt.mapInArrow(merge, "key_range int, place long, url_key string, ts string, page_id long, archive string, offset long, length long, seen long"), "index")
    # one row a range: where a history goes on over an edge
    edges = index.groupBy("key_range").agg(F.min_by("url_key", "place").alias("first"), F.max_by("url_key", "place").alias("last"), F.max_by("seen", "place").alias("seen")).orderBy("key_range").collect()
    before, rows = ("", 0), []
    for r in edges:
        carried = before[1] if before[0] == r["first"] else 0
        if carried:
            rows.append((r["key_range"], r["first"], carried))
        before = r["last"], r["seen"] + (carried if r["first"] == r["last"] else 0)
    over = index.sparkSession.createDataFrame(rows, "key_range int, url_key string, carried long")
    whole = index.join(F.broadcast(over), ["key_range", "url_key"], "left")
    return whole.select("key_range", "place", "url_key", "ts", "page_id", "archive", "offset", "length", (F.col("seen") + F.coalesce("carried", F.lit(0))).alias("history"))


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write, index and read back: one row a record, with its place in the capture index and in its URL's history."""
    archives = write_archives(with_revisits(pages))
    index = merge_index(archives).select("archive", "offset", "url_key", "ts", "key_range", "place", F.col("length").alias("record_bytes"), "history")
    return read_archives(archives).join(index, ["archive", "offset"]).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts", "key_range", "place", "record_bytes", "history")


#: DuckDB, for page_id, payload_bytes, payload_digest, record_type, refers_to, url_key and history, of well-formed http URLs.
ORACLE_SQL = r"""
WITH u AS (SELECT *, regexp_extract(lower(url), '^https?://(?:[^/?#@]*@)?(?:www[0-9]*[.])?([^/?#:]*)', 1) AS host,
  regexp_extract(lower(url), '^https?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(lower(url), '^https?://[^?#]*([?][^#]+)', 1) AS query FROM pages),
k AS (SELECT page_id, html, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || (CASE WHEN path = '' THEN '/' ELSE path END) || query AS url_key FROM u),
p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest, url_key,
  row_number() OVER (PARTITION BY url_key ORDER BY page_id) AS history FROM k),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to, p.url_key, p.history
FROM p LEFT JOIN f USING (payload_digest)
"""
