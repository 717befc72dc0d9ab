"""Near-duplicate documents by a chosen-path set similarity join over minwise tokens.

A document is the set of its distinct five-word shingles (64-bit hashes). Documents of equal sets form
one class at once. Each class gets ``SKETCH`` minwise tokens. ``TREES`` independent trees then branch the
classes: at a node, a hash of the node chooses one token slot, and with probability ``BRANCH`` a second;
a class goes to the child named by its token in that slot. Two sets meet in a node only if they share
every token on the path, so after ``DEPTH`` levels nodes are small.

A node's members are compared with its most central one first (the member that collides most over all
nodes), which links a group of copies to its origin; links join them into components. A node whose members
are all connected is done. In every other node of at most ``CHUNK`` members, all pairs of different
components are compared where they meet: sketches choose the members whose full sets are brought there and
then decide. A larger node branches on, up to
``ROUNDS`` levels of ``DEPTH``; what is still large then is compared component by component, in chunks. No
partner is dropped, and members of one component are never paired among themselves. Every link is confirmed
on the full sets (100 * intersection >= 85 * union); links and components stay distributed.

``miss_probability`` gives the chance that a pair of a given similarity shares no leaf: at the threshold below
1e-6 if its nodes are small after ``DEPTH`` levels and below 1e-4 if they stay large through all ``ROUNDS``.

Defined results: null, empty and blank texts have no shingles, link with nothing and stand alone; a text
of one to four words is one shingle of all its words; rows of the same id and set size collapse to one; rows with a
null id link with nothing and are kept, with a null component; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, slices, small_batches, stage, unstage, utf8, word_hashes

SHINGLE = 5
NUM, DEN = 85, 100
SKETCH, FINE = 128, 256
TREES, DEPTH, BRANCH = 16, 5, 0.18
ROUNDS = 3
#: Equal tokens of FINE that a pair at the threshold falls short of in 3 of 10,000 cases; such a pair is
#: lost only if neither a star nor any other link connects it.
LEAST_SAME = 197
#: Members of a node that a task compares; a larger node branches on, and at last is compared in chunks.
CHUNK = 2048
#: Bounds on memory, each with another way beyond: ids that are broadcast, edges that one task joins.
BROADCAST_IDS, UNION_EDGES = 500_000, 2_000_000

_U = np.uint64
_RNG = np.random.default_rng(20240229)
_ODD = _RNG.integers(1, 2**63, SHINGLE, dtype=np.uint64) * _U(2) + _U(1)
_MUL = (_RNG.integers(1, 2**31, SKETCH + FINE, dtype=np.uint64) * _U(2) + _U(1)).astype(np.uint32)


def miss_probability(similarity: float, rounds: int = 1, depth: int = DEPTH, trees: int = TREES, branch: float = BRANCH) -> float:
    """Chance that a pair meets in no leaf after some rounds: a branching process that dies out in every tree."""
    q = 0.0
    for level in range(rounds * depth, 0, -1):  # from the leaves up; later rounds branch twice as often
        more = branch if level <= depth else 2 * branch
        one = 1 - similarity + similarity * q
        q = one * (1 - more + more * one)
    return q**trees


def shingles(h: np.ndarray) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text's word hashes."""
    n = h.size
    if not n:
        return h
    if n < SHINGLE:
        return mix(np.array([(h * _ODD[:n]).sum() + _U(n)], np.uint64))
    total = h[: n - SHINGLE + 1] * _ODD[0]
    for k in range(1, SHINGLE):
        total += h[k : n - SHINGLE + 1 + k] * _ODD[k]
    return np.unique(mix(total + _U(SHINGLE)))


def text_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The shingle set of each text."""
    h, n = word_hashes(texts)
    return [shingles(x) for x in np.split(h, np.cumsum(n)[:-1])] if texts else []


def _minima(s: np.ndarray, mul: np.ndarray) -> np.ndarray:
    """The least value of a non-empty set under each of some hash functions."""
    low, high = (s & _U(0xFFFFFFFF)).astype(np.uint32), (s >> _U(32)).astype(np.uint32)
    out = np.full(mul.size, 0xFFFFFFFF, np.uint32)
    for i in range(0, s.size, 2048):
        v = np.multiply.outer(mul, low[i : i + 2048])
        v += high[i : i + 2048]
        np.minimum(out, v.min(axis=1), out=out)
    return out


def sketch(s: np.ndarray) -> np.ndarray:
    """``SKETCH`` minwise tokens of a non-empty set, 16 bits each: what the trees branch on."""
    out = _minima(s, _MUL[:SKETCH])
    return (out ^ (out >> np.uint32(16))).astype(np.uint16)


def fine_sketch(s: np.ndarray) -> np.ndarray:
    """``FINE`` more minwise tokens, 8 bits each: what candidate pairs are chosen by."""
    out = _minima(s, _MUL[SKETCH:])
    return (out ^ (out >> np.uint32(8)) ^ (out >> np.uint32(16)) ^ (out >> np.uint32(24))).astype(np.uint8)


def _sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (128-bit hash of the set), tokens."""

    def run(batches):
        for batch in slices(batches, "b"):
            ids, n, keys, toks = batch.column("doc_id"), [], [], []
            for s in text_sets(batch.column("b").to_pylist()):
                n.append(s.size)
                keys.append(xxhash.xxh128_digest(s.tobytes()) if s.size else None)
                toks.append(sketch(s).tobytes() if s.size else None)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(toks, pa.binary())], names=["doc_id", "n_shingles", "set_key", "tokens"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, tokens binary")


def _branch(node: np.ndarray, doc: np.ndarray, tokens: np.ndarray, levels: int, branch: float) -> tuple[np.ndarray, np.ndarray]:
    """Follow ``levels`` levels down from (node, row of tokens) pairs."""
    for _ in range(levels):
        pick = mix(node ^ _U(0x9E3779B97F4A7C15))
        more = (mix(node ^ _U(0xD1B54A32D192ED03)) >> _U(11)).astype(np.float64) / float(1 << 53) < branch
        first, second = (pick & _U(0xFFFF)) % _U(SKETCH), (pick >> _U(32)) % _U(SKETCH)
        more &= first != second
        at = np.concatenate([node, node[more]])
        slot = np.concatenate([first, second[more]])
        doc = np.concatenate([doc, doc[more]])
        node = mix(at ^ mix(tokens[doc, slot.astype(np.int64)].astype(np.uint64) | (slot << _U(40))))
    return node, doc


def _paths(rows: DataFrame, levels: int, branch: float, start: str | None = None) -> DataFrame:
    """(node, rep): leaves ``levels`` below the tree roots, or below the nodes in column ``start``."""

    def run(batches):
        roots = mix(np.arange(1, TREES + 1, dtype=np.uint64) * _U(0xA0761D6478BD642F))
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                tokens = np.frombuffer(b"".join(part.column("tokens").to_pylist()), np.uint16).reshape(-1, SKETCH)
                reps = part.column("rep").to_numpy(zero_copy_only=False)
                n = len(reps)
                if start:
                    node, doc = part.column(start).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).copy(), np.arange(n)
                else:
                    node, doc = np.tile(roots, n), np.repeat(np.arange(n), TREES)
                node, doc = _branch(node, doc, tokens, levels, branch)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(reps[doc], pa.int64())], names=["node", "rep"])

    return rows.select("tokens", "rep", *([start] if start else [])).mapInArrow(run, "node long, rep long")


def _stars(met: DataFrame) -> DataFrame:
    """Pairs (a, b) of each node's members with the one that collides most over all nodes: the likeliest centre."""
    central = met.groupBy("rep").agg(F.sum(F.col("n") - 1).alias("score"))
    scored = met.select("node", "rep").join(central, "rep")
    centre = scored.groupBy("node").agg(F.max(F.struct("score", F.negative("rep").alias("neg"))).alias("c")).select("node", F.negative("c.neg").alias("centre"))
    return met.join(centre, "node").filter("rep != centre").select(F.least("centre", "rep").alias("a"), F.greatest("centre", "rep").alias("b")).distinct()


def _full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, s, fine): whole shingle sets and fine sketches of the documents named; only they are shingled again."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS

    def sets(batches):
        for batch in slices(batches, "b"):
            made = text_sets(batch.column("b").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in made], pa.binary()), pa.array([fine_sketch(s).tobytes() for s in made], pa.binary())], names=["id", "s", "fine"])

    return docs.join(F.broadcast(ids) if few else ids, docs["doc_id"] == ids["rep"], "left_semi").mapInArrow(sets, "id long, s binary, fine binary")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """The link condition on two sorted sets."""
    small, large = (x, y) if x.size <= y.size else (y, x)
    if not small.size or DEN * small.size < NUM * large.size:
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, large.size - 1)] == small).sum())
    return DEN * both >= NUM * (x.size + y.size - both)


def _linked(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def confirm(batches):
        for batch in batches:
            for part in slices([batch], "sa"):
                keep = []
                for x, y in zip(part.column("sa").to_pylist(), part.column("sb").to_pylist()):
                    keep.append(similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wide = pairs.join(full.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(full.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    return wide.select("a", "b", "sa", "sb").mapInArrow(confirm, "a long, b long")


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node reachable) of the edges a - b; pointer jumping in numpy."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: a.size], at[a.size :]
    label = np.arange(names.size)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            return names, names[label]
        label = new


def components(edges: DataFrame, small: int | None = None, max_rounds: int = 60) -> DataFrame:
    """(node, root): the least id reachable, for nodes that have edges.

    Up to ``small`` edges (a bound on memory) one task joins them; more go through alternating star
    contraction, whose rounds stay distributed. Both give the same result.
    """
    small = UNION_EDGES if small is None else small
    now = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v"), "edges")
    if now.count() <= small:

        def one(batches):
            parts = [(x.column("u").to_numpy(zero_copy_only=False), x.column("v").to_numpy(zero_copy_only=False)) for x in batches]
            if parts:
                node, root = union_find(*(np.concatenate(c) for c in zip(*parts)))
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], names=["node", "root"])

        return stage(now.coalesce(1).mapInArrow(one, "node long, root long"), "roots")
    now = stage(now.distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = stage(star, "edges")
        unstage(now)
        now = after
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    own = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(own)


def _alike(fine: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j, of members of different components whose sketches agree enough."""
    a, b = [], []
    for i in range(len(root) - 1):
        at = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        if at.size:
            at = at[(fine[at] == fine[i]).sum(axis=1) >= LEAST_SAME]
            a.append(np.full(at.size, i))
            b.append(at)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64),) * 2


def _grouped(batches, names: list[str]):
    """The columns of each node in turn, from batches sorted by node; one node and one batch are held."""
    held = None
    for batch in batches:
        part = []
        for name in ("node", *names):
            column = batch.column(name)
            if pa.types.is_binary(column.type):
                values = np.empty(batch.num_rows, object)
                values[:] = column.to_pylist()
                part.append(values)
            else:
                part.append(column.to_numpy(zero_copy_only=False))
        if held is not None:
            part = [np.concatenate(x) for x in zip(held, part)]
        edges = [0, *(np.flatnonzero(np.diff(part[0])) + 1).tolist()]
        for lo, hi in zip(edges, edges[1:]):
            yield [x[lo:hi] for x in part]
        held = [x[edges[-1] :] for x in part]
    if held is not None and len(held[0]):
        yield held


def _packed(rows: list[tuple], names: list[str]):
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*rows)], names=names)


def _hopeful(rows: DataFrame) -> DataFrame:
    """(node, rep, root) of the members that some member of another component may be similar to, by sketches."""

    def run(batches):
        out, size = [], 0
        for node, rep, root, fine in _grouped(batches, ["rep", "root", "fine"]):
            i, j = _alike(np.frombuffer(b"".join(fine), np.uint8).reshape(-1, FINE), root)
            at = np.unique(np.concatenate([i, j]))
            if at.size:
                out.append((node[at], rep[at], root[at]))
                size += at.size
            if size > 50_000:
                yield from _packed(out, ["node", "rep", "root"])
                out, size = [], 0
        yield from _packed(out, ["node", "rep", "root"])

    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(run, "node long, rep long, root long")


def _settled(rows: DataFrame) -> DataFrame:
    """Links (a, b) inside each node of rows (node, rep, root, fine, s): full sets decide, one link joins two components."""

    def run(batches):
        out = []
        for _, rep, root, fine, s in _grouped(batches, ["rep", "root", "fine", "s"]):
            sets = [np.frombuffer(x, np.uint64) for x in s]
            joined = {r: r for r in root.tolist()}

            def find(x, joined=joined):
                while joined[x] != x:
                    x = joined[x]
                return x

            for i, j in zip(*(x.tolist() for x in _alike(np.frombuffer(b"".join(fine), np.uint8).reshape(-1, FINE), root))):
                x, y = find(int(root[i])), find(int(root[j]))
                if x != y and similar(sets[i], sets[j]):
                    joined[x] = y
                    out.append((rep[i : i + 1], rep[j : j + 1]))
            if len(out) > 10_000:
                yield from _packed(out, ["a", "b"])
                out = []
        yield from _packed(out, ["a", "b"])

    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(run, "a long, b long")


def _across(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) between the components x and y of each of ``pairs``.

    The smaller side's members go to every chunk of the larger side's, so no task holds more than a chunk.
    """
    size = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    known = pairs.join(size.withColumnsRenamed({"root": "x", "n": "nx"}), "x").join(size.withColumnsRenamed({"root": "y", "n": "ny"}), "y")
    swap = F.col("nx") > F.col("ny")
    known = known.select(F.when(swap, F.col("y")).otherwise(F.col("x")).alias("few"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("many"), F.ceil(F.greatest("nx", "ny") / CHUNK).cast("int").alias("chunks"))
    many = members.join(known.select(F.col("many").alias("root"), "chunks").distinct(), "root").select(F.col("root").alias("many"), F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int").alias("chunk"), "rep", "fine")
    few = known.join(members.withColumnRenamed("root", "few"), "few").select("many", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "rep", "fine")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(left, right):
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        take = lambda t: (np.array(t.column("rep").to_pylist(), np.int64), np.frombuffer(b"".join(t.column("fine").to_pylist()), np.uint8).reshape(-1, FINE))
        (xs, tx), (ys, ty) = take(left), take(right)
        hits = [np.flatnonzero((ty == own).sum(axis=1) >= LEAST_SAME) for own in tx]
        a, b = np.repeat(xs, [h.size for h in hits]), ys[np.concatenate(hits)]
        return pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=schema)

    return few.groupBy("many", "chunk").cogroup(many.groupBy("many", "chunk")).applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every distinct document id."""
    small_batches(docs.sparkSession)
    src = docs.select(docs[key].cast("long").alias("doc_id"), utf8(docs[text]).alias("b"))
    sketched = stage(_sketches(src), "sketch")
    base = sketched.select("doc_id", "n_shingles", "set_key")
    reps = stage(sketched.filter("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("tokens").alias("tokens")), "reps")

    # each node's members against its most central one
    paths = _paths(reps, DEPTH, BRANCH)
    sizes = paths.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = stage(paths.join(sizes, "node"), "nodes")
    star = stage(_stars(met), "pairs")
    ids = stage(met.select("rep").distinct(), "ids")
    full = stage(_full_sets(src, ids), "sets")
    links = stage(_linked(star, full), "links")
    roots = components(links)
    used = [met, star, ids, full, links]
    fine = full.select(F.col("id").alias("rep"), "fine")
    nodes = met.select("node", "rep")
    for turn in range(ROUNDS):
        last = turn == ROUNDS - 1
        held = nodes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("node", "rep", F.coalesce("root", "rep").alias("root"))
        # a node of one component is done
        opened = stage(held.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("node", "n"), "opened")
        near = held.join(opened.filter(F.col("n") <= CHUNK).select("node"), "node").join(fine, "rep")
        hopeful = stage(_hopeful(near.select("node", "rep", "root", "fine")), "hopeful")
        found = _settled(hopeful.join(full.withColumnRenamed("id", "rep"), "rep").select("node", "rep", "root", "fine", "s"))
        large = opened.filter(F.col("n") > CHUNK)
        deep = None if large.isEmpty() else stage(held.join(large.select("node"), "node"), "deep")
        if deep is not None and last:
            own = deep.select("node", "root").distinct()
            meet = own.withColumnRenamed("root", "x").join(own.withColumnRenamed("root", "y"), "node").filter("x < y").select("x", "y").distinct()
            members = deep.select("rep", "root").distinct().join(fine, "rep")
            found = found.unionByName(_linked(_across(members, meet), full))
        more = stage(found, "links")
        used += [opened, hopeful, more, *([deep] if deep is not None else [])]
        if not more.isEmpty():
            links = links.unionByName(more)
            roots = components(links)
        if deep is None or last:
            break
        below = deep.select(F.col("node").alias("at"), "rep").join(reps.select("rep", "tokens"), "rep")
        nodes = stage(_paths(below, DEPTH, 2 * BRANCH, "at"), "nodes")
        used.append(nodes)
    unstage(*used)  # the result needs the sketches, the classes and the last components only
    classes = reps.select("set_key", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("root", "rep").alias("component_id"))
    alone = base.filter("set_key is null or doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    done = base.filter("doc_id is not null").join(classes, "set_key").select("doc_id", "n_shingles", "component_id").unionByName(alone)
    component = F.coalesce("component_id", "doc_id")
    return done.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")).distinct()


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` of each group of near duplicates, with all its columns.

    An id that is kept keeps each of its different texts (one row each); rows with a null id stay.
    """
    kept = near_duplicates(docs.filter(docs[key].isNotNull()), key, text).filter("kept").select(F.col("doc_id").alias("_kept_id"))
    one = docs.join(kept, docs[key] == kept["_kept_id"], "left_semi").dropDuplicates([key, text])
    return one.unionByName(docs.filter(docs[key].isNull()))


#: DuckDB: all pairs that share a shingle, on the exact sets; for small tables.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, chr(31)) ELSE array_to_string(w[i:i + 4], chr(31)) END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
c AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(30) ORDER BY g)) AS k FROM s GROUP BY doc_id),
r AS (SELECT k, min(doc_id) AS rep, any_value(n) AS n FROM c GROUP BY k),
p AS (SELECT s.g, r.rep, r.n FROM s JOIN r ON s.doc_id = r.rep),
x AS (SELECT a.rep AS a, b.rep AS b FROM p a JOIN p b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM x UNION SELECT b, a FROM x),
t(a, z) AS (SELECT rep, rep FROM r UNION SELECT e.b, t.z FROM t JOIN e ON t.a = e.a),
m AS (SELECT a, min(z) AS root FROM t GROUP BY a)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(m.root, d.doc_id) AS component_id, coalesce(m.root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN r ON c.k = r.k LEFT JOIN m ON m.a = r.rep
"""
