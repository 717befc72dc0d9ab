"""BPE encoding and decoding with a byte-level tokenizer file, equal to the tokenizers library.

Texts go to a Rust byte-pair encoder whose ranks come from the tokenizer file itself. A piece that the
pre-tokenizer leaves unsplit and that is longer than ``PIECE`` bytes is encoded by tree concatenation: it is
halved down to leaves, which are encoded on their own (side by side where there are many), then halves are joined
on the way up. A window of tokens around each join is encoded again, growing until its first token equals the
left half's token at that place and its last the right half's. The overlapping tokens make each adjacent pair of
the joined sequence a pair that some encoding holds, which is what makes a byte-pair encoding the canonical one.

Defined results: null and empty texts have no tokens; special tokens of the file inside a text become
their ids, as the library does by default; equal texts give equal ids; null keys stay; a column that has the name
of a new one is replaced, all others stay. Rows are independent (no shuffle).
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices

PIECE = 32
#: Leaves from which on they are encoded on threads.
MANY = 256
# Fixed value: the published split pattern of this family of tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LONG_GAP = re.compile(rb"\s{%d}" % (PIECE // 3))


@functools.cache
def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, spec: str):
        import regex

        doc = json.loads(spec)
        pre = doc["pre_tokenizer"]
        if doc["model"]["type"] != "BPE" or doc.get("normalizer") or pre["type"] != "ByteLevel" or pre["add_prefix_space"]:
            raise ValueError("a byte-level BPE file without normalizer and prefix space is needed")
        symbols = _byte_symbols()
        special = {t["content"]: t["id"] for t in doc["added_tokens"]}
        if any(t[k] for t in doc["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that strip or need word edges are not supported")
        self.ids = {bytes(symbols[c] for c in s): i for s, i in doc["model"]["vocab"].items() if s not in special}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in doc["model"]["merges"]]
        order = [self.ids[bytes(symbols[c] for c in "".join(m))] for m in merges]
        # The encoder takes merge order for ids: single bytes first, then merges; map back when a file differs.
        singles = [k for k in self.ids if len(k) == 1]
        back = {v: k for k, v in self.ids.items()}
        ranks = {k: i for i, k in enumerate([*sorted(singles), *dict.fromkeys(back[i] for i in order)])}
        self.to_id = np.zeros(len(ranks), np.uint32)
        for k, r in ranks.items():
            self.to_id[r] = self.ids[k]
        self.core = tiktoken.Encoding("tarn", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = tiktoken.Encoding("tarn-unsplit", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
        self.special = special
        self.pattern = regex.compile(PATTERN)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.tokens = back | {i: s.encode() for s, i in special.items()}
        self.by_rank = [k for k in ranks]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text as unsigned 32-bit integers."""
        out = []
        for part in self.split.split(text) if self.split else [text]:
            if part in self.special:
                out.append(np.array([self.special[part]], np.uint32))
            elif part:
                out.append(self.to_id[np.array(self._ranks(part), np.int64)])
        return np.concatenate(out) if out else np.empty(0, np.uint32)

    def _ranks(self, text: str) -> list[int]:
        raw = text.encode()
        if max(map(len, raw.split()), default=0) <= PIECE and not _LONG_GAP.search(raw):
            return self.core.encode_ordinary(text)
        out: list[int] = []
        known: dict[str, list[int]] = {}
        for p in self.pattern.findall(text):
            if p not in known:
                known[p] = self.tree(p) if len(p.encode()) > PIECE else self.whole.encode_ordinary(p)
            out += known[p]
        return out

    def tree(self, piece: str, leaf: int = PIECE) -> list[int]:
        """Tree concatenation of one unsplit piece; leaves have ``leaf`` characters at most."""
        leaves: list[str] = []

        def halve(lo: int, hi: int):
            if hi - lo <= leaf:
                leaves.append(piece[lo:hi])
                return len(leaves) - 1
            mid = (lo + hi) // 2
            return halve(lo, mid), halve(mid, hi)

        def join(node) -> list[int]:
            return parts[node] if isinstance(node, int) else self.join(join(node[0]), join(node[1]))

        root = halve(0, len(piece))
        parts = self.whole.encode_ordinary_batch(leaves, num_threads=2) if len(leaves) >= MANY else [self.whole.encode_ordinary(x) for x in leaves]
        return join(root)

    def join(self, left: list[int], right: list[int], start: int = 4) -> list[int]:
        """Join two encodings: grow a window over the seam until both sides agree with it."""
        p, q = min(start, len(left)), min(start, len(right))
        inner = lambda t: self.by_rank[t][0] & 0xC0 == 0x80  # noqa: E731  # a token that begins inside a character
        while True:
            while p < len(left) and inner(left[len(left) - p]):
                p += 1
            while q < len(right) and inner(right[q]):
                q += 1
            window = self.whole.encode_ordinary(b"".join(self.by_rank[t] for t in left[len(left) - p :] + right[:q]).decode())
            grow_left = p < len(left) and window[0] != left[len(left) - p]
            grow_right = q < len(right) and window[-1] != right[q - 1]
            if not grow_left and not grow_right:
                return left[: len(left) - p] + window + right[q:]
            p = min(len(left), 2 * p) if grow_left else p
            q = min(len(right), 2 * q) if grow_right else q

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids.tolist() if i in tokens])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def codec(spec: str) -> Codec:
    return Codec(spec)


def load_spec(path: str) -> str:
    """The tokenizer file's text; read on the driver and shipped with the task (a few MB, fixed by the file)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _over(df: DataFrame, source: str, fn: Callable, schema: str, kinds: list[pa.DataType], spec: str) -> DataFrame:
    shipped = df.sparkSession.sparkContext.broadcast(spec)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        c = codec(shipped.value)
        for batch in slices(batches, "v", 4 << 20) if source == "text" else batches:
            rows = [(k, *fn(c, v)) for k, v in zip(batch.column("k").to_pylist(), batch.column("v").to_pylist())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)

    return df.mapInArrow(run, schema)


def encode_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the whole text's token ids; null counts as empty."""
    src = docs.select(docs[key].alias("k"), docs[text].alias("v"))
    return _over(src, "text", lambda c, v: (c.encode(v or "").astype(np.int32),), f"{key} long, ids array<int>", [pa.int64(), pa.list_(pa.int32())], load_spec(path))


def decode_ids(rows: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text): the text of each id list; null and empty lists give an empty text."""
    src = rows.select(rows[key].alias("k"), rows[ids].alias("v"))
    return _over(src, "ids", lambda c, v: (c.decode(np.array(v or [], np.int64)),), f"{key} long, text string", [pa.int64(), pa.string()], load_spec(path))


def bpe_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each whole text, decode the ids again, and return counts and digests of both."""

    def one(c: Codec, v: str | None):
        ids = c.encode(v or "")
        return ids.size, hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(c.decode(ids).encode("utf-8")).hexdigest()

    src = docs.select(docs[key].alias("k"), docs[text].alias("v"))
    return _over(src, "text", one, f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string", [pa.int64(), pa.int64(), pa.string(), pa.string()], load_spec(path))


def with_ids(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = "decoded") -> DataFrame:
    """``docs`` with its token ids, their number and, unless its name is None, the text decoded from them."""
    shipped = docs.sparkSession.sparkContext.broadcast(load_spec(path))
    new = [ids, "n_tokens", *([decoded] if decoded else [])]
    rest = [c for c in docs.columns if c not in new or c == text]
    src = docs.select(*[docs[f"`{c}`"] for c in rest])
    kinds = [T.ArrayType(T.IntegerType()), T.LongType(), T.StringType()]
    schema = T.StructType([*src.schema, *(T.StructField(c, k) for c, k in zip(new, kinds))])

    def run(batches):
        c = codec(shipped.value)
        for batch in slices(batches, text, 4 << 20):
            got = [c.encode(x or "") for x in batch.column(text).to_pylist()]
            made = [pa.array([g.astype(np.int32) for g in got], pa.list_(pa.int32())), pa.array([g.size for g in got], pa.int64())]
            if decoded:
                made.append(pa.array([c.decode(g) for g in got], pa.string()))
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in rest], *made], names=[*rest, *new])

    return src.mapInArrow(run, schema)
