"""What the operators share: the shared folder, staged tables, words and column clashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# White space between words, and ASCII capitals with their small letters.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_WEIGHTS = np.random.default_rng(20240301).integers(1, 2**63, 1 << 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes hashed at once.
_PIECE = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the setting is missing (local tests) a temporary folder is made and set.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tarn-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Hand Python at most ``rows`` rows at a time: whole texts and sets make wide rows, and batches count rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


_STAGED: list[DataFrame] = []


@contextmanager
def scratch(*keep_out: DataFrame):
    """Delete what was staged inside when it ends, and ``keep_out``, but for the frames given to the yielded function."""
    first, kept = len(_STAGED), []
    try:
        yield lambda df: kept.append(df) or df
    finally:
        done = [*_STAGED[first:], *keep_out]
        del _STAGED[first:]
        unstage(*(df for df in done if not any(df is k for k in kept)))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tarn-stage/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tarn_path = path
    _STAGED.append(out)
    return out


def unstage(*dfs: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in dfs:
        path = getattr(df, "_tarn_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _piece_words(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of the words of a piece of lower-case text: a weighted sum of bytes and length, mixed."""
    inside = ~_SPACE[b]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    first, length = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not first.size:
        return first, np.empty(0, np.uint64)
    length = length - first
    offset = np.cumsum(length) - length
    place = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(offset, length)
    weight = _WEIGHTS[place & (_WEIGHTS.size - 1)]
    if length.max() > _WEIGHTS.size:
        weight = weight ^ mix((place // _WEIGHTS.size).astype(np.uint64)) << np.uint64(1)
    value = (b[inside].astype(np.uint64) + np.uint64(1)) * weight
    return first, mix(np.add.reduceat(value, offset) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words in order, number of words of each text).

    Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z in lower case. Memory follows
    ``_PIECE`` and the result, not the texts: long ones are cut between words.
    """
    whole = b" ".join(texts).translate(_LOWER)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    buffer = np.frombuffer(whole, np.uint8)
    firsts, hashes, at = [], [], 0
    while at < len(whole):
        gap = _GAP.search(whole, at + _PIECE)
        end = gap.start() if gap else len(whole)
        first, h = _piece_words(buffer[at:end])
        firsts.append(first + at)
        hashes.append(h)
        at = end
    if not firsts:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    cut = np.searchsorted(np.concatenate(firsts), begins)
    h = np.concatenate(hashes)
    return h, np.diff(np.append(cut, h.size))


def utf8(col) -> "F.Column":
    """A text column as UTF-8 bytes; null is empty."""
    return F.coalesce(F.encode(col, "UTF-8"), F.lit(b"")) if not isinstance(col, str) else F.coalesce(F.encode(F.col(f"`{col}`"), "UTF-8"), F.lit(b""))


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterable[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds at most about ``limit`` bytes a slice; a longer value stands alone."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        start, size = 0, 0
        for i, x in enumerate(lengths):
            x = 0 if x is None or x != x else int(x)
            if i > start and size + x > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += x
        yield batch.slice(start, n - start)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
