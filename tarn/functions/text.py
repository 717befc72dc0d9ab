"""Text helpers as expressions: glob patterns, byte ranges, longest common subsequence."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def glob_regex(pattern: str) -> str:
    """A Java and Python regular expression for ``* ? [..] [^..]`` and backslash escapes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("(?s:.*)")
        elif c == "?":
            out.append("(?s:.)")
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^" + body[1:] if body[0] in "^!" else body) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def glob(col: Column, pattern: str) -> Column:
    """Whether a text matches a glob; a plain prefix pattern stays pushable."""
    if re.fullmatch(r"[^*?\[\\]*\*", pattern):
        return col.startswith(pattern[:-1])
    if not re.search(r"[*?\[\\]", pattern):
        return col == pattern
    return col.rlike(glob_regex(pattern))


def byte_range(value: Column, start: int, end: int) -> Column:
    """The inclusive byte range of a binary value; negative places count from its end."""
    n = F.octet_length(value)
    a = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    b = F.lit(end) if end >= 0 else n + end
    b = F.least(b, n - 1)
    return F.when((a <= b) & (b >= 0), F.substring(value, a + 1, b - a + 1)).otherwise(F.lit(b""))


def write_range(value: Column, offset: int, patch: bytes) -> Column:
    """The value with bytes overwritten from an offset, padded by zeros where it is shorter."""
    value = F.coalesce(value, F.lit(b""))
    if not patch:
        return value
    padded = F.when(F.octet_length(value) < offset, F.rpad(value, F.lit(offset), F.lit(b"\0"))).otherwise(value)
    head, tail = F.substring(padded, F.lit(1), F.lit(offset)), F.substring(padded, F.lit(offset + len(patch) + 1), F.octet_length(padded))
    return F.concat(head, F.lit(patch), tail)


def lcs(a: str, b: str) -> str:
    """One longest common subsequence, by the usual table with rows of Python integers as bit sets."""
    masks: dict[str, int] = {}
    for j, c in enumerate(b):
        masks[c] = masks.get(c, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, []
    for c in a:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    out, j = [], len(b) - 1
    for i in range(len(a) - 1, -1, -1):
        while j >= 0 and rows[i] >> j & 1:
            j -= 1
        if j < 0:
            break
        if i == 0 or rows[i - 1] >> j & 1:
            out.append(a[i])
            j -= 1
    return "".join(reversed(out))


def lcs_matches(a: str, b: str, least: int = 0) -> list[tuple[int, int, int, int, int]]:
    """Common runs of one longest common subsequence from its end: (a first, a last, b first, b last, length)."""
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            end_a, end_b = i - 1, j - 1
            while i and j and a[i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
            if end_a - i + 1 >= least:
                out.append((i, end_a, j, end_b, end_a - i + 1))
        elif rows[i - 1][j] > rows[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out


@F.pandas_udf(T.StringType())
def lcs_text(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Arrow-batched LCS of two text columns; NULL if either is NULL."""
    for a, b in parts:
        yield pd.Series([lcs(x, y) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="object")


@F.pandas_udf(T.LongType())
def lcs_length(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in parts:
        yield pd.Series([len(lcs(x, y)) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="Int64")
