"""The text edge: result pages as JSON, rows as text, statement files."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import cast_out
from ..plans.compile import compile_query
from ..plans.dialect import from_params
from ..plans.spec import QuerySpec


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON object a row; missing values are null."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def text_rows(df: DataFrame) -> DataFrame:
    """Every value as text, as the wire has it: NULL is empty, whole doubles have no fraction."""
    return df.select(*[cast_out(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def page(tables: Mapping[str, DataFrame], table: str, params: Mapping[str, str], spec: QuerySpec | None = None) -> tuple[DataFrame, str]:
    """A query by URL-style parameters: (page, content range ``first-last/total`` with the exact total)."""
    spec = spec or from_params(table, dict(params))
    rows = compile_query(spec, tables)
    total = compile_query(replace(spec, limit=None, offset=0, order_by=()), tables).count()
    shown = min(total - spec.offset, spec.limit if spec.limit is not None else total)
    span = f"{spec.offset}-{spec.offset + shown - 1}" if shown > 0 else "*"
    return rows, f"{span}/{total}"


def chunks(df: DataFrame, size: int = 64 << 10) -> Iterator[str]:
    """A JSON array in pieces of about ``size`` characters; rows stream from the executors by partition."""
    part, length, first = ["["], 1, True
    for row in json_rows(df).toLocalIterator():
        text = row["value"] if first else "," + row["value"]
        first = False
        part.append(text)
        length += len(text)
        if length >= size:
            yield "".join(part)
            part, length = [], 0
    yield "".join(part) + "]"


def statements(text: str) -> list[str]:
    """Statements of a migration file: ended by ``;`` outside quotes, or one a line; ``--`` and ``#`` comments."""
    text = re.sub(r"(?m)^\s*(--|#).*$", "", text)
    if ";" not in text:
        return [line.strip() for line in text.splitlines() if line.strip()]
    out, held, quote = [], [], None
    for c in text:
        if quote:
            quote = None if c == quote else quote
        elif c in "'\"":
            quote = c
        if c == ";" and not quote:
            out.append("".join(held).strip())
            held = []
        else:
            held.append(c)
    out.append("".join(held).strip())
    return [" ".join(s.split("\n")) for s in out if s]
