"""Row policies: who may read or write which rows of a table.

A policy is a condition that may use the caller's claims and membership in other tables; it compiles to a
filter and semi or anti joins below the query. Several policies of a table and scope admit a row if any does.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.compile import restrict, table_scope
from ..plans.dialect import parse_policy


@dataclass(frozen=True)
class Policy:
    table: str
    scopes: tuple[str, ...]
    using: str


class Policies:
    """The registry that GRANT and REVOKE change."""

    def __init__(self):
        self.rows: list[Policy] = []

    def grant(self, table: str, scopes: Sequence[str], using: str) -> None:
        unknown = set(scopes) - {"read", "write"}
        if unknown or not scopes:
            raise ValueError("scopes are read and write")
        parse_policy(using)
        self.revoke(table, scopes)
        self.rows.append(Policy(table, tuple(scopes), using))

    def revoke(self, table: str, scopes: Sequence[str] = ("read", "write")) -> None:
        kept = []
        for p in self.rows:
            left = tuple(s for s in p.scopes if p.table != table or s not in scopes)
            if left:
                kept.append(Policy(p.table, left, p.using))
        self.rows = kept

    def of(self, table: str, scope: str) -> list[Policy]:
        return [p for p in self.rows if p.table == table and scope in p.scopes]


def admitted(df: DataFrame, table: str, policies: Sequence[Policy], claims: Mapping[str, str], tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows that some policy admits; no policy admits none."""
    if not policies:
        return df.filter(F.lit(False))
    parts = [restrict(df, parse_policy(p.using, dict(claims)), table_scope(df, table), tables) for p in policies]
    if len(parts) == 1:
        return parts[0]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def denied(rows: DataFrame, table: str, policies: Sequence[Policy], claims: Mapping[str, str], tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    """WITH CHECK: new rows that no policy admits."""
    return rows.join(admitted(rows, table, policies, claims, tables).select(key), key, "left_anti")
