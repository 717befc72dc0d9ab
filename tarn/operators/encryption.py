"""Encrypted columns: AES-GCM values at rest, equality only through a keyed blind column.

A sealed value is ``<key id>:<base64>``, so values sealed under older keys stay readable while they are
rewrapped. Searchable columns carry a second column with a keyed digest; equality, uniqueness and joins on
it work without opening a value, ordering and patterns do not.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.schema import Table
from ..plans.spec import AnyOf, DialectError, QuerySpec

BLIND = "_blind_"


class Keyring:
    """Keys by id; the newest seals, all open. Keys stay on the driver and travel inside plans only."""

    def __init__(self, secrets: Mapping[str, bytes]):
        if not secrets:
            raise ValueError("a keyring needs a key")
        self.keys = {name: hashlib.sha256(b"seal" + secret).digest() for name, secret in secrets.items()}
        self.newest = list(self.keys)[-1]
        first = next(iter(secrets.values()))
        self.index_key = hashlib.sha256(b"blind" + first).digest()

    def rotated(self, name: str, secret: bytes) -> Keyring:
        out = Keyring.__new__(Keyring)
        out.keys = {**self.keys, name: hashlib.sha256(b"seal" + secret).digest()}
        out.newest, out.index_key = name, self.index_key
        return out

    def seal(self, col: Column) -> Column:
        made = F.base64(F.aes_encrypt(col.cast("string").cast("binary"), F.lit(self.keys[self.newest]), F.lit("GCM")))
        return F.when(col.isNotNull(), F.concat(F.lit(self.newest + ":"), made))

    def unseal(self, col: Column) -> Column:
        """The text of a sealed value; NULL if its key is unknown."""
        out = F.lit(None).cast("string")
        body = F.unbase64(F.substring_index(col, ":", -1))
        for name, key in self.keys.items():
            out = F.when(F.substring_index(col, ":", 1) == name, F.try_aes_decrypt(body, F.lit(key), F.lit("GCM")).cast("string")).otherwise(out)
        return out

    def retired(self, name: str) -> Keyring:
        """Without a key: what it seals can't be opened any more. The newest can't go."""
        if name == self.newest or name not in self.keys:
            raise ValueError(f"{name!r} can't be retired")
        out = Keyring.__new__(Keyring)
        out.keys = {k: v for k, v in self.keys.items() if k != name}
        out.newest, out.index_key = self.newest, self.index_key
        return out

    def blind(self, col: Column) -> Column:
        """HMAC-SHA256 of the text, in built-in functions."""
        block = self.index_key.ljust(64, b"\0")
        inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in block)), F.encode(col.cast("string"), "UTF-8")), 256)
        return F.when(col.isNotNull(), F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in block)), F.unhex(inner)), 256))

    def blind_value(self, text: str) -> str:
        return hmac.new(self.index_key, text.encode(), hashlib.sha256).hexdigest()

    def same(self, a: str, b: str) -> bool:
        return hmac.compare_digest(a, b)


def seal_rows(table: Table, df: DataFrame, ring: Keyring) -> DataFrame:
    """Rows at rest: encrypted columns sealed, with a blind column beside each searchable one."""
    out = []
    for name in df.columns:
        c = next((c for c in table.columns if c.name == name), None)
        col = F.col(f"`{name}`")
        out.append(ring.seal(col).alias(name) if c and c.encrypted else col)
        if c and c.encrypted and c.searchable:
            out.append(ring.blind(col).alias(BLIND + name))
    return df.select(*out)


def open_rows(table: Table, df: DataFrame, ring: Keyring | None) -> DataFrame:
    """Rows as read: opened with a keyring, NULL in encrypted columns without one."""
    out = []
    for name in df.columns:
        if name.startswith(BLIND):
            continue
        c = next((c for c in table.columns if c.name == name), None)
        col = F.col(f"`{name}`")
        if c and c.encrypted:
            col = (ring.unseal(col).cast(c.spark) if ring else F.lit(None).cast(c.spark)).alias(name)
        out.append(col)
    return df.select(*out)


def find(table: Table, df: DataFrame, column: str, text: str, ring: Keyring) -> DataFrame:
    """Sealed rows whose searchable column equals a text."""
    if not table.column(column).searchable:
        raise DialectError(f"{column!r} is not searchable")
    return df.filter(F.col(BLIND + column) == ring.blind_value(text))


def rewrap(table: Table, df: DataFrame, ring: Keyring) -> DataFrame:
    """Rows sealed under older keys sealed again under the newest."""
    sealed = {c.name for c in table.columns if c.encrypted}
    old = lambda n: ~F.col(f"`{n}`").startswith(ring.newest + ":")
    return df.select(*[F.when(old(n), ring.seal(ring.unseal(F.col(f"`{n}`")))).otherwise(F.col(f"`{n}`")).alias(n) if n in sealed else F.col(f"`{n}`") for n in df.columns])


def guard(spec: QuerySpec, table: Table) -> None:
    """Reject conditions, orders, groups and joins that would need an encrypted column's value."""
    hidden = {c.name: c for c in table.columns if c.encrypted}
    bare = lambda name: name.rpartition(".")[2]
    for group in spec.where:
        for t in group.tests if isinstance(group, AnyOf) else ():
            c = hidden.get(bare(t.field))
            if c and not (t.op in ("IS NULL", "IS NOT NULL") or t.op in ("=", "IN") and c.searchable):
                raise DialectError(f"{t.field!r} is encrypted: only equality on a searchable column is possible")
    used = [*spec.group_by, *(n for n, _ in spec.order_by), *(x for j in spec.joins for x in (j.left, j.right)), *(a.column for a in spec.aggregates if a.column)]
    for name in used:
        if bare(name) in hidden:
            raise DialectError(f"{name!r} is encrypted")
