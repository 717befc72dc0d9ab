"""Bit operations on binary columns as built-in expressions; bits count from the first byte's high bit."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_NIBBLES = [(f"{i:X}", f"{i:04b}") for i in range(16)]


def _table(pairs: list[tuple[str, str]]) -> Column:
    return F.create_map(*[F.lit(x) for p in pairs for x in p])


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression of a value that is computed once, however often the expression names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _word_places(size: Column) -> Column:
    """The places of the first bytes of a value's words of 8 bytes; one word for an empty value."""
    return F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(8))


def _word(value: Column, at: Column) -> Column:
    """8 bytes from a place as a long, zeros beyond the end."""
    return F.conv(F.rpad(F.hex(F.substring(value, at + 1, F.lit(8))), 16, "0"), 16, -10).cast("long")


def bits(value: Column) -> Column:
    """The bits of a binary value as text of 0 and 1; NULL is empty."""
    digits = F.filter(F.split(F.hex(F.coalesce(value, F.lit(b""))), ""), lambda d: d != "")
    return F.array_join(F.transform(digits, lambda d: F.element_at(_table(_NIBBLES), d)), "")


def pack(text: Column) -> Column:
    """The binary value of a text of bits whose length is a multiple of 8."""
    back = [(b, h) for h, b in _NIBBLES]
    n = F.length(text)
    nibbles = F.transform(F.when(n > 0, F.sequence(F.lit(0), F.floor(n / 4).cast("int") - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.element_at(_table(back), F.substring(text, i * 4 + 1, F.lit(4))))
    return F.unhex(F.array_join(nibbles, ""))


def get_bit(value: Column, offset: int) -> Column:
    """The bit at an offset; 0 beyond the end."""
    byte = F.conv(F.hex(F.substring(value, offset // 8 + 1, 1)), 16, 10).cast("int")
    return F.coalesce(F.shiftright(byte, 7 - offset % 8).bitwiseAND(F.lit(1)), F.lit(0))


def _padded(text: Column, width: int) -> Column:
    size = -(-width // 8) * 8
    return F.when(F.length(text) < size, F.rpad(text, size, "0")).otherwise(text)


def set_bits(value: Column, offset: int, patch: Column, width: int) -> Column:
    """The value with ``width`` bits from an offset replaced by a text of bits, grown by zeros if needed."""
    text = _padded(bits(value), offset + width)
    return pack(F.concat(F.substring(text, 1, offset), patch, F.substring(text, F.lit(offset + width + 1), F.length(text))))


def set_bit(value: Column, offset: int, bit: int) -> Column:
    return set_bits(value, offset, F.lit(str(bit)), 1)


def _window(value: Column, start: int | None, end: int | None, unit: str) -> tuple[Column, Column]:
    """(bits in the inclusive range, place of its first bit)."""
    text = bits(value)
    if start is None:
        return text, F.lit(0)
    scale = 8 if unit.upper() == "BYTE" else 1
    n = F.length(text) / scale if scale > 1 else F.length(text)
    n = n.cast("int")
    a = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    last = -1 if end is None else end
    b = F.least(F.lit(last) if last >= 0 else n + last, n - 1)
    part = F.when(a <= b, F.substring(text, a * scale + 1, (b - a + 1) * scale)).otherwise(F.lit(""))
    return part, a * scale


def bit_count(value: Column, start: int | None = None, end: int | None = None, unit: str = "BYTE") -> Column:
    """Ones in the value or in an inclusive range of bytes or bits."""
    if start is None:
        return F.bitmap_count(F.coalesce(value, F.lit(b""))).cast("long")
    part, _ = _window(value, start, end, unit)
    return F.length(F.replace(part, F.lit("0"), F.lit(""))).cast("long")


def bit_position(value: Column, bit: int, start: int | None = None, end: int | None = None, unit: str = "BYTE") -> Column:
    """Place of the first such bit; -1 if none; a value of ones only has its first 0 just past the end."""
    part, first = _window(value, start, end, unit)
    at = F.instr(part, str(bit))
    past = F.lit(-1) if bit or end is not None else F.when(F.length(part) > 0, first + F.length(part)).otherwise(F.lit(-1))
    empty = F.lit(-1 if bit else 0)
    return F.when(F.coalesce(F.octet_length(value), F.lit(0)) == 0, empty).when(at > 0, first + at - 1).otherwise(past).cast("long")


def bit_op(op: str, values: list[Column]) -> Column:
    """AND, OR, XOR of binary columns, or NOT of one; shorter values are padded by zeros."""
    op = op.upper()
    steps = {"AND": lambda x, y: x.bitwiseAND(y), "OR": lambda x, y: x.bitwiseOR(y), "XOR": lambda x, y: x.bitwiseXOR(y)}

    def made(held: Column) -> Column:
        parts = [held[f"v{i}"] for i in range(len(values))]
        size = F.greatest(*[F.octet_length(v) for v in parts]) if len(parts) > 1 else F.octet_length(parts[0])
        one = (lambda at: F.bitwise_not(_word(parts[0], at))) if op == "NOT" else lambda at: reduce(steps[op], [_word(v, at) for v in parts])
        digits = F.transform(_word_places(size), lambda at: F.lpad(F.hex(one(at)), 16, "0"))
        return F.substring(F.unhex(F.array_join(digits, "")), F.lit(1), size)

    return _with(F.struct(*[F.coalesce(v, F.lit(b"")).alias(f"v{i}") for i, v in enumerate(values)]), made)


def field_get(value: Column, kind: str, offset: int) -> Column:
    """BITFIELD GET: an unsigned (u1 to u63) or signed (i1 to i64) number at a bit offset."""
    width = int(kind[1:])
    part = F.substring(F.rpad(bits(value), F.greatest(F.length(bits(value)), F.lit(offset + width)), F.lit("0")), offset + 1, width)
    if kind[0] == "u":
        return F.conv(part, 2, 10).cast("long")
    rest = F.coalesce(F.conv(F.substring(part, 2, width - 1), 2, 10).cast("decimal(20,0)"), F.lit(0)) if width > 1 else F.lit(0)
    return (rest - F.substring(part, 1, 1).cast("decimal(20,0)") * F.lit(1 << (width - 1)).cast("decimal(20,0)")).cast("long")


def field_bounds(kind: str) -> tuple[int, int]:
    width = int(kind[1:])
    if kind[0] not in "ui" or not 1 <= width <= (63 if kind[0] == "u" else 64):
        raise ValueError(f"{kind!r} is no bit field type")
    return (0, (1 << width) - 1) if kind[0] == "u" else (-(1 << (width - 1)), (1 << (width - 1)) - 1)


def field_fit(number: Column, kind: str, overflow: str = "WRAP") -> Column:
    """A number (decimal) within a field: wrapped around, saturated, or NULL on FAIL."""
    low, high = field_bounds(kind)
    number = number.cast("decimal(38,0)")
    lo, hi = F.lit(str(low)).cast("decimal(38,0)"), F.lit(str(high)).cast("decimal(38,0)")
    if overflow == "SAT":
        return F.greatest(lo, F.least(hi, number))
    if overflow == "FAIL":
        return F.when((number >= lo) & (number <= hi), number)
    return F.pmod(number - lo, F.lit(str(high - low + 1)).cast("decimal(38,0)")) + lo


def field_set(value: Column, kind: str, offset: int, number: Column) -> Column:
    """The value with a number (already fitted) written at a bit offset."""
    width = int(kind[1:])
    raw = F.pmod(number.cast("decimal(38,0)"), F.lit(str(1 << width)).cast("decimal(38,0)"))
    return set_bits(value, offset, F.lpad(F.conv(raw.cast("string"), 10, 2), width, "0"), width)
