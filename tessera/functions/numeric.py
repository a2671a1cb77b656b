"""Numbers: literals, widths, coercions."""

from __future__ import annotations

import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMITS = {"int8": 7, "int16": 15, "int32": 31, "int64": 63}


def integer_width(n: Column) -> Column:
    """The least signed type that holds an integer."""
    c = F.lit("int64")
    for name in ("int32", "int16", "int8"):
        c = F.when(n.between(-(2 ** LIMITS[name]), 2 ** LIMITS[name] - 1), name).otherwise(c)
    return F.when(n.isNotNull(), c)


def unsigned_width(n: Column) -> Column:
    return F.when(n < 2**8, "uint8").when(n < 2**16, "uint16").when(n < 2**32, "uint32").when(n.isNotNull(), "uint64")


def number_kind(s: Column) -> Column:
    """What a number literal is read as: int, uint, big (an integer beyond 64 bits), float, or null for no number."""
    d = s.try_cast("decimal(38,0)")
    decimal = s.rlike(r"^[+-]?[0-9]+$")
    return (
        F.when(s.rlike("^[+-]?0[xX][0-9a-fA-F]+$") | s.rlike("^[+-]?0[bB][01]+$"), "int")
        .when(decimal & d.between(-(2**63), 2**63 - 1), "int")
        .when(decimal & d.between(F.lit(0), F.lit(str(2**64 - 1)).cast("decimal(38,0)")), "uint")
        .when(decimal, "big")
        .when(s.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), F.when(F.abs(s.try_cast("double")) < float("inf"), "float").otherwise("big"))
    )


def literal_value(s: Column) -> Column:
    """The value of an int literal, hexadecimal and binary ones included."""
    negative = s.startswith("-")
    digits = F.regexp_replace(s, "^[+-]", "")
    from_hex, from_bin = F.conv(F.substring(digits, 3, 64), 16, 10), F.conv(F.substring(digits, 3, 64), 2, 10)
    v = F.when(digits.rlike("^0[xX]"), from_hex).when(digits.rlike("^0[bB]"), from_bin).otherwise(digits).try_cast("decimal(38,0)")
    return F.when(negative, -v).otherwise(v).try_cast("long")


def coerce_int(x: Column, bits: int = 32) -> Column:
    """Truncated towards zero; 0 for what is no number or out of range."""
    v = x.try_cast("double")
    v = F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)).try_cast("decimal(38,0)")
    return F.coalesce(F.when(v.between(-(2 ** (bits - 1)), 2 ** (bits - 1) - 1), v.try_cast("long")), F.lit(0).cast("long"))


def wrap_int(x: Column, bits: int) -> Column:
    """The low bits of an integer, as a signed number."""
    m = F.pmod(x.cast("decimal(38,0)"), F.lit(str(2**bits)).cast("decimal(38,0)"))
    return F.when(m >= F.lit(str(2 ** (bits - 1))).cast("decimal(38,0)"), m - F.lit(str(2**bits)).cast("decimal(38,0)")).otherwise(m).cast("long")


def coerce_numeric(s: Column) -> tuple[Column, Column]:
    """(integer, number) of a numeric string: the first where the value is integral and below 1e15, else the second, else both null."""
    v = s.try_cast("double")
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    return F.when(whole, v.try_cast("long")), F.when(~whole, v)


def hexed(b: Column) -> Column:
    return F.lower(F.hex(b))


def unhexed(s: Column) -> Column:
    """Bytes of an even number of hexadecimal digits; else null."""
    return F.when(s.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(s))


def format_float(x: float) -> str:
    """Shortest digits that read back the same; integral values keep a .0, and more than 15 digits are written with an exponent."""
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "inf" if x > 0 else "-inf"
    plain = format(x, "f") if x == int(x) and abs(x) < 1e22 else repr(x)
    if "e" in plain or "E" in plain or sum(c.isdigit() for c in plain.split(".")[0].lstrip("-")) > 15:
        mantissa, _, exponent = (repr(x) if "e" in repr(x) else f"{x:.17e}").partition("e")
        from decimal import Decimal

        sign, digits, power = Decimal(repr(x)).normalize().as_tuple()
        text = "".join(map(str, digits))
        mantissa = text[0] + ("." + text[1:] if len(text) > 1 else "")
        return ("-" if sign else "") + f"{mantissa}e{power + len(digits) - 1}"
    if plain.endswith(".000000"):
        plain = plain[:-5]
    return plain if "." in plain else plain + ".0"


def varint(n: int) -> bytes:
    out = bytearray()
    while True:
        n, low = n >> 7, n & 127
        out.append(low | (128 if n else 0))
        if not n:
            return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    """(value, next place); at most ten bytes."""
    value = 0
    for k in range(10):
        if at + k >= len(data):
            raise ValueError("varint ends early")
        value |= (data[at + k] & 127) << 7 * k
        if data[at + k] < 128:
            return value, at + k + 1
    raise ValueError("varint too long")


def squeezed(data: bytes) -> tuple[bytes, bool]:
    """Compressed if that is worth it: more than 64 bytes, and less than nine tenths of them after."""
    if len(data) > 64:
        small = zlib.compress(data)
        if len(small) < len(data) * 9 // 10:
            return small, True
    return data, False
