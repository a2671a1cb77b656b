"""Values of nested documents, their schemas, and their JSON.

Null, booleans, integers, floats, strings, bytes, lists and (insertion-ordered) dictionaries are Python's own; the rest are the
classes here. Integers beyond 64 bits and floats beyond doubles keep their digits in a BigNumber.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from typing import Any, NamedTuple

I64, U64 = 2**63, 2**64


class FormatError(ValueError):
    """A document that can't be read or written."""


class BigNumber(str):
    __slots__ = ()


class Ref(str):
    """The name of another value; names aren't checked and may form cycles."""

    __slots__ = ()


class Timestamp(NamedTuple):
    millis: int
    offset: int


@dataclass(frozen=True)
class Tagged:
    tag: str
    value: Any


@dataclass
class Pairs:
    """A map whose keys are strings or integers; repeated keys stay."""

    items: list[tuple[Any, Any]]


@dataclass(frozen=True)
class FieldType:
    base: str
    nullable: bool = False
    is_array: bool = False

    def __str__(self) -> str:
        return ("[]" if self.is_array else "") + self.base + ("?" if self.nullable else "")


@dataclass
class Schema:
    name: str
    fields: list[tuple[str, FieldType]]

    def accepts(self, keys) -> bool:
        """Whether an object of these keys has all fields that aren't nullable, and no others."""
        keys, names = set(keys), {n for n, _ in self.fields}
        return keys <= names and all(t.nullable or n in keys for n, t in self.fields)

    def overlaps(self, rows: list) -> bool:
        """Whether the first row is an object that has more than half of the fields, or all."""
        if not rows or not isinstance(rows[0], dict):
            return False
        names = {n for n, _ in self.fields}
        both = len(names & set(rows[0]))
        return both > len(names) // 2 or both == len(names)


@dataclass
class Union:
    name: str
    variants: list[tuple[str, list[tuple[str, FieldType]]]]


@dataclass
class Document:
    data: dict[str, Any]
    schemas: dict[str, Schema] = field(default_factory=dict)
    unions: dict[str, Union] = field(default_factory=dict)
    root_array: bool = False


def kind_of(v: Any) -> str:
    if v is None:
        return "null"
    for t, name in ((bool, "bool"), (int, "int"), (float, "float"), (BigNumber, "number"), (Ref, "ref"), (str, "string"), (bytes, "bytes"), (Timestamp, "timestamp"), (list, "array"), (dict, "object"), (Pairs, "map"), (Tagged, "tagged")):
        if isinstance(v, t):
            return "uint" if name == "int" and v >= I64 else name
    raise TypeError(f"not a value: {v!r}")


# Timestamps


def days_of(y: int, m: int, d: int) -> int:
    y -= m <= 2
    era, of_era = divmod(y, 400)
    return era * 146097 + of_era * 365 + of_era // 4 - of_era // 100 + (153 * ((m + 9) % 12) + 2) // 5 + d - 1 - 719468


def date_of(days: int) -> tuple[int, int, int]:
    era, doe = divmod(days + 719468, 146097)
    yoe = (doe - doe // 1460 + doe // 36524 - doe // 146096) // 365
    doy = doe - (365 * yoe + yoe // 4 - yoe // 100)
    m = (5 * doy + 2) // 153
    month = m + 3 if m < 10 else m - 9
    return yoe + era * 400 + (month <= 2), month, doy - (153 * m + 2) // 5 + 1


def format_timestamp(t: Timestamp) -> str:
    low, high = -62_167_219_200_000, 253_402_300_799_999
    local = min(max(min(max(t.millis, low), high) + t.offset * 60_000, low), high)
    secs, ms = divmod(local, 1000)
    days, rest = divmod(secs, 86400)
    y, m, d = date_of(days)
    zone = "Z" if t.offset == 0 else f"{'+' if t.offset > 0 else '-'}{abs(t.offset) // 60:02d}:{abs(t.offset) % 60:02d}"
    return f"{y:04d}-{m:02d}-{d:02d}T{rest // 3600:02d}:{rest % 3600 // 60:02d}:{rest % 60:02d}" + (f".{ms:03d}" if ms else "") + zone


# JSON


def number(digits: str) -> Any:
    """An integer that fits 64 bits or a finite float; else a BigNumber."""
    if digits.lstrip("-").isdigit():
        n = int(digits)
        return n if -I64 <= n < U64 else BigNumber(digits)
    x = float(digits)
    return x if math.isfinite(x) else BigNumber(digits)


def _bad_constant(name: str):
    raise FormatError(f"not JSON: {name}")


def from_json(text: str) -> Document:
    """A document of plain JSON. Strings stay strings, whatever they look like; what isn't an object is kept under the key root."""
    try:
        made = json.loads(text, parse_int=number, parse_float=number, parse_constant=_bad_constant)
    except (json.JSONDecodeError, RecursionError) as e:
        raise FormatError(f"not JSON: {e}") from None
    return Document(made) if isinstance(made, dict) else Document({"root": made}, root_array=isinstance(made, list))


def _json(v: Any, out: list[str], pad: str | None) -> None:
    inner = None if pad is None else pad + "  "
    start, end = ("", "") if pad is None else ("\n" + inner, "\n" + pad)

    def sequence(opening: str, closing: str, entries: list) -> None:
        if not entries:
            out.append(opening + closing)
            return
        out.append(opening)
        for i, (key, x) in enumerate(entries):
            out.append(("," if i else "") + start)
            if key is not None:
                out.append(json.dumps(key, ensure_ascii=False) + (":" if pad is None else ": "))
            _json(x, out, inner)
        out.append(end + closing)

    if isinstance(v, Timestamp):
        out.append(f'"{format_timestamp(v)}"')
    elif isinstance(v, BigNumber):
        out.append(str(v))
    elif isinstance(v, Ref):
        sequence("{", "}", [("$ref", str(v))])
    elif isinstance(v, Tagged):
        sequence("{", "}", [("$tag", v.tag), ("$value", v.value)])
    elif isinstance(v, Pairs):
        sequence("[", "]", [(None, [k, x]) for k, x in v.items])
    elif isinstance(v, bytes):
        out.append(f'"0x{v.hex()}"')
    elif isinstance(v, dict):
        sequence("{", "}", list(v.items()))
    elif isinstance(v, list):
        sequence("[", "]", [(None, x) for x in v])
    elif isinstance(v, float):
        out.append(repr(v) if math.isfinite(v) else "null")
    else:
        out.append(json.dumps(v, ensure_ascii=False))


def value_json(v: Any, pretty: bool = False) -> str:
    out: list[str] = []
    _json(v, out, "" if pretty else None)
    return "".join(out)


def to_json(doc: Document, pretty: bool = True) -> str:
    """The document as one JSON value; a root array comes without its key."""
    return value_json(doc.data["root"] if doc.root_array and "root" in doc.data else doc.data, pretty)
