"""Writing documents as text: values, schemas, tables."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from tessera.sources.values import BigNumber, Document, Pairs, Ref, Schema, Tagged, Timestamp, format_timestamp

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.\-]*")
RESERVED = ("true", "false", "null", "~", "NaN", "inf", "Infinity")
ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\t": "\\t", "\r": "\\r", "\b": "\\b", "\f": "\\f"} | {chr(k): f"\\u{k:04x}" for k in (*range(8), 11, *range(14, 32), *range(127, 160))}


@dataclass(frozen=True)
class Style:
    """compact: no spaces, indents or blank lines; compact_floats: no .0, so that integral floats are read back as integers."""

    compact: bool = False
    compact_floats: bool = False

    @property
    def comma(self) -> str:
        return "," if self.compact else ", "

    @property
    def colon(self) -> str:
        return ":" if self.compact else ": "

    @property
    def space(self) -> str:
        return "" if self.compact else " "


PRETTY = Style()


def needs_quoting(s: str) -> bool:
    return s in RESERVED or not NAME.fullmatch(s)


def quoted(s: str) -> str:
    return '"' + "".join(ESCAPES.get(c, c) for c in s) + '"' if needs_quoting(s) else s


def plain_float(x: float) -> str:
    """The shortest digits that read back as x, without an exponent."""
    s = format(Decimal(repr(x)), "f")
    return s[:-2] if s.endswith(".0") else s


def float_text(x: float, compact: bool = False) -> str:
    if not math.isfinite(x):
        return "NaN" if math.isnan(x) else "inf" if x > 0 else "-inf"
    s = plain_float(x)
    if "." in s:
        return s
    if len(s.lstrip("-")) > 15:
        sign, digits, power = Decimal(repr(x)).normalize().as_tuple()
        d = "".join(map(str, digits))
        return f"{'-' if sign else ''}{d[0]}{'.' + d[1:] if len(d) > 1 else ''}e{power + len(d) - 1}"
    return s if compact else s + ".0"


def map_key(k: Any) -> str:
    if isinstance(k, int) and not isinstance(k, bool):
        return str(k)
    if type(k) is str:
        return quoted(k)
    inner = {type(None): lambda: "~", bool: lambda: str(k).lower(), float: lambda: plain_float(k), Timestamp: lambda: format_timestamp(k), bytes: lambda: "0x" + k.hex(), Ref: lambda: f"!{k}", BigNumber: lambda: str(k), Tagged: lambda: f":{k.tag}"}
    return f'"{inner.get(type(k), lambda: "")()}"'


def singular(name: str) -> str:
    name = name.lower()
    if name.endswith("ies"):
        return name[:-3] + "y"
    if name.endswith(("sses", "xes", "ches", "shes")):
        return name[:-2]
    return name[:-1] if len(name) > 1 and name.endswith("s") and not name.endswith("ss") else name


class Renderer:
    def __init__(self, schemas: dict[str, Schema], style: Style = PRETTY):
        self.schemas, self.style = schemas, style

    def resolve(self, declared: str | None, hint: str | None) -> Schema | None:
        """By its declared name, else by the singular of the key, whatever its case."""
        if declared in self.schemas:
            return self.schemas[declared]
        if hint is None:
            return None
        name = singular(hint)
        return self.schemas.get(name) or next((s for n, s in self.schemas.items() if n.lower() == name), None)

    def by_shape(self, row: dict) -> Schema | None:
        return next((s for s in self.schemas.values() if s.accepts(row)), None)

    def value(self, v: Any, hint: str | None = None, indent: int = 0, declared: str | None = None) -> str:
        st = self.style
        if v is None:
            return "~"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, Timestamp):
            return format_timestamp(v)
        if isinstance(v, (int, BigNumber)):
            return str(v)
        if isinstance(v, float):
            return float_text(v, st.compact_floats)
        if isinstance(v, Ref):
            return f"!{v}"
        if isinstance(v, str):
            return quoted(v)
        if isinstance(v, bytes):
            return f'b"{v.hex()}"'
        if isinstance(v, Tagged):
            return f":{v.tag} {self.value(v.value, None, indent)}"
        if isinstance(v, Pairs):
            return f"@map{st.space}{{" + st.comma.join(map_key(k) + st.colon + self.value(x, None, indent) for k, x in v.items) + "}"
        if isinstance(v, dict):
            schema = self.resolve(declared, hint) or self.by_shape(v)
            types = {n: t.base for n, t in schema.fields} if schema else {}
            return "{" + st.comma.join(quoted(k) + st.colon + self.value(x, k, indent, types.get(k)) for k, x in v.items()) + "}"
        schema = self.resolve(declared, hint)
        first = v[0] if v and isinstance(v[0], dict) else None
        if schema is None and (hint is not None or declared is not None) and first is not None:
            schema = self.by_shape(first)
        if schema is not None and first is not None and schema.accepts(first):
            return f"@table {schema.name}{st.space}" + self.rows(v, schema, indent)
        return "[" + st.comma.join(self.value(x, None, indent) for x in v) + "]"

    def rows(self, rows: list, schema: Schema, indent: int) -> str:
        inner = 0 if self.style.compact else indent + 2
        return "[\n" + ",\n".join(" " * inner + self.tuple(r, schema, inner) for r in rows) + "\n" + ("" if self.style.compact else " " * indent) + "]"

    def tuple(self, row: Any, schema: Schema, indent: int) -> str:
        """By position; a field that isn't there is ``~``, one that is null is null."""
        if not isinstance(row, dict):
            return self.value(row, None, indent)
        out = []
        for name, kind in schema.fields:
            v = row.get(name)
            inner = self.schemas.get(kind.base)
            if name not in row:
                out.append("~")
            elif v is None:
                out.append("null")
            elif inner is not None and kind.is_array:
                out.append(self.value(v, None, indent) if not isinstance(v, list) else self.rows(v, inner, indent) if v else "[]")
            elif inner is not None:
                out.append(self.tuple(v, inner, indent))
            else:
                out.append(self.value(v, None, indent))
        return "(" + self.style.comma.join(out) + ")"


def to_text(doc: Document, style: Style = PRETTY, with_schemas: bool = True) -> str:
    """The whole document; without schemas its data alone, no tables in it."""
    st, out = style, []
    if doc.root_array:
        out.append("@root-array\n" + ("" if st.compact else "\n"))
    if with_schemas:
        def fields(of):
            return st.comma.join(quoted(n) + st.colon + str(t) for n, t in of)

        for u in doc.unions.values():
            lines = [("" if st.compact else "  ") + f"{n}{st.space}({fields(fs)})" for n, fs in u.variants]
            out.append(f"@union {u.name}{st.space}{{\n" + "".join(x + ("," if i < len(lines) - 1 else "") + "\n" for i, x in enumerate(lines)) + "}\n")
        out += [f"@struct {s.name}{st.space}({fields(s.fields)})\n" for s in doc.schemas.values()]
        if (doc.unions or doc.schemas) and not st.compact:
            out.append("\n")
    r = Renderer(doc.schemas if with_schemas else {}, style)
    return "".join(out) + "".join(quoted(k) + st.colon + r.value(v, k) + "\n" for k, v in doc.data.items())
