"""Compact binary documents: a header, a string table, schemas, an index of sections, and each top-level value as a section of its own.

Sections are found by the index and decoded one by one; what isn't asked for isn't decompressed.
"""

from __future__ import annotations

import struct
import zlib
from typing import Any

from tessera.functions.numeric import read_varint, squeezed, varint
from tessera.sources.values import I64, BigNumber, Document, FieldType, FormatError, Pairs, Ref, Schema, Tagged, Timestamp, Union

MAGIC, VERSION = bytes.fromhex("544c4258"), (2, 0)
HEADER, DEPTH, MOST_BYTES, MOST_ITEMS = 64, 256, 256 << 20, 1 << 20
CODE = {
    "null": 0, "bool": 1, "int8": 2, "int16": 3, "int": 4, "int32": 4, "int64": 5, "uint8": 6, "uint16": 7, "uint": 8, "uint32": 8, "uint64": 9, "float32": 10,
    "float": 11, "float64": 11, "string": 16, "bytes": 17, "number": 18, "array": 32, "object": 33, "struct": 34, "map": 35, "tuple": 36, "ref": 48, "tagged": 49, "timestamp": 50,
}
FIXED = {2: "<b", 3: "<h", 4: "<i", 5: "<q", 6: "<B", 7: "<H", 8: "<I", 9: "<Q", 10: "<f", 11: "<d"}
NAMED = {1: "bool", 2: "int8", 3: "int16", 4: "int", 5: "int64", 6: "uint8", 7: "uint16", 8: "uint", 9: "uint64", 10: "float32", 11: "float", 16: "string", 17: "bytes", 33: "object", 34: "any", 35: "map", 36: "tuple", 49: "tagged", 50: "timestamp"}
RANGE = {2: (-(2**7), 2**7), 3: (-(2**15), 2**15), 4: (-(2**31), 2**31), 5: (-I64, I64), 6: (0, 2**8), 7: (0, 2**16), 8: (0, 2**32), 9: (0, 2**64)}


def to_int(v: Any, code: int) -> int:
    """Truncated; 0 for what isn't a number or is out of the type's range."""
    low, high = RANGE[code]
    if isinstance(v, BigNumber):
        v = int(v) if v.lstrip("-").isdigit() else 0
    elif isinstance(v, bool) or not isinstance(v, (int, float)):
        v = 0
    elif isinstance(v, float):
        v = int(v) if abs(v) < 2**65 else 0
    return v if low <= v < high else 0


class Writer:
    def __init__(self, doc: Document):
        self.doc = doc
        self.strings: dict[str, int] = {}
        self.schemas = [s for s in doc.schemas.values()]
        self.numbers = {s.name: i for i, s in enumerate(self.schemas)}
        for s in self.schemas:
            self.names(s.name, s.fields)
        for u in doc.unions.values():
            self.intern(u.name)
            for name, fields in u.variants:
                self.names(name, fields)

    def names(self, name: str, fields: list[tuple[str, FieldType]]) -> None:
        self.intern(name)
        for n, t in fields:
            self.intern(n)
            if self.code(t, False) in (34, 49):
                self.intern(t.base)

    def intern(self, s: str) -> int:
        return self.strings.setdefault(s, len(self.strings))

    def word(self, s: str) -> bytes:
        return struct.pack("<I", self.intern(s))

    def code(self, t: FieldType, as_array: bool = True) -> int:
        if t.is_array and as_array:
            return 32
        return 49 if t.base in self.doc.unions else CODE.get(t.base, 34) if t.base not in ("array", "struct", "number", "ref", "tagged", "null") else 34

    def usable(self, s: Schema, seen: tuple[str, ...] = ()) -> bool:
        """Whether values of a schema can be told apart when read: a field without a known type is only safe within a list."""
        return s.name in seen or all(t.is_array or self.code(t) != 34 or (t.base in self.numbers and self.usable(self.schemas[self.numbers[t.base]], (*seen, s.name))) for _, t in s.fields)

    def schema_for(self, key: str, v: Any) -> Schema | None:
        """The first schema that takes the first, the middle and the last row; for no rows, the one the key names."""
        if not isinstance(v, list):
            return None
        if not v:
            from tessera.sources.render import singular

            return next((s for n, s in self.doc.schemas.items() if n.lower() == singular(key)), None)
        rows = [v[0], *([v[len(v) // 2]] if len(v) > 2 else []), v[-1]]
        if not all(isinstance(r, dict) for r in rows):
            return None
        return next((s for s in self.schemas if self.usable(s) and all(s.accepts(r) for r in rows)), None)

    def fits(self, v: Any, t: FieldType) -> bool:
        """Whether a value is of its declared type, so that nothing is lost."""
        if t.is_array:
            return isinstance(v, list) and all(x is not None and self.fits(x, FieldType(t.base)) or (x is None and self.code(FieldType(t.base)) == 34 and t.base not in self.numbers) for x in v)
        code = self.code(t)
        if code in RANGE:
            return isinstance(v, int) and not isinstance(v, bool) and RANGE[code][0] <= v < RANGE[code][1]
        if code == 34 and t.base in self.numbers:
            return isinstance(v, dict) and self.row_fits(v, self.schemas[self.numbers[t.base]])
        if code == 10:
            return isinstance(v, float) and (v != v or struct.unpack("<f", struct.pack("<f", v))[0] == v if abs(v) < 3e38 or v != v else True)
        want = {1: bool, 11: float, 16: str, 17: bytes, 50: Timestamp, 49: Tagged}.get(code)
        return True if want is None else type(v) is want

    def row_fits(self, row: Any, s: Schema) -> bool:
        return row is None or isinstance(row, dict) and s.accepts(row) and len(row) > 0 and all(n not in row or row[n] is None or self.fits(row[n], t) for n, t in s.fields) and all(t.nullable or n in row for n, t in s.fields)

    def value(self, v: Any) -> tuple[int, bytes]:
        if v is None:
            return 0, b""
        if isinstance(v, bool):
            return 1, bytes([v])
        if isinstance(v, Timestamp):
            return 50, struct.pack("<qh", *v)
        if isinstance(v, int):
            code = next((c for c in (2, 3, 4, 5) if RANGE[c][0] <= v < RANGE[c][1]), 9)
            return code, struct.pack(FIXED[code], v)
        if isinstance(v, float):
            return 11, struct.pack("<d", v)
        if isinstance(v, str):
            return (18 if isinstance(v, BigNumber) else 48 if isinstance(v, Ref) else 16), self.word(v)
        if isinstance(v, bytes):
            return 17, varint(len(v)) + v
        if isinstance(v, Tagged):
            tag = self.word(v.tag)
            code, data = self.value(v.value)
            return 49, tag + bytes([code]) + data
        if isinstance(v, dict):
            if len(v) > 0xFFFF:
                raise FormatError(f"Value out of range: Object has {len(v)} fields, exceeds maximum 65535")
            out = [struct.pack("<H", len(v))]
            for k, x in v.items():
                name = self.word(k)
                code, data = self.value(x)
                out += [name, bytes([code]), data]
            return 33, b"".join(out)
        if isinstance(v, Pairs):
            out = [struct.pack("<I", len(v.items))]
            for k, x in v.items:
                if type(k) not in (str, int):
                    raise FormatError("Parse error: map keys must be string, int, or uint")
                for y in (k, x):
                    code, data = self.value(y)
                    out += [bytes([code]), data]
            return 35, b"".join(out)
        return 32, self.array(v)

    def array(self, v: list) -> bytes:
        head = struct.pack("<I", len(v))
        if not v:
            return head
        if all(type(x) is int and RANGE[4][0] <= x < RANGE[4][1] for x in v):
            return head + b"\x04" + struct.pack(f"<{len(v)}i", *v)
        if all(type(x) is str for x in v):
            return head + b"\x10" + b"".join(self.word(x) for x in v)
        return head + b"\xff" + b"".join(bytes([c]) + d for c, d in map(self.value, v))

    def row(self, row: dict | None, s: Schema) -> bytes:
        """Two bits a field (there, null, absent), then what is there."""
        null = absent = 0
        out = []
        for i, (name, t) in enumerate(s.fields):
            if row is None or name not in row:
                absent |= 1 << i
            elif row[name] is None:
                null |= 1 << i
            else:
                out.append(self.typed(row[name], t))
        size = (len(s.fields) + 7) // 8
        return null.to_bytes(size, "little") + absent.to_bytes(size, "little") + b"".join(out)

    def typed(self, v: Any, t: FieldType) -> bytes:
        if t.is_array:
            if not isinstance(v, list) or not v:
                return struct.pack("<I", 0)
            code, head = self.code(FieldType(t.base)), struct.pack("<I", len(v))
            if code == 34 and t.base not in self.numbers:
                return head + b"\xff" + b"".join(bytes([c]) + d for c, d in map(self.value, v))
            return head + bytes([code]) + b"".join(self.typed(x, FieldType(t.base)) for x in v)
        code = self.code(t)
        if code in RANGE:
            return struct.pack(FIXED[code], to_int(v, code))
        if code in (10, 11):
            return struct.pack(FIXED[code], float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else 0.0)
        if code == 1:
            return bytes([v is True])
        if code == 16:
            return self.word(v if type(v) is str else "")
        if code == 17:
            return varint(len(v)) + v if isinstance(v, bytes) else b"\0"
        if code == 50:
            return struct.pack("<qh", *(v if isinstance(v, Timestamp) else (0, 0)))
        if code == 34 and t.base in self.numbers and isinstance(v, dict):
            i = self.numbers[t.base]
            return struct.pack("<H", i) + self.row(v, self.schemas[i])
        return self.value(v)[1]

    def section(self, key: str, v: Any, lossless: bool) -> tuple[int, int, int, int, bytes]:
        """Schema, type, whether a list, number of items, data."""
        s = self.schema_for(key, v)
        if s is not None and v and all(r is None or isinstance(r, dict) for r in v) and (not lossless or all(self.row_fits(r, s) for r in v)):
            i = self.numbers[s.name]
            return i, 34, 1, len(v), struct.pack("<IHH", len(v), i, 2 * ((len(s.fields) + 7) // 8)) + b"".join(self.row(r, s) for r in v)
        code, data = self.value(v)
        return 0xFFFF, code, int(isinstance(v, list)), len(v) if isinstance(v, list) else len(v.items) if isinstance(v, Pairs) else 0, data

    def field(self, name: str, t: FieldType) -> bytes:
        code = self.code(t, False)
        ref = self.strings[t.base] if code in (34, 49) else 0xFFFF
        return struct.pack("<IBBH", self.strings[name], code, t.nullable | t.is_array << 1, ref & 0xFFFF)

    def bytes(self, compress: bool = True, lossless: bool = True) -> bytes:
        """The file. Lossless: rows whose values aren't of their fields' types are written without the schema rather than coerced."""
        sections = []
        for key, v in self.doc.data.items():
            at = self.intern(key)
            sections.append((at, *self.section(key, v, lossless)))
        text = [s.encode("utf-8", "surrogatepass") for s in self.strings]
        offsets = [0]
        for s in text:
            offsets.append(offsets[-1] + len(s))
        size = 8 + 8 * len(text) + offsets[-1]
        table = struct.pack(f"<II{2 * len(text)}I", size, len(text), *offsets[:-1], *map(len, text)) + b"".join(text)
        structs = [struct.pack("<IHH", self.strings[s.name], len(s.fields), 0) + b"".join(self.field(*f) for f in s.fields) for s in self.schemas]
        unions = [struct.pack("<IHH", self.strings[u.name], len(u.variants), 0) + b"".join(struct.pack("<IHH", self.strings[n], len(fs), 0) + b"".join(self.field(*f) for f in fs) for n, fs in u.variants) for u in self.doc.unions.values()]

        def listed(parts: list[bytes]) -> bytes:
            at, offs = 0, []
            for p in parts:
                offs.append(at)
                at += len(p)
            return struct.pack(f"<{len(offs)}I", *offs) + b"".join(parts)

        body = listed(structs) + listed(unions)
        schemas = struct.pack("<IHH", 8 + len(body), len(structs), len(unions)) + body
        index_size = 8 + 32 * len(sections)
        at = HEADER + len(table) + len(schemas) + index_size
        index, data = [struct.pack("<II", index_size, len(sections))], []
        first = at
        for key, schema, code, is_list, items, raw in sections:
            put, small = squeezed(raw) if compress else (raw, False)
            index.append(struct.pack("<IQIIHBBI4x", key, at, len(put), len(raw), schema, code, small | is_list << 1, items))
            data.append(put)
            at += len(put)
        header = MAGIC + struct.pack("<HHIIQQQQIIII", *VERSION, compress | self.doc.root_array << 1, 0, HEADER, HEADER + len(table), HEADER + len(table) + len(schemas), first, len(text), len(structs), len(sections), 0)
        return header + table + schemas + b"".join(index) + b"".join(data)


def to_binary(doc: Document, compress: bool = True, lossless: bool = True) -> bytes:
    return Writer(doc).bytes(compress, lossless)


class Reader:
    """A binary document whose sections are decoded when asked for, and kept until ``clear``."""

    def __init__(self, data: bytes):
        if len(data) < HEADER or data[:4] != MAGIC:
            raise FormatError("Invalid magic bytes")
        major, minor, flags = struct.unpack_from("<HHI", data, 4)
        if major != VERSION[0]:
            raise FormatError(f"Unsupported version: {major}.{minor}")
        self.data, self.root_array = data, bool(flags & 2)
        strings, schemas, index, first = struct.unpack_from("<4Q", data, 16)
        n_strings, n_schemas, n_sections = struct.unpack_from("<3I", data, 48)
        if max(strings, schemas, index, first) > len(data):
            raise FormatError("Parse error: header region offsets exceed file size")
        try:
            at = strings + 8
            self.offsets = struct.unpack_from(f"<{n_strings}I", data, at)
            self.lengths = struct.unpack_from(f"<{n_strings}I", data, at + 4 * n_strings)
            self.text_at = at + 8 * n_strings
            n_unions = struct.unpack_from("<H", data, schemas + 6)[0]
            self._definitions(schemas + 8, n_schemas, n_unions)
            self.sections: dict[str, tuple] = {}
            for i in range(n_sections):
                key, off, size, raw, schema, code, bits, items = struct.unpack_from("<IQIIHBBI", data, index + 8 + 32 * i)
                if off + size > len(data):
                    raise FormatError("Parse error: section out of bounds")
                self.sections[self.string(key)] = (off, size, raw, schema, code, bits, items)
        except struct.error as e:
            raise FormatError(f"Parse error: {e}") from None
        self._kept: dict[str, Any] = {}

    def string(self, i: int) -> str:
        if i >= len(self.offsets):
            raise FormatError(f"Parse error: string {i} out of bounds")
        at = self.text_at + self.offsets[i]
        try:
            return self.data[at : at + self.lengths[i]].decode("utf-8", "surrogatepass")
        except UnicodeDecodeError:
            raise FormatError("Invalid UTF-8") from None

    def _fields(self, at: int, n: int) -> tuple[list[tuple[str, FieldType]], int]:
        out = []
        for _ in range(n):
            name, code, bits, ref = struct.unpack_from("<IBBH", self.data, at)
            base = self.string(ref) if code in (34, 49) and ref != 0xFFFF else NAMED.get(code, "any")
            out.append((self.string(name), FieldType(base, bool(bits & 1), bool(bits & 2))))
            at += 8
        return out, at

    def _definitions(self, at: int, n_schemas: int, n_unions: int) -> None:
        self.schemas: list[Schema] = []
        self.unions: dict[str, Union] = {}
        at += 4 * n_schemas
        for _ in range(n_schemas):
            name, n, _ = struct.unpack_from("<IHH", self.data, at)
            fields, at = self._fields(at + 8, n)
            self.schemas.append(Schema(self.string(name), fields))
        at += 4 * n_unions
        for _ in range(n_unions):
            name, n, _ = struct.unpack_from("<IHH", self.data, at)
            at += 8
            variants = []
            for _ in range(n):
                v, k, _ = struct.unpack_from("<IHH", self.data, at)
                fields, at = self._fields(at + 8, k)
                variants.append((self.string(v), fields))
            self.unions[self.string(name)] = Union(self.string(name), variants)

    def keys(self) -> list[str]:
        return list(self.sections)

    def clear(self) -> None:
        self._kept.clear()

    def get(self, key: str) -> Any:
        if key not in self.sections:
            raise FormatError(f"Missing field: {key}")
        if key not in self._kept:
            off, size, raw, schema, code, bits, _ = self.sections[key]
            data = self.data[off : off + size]
            if bits & 1:
                if raw > MOST_BYTES:
                    raise FormatError("Parse error: decompressed section too large")
                try:
                    d = zlib.decompressobj()
                    data = d.decompress(data, MOST_BYTES)
                except zlib.error as e:
                    raise FormatError(f"Parse error: {e}") from None
            try:
                self._kept[key] = self._rows(data, schema) if bits & 2 and schema != 0xFFFF else self._value(data, 0, code, 0)[0]
            except (struct.error, IndexError, ValueError) as e:
                raise e if isinstance(e, FormatError) else FormatError(f"Parse error: {e}") from None
        return self._kept[key]

    def document(self) -> Document:
        return Document({k: self.get(k) for k in self.sections}, {s.name: s for s in self.schemas}, self.unions, self.root_array)

    def _count(self, data: bytes, at: int) -> tuple[int, int]:
        n = struct.unpack_from("<I", data, at)[0]
        if n > MOST_ITEMS:
            raise FormatError(f"Parse error: array element count {n} exceeds limit of {MOST_ITEMS}")
        return n, at + 4

    def _rows(self, data: bytes, schema: int) -> list:
        n, at = self._count(data, 0)
        bits = struct.unpack_from("<H", data, 6)[0]
        if schema >= len(self.schemas):
            raise FormatError("Parse error: struct array schema index out of bounds")
        at, out = 8, []
        for _ in range(n):
            row, at, none = self._row(data, at, self.schemas[schema], bits // 2, 0)
            out.append(None if none else row)
        return out

    def _row(self, data: bytes, at: int, s: Schema, size: int, depth: int) -> tuple[dict, int, bool]:
        if at + 2 * size > len(data):
            raise FormatError("Parse error: read out of bounds")
        null, absent = int.from_bytes(data[at : at + size], "little"), int.from_bytes(data[at + size : at + 2 * size], "little")
        at, row = at + 2 * size, {}
        for i, (name, t) in enumerate(s.fields):
            state = null >> i & 1 | (absent >> i & 1) << 1
            if state == 0:
                row[name], at = self._value(data, at, self._code(t), depth + 1)
            elif state == 1 or state == 2 and not t.nullable:
                row[name] = None
        return row, at, absent == (1 << len(s.fields)) - 1 and not null

    def _code(self, t: FieldType) -> int:
        return 32 if t.is_array else 49 if t.base in self.unions else CODE.get(t.base, 34)

    def _value(self, data: bytes, at: int, code: int, depth: int) -> tuple[Any, int]:
        if depth > DEPTH:
            raise FormatError("Parse error: maximum decode nesting depth exceeded")
        if code == 0:
            return None, at
        if code == 1:
            return data[at] != 0, at + 1
        if code in FIXED:
            return struct.unpack_from(FIXED[code], data, at)[0], at + struct.calcsize(FIXED[code])
        if code in (16, 18, 48):
            s = self.string(struct.unpack_from("<I", data, at)[0])
            return {16: str, 18: BigNumber, 48: Ref}[code](s), at + 4
        if code == 17:
            n, at = read_varint(data, at)
            if at + n > len(data):
                raise FormatError("Parse error: read out of bounds")
            return data[at : at + n], at + n
        if code == 50:
            return Timestamp(*struct.unpack_from("<qh", data, at)), at + 10
        if code in (32, 36):
            n, at = self._count(data, at)
            if not n:
                return [], at
            kind, at, out = data[at], at + 1, []
            for _ in range(n):
                k, at = (data[at], at + 1) if kind == 0xFF else (kind, at)
                v, at = self._value(data, at, k, depth + 1)
                out.append(v)
            return out, at
        if code == 33:
            n, at, out = struct.unpack_from("<H", data, at)[0], at + 2, {}
            for _ in range(n):
                key, kind = struct.unpack_from("<IB", data, at)
                out[self.string(key)], at = self._value(data, at + 5, kind, depth + 1)
            return out, at
        if code == 34:
            i = struct.unpack_from("<H", data, at)[0]
            if i >= len(self.schemas):
                raise FormatError("Parse error: struct schema index out of bounds")
            s = self.schemas[i]
            row, at, _ = self._row(data, at + 2, s, (len(s.fields) + 7) // 8, depth)
            return row, at
        if code == 35:
            n, at = self._count(data, at)
            items = []
            for _ in range(n):
                k, at = self._value(data, at + 1, data[at], depth + 1)
                v, at = self._value(data, at + 1, data[at], depth + 1)
                items.append((k, v))
            return Pairs(items), at
        if code == 49:
            tag, kind = struct.unpack_from("<IB", data, at)
            v, at = self._value(data, at + 5, kind, depth + 1)
            return Tagged(self.string(tag), v), at
        raise FormatError(f"Invalid type code: 0x{code:02X}")


def from_binary(data: bytes) -> Document:
    return Reader(data).document()
