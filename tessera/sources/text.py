"""Reading human-written nested text: keys and values, schemas, tables, maps, tags, references and includes."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from pathlib import Path
from typing import Any

from tessera.sources.values import I64, U64, BigNumber, Document, FieldType, FormatError, Pairs, Ref, Schema, Tagged, Timestamp, Union, days_of

DEPTH, INCLUDES = 256, 32
TOKEN = re.compile(
    r"""(?:\s+|\#[^\n]*)*(?:
    (?P<punct>[{}\[\](),=~?:])
    |(?P<plain>[A-Za-z_][A-Za-z0-9_.\-]*(?![\w"]))
    |(?P<simple>"[^"\\]+"(?!"))
    |@(?P<directive>[\w.\-]*)
    |!(?P<ref>[\w.\-]*)
    |b"(?P<bytes>[^"]*)(?P<bytes_end>"?)
    |\"\"\"(?P<block>.*?)(?P<block_end>\"\"\"|\Z)
    |"(?P<string>(?:[^"\\]|\\.)*)(?P<string_end>"?)
    |(?P<date>[0-9]{4}-[0-9]{2}-[0-9]{2}(?:T[0-9:]*(?:\.[0-9]*)?(?:Z|[+\-][0-9:]*)?)?)
    |(?P<minus>-inf(?!\w))
    |(?P<radix>-?0[xX][0-9a-fA-F]*|-?0[bB][01]*)
    |(?P<number>-?[0-9]+(?:\.[0-9]*)?(?:[eE][+\-]?[0-9]*)?)
    |(?P<word>[^\W\d][\w.\-]*)
    |(?P<other>.)|\Z)""",
    re.X | re.S,
)
ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{0,4})|(.)|\Z)", re.S)
PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", '"': '"', "\\": "\\"}
CLOCK = re.compile(r"T([0-9]{2}).([0-9]{2})(?::([0-9]{2}))?(?:\.([0-9]*))?(Z|[+\-].*)?")
NAMES = {"{": "LBrace", "}": "RBrace", "[": "LBracket", "]": "RBracket", "(": "LParen", ")": "RParen", ",": "Comma", "=": "Eq", "~": "Null", "?": "Question", ":": "Colon"}
WORDS = {"true": ("Bool", True), "false": ("Bool", False), "null": ("ExplicitNull", None), "NaN": ("Float", math.nan), "inf": ("Float", math.inf)}
VALUE_ONLY = ("object", "map", "tuple", "ref", "tagged")


def unescape(s: str) -> str:
    def one(m: re.Match) -> str:
        if m[1] is not None:
            if len(m[1]) != 4:
                raise FormatError("Parse error: Invalid unicode escape: expected 4 hex digits after \\u")
            if 0xD800 <= int(m[1], 16) <= 0xDFFF:
                raise FormatError(f"Parse error: Invalid unicode codepoint: U+{int(m[1], 16):04X}")
            return chr(int(m[1], 16))
        if m[2] not in PLAIN:
            raise FormatError(f"Parse error: Invalid escape sequence: \\{m[2]}")
        return PLAIN[m[2]]

    return ESCAPE.sub(one, s) if "\\" in s else s


def dedent(s: str) -> str:
    lines = s.split("\n")
    lines = [x[:-1] if x.endswith("\r") else x for x in lines]
    if lines and lines[-1] == "" and len(lines) > 1:
        lines.pop()
    if len(lines) > 1 and not lines[0].strip():
        lines = lines[1:]
    if len(lines) > 1 and not lines[-1].strip():
        lines = lines[:-1]
    indent = min((len(x) - len(x.lstrip()) for x in lines if x.strip()), default=0)
    return "\n".join(x[indent:] for x in lines)


def timestamp(s: str) -> Timestamp:
    bad = FormatError(f"Parse error: Invalid timestamp: {s}")
    year, month, day = int(s[:4]), int(s[5:7]), int(s[8:10])
    if not (1 <= month <= 12 and 1 <= day <= 31):
        raise bad
    hour = minute = second = millis = offset = 0
    if len(s) > 10:
        m = CLOCK.fullmatch(s[10:])
        if not m:
            raise bad
        hour, minute, second = int(m[1]), int(m[2]), int(m[3] or 0)
        millis = int((m[4] or "0")[:3].ljust(3, "0"))
        if m[5] and m[5] != "Z":
            zone = re.fullmatch(r"([0-9]{2})(?::?([0-9]{2}))?:?[0-9:]*", m[5][1:])
            if not zone or int(zone[1]) > 23 or int(zone[2] or 0) > 59:
                raise bad
            offset = (int(zone[1]) * 60 + int(zone[2] or 0)) * (-1 if m[5][0] == "-" else 1)
        if hour > 23 or minute > 59 or second > 59:
            raise bad
    return Timestamp((((days_of(year, month, day) * 24 + hour) * 60 + minute - offset) * 60 + second) * 1000 + millis, offset)


def _bytes(s: str, ended: str) -> tuple[str, bytes]:
    if not ended:
        raise FormatError("Parse error: Unterminated bytes literal")
    wrong = re.search(r"[^0-9a-fA-F]", s)
    if wrong:
        raise FormatError(f"Parse error: Invalid character '{wrong[0]}' in bytes literal (expected hex digit or '\"')")
    if len(s) % 2:
        raise FormatError(f"Parse error: Bytes literal has odd number of hex digits ({len(s)})")
    return "Bytes", bytes.fromhex(s)


def _radix(s: str) -> tuple[str, int]:
    digits, base = s.lstrip("-")[2:], 16 if "x" in s.lower() else 2
    if not digits or int(digits, base) >= I64:
        raise FormatError(f"Parse error: Invalid {'hex' if base == 16 else 'binary'}: {s}")
    return "Int", int(digits, base) * (-1 if s[0] == "-" else 1)


def _number(s: str) -> tuple[str, Any]:
    if "." not in s and "e" not in s and "E" not in s:
        n = int(s)
        return ("Int", n) if -I64 <= n < I64 else ("UInt", n) if 0 <= n < U64 else ("JsonNumber", BigNumber(s))
    try:
        x = float(s)
    except ValueError:
        raise FormatError(f"Parse error: Invalid float: {s}") from None
    return ("Float", x) if math.isfinite(x) else ("JsonNumber", BigNumber(s))


def tokens(text: str) -> tuple[list[str], list[Any], list[int]]:
    """Kinds, values and ends of all tokens. Characters that begin none are passed over."""
    kinds, values, ends = [], [], []
    for m in TOKEN.finditer(text):
        group = m.lastgroup
        if group is None or group == "other":
            continue
        s = m[group]
        if group == "punct":
            kind, value = NAMES[s], None
        elif group == "plain":
            kind, value = WORDS.get(s) or ("Word", s)
        elif group == "simple":
            kind, value = "String", s[1:-1]
        elif group == "number":
            kind, value = _number(s)
        elif group == "string_end":
            kind, value = "String", unescape(m["string"])
            if not s:
                raise FormatError("Parse error: Unterminated string")
        elif group == "directive" or group == "ref":
            kind, value = ("Directive" if group == "directive" else "Ref"), s
        elif group == "date":
            kind, value = "Timestamp", timestamp(s)
        elif group == "word":
            kind, value = WORDS.get(s) or ("Word", s)
        elif group == "block_end":
            if not s:
                raise FormatError("Parse error: Unterminated multiline string")
            kind, value = "String", dedent(m["block"])
        elif group == "bytes_end":
            kind, value = _bytes(m["bytes"], s)
        elif group == "radix":
            kind, value = _radix(s)
        else:
            kind, value = "Float", -math.inf
        kinds.append(kind)
        values.append(value)
        ends.append(m.end())
    kinds.append("Eof")
    values.append(None)
    ends.append(len(text))
    return kinds, values, ends


SCALARS = frozenset(("Bool", "Int", "UInt", "JsonNumber", "Float", "String", "Bytes", "Word", "Timestamp"))
STARTS = frozenset((*SCALARS, "Null", "Ref", "Colon", "Directive", "LBrace", "LBracket", "LParen"))


class Parser:
    def __init__(self, text: str, folder: Path | None = None, read: Callable[[Path], str] | None = None, above: tuple[Path, ...] = ()):
        self.text, (self.kinds, self.values, self.ends), self.at = text, tokens(text), 0
        self.kind = self.kinds[0]
        self.folder, self.read, self.above = folder, read or (lambda p: p.read_text(encoding="utf-8")), above
        self.schemas: dict[str, Schema] = {}
        self.unions: dict[str, Union] = {}
        self.root_array = False

    def next(self) -> Any:
        at = self.at
        value = self.values[at]
        if self.kind != "Eof":
            self.at = at = at + 1
            self.kind = self.kinds[at]
        return value

    def got(self) -> str:
        kind, value = self.kind, self.values[self.at]
        return kind if value is None else f'{kind}("{value}")' if isinstance(value, str) else f"{kind}({value})"

    def expect(self, kind: str, what: str | None = None) -> Any:
        if self.kind != kind:
            raise FormatError(f"Expected {what or kind}, got {self.got()}")
        return self.next()

    def skip(self, kind: str) -> bool:
        if self.kind == kind:
            self.next()
            return True
        return False

    def until(self, kind: str, one: Callable[[], Any]) -> list:
        """What ``one`` gives, again and again, up to a closing token; commas between are as good as none."""
        out = []
        while self.kind != kind:
            out.append(one())
            if self.kind == "Comma":
                self.next()
        self.next()
        return out

    def document(self) -> dict[str, Any]:
        data: dict[str, Any] = {}
        while self.kind != "Eof":
            if self.kind == "Directive":
                end = self.ends[self.at]
                name = self.next()
                if name == "struct":
                    name = self.expect("Word", "word")
                    self.expect("LParen")
                    self.schemas[name] = Schema(name, self.fields(("Word", "String"), "field name"))
                elif name == "union":
                    name = self.expect("Word", "word")
                    self.expect("LBrace")
                    self.unions[name] = Union(name, self.until("RBrace", self.variant))
                elif name == "include":
                    data.update(self.include())
                elif name == "root-array":
                    self.root_array = True
                elif self.kind in STARTS and "\n" not in self.text[end : self.ends[self.at]]:
                    self.value(0)
            elif self.kind in ("Word", "String"):
                key, value = self.pair(0)
                data[key] = value
            elif self.kind == "Ref":
                name = f"!{self.next()}"
                self.expect("Colon")
                data[name] = self.value(0)
            else:
                self.next()
        return data

    def fields(self, kinds: tuple[str, ...], what: str) -> list[tuple[str, FieldType]]:
        found: dict[str, FieldType] = {}

        def one() -> None:
            if self.kind not in kinds:
                raise FormatError(f"Expected {what}, got {self.got()}")
            name = self.next()
            found[name] = self.field_type() if self.skip("Colon") else FieldType("string")

        self.until("RParen", one)
        return list(found.items())

    def variant(self) -> tuple[str, list[tuple[str, FieldType]]]:
        name = self.expect("Word", "word")
        self.expect("LParen")
        return name, self.fields(("Word",), "word")

    def field_type(self) -> FieldType:
        is_array = self.skip("LBracket")
        if is_array:
            self.expect("RBracket")
        base = self.expect("Word", "word")
        if base in VALUE_ONLY:
            raise FormatError(f"Parse error: '{base}' is a value type and cannot be used as a schema field type")
        return FieldType(base, self.skip("Question"), is_array)

    def include(self) -> dict[str, Any]:
        if self.kind not in ("Word", "String"):
            raise FormatError(f"Expected file path, got {self.got()}")
        name = self.next()
        path = (self.folder / name) if self.folder else Path(name)
        real = path.resolve()
        if real in self.above:
            raise FormatError(f"Parse error: Circular include detected: {real}")
        if len(self.above) >= INCLUDES:
            raise FormatError(f"Parse error: Include depth exceeds limit of {INCLUDES}")
        try:
            text = self.read(path)
        except OSError as e:
            raise FormatError(f"Parse error: Failed to include {name}: {e}") from None
        inner = Parser(text, path.parent, self.read, (*self.above, real))
        inner.schemas, inner.unions = dict(self.schemas), dict(self.unions)
        data = inner.document()
        self.schemas.update(inner.schemas)
        self.unions.update(inner.unions)
        return data

    def pair(self, depth: int) -> tuple[str, Any]:
        if self.kind not in ("Word", "String"):
            raise FormatError(f"Expected key, got {self.got()}")
        key = self.next()
        self.expect("Colon")
        return key, self.value(depth)

    def entry(self, depth: int) -> tuple[str, Any]:
        if self.kind == "Ref":
            key = f"!{self.next()}"
            self.expect("Colon")
            return key, self.value(depth)
        return self.pair(depth)

    def value(self, depth: int) -> Any:
        if depth > DEPTH:
            raise FormatError("Parse error: maximum parse nesting depth exceeded")
        kind = self.kind
        if kind in SCALARS:
            return self.next()
        if kind in ("Null", "ExplicitNull"):
            return self.next()
        if kind == "Ref":
            return Ref(self.next())
        if kind == "LBrace":
            self.next()
            return dict(self.until("RBrace", lambda: self.entry(depth + 1)))
        if kind in ("LBracket", "LParen"):
            self.next()
            return self.until("RBracket" if kind == "LBracket" else "RParen", lambda: self.value(depth + 1))
        if kind == "Colon":
            self.next()
            tag = self.expect("Word", "tag name after ':'")
            return Tagged(tag, self.value(depth + 1))
        if kind == "Directive":
            name = self.next()
            if name == "table":
                return self.table(depth)
            if name == "map":
                self.expect("LBrace")
                return Pairs(self.until("RBrace", lambda: self.map_entry(depth + 1)))
            if self.kind in STARTS:
                self.value(depth + 1)
            return None
        raise FormatError(f"Expected value, got {self.got()}")

    def map_entry(self, depth: int) -> tuple[Any, Any]:
        if self.kind not in ("String", "Word", "Int", "UInt"):
            raise FormatError(f"Expected map key, got {self.got()}")
        key = self.next()
        self.expect("Colon")
        return key, self.value(depth)

    def table(self, depth: int) -> list:
        name = self.expect("Word", "word")
        if name not in self.schemas:
            raise FormatError(f"Unknown struct: {name}")
        self.expect("LBracket")
        return self.until("RBracket", lambda: self.row(self.schemas[name], depth + 1))

    def row(self, schema: Schema, depth: int) -> dict[str, Any]:
        """A tuple by position. In a nullable field ``~`` is no field at all, and null is one that is null."""
        self.expect("LParen")
        out = {}
        for name, kind in schema.fields:
            token = self.kind
            value = self.next() if token in SCALARS and not kind.is_array else self.of_type(kind, depth)
            if value is not None or token == "ExplicitNull" or not kind.nullable:
                out[name] = value
            if self.kind == "Comma":
                self.next()
        self.expect("RParen")
        return out

    def of_type(self, kind: FieldType, depth: int) -> Any:
        if depth > DEPTH:
            raise FormatError("Parse error: maximum parse nesting depth exceeded")
        if self.kind in ("Null", "ExplicitNull"):
            return self.next()
        if not kind.is_array and self.kind == "LParen" and kind.base in self.schemas:
            return self.row(self.schemas[kind.base], depth + 1)
        if kind.is_array:
            self.expect("LBracket")
            return self.until("RBracket", lambda: self.of_type(FieldType(kind.base), depth + 1))
        return self.value(depth)


def parse(text: str, path: str | Path | None = None) -> Document:
    """A document from its text; includes are looked for beside ``path``."""
    p = Parser(text, Path(path).parent if path else None, above=(Path(path).resolve(),) if path else ())
    data = p.document()
    return Document(data, p.schemas, p.unions, p.root_array)


def load(path: str | Path) -> Document:
    return parse(Path(path).read_text(encoding="utf-8"), path)
