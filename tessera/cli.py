"""Command line: compile, decompile, info, validate, and conversions between text, binary and JSON. Errors go to stderr, with exit code 1."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from tessera.operators.inference import infer
from tessera.sources import binary, text
from tessera.sources.render import Style, to_text
from tessera.sources.values import Document, FormatError, from_json, kind_of, to_json


def _load(path: str) -> Document:
    data = Path(path).read_bytes()
    return binary.from_binary(data) if data[:4] == binary.MAGIC else text.load(path)


def info(path: str) -> str:
    data = Path(path).read_bytes()
    is_binary = data[:4] == binary.MAGIC
    doc = _load(path)
    out = [f"file: {path}", f"form: {'binary' if is_binary else 'text'}", f"bytes: {len(data)}", f"schemas: {len(doc.schemas)}"]
    for s in doc.schemas.values():
        out += [f"  {s.name}", *(f"    {n}: {t}" for n, t in s.fields)]
    out += [f"unions: {len(doc.unions)}", *(f"  {u.name}: {', '.join(n for n, _ in u.variants)}" for u in doc.unions.values())]
    return "\n".join([*out, f"keys: {len(doc.data)}", *(f"  {k}: {kind_of(v)}" + (f" of {len(v)}" if isinstance(v, list) else "") for k, v in doc.data.items())])


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="tessera")
    commands = top.add_subparsers(dest="command", required=True)
    for name, needs in (("compile", True), ("decompile", True), ("info", False), ("validate", False), ("to-json", None), ("from-json", True), ("binary-to-json", None), ("json-to-binary", True)):
        c = commands.add_parser(name)
        c.add_argument("input")
        if needs is not False:
            c.add_argument("-o", "--output", required=bool(needs))
        if name in ("decompile", "from-json"):
            c.add_argument("--compact", action="store_true")
            c.add_argument("--compact-floats", action="store_true")
        if name in ("compile", "json-to-binary"):
            c.add_argument("--no-compress", action="store_true")
    a = top.parse_args(argv)
    try:
        if a.command in ("compile", "json-to-binary"):
            doc = text.load(a.input) if a.command == "compile" else from_json(Path(a.input).read_text(encoding="utf-8"))
            Path(a.output).write_bytes(binary.to_binary(doc, not a.no_compress))
        elif a.command in ("decompile", "from-json"):
            doc = _load(a.input) if a.command == "decompile" else infer(from_json(Path(a.input).read_text(encoding="utf-8")))
            Path(a.output).write_text(to_text(doc, Style(a.compact, a.compact_floats)), encoding="utf-8")
        elif a.command in ("to-json", "binary-to-json"):
            made = to_json(_load(a.input))
            Path(a.output).write_text(made, encoding="utf-8") if a.output else print(made)
        elif a.command == "info":
            print(info(a.input))
        else:
            _load(a.input)
            print("valid")
    except (FormatError, OSError, UnicodeDecodeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
