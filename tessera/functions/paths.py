"""Paths such as ``a.b[0].c`` into nested values, compiled to columns, and accessors that give null rather than fail."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Step = str | int
_INDEX = re.compile(r"\[([0-9]+)\]")


def parse_path(path: str) -> list[Step] | None:
    """Names and indexes; None for an empty path, a leading or double dot, or a broken index. A dot at the end changes nothing."""
    steps: list[Step] = []
    rest = path
    if not rest:
        return None
    first = True
    while rest:
        if rest[0] == "[":
            m = _INDEX.match(rest)
            if not m or int(m[1]) >= 2**63:
                return None
            steps.append(int(m[1]))
            rest = rest[m.end() :]
        else:
            if rest[0] == ".":
                if first:
                    return None
                rest = rest[1:]
                if not rest:
                    break
            elif not first:
                return None
            m = re.match(r"[^.\[]+", rest)
            if not m:
                return None
            steps.append(m[0])
            rest = rest[m.end() :]
        first = False
    return steps


def json_path(path: str) -> str | None:
    """The path as ``$`` syntax, odd names quoted."""
    steps = parse_path(path)
    return None if steps is None else "$" + "".join(f"[{s}]" if isinstance(s, int) else f".{s}" if re.fullmatch(r"[A-Za-z_]\w*", s) else f'["{s}"]' for s in steps)


def at_path(column: Column, path: str, kind: str, schema: T.DataType | None = None) -> Column:
    """What lies at a path of a typed column (with its schema) or of a variant, as ``kind``; null where there is nothing or no such type."""
    steps = parse_path(path)
    if steps is None:
        return F.lit(None).cast(kind)
    if schema is None:
        return F.try_variant_get(column, json_path(path), kind)
    for s in steps:
        if isinstance(s, int):
            if not isinstance(schema, T.ArrayType):
                return F.lit(None).cast(kind)
            column, schema = F.get(column, s), schema.elementType
        else:
            if not isinstance(schema, T.StructType) or s not in schema.names:
                return F.lit(None).cast(kind)
            column, schema = column.getField(s), schema[s].dataType
    return column.try_cast(kind)


def in_json(column: Column | str, path: str, kind: str = "string") -> Column:
    """What lies at a path of a column of JSON text."""
    p = json_path(path)
    return F.lit(None).cast(kind) if p is None else F.get_json_object(column, p.replace('["', "['").replace('"]', "']")).try_cast(kind)


def required(column: Column, name: str) -> Column:
    return F.when(column.isNotNull(), column).otherwise(F.raise_error(F.lit(f"missing {name}")))
