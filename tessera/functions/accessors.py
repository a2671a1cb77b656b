"""Typed access to variants: null instead of failure, never a value that was changed on the way."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kind(v: Column) -> Column:
    """null, bool, int, float, string, array or object; SQL null for nothing at all."""
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), F.lit(None)).when(F.is_variant_null(v), "null").when(s == "BOOLEAN", "bool").when(s == "BIGINT", "int").when(s.startswith("DECIMAL") | (s == "DOUBLE"), "float")
        .when(s == "STRING", "string").when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object")
    )


def _of(v: Column, kinds: tuple[str, ...], to: str) -> Column:
    return F.when(kind(v).isin(*kinds), F.try_variant_get(v, "$", to))


def as_bool(v: Column) -> Column:
    return _of(v, ("bool",), "boolean")


def as_int(v: Column) -> Column:
    return _of(v, ("int",), "long")


def as_float(v: Column) -> Column:
    return _of(v, ("int", "float"), "double")


def as_string(v: Column) -> Column:
    return _of(v, ("string",), "string")


def as_array(v: Column) -> Column:
    return _of(v, ("array",), "array<variant>")


def as_object(v: Column) -> Column:
    return _of(v, ("object",), "map<string,variant>")


def as_int_checked(v: Column) -> Column:
    """As as_int; what isn't an integer is an error."""
    return F.when(v.isNull(), F.lit(None)).otherwise(F.coalesce(as_int(v), F.raise_error(F.concat(F.lit("not an integer: "), kind(v))).cast("long")))


def length(v: Column) -> Column:
    return F.coalesce(F.size(as_array(v)), F.size(as_object(v)))


def with_default(column: Column, default: object) -> Column:
    return F.coalesce(column, F.lit(default))
