"""String functions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

RESERVED = ("true", "false", "null", "~", "NaN", "inf", "Infinity")


def needs_quoting(s: Column) -> Column:
    """Whether a string must be quoted to be read back as a string."""
    return ~s.rlike(r"\A[A-Za-z_][A-Za-z0-9_.\-]*\z") | s.isin(*RESERVED)


def escape(s: Column) -> Column:
    """Backslash escapes for quote, backslash and control characters."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r"), ("\b", "\\b"), ("\f", "\\f")):
        s = F.replace(s, F.lit(a), F.lit(b))
    rest = F.array(*(F.struct(F.lit(chr(k)).alias("c"), F.lit(f"\\u{k:04x}").alias("e")) for k in (*range(1, 8), 11, *range(14, 32), 127)))
    return F.when(s.rlike(r"[\x00-\x07\x0b\x0e-\x1f\x7f]"), F.replace(F.aggregate(rest, s, lambda acc, e: F.replace(acc, e["c"], e["e"])), F.lit("\0"), F.lit("\\u0000"))).otherwise(s)


def quoted(s: Column) -> Column:
    return F.when(needs_quoting(s), F.concat(F.lit('"'), escape(s), F.lit('"'))).otherwise(s)


def singularize(s: Column) -> Column:
    s = F.lower(s)
    return (
        F.when(s.endswith("ies") & (F.length(s) > 3), F.concat(F.left(s, F.length(s) - 3), F.lit("y")))
        .when(s.rlike("(ss|x|ch|sh)es$"), F.left(s, F.length(s) - 2))
        .when(s.endswith("s") & ~s.endswith("ss") & (F.length(s) > 1), F.left(s, F.length(s) - 1))
        .otherwise(s)
    )


def snake_case(s: Column) -> Column:
    """An underscore before each upper-case letter but a first one, then lower case."""
    return F.lower(F.regexp_replace(s, r"(?<!^)([A-Z])", "_$1"))


def strip_html(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(s, "<[^>]+>", " "), r"[ \t\n\r\f\x0B]+", " "))


def truncate(s: Column, n: int = 200, least: int = 10) -> Column:
    """The first n characters and an ellipsis; texts of ``least`` characters or fewer become empty."""
    s = F.coalesce(s, F.lit(""))
    return F.when(F.length(s) <= least, "").when(F.length(s) > n, F.concat(F.left(s, F.lit(n)), F.lit("..."))).otherwise(s)


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, else the empty string."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def part_of(s: Column, separator: str, index: int, least: int) -> Column:
    """Part ``index`` (from 0) if there are ``least`` parts or more."""
    parts = F.split(s, f"\\Q{separator}\\E", -1)
    return F.when(F.size(parts) >= least, F.get(parts, index))


def prefix_label(s: Column, separator: str, labels: dict[str, str], default: str = "Other") -> Column:
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.substring_index(s, separator, 1)), F.lit(default))


def word_count(s: Column) -> Column:
    return F.regexp_count(s, F.lit(r"\S+"))


def paragraph_count(s: Column) -> Column:
    return F.size(F.split(s, "\n\n", -1))


def number_count(s: Column) -> Column:
    return F.regexp_count(s, F.lit(r"[0-9]+\.?[0-9]*"))


def contained(s: Column, needles: Sequence[str]) -> Column:
    """How many of the needles, which are lower-case, a text contains whatever its case."""
    low = F.lower(s)
    return sum((F.contains(low, F.lit(n)).cast("int") for n in needles), F.lit(0))


def after_marker(s: Column, marker: str) -> Column:
    """What follows the first marker; a text without one is an error."""
    at = F.locate(marker, s) if isinstance(s, str) else F.instr(s, F.lit(marker))
    return F.when(at > 0, F.substring(s, at + len(marker), F.length(s))).otherwise(F.raise_error(F.lit(f"no marker {marker}")))


def common_affixes(a: Column, b: Column) -> tuple[Column, Column]:
    """Lengths of the longest common prefix and, of what remains of the shorter, suffix."""
    least = F.least(F.length(a), F.length(b))

    def run(x: Column, y: Column) -> Column:
        places = F.when(least > 0, F.sequence(F.lit(1), least))
        bad = F.filter(places, lambda i: F.substr(x, i, F.lit(1)) != F.substr(y, i, F.lit(1)))
        return F.coalesce(F.get(bad, 0) - 1, least)

    prefix = run(a, b)
    return prefix, F.least(run(F.reverse(a), F.reverse(b)), least - prefix)


def dedent(s: Column) -> Column:
    """A multi-line text without its blank first and last line and without the indentation that all lines share."""
    lines = F.split(s, "\n", -1)
    blank = lambda x: F.trim(x) == ""
    lines = F.when((F.size(lines) > 0) & blank(F.get(lines, 0)), F.slice(lines, F.lit(2), F.size(lines))).otherwise(lines)
    lines = F.when((F.size(lines) > 0) & blank(F.element_at(lines, F.greatest(F.size(lines), F.lit(1)))), F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    indents = F.transform(F.filter(lines, lambda x: ~blank(x)), lambda x: F.length(x) - F.length(F.ltrim(x)))
    least = F.coalesce(F.array_min(indents), F.lit(0))
    return F.array_join(F.transform(lines, lambda x: F.when(F.length(x) >= least, F.substr(x, least + 1)).otherwise(F.lit(""))), "\n")
