import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import numeric, paths, scoring, temporal, text
from tessera.operators import relational as R
from tessera.sources.values import Timestamp, format_timestamp


def column(spark, values, made, kind="string"):
    """What an expression makes of each value."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(made(F.col("x"))).collect()]


def test_quoting_and_escaping(spark):
    odd = ["", "true", "a b", "1a", "a-b.c", "é", "_x", "x\n"]
    assert column(spark, odd, text.needs_quoting) == [True, True, True, True, False, True, False, True]
    assert column(spark, ['a"\\\n\t\x01\x7f\0', "plain"], text.quoted) == ['"a\\"\\\\\\n\\t\\u0001\\u007f\\u0000"', "plain"]


def test_names(spark):
    assert column(spark, ["Cities", "boxes", "classes", "class", "items", "s"], text.singularize) == ["city", "box", "class", "class", "item", "s"]
    assert column(spark, ["OrderLine", "ABC", "x", "aB"], text.snake_case) == ["order_line", "a_b_c", "x", "a_b"]


def test_texts(spark):
    assert column(spark, ["<p>a<br>b</p>  c", None], text.strip_html) == ["a b c", None]
    assert column(spark, ["x" * 201, "x" * 10, None, "x" * 200], text.truncate) == ["x" * 200 + "...", "", "", "x" * 200]
    assert column(spark, ["a:b:c:d:e", "a:b"], lambda c: text.part_of(c, ":", 3, 5)) == ["d", None]
    assert column(spark, ["  a\n    b\n\n", "\n  x\n  y\n ", "z"], text.dedent) == ["a\n  b\n", "x\ny", "z"]
    assert column(spark, ["", None, "b"], lambda c: text.first_filled(c, F.lit("d"))) == ["d", "d", "b"]
    with pytest.raises(Exception, match="no marker"):
        column(spark, ["nothing"], lambda c: text.after_marker(c, "=== "))
    df = spark.createDataFrame([("abcde", "abxde"), ("aa", "aaa"), ("", "x"), ("same", "same")], "a string, b string")
    assert [tuple(r) for r in df.select(*text.common_affixes(F.col("a"), F.col("b"))).collect()] == [(2, 2), (2, 0), (0, 0), (4, 0)]


def test_numbers(spark):
    assert column(spark, ["1", "-0x1f", "9223372036854775808", "18446744073709551616", "1.5", "1e400", "x", "0b1", None], numeric.number_kind) == ["int", "int", "uint", "big", "float", "big", None, "int", None]
    assert column(spark, ["0xff", "-0b11", "12", "-0x10"], numeric.literal_value) == [255, -3, 12, -16]
    assert column(spark, [127, 128, -129, 2**31, None], numeric.integer_width, "long") == ["int8", "int16", "int16", "int64", None]
    assert column(spark, [255, 256, 2**32, None], numeric.unsigned_width, "long") == ["uint8", "uint16", "uint64", None]
    assert column(spark, ["2.9", "-2.9", "x", "3000000000", "NaN", None], numeric.coerce_int) == [2, -2, 0, 0, 0, 0]
    assert column(spark, [128, -129, 255, 2**40 + 5], lambda c: numeric.wrap_int(c, 8), "long") == [-128, 127, -1, 5]
    assert column(spark, ["00fF", "0", "zz", ""], lambda c: numeric.hexed(numeric.unhexed(c))) == ["00ff", None, None, ""]
    assert column(spark, ["31260.00000", "1.5", "x", "1e16"], lambda c: F.struct(*numeric.coerce_numeric(c))) == [Row(31260, None), Row(None, 1.5), Row(None, None), Row(None, 1e16)]


def test_bytes_of_numbers():
    for n in (0, 1, 127, 128, 300, 2**63):
        assert numeric.read_varint(numeric.varint(n) + b"rest", 0) == (n, len(numeric.varint(n)))
    for bad in (b"", b"\x80", b"\x80" * 11):
        with pytest.raises(ValueError):
            numeric.read_varint(bad, 0)
    assert numeric.squeezed(b"a" * 64) == (b"a" * 64, False)
    assert numeric.squeezed(b"a" * 65)[1] and not numeric.squeezed(bytes(range(100)))[1]
    assert [numeric.format_float(x) for x in (1.0, 0.1, 1e15, 1e21, math.inf, -math.inf, math.nan, 123456.789)] == ["1.0", "0.1", "1e15", "1e21", "inf", "-inf", "NaN", "123456.789"]


STAMPS = ["2024-01-15", "2024-01-15T10:30Z", "2024-01-15T10:30:05.25+05:30", "2024-01-15T10:30:00-0800", "2023-02-31", "1969-12-31T23:59:59.999Z", "2024-01-15T10:30:05.1234567Z", "2024-01-15T10:30:00+05"]


def test_timestamps(spark):
    got = column(spark, STAMPS, lambda c: F.struct(*temporal.parse_iso(c)))
    from tessera.sources.text import timestamp

    assert [tuple(r) for r in got] == [tuple(timestamp(s)) for s in STAMPS]
    assert column(spark, ["2024-13-01", "2024-01-01T24:00Z", "x", None, "2024-1-01"], lambda c: temporal.parse_iso(c)[0]) == [None] * 5
    rows = [(0, 0), (-1, 0), (1705314605250, 330), (1705314605000, -480), (10**17, 0), (-(10**17), 90)]
    df = spark.createDataFrame(rows, "ms long, tz int")
    assert [r[0] for r in df.select(temporal.format_millis(F.col("ms"), F.col("tz"))).collect()] == [format_timestamp(Timestamp(*r)) for r in rows]
    assert column(spark, [1, 12, 13], temporal.month_name, "int") == ["January", "December", None]


def test_paths(spark):
    assert paths.parse_path("a.b[0].c") == ["a", "b", 0, "c"] and paths.parse_path("[1][2].x") == [1, 2, "x"] and paths.parse_path("a.") == ["a"]
    for bad in ("", ".a", "a..b", "a[", "a[]", "a[x]", "a[-1]", "a[99999999999999999999]", "a[0]b"):
        assert paths.parse_path(bad) is None
    assert paths.json_path("a.x y[2]") == '$.a["x y"][2]'
    df = spark.createDataFrame([('{"a": {"x y": [1, {"b": "t"}]}, "n": null}',)], "j string")
    v = F.parse_json("j")
    got = df.select(paths.at_path(v, "a.x y[1].b", "string"), paths.at_path(v, "a.x y[0]", "int"), paths.at_path(v, "a.x y[9]", "int"), paths.at_path(v, "a..b", "int"), paths.at_path(v, "a.x y[1].b", "int"), paths.in_json("j", "a.x y[1].b"), paths.in_json("j", "n")).first()
    assert tuple(got) == ("t", 1, None, None, None, "t", None)
    typed = T.StructType([T.StructField("l", T.ArrayType(T.StructType([T.StructField("odd.name", T.StringType())])))])
    df = spark.createDataFrame([(([("7",)],),)], T.StructType([T.StructField("s", typed)]))
    assert tuple(df.select(paths.at_path(F.col("s"), "l[0]", "string", typed).isNotNull(), paths.at_path(F.col("s"), "l[0].none", "int", typed), paths.at_path(F.col("s"), "l.x", "int", typed)).first()) == (True, None, None)
    with pytest.raises(Exception, match="missing k"):
        df.select(paths.required(F.lit(None), "k")).collect()


def test_scores(spark):
    words = "You should consider and recommend the next step. " * 30
    assert column(spark, [words, "nothing"], scoring.actionability) == [1.0, 0.0]
    assert column(spark, ["## a\n\nb\n\n- c " + "w " * 120, "x"], scoring.coherence) == [pytest.approx(0.5 + 2 / 7 * 0.2 + 0.3), 0.5]
    assert column(spark, ["12 and 3.5 and 7", ""], lambda c: scoring.numbers(c, 4)) == [0.75, 0.0]
    assert column(spark, ["a"], lambda c: scoring.numbers(c, 0)) == column(spark, ["a"], lambda c: scoring.keyword_share(c, [], 0.5)) == [1.0]
    assert column(spark, ["Alpha only"], lambda c: scoring.keyword_share(c, ["alpha", "beta", "gamma", "delta"], 0.5)) == [0.5]
    es = [scoring.Element("a", "total revenue by region", r"\$\d+"), scoring.Element("b", "trend over time")]
    assert column(spark, ["Revenue was $5, a trend"], lambda c: F.struct(scoring.completeness(c, es), scoring.facts(c, es), scoring.relevance(c, es))) == [Row(1.0, 1.0, pytest.approx(2 / 6))]
    assert column(spark, ["x"], lambda c: F.struct(scoring.completeness(c, []), scoring.facts(c, []), scoring.relevance(c, []))) == [Row(1.0, 1.0, 1.0)]
    assert column(spark, ["x"], lambda c: scoring.weighted({"a": F.lit(1.0)}, {"a": 0.0})) == [0.0]
    assert column(spark, ["x y z"], lambda c: scoring.custom(c, "length_check")) == [0.5]
    # Weights that sum to more than 1.
    made = scoring.rubric(F.lit("## | token"), [scoring.Criterion("s", 0.9, "structure"), scoring.Criterion("p", 0.6, "pattern", {"regex": "token"})])
    assert spark.range(1).select(made).first()[0] == pytest.approx((0.9 * 0.4 + 0.6) / 1.5)


def test_relational_corners(spark):
    df = spark.createDataFrame([("g", "a", 1.0), ("g", "b", 1.0), ("h", "a", 2.0), ("i", "a", None), ("i", "b", 0.5)], "k string, e string, s double")
    assert sorted(map(tuple, R.winner_and_margin(df, "k", "e", "s").collect())) == [("g", "a", 1.0, 0.0), ("h", "a", 2.0, None), ("i", "b", 0.5, None)]
    assert {r["k"]: r["margin"] for r in R.winner_and_margin(df, "k", "e", "s", single=0.0).collect()}["h"] == 0.0
    assert R.with_fallback(df, F.col("k") == "zz", F.col("k") == "h").count() == 1 and R.with_fallback(df, F.col("k") == "g", F.lit(True)).count() == 2
    assert [tuple(r) for r in R.nest(df, ["k"], ["e"], F.when(F.col("s") > 1, F.col("e")), "x").orderBy("k").collect()] == [("g", []), ("h", ["a"]), ("i", [])]
    twice = spark.createDataFrame([(1, "L", 5), (1, "L", 6)], "i int, c string, v int")
    with pytest.raises(Exception, match="two values for L"):
        R.strict_pivot(twice, ["i"], "c", ["L", "R"], "v").collect()
    assert [tuple(r) for r in R.strict_pivot(twice.limit(1), ["i"], "c", ["L", "R"], "v").collect()][0][2] is None
    assert R.complete_cases(df, ["k"], "e", 2).count() == 4
    best = spark.createDataFrame([("p", "json", 1.0), ("p", "text", 1.0), ("q", "json", 0.0), ("q", "text", 3.0)], "p string, f string, s double")
    assert {r["p"]: r["best"] for r in R.best_or_baseline(best, "p", "f", "s", "json").collect()} == {"p": "json", "q": "text"}
    assert {r["p"]: r["pct"] for r in R.against_baseline(best, "p", "f", "s", "json").collect()} == {"p": 0.0, "q": 0.0}
    codes = spark.createDataFrame([("A",), ("Z",), (None,)], "c string")
    assert [r[0] for r in codes.select(R.code_lookup("c", {"A": "all"})).collect()] == ["all", "Z", "Other"]
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src int, dst int")
    assert sorted(tuple(r) for r in R.closure(ring, spark.createDataFrame([(2,)], "x int")).collect()) == [(2, 1, 2), (2, 2, 0), (2, 3, 1), (2, 4, 2)]
    none = df.limit(0)
    assert R.winner_and_margin(none, "k", "e", "s").collect() == R.first_per_key(none, ["k"], [F.col("e")]).collect() == R.last_wins(none, ["k"], F.col("e")).collect() == []
    assert [r[0] for r in codes.select(R.any_contains("c", [])).collect()] == [False] * 3
    assert [r[0] for r in spark.createDataFrame([(0.5,), (-3.0,), (9.0,)], "d double").select(R.verdict(F.col("d"))).collect()] == ["PASS", "MARGINAL", "FAIL"]


def test_closure_of_a_long_chain_a_clique_and_nulls(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(70)], "src int, dst int")
    start = spark.createDataFrame([(0,), (0,)], "x int")
    assert sorted(map(tuple, R.closure(chain, start).collect())) == [(0, i, i) for i in range(71)]
    clique = spark.createDataFrame([(i, j) for i in range(30) for j in range(30)], "src int, dst long")
    assert sorted(map(tuple, R.closure(clique, start).collect())) == [(0, i, min(i, 1)) for i in range(30)]
    nulls = spark.createDataFrame([(None, 1), (1, None), (1, 2), (1, 2)], "src int, dst int")
    found = R.closure(nulls, spark.createDataFrame([(None,), (1,)], "x int")).collect()
    assert set(map(tuple, found)) == {(None, None, 0), (1, 1, 0), (1, 2, 1)} and len(found) == 3
    assert R.closure(nulls, start.limit(0)).collect() == []


def test_places_over_several_ranges(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        rows = R.placed(spark.range(1000).select((F.col("id") * 37 % 1000).alias("k")), [F.col("k")], "place").collect()
    finally:
        spark.conf.unset(name)
    assert sorted((r["k"], r["place"]) for r in rows) == [(i, i + 1) for i in range(1000)]
    assert R.placed(spark.range(0), [F.col("id")], "place").collect() == []
