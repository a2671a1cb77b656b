import json
import math
import tracemalloc

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera import cli
from tessera.operators import inference as I
from tessera.sources import binary, datasource, documents, text
from tessera.sources.render import Style, float_text, needs_quoting, singular, to_text
from tessera.sources.values import BigNumber, Document, FieldType, FormatError, Pairs, Ref, Schema, Tagged, Timestamp, format_timestamp, from_json, to_json, value_json

SAMPLE = """
# people
@struct address (street: string, city: string, zip: string?)
@struct person (id: int, name: string, "e-mail": string?, home: address?, tags: []string, score: float?)
@union shape { circle (r: float), box (w: float, h: float), none () }
@later some-argument
title: "A \\"title\\"\\n\\u00e9"
block: \"\"\"
    first
      second

    third
    \"\"\"
people: @table person [
  (1, ann, null, ("1 Main", Ulm, ~), [a, "b c"], 1.5),
  (2, "Bo Li", ~, ~, [], ~),
]
numbers: [1, -2, 0xff, -0b101, 1.0, 2e3, 18446744073709551615, 123456789012345678901234567890, 1e999, NaN, inf, -inf]
when: [2024-02-29, 2024-01-15T10:30Z, 2024-01-15T10:30:05.25+05:30, 2024-01-15T10:30:00-0800]
raw: b"00ff7A"
nothing: ~
choice: :circle (5.0)
!base: {x: 1}
uses: {ref: !base, !inner: 2}
lookup: @map {1: one, "two": 2, three: [3]}
pair: (1, two)
unknown: @thing 5
"""


def test_everything_in_a_text():
    d = text.parse(SAMPLE)
    v = d.data
    assert v["title"] == 'A "title"\né' and v["block"] == "first\n  second\n\nthird"
    assert v["people"] == [
        {"id": 1, "name": "ann", "e-mail": None, "home": {"street": "1 Main", "city": "Ulm"}, "tags": ["a", "b c"], "score": 1.5},
        {"id": 2, "name": "Bo Li", "tags": []},
    ]
    assert v["numbers"][:7] == [1, -2, 255, -5, 1.0, 2000.0, 2**64 - 1]
    assert v["numbers"][7:9] == ["123456789012345678901234567890", "1e999"] and isinstance(v["numbers"][7], BigNumber)
    assert math.isnan(v["numbers"][9]) and v["numbers"][10:] == [math.inf, -math.inf]
    assert [format_timestamp(t) for t in v["when"]] == ["2024-02-29T00:00:00Z", "2024-01-15T10:30:00Z", "2024-01-15T10:30:05.250+05:30", "2024-01-15T10:30:00-08:00"]
    assert v["raw"] == b"\x00\xff\x7a" and v["nothing"] is None and v["unknown"] is None
    assert v["choice"] == Tagged("circle", [5.0]) and v["!base"] == {"x": 1}
    assert v["uses"] == {"ref": Ref("base"), "!inner": 2} and isinstance(v["uses"]["ref"], Ref)
    assert v["lookup"] == Pairs([(1, "one"), ("two", 2), ("three", [3])]) and v["pair"] == [1, "two"]
    assert [n for n, _ in d.unions["shape"].variants] == ["circle", "box", "none"]
    assert d.schemas["person"].fields[2] == ("e-mail", FieldType("string", True))


@pytest.mark.parametrize("style", [Style(), Style(True), Style(True, False)])
def test_text_round_trip(style):
    d = text.parse(SAMPLE)
    once = to_text(d, style)
    again = text.parse(once)
    assert value_json(again.data) == value_json(d.data) and to_text(again, style) == once
    assert again.schemas == d.schemas and again.unions == d.unions


@pytest.mark.parametrize("compress", [True, False])
def test_binary_round_trip(compress):
    d = text.parse(SAMPLE)
    data = binary.to_binary(d, compress)
    assert data[:4] == binary.MAGIC and data[4:8] == b"\x02\0\0\0" and len(data) > 64
    back = binary.from_binary(data)
    assert value_json(back.data) == value_json(d.data) and back.schemas == d.schemas and back.unions == d.unions


def test_three_states_of_a_field():
    d = text.parse("@struct s (a: int?, b: int?, c: int)\nt: @table s [(1, null, 3), (~, 2, ~)]")
    assert d.data["t"] == [{"a": 1, "b": None, "c": 3}, {"b": 2, "c": None}]
    assert to_text(d, Style(True)).splitlines()[2:4] == ["(1,null,3),", "(~,2,null)"]
    assert binary.from_binary(binary.to_binary(d)).data == d.data


def test_a_row_without_any_field_is_read_as_null():
    d = text.parse("@struct s (a: int?)\nt: @table s [(~), (1)]")
    assert binary.from_binary(binary.to_binary(d, lossless=False)).data["t"] == [None, {"a": 1}]
    assert binary.from_binary(binary.to_binary(d)).data["t"] == [{}, {"a": 1}]


def test_coercion_only_when_asked_for():
    d = text.parse("@struct s (i: int8, u: uint8, f: float, s: string, b: bool, n: int)\nt: @table s [(300, -1, 2, 3, x, 2.9), (1, 2, 1.5, s, true, 9)]")
    assert binary.from_binary(binary.to_binary(d)).data == d.data
    assert binary.from_binary(binary.to_binary(d, lossless=False)).data["t"][0] == {"i": 0, "u": 0, "f": 2.0, "s": "", "b": False, "n": 2}


@pytest.mark.parametrize(
    ("source", "message"),
    [
        ('a: "x', "Unterminated string"), ('a: """x', "Unterminated multiline string"), ("a: 0x", "Invalid hex: 0x"), ("a: 0b", "Invalid binary: 0b"), ("a: 0xffffffffffffffff", "Invalid hex"),
        ("a b", 'Expected Colon, got Word("b")'), ("a: {b: 1", "Expected key, got Eof"), ("a: [1", "Expected value, got Eof"), ('a: "\\q"', "Invalid escape sequence: \\q"), ('a: "\\ud800"', "Invalid unicode codepoint: U+D800"),
        ('a: "\\u12"', "expected 4 hex digits"), ('a: b"123"', "odd number of hex digits"), ('a: b"xy"', "Invalid character 'x'"), ("a: 2024-13-01", "Invalid timestamp"), ("a: 2024-01-01T25:00Z", "Invalid timestamp"),
        ("a: @table none []", "Unknown struct: none"), ("@struct s (a: object)", "cannot be used as a schema field type"), ("@struct s (a: int)\nt: @table s [(1, 2)]", "Expected RParen"), ("@struct s (a: int, b: int)\nt: @table s [(1)]", "Expected value"),
        ("a: 1e", "Invalid float"), ('@include "nowhere.x"', "Failed to include nowhere.x"), ("a: : 5", "Expected tag name"), ("a: @map {[1]: 2}", "Expected map key"), ("a: " + "[" * 300, "depth exceeded"),
    ],
)
def test_errors(source, message):
    with pytest.raises(FormatError, match=__import__("re").escape(message)):
        text.parse(source)


def test_days_roll_over():
    assert format_timestamp(text.parse("a: 2023-02-31").data["a"]) == "2023-03-03T00:00:00Z"


def test_includes(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "types.t").write_text("@struct p (x: int)\nshared: 1\nkept: 2")
    (tmp_path / "in" / "rows.t").write_text("rows: @table p [(1), (2)]")
    (tmp_path / "main.t").write_text('kept: 0\n@include "in/types.t"\n@include "in/rows.t"\nshared: 3')
    assert text.load(tmp_path / "main.t").data == {"kept": 2, "shared": 3, "rows": [{"x": 1}, {"x": 2}]}
    (tmp_path / "a.t").write_text("@include b.t")
    (tmp_path / "b.t").write_text("@include a.t")
    with pytest.raises(FormatError, match="Circular"):
        text.load(tmp_path / "a.t")


def test_json_is_taken_as_it_is():
    d = from_json('{"a": {"$ref": "x"}, "b": "0xff", "c": "2024-01-01", "n": [1, 1.0, 18446744073709551615, 18446744073709551616, 1e400, -0]}')
    assert d.data["a"] == {"$ref": "x"} and d.data["b"] == "0xff" and d.data["c"] == "2024-01-01"
    assert [type(x) for x in d.data["n"]] == [int, float, int, BigNumber, BigNumber, int]
    assert to_json(from_json("[1, {}]"), pretty=False) == "[1,{}]" and to_json(from_json("3"), pretty=False) == '{"root":3}'
    assert value_json([math.nan, b"\xab", Ref("r"), Tagged("t", 1), Pairs([(1, 2)]), Timestamp(0, 90)]) == '[null,"0xab",{"$ref":"r"},{"$tag":"t","$value":1},[[1,2]],"1970-01-01T01:30:00+01:30"]'
    for bad in ("{", '{"a": NaN}', ""):
        with pytest.raises(FormatError):
            from_json(bad)


@pytest.mark.parametrize(("x", "want"), [(1.0, "1.0"), (0.1, "0.1"), (1e15, "1e15"), (123456789012345.0, "123456789012345.0"), (1e21, "1e21"), (-2.5e17, "-2.5e17"), (1e-7, "0.0000001"), (math.inf, "inf"), (-0.0, "-0.0")])
def test_floats(x, want):
    assert float_text(x) == want and (math.isnan(x) or text.parse(f"a: {want}").data["a"] == x)


def test_names():
    assert [singular(x) for x in ("Cities", "boxes", "classes", "class", "items", "s", "dishes")] == ["city", "box", "class", "class", "item", "s", "dish"]
    assert [needs_quoting(x) for x in ("", "true", "a b", "1a", "a-b.c", "é", "_x", "NaN", "-a")] == [True, True, True, True, False, True, False, True, True]


def test_inference():
    d = from_json('{"orders": [{"id": 1, "to": {"city": "x"}, "items": [{"sku": "a", "n": 1}]}, {"id": 2.5, "to": {"city": "y", "zip": null}, "note": null, "items": [{"sku": "b"}, {"sku": "c", "n": 2}]}], "mixed": [1, {}], "none": [{"a": 1}, {"b": 2}], "none2": []}')
    found = I.infer(d).schemas
    assert {n: [(k, str(t)) for k, t in s.fields] for n, s in found.items()} == {
        "to": [("city", "string"), ("zip", "string?")],
        "item": [("sku", "string"), ("n", "int64?")],
        "order": [("id", "float"), ("to", "to"), ("note", "string?"), ("items", "[]item")],
    }
    assert dict(I.infer(d, compat=True).schemas["item"].fields)["n"] == FieldType("int", True)
    shown = text.parse(to_text(I.infer(d)))
    assert value_json(shown.data) == value_json(d.data)


def test_kinds_merge_either_way():
    kinds = [I.kind_of(v) for v in (None, True, 1, 1.5, "s", [1], [1.5], [], {"a": 1}, {"a": None, "b": 2}, {"c": 1}, Ref("x"))]
    for a in kinds:
        assert I.merge(a, a) == a
        for b in kinds:
            x, y = I.merge(a, b), I.merge(b, a)
            assert x == y or (x.name == y.name == "object" and dict(x.fields) == dict(y.fields))
    assert I.merge(I.INT, I.FLOAT) == I.FLOAT and I.merge(I.INT, I.STRING) == I.MIXED


def test_schema_matching():
    s = Schema("s", [("a", FieldType("int")), ("b", FieldType("int", True)), ("c", FieldType("int"))])
    assert s.accepts(["a", "c"]) and s.accepts("abc") and not s.accepts("ab") and not s.accepts("abcd")
    assert s.overlaps([{"a": 1, "b": 2}]) and not s.overlaps([{"a": 1}]) and not s.overlaps([]) and not s.overlaps([1])


values = st.recursive(
    st.none() | st.booleans() | st.integers(-(2**63), 2**64 - 1) | st.floats(allow_nan=False) | st.text(st.characters(exclude_categories=["Cs"])) | st.binary(max_size=9)
    | st.builds(Timestamp, st.integers(-62_000_000_000_000, 250_000_000_000_000), st.integers(-1439, 1439)) | st.from_regex(r"[a-z][a-z0-9_]{0,5}", fullmatch=True).map(Ref),
    lambda inner: st.lists(inner, max_size=4) | st.dictionaries(st.text(st.characters(exclude_categories=["Cs"]), max_size=6), inner, max_size=4) | st.builds(Tagged, st.from_regex(r"[a-z][a-z0-9]{0,4}", fullmatch=True).filter(lambda t: t not in ("true", "false", "null", "inf")), inner)
    | st.lists(st.tuples(st.text(st.characters(exclude_categories=["Cs"]), max_size=5) | st.integers(-(2**63), 2**63 - 1), inner), max_size=3).map(Pairs),
    max_leaves=12,
)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text(st.characters(exclude_categories=["Cs"]), min_size=1, max_size=8), values, max_size=4))
def test_any_document_survives(data):
    # A leading "!" names a reference's definition in text; a tagged value written without its own brackets is one with what follows it.
    doc = Document(data)
    assert value_json(binary.from_binary(binary.to_binary(doc)).data) == value_json(data)
    assert value_json(text.parse(to_text(doc)).data) == value_json(data)
    assert value_json(text.parse(to_text(doc, Style(True))).data) == value_json(data)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=200) | st.text(max_size=80).map(str.encode))
def test_no_input_crashes(data):
    for read in (lambda: binary.from_binary(data), lambda: binary.from_binary(binary.to_binary(text.parse(SAMPLE))[:-1] + data), lambda: text.parse(data.decode("utf-8", "replace"))):
        try:
            read()
        except FormatError:
            pass


def test_broken_binaries():
    whole = binary.to_binary(text.parse(SAMPLE), compress=False)
    for i in range(0, len(whole), 3):
        for made in (whole[:i], whole[:i] + b"\xff" + whole[i + 1 :]):
            try:
                value_json(binary.from_binary(made).data)
            except (FormatError, UnicodeEncodeError):
                pass
    with pytest.raises(FormatError, match="magic"):
        binary.Reader(b"none" * 20)
    with pytest.raises(FormatError, match="version: 3"):
        binary.Reader(whole[:4] + b"\x03" + whole[5:])


def test_sections_are_read_one_by_one():
    r = binary.Reader(binary.to_binary(text.parse(SAMPLE)))
    assert r.keys()[:3] == ["title", "block", "people"] and r.get("people") is r.get("people")
    r.clear()
    assert r.get("raw") == b"\x00\xff\x7a"
    with pytest.raises(FormatError):
        r.get("nowhere")


# Spark


def test_reading_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.t").write_text(SAMPLE)
    (tmp_path / "t" / "bad.t").write_text('x: "')
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "a.b").write_bytes(binary.to_binary(text.parse(SAMPLE)))
    rows = documents.read_documents(spark, str(tmp_path / "t"))
    assert {r["error"] for r in rows.where("key is null").collect()} == {"Parse error: Unterminated string"}
    from_text = {r["key"]: r["json"] for r in rows.where("key is not null").collect()}
    from_binary = documents.read_documents(spark, str(tmp_path / "b"), "binary")
    assert {r["key"]: r["json"] for r in from_binary.collect()} == from_text
    only = documents.read_documents(spark, str(tmp_path / "b"), "binary", ["people"])
    schema = documents.schema_of(text.parse(SAMPLE), "people")
    people = documents.table_rows(only, schema).orderBy("row").collect()
    assert [(r["id"], r["name"], r["tags"]) for r in people] == [(1, "ann", ["a", "b c"]), (2, "Bo Li", [])]
    assert people[0]["home"]["city"] == "Ulm" and people[1]["home"] is None


def test_data_source_with_pushed_filters(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.b").write_bytes(binary.to_binary(Document({"a": i, "b": [i]})))
    datasource.register(spark)
    df = spark.read.format("nested").option("form", "binary").load(str(tmp_path))
    assert df.count() == 6 and df.rdd.getNumPartitions() == 3
    assert sorted(r["json"] for r in df.where("key = 'b'").collect()) == ["[0]", "[1]", "[2]"]
    assert df.where("key in ('a', 'b') and json = '[1]'").count() == 1
    reader = datasource.Reader({"path": str(tmp_path), "form": "binary"})
    rest = list(reader.pushFilters([datasource.EqualTo(("key",), "b"), datasource.EqualTo(("json",), "x")]))
    assert reader.keys == {"b"} and len(rest) == 1
    with pytest.raises(ValueError):
        datasource.Reader({})


def test_converting_rows(spark):
    files = spark.createDataFrame([("x", bytearray(b'{"rows": [{"a": 1}, {"a": null}]}')), ("bad", bytearray(b"{")), ("none", None)], "path string, content binary")
    got = {r["path"]: r for r in documents.converted(files, "json", "compact", with_inference=True).collect()}
    assert got["x"]["content"].decode() == "@struct row(a:int64?)\nrows:@table row[\n(1),\n(null)\n]\n"
    assert got["bad"]["content"] is None and "not JSON" in got["bad"]["error"] and tuple(got["none"])[1:] == (None, None)
    assert documents.parsed(files.limit(0), "json").collect() == []
    with pytest.raises(ValueError):
        documents.parsed(files, "other")


class Direct:
    """Stands for a table of files: gives the function that Python's workers run on its batches."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_a_batch_of_many_documents_leaves_in_slices():
    made = [json.dumps({"turns": [{"turn": i, "text": f"{i} " * 1500}]}).encode() for i in range(1000)]
    made[7], made[500] = None, b"{"
    batch = pa.record_batch([pa.array(map(str, range(1000))), pa.array(made, pa.binary())], ["path", "content"])
    tracemalloc.start()
    try:
        most, out = 0, []
        for b in documents.converted(Direct(), "json", "binary", with_inference=True)(iter([batch])):
            most = max(most, tracemalloc.get_traced_memory()[1])
            out.append(b)
    finally:
        tracemalloc.stop()
    assert most < 3 << 20 < batch.nbytes and max(b.nbytes for b in out) < 2 << 20
    whole = pa.Table.from_batches(out).to_pylist()
    assert [r["path"] for r in whole] == list(map(str, range(1000)))
    assert all(r["content"] == binary.to_binary(I.infer(from_json(d.decode()))) and r["error"] is None for r, d in zip(whole, made) if d not in (None, b"{"))
    assert (whole[7]["content"], whole[7]["error"]) == (None, None) and whole[500]["content"] is None and "not JSON" in whole[500]["error"]
    parsed = list(documents.parsed(Direct(), "binary", ["turns"])(iter(out)))
    assert 1 < len(parsed) < 20 and max(b.nbytes for b in parsed) < 2 << 20
    rows = pa.Table.from_batches(parsed).to_pylist()
    assert [r["path"] for r in rows] == list(map(str, range(1000))) and {r["path"] for r in rows if r["error"]} == {"7", "500"}
    assert all(json.loads(r["json"]) == json.loads(d)["turns"] for r, d in zip(rows, made) if r["error"] is None)


def test_a_slice_is_no_smaller_than_a_row():
    batches = [pa.record_batch([pa.array([str(i)]), pa.array([b'{"a": "' + b"x" * (n << 20) + b'", "b": 1}'])], ["path", "content"]) for i, n in enumerate((3, 0, 2))]
    out = list(documents.parsed(Direct(), "json")(iter(batches)))
    assert [[(r["path"], r["key"]) for r in b.to_pylist()] for b in out] == [[("0", "a")], [("0", "b"), ("1", "a"), ("1", "b"), ("2", "a")], [("2", "b")]]
    assert list(documents.parsed(Direct(), "json", ["none"])(iter(batches))) == []


def test_documents_from_rows(spark):
    df = spark.createDataFrame([("g", 2, "b", None), ("g", 1, "a", 0.5), ("h", 1, None, 1.0)], "k string, n int, s string, x double")
    got = {r["path"]: json.loads(r["content"]) for r in documents.from_rows(df, ["k"], "rows", ["n"]).collect()}
    assert got == {"g": {"rows": [{"n": 1, "s": "a", "x": 0.5}, {"n": 2, "s": "b", "x": None}]}, "h": {"rows": [{"n": 1, "s": None, "x": 1.0}]}}
    assert df.select(F.count("*")).first()[0] == 3


def test_command_line(tmp_path, capsys):
    a, b, c, j = (str(tmp_path / n) for n in ("a.t", "b.b", "c.t", "d.json"))
    (tmp_path / "a.t").write_text(SAMPLE)
    assert cli.main(["compile", a, "-o", b]) == cli.main(["decompile", b, "-o", c, "--compact"]) == cli.main(["binary-to-json", b, "-o", j]) == 0
    assert value_json(text.load(c).data) == value_json(text.load(a).data)
    assert cli.main(["from-json", j, "-o", c]) == cli.main(["json-to-binary", j, "-o", b, "--no-compress"]) == cli.main(["validate", a]) == cli.main(["to-json", a]) == 0
    assert "@table" in (tmp_path / "c.t").read_text()
    assert cli.main(["info", b]) == 0 and "keys: " in capsys.readouterr().out
    (tmp_path / "a.t").write_text("x:")
    assert cli.main(["validate", a]) == 1 and "error" in capsys.readouterr().err
    assert cli.main(["info", str(tmp_path / "none")]) == 1
