import io
import zipfile
from dataclasses import dataclass, field

import pytest
from pyspark.sql import functions as F

from tessera.functions import accessors as V
from tessera.sources import builder as B
from tessera.sources import files, text
from tessera.sources.values import FieldType, FormatError, Ref, Schema


def test_delimited(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" id \tname\t v\n1\tx\t\n02\t\t3.5\n")
    df = files.delimited(spark, str(tmp_path / "a.txt"))
    assert df.dtypes == [("id", "string"), ("name", "string"), ("v", "string")]
    assert sorted(map(tuple, df.collect()), key=str) == [("02", None, "3.5"), ("1", "x", None)]
    assert files.delimited(spark, str(tmp_path / "a.txt"), columns=["v"]).columns == ["v"]


def test_zip_archives(spark):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("num.txt", "b\ta\r\n1\t2\r\n\t4\r\n")
        z.writestr("other.txt", "x")
    rows = spark.createDataFrame([("z", bytearray(data.getvalue())), ("bad", bytearray(b"no")), ("none", None)], "path string, content binary")
    assert sorted((r["path"], r["name"]) for r in files.unzipped(rows).where("name is not null").collect()) == [("z", "num.txt"), ("z", "other.txt")]
    assert files.unzipped(rows).where("name is null").count() == 1
    assert sorted(map(tuple, files.zipped_table(rows, "num.txt", ["a", "b", "c"]).collect()), key=str) == [("z", "2", "1", None), ("z", "4", None, None)]


def test_json_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"result": {"x": 1}}, {"result": {"x": 2}}]')
    (tmp_path / "b.json").write_text('{"result": {"x": 3, "y": "t"}}')
    df = files.json_records(spark, str(tmp_path))
    assert sorted(r["x"] for r in files.unwrapped(df).collect()) == [1, 2, 3]
    assert files.unwrapped(df, "absent").columns == df.columns
    (tmp_path / "b.json").write_text("{broken")
    df = files.json_records(spark, str(tmp_path), "result struct<x:int>, _corrupt string")
    assert sorted((r["result"].x if r["result"] else None, r["_corrupt"] is not None) for r in df.collect() if r["_corrupt"] is None) == [(1, False), (2, False)]


def test_a_pushed_query(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    got = files.newest_first(orders, F.col("o_totalprice") > 1000, [F.desc("o_orderkey")], ["o_orderkey"], 3)
    assert got.count() == 3 and "PushedFilters: [IsNotNull(o_totalprice)" in got._jdf.queryExecution().executedPlan().toString()


def test_accessors(spark):
    df = spark.createDataFrame([('{"i": 5, "f": 1.5, "s": "5", "b": true, "n": null, "a": [1, "x"], "o": {"k": 1}}',)], "j string").select(F.parse_json("j").alias("v"))
    at = {k: F.variant_get("v", f"$.{k}", "variant") for k in "ifsbnao"} | {"z": F.try_variant_get("v", "$.z", "variant")}

    def row(made):
        return list(df.select(*(made(c).alias(k) for k, c in at.items())).first())

    assert row(V.kind) == ["int", "float", "string", "bool", "null", "array", "object", None]
    assert row(V.as_int) == [5, *[None] * 7]
    assert row(V.as_float)[:4] == [5.0, 1.5, None, None]
    assert row(V.as_string) == [None, None, "5", *[None] * 5]
    assert row(V.as_bool)[3] is True
    assert row(V.length) == [None] * 5 + [2, 1, None]
    assert df.select(V.as_int_checked(at["i"]), V.as_int_checked(at["z"]), V.with_default(V.as_int(at["z"]), 7)).first()[:] == (5, None, 7)
    with pytest.raises(Exception, match="not an integer: string"):
        df.select(V.as_int_checked(at["s"])).collect()


@dataclass
class Place:
    city: str
    code: str | None = None


@dataclass
class Person:
    id: int
    name: str = field(metadata={"name": "full-name"})
    home: Place | None
    tags: list[str]
    at: Place = field(metadata={"flatten": True})
    secret: str = field(default="s", metadata={"skip": True})
    score: float = 0.5


def test_dataclasses():
    p = Person(1, "Ann", None, ["a"], Place("Ulm", "89"), "hidden", 2.0)
    doc = B.Builder().add("people", [p]).build()
    assert doc.data == {"people": [{"id": 1, "full-name": "Ann", "home": None, "tags": ["a"], "city": "Ulm", "code": "89", "score": 2.0}]}
    assert doc.schemas["Person"].fields == [("id", FieldType("int64")), ("full-name", FieldType("string")), ("home", FieldType("Place", True)), ("tags", FieldType("string", False, True)), ("city", FieldType("string")), ("code", FieldType("string", True)), ("score", FieldType("float"))]
    back = B.from_value(doc.data["people"], list[Person])
    assert back == [Person(1, "Ann", None, ["a"], Place("Ulm", "89"), "s", 2.0)]
    assert B.from_value({"id": 1, "full-name": "x", "tags": [], "city": "c"}, Person).score == 0.5
    assert B.from_value({"a": 1}, dict[str, float]) == {"a": 1.0}
    for bad, where in (({"full-name": "x", "tags": [], "city": "c"}, "Missing field: id"), ({"id": "1", "full-name": "x", "tags": [], "city": "c"}, "id: str for int"), ({"id": 1, "full-name": "x", "tags": [1], "city": "c"}, r"tags\[0\]: int for str"), ([], "no object")):
        with pytest.raises(FormatError, match=where):
            B.from_value(bad, Person)


def test_builder():
    s = Schema("s", [("a", FieldType("int"))])
    b = B.Builder().schema(s).schema(Schema("s", [("a", FieldType("int"))])).value("k", 1).root_array()
    with pytest.raises(FormatError, match="two schemas"):
        b.merge(text.parse("@struct s (a: string)"))
    assert b.merge(text.parse("@union u {x ()}\nk: 2\nm: 3")).build().data == {"k": 2, "m": 3}


def test_references():
    d = text.parse("!a: {next: !b}\n!b: {back: !a, v: 1}\nstart: [!a, !none]")
    assert B.resolve(d) == {"start": [{"next": {"back": Ref("a"), "v": 1}}, Ref("none")]}


def test_empty_parts():
    v = {"a": None, "b": [], "c": {}, "d": {"e": None}, "f": [None, {"g": []}], "h": "", "i": 0, "j": False}
    assert B.strip_empty(v) == {"d": {}, "f": [None, {}], "h": "", "i": 0, "j": False}
    assert B.without({"x": 1, "l": [{"x": 2, "attys": 3}]}, {"x"}, {"attys": "attorneys"}) == {"l": [{"attorneys": 3}]}
