"""Queries that go through the nested formats and back, and those on schemas and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import numeric as N
from tessera.operators import inference as I
from tessera.plans.catalogue import query, table
from tessera.sources import documents as D

TURNS = T.StructType([T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def _talks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return D.from_rows(rows, ["conv_id"], "turns", ["turn", "role", "text"])


def _turns(files: DataFrame, form: str) -> DataFrame:
    rows = D.table_rows(D.parsed(files, form, ["turns"]), TURNS)
    return rows.select(F.col("path").cast("long").alias("conv_id"), "turn", "role", "text")


SAME = "SELECT conv_id, turn, role, text FROM conversations"


@query(SAME)
def src1_snk3_text_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return _turns(D.converted(_talks(spark, d), "json", "text", with_inference=True), "text")


@query(SAME)
def snk6_compact_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return _turns(D.converted(_talks(spark, d), "json", "compact", with_inference=True), "text")


@query(SAME)
def src9_snk1_binary_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return _turns(D.converted(_talks(spark, d), "json", "binary", with_inference=True), "binary")


@query(SAME)
def src15_json_documents(spark: SparkSession, d: str) -> DataFrame:
    return _turns(_talks(spark, d), "json")


@query("SELECT r_name AS path, 'nations' AS key, 'array' AS kind, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def src12_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_nationkey", "n_name")
    files = D.converted(D.from_rows(rows, ["r_name"], "nations", ["n_nationkey"]), "json", "binary", with_inference=True)
    return D.parsed(files, "binary").select("path", "key", "kind", F.size(F.from_json("json", "array<string>")).cast("long").alias("n"))


@query("SELECT key, CASE kind WHEN 'UBIGINT' THEN 'BIGINT' ELSE kind END AS kind, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key, json_type(props, '$.' || unnest(json_keys(props))) AS kind FROM events) GROUP BY 1, 2")
def i1_infer_props(spark: SparkSession, d: str) -> DataFrame:
    return I.key_summary(table(spark, d, "events"), "props")


@query("SELECT event_id, len(list_filter(json_keys(props), lambda k: NOT list_contains(['k', 'extra'], k))) = 0 AND list_contains(json_keys(props), 'k') AS accepts FROM events")
def i5_schema_match(spark: SparkSession, d: str) -> DataFrame:
    keys, names, needed = F.json_object_keys("props"), F.array(F.lit("k"), F.lit("extra")), F.array(F.lit("k"))
    return table(spark, d, "events").select("event_id", ((F.size(F.array_except(keys, names)) == 0) & (F.size(F.array_except(needed, keys)) == 0)).alias("accepts"))


@query("SELECT p_partkey, coalesce(TRY_CAST(p_name AS INTEGER), 0) AS as_int, coalesce(TRY_CAST(p_name AS DOUBLE), 0.0::DOUBLE) AS as_float, CASE WHEN trunc(p_retailprice * 3000000) BETWEEN -2147483648 AND 2147483647 THEN CAST(trunc(p_retailprice * 3000000) AS BIGINT) ELSE 0 END AS narrowed FROM part")
def i9_typed_encode(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", F.coalesce(name.try_cast("int"), F.lit(0)).alias("as_int"), F.coalesce(name.try_cast("double"), F.lit(0.0)).alias("as_float"), N.coerce_int(F.col("p_retailprice") * 3000000).alias("narrowed"))


@query("SELECT o_orderpriority AS s, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS id FROM orders GROUP BY 1")
def i11_dictionary(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    first = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("s")).agg(F.min("o_orderkey").alias("first"))
    return first.select("s", (F.row_number().over(Window.orderBy("first")) - 1).cast("long").alias("id"))


@query("""SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","ratio":null}' AS json FROM nation""")
def c2_json_render(spark: SparkSession, d: str) -> DataFrame:
    ratio = F.lit(float("nan"))
    row = F.struct("n_nationkey", "n_name", F.when(~F.isnan(ratio), ratio).alias("ratio"))
    return table(spark, d, "nation").select("n_nationkey", F.to_json(row, {"ignoreNullFields": "false"}).alias("json"))
