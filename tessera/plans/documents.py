"""Queries on structured and nested columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import relational as R
from tessera.plans.catalogue import query, table


def _orders(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))).alias("lines"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus").join(lines, "l_orderkey", "left")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem")
def p11_deny_list(spark: SparkSession, d: str) -> DataFrame:
    slim = _orders(spark, d).withColumn("lines", F.transform("lines", lambda x: x.dropFields("l_returnflag")))
    return slim.select("l_orderkey", F.inline("lines")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT o_orderkey, CASE WHEN n > 0 THEN n END AS returned FROM (SELECT o_orderkey, count(l_orderkey) FILTER (WHERE l_returnflag = 'R') AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)")
def p12_drop_empty(spark: SparkSession, d: str) -> DataFrame:
    kept = _orders(spark, d).withColumn("lines", F.filter(F.coalesce("lines", F.array()), lambda x: x["l_returnflag"] == "R"))
    return R.drop_empty(kept, ["lines"]).select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("lines").isNotNull(), F.size("lines")).cast("long").alias("returned"))


@query("SELECT s_suppkey, upper(s_name) AS s_name FROM supplier")
def p10_stripped_names(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias(" s_suppkey "), F.upper("s_name").alias("s_name  "))
    return R.stripped(rows)


@query("SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 3")
def w1_longest_texts(spark: SparkSession, d: str) -> DataFrame:
    return R.top_per_key(table(spark, d, "documents"), ["lang"], [F.desc("n_chars"), F.col("doc_id")], 3).select("doc_id", "lang", "rank")
