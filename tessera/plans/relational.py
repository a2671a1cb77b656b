"""Queries for filters, joins, aggregations, ranking and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import relational as R
from tessera.plans.catalogue import query, table

MONEY = "decimal(18,2)"


def money(column: str):
    return F.sum(F.col(column).cast(MONEY)).cast("double")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, o_orderdate, o_totalprice FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey")
def j1_left_join_single(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", "o_totalprice")
    return table(spark, d, "lineitem").join(orders, "l_orderkey", "left").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "o_orderdate", "o_totalprice")


@query("""
WITH oc AS (SELECT o_orderkey, o_orderdate, c_mktsegment, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING'),
ps AS (SELECT p_partkey, p_brand FROM part WHERE p_size <= 25)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, o_orderdate, c_mktsegment, p_brand, n_name AS supplier_nation
FROM lineitem LEFT JOIN oc ON l_orderkey = o_orderkey LEFT JOIN ps ON l_partkey = p_partkey
LEFT JOIN (SELECT s_suppkey, n_name, n_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey) ON l_suppkey = s_suppkey AND c_nationkey = n_nationkey""")
def j2_left_join_composite(spark: SparkSession, d: str) -> DataFrame:
    customer = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select("c_custkey", "c_mktsegment", "c_nationkey")
    orders = table(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", "c_mktsegment", "c_nationkey")
    part = table(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    nation = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("supplier_nation"))
    supplier = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_nationkey").alias("c_nationkey"), "supplier_nation")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return rows.join(orders, "l_orderkey", "left").join(part, "l_partkey", "left").join(supplier, ["l_suppkey", "c_nationkey"], "left").drop("c_nationkey")


@query("SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j3_inner_lookup(spark: SparkSession, d: str) -> DataFrame:
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    return table(spark, d, "customer").join(places, "c_nationkey").select("c_custkey", "c_name", "n_name", "r_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def j4_semi(spark: SparkSession, d: str) -> DataFrame:
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(urgent, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def j5_anti(spark: SparkSession, d: str) -> DataFrame:
    partial = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(partial, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT event_type, r_name AS region, count(*) AS n FROM events JOIN (SELECT * FROM (VALUES ('click', 0), ('view', 1), ('purchase', 2)) v(t, k)) ON event_type = t JOIN region ON k = r_regionkey GROUP BY 1, 2")
def j6_metadata_lookup(spark: SparkSession, d: str) -> DataFrame:
    meta = spark.createDataFrame([("click", 0), ("view", 1), ("purchase", 2)], "event_type string, r_regionkey int")
    return table(spark, d, "events").join(meta, "event_type").join(table(spark, d, "region"), "r_regionkey").groupBy("event_type", F.col("r_name").alias("region")).agg(F.count("*").alias("n"))


@query("""
WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 7 + 3) % 25 AS dst FROM nation),
r AS (SELECT n_nationkey AS origin, n_nationkey AS node, 0 AS depth, [n_nationkey] AS path FROM nation WHERE n_regionkey = 1
  UNION ALL SELECT origin, dst, depth + 1, list_append(path, dst) FROM r JOIN e ON node = src WHERE NOT list_contains(path, dst))
SELECT origin, node, min(depth) AS depth FROM r GROUP BY 1, 2""")
def j7_reference_closure(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    edges = nation.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("dst"))
    return R.closure(edges, nation.where("n_regionkey = 1").select("n_nationkey"))


@query("SELECT CASE l_returnflag WHEN 'R' THEN 'returned' WHEN 'A' THEN 'accepted' ELSE coalesce(l_returnflag, 'Other') END AS label, count(*) AS n FROM lineitem GROUP BY 1")
def j8_code_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(R.code_lookup("l_returnflag", {"R": "returned", "A": "accepted"}).alias("label")).agg(F.count("*").alias("n"))


@query("SELECT user_id, max(value) AS best FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def j9_pick_kind(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.max("value").alias("best"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '5-LOW' AND o_totalprice > 1000")
def flt1_conjunction(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderstatus = 'O' AND o_orderpriority <> '5-LOW' AND o_totalprice > 1000").select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_type, '(ARD|OMO)$') AND contains(p_name, 'g')")
def flt2_contains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(F.col("p_type").rlike("(ARD|OMO)$") & F.col("p_name").contains("g")).select("p_partkey", "p_name")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE upper(c_mktsegment) IN ('BUILDING', 'MACHINERY')")
def flt3_upper_in(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where(F.upper("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_mktsegment")


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'gear') OR contains(p_name, 'ring') OR contains(p_name, '5')")
def flt4_or_fold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(R.any_contains("p_name", ["gear", "ring", "5"])).select("p_partkey", "p_name")


@query("""
WITH x AS (SELECT * FROM customer WHERE c_mktsegment = 'BUILD')
SELECT c_custkey, c_mktsegment FROM x UNION ALL
SELECT c_custkey, c_mktsegment FROM customer WHERE contains(c_mktsegment, 'BUILD') AND NOT EXISTS (SELECT 1 FROM x)""")
def flt5_fallback(spark: SparkSession, d: str) -> DataFrame:
    return R.with_fallback(table(spark, d, "customer"), F.col("c_mktsegment") == "BUILD", F.col("c_mktsegment").contains("BUILD")).select("c_custkey", "c_mktsegment")


@query("SELECT count(*) FILTER (WHERE t IS NULL OR t = '') AS blanks, count(*) AS n FROM (SELECT CASE WHEN length(text) < 20 THEN '' WHEN length(text) > 5000 THEN NULL ELSE text END AS t FROM documents)")
def flt6_blank(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.length("text") < 20, "").when(F.length("text") > 5000, F.lit(None)).otherwise(F.col("text"))
    return table(spark, d, "documents").select(t.alias("t")).agg(F.count_if(R.blank("t")).alias("blanks"), F.count("*").alias("n"))


@query("SELECT s_suppkey, n FROM (SELECT s_suppkey, nullif(s_nationkey, 3) AS n, CASE WHEN s_acctbal < 0 THEN NULL ELSE s_acctbal END AS b FROM supplier) WHERE n IS NOT NULL AND b IS NOT NULL")
def flt7_drop_nulls(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select("s_suppkey", F.nullif(F.col("s_nationkey"), F.lit(3)).alias("n"), F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("b"))
    return R.not_null(rows, ["n", "b"]).select("s_suppkey", "n")


@query("SELECT n_name, string_agg(CASE WHEN s_acctbal > 5000 THEN CAST(s_suppkey AS VARCHAR) END, ',' ORDER BY s_suppkey) AS rich FROM nation JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_name")
def flt8_open_group(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").join(table(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"))
    item = F.when(F.col("s_acctbal") > 5000, F.col("s_suppkey").cast("string"))
    nested = R.nest(rows, ["n_name"], ["s_suppkey"], item, "items")
    return nested.select("n_name", F.when(F.size("items") > 0, F.array_join("items", ",")).alias("rich"))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1")
def flt9_status(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type <> 'error'").groupBy("event_type").agg(F.count("*").alias("n"))


@query("""
WITH c AS (SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = 5)
SELECT event_type, CAST(count(DISTINCT user_id) AS BIGINT) AS users, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events WHERE user_id IN (SELECT user_id FROM c) GROUP BY 1""")
def flt10_complete_case(spark: SparkSession, d: str) -> DataFrame:
    return R.complete_cases(table(spark, d, "events"), ["user_id"], "event_type", 5).groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), money("value").alias("total"))


@query("SELECT page_id, starts_with(url, 'https://') AS secure FROM pages WHERE starts_with(url, 'http')")
def flt11_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").where(F.col("url").startswith("http")).select("page_id", F.col("url").startswith("https://").alias("secure"))


@query("SELECT count(*) FILTER (WHERE TRY_CAST(regexp_extract(p_name, '[0-9]+') AS INTEGER) > 100) AS n FROM part")
def flt12_type_guard(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").agg(F.count_if(F.regexp_extract("p_name", "[0-9]+", 0).try_cast("int") > 100).alias("n"))


@query("SELECT o_orderkey FROM orders WHERE lower(trim(o_orderpriority)) IN ('1-urgent', '2-high') AND o_custkey IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)")
def flt13_lists(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(F.lower(F.trim("o_orderpriority")).isin("1-urgent", "2-high") & F.col("o_custkey").isin(1, 2, 3, 5, 8, 13, 21, 34, 55, 89)).select("o_orderkey")


@query("SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY 1 ORDER BY top DESC, o_custkey LIMIT 10")
def a1_group_max_topn(spark: SparkSession, d: str) -> DataFrame:
    best = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"))
    return R.top_k(best, [F.desc("top"), F.col("o_custkey")], 10)


@query("SELECT coalesce(nullif(lang, 'es'), 'Unknown') AS lang, count(*) AS n FROM documents GROUP BY 1")
def a2_histogram(spark: SparkSession, d: str) -> DataFrame:
    return R.histogram(table(spark, d, "documents"), F.nullif(F.col("lang"), F.lit("es")), "lang")


@query(r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[a-z]+')) AS word FROM documents) GROUP BY 1 ORDER BY n DESC, word LIMIT 50")
def a3_nested_hist(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), 0)).alias("word"))
    return R.top_k(R.histogram(words, F.col("word"), "word"), [F.desc("n"), F.col("word")], 50)


@query("SELECT coalesce(nullif(o_orderpriority, '1-URGENT'), nullif(o_orderstatus, 'O'), 'UNSCORED') AS severity, count(*) AS n FROM orders GROUP BY 1")
def a4_first_available(spark: SparkSession, d: str) -> DataFrame:
    first = F.coalesce(F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT")), F.nullif(F.col("o_orderstatus"), F.lit("O")), F.lit("UNSCORED"))
    return table(spark, d, "orders").groupBy(first.alias("severity")).agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, CAST(coalesce(min(CASE WHEN year(o_orderdate) > 1995 THEN year(o_orderdate) END), 9999) AS INTEGER) AS first_year, CAST(coalesce(max(CASE WHEN year(o_orderdate) > 1995 THEN year(o_orderdate) END), 0) AS INTEGER) AS last_year FROM orders GROUP BY 1")
def a5_guarded_minmax(spark: SparkSession, d: str) -> DataFrame:
    y = F.year("o_orderdate")
    low, high = R.guarded_range(y, y > 1995, 9999, 0)
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(low.alias("first_year"), high.alias("last_year"))


@query("SELECT l_returnflag, CAST(coalesce(sum(CASE WHEN l_discount > 0.05 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS total FROM lineitem GROUP BY 1")
def a6_guarded_sum(spark: SparkSession, d: str) -> DataFrame:
    kept = F.when(F.col("l_discount") > 0.05, F.col("l_extendedprice").cast(MONEY))
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.coalesce(F.sum(kept).cast("double"), F.lit(0.0)).alias("total"))


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def a7_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"))


@query("SELECT l_linestatus, round(CAST(count(*) AS DOUBLE) / count(DISTINCT l_orderkey), 1) AS lines_per_order FROM lineitem GROUP BY 1")
def a8_rounded_ratio(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(R.ratio(F.count("*").cast("double"), F.count_distinct("l_orderkey").cast("double"), 1).alias("lines_per_order"))


@query("SELECT event_type, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean, count(*) FILTER (WHERE value > 50) AS wins FROM events GROUP BY 1")
def a9_mean_and_wins(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg((money("value") / F.count("*")).alias("mean"), F.count_if(F.col("value") > 50).alias("wins"))


@query("""
SELECT event_type, CAST(dayofweek(ts) AS INTEGER) AS day, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n
FROM events GROUP BY GROUPING SETS ((event_type, dayofweek(ts)), (event_type), (dayofweek(ts)))""")
def a11_breakdown(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("day", F.dayofweek("ts") - 1)
    return rows.groupingSets([["event_type", "day"], ["event_type"], ["day"]], "event_type", "day").agg(money("value").alias("total"), F.count("*").alias("n")).select("event_type", "day", "total", "n")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1, 2")
def a14_domain_sums(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), money("o_totalprice").alias("total"))


@query("SELECT l_returnflag, median(l_extendedprice) AS mid FROM lineitem GROUP BY 1")
def a15_median(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.median("l_extendedprice").alias("mid"))


@query("""
WITH s AS (SELECT p_brand, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS gross, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS net FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
p AS (SELECT p_brand, round(CASE WHEN gross = 0 THEN 0 ELSE (net - gross) / gross * 100 END, 6) AS pct FROM s)
SELECT p_brand, pct, CASE WHEN abs(pct) <= 4.9 THEN 'PASS' WHEN abs(pct) <= 5 THEN 'MARGINAL' ELSE 'FAIL' END AS verdict FROM p""")
def a16_pct_diff(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    net = F.sum(F.col("l_extendedprice").cast(MONEY) * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("double")
    sums = rows.groupBy("p_brand").agg(money("l_extendedprice").alias("gross"), net.alias("net"))
    pct = R.ratio(F.col("net") - F.col("gross"), F.col("gross")) * 100
    return sums.select("p_brand", F.round(pct, 6).alias("pct")).withColumn("verdict", R.verdict(F.col("pct"), 4.9, 5.0))


@query("SELECT event_id, user_id, value - min(value) OVER (PARTITION BY user_id) AS over_least FROM events")
def a17_min_overhead(spark: SparkSession, d: str) -> DataFrame:
    return R.minus_least(table(spark, d, "events"), ["user_id"], "value", "over_least").select("event_id", "user_id", "over_least")


@query("SELECT o_orderkey, string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, ';' ORDER BY l_linenumber, l_partkey, l_suppkey) AS items FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def a20_nest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")).join(table(spark, d, "lineitem"), "l_orderkey")
    item = F.concat_ws(":", "l_linenumber", "l_partkey", "l_suppkey")
    return R.nest(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], item, "items").select(F.col("l_orderkey").alias("o_orderkey"), F.array_join("items", ";").alias("items"))


@query("SELECT conv_id, count(*) AS turns, CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS pieces FROM conversations GROUP BY 1")
def a21_nested_lengths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.size(F.split("text", " "))).alias("pieces"))


@query("""
WITH t AS (SELECT user_id, event_type, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2),
b AS (SELECT user_id, total AS base FROM t WHERE event_type = 'view')
SELECT t.user_id, event_type, total, round(CASE WHEN coalesce(base, 0) = 0 THEN 0 ELSE (total - base) / base * 100 END, 6) AS pct FROM t LEFT JOIN b ON t.user_id = b.user_id WHERE event_type <> 'view'""")
def a23_pct_vs_baseline(spark: SparkSession, d: str) -> DataFrame:
    totals = table(spark, d, "events").groupBy("user_id", "event_type").agg(money("value").alias("total"))
    return R.against_baseline(totals, "user_id", "event_type", "total", "view").withColumn("pct", F.round("pct", 6))


@query("""
WITH t AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, CASE event_type WHEN 'view' THEN 0 ELSE 1 END, event_type) AS k FROM t)
SELECT user_id, event_type AS best, n FROM r WHERE k = 1""")
def a24_best_vs_baseline(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return R.best_or_baseline(counts, "user_id", "event_type", "n", "view")


@query("""
WITH t AS (SELECT o_orderpriority AS domain, o_orderstatus AS fmt, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS s FROM orders GROUP BY 1, 2),
w AS (SELECT domain, coalesce(max(CASE WHEN fmt = 'F' THEN s END), 1) AS f, coalesce(max(CASE WHEN fmt = 'O' THEN s END), 1) AS o FROM t GROUP BY 1)
SELECT domain, round((1 - f / o) * 100, 6) AS savings FROM w""")
def a25_savings(spark: SparkSession, d: str) -> DataFrame:
    sums = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("domain")).pivot("o_orderstatus", ["F", "O"]).agg(money("o_totalprice"))
    return sums.select("domain", F.round((1 - F.coalesce("F", F.lit(1.0)) / F.coalesce("O", F.lit(1.0))) * 100, 6).alias("savings"))


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def w1_distinct_on(spark: SparkSession, d: str) -> DataFrame:
    return R.first_per_key(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate")


MEANS = "SELECT user_id, event_type, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS score FROM events %s GROUP BY 1, 2"
RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_type) AS k, lead(score) OVER (PARTITION BY user_id ORDER BY score DESC, event_type) AS second FROM m)"


@query(f"WITH m AS ({MEANS % ''}), {RANKED} SELECT user_id, event_type AS winner, round(score, 6) AS score, round(score - second, 6) AS margin FROM r WHERE k = 1")
def w2_winner_margin(spark: SparkSession, d: str) -> DataFrame:
    means = table(spark, d, "events").groupBy("user_id", "event_type").agg((money("value") / F.count("*")).alias("score"))
    return R.winner_and_margin(means, "user_id", "event_type", "score").withColumns({c: F.round(c, 6) for c in ("score", "margin")})


@query("SELECT user_id, event_id AS first_event FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def w3_first_row(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"))


FEW = "WHERE event_type IN ('error', 'signup')"


@query(f"WITH m AS ({MEANS % ''}), {RANKED} SELECT user_id, event_type AS winner, round(score, 6) AS score, round(coalesce(score - second, 0.0), 6) AS margin FROM r WHERE k = 1")
def w4_leader_margin(spark: SparkSession, d: str) -> DataFrame:
    means = table(spark, d, "events").groupBy("user_id", "event_type").agg((money("value") / F.count("*")).alias("score"))
    return R.winner_and_margin(means, "user_id", "event_type", "score", single=0.0).withColumns({c: F.round(c, 6) for c in ("score", "margin")})


@query("""
WITH p AS (SELECT p_brand, p_partkey, p_retailprice, CASE WHEN p_size < 5 THEN 1 WHEN p_size < 20 THEN 2 ELSE 3 END AS priority FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY priority, p_retailprice DESC, p_partkey) AS k FROM p)
SELECT p_brand, p_partkey, priority FROM r WHERE k = 1 ORDER BY priority, p_retailprice DESC, p_partkey LIMIT 5""")
def w5_priority_fill(spark: SparkSession, d: str) -> DataFrame:
    priority = F.when(F.col("p_size") < 5, 1).when(F.col("p_size") < 20, 2).otherwise(3)
    return R.priority_fill(table(spark, d, "part"), "p_brand", priority, [F.desc("p_retailprice"), F.col("p_partkey")], 5).select("p_brand", "p_partkey", "priority")


@query("SELECT DISTINCT event_id, min(value) OVER (PARTITION BY event_type) AS least FROM events")
def w6_min_over(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.min("value").over(Window.partitionBy("event_type")).alias("least"))


@query("SELECT row_number() OVER (ORDER BY x NULLS FIRST, c_custkey) AS place, c_custkey FROM (SELECT c_custkey, nullif(c_nationkey, 7) AS x FROM customer)")
def o1_nulls_first(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", F.nullif(F.col("c_nationkey"), F.lit(7)).alias("x"))
    return R.placed(rows, [F.asc_nulls_first("x"), F.col("c_custkey")], "place").select("place", "c_custkey").orderBy("place")


@query("SELECT c_mktsegment, CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 0 END AS place, count(*) AS n FROM customer GROUP BY 1, 2")
def o2_custom_order(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy("c_mktsegment", R.in_list_order("c_mktsegment", ["MACHINERY", "BUILDING"]).alias("place")).agg(F.count("*").alias("n")).orderBy("place", "c_mktsegment")


@query("SELECT s_suppkey, coalesce(x, '') AS x FROM (SELECT s_suppkey, nullif(s_name, 'Supplier#000000003') AS x FROM supplier) ORDER BY 2, 1")
def o3_sort_default(spark: SparkSession, d: str) -> DataFrame:
    x = F.coalesce(F.nullif(F.col("s_name"), F.lit("Supplier#000000003")), F.lit(""))
    return table(spark, d, "supplier").select("s_suppkey", x.alias("x")).orderBy("x", "s_suppkey")


@query("SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, min(p_partkey) LIMIT 10")
def o4_top_k_first_seen(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))
    return R.top_k(counts, [F.desc("n"), F.col("first")], 10).drop("first")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25")
def o5_head(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey").limit(25)


@query("SELECT DISTINCT p_brand, p_size FROM part")
def o6_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_brand", "p_size").distinct().orderBy("p_brand", "p_size")


@query("SELECT c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier")
def o7_union(spark: SparkSession, d: str) -> DataFrame:
    suppliers = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    return table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")).unionByName(suppliers)


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def o8_last_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return R.last_wins(rows, ["user_id", "event_type"], F.struct("ts", "event_id")).drop("ts")


@query("SELECT l_linestatus, max(CASE WHEN l_returnflag = 'A' THEN n END) AS A, max(CASE WHEN l_returnflag = 'R' THEN n END) AS R FROM (SELECT l_linestatus, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) WHERE l_returnflag IN ('A', 'R') GROUP BY 1")
def o9_pivot(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "lineitem").groupBy("l_linestatus", "l_returnflag").agg(F.count("*").alias("n"))
    return R.strict_pivot(counts, ["l_linestatus"], "l_returnflag", ["A", "R"], "n")


@query("SELECT conv_id, turn, unnest(string_split(text, '. ')) AS sentence FROM conversations")
def o10_explode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.split("text", "\\. ")).alias("sentence"))


@query("""
SELECT a.event_id, count(*) AS recent, CAST(sum(CAST(b.value AS DECIMAL(18, 2))) AS DOUBLE) AS total
FROM events a JOIN events b ON b.user_id = a.user_id AND b.ts >= a.ts - INTERVAL 60 SECOND AND b.ts <= a.ts GROUP BY a.event_id""")
def st1_sliding_60s(spark: SparkSession, d: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    by = Window.partitionBy("user_id").orderBy(at).rangeBetween(-60_000_000, 0)
    total = F.sum(F.col("value").cast("decimal(18,2)")).over(by).cast("double")
    return table(spark, d, "events").select("event_id", F.count("*").over(by).alias("recent"), total.alias("total"))
