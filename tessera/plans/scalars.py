"""Queries for scalar functions: strings, numbers, timestamps, paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import numeric as N
from tessera.functions import paths as P
from tessera.functions import temporal as T
from tessera.functions import text as X
from tessera.plans.catalogue import query, table


@query("SELECT p_partkey, NOT regexp_full_match(p_name, '[A-Za-z_][A-Za-z0-9_.\\-]*') OR p_name IN ('true', 'null') AS quoted, NOT regexp_full_match(p_brand, '[A-Za-z_][A-Za-z0-9_.\\-]*') AS brand FROM part")
def f1_needs_quoting(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", X.needs_quoting(F.col("p_name")).alias("quoted"), X.needs_quoting(F.col("p_brand")).alias("brand"))


@query(r"""SELECT conv_id, turn, replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n') AS escaped FROM conversations""")
def f2_escape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", X.escape(F.col("text")).alias("escaped"))


@query("""
SELECT DISTINCT w, CASE WHEN w LIKE '%ies' AND length(w) > 3 THEN left(w, -3) || 'y' WHEN regexp_matches(w, '(ss|x|ch|sh)es$') THEN left(w, -2)
  WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND length(w) > 1 THEN left(w, -1) ELSE w END AS singular
FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark)""")
def f5_singularize(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("w")).distinct()
    return words.select("w", X.singularize(F.col("w")).alias("singular"))


@query("SELECT s_suppkey, lower(left(s_name, 1) || regexp_replace(substr(s_name, 2), '([A-Z])', '_\\1', 'g')) AS snake FROM supplier")
def f6_snake(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", X.snake_case(F.col("s_name")).alias("snake"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS plain FROM pages")
def f8_strip_html(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.strip_html(F.col("html")).alias("plain"))


@query("SELECT o_orderkey, upper(trim(substr(o_orderpriority, 3))) AS label, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS level FROM orders")
def f9_slice_cast(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", F.upper(F.trim(F.substr(p, F.lit(3)))).alias("label"), F.substring(p, 1, 1).cast("int").alias("level"))


@query("SELECT doc_id, CASE WHEN length(text) <= 10 THEN '' WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS short FROM documents")
def f10_truncate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.truncate(F.col("text")).alias("short"))


@query("SELECT c_custkey, coalesce(nullif(CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END, ''), nullif(c_name, ''), '') AS label FROM customer")
def f11_fallback(spark: SparkSession, d: str) -> DataFrame:
    segment = F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", X.first_filled(segment, F.col("c_name")).alias("label"))


@query("SELECT page_id, CASE WHEN len(string_split(url, '/')) >= 5 THEN string_split(url, '/')[4] END AS part FROM pages")
def f12_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.part_of(F.col("url"), "/", 3, 5).alias("part"))


@query("SELECT CASE split_part(o_orderpriority, '-', 1) WHEN '1' THEN 'now' WHEN '2' THEN 'soon' ELSE 'Other' END AS domain, count(*) AS n FROM orders GROUP BY 1")
def f13_prefix_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(X.prefix_label(F.col("o_orderpriority"), "-", {"1": "now", "2": "soon"}).alias("domain")).agg(F.count("*").alias("n"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')) AS words, len(string_split(text, chr(10) || chr(10))) AS paragraphs, len(regexp_extract_all(text, '[0-9]+\.?[0-9]*')) AS numbers FROM documents")
def f14_f15_counts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", X.word_count(t).alias("words"), X.paragraph_count(t).alias("paragraphs"), X.number_count(t).alias("numbers"))


@query("SELECT page_id, substr(html, instr(html, '<article>') + 9) AS body FROM pages WHERE contains(html, '<article>')")
def f23_after_marker(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").where(F.col("html").contains("<article>")).select("page_id", X.after_marker(F.col("html"), "<article>").alias("body"))


@query("""
WITH p AS (SELECT a.p_partkey, a.p_type AS x, b.p_type AS y, least(length(a.p_type), length(b.p_type)) AS n FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
q AS (SELECT *, coalesce(list_min(list_filter(range(1, n + 1), lambda i: x[i] <> y[i])) - 1, n) AS prefix, coalesce(list_min(list_filter(range(1, n + 1), lambda i: reverse(x)[i] <> reverse(y)[i])) - 1, n) AS s FROM p)
SELECT p_partkey, CAST(prefix AS INTEGER) AS prefix, CAST(least(s, n - prefix) AS INTEGER) AS suffix FROM q""")
def f24_affixes(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    pairs = part.select("p_partkey", F.col("p_type").alias("x")).join(part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_type").alias("y")), "p_partkey")
    prefix, suffix = X.common_affixes(F.col("x"), F.col("y"))
    return pairs.select("p_partkey", prefix.alias("prefix"), suffix.alias("suffix"))


@query("SELECT o_orderkey, CASE WHEN k BETWEEN -128 AND 127 THEN 'int8' WHEN k BETWEEN -32768 AND 32767 THEN 'int16' WHEN k BETWEEN -2147483648 AND 2147483647 THEN 'int32' ELSE 'int64' END AS width FROM (SELECT o_orderkey, o_orderkey * o_custkey - 5000 AS k FROM orders)")
def n2_int_width(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", N.integer_width(F.col("o_orderkey") * F.col("o_custkey") - 5000).alias("width"))


@query("SELECT s, CASE WHEN regexp_full_match(s, '[+-]?[0-9]+') THEN CASE WHEN TRY_CAST(s AS BIGINT) IS NOT NULL THEN 'int' WHEN TRY_CAST(s AS UBIGINT) IS NOT NULL THEN 'uint' ELSE 'big' END WHEN TRY_CAST(s AS DOUBLE) IS NOT NULL THEN 'float' END AS kind FROM (SELECT CASE o_orderkey % 5 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN o_orderkey || '.5' WHEN 2 THEN '1844674407370955' || (1000 + o_orderkey % 900) WHEN 3 THEN '99999999999999999' || o_orderkey || '000' ELSE o_orderpriority END AS s FROM orders)")
def n1_number_kind(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = k.cast("string")
    s = F.when(k % 5 == 0, text).when(k % 5 == 1, F.concat(text, F.lit(".5"))).when(k % 5 == 2, F.concat(F.lit("1844674407370955"), (1000 + k % 900).cast("string"))).when(k % 5 == 3, F.concat(F.lit("99999999999999999"), text, F.lit("000"))).otherwise(F.col("o_orderpriority"))
    return table(spark, d, "orders").select(s.alias("s")).select("s", N.number_kind(F.col("s")).alias("kind"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN trunc(l_extendedprice * 100000) BETWEEN -2147483648 AND 2147483647 THEN CAST(trunc(l_extendedprice * 100000) AS BIGINT) ELSE 0 END AS c FROM lineitem")
def n4_coerce(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", N.coerce_int(F.col("l_extendedprice") * 100000).alias("c"))


@query("SELECT event_id, CASE WHEN v = floor(v) AND abs(v) < 1e15 THEN CAST(v AS BIGINT) END AS whole, CASE WHEN v <> floor(v) OR abs(v) >= 1e15 THEN v END AS number FROM (SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(CASE WHEN event_id % 3 = 1 THEN round(value) ELSE value END AS VARCHAR) END AS DOUBLE) AS v FROM events)")
def n5_coerce_numeric(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 3
    s = F.when(k == 0, F.col("event_type")).when(k == 1, F.round("value").cast("string")).otherwise(F.col("value").cast("string"))
    whole, number = N.coerce_numeric(s)
    return table(spark, d, "events").select("event_id", whole.alias("whole"), number.alias("number"))


@query("SELECT event_id, TRY_CAST(CASE WHEN event_id % 2 = 0 THEN event_type ELSE CAST(event_id AS VARCHAR) END AS BIGINT) AS n FROM events")
def n6_try_cast(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(F.col("event_id").cast("string"))
    return table(spark, d, "events").select("event_id", s.try_cast("long").alias("n"))


@query("SELECT s_suppkey, lower(hex(s_name)) AS h, s_name AS back FROM supplier")
def n9_hex(spark: SparkSession, d: str) -> DataFrame:
    h = N.hexed(F.col("s_name"))
    return table(spark, d, "supplier").select("s_suppkey", h.alias("h"), N.unhexed(h).cast("string").alias("back"))


@query("""
SELECT event_id, s, epoch_us(ts) // 1000000 * 1000 - CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 330 * 60000 ELSE -480 * 60000 END AS ms, CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 330 ELSE -480 END AS zone
FROM (SELECT event_id, ts, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE event_id % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '+05:30' ELSE '-0800' END AS s FROM events)""")
def t1_parse_iso(spark: SparkSession, d: str) -> DataFrame:
    zone = F.when(F.col("event_id") % 3 == 0, "Z").when(F.col("event_id") % 3 == 1, "+05:30").otherwise("-0800")
    rows = table(spark, d, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone).alias("s"))
    ms, offset = T.parse_iso(F.col("s"))
    return rows.select("event_id", "s", ms.alias("ms"), offset.alias("zone"))


@query("SELECT o_orderkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS days FROM orders")
def t2_days(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", T.days_from_civil(F.year(o).cast("long"), F.month(o).cast("long"), F.dayofmonth(o).cast("long")).alias("days"))


@query("SELECT event_id, strftime(ts + INTERVAL 90 MINUTE, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) // 1000 % 1000 > 0 THEN strftime(ts, '.%g') ELSE '' END || '+01:30' AS s FROM events")
def t3_format(spark: SparkSession, d: str) -> DataFrame:
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    return table(spark, d, "events").select("event_id", T.format_millis(ms, F.lit(90)).alias("s"))


@query("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, monthname(o_orderdate) AS name FROM orders")
def t4_t6_calendar(spark: SparkSession, d: str) -> DataFrame:
    y, m, day = T.civil_from_days(F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("long"))
    return table(spark, d, "orders").select("o_orderkey", y.alias("y"), m.alias("m"), day.alias("d"), T.month_name(m).alias("name"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS none FROM events")
def p4_path(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", P.in_json("props", "k", "long").alias("k"), P.in_json("props", "none").alias("none"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def p5_variant_path(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", P.at_path(F.try_parse_json("props"), "k", "long").alias("k"))


@query("SELECT o_orderkey, o_orderstatus AS a, o_custkey AS b FROM orders")
def p2_p3_struct_path(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.struct(F.array(F.struct(F.col("o_orderstatus").alias("s"), F.col("o_custkey").alias("k"))).alias("list")).alias("doc"))
    schema = rows.schema["doc"].dataType
    return rows.select("o_orderkey", P.at_path(F.col("doc"), "list[0].s", "string", schema).alias("a"), P.at_path(F.col("doc"), "list[0].k", "long", schema).alias("b"))
