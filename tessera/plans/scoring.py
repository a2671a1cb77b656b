"""Queries for text scores and the comparisons made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scoring as S
from tessera.operators import relational as R
from tessera.plans.catalogue import query, table

ELEMENTS = (S.Element("place", "the region where things are", r"\bthe\b"), S.Element("sum", "total amount that was found"), S.Element("broken", "being with others", "(open"))
RUBRIC = (
    S.Criterion("words", 0.5, "keywords", {"keywords": ["the", "que", "der"], "threshold": 0.5}),
    S.Criterion("figures", 0.3, "numbers", {"least": 3}),
    S.Criterion("shape", 0.4, "structure"),
    S.Criterion("advice", 0.2, "recommendations"),
    S.Criterion("token", 0.1, "pattern", {"regex": "token"}),
    S.Criterion("length", 0.2, "custom", {"name": "length_check"}),
    S.Criterion("unknown", 0.1, "custom", {"name": "nothing"}),
)


def _contained(words, low="lower(text)"):
    return " + ".join(f"CAST(contains({low}, '{w}') AS INTEGER)" for w in words)


WORDS = r"len(regexp_extract_all(text, '[^ \t\n\r\f\v]+'))"
NUMBERS = r"len(regexp_extract_all(text, '[0-9]+\.?[0-9]*'))"
PARAGRAPHS = "len(string_split(text, chr(10) || chr(10)))"
COHERENCE = f"least(0.5::DOUBLE + ({_contained(S.MARKERS, 'text')}) / 7.0::DOUBLE * 0.2::DOUBLE + CASE WHEN {PARAGRAPHS} >= 3 THEN 0.15 ELSE 0 END::DOUBLE + CASE WHEN {WORDS} BETWEEN 100 AND 2000 THEN 0.15 ELSE 0 END::DOUBLE, 1)"
ACTION = f"least(({_contained(S.ADVICE)}) / 3.0::DOUBLE, 1)"
THREE = [w for e in ELEMENTS for w in e.keywords()]
COMPLETE = f"(CAST(regexp_matches(text, '\\bthe\\b') AS INTEGER) + CAST(({_contained(ELEMENTS[1].keywords(5))}) > 0 AS INTEGER) + CAST(({_contained(ELEMENTS[2].keywords(5))}) > 0 AS INTEGER)) / 3.0::DOUBLE"
RELEVANT = f"({_contained(THREE)}) / {len(THREE)}.0::DOUBLE"
FACTS = "CAST(regexp_matches(text, '\\bthe\\b') AS INTEGER) / 2.0::DOUBLE"


@query(f"SELECT conv_id, turn, {ACTION} AS actionability, least(({_contained(S.MORE_ADVICE)}) / 4.0::DOUBLE, 1) AS recommendations, least(({_contained(S.MORE_MARKERS, 'text')}) / 5.0::DOUBLE, 1) AS structure FROM conversations")
def f20_actionability(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", S.actionability(t).alias("actionability"), S.recommendations(t).alias("recommendations"), S.structure(t).alias("structure"))


@query(f"SELECT doc_id, round({COHERENCE}, 9) AS coherence FROM documents")
def f21_coherence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.round(S.coherence(F.col("text")), 9).alias("coherence"))


@query(f"SELECT doc_id, CASE WHEN r >= 0.5 THEN 1 ELSE r / 0.5 END AS share FROM (SELECT doc_id, ({_contained(['the', 'que', 'der', 'and'])}) / 4.0::DOUBLE AS r FROM documents)")
def f16_keywords(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", S.keyword_share(F.col("text"), ["the", "que", "der", "and"], 0.5).alias("share"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9]{4}') THEN 1.0::DOUBLE ELSE 0 END AS four, 0.0::DOUBLE AS broken FROM documents")
def f17_pattern(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", S.pattern(t, "[0-9]{4}").alias("four"), S.pattern(t, "(open").alias("broken"))


@query(f"""
SELECT doc_id, CASE WHEN regexp_matches(text, '\\bthe\\b') THEN 0.95::DOUBLE ELSE 0 END AS one, CASE WHEN ({_contained(ELEMENTS[1].keywords(5))}) > 0 THEN 0.8::DOUBLE ELSE 0 END AS two,
  CASE WHEN ({_contained(ELEMENTS[2].keywords(5))}) > 0 THEN 0.7::DOUBLE ELSE 0 END AS three FROM documents""")
def f18_f22_elements(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", *(S.element_quality(t, e).alias(n) for e, n in zip(ELEMENTS, ("one", "two", "three"))))


@query(f"""
WITH m AS (SELECT doc_id, {COMPLETE} AS completeness, {RELEVANT} AS relevance, {COHERENCE} AS coherence, {FACTS} AS factual_accuracy, {ACTION} AS actionability FROM documents)
SELECT doc_id, round(completeness, 9) AS completeness, round(relevance, 9) AS relevance, factual_accuracy, round((completeness * 0.25 + relevance * 0.25 + coherence * 0.2 + factual_accuracy * 0.2 + actionability * 0.1) / 1.0, 9) AS score FROM m""")
def a19_composite(spark: SparkSession, d: str) -> DataFrame:
    m = S.metrics(F.col("text"), ELEMENTS, "recommendation")
    rows = table(spark, d, "documents").select("doc_id", *(v.alias(k) for k, v in m.items()))
    return rows.select("doc_id", *(F.round(k, 9).alias(k) for k in ("completeness", "relevance")), "factual_accuracy", F.round(S.weighted({k: F.col(k) for k in m}), 9).alias("score"))


@query(f"""
WITH c AS (SELECT doc_id, ({_contained(['the', 'que', 'der'])}) / 3.0::DOUBLE AS k, least({NUMBERS} / 3.0::DOUBLE, 1) AS n, least(({_contained(S.MORE_MARKERS, 'text')}) / 5.0::DOUBLE, 1) AS s,
  least(({_contained(S.MORE_ADVICE)}) / 4.0::DOUBLE, 1) AS a, CAST(contains(text, 'token') AS INTEGER) AS t, CASE WHEN {WORDS} BETWEEN 100 AND 2000 THEN 1.0 ELSE 0.5 END::DOUBLE AS l FROM documents)
SELECT doc_id, round((CASE WHEN k >= 0.5 THEN 1 ELSE k / 0.5 END * 0.5 + n * 0.3 + s * 0.4 + a * 0.2 + t * 0.1 + l * 0.2 + 0.05) / 1.8, 9) AS score FROM c""")
def a18_rubric(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.round(S.rubric(F.col("text"), RUBRIC), 9).alias("score"))


@query(f"""
WITH s AS (SELECT source, lang, round(avg({COHERENCE}), 9) AS score FROM documents GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, lang) AS k, lead(score) OVER (PARTITION BY source ORDER BY score DESC, lang) AS second FROM s)
SELECT source, lang AS winner, score, round(score - second, 6) AS margin FROM r WHERE k = 1""")
def w2_text_winner(spark: SparkSession, d: str) -> DataFrame:
    means = table(spark, d, "documents").groupBy("source", "lang").agg(F.round(F.avg(S.coherence(F.col("text"))), 9).alias("score"))
    return R.winner_and_margin(means, "source", "lang", "score").withColumn("margin", F.round("margin", 6))


@query("SELECT item_id, 'Read text.' || chr(10) || chr(10) || 'Data: ' || text || ' as text' AS prompt FROM benchmark")
def snk12_prompt(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", S.with_data(F.lit("Data: {data} as {format_name}"), F.col("text"), "text", "Read text.").alias("prompt"))
