import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import compare as C
from tessera.sources import text


@pytest.fixture(scope="module")
def analysis(spark):
    rows = [("t1", "p", "json", 1.0, 0.5, 0.8, 1.0), ("t1", "q", "json", 1.0, 1.0, 0.8, 1.0), ("t2", "p", "json", 0.4, 0.5, 0.5, 0.5), ("t2", "q", "json", 0.4, 0.5, 0.5, 0.5), ("t1", "p", "text", 1.0, 1.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, "task_id string, provider string, format string, completeness double, relevance double, coherence double, factual_accuracy double")


def test_composites_and_rankings(analysis):
    s = C.composites(analysis)
    got = {(r[0], r[1], r[2]): r[3] for r in s.collect()}
    assert got["t1", "p", "json"] == pytest.approx(0.25 + 0.125 + 0.16 + 0.2 + 0.1)
    r = {(x["task_id"], x["format"]): x for x in C.rankings(s).collect()}
    assert r["t1", "json"]["providers_ranked"] == ["q", "p"] and r["t1", "json"]["margin"] == pytest.approx(0.125)
    assert r["t2", "json"]["winner"] == "p" and r["t2", "json"]["margin"] == 0 and r["t1", "text"]["margin"] is None
    acc = {(x["provider"], x["format"]): x for x in C.format_accuracy(s).collect()}
    assert (acc["p", "json"]["wins"], acc["q", "json"]["wins"]) == (1, 1) and acc["p", "text"]["avg_score"] == pytest.approx(1.0)


def test_tokens_of_complete_cases(spark):
    rows = [("a", "p", "json", "Success", 10, 1), ("a", "p", "text", "success", 6, 1), ("b", "p", "json", "success", 90, 9), ("b", "p", "text", "error", 0, 0), ("a", "q", "json", "success", 0, 0), ("a", "q", "text", "success", 5, 5)]
    df = spark.createDataFrame(rows, "task_id string, provider string, format string, status string, input_tokens int, output_tokens int")
    got = {(r["provider"], r["format"]): (r["input_tokens"], r["total_tokens"]) for r in C.format_tokens(df, 2).collect()}
    assert got == {("p", "json"): (10, 11), ("p", "text"): (6, 7), ("q", "json"): (0, 0), ("q", "text"): (5, 10)}
    saved = {r["provider"]: r for r in C.savings(C.format_tokens(df, 2), "json").collect()}
    assert saved["p"]["input_pct"] == pytest.approx(-40) and saved["q"]["input_pct"] == 0


def test_means_leaders_summary_and_report(spark, analysis):
    s = C.composites(analysis).where("format = 'json'")
    tasks = spark.createDataFrame([("t1", "law", "simple"), ("t2", "health", "simple")], "task_id string, category string, complexity string")
    m = C.means_by(s, tasks, ["category", "complexity"])
    got = {(r["column"], r["value"], r["provider"]): r["score"] for r in m.collect()}
    assert len(got) == 6 and got["complexity", "simple", "q"] == pytest.approx((0.91 + 0.05 + got["category", "health", "q"]) / 2, abs=0.01)
    lead = {r["value"]: r["winner"] for r in C.leaders(m.where("column = 'category'")).collect()}
    assert lead == {"law": "q", "health": "p"}
    made = json.loads(C.summary(s, m.where("column = 'category'")).first()[0])
    assert [x["provider"] for x in made["rankings"]] == ["q", "p"] and [x["category"] for x in made["categories"]] == ["health", "law"]
    back = text.parse(C.report({"accuracy": C.format_accuracy(C.composites(analysis))}))
    assert [r["format"] for r in back.data["accuracy"]] == ["json", "json", "text"] and "accuracy" in back.schemas
    assert s.where(F.lit(False)).count() == 0 and C.format_accuracy(s.limit(0)).collect() == []
