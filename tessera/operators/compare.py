"""Comparing answers by task, provider and format: composites, rankings, complete cases, token sums, and the reports made of them.

``analysis`` has (task_id, provider, format, completeness, relevance, coherence, factual_accuracy and, perhaps, actionability);
``responses`` has (task_id, provider, format, status, input_tokens, output_tokens).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scoring import WEIGHTS, weighted
from tessera.operators.relational import complete_cases, ratio, winner_and_margin

CASE = ["task_id", "provider", "format"]


def composites(analysis: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(task_id, provider, format, score); a metric that isn't there counts as 1."""
    weights = WEIGHTS if weights is None else weights
    have = {k: F.col(k) if k in analysis.columns else F.lit(1.0) for k in weights}
    return analysis.select(*CASE, weighted(have, weights).alias("score"))


def rankings(scores: DataFrame) -> DataFrame:
    """(task_id, format, providers_ranked, winner, margin); equal scores rank by name, and the only provider has no margin."""
    ranked = scores.groupBy("task_id", "format").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "provider"))), lambda x: x["provider"]).alias("providers_ranked"))
    best = winner_and_margin(scores.withColumn("__group", F.struct("task_id", "format")), "__group", "provider", "score").select("__group.*", "winner", "margin")
    return ranked.join(best, ["task_id", "format"])


def format_accuracy(scores: DataFrame) -> DataFrame:
    """(provider, format, avg_score, wins); a provider that never wins has 0."""
    by = Window.partitionBy("task_id", "format").orderBy(F.desc("score"), "provider")
    won = scores.withColumn("__won", F.row_number().over(by) == 1)
    return won.groupBy("provider", "format").agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_score"), F.count_if("__won").alias("wins"))


def complete(responses: DataFrame, formats: int) -> DataFrame:
    """The successful responses of the tasks and providers that succeeded in all formats."""
    return complete_cases(responses.where(F.lower("status") == "success"), ["task_id", "provider"], "format", formats)


def format_tokens(responses: DataFrame, formats: int) -> DataFrame:
    """(provider, format, input_tokens, output_tokens, total_tokens) over complete cases."""
    sums = complete(responses, formats).groupBy("provider", "format").agg(*(F.sum(F.col(c).cast("long")).alias(c) for c in ("input_tokens", "output_tokens")))
    return sums.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))


def means_by(scores: DataFrame, tasks: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, provider, score): means by each of some columns of the tasks, in one pass; scores of unknown tasks are left out."""
    joined = scores.join(tasks.select("task_id", *columns), "task_id")
    sets = [[c, "provider"] for c in columns]
    means = joined.groupingSets(sets, *columns, "provider").agg(F.avg("score").alias("score"), F.grouping_id().alias("__g"))
    picks = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    bits = {c: 1 << (len(columns) - i) for i, c in enumerate(columns)}
    whole = sum(bits.values())
    chosen = F.coalesce(*(F.when(F.col("__g") == whole - bits[c], p) for c, p in zip(columns, picks)))
    return means.select(chosen.alias("c"), "provider", "score").select("c.*", "provider", "score")


def leaders(means: DataFrame) -> DataFrame:
    """(value, winner, score, margin): the best provider of each category; the only one leads by 0."""
    return winner_and_margin(means, "value", "provider", "score", single=0.0)


def savings(tokens: DataFrame, baseline: str) -> DataFrame:
    """(provider, format, input_pct, total_pct): tokens against the baseline format's in percent; 0 where that is 0 or absent."""
    base = {c: F.max(F.when(F.col("format") == baseline, F.col(c))).over(Window.partitionBy("provider")) for c in ("input_tokens", "total_tokens")}
    pct = {c: ratio((F.col(c) - b).cast("double"), b.cast("double")) * 100 for c, b in base.items()}
    return tokens.select("provider", "format", pct["input_tokens"].alias("input_pct"), pct["total_tokens"].alias("total_pct")).where(F.col("format") != baseline)


def summary(scores: DataFrame, means: DataFrame) -> DataFrame:
    """One JSON text: providers by mean score with their wins, and the leader of each category."""
    total = format_accuracy(scores).groupBy("provider").agg(F.sum("wins").alias("wins")).join(scores.groupBy("provider").agg(F.avg("score").alias("score")), "provider")
    first = total.agg(F.array_sort(F.collect_list(F.struct((-F.round("score", 3)).alias("s"), "provider", "wins"))).alias("x"))
    ranks = first.select(F.transform("x", lambda e, i: F.struct((i + 1).alias("rank"), e["provider"].alias("provider"), (-e["s"]).alias("score"), e["wins"].alias("wins"))).alias("rankings"))
    best = leaders(means).agg(F.array_sort(F.collect_list(F.struct(F.col("value").alias("category"), F.col("winner").alias("leader"), F.round("margin", 3).alias("margin")))).alias("categories"))
    return ranks.join(best).select(F.to_json(F.struct("rankings", "categories")).alias("json"))


def report(tables: dict[str, DataFrame], order: Sequence[str] = ("format", "task_id", "provider")) -> str:
    """Small tables as nested text, with schemas, numbers of three decimals and rows in order."""
    from tessera.operators.inference import infer
    from tessera.sources.render import to_text
    from tessera.sources.values import Document

    data = {}
    for name, df in tables.items():
        rounded = df.select(*(F.round(c, 3).alias(c) if t == "double" else c for c, t in df.dtypes))
        data[name] = [r.asDict(recursive=True) for r in rounded.orderBy(*(c for c in order if c in df.columns)).collect()]
    return to_text(infer(Document(data)))
