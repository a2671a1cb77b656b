"""Relational operators: filters, reductions, ranking, reshaping. All are DataFrame compositions; ties always have a rule."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce
from itertools import count
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tessera.session import shared_dir


def any_contains(column: str, needles: Sequence[str]) -> Column:
    """Whether a column contains any of the needles; of none, false."""
    return reduce(or_, (F.col(column).contains(n) for n in needles), F.lit(False))


def with_fallback(df: DataFrame, exact: Column, partial: Column) -> DataFrame:
    """Rows where ``exact`` holds or, if there is none at all, rows where ``partial`` does. One scan; the test for existence is a one-row join."""
    found = df.where(exact).limit(1).agg((F.count("*") > 0).alias("__found"))
    return df.join(found).where(F.when(F.col("__found"), exact).otherwise(partial)).drop("__found")


def complete_cases(df: DataFrame, keys: Sequence[str], kind: str, kinds: int) -> DataFrame:
    """Rows of the keys that come with all ``kinds`` different values of ``kind``: relational division."""
    whole = df.groupBy(*keys).agg(F.count_distinct(kind).alias("__kinds")).where(F.col("__kinds") == kinds).select(*keys)
    return df.join(whole, list(keys), "left_semi")


def not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(how="any", subset=list(columns))


def blank(column: str) -> Column:
    return F.col(column).isNull() | (F.col(column) == "")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an order that must be total; the rank limit is pushed below the shuffle."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(by)).where("__rank = 1").drop("__rank")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)


def winner_and_margin(df: DataFrame, group: str, entity: str, score: str, single: float | None = None) -> DataFrame:
    """(group, winner, score, margin): the best entity of each group and its lead over the second; ``single`` is the lead over nobody.

    Equal scores go to the lesser entity. Nulls rank last.
    """
    by = Window.partitionBy(group).orderBy(F.col(score).desc_nulls_last(), F.col(entity))
    ranked = df.select(group, F.col(entity).alias("winner"), score, F.lead(score).over(by).alias("__second"), F.row_number().over(by).alias("__rank"))
    margin = F.coalesce(F.col(score) - F.col("__second"), F.lit(single).cast("double"))
    return ranked.where("__rank = 1").select(group, "winner", score, margin.alias("margin"))


def priority_fill(df: DataFrame, key: str, priority: Column, order: Sequence[Column], n: int) -> DataFrame:
    """The best row of each key by priority and order, and of these the first n: a greedy fill without a loop."""
    ranked = first_per_key(df.withColumn("priority", priority), [key], [F.col("priority"), *order])
    return ranked.orderBy("priority", *order).limit(n)


def histogram(df: DataFrame, key: Column, name: str = "key", default: str = "Unknown") -> DataFrame:
    return df.groupBy(F.coalesce(key, F.lit(default)).alias(name)).agg(F.count("*").alias("n"))


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def placed(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """The rows with their places in a total order, from 1. They are sorted by ranges and written to the shared folder; a place is that in its range and the sizes of the ranges before."""
    part = F.spark_partition_id()
    folder = f"{shared_dir(df.sparkSession)}/placed-{uuid.uuid4().hex}"
    ranges = df.orderBy(*order).select("*", part.alias("__range"), (F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)).alias("__row"))
    ranges.write.parquet(folder)
    rows = df.sparkSession.read.schema(ranges.schema).parquet(folder)
    sizes = rows.groupBy("__range").agg(F.count("*").alias("__n"))
    before = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    return rows.join(F.broadcast(before), "__range").select(*df.columns, (F.col("__before") + F.col("__row") + 1).alias(name))


def guarded_range(value: Column, guard: Column, least: float, most: float) -> tuple[Column, Column]:
    """Minimum and maximum of the guarded values, sentinels where there is none."""
    kept = F.when(guard, value)
    return F.coalesce(F.min(kept), F.lit(least)), F.coalesce(F.max(kept), F.lit(most))


def ratio(part: Column, whole: Column, digits: int | None = None) -> Column:
    """part / whole, 0 where the whole is 0 or null."""
    r = F.coalesce(F.try_divide(part, whole), F.lit(0.0))
    return F.round(r, digits) if digits is not None else r


def verdict(difference: Column, passing: float = 1.0, marginal: float = 5.0) -> Column:
    return F.when(F.abs(difference) <= passing, "PASS").when(F.abs(difference) <= marginal, "MARGINAL").otherwise("FAIL")


def minus_least(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds the value less the least of its key: the overhead common to all is taken off."""
    return df.withColumn(name, F.col(value) - F.min(value).over(Window.partitionBy(*keys)))


def against_baseline(df: DataFrame, key: str, kind: str, value: str, baseline: str) -> DataFrame:
    """(key, kind, value, pct): each kind's difference from the baseline kind in percent; 0 if that is 0 or absent. The baseline itself is left out."""
    base = F.max(F.when(F.col(kind) == baseline, F.col(value))).over(Window.partitionBy(key))
    pct = F.when(F.coalesce(base, F.lit(0.0)) == 0, 0.0).otherwise((F.col(value) - base) / base * 100)
    return df.select(key, kind, value, pct.alias("pct")).where(F.col(kind) != baseline)


def best_or_baseline(df: DataFrame, key: str, kind: str, value: str, baseline: str) -> DataFrame:
    """(key, best, value): the best kind; another has to be strictly better than the baseline, and among others the lesser by name wins."""
    by = Window.partitionBy(key).orderBy(F.desc(value), F.when(F.col(kind) == baseline, 0).otherwise(1), F.col(kind))
    return df.withColumn("__rank", F.row_number().over(by)).where("__rank = 1").select(key, F.col(kind).alias("best"), value)


def nest(df: DataFrame, keys: Sequence[str], order: Sequence[str], item: Column, name: str) -> DataFrame:
    """One row per key with the list of its items in order; rows whose item is null open the group and add nothing."""
    entry = F.when(item.isNotNull(), F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), item.alias("item")))
    items = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["item"])
    return df.groupBy(*keys).agg(items.alias(name))


def strict_pivot(df: DataFrame, index: Sequence[str], column: str, values: Sequence[str], value: str) -> DataFrame:
    """One column for each of the values; two rows for one cell are an error, none gives a null."""
    cells = [F.when(F.count(F.when(F.col(column) == v, 1)) <= 1, F.max(F.when(F.col(column) == v, F.col(value)))).otherwise(F.raise_error(F.lit(f"two values for {v}"))).alias(v) for v in values]
    return df.where(F.col(column).isin(list(values))).groupBy(*index).agg(*cells)


def in_list_order(column: str, values: Sequence[str]) -> Column:
    """A column's place in a list, from 1; 0 if it isn't there."""
    return F.array_position(F.array(*(F.lit(v) for v in values)), F.col(column))


def last_wins(df: DataFrame, keys: Sequence[str], position: Column) -> DataFrame:
    """The last row of each key by position."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), position).alias("__last"))
    return last.select(*keys, "__last.*")


def code_lookup(column: str, labels: dict[str, str], default: str = "Other") -> Column:
    """A code's label; an unknown code is its own, a null the default."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(column, F.lit(""))), F.col(column), F.lit(default))


def drop_empty(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Empty lists become null, which JSON output leaves out."""
    return df.withColumns({c: F.when(F.size(c) > 0, F.col(c)) for c in columns})


def stripped(df: DataFrame) -> DataFrame:
    """Column names without the white space around them."""
    return df.toDF(*(c.strip() for c in df.columns))


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(origin, node, depth): what each start node reaches, at its least depth, over paths of any length. ``edges`` is (src, dst).

    Step by step: each writes the pairs that no earlier step has to the shared folder, so paths are never listed, cycles end by themselves and no step depends on
    the executors of another. The steps run when this is called. Edges with a null end lead nowhere, a null start reaches itself, repeated rows count once, no start gives no rows.
    """
    spark = edges.sparkSession
    folder = f"{shared_dir(spark)}/closure-{uuid.uuid4().hex}"
    first, links = start.select(F.col(start.columns[0]).alias("node")), edges.select("src", "dst").dropna().distinct()
    kind = first.union(links.select("dst")).schema["node"].dataType
    links.select(F.col("src").cast(kind).alias("node"), F.col("dst").cast(kind).alias("dst")).write.parquet(f"{folder}/edges")
    links = spark.read.parquet(f"{folder}/edges")
    schema = StructType([StructField("origin", kind), StructField("node", kind), StructField("depth", IntegerType())])
    step = first.distinct().select(F.col("node").cast(kind).alias("origin"), F.col("node").cast(kind).alias("node"))
    for depth in count():
        step.write.parquet(f"{folder}/reached/depth={depth}")
        found = spark.read.schema(schema).parquet(f"{folder}/reached")
        last = found.where(F.col("depth") == depth)
        if last.isEmpty():
            return found
        nearby = last.join(links, "node").select("origin", F.col("dst").alias("node")).distinct().alias("new")
        step = nearby.join(found.alias("old"), F.expr("new.origin <=> old.origin AND new.node = old.node"), "left_anti")
