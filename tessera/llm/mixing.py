"""Operator 4: mixing sources to target weights by Sainte-Laguë apportionment.

Documents are dealt to shards by a hash; in a shard each source's documents, in a seeded order, are cut into blocks
of equal numbers of tokens. The seats of a shard go to its sources by highest
quotients weight / (2 k - 1), k up to the number of the source's blocks, which gives integer quotas. Each source then keeps the
documents that fill as many blocks as its quota, in another seeded order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._shared import seeded, shards_for, word_count

#: Target weights; sources that aren't named have weight 1.
WEIGHTS = {"src0": 3.0, "src1": 1.5, "src2": 0.5}
BLOCK_TOKENS, SHARD_ROWS, SHARE, SEED = 2048, 32_768, 0.7, 7


def _number(md5: str) -> Column:
    return F.conv(F.substring(md5, 1, 8), 16, 10).cast("long")


def blocks(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, shard_rows: int = SHARD_ROWS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, tokens, shard, block) of each doc_id; null texts and sources, repeated and null ids, ties and empty tables as in ``mix``. The block is that of the first token."""
    shards = shards_for(docs.count(), shard_rows)
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("source"), word_count("text").alias("tokens"))
    rows = rows.groupBy("doc_id").agg(F.min("source").alias("source"), F.sum("tokens").alias("tokens"))
    rows = rows.withColumn("order", seeded(seed, "doc_id")).withColumn("shard", (_number("order") % shards).cast("int"))
    before = F.sum("tokens").over(Window.partitionBy("shard", "source").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens")
    return rows.select("doc_id", "source", "tokens", "shard", F.floor(before / F.lit(block_tokens)).cast("long").alias("block"))


def quotas(of: DataFrame, weights: dict[str, float] | None = None, share: float = SHARE) -> DataFrame:
    """(shard, source, quota) from (shard, source, n), n being the number of blocks: ``share`` of a shard's blocks, rounded down, are its seats.

    Ties go to the lesser source by name; no rows give none. A shard has a bounded number of rows, so of seats too, but for the blocks of very long documents.
    """
    weights = WEIGHTS if weights is None else weights
    weight = F.lit(1.0)
    for name, w in sorted(weights.items()):
        weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    seats = of.select("shard", "source", "n", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k"))
    by = Window.partitionBy("shard").orderBy(F.desc("quotient"), "source", "k")
    seats = seats.withColumn("quotient", weight / (2 * F.col("k") - 1)).withColumn("rank", F.row_number().over(by)).withColumn("house", F.floor(F.lit(share) * F.count("*").over(Window.partitionBy("shard"))))
    return seats.where("rank <= house").groupBy("shard", "source").agg(F.count("*").alias("quota"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_tokens: int = BLOCK_TOKENS, shard_rows: int = SHARD_ROWS, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """(doc_id, source, tokens, shard, block) of the documents selected.

    A source of a shard has as many blocks as its tokens fill, one at least, so a document of any length counts for all that it covers; its quota is one of tokens, ``block_tokens`` a seat.
    Its documents are kept in another seeded order as long as they lie by half or more within the quota, so its tokens miss it by half of one document at most.
    Tokens are words; a null or wordless text has none. A null source is a source of its own, named "". A null
    doc_id is never selected. Rows that share a doc_id are one document, of the least source by name and of all their tokens. Equal quotients go to the
    lesser source by name. A source of weight 0 gets seats only when the others have no blocks left. Other columns are not read. An
    empty table gives no rows.
    """
    if not 0 <= share <= 1:
        raise ValueError("share must be in [0, 1]")
    rows = blocks(docs, block_tokens, shard_rows, seed)
    filled = F.greatest(F.ceil(F.sum("tokens") / F.lit(block_tokens)), F.lit(1)).cast("long")
    each = rows.groupBy("shard", "source").agg(filled.alias("n"))
    by = Window.partitionBy("shard", "source").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("order", seeded(seed + 1, "doc_id")).withColumn("after", F.sum("tokens").over(by))
    kept = placed.join(quotas(each, weights, share), ["shard", "source"]).where(2 * F.col("after") - F.col("tokens") <= 2 * block_tokens * F.col("quota"))
    return kept.select("doc_id", "source", "tokens", "shard", "block")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The selected rows of ``docs`` with all their columns, whatever these are called; rows that share a doc_id stay or go together."""
    chosen = mix(docs, **options).select(F.col("doc_id").alias("chosen"))
    return docs.join(chosen, docs["doc_id"].cast("long") == chosen["chosen"], "left_semi")


def sql(n_rows: str = "(SELECT count(*) FROM documents)", tokens: str = "len(w)", words: str = "", weights: dict[str, float] | None = None, block_tokens: int = BLOCK_TOKENS, shard_rows: int = SHARD_ROWS, share: float = SHARE, seed: int = SEED) -> str:
    cases = " ".join(f"WHEN source = '{s}' THEN CAST({w} AS DOUBLE)" for s, w in sorted((WEIGHTS if weights is None else weights).items()))
    return f"""
WITH d AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, min(coalesce(source, '')) AS source, CAST(sum({words}) AS BIGINT) AS tokens
  FROM documents WHERE doc_id IS NOT NULL GROUP BY 1),
s AS (SELECT *, md5('{seed}|' || doc_id) AS o, greatest(1, CAST(ceil({n_rows} / {shard_rows}.0) AS BIGINT)) AS shards FROM d),
r AS (SELECT *, CAST(CAST('0x' || substr(o, 1, 8) AS BIGINT) % shards AS INTEGER) AS shard FROM s),
b AS (
  SELECT doc_id, source, tokens, shard,
    CAST(floor((sum(tokens) OVER (PARTITION BY shard, source ORDER BY o, doc_id ROWS UNBOUNDED PRECEDING) - tokens) / {block_tokens}) AS BIGINT) AS block
  FROM r),
e AS (SELECT shard, source, CAST(greatest(1, ceil(sum(tokens) / {block_tokens}.0)) AS BIGINT) AS n FROM b GROUP BY 1, 2),
k AS (SELECT shard, source, unnest(range(1, n + 1)) AS k FROM e),
q AS (
  SELECT shard, source, CASE {cases} ELSE CAST(1 AS DOUBLE) END / (2 * k - 1) AS quotient, k,
    floor({share} * count(*) OVER (PARTITION BY shard)) AS house FROM k),
w AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY quotient DESC, source, k) AS rank FROM q),
t AS (SELECT shard, source, count(*) AS quota FROM w WHERE rank <= house GROUP BY 1, 2),
p AS (SELECT *, sum(tokens) OVER (PARTITION BY shard, source ORDER BY md5('{seed + 1}|' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) AS after FROM b)
SELECT doc_id, source, tokens, shard, block FROM p JOIN t USING (shard, source) WHERE 2 * after - tokens <= 2 * {block_tokens} * quota"""
