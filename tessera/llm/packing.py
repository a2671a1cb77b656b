"""Operator 9: sum-of-squares packing of documents into sequences of equal length.

Each document goes where the sum, over all gaps, of the squared number of open bins with that gap becomes
smallest: into an open bin, or into a new one. What a document has beyond the capacity fills bins of its own, so every token is
packed. The method is sequential; documents are dealt to shards by a hash and each shard is packed by itself, so shards run side
by side. There are as many shards as the input needs at ``shard_rows`` rows each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import seeded, shards_for, word_count

CAPACITY, SHARD_ROWS, SEED = 2048, 8192, 11
SCHEMA = "shard int, bin int, doc_id long, piece int, start long, length int, at int"


class SumOfSquares:
    """Open bins by gap; the gap of a bin is what is free in it. Full bins aren't counted."""

    def __init__(self, capacity: int):
        self.capacity, self.bins = capacity, 0
        self.open = np.zeros(capacity + 1, dtype=np.int64)
        self.where: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) for an item of 1 to capacity. Ties: an open bin before a new one, the smaller gap, the bin that came to it last."""
        c, n = self.capacity, self.open
        best, gap = (2 * int(n[c - size]) + 1 if size < c else 0), c
        gaps = np.flatnonzero(n[size:c]) + size
        if len(gaps):
            change = np.where(gaps > size, 2 * n[gaps - size] + 1, 0) - 2 * n[gaps] + 1
            k = int(np.argmin(change))
            if change[k] <= best:
                gap = int(gaps[k])
        if gap == c:
            b, self.bins = self.bins, self.bins + 1
        else:
            b = self.where[gap].pop()
            n[gap] -= 1
        if gap > size:
            self.where[gap - size].append(b)
            n[gap - size] += 1
        return b, c - gap


def pack_shard(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    packer, out = SumOfSquares(capacity), []
    rows = rows.sort_values(["order", "doc_id", "tokens"], kind="stable", na_position="last")
    for doc, tokens in zip(rows["doc_id"], rows["tokens"]):
        for piece, start in enumerate(range(0, int(tokens), capacity)):
            size = min(capacity, int(tokens) - start)
            b, at = packer.place(size)
            out.append((b, doc, piece, start, size, at))
    made = pd.DataFrame(out, columns=["bin", "doc_id", "piece", "start", "length", "at"])
    made.insert(0, "shard", rows["shard"].iloc[0] if len(rows) else 0)
    made["doc_id"] = made["doc_id"].astype("Int64")
    return made


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, seed: int = SEED) -> DataFrame:
    """(shard, bin, doc_id, piece, start, length, at): where each piece of each document lies in its sequence.

    ``start`` is the piece's first token in the document, ``at`` its place in the bin. Tokens are words. A null or wordless
    text has no pieces. A null doc_id is packed like any other, its shard being by its text, and repeated rows are packed each; among rows of one hash the order is by
    id and length. Other columns are not read. An empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    shards = shards_for(docs.count(), shard_rows)
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), "text")).alias("spread")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_count("text").alias("tokens"), spread).where("tokens > 0")
    by = F.coalesce("spread", F.xxhash64(F.lit(seed), "doc_id"))
    rows = rows.select("doc_id", "tokens", seeded(seed, "doc_id").alias("order"), F.pmod(by, F.lit(shards)).cast("int").alias("shard"))
    return rows.groupBy("shard").applyInPandas(lambda pdf: pack_shard(pdf.astype({"doc_id": "Int64"}), capacity), SCHEMA)
