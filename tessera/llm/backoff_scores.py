"""Operator 6: stupid-backoff scores of all documents from the bigram counts of the whole corpus.

A word w after v scores log(c(v, w) / c(v)) where the corpus has the bigram at least ``min_count`` times, else
log(alpha * c(w) / N); a document's first word scores log(c(w) / N). All counts are over all documents.

Count tables and the exploded bigrams are partitioned alike, by the hash of the predicted word, so that c(v, w) and
c(w) meet their occurrences in one exchange. Bigrams travel as packed columns rather than as rows: at some nine
bytes each instead of thirty the exchange stays near the size of the input. Words with more than N / 2**20 occurrences (at
most 2**20 of them, whatever the corpus) are partitioned by the bigram instead, so none makes a hot partition;
their counts go to all workers. The counts c(v) of other context words come from a join with the unigram table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _hashing as H
from tessera.llm._shared import written

ALPHA, MIN_COUNT = 0.4, 2
#: A word is common if it makes up more than this share of the corpus; there are at most as many as its inverse.
COMMON = 2.0**-20
RECORDS, MOST_RECORDS, MANY = 1 << 21, 1 << 24, 4096
#: Words are told apart by 48 bits of their hashes; 0 stands for no word.
WORD = np.uint64((1 << 48) - 1)
PIECE = 1 << 23


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    h, count = H.words(texts)
    h = h & WORD
    h[h == 0] = 1
    return h, count


def unigrams(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word occurs in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for _, part in H.pieces(batch.column(0), PIECE):
                w, k = np.unique(_words(part)[0], return_counts=True)
                word, at = np.unique(np.concatenate([word, w]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([n, k]), minlength=len(word)).astype(np.int64)
                if len(word) > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(n)], ["word", "n"])
                    word, n = word[:0], n[:0]
        yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(n)], ["word", "n"])

    return docs.where("doc_id is not null").select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _split(x: np.ndarray) -> list[bytes]:
    return [(x & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), (x >> np.uint64(32)).astype(np.uint16).tobytes()]


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, dtype: type, n: int) -> np.ndarray:
        x = np.frombuffer(self.data, dtype, n, self.at)
        self.at += x.nbytes
        return x

    def word(self, n: int) -> np.ndarray:
        low = self.take(np.uint32, n).astype(np.uint64)
        return low | self.take(np.uint16, n).astype(np.uint64) << np.uint64(32)


def pack(w: np.ndarray, v: np.ndarray, doc: np.ndarray) -> bytes:
    """Records sorted by word, context and document: each word once, each bigram once, then documents' numbers."""
    order = np.lexsort((doc, v, w))
    w, v, doc = w[order], v[order], doc[order]
    new_w = np.concatenate([[True], w[1:] != w[:-1]])
    new_pair = new_w | np.concatenate([[True], v[1:] != v[:-1]])
    pairs = np.flatnonzero(new_pair)
    per_pair = np.diff(np.append(pairs, len(w)))
    per_w = np.diff(np.append(np.flatnonzero(new_w[pairs]), len(pairs)))
    parts = [np.array([len(per_w), len(pairs), len(w)], np.uint32).tobytes(), *_split(w[new_w]), per_w.astype(np.uint32).tobytes(), *_split(v[pairs]), per_pair.astype(np.uint32).tobytes(), doc.astype(np.uint32).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r = _Reader(zstandard.decompress(blob))
    n_w, n_pairs, n = (int(x) for x in r.take(np.uint32, 3))
    w, per_w, v, per_pair = r.word(n_w), r.take(np.uint32, n_w), r.word(n_pairs), r.take(np.uint32, n_pairs)
    return np.repeat(np.repeat(w, per_w), per_pair), np.repeat(v, per_pair), r.take(np.uint32, n)


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """values at the wanted keys, 0 where there is none; keys are sorted."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, values[at], 0)


def scores(docs: DataFrame, alpha: float = ALPHA, min_count: int = MIN_COUNT) -> DataFrame:
    """(doc_id, n_tokens, log_score, mean_log_score) of each document, natural logarithms, rounded to 3 and 6 decimals.

    Words are runs of anything but ASCII white space, in lower case. A null or wordless text gives no row and neither does a
    null doc_id. Rows that share a doc_id are added up; repeated rows count each time. Ties don't arise. Other columns
    are not read. An empty table gives no rows.
    """
    if not 0 < alpha <= 1 or min_count < 1:
        raise ValueError("alpha must be in (0, 1] and min_count at least 1")
    spark = docs.sparkSession
    counts = written(unigrams(docs), "unigrams")
    total = counts.agg(F.sum("n")).first()[0] or 0
    common = counts.where(F.col("n") > F.lit(COMMON * total)).toArrow()  # at most 1 / COMMON rows
    order = np.argsort(common["word"].to_numpy())
    shared = spark.sparkContext.broadcast((common["word"].to_numpy()[order].astype(np.uint64).tobytes(), common["n"].to_numpy()[order].astype(np.int64).tobytes()))
    buckets = max(1, min(-(-total // RECORDS), max(MANY, -(-total // MOST_RECORDS))))

    def table() -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(shared.value[0], np.uint64), np.frombuffer(shared.value[1], np.int64)

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = table()
        for batch in batches:
            for first, part in H.pieces(batch.column(1), PIECE):
                w, count = _words(part)
                if not len(w):
                    continue
                ids = batch.column(0).slice(first, len(part)).to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(len(part)), count)
                v = np.concatenate([[np.uint64(0)], w[:-1]])
                v[np.concatenate([[True], doc[1:] != doc[:-1]])] = 0
                is_common = _look_up(keys, values, w) > 0
                bucket = (H.mix(np.where(is_common, H.join_hashes([w, v]), w)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                at = np.searchsorted(bucket[order], np.arange(buckets + 1))
                packer = zstandard.ZstdCompressor(level=1)
                for b in range(buckets):
                    if at[b] < at[b + 1]:
                        rows = order[at[b] : at[b + 1]]
                        here, local = np.unique(doc[rows], return_inverse=True)
                        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([packer.compress(np.diff(ids[here], prepend=0).tobytes())], pa.binary()), pa.array([pack(w[rows], v[rows], local)], pa.binary())], ["bucket", "docs", "grams"])

    packed = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null").mapInArrow(bigrams, "bucket int, docs binary, grams binary").groupBy("bucket")

    def counted(t: pa.Table):
        """Of the records of one bucket: context, document, count of the bigram, count of the word."""
        keys, values = table()
        parts = [(*unpack(g.as_py()), np.cumsum(np.frombuffer(zstandard.decompress(d.as_py()), np.int64))) for g, d in zip(t["grams"], t["docs"])]
        w, v = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        doc = np.concatenate([p[3][p[2]] for p in parts])
        del parts
        order = np.lexsort((v, w))
        w, v, doc = w[order], v[order], doc[order]
        new_w = np.concatenate([[True], w[1:] != w[:-1]])
        at = np.flatnonzero(new_w | np.concatenate([[True], v[1:] != v[:-1]]))
        n = np.diff(np.append(at, len(w)))
        c2 = np.repeat(n, n)
        at = np.flatnonzero(new_w)
        n = np.diff(np.append(at, len(w)))
        known = _look_up(keys, values, w[at])
        c1 = np.repeat(np.where(known > 0, known, n), n)
        return v, doc, c2, c1

    def sums(t: pa.Table) -> pa.Table:
        v, doc, c2, c1 = counted(t)
        hit = (v > 0) & (c2 >= min_count)
        score = np.where(hit, np.log(c2), np.log(c1) - np.log(total) + np.where(v > 0, np.log(alpha), 0.0))
        keys, values = table()
        of_context = _look_up(keys, values, v)
        score -= np.where(hit & (of_context > 0), np.log(np.maximum(of_context, 1)), 0.0)
        ids, at = np.unique(doc, return_inverse=True)
        return pa.table({"doc_id": pa.array(ids), "score": pa.array(np.bincount(at, weights=score)), "n": pa.array(np.bincount(at))})

    def contexts(t: pa.Table) -> pa.Table:
        v, doc, c2, _ = counted(t)
        keys, values = table()
        open_ = (v > 0) & (c2 >= min_count)
        open_[open_] = _look_up(keys, values, v[open_]) == 0
        return pa.table({"word": pa.array(v[open_].astype(np.int64)), "doc_id": pa.array(doc[open_])})

    own = packed.applyInArrow(sums, "doc_id long, score double, n long")
    rest = packed.applyInArrow(contexts, "word long, doc_id long").join(counts, "word").select("doc_id", (-F.log(F.col("n"))).alias("score"), F.lit(0).cast("long").alias("n"))
    both = own.unionByName(rest).groupBy("doc_id").agg(F.sum("n").alias("n_tokens"), F.sum("score").alias("score"))
    return both.select("doc_id", "n_tokens", F.round("score", 3).alias("log_score"), F.round(F.col("score") / F.col("n_tokens"), 6).alias("mean_log_score"))
