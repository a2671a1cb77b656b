"""Operator 10: fingerprints by consistent weighted sampling.

A document is the weighted set of its lower-case words, the weight of a word being how often it occurs. For
each of ``k`` samples a word w draws r, c ~ Gamma(2, 1) and b ~ U(0, 1), from hashes of (w, sample) alone. With
t = floor(ln(weight) / r + b), y = exp(r (t - b)) and a = c / (y exp(r)), the sample is the (w, t) of the least a.
Two documents agree in a sample with a probability that equals their generalised Jaccard similarity,
sum of minima over sum of maxima of the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _hashing as H

SAMPLES, SEED = 64, 1
#: Bytes of text whose distinct (word, weight) pairs are drawn for together; bounds the memory of a worker.
PIECE = 1 << 22


def draw(words: np.ndarray, log_weights: np.ndarray, sample: int, seed: int = SEED) -> np.ndarray:
    """ln a of each weighted word for one sample, in single precision. It depends on the word and its t alone, not further on the weight."""
    salt = (seed * 1_000_003 + sample) * 3
    low, scale = np.uint64(0xFFFFFFFF), np.float32(2.0**-32)

    def bits(i: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return H.mix(words + np.uint64(((salt + i) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64))

    def gamma(u: np.ndarray) -> np.ndarray:
        one, two = ((u & low).astype(np.float32) + np.float32(0.5)) * scale, ((u >> np.uint64(32)).astype(np.float32) + np.float32(0.5)) * scale
        return -np.log(np.minimum(one * two, np.float32(1 - 2.0**-24)))

    r, c = gamma(bits(0)), gamma(bits(1))
    b = (bits(2) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
    return np.log(c) - r * (np.floor(log_weights / r + b) - b) - r


def signatures(texts: pa.Array, k: int, seed: int) -> np.ndarray:
    """A row of k 64-bit samples for each text; texts without words have zeros."""
    h, count = H.words(texts)
    doc = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    weight = np.diff(np.append(at, len(h)))
    h, doc = h[at], doc[at]
    out = np.zeros((len(count), k), dtype=np.uint64)
    if not len(h):
        return out
    by = np.lexsort((weight, h))
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[by][1:] != h[by][:-1]) | (weight[by][1:] != weight[by][:-1])
    kind = np.empty(len(h), dtype=np.int64)
    kind[by] = np.cumsum(new) - 1
    words, log_weights = h[by][new], np.log(weight[by][new].astype(np.float32))
    start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    present = doc[start]
    for s in range(k):
        least = np.minimum.reduceat(draw(words, log_weights, s, seed)[kind], start)
        # The value stands for its (word, t); other pairs have the same one with a probability of about 2 ** -22.
        out[present, s] = H.mix(least.view(np.uint32).astype(np.uint64) << np.uint64(32) | np.uint64(s + 1))
    return out


def fingerprints(docs: DataFrame, k: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint): ``k`` 64-bit samples of each row's text.

    Every row gives a row, also repeated ones. A null or wordless text has a null fingerprint; so no two of these agree. A
    null doc_id stays null. Equal weighted sets have equal fingerprints at any place and in any batch. Other columns are not
    read. An empty table gives no rows.
    """
    if k < 1:
        raise ValueError("k must be at least 1")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in H.pieces(batch.column(1), PIECE):
                s = signatures(part, k, seed)
                rows = pa.FixedSizeListArray.from_arrays(pa.array(s.view(np.int64).ravel()), k).cast(pa.list_(pa.int64()))
                empty = pa.array(~s.any(axis=1))
                rows = pa.compute.if_else(empty, pa.scalar(None, rows.type), rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), rows], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sign, "doc_id long, fingerprint array<long>")


def agreement(a, b):
    """The share of samples in which two fingerprint columns agree: the estimate of generalised Jaccard similarity."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), lambda e: e == 1)) / F.size(a)
