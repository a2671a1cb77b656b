import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import _hashing as H
from tessera.llm import weighted_minhash as W

from .conftest import near_copy, prose, words_of


def similarity(a, b):
    x, y = collections.Counter(words_of(a)), collections.Counter(words_of(b))
    return sum((x & y).values()) / sum((x | y).values())


def test_agreement_estimates_generalised_jaccard():
    r = random.Random(3)
    pairs = []
    for rate in (0.05, 0.2, 0.4, 0.7):
        for _ in range(6):
            a = prose(r, 120) + " the" * r.randint(0, 30)
            pairs.append((a, near_copy(r, a, rate) + " the" * r.randint(0, 30)))
    k = 1024
    s = W.signatures(pa.array([t for p in pairs for t in p]), k, 1)
    off = [(s[2 * i] == s[2 * i + 1]).mean() - similarity(*p) for i, p in enumerate(pairs)]
    assert max(map(abs, off)) < 5 * 0.5 / np.sqrt(k)
    assert abs(np.mean(off)) < 0.01


def test_samples_equal_brute_force():
    text = "a b b c c c c " + "d " * 9
    got = W.signatures(pa.array(["x y z", text]), 16, 1)[1]
    for s in range(16):
        least = min(W.draw(H.words(pa.array([w]))[0], np.log(np.array([n], np.float32)), s)[0] for w, n in collections.Counter(text.split()).items())
        assert got[s] == H.mix(np.array([least], np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | np.uint64(s + 1))[0]


def test_rows_nulls_and_repeats(docs, clashing, empty):
    rows = docs.select("doc_id", "text").collect()
    got = W.fingerprints(docs, 8).join(docs.select("doc_id").distinct(), "doc_id").collect()
    assert W.fingerprints(docs, 8).count() == len(rows)
    by = collections.defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(None if r["fingerprint"] is None else tuple(r["fingerprint"]))
    for i, t in rows:
        if i is not None:
            assert (None in by[i]) == (not words_of(t))
    assert by[0] == by[40] == by[41]  # exact copies
    assert by[2] == by[46]  # the same but for case
    assert W.fingerprints(empty).collect() == []
    order = lambda df: sorted(map(str, df.collect()))
    assert order(W.fingerprints(clashing, 8)) == order(W.fingerprints(docs.repartition(7), 8))
    with pytest.raises(ValueError):
        W.fingerprints(docs, 0)


def test_agreement_column(docs):
    f = W.fingerprints(docs.where("doc_id in (0, 40)"), 8)
    a, b = f.where("doc_id = 0").select(F.col("fingerprint").alias("x")), f.where("doc_id = 40").select(F.col("fingerprint").alias("y"))
    assert a.join(b).select(W.agreement("x", "y")).first()[0] == 1.0
