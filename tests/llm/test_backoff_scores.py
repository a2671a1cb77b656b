import collections
import math

import pytest

from tessera.llm import backoff_scores as B

from .conftest import SCHEMA, words_of


def brute(rows, alpha=B.ALPHA, least=B.MIN_COUNT):
    rows = [(i, words_of(t)) for i, t in rows if i is not None]
    one = collections.Counter(w for _, ws in rows for w in ws)
    two = collections.Counter(p for _, ws in rows for p in zip(ws, ws[1:]))
    total, out = sum(one.values()), {}
    for i, ws in rows:
        s = 0.0
        for k, w in enumerate(ws):
            pair = (ws[k - 1], w)
            if k and two[pair] >= least:
                s += math.log(two[pair] / one[ws[k - 1]])
            else:
                s += math.log(one[w] / total) + (math.log(alpha) if k else 0)
        if ws:
            n, before = out.get(i, (0, 0.0))
            out[i] = n + len(ws), before + s
    return out


def check(got, want):
    got = {r["doc_id"]: r for r in got}
    assert got.keys() == want.keys()
    for i, (n, s) in want.items():
        assert got[i]["n_tokens"] == n
        assert got[i]["log_score"] == pytest.approx(s, abs=6e-4)
        assert got[i]["mean_log_score"] == pytest.approx(s / n, abs=6e-7)


@pytest.mark.parametrize(("alpha", "least"), [(0.4, 2), (1.0, 1), (0.1, 3)])
def test_scores_equal_brute_force(docs, alpha, least):
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    check(B.scores(docs, alpha, least).collect(), brute(rows, alpha, least))


def test_many_buckets_and_few_common_words(docs, monkeypatch):
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    monkeypatch.setattr(B, "RECORDS", 500)
    monkeypatch.setattr(B, "COMMON", 0.002)
    check(B.scores(docs).collect(), brute(rows))
    monkeypatch.setattr(B, "COMMON", 1.0)  # none is common: all contexts are joined
    check(B.scores(docs).collect(), brute(rows))


def test_counts_are_over_all_documents(spark):
    rows = [(i, "a b", None, None, 3) for i in range(50)] + [(99, "a c", None, None, 3)]
    got = {r["doc_id"]: r["log_score"] for r in B.scores(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0] == pytest.approx(math.log(51 / 102) + math.log(50 / 51), abs=1e-3)
    assert got[99] == pytest.approx(math.log(51 / 102) + math.log(0.4 / 102), abs=1e-3)


def test_empty_table_and_other_columns(docs, clashing, empty):
    assert B.scores(empty).collect() == []
    assert sorted(B.scores(clashing).collect()) == sorted(B.scores(docs).collect())


def test_packing_is_exact():
    import numpy as np

    rng = np.random.default_rng(0)
    w, v, doc = (rng.integers(0, k, 1000, dtype=np.uint64) for k in (30, 20, 9))
    w, v = w * np.uint64(2**40 + 1), v * np.uint64(2**43 + 5)
    got = B.unpack(B.pack(w, v, doc))
    assert sorted(zip(*(x.tolist() for x in got))) == sorted(zip(w.tolist(), v.tolist(), doc.tolist()))


def test_bad_options(docs):
    with pytest.raises(ValueError):
        B.scores(docs, alpha=0)
