import collections
import math

import pytest

from tessera.llm import backoff_scores as B
from tessera.llm import ngram_scores as G

from .conftest import SCHEMA, words_of
from .test_backoff_scores import check


def grams(ws, order):
    return collections.Counter(tuple(ws[i : i + k]) for k in range(1, order + 1) for i in range(len(ws) - k + 1))


def brute(rows, order=3, alpha=0.4, least=1, held_out=True):
    rows = [(i, words_of(t)) for i, t in rows if i is not None]
    every = collections.Counter()
    for _, ws in rows:
        every.update(grams(ws, order))
    total, out = sum(len(ws) for _, ws in rows), {}
    for i, ws in rows:
        own = grams(ws, order) if held_out else collections.Counter()
        c = lambda g: every[g] - own[g]  # noqa: E731, B023

        def score(h, w):
            if not h:
                return math.log(max(c((w,)), 1)) - math.log(max(total - (len(ws) if held_out else 0), 1))  # noqa: B023
            return math.log(c((*h, w)) / c(h)) if c((*h, w)) >= least else math.log(alpha) + score(h[1:], w)

        if ws:
            n, before = out.get(i, (0, 0.0))
            out[i] = n + len(ws), before + sum(score(tuple(ws[max(0, k - order + 1) : k]), w) for k, w in enumerate(ws))
    return out


@pytest.mark.parametrize(("order", "least", "held_out"), [(3, 1, True), (2, 1, True), (4, 2, True), (3, 1, False), (3, 2, False)])
def test_scores_equal_brute_force(docs, order, least, held_out):
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    check(G.ngram_scores(docs, order, 0.4, least, held_out).collect(), brute(rows, order, 0.4, least, held_out))


@pytest.mark.parametrize("coded", [1 << 20, 20, 0])
def test_hot_and_rare_words(docs, monkeypatch, coded):
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    monkeypatch.setattr(G, "RECORDS", 100)
    monkeypatch.setattr(G, "CODED", coded)
    monkeypatch.setattr(G, "PIECE", 3000)
    for order in (3, 4):
        check(G.ngram_scores(docs, order).collect(), brute(rows, order))


def test_longer_sequences_and_single_occurrences_count(spark):
    """The last two texts have the same pairs of words seen elsewhere; only the sequences of three differ."""
    texts = ["a b c", "x b d", "a b c", "a b d"]
    df = spark.createDataFrame([(i, t, None, None, 5) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r["log_score"] for r in G.ngram_scores(df).collect()}
    start = math.log(2 / 9) + math.log(2 / 2)
    assert got[2] == pytest.approx(start + math.log(1 / 2), abs=1e-3)
    assert got[3] == pytest.approx(start + math.log(0.4) + math.log(1 / 3), abs=1e-3)


def test_single_occurrences_elsewhere_count(spark):
    """Each text's pairs occur once in its own row and once in another; what only its own row has is unseen."""
    df = spark.createDataFrame([(0, "a b", None, None, 3), (1, "a b", None, None, 3), (2, "c d c d", None, None, 7)], SCHEMA)
    got = {r["doc_id"]: r["log_score"] for r in G.ngram_scores(df).collect()}
    assert got[0] == got[1] == pytest.approx(math.log(1 / 6), abs=1e-3)
    assert got[2] == pytest.approx(math.log(1 / 4) * 4 + math.log(0.4) + 2 * 2 * math.log(0.4), abs=1e-3)


def test_order_two_is_the_bigram_operator(docs, empty):
    assert {r["doc_id"]: r["log_score"] for r in G.ngram_scores(docs, 2, min_count=2, held_out=False).collect()} == pytest.approx({r["doc_id"]: r["log_score"] for r in B.scores(docs).collect()}, abs=2e-3)
    assert G.ngram_scores(empty).collect() == []
    with pytest.raises(ValueError):
        G.ngram_scores(docs, 1)
