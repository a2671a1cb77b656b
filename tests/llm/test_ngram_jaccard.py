import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import _hashing as H
from tessera.llm import ngram_jaccard as J
from tessera.llm.components import components

from .conftest import SCHEMA, near_copy, prose, words_of


def grams(text, n):
    w = words_of(text)
    return set(zip(*(w[i:] for i in range(n)))) if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, t):
    """(doc_id, class_id, links) of each row, from all pairs of rows."""
    rows = [(i, grams(text, n)) for i, text in rows if i is not None]
    least, links = {i: i for i, _ in rows}, [0] * len(rows)

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for k, (a, x) in enumerate(rows):
        for m in range(k + 1, len(rows)):
            b, y = rows[m]
            if x and y and len(x & y) / len(x | y) >= t - 1e-12:
                links[k] += 1
                links[m] += 1
                u, v = sorted((root(a), root(b)))
                least[v] = u
    return sorted((a, root(a), k) for (a, _), k in zip(rows, links))


def rows_of(docs):
    return [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]


def found(df):
    return sorted((r["doc_id"], r["class_id"], r["links"]) for r in df.collect())


@pytest.mark.parametrize(("n", "t"), [(1, 0.5), (3, 0.65), (3, 1.0), (5, 0.3)])
def test_links_equal_brute_force(docs, n, t):
    assert found(J.near_classes(docs, n, t)) == brute(rows_of(docs), n, t)


def test_ids_that_differ_and_ids_that_several_rows_share(docs):
    once = docs.where("doc_id not in (5, 6)")
    assert found(J.near_classes(once)) == brute(rows_of(once), J.N, J.THRESHOLD)


def test_one_id_joins_classes(spark):
    """Its two rows are in two classes, which are one then; links stay those of each row."""
    x, y = "a b c d e f g h", "p q r s t u v w"
    rows = [(i, t, None, None, 0) for i, t in [(6, x), (6, y), (9, x), (12, y), (20, y + " z"), (30, "alone here now")]]
    got = found(J.near_classes(spark.createDataFrame(rows, SCHEMA)))
    assert got == [(6, 6, 1), (6, 6, 2), (9, 6, 1), (12, 6, 2), (20, 6, 2), (30, 30, 0)] == brute([r[:2] for r in rows], J.N, J.THRESHOLD)


def test_random_texts_of_few_words(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice("abcd") for _ in range(r.randint(0, 7))), None, None, 0) for i in range(120)]
    assert found(J.near_classes(spark.createDataFrame(rows, SCHEMA), 2, 0.5)) == brute([x[:2] for x in rows], 2, 0.5)


def test_a_group_of_many_near_copies(spark):
    r = random.Random(2)
    base = prose(r, 150)
    rows = [(i, near_copy(r, base, 0.03) if i % 2 else base, None, None, 0) for i in range(160)]
    rows += [(1000 + i, prose(r, 40) + " " + base[:250], None, None, 0) for i in range(40)]
    assert found(J.near_classes(spark.createDataFrame(rows, SCHEMA))) == brute([x[:2] for x in rows], J.N, J.THRESHOLD)


def test_empty_table_and_other_columns(docs, clashing, empty):
    assert J.near_classes(empty).collect() == []
    assert J.keep_one(empty).collect() == []
    assert found(J.near_classes(clashing)) == found(J.near_classes(docs))
    assert J.keep_one(clashing).columns == clashing.columns


def test_one_of_each_group_stays(docs):
    kept = collections.Counter((r["doc_id"], r["text"]) for r in J.keep_one(docs).collect())
    of = {a: c for a, c, _ in brute(rows_of(docs), J.N, J.THRESHOLD)}
    assert kept == collections.Counter(k for k in rows_of(docs) if k[0] is None or of[k[0]] == k[0])


def test_components_of_chains_and_rings(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102), (102, 100), (7, 7), (300, 200)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 1 for i in range(2, 61)} | {101: 100, 102: 100, 300: 200}


def test_a_full_bit_array_and_small_groups_change_nothing(docs, monkeypatch):
    want = found(J.near_classes(docs))
    monkeypatch.setattr(J, "FILTER_BITS", 64)
    monkeypatch.setattr(J, "PAIRS_PER_GROUP", 2)
    assert found(J.near_classes(docs)) == want


def test_the_filters_bound_what_sets_share():
    rng = np.random.default_rng(0)
    for n in (5, 40, 300, 3000):
        x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: n // 2], rng.integers(0, 2**64, n // 2 + 1, dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        assert J._most_common(J._unbin(J._bins(x)), J._unbin(J._bins(y))) >= both
        assert J._common(J._unpacked(J._packed(x)), J._unpacked(J._packed(y))) == both
    assert J._bins(np.arange(100, dtype=np.uint64)) == b""  # all in one range: more than four bits hold


def test_hashes_depend_on_the_words_alone(texts):
    whole, count = H.words(pa.array(texts))
    at = 0
    for text, n in zip(texts, count):
        alone, k = H.words(pa.array([text], pa.string()))
        assert k[0] == n == len(words_of(text))
        assert (alone == whole[at : at + n]).all()
        at += n
    words = {w for t in texts for w in words_of(t)}
    assert len({int(H.words(pa.array([w.decode()]))[0][0]) for w in words}) == len(words)


def test_slices_of_bytes_change_no_hash(texts):
    some = [t for t in texts if t is None or len(t) < 5000] + ["ab cd" * 40, "x" * 200]
    whole = H._words(pa.array(some))
    for k in (1, 7, 64):
        parted = H._words(pa.array(some), k)
        assert (parted[0] == whole[0]).all() and (parted[1] == whole[1]).all()


def test_bad_threshold(docs):
    with pytest.raises(ValueError):
        J.near_classes(docs, threshold=0)


def test_no_machine_local_folder(spark, docs):
    from tessera.llm._shared import shared_dir

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
