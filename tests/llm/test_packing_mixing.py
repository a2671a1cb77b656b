import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing, packing
from tessera.llm._shared import shards_for

from .conftest import SCHEMA, prose, words_of


def naive(sizes, capacity):
    """The definition itself: every choice is tried and the sum of squares computed anew."""
    gaps, made, out = {}, 0, []
    stacks = collections.defaultdict(list)
    total = lambda g: sum(n * n for n in collections.Counter(x for x in g.values() if 0 < x < capacity).values())
    for s in sizes:
        choices = []
        for gap in {g for g in gaps.values() if g >= s}:
            b = stacks[gap][-1]
            choices.append((total(gaps | {b: gap - s}), 0, gap, b))
        choices.append((total(gaps | {made: capacity - s}), 1, capacity, made))
        _, new, gap, b = min(choices)
        made += new
        if not new:
            stacks[gap].pop()
        if gap > s:
            gaps[b] = gap - s
            stacks[gap - s].append(b)
        else:
            gaps.pop(b, None)
        out.append((b, capacity - gap))
    return out


@pytest.mark.parametrize("capacity", [1, 2, 7, 30, 100])
def test_places_equal_the_definition(capacity):
    r = random.Random(capacity)
    sizes = [r.randint(1, capacity) for _ in range(200)]
    packer = packing.SumOfSquares(capacity)
    assert [packer.place(s) for s in sizes] == naive(sizes, capacity)


def check_packed(docs, rows, capacity):
    want = collections.Counter((r["doc_id"], len(words_of(r["text"]))) for r in docs.select("doc_id", "text").collect() if words_of(r["text"]))
    bins, by_doc = collections.defaultdict(list), collections.Counter()
    for r in rows:
        bins[r["shard"], r["bin"]].append((r["at"], r["length"]))
        by_doc[r["doc_id"]] += r["length"]
    for pieces in bins.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:]))
        assert pieces[-1][0] + pieces[-1][1] <= capacity
    total = collections.Counter()
    for (i, n), k in want.items():
        total[i] += n * k
    assert by_doc == total


def test_every_token_is_packed_once(docs, clashing, empty):
    for capacity in (64, 2048):
        check_packed(docs, packing.pack(docs, capacity, shard_rows=16).collect(), capacity)
    assert sorted(map(str, packing.pack(clashing).collect())) == sorted(map(str, packing.pack(docs).collect()))
    assert packing.pack(empty).collect() == []
    with pytest.raises(ValueError):
        packing.pack(docs, 0)


def test_bins_are_nearly_full(spark):
    r = random.Random(5)
    docs = spark.createDataFrame([(i, prose(r, r.randint(1, 300)), None, None, 0) for i in range(500)], SCHEMA)
    rows = packing.pack(docs, 512).collect()
    assert sum(x["length"] for x in rows) / 512 / len({(x["shard"], x["bin"]) for x in rows}) > 0.9


def brute_mix(rows, weights, block_tokens, shard_rows, share, seed):
    docs = {}
    for i, text, source in rows:
        if i is not None:
            s, n = docs.get(i, (source or "", 0))
            docs[i] = min(s, source or ""), n + len(words_of(text))
    md5 = lambda *x: hashlib.md5("|".join(map(str, x)).encode()).hexdigest()
    shards, blocks = shards_for(len(rows), shard_rows), {}
    streams = collections.defaultdict(list)
    for i, (s, n) in docs.items():
        o = md5(seed, i)
        streams[int(o[:8], 16) % shards, s].append((o, i, n))
    for key, stream in streams.items():
        before = 0
        for _, i, n in sorted(stream):
            blocks[i] = before // block_tokens
            before += n
    kept = set()
    for shard in {k[0] for k in streams}:
        own = {s: max(1, -(-sum(n for _, _, n in stream) // block_tokens)) for (sh, s), stream in streams.items() if sh == shard}
        seats = sorted((-weights.get(s, 1.0) / (2 * k + 1), s, k) for s, n in own.items() for k in range(n))
        quota = collections.Counter(s for _, s, _ in seats[: int(share * len(seats))])
        for s in own:
            before = 0
            for _, i, n in sorted((md5(seed + 1, i), i, n) for _, i, n in streams[shard, s]):
                if quota[s] and before + n / 2 <= quota[s] * block_tokens:
                    kept.add((i, s, n, shard, blocks[i]))
                before += n
    return kept


@pytest.mark.parametrize(("share", "block", "shard"), [(0.7, 50, 20), (0.3, 2048, 1000), (1.0, 10, 7), (0.0, 10, 7)])
def test_mixture_equals_brute_force(docs, share, block, shard):
    weights = {"src0": 3.0, "src1": 0.5, "src3": 0.0}
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    got = mixing.mix(docs, weights, block, shard, share, 3).collect()
    assert {tuple(r) for r in got} == brute_mix(rows, weights, block, shard, share, 3)
    assert len(got) == len({r["doc_id"] for r in got})


def test_quotas_are_sainte_lague(spark):
    of = spark.createDataFrame([(0, s, 60) for s in "abc"], "shard int, source string, n long")
    got = {r["source"]: r["quota"] for r in mixing.quotas(of, {"a": 53.0, "b": 24.0, "c": 23.0}, 7 / 180 + 1e-9).collect()}
    assert got == {"a": 3, "b": 2, "c": 2}  # the textbook case in which highest averages by Jefferson's divisors give 4, 2, 1


def test_mixing_leaves_rows_as_they_are(docs, clashing, empty):
    chosen = {r["doc_id"] for r in mixing.mix(docs, share=0.5, block_tokens=50).collect()}
    rows = mixing.mixed(clashing, share=0.5, block_tokens=50)
    assert rows.columns == clashing.columns
    assert sorted(map(str, rows.collect())) == sorted(map(str, clashing.where(F.col("doc_id").isin(list(chosen))).collect()))
    assert mixing.mix(empty).collect() == []
    with pytest.raises(ValueError):
        mixing.mix(docs, share=2)


def test_long_documents_take_their_quota_by_tokens(spark):
    """Two sources of equal weight and equal tokens, one of them in documents of many blocks: each keeps its share of the tokens."""
    rows = [(i, "w " * 1000, None, "long", 2000) for i in range(20)] + [(100 + i, "w " * 10, None, "short", 20) for i in range(2000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = collections.Counter()
    for r in mixing.mix(docs, {}, 100, share=0.5).collect():
        got[r["source"]] += r["tokens"]
    assert abs(got["long"] - 10_000) <= 500 and abs(got["short"] - 10_000) <= 5
    assert mixing.mix(docs, {}, 100, share=1.0).count() == len(rows)
    assert mixing.mix(docs, {}, 100, share=0.0).count() == 0
