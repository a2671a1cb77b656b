"""Operator 7: links between documents whose sets of word n-grams have a Jaccard similarity of at least t, as classes and numbers of links.

An exact set-similarity self-join. Every gram has a place in one total order, rare ones first; two sets of
similarity t or more share a gram among the first |x| - ceil(t |x|) + 1 of each. The order follows a histogram
of all grams of the corpus over a fixed number of hash cells: how well it tells rare from frequent decides only
how many candidates arise, never which pairs are found. Equal sets are one, with the number of
its rows; copies are never expanded into pairs. Candidates come from an equi-join on prefix grams under the length and positional filters; a pair goes
on from the first of its common prefix grams as far as two carried predecessors tell, and is made distinct. A suffix
filter compares counts of grams by hash range, which are a sixteenth as large as the sets; what passes is verified once by exact intersection.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _hashing as H
from tessera.llm._shared import dropped, joined, written
from tessera.llm.components import components

N, THRESHOLD = 3, 0.5
CELL_BITS, CHUNK_BITS = 22, 16
#: Bits of the arrays (16 MB) that tell most documents apart from copies or candidates before a join does so exactly.
FILTER_BITS = 1 << 27
PAIRS_PER_GROUP, PARTS = 20_000, 16


def _as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _survey(docs: DataFrame, n: int) -> DataFrame:
    """One pass over all texts: a hash of each row's set (null for one without words), and each task's counts of grams by hash cell."""

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, dtype=np.uint32)
        names = ["doc_id", "set", "chunk", "cells"]
        for batch in batches:
            for first, part in H.pieces(batch.column(1), 1 << 21):
                sets = list(H.ngram_sets(part, n))
                lens = np.array([len(s) for s in sets])
                marks = np.zeros((3, len(sets)), dtype=np.uint64)
                with np.errstate(over="ignore"):
                    for i, s in enumerate(sets):
                        marks[:, i] = len(s), s.sum(), H.mix(s).sum()
                if lens.any():
                    cells += np.bincount((np.concatenate(sets) >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(cells)).astype(np.uint32)
                none = pa.nulls(len(sets))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), pa.array(_as_signed(H.join_hashes(list(marks))), mask=lens == 0), none.cast(pa.int32()), none.cast(pa.binary())], names)
        pack = zstandard.ZstdCompressor(level=1)
        for k, part in enumerate(cells.reshape(-1, 1 << CHUNK_BITS)):
            if part.any():
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array([k], pa.int32()), pa.array([pack.compress(part.tobytes())], pa.binary())], names)

    return docs.mapInArrow(survey, "doc_id long, set long, chunk int, cells binary")


def _histogram(survey: DataFrame) -> np.ndarray:
    """For each hash cell the logarithm, in at most 256 steps, of the number of grams of all documents in it."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << CHUNK_BITS, dtype=np.uint64)
        for blob in pdf["cells"]:
            total += np.frombuffer(zstandard.decompress(blob), dtype=np.uint32)
        steps = np.minimum(255, np.round(np.log2(1 + total.astype(float)) * 6)).astype(np.uint8)
        return pd.DataFrame({"chunk": pdf["chunk"][:1], "cells": [steps.tobytes()]})

    cells = np.zeros(1 << CELL_BITS, dtype=np.uint8)
    for k, blob in survey.where("chunk is not null").select("chunk", "cells").groupBy("chunk").applyInPandas(add, "chunk int, cells binary").collect():
        cells[k << CHUNK_BITS : (k + 1) << CHUNK_BITS] = np.frombuffer(blob, dtype=np.uint8)  # 2 ** CELL_BITS bytes in all, whatever the input
    return cells


def _bit_array(ids: DataFrame) -> tuple[int, Broadcast]:
    """A bit array of at most FILTER_BITS with the bits of the ids set: what has no bit there is surely none of them, what has one may be another."""
    ids = ids.toDF("id")
    bits = min(FILTER_BITS, 1 << max(10, int(np.ceil(np.log2(16 * max(1, ids.count()))))))
    cell = F.pmod(F.xxhash64("id"), F.lit(bits))
    rows = ids.select(F.shiftright(cell, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), cell.bitwiseAND(63).cast("int")).alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    words = np.zeros(bits >> 6, dtype=np.int64)
    words[rows["at"].to_numpy()] = rows["bit"].to_numpy()
    return bits, ids.sparkSession.sparkContext.broadcast(words.tobytes())


def _with_bit(docs: DataFrame, of: tuple[int, Broadcast], wanted: bool, then: Callable | None = None, schema: str = "doc_id long, text string") -> DataFrame:
    """The rows (doc_id, text) whose id has a bit in the array, or, if not ``wanted``, those whose id has none; ``then`` works on their batches in the same process."""
    bits, shared = of

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.frombuffer(shared.value, dtype=np.int64)
        for batch in batches:
            at = batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["doc_id", "text"]).filter(pa.array(((words[at >> 6] >> (at & 63)) & 1 == 1) == wanted))

    return docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("at")).mapInArrow((lambda batches: then(pick(batches))) if then else pick, schema)


POSTING = "gram long, rep long, place long, before long"


def _postings(n: int, t: float, shared: Broadcast) -> Callable:
    """Makes of batches (doc_id, text): gram, rep, place (size * 2**32 + position), the two grams before it in the prefix as 32 bits each; rare grams come first."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in batches:
            for first, part in H.pieces(batch.column(1), 1 << 21):
                out, size = [], []
                for s in H.ngram_sets(part, n):
                    order = np.argsort(cells[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)], kind="stable")
                    out.append(s[order[: len(s) - int(np.ceil(t * len(s) - 1e-9)) + 1]])
                    size.append(len(s))
                k = np.array([len(x) for x in out])
                g = np.concatenate(out)
                pos = np.arange(len(g)) - np.repeat(np.cumsum(k) - k, k)
                low = g & np.uint64(0xFFFFFFFF)
                one, two = np.where(pos >= 1, np.roll(low, 1), 0), np.where(pos >= 2, np.roll(low, 2), 0)
                place = np.repeat(np.array(size, dtype=np.int64), k) << 32 | pos
                ids = np.repeat(batch.column(0).slice(first, len(k)).to_numpy(), k)
                yield pa.RecordBatch.from_arrays([pa.array(_as_signed(g)), pa.array(ids), pa.array(place), pa.array(_as_signed(one << np.uint64(32) | two))], ["gram", "rep", "place", "before"])

    return prefixes


def _candidates(postings: DataFrame, t: float) -> DataFrame:
    """(a, part, bs): with each a all b > a that it has to be held against, each once; by the hash of b in PARTS lists at most."""
    a = postings.select("gram", *(F.col(c).alias(f"{c}_a") for c in ("rep", "place", "before")))
    b = postings.select("gram", *(F.col(c).alias(f"{c}_b") for c in ("rep", "place", "before")))
    size = {s: F.shiftright(f"place_{s}", 32) for s in "ab"}
    pos = {s: F.col(f"place_{s}").bitwiseAND(0xFFFFFFFF) for s in "ab"}
    one = {s: F.shiftrightunsigned(f"before_{s}", 32) for s in "ab"}
    two = {s: F.col(f"before_{s}").bitwiseAND(0xFFFFFFFF) for s in "ab"}
    # The positional bound is that of a pair's first common gram; at later ones it may drop only what came up before.
    need = F.ceil(F.lit(t / (1 + t)) * (size["a"] + size["b"]) - F.lit(1e-9))
    fits = (F.least(size["a"], size["b"]) >= F.lit(t) * F.greatest(size["a"], size["b"]) - F.lit(1e-9)) & (F.least(size["a"] - pos["a"], size["b"] - pos["b"]) >= need)
    seen = ((one["a"] != 0) & ((one["a"] == one["b"]) | (one["a"] == two["b"]))) | ((two["a"] != 0) & ((two["a"] == two["b"]) | (two["a"] == one["b"])))
    return a.join(b, "gram").where((F.col("rep_a") < F.col("rep_b")) & fits & ~seen).groupBy(F.col("rep_a").alias("a"), F.pmod(F.xxhash64("rep_b"), F.lit(PARTS)).cast("int").alias("part")).agg(F.collect_set("rep_b").alias("bs"))


def _bins(grams: np.ndarray) -> bytes:
    """Counts of the grams by hash range, about as many ranges as grams, in four bits each; nothing if a count needs more."""
    k = max(4, int(np.round(np.log2(max(1, len(grams))))))
    n = np.bincount((grams >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k)
    return b"" if n.max() > 15 else (n[0::2] << 4 | n[1::2]).astype(np.uint8).tobytes()


def _unbin(data: bytes) -> np.ndarray:
    x = np.frombuffer(data, np.uint8)
    return np.stack([x >> 4, x & 15], axis=1).ravel()


def _most_common(x: np.ndarray, y: np.ndarray) -> int:
    """A bound on what two sets share, from their counts by range: the suffix filter."""
    if not len(x) or not len(y):
        return 1 << 62
    while len(x) > len(y):
        x = x[0::2] + x[1::2]
    while len(y) > len(x):
        y = y[0::2] + y[1::2]
    return int(np.minimum(x, y).sum())


def _packed(grams: np.ndarray) -> bytes:
    """The upper 40 bits of each gram; at two thousand grams a pair shares a false one with a probability of four in a million."""
    return np.sort(grams >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view(np.int64).ravel()


def _common(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) < len(y):
        x, y = y, x
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    return int((x[at] == y).sum())


def _checked(docs: DataFrame, pairs: DataFrame, n: int, threshold: float, exact: bool) -> DataFrame:
    """Of rows (a, bs, group) those pairs that pass the suffix filter, or, if exact, those that are similar; ``scores`` go with the bs.

    What each group needs of its documents is made from their texts. Most other documents are left out before
    the shuffle by a bit array.
    """
    wanted = written(pairs.select("group", F.explode(F.concat(F.array("a"), "bs")).alias("rep")).distinct(), "ngram-wanted")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in H.pieces(batch.column(1), 1 << 21):
                sets = list(H.ngram_sets(part, n))
                data = pa.array([_packed(s) if exact else _bins(s) for s in sets], pa.binary())
                size = np.array([len(s) for s in sets], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), pa.array(size), data], ["rep", "size", "data"]).filter(pa.array(size > 0))

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        of = {rep: (size, _unpacked(data) if exact else _unbin(data)) for rep, size, data in zip(right["rep"].to_pylist(), right["size"].to_pylist(), right["data"].to_pylist())}
        out: dict[str, list] = {"a": [], "bs": [], "scores": [], "group": []}
        for a, bs, group in zip(left["a"].to_pylist(), left["bs"].to_pylist(), left["group"].to_pylist()):
            kept: dict[int, float] = {}
            n_x, x = of[a]
            for b in bs:
                n_y, y = of[b]
                both = _common(x, y) if exact else _most_common(x, y)
                if both >= threshold / (1 + threshold) * (n_x + n_y) - 1e-9:
                    kept[b] = both / max(1, n_x + n_y - both) if exact else 1.0
            if kept:
                for name, v in zip(out, (a, list(kept), list(kept.values()), group)):
                    out[name].append(v)
        return pa.table({"a": pa.array(out["a"], pa.int64()), "bs": pa.array(out["bs"], pa.list_(pa.int64())), "scores": pa.array(out["scores"], pa.list_(pa.float64())), "group": pa.array(out["group"], pa.int32())})

    data = wanted.join(_with_bit(docs, _bit_array(wanted.select("rep").distinct()), True, make, "rep long, size int, data binary"), "rep")
    made = written(pairs.groupBy("group").cogroup(data.groupBy("group")).applyInArrow(check, "a long, bs array<long>, scores array<double>, group int"), "ngram-checked")
    dropped(wanted)
    return made


def _in_groups(candidates: DataFrame) -> DataFrame:
    """(a, bs, group): rows of one neighbourhood come together, so that few groups need the same document; large ones are divided."""
    least = candidates.select(F.explode(F.concat(F.array("a"), "bs")).alias("x"), "a").groupBy("x").agg(F.min("a").alias("label"))
    labelled = candidates.join(least.withColumnRenamed("x", "a"), "a")
    sizes = labelled.groupBy("label").agg(F.ceil(F.sum(F.size("bs")) / PAIRS_PER_GROUP).alias("parts"))
    total = candidates.agg(F.sum(F.size("bs"))).first()[0] or 0
    groups = max(1, -(-total // PAIRS_PER_GROUP))
    part = F.pmod(F.xxhash64("a", "part"), F.col("parts"))
    return labelled.join(sizes, "label").select("a", "bs", F.pmod(F.xxhash64("label", part), F.lit(groups)).cast("int").alias("group"))


def similar_sets(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For docs (doc_id, text) of ids that differ: (rows, sets, pairs) with (doc_id, set) of each row, (set, rep, n) of each set of grams, and (a, b, jaccard) of representatives."""
    survey = written(_survey(docs, n), "ngram-survey")
    rows = written(survey.where("chunk is null").select("doc_id", "set"), "ngram-rows")
    sets = written(rows.where("set is not null").groupBy("set").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "ngram-sets")
    total = rows.count()
    copies = written(joined(rows.where("set is not null"), sets.where("n > 1"), "set", "n", total).where("doc_id != rep").select("doc_id"), "ngram-copies")
    bits = _bit_array(copies)
    histogram = docs.sparkSession.sparkContext.broadcast(_histogram(survey).tobytes())
    dropped(survey)
    # Of copies one is taken. What has no bit is none; the others, which are few, are held against the copies' ids.
    make = _postings(n, threshold, histogram)
    postings = _with_bit(docs, bits, False, make, POSTING).unionByName(_with_bit(docs, bits, True).join(copies, "doc_id", "left_anti").mapInArrow(make, POSTING))
    candidates = written(_candidates(postings, threshold), "ngram-candidates")
    groups = written(_in_groups(candidates), "ngram-groups")
    dropped(candidates, copies)
    likely = _checked(docs, groups, n, threshold, exact=False)
    dropped(groups)
    similar = _checked(docs, likely.drop("scores"), n, threshold, exact=True)
    dropped(likely)
    pairs = written(similar.select("a", F.explode(F.arrays_zip("bs", "scores")).alias("s")).select("a", F.col("s.bs").alias("b"), F.col("s.scores").alias("jaccard")), "ngram-pairs")
    dropped(similar)
    return rows, sets, pairs


def near_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, links) for each row: its class and the number of other rows of similarity ``threshold`` or more.

    A class is what links connect, and its id is the least doc_id in it. Words are runs of anything but ASCII white space, in lower case; a text of fewer than n words
    is one gram of all its words. A text without words has no links and its own doc_id as class; a row without a doc_id gives no row. Rows that
    share a doc_id each count and are in one class. Texts of any length are read whole. Other columns are not read. The order of equally rare grams follows their hashes, so ties change nothing.
    An empty table gives no rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    names = None
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        names = written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "ngram-named")
        docs = names.select(F.col("row").alias("doc_id"), "text")
    rows, sets, pairs = similar_sets(docs, n, threshold)
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = both.join(sets.select(F.col("rep").alias("b"), "n"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    by_set = sets.join(links, "rep", "left").select("set", "rep", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("links"))
    total = rows.count()

    def labelled(classes: DataFrame, label: str) -> DataFrame:
        """Rows with the least node of what their set's representative is connected to."""
        of = written(by_set.join(classes, by_set["rep"] == classes["node"], "left").select("set", "n", F.coalesce("least", "rep").alias(label), "links"), "ngram-classes")
        return joined(rows.where("set is not null"), of, "set", "n", total).select("doc_id", label, "links").unionByName(rows.where("set is null").select("doc_id", F.col("doc_id").alias(label), F.lit(0).cast("long").alias("links")))

    classes = components(pairs)
    if names is None:
        made = labelled(classes, "class_id")
        dropped(pairs, sets)
        return made
    # Classes are those of rows so far; rows of one doc_id bring theirs together.
    named = written(labelled(classes, "label").join(names.select(F.col("row").alias("doc_id"), F.col("doc_id").alias("name")), "doc_id").select("name", "label", "links"), "ngram-labelled")
    least = named.groupBy("label").agg(F.min("name").alias("least_name"), F.count("*").alias("n"))
    ends = joined(named, written(least, "ngram-least"), "label", "n", total)
    merged = components(ends.where("name != least_name").select(F.col("name").alias("a"), F.col("least_name").alias("b")))
    return ends.join(merged, ends["name"] == merged["node"], "left").select(F.col("name").alias("doc_id"), F.coalesce("least", "name").alias("class_id"), "links")


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without the near duplicates: of each class of ``near_classes`` the one of the least doc_id stays.

    All columns stay as they are, and so do rows without a doc_id or without words, very long texts too. Rows that share a doc_id stay or go together, but
    equal rows of one doc_id stay as often as they come. An empty table stays empty.
    """
    gone = near_classes(docs, n, threshold).where("doc_id != class_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone"], "left_anti")
