"""Operator 6 for any order: stupid-backoff scores of all documents from the n-gram counts of the whole corpus, every count used.

A word w after the context h = (.., u, v) scores log(c(h, w) / c(h)) where the corpus has (h, w) at least ``min_count`` times; else
h loses its first word and log(alpha) is added, again and again; without context a word scores log(c(w) / N). With ``held_out``,
which is the default, c and N leave out what the scored row itself holds: a sequence that no other row has is unseen, however rare or frequent in its own row.

Occurrences are partitioned by the last context word v, so that c(h) and c(h, w) of all contexts that end in v meet there in one exchange.
A word with more than RECORDS occurrences is partitioned by (v, w) instead; of its contexts, c(v) and the most frequent longer ones go to all workers, and other longer ones are counted and joined.
The 2**20 most frequent words have codes by rank, which pack well, and their counts go to all workers; other words' counts are joined where needed.
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
from tessera.llm.backoff_scores import ALPHA, _look_up, _words, unigrams

ORDER, RECORDS, CODED, PIECE, BUCKETS_A_TASK, RARE_BITS = 3, 1 << 20, 1 << 20, 1 << 22, 8, 1 << 27
#: Codes of words: 0 is none.
RARE, FIRST = 1, 2
#: Documents whose sums travel together, binary places of these, and keys of the numbers of words.
SHARD_DOCS, PLACES, SHARDS = 1 << 16, float(1 << 28), 1 << 20


def _planes(x: np.ndarray, width: int) -> bytes:
    """The lowest bytes of all numbers, then the next ones, and so on."""
    return np.ascontiguousarray(x.astype(np.uint64)).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


class _Planes:
    def __init__(self, data: bytes):
        self.data, self.at = np.frombuffer(data, np.uint8), 0

    def take(self, n: int, width: int) -> np.ndarray:
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = self.data[self.at : self.at + n * width].reshape(width, n).T
        self.at += n * width
        return x.view(np.uint64).ravel()


def _extended(w: np.ndarray, count: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Words with a 0 after each row, the row of each, and where its 1st, 2nd, .. word before it is (-1: none)."""
    count = np.asarray(count, np.int64)
    full = np.where(count > 0, count + 1, 0)
    row = np.repeat(np.arange(len(count)), full)
    start = np.cumsum(full) - full
    place = np.arange(len(row)) - start[row]
    ext = np.zeros(len(row), np.uint64)
    ext[place < count[row]] = w
    return ext, row, [np.where(place >= k, np.arange(len(row)) - k, -1) for k in range(1, order)]


def _at(x: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.where(places >= 0, x[places], x.dtype.type(0))


def _times(keys: np.ndarray) -> np.ndarray:
    """How often each key occurs."""
    if not len(keys):
        return np.zeros(0, np.int64)
    order = np.argsort(keys)
    s = keys[order]
    n = np.diff(np.append(np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])), len(s)))
    out = np.empty(len(s), np.int64)
    out[order] = np.repeat(n, n)
    return out


def _with(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    return H.join_hashes([h, x])


def _pair_key(h: np.ndarray) -> np.ndarray:
    """A key that no word has: words have 48 bits."""
    return (h & np.uint64((1 << 61) - 1)) | np.uint64(1 << 61)


def _contexts(before: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of the last 1, 2, .. context words."""
    out = [before[0]]
    for x in before[1:]:
        out.append(_with(out[-1], x))
    return out


def _frequent(counts: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """The least count that no more than CODED keys (word, n) reach, and these keys in order with their counts."""
    sizes = counts.groupBy("n").count().toArrow()
    by_n = np.argsort(-sizes["n"].to_numpy())
    enough = np.cumsum(sizes["count"].to_numpy()[by_n]) <= CODED
    least = int(sizes["n"].to_numpy()[by_n][enough][-1]) if enough.any() else (1 << 62)
    most = counts.where(F.col("n") >= least).select("word", "n").toArrow()
    word, n = most["word"].to_numpy().astype(np.uint64), most["n"].to_numpy().astype(np.int64)
    by = np.argsort(word)
    return least, word[by], n[by]


def ngram_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, min_count: int = 1, held_out: bool = True) -> DataFrame:
    """(doc_id, n_tokens, log_score, mean_log_score) as ``backoff_scores.scores`` gives them, which this is at order 2 and ``held_out`` False.

    With ``held_out`` each row is scored by all other rows; a word that they lack counts once, and so does an N of 0. Repeated rows count
    for one another. Null, empty and wordless texts, null ids and repeated ids are as in ``scores``.
    """
    if not 0 < alpha <= 1 or min_count < 1 or order < 2:
        raise ValueError("alpha must be in (0, 1], min_count at least 1 and order at least 2")
    spark = docs.sparkSession
    counts = written(unigrams(docs), "unigrams")
    total = int(counts.agg(F.sum("n")).first()[0] or 0)
    least, word, n = _frequent(counts)
    rank = np.empty(len(word), np.int64)
    rank[np.argsort(-n, kind="stable")] = np.arange(len(word))
    shared = spark.sparkContext.broadcast((word.tobytes(), n.tobytes(), rank.astype(np.int32).tobytes()))
    limit = RECORDS
    hot_words = word[n > limit]
    hot_shared = spark.sparkContext.broadcast(hot_words.tobytes())
    buckets = max(1, -(-total // RECORDS))
    shards = max(1, -(-docs.count() // SHARD_DOCS))
    piece = PIECE
    # Of words without a code most occur once, which needs no join: a bit array has the others, and a few that it takes for such.
    rare = counts.where((F.col("n") < least) & (F.col("n") > 1))
    bits = min(RARE_BITS, 1 << max(10, int(np.ceil(np.log2(16 * max(1, rare.count()))))))
    at = F.col("word").bitwiseAND(bits - 1)
    marks = rare.select(F.shiftright(at, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int")).alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    rows_of_bits = np.zeros(bits >> 6, np.int64)
    rows_of_bits[marks["at"].to_numpy()] = marks["bit"].to_numpy()
    rare_shared = spark.sparkContext.broadcast(rows_of_bits.tobytes())

    def table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.frombuffer(shared.value[0], np.uint64), np.frombuffer(shared.value[1], np.int64), np.frombuffer(shared.value[2], np.int32)

    def several(w: np.ndarray) -> np.ndarray:
        """Which of the words without a code may occur more than once."""
        x, at = np.frombuffer(rare_shared.value, np.int64), (w & np.uint64(bits - 1)).astype(np.int64)
        return x[at >> 6] >> (at & 63) & 1 == 1

    def is_hot(v: np.ndarray) -> np.ndarray:
        hot = np.frombuffer(hot_shared.value, np.uint64)
        return _look_up(hot, np.ones(len(hot), np.int64), v) > 0

    def long_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How often each context of two and more words that ends in a hot word occurs."""
        for batch in batches:
            for _, part in H.pieces(batch.column(0), piece):
                w, count = _words(part)
                if not len(w):
                    continue
                ext, _, places = _extended(w, count, order)
                before = [_at(ext, p) for p in places]
                hot = is_hot(before[0])
                for k, h in enumerate(_contexts(before)):
                    if k:
                        key, m = np.unique(_pair_key(h[hot & (before[k] > 0)]), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(m.astype(np.int64))], ["word", "n"])

    wanted = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    contexts = written(wanted.select("text").mapInArrow(long_contexts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "ngram-contexts") if len(hot_words) and order > 2 else None
    # The most frequent of these contexts go to all workers; the others' counts are joined.
    frequent = _frequent(contexts.where("n > 1"))[1:] if contexts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    context_shared = spark.sparkContext.broadcast((frequent[0].tobytes(), frequent[1].tobytes()))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, _, ranks = table()
        for batch in batches:
            for first, part in H.pieces(batch.column(1), piece):
                w, count = _words(part)
                if not len(w):
                    continue
                ids = batch.column(0).slice(first, len(part)).to_numpy(zero_copy_only=False).astype(np.int64)
                worded = np.flatnonzero(count)
                lengths = np.stack([ids[worded], np.asarray(count, np.int64)[worded]])
                yield pa.RecordBatch.from_arrays([pa.array([-1 - int(ids[0]) % SHARDS], pa.int32()), pa.array([zstandard.ZstdCompressor(level=1).compress(lengths.tobytes())], pa.binary())], ["bucket", "grams"])
                ext, row, places = _extended(w, count, order)
                code = _look_up(keys, ranks.astype(np.int64) + FIRST, ext)
                code[(code == 0) & (ext > 0)] = RARE
                before = [_at(ext, p) for p in places]
                hot = is_hot(before[0])
                bucket = np.where(before[0] == 0, ext, np.where(hot, _with(before[0], ext), before[0]))
                bucket = (H.mix(bucket) % np.uint64(buckets)).astype(np.int64)
                bucket[hot & (ext == 0)] = buckets  # a hot word's contexts are counted elsewhere
                own = []
                if held_out:
                    rows = row.astype(np.uint64)
                    own.append(_times(_with(rows, ext)))
                    for h in _contexts(before):
                        m = np.zeros(len(ext), np.int64)
                        m[hot] = _times(_with(rows[hot], h[hot]))
                        own.append(m)
                by = np.argsort(bucket, kind="stable")
                at = np.searchsorted(bucket[by], np.arange(buckets + 1))
                packer = zstandard.ZstdCompressor(level=1)
                for b in range(buckets):
                    if at[b] == at[b + 1]:
                        continue
                    here = by[at[b] : at[b + 1]]
                    r, per = np.unique(row[here], return_counts=True)
                    parts = [np.array([len(here), len(r)], np.uint32).tobytes(), _planes(np.diff(ids[r], prepend=0), 8), _planes(count[r], 4), _planes(per, 4)]
                    # v takes few values in a bucket: each once, then places in their list
                    v, place = np.unique(np.where(code[places[0][here]] == RARE, 0, code[places[0][here]]) * (places[0][here] >= 0), return_inverse=True)
                    parts += [np.array([len(v)], np.uint32).tobytes(), _planes(np.diff(v, prepend=0), 3), _planes(place, 3)]
                    rare = before[0][here][(v[place] == 0) & (before[0][here] > 0)]
                    parts += [_planes((before[0][here] > 0)[v[place] == 0], 1), _planes(rare, 6)]
                    for x, c in [(_at(ext, p), _at(code, p)) for p in (q[here] for q in places[1:])] + [(ext[here], code[here])]:
                        parts += [_planes(c, 3), _planes(x[c == RARE], 6)]
                    parts += [_planes(m[here], 4) for m in own]
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([packer.compress(b"".join(parts))], pa.binary())], ["bucket", "grams"])

    def unpack(blob: bytes, by_rank: np.ndarray) -> tuple:
        data = zstandard.decompress(blob)
        n, n_rows = (int(x) for x in np.frombuffer(data, np.uint32, 2))
        r = _Planes(data[8:])
        ids, length, per = np.cumsum(r.take(n_rows, 8).astype(np.int64)), r.take(n_rows, 4), r.take(n_rows, 4)
        n_v = int(r.take(1, 4)[0])
        v = np.cumsum(r.take(n_v, 3))
        c = v[r.take(n, 3).astype(np.int64)]
        odd = np.flatnonzero(c == 0)
        is_rare = odd[r.take(len(odd), 1) > 0]
        c[is_rare] = RARE

        def words(c: np.ndarray) -> np.ndarray:
            x = np.zeros(n, np.uint64)
            known = c >= FIRST
            x[known] = by_rank[(c[known] - np.uint64(FIRST)).astype(np.int64)]
            rare = c == RARE
            x[rare] = r.take(int(rare.sum()), 6)
            return x

        columns = [words(c)]
        for _ in range(order - 1):
            columns.append(words(r.take(n, 3)))
        own = [r.take(n, 4).astype(np.int32) for _ in range(order)] if held_out else [np.zeros(n, np.int32)] * order
        return columns, own, np.repeat(np.arange(n_rows), per.astype(np.int64)), ids, length.astype(np.int64)

    def solved(blobs: list[bytes], keys: np.ndarray, values: np.ndarray, by_rank: np.ndarray):
        """Sums by document, and (key, doc_id, sign, own) of the counts to be joined, of the records of one bucket."""
        parts = [unpack(b, by_rank) for b in blobs]
        base = np.cumsum([0, *(len(p[3]) for p in parts)])
        row = np.concatenate([p[2] + b for p, b in zip(parts, base)])
        ids, length = np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts])
        columns = [np.concatenate([p[0][k] for p in parts]) for k in range(order)]
        own = [np.concatenate([p[1][k] for p in parts]) for k in range(order)]
        del parts
        before, w = columns[:-1], columns[-1]
        del columns
        rows = row.astype(np.uint64)
        known_v = _look_up(keys, values, before[0])
        hot = known_v > limit
        frequent_contexts = np.frombuffer(context_shared.value[0], np.uint64), np.frombuffer(context_shared.value[1], np.int64)
        open_, score, steps, asked = w > 0, np.zeros(len(w)), np.zeros(len(w), np.int64), []
        hs = _contexts(before)
        for k in range(order - 1, 0, -1):
            h = hs[k - 1]
            gram = _with(h, w)
            c, ch = _times(gram), _times(h)
            if held_out:
                c = c - _times(_with(gram, rows))
                ch = ch - _times(_with(h, rows))
            valid = open_ & (before[k - 1] > 0)
            hit = valid & (c >= min_count)
            score[hit] += np.log(c[hit])
            if k == 1:
                ch = np.where(hot, known_v - own[1], ch)
                done = hit
            else:
                at = np.flatnonzero(hit & hot)
                known = _look_up(*frequent_contexts, _pair_key(h[at]))
                ch[at] = known - own[k][at]
                far = np.zeros(len(hit), bool)
                far[at[known == 0]] = True
                done = hit & ~far
                asked.append((_pair_key(h[far]), row[far], np.full(int(far.sum()), -1, np.int8), own[k][far]))
            score[done] -= np.log(ch[done])
            steps[valid & ~hit] += 1
            open_ &= ~hit
            del h, gram, c, ch
        score += steps * np.log(alpha)
        n_w = _look_up(keys, values, w)
        others = np.maximum(total - (length[row] if held_out else 0), 1)
        score[open_] -= np.log(others[open_] if held_out else others)
        near = open_ & (n_w > 0)
        score[near] += np.log(np.maximum(n_w[near] - own[0][near], 1))
        far = open_ & (n_w == 0)  # what occurs once adds log(1)
        far[far] = several(w[far])
        asked.append((w[far], row[far], np.ones(int(far.sum()), np.int8), own[0][far]))
        doc, at = np.unique(ids, return_inverse=True)
        key, r, sign, m = (np.concatenate(x) for x in zip(*asked))
        return (doc, np.bincount(at[row], weights=score, minlength=len(doc))), (key.astype(np.int64), ids[r], sign, m)

    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("sign", pa.int8()), ("own", pa.int32()), ("shard", pa.int32()), ("sums", pa.binary())])

    def of_documents(doc: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Sums of scores, packed by shards of documents; ids rise and scores have 28 binary places."""
        by = np.lexsort((doc, doc % shards))
        doc, score, shard = doc[by], score[by], doc[by] % shards
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(doc)]]) if len(doc) else []
        packer = zstandard.ZstdCompressor(level=1)
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            data = _planes(np.diff(doc[lo:hi], prepend=0), 8) + _planes(np.rint(score[lo:hi] * PLACES).astype(np.int64), 8)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(schema)[:4]), pa.array([shard[lo]], pa.int32()), pa.array([packer.compress(data)], pa.binary())], schema=schema)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, ranks = table()
        by_rank = np.empty(len(keys), np.uint64)
        by_rank[ranks] = keys
        doc, score = np.zeros(0, np.int64), np.zeros(0)

        def groups() -> Iterator[tuple[int, list[bytes]]]:
            held, last = [], None
            for batch in batches:
                for b, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if held and (b != last or b < 0):
                        yield last, held
                        held = []
                    held.append(blob.as_py())
                    last = b
            if held:
                yield last, held

        for b, blobs in groups():
            if b < 0:
                ids, n = np.frombuffer(zstandard.decompress(blobs[0]), np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int64()), pa.array(ids), pa.nulls(len(n), pa.int8()), pa.array(n.astype(np.int32)), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], schema=schema)
                continue
            (more, sums), (key, of, sign, m) = solved(blobs, keys, values, by_rank)
            for i in range(0, len(key), 1 << 18):
                part = slice(i, i + (1 << 18))
                k = len(key[part])
                yield pa.RecordBatch.from_arrays([pa.array(key[part]), pa.array(of[part]), pa.array(sign[part]), pa.array(m[part].astype(np.int32)), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], schema=schema)
            doc, at = np.unique(np.concatenate([doc, more]), return_inverse=True)
            score = np.bincount(at, weights=np.concatenate([score, sums]), minlength=len(doc))
            if len(doc) > 1 << 21:
                yield from of_documents(doc, score)
                doc, score = doc[:0], score[:0]
        yield from of_documents(doc, score)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of documents, of rows sorted by shard."""
        docs_, scores_, last = [], [], None

        def whole() -> tuple[np.ndarray, np.ndarray]:
            doc, at = np.unique(np.concatenate(docs_), return_inverse=True)
            return doc, np.bincount(at, weights=np.concatenate(scores_), minlength=len(doc))

        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if docs_ and (shard != last or sum(map(len, docs_)) > 1 << 21):
                    doc, score = whole()
                    docs_, scores_ = [doc], [score]
                    if shard != last:
                        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(score)], ["doc_id", "score"])
                        docs_, scores_ = [], []
                data = np.frombuffer(zstandard.decompress(blob.as_py()), np.uint8)
                r, n = _Planes(data), len(data) // 16
                docs_.append(np.cumsum(r.take(n, 8).astype(np.int64)))
                scores_.append(r.take(n, 8).astype(np.int64) / PLACES)
                last = shard
        if docs_:
            doc, score = whole()
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(score)], ["doc_id", "score"])

    packed = wanted.mapInArrow(records, "bucket int, grams binary")
    tasks = max(1, -(-buckets // BUCKETS_A_TASK))
    rows = packed.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(solve, "key long, doc_id long, sign byte, own int, shard int, sums binary")
    rows = written(rows, "ngram-sums")
    known = counts.where((F.col("n") < least) & (F.col("n") > 1)).select("word", F.col("n").alias("known"))
    if contexts:
        known = known.unionByName(contexts.select("word", F.col("n").alias("known")))
    asked = rows.where("key is not null").join(known, rows["key"] == known["word"], "left")
    # A word that the bit array takes for a more frequent one isn't known and occurs once.
    terms = asked.groupBy("doc_id").agg(F.sum(F.col("sign") * F.log(F.greatest(F.coalesce("known", F.lit(1)) - F.col("own"), F.lit(1)))).alias("score"))
    sums = rows.where("shard is not null").select("shard", "sums").repartition("shard").sortWithinPartitions("shard").mapInArrow(added, "doc_id long, score double")
    lengths = rows.where("key is null and shard is null").groupBy("doc_id").agg(F.sum("own").alias("n"))
    none = F.lit(0).cast("long").alias("n")
    both = terms.select("doc_id", "score", none).unionByName(sums.select("doc_id", "score", none)).unionByName(lengths.select("doc_id", F.lit(0.0).alias("score"), "n")).groupBy("doc_id").agg(F.sum("n").alias("n_tokens"), F.sum("score").alias("score"))
    return both.select("doc_id", "n_tokens", F.round("score", 3).alias("log_score"), F.round(F.col("score") / F.col("n_tokens"), 6).alias("mean_log_score"))
