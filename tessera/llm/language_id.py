"""Operator 2: hierarchical language identification.

Linear support vector machines on hashed byte bigrams and trigrams decide between families of languages first, pair
by pair, and then, pair by pair, between the languages of the winning family. Whether a text is in the language found at all is told by how
likely its n-grams are in the likeliest of the languages: it is rejected below a floor that stretches of held-out texts of its length stay above, however short it is.
All this is fitted on every labelled row. A hash of each row says whether it is for fitting or for the floors. Gram counts and floors are those of all rows of their half; a machine is
the mean, by rows, of machines fitted on shards that together hold all rows of the other half, whatever the partitions. Every byte of every text is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _hashing as H

FAMILIES: dict[str, tuple[str, ...]] = {"germanic": ("de", "en"), "romance": ("es", "fr")}
#: About as many rows are fitted together, in one shard; there are as many shards as all rows take up.
TRAIN_ROWS = 1600
#: What weights are multiplied by when they are summed as integers, so that the order of shards doesn't matter; steps of likelihoods of stretches when these are counted; partial sums that the driver gets.
FIXED, STEPS, PARTS = 2.0**20, 1 << 10, 8
BITS = 13
#: Share of held-out stretches of each length that stay above the floor, how far below them it lies, and these lengths in grams, from 8 to 8192.
KEEP, SLACK, LENGTHS = 0.998, 0.5, 2 ** np.arange(3, 14)
STRETCHES = 8
#: Bytes that are looked up together.
SLICE = 1 << 18

_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@dataclass
class Model:
    """weights: a row for each hash cell (the last is for no gram), a column for each machine, then the log probabilities in each language by name; pairs: what each machine tells apart; floors: by LENGTHS."""

    weights: np.ndarray
    bias: np.ndarray
    pairs: list[tuple[str, str]]
    families: dict[str, tuple[str, ...]]
    floors: np.ndarray


def _folded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The folded bytes of all texts, in which runs of anything but letters are one space, and where each text begins."""
    raw, at = H.flat(pc.utf8_lower(texts))
    x = _FOLD[raw]
    keep = x != 32
    keep[1:] |= x[:-1] != 32
    ends = np.zeros(len(at), np.int64)
    for k in range(0, len(x), SLICE):  # the number kept before each text, without eight bytes for each byte
        here = np.searchsorted(at, k, "right"), np.searchsorted(at, k + SLICE, "right")
        part = np.cumsum(keep[k : k + SLICE])
        ends[here[0] : here[1]] += part[at[here[0] : here[1]] - k - 1]
        ends[here[1] :] += part[-1]
    return x[keep], ends


def _cells(x: np.ndarray, at: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash cells of the bigrams and trigrams that begin at the places lo to hi; grams across texts have the last cell."""
    part = x[lo : hi + 2].astype(np.uint32)
    part = np.concatenate([part, np.zeros(hi + 2 - lo - len(part), np.uint32)])
    pair = part[:-1] << np.uint32(8) | part[1:]
    two = (pair[:-1] + np.uint32(1)) * np.uint32(2654435761) >> np.uint32(32 - BITS)
    three = ((pair[:-1] << np.uint32(8) | part[2:]) + np.uint32(7)) * np.uint32(2246822519) >> np.uint32(32 - BITS)
    ends = at[1:][at[1:] > at[:-1]]
    for back, cells in ((1, (two, three)), (2, (three,))):
        e = ends - back
        e = e[(e >= lo) & (e < hi)] - lo
        for c in cells:
            c[e] = 1 << BITS
    return two, three


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash cells of bigrams and trigrams of the folded bytes of all texts, and where each text begins."""
    x, at = _folded(texts)
    return *_cells(x, at, 0, len(x)), at


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the rows of values from at[i] to at[i + 1]."""
    out = np.zeros((len(at) - 1, *values.shape[1:]), dtype=np.float64)
    some = at[1:] > at[:-1]
    if some.any():
        out[some] = np.add.reduceat(values, at[:-1][some], axis=0, dtype=np.float64)
    return out


def _counts(texts: pa.Array) -> Iterator[np.ndarray]:
    """How many grams of each text have each hash cell."""
    x, at = _folded(texts)
    for i in range(len(texts)):
        n = np.zeros(1 << BITS, np.int64)
        for lo in range(at[i], at[i + 1], SLICE):
            for cells in _cells(x, at[i : i + 2], lo, min(lo + SLICE, at[i + 1])):
                n += np.bincount(cells, minlength=(1 << BITS) + 1)[:-1]
        yield n


def features(texts: pa.Array) -> np.ndarray:
    """Relative frequencies of the hash cells, a row for each text."""
    out = np.zeros((len(texts), 1 << BITS), dtype=np.float32)
    for i, n in enumerate(_counts(texts)):
        out[i] = n / max(1, n.sum())
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 0) -> tuple[np.ndarray, float]:
    """A linear machine with hinge loss by dual coordinate descent; y is -1 or 1. The bias is a feature of its own."""
    scale = np.float32(1 / max(1e-9, np.sqrt((x * x).sum(1).mean())))
    x = np.concatenate([x * scale, np.full((len(x), 1), 0.3, np.float32)], axis=1)
    w, alpha, norm = np.zeros(x.shape[1], np.float32), np.zeros(len(x)), (x * x).sum(1)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            g = y[i] * float(w @ x[i]) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cost)
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                alpha[i] = new
    return w[:-1] * scale, float(w[-1] * 0.3)


def languages(model: Model) -> list[str]:
    return sorted(m for members in model.families.values() for m in members)


def _raw(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The machines' values, mean log probabilities of the grams in each language, and the number of grams, of each text."""
    x, at = _folded(texts)
    none = 1 << BITS
    total, n = np.zeros((len(texts), model.weights.shape[1])), np.zeros(len(texts))
    for lo in range(0, len(x), SLICE):
        hi = min(lo + SLICE, len(x))
        two, three = _cells(x, at, lo, hi)
        some = slice(max(0, np.searchsorted(at, lo, "right") - 1), np.searchsorted(at, hi, "left"))
        here = np.clip(at[some.start : some.stop + 1], lo, hi) - lo
        for cells in (two, three):
            total[some] += _sums(model.weights[cells], here)
        n[some] += _sums((two != none).astype(np.int32) + (three != none), here)
    mean, k = total / np.maximum(n, 1)[:, None], len(model.pairs)
    return mean[:, :k] + model.bias, mean[:, k:], n


def floor_at(n: np.ndarray, model: Model) -> np.ndarray:
    """The floor for texts of n grams; between LENGTHS it changes with the logarithm."""
    return np.interp(np.log(np.maximum(n, 1)), np.log(LENGTHS), model.floors)


def _stretches(texts: pa.Array, model: Model) -> list[np.ndarray]:
    """For each of LENGTHS the likelihoods of STRETCHES stretches of each text, or the whole of a shorter one. Long texts are read in slices."""
    x, at = _folded(texts)
    found: list[list[np.ndarray]] = [[] for _ in LENGTHS]
    weights = model.weights[:, len(model.pairs) :]
    for i in range(len(texts)):
        n = max(0, 2 * (at[i + 1] - at[i]) - 3)
        ways = [(k, min(length, n)) for k, length in enumerate(LENGTHS) if n and n >= length // 2]
        if not ways:
            continue
        starts = np.stack([np.linspace(0, n - size, STRETCHES).astype(int) for _, size in ways])
        ends = starts + np.array([size for _, size in ways])[:, None]
        places, where = np.unique(np.stack([starts, ends]), return_inverse=True)
        sums, before = np.zeros((len(places), weights.shape[1])), np.zeros(weights.shape[1])
        for lo in range(at[i], at[i + 1], SLICE):
            grams = np.stack(_cells(x, at[i : i + 2], lo, min(lo + SLICE, at[i + 1])), axis=1).ravel()
            total = np.cumsum(np.concatenate([before[None], weights[grams]]), axis=0, dtype=np.float64)
            first = 2 * (lo - at[i])
            here = (places >= first) & (places <= first + len(grams))
            sums[here] = total[places[here] - first]
            before = total[-1]
        a, b = sums[where.reshape(2, len(ways), STRETCHES)]
        for (k, size), likely in zip(ways, (b - a).max(2)):
            found[k].append(likely / size)
    return [np.concatenate(f) if f else np.zeros(0) for f in found]


def _above(low: np.ndarray) -> np.ndarray:
    """The floors, from the least likelihoods that are to stay above them (-inf where there are none): longer stretches never have a lower one."""
    some = np.isfinite(low)
    return np.maximum.accumulate(np.where(some, low, low[some].min(initial=0.0) if some.any() else -1e9) - SLACK)


def _floors(texts: pa.Array, model: Model) -> np.ndarray:
    """For each of LENGTHS the floor under the stretches of the texts."""
    return _above(np.array([np.quantile(v, 1 - KEEP) if len(v) else -np.inf for v in _stretches(texts, model)]))


def decide(values: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Family, language and margin (the smaller one of the two decisions') of each row of values. Ties go to the first by name."""
    column = {p: i for i, p in enumerate(model.pairs)}

    def contest(names: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
        if len(names) == 1:
            return np.zeros(len(values), dtype=int), np.full(len(values), np.inf)
        wins, least = np.zeros((len(values), len(names))), np.full((len(values), len(names)), np.inf)
        for (i, a), (j, b) in combinations(enumerate(names), 2):
            v = values[:, column[a, b]]
            wins[:, i] += v >= 0
            wins[:, j] += v < 0
            least[:, i], least[:, j] = np.minimum(least[:, i], v), np.minimum(least[:, j], -v)
        best = np.argmax(wins * 1e6 + np.clip(least, -1e5, 1e5), axis=1)
        return best, np.abs(least[np.arange(len(values)), best])

    names = tuple(sorted(model.families))
    which, margin = contest(names)
    language = np.empty(len(values), dtype=object)
    for k, family in enumerate(names):
        members = tuple(sorted(model.families[family]))
        best, inner = contest(members)
        here = which == k
        language[here] = np.array(members, dtype=object)[best[here]]
        margin[here] = np.minimum(margin[here], inner[here])
    return np.array(names, dtype=object)[which], language, margin


def _contests(families: dict[str, tuple[str, ...]]) -> list[tuple[str, str]]:
    """What each machine tells apart: pairs of families, then pairs of languages in a family."""
    return [*combinations(sorted(families), 2), *(p for f in sorted(families) for p in combinations(sorted(families[f]), 2))]


def _shard(texts: pa.Array, languages: list[str], families: dict[str, tuple[str, ...]]) -> tuple[list[tuple[np.ndarray, float, int]], list[np.ndarray]]:
    """(weights, bias, rows) of each machine fitted on these rows, and the gram counts of each language by name."""
    x, lang = features(texts), np.array(languages, dtype=object)
    of = {m: f for f, members in families.items() for m in members}
    fam = np.array([of[v] for v in lang], dtype=object)
    machines = []
    for k, pair in enumerate(_contests(families)):
        names = fam if pair[0] in families and k < len(families) * (len(families) - 1) // 2 else lang
        use = (names == pair[0]) | (names == pair[1])
        machines.append((*(fit_svm(x[use], np.where(names[use] == pair[0], 1.0, -1.0)) if use.any() else (np.zeros(1 << BITS, np.float32), 0.0)), int(use.sum())))
    return machines, [sum(_counts(texts.filter(pa.array(lang == m))), np.zeros(1 << BITS, np.int64)) for m in sorted(of)]


def _model(machines: list[tuple[np.ndarray, float]], counts: list[np.ndarray], families: dict[str, tuple[str, ...]]) -> Model:
    weights = np.zeros(((1 << BITS) + 1, len(machines) + len(counts)), np.float32)
    for k, (w, _) in enumerate(machines):
        weights[:-1, k] = w
    for k, n in enumerate(counts):
        weights[:-1, len(machines) + k] = np.log((n + 0.5) / (n + 0.5).sum())
    return Model(weights, np.array([b for _, b in machines], dtype=float), _contests(families), {f: tuple(m) for f, m in families.items()}, np.full(len(LENGTHS), -1e9))


def fit(texts: pa.Array, languages: list[str], families: dict[str, tuple[str, ...]] = FAMILIES) -> Model:
    """The machines and probabilities from the even rows, as one shard; the floors of the rejection from the odd ones."""
    machines, counts = _shard(texts.take(pa.array(np.arange(0, len(texts), 2))), languages[::2], families)
    model = _model([m[:2] for m in machines], counts, families)
    if len(texts) > 1:
        model.floors = _floors(texts.take(pa.array(np.arange(1, len(texts), 2))), model)
    return model


def _labelled(docs: DataFrame, families: dict[str, tuple[str, ...]]) -> DataFrame:
    return docs.where(F.col("lang").isin([m for members in families.values() for m in members]) & F.col("text").isNotNull())


def sample(docs: DataFrame, families: dict[str, tuple[str, ...]] = FAMILIES, rows: int = TRAIN_ROWS) -> pa.Table:
    """(text, lang) of the ``rows`` labelled rows whose ids hash lowest: the same ones whatever the partitions. For a look at the rows; nothing is fitted on it."""
    order = F.xxhash64(F.lit(17), "doc_id")
    labelled = _labelled(docs, families).where("doc_id is not null")
    return labelled.select(order.alias("h"), "text", "lang").orderBy("h", "text").limit(rows).select("text", "lang").toArrow()


def trained(docs: DataFrame, families: dict[str, tuple[str, ...]] = FAMILIES, rows: int = TRAIN_ROWS) -> Model:
    """The model of all labelled rows, null ids and repeated rows included, in shards of about ``rows``. Texts go to a half and a shard by their hashes, so equal ones stay together."""
    spark = docs.sparkSession
    labelled = _labelled(docs, families).select("text", "lang", F.xxhash64(F.lit(17), "text", "lang").alias("h"))
    fitting = labelled.where("h % 2 = 0")
    shards = -(-fitting.count() // rows)
    n_machines, n = len(_contests(families)), sum(map(len, families.values()))
    if not shards:
        machines, counts = [(np.zeros(1 << BITS), 0.0)] * n_machines, [np.zeros(1 << BITS, np.int64)] * n
    else:

        def fitted(table: pa.Table) -> pa.Table:
            table = table.sort_by([("h", "ascending"), ("lang", "ascending"), ("text", "ascending")])
            texts = table["text"].combine_chunks()
            made, counted = _shard(texts, table["lang"].to_pylist(), families)
            sums = [np.rint(np.append(w.astype(np.float64), b) * FIXED).astype(np.int64) * k for w, b, k in made] + [np.append(c, 0) for c in counted]
            return pa.table({"k": pa.array(range(len(sums)), pa.int32()), "rows": pa.array([m[2] for m in made] + [0] * len(counted), pa.int64()), "sums": pa.array([v.tobytes() for v in sums], pa.binary())})

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, list] = {}
            for batch in batches:
                for k, m, v in zip(*(c.to_pylist() for c in batch.columns)):
                    mine = total.setdefault(k, [0, np.zeros((1 << BITS) + 1, np.int64)])
                    mine[0] += m
                    mine[1] += np.frombuffer(v, np.int64)
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([m for m, _ in total.values()], pa.int64()), pa.array([v.tobytes() for _, v in total.values()], pa.binary())], ["k", "rows", "sums"])

        schema = "k int, rows long, sums binary"
        parts = fitting.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards))).groupBy("shard").applyInArrow(fitted, schema).repartition(PARTS).mapInArrow(added, schema).toArrow()
        total = {r["k"]: (r["rows"], np.frombuffer(r["sums"], np.int64)) for b in added(iter(parts.to_batches())) for r in b.to_pylist()}  # a few times PARTS rows at most
        mean = [total[k][1] / (FIXED * max(1, total[k][0])) for k in range(n_machines)]
        machines, counts = [(w[:-1], float(w[-1])) for w in mean], [total[n_machines + k][1][:-1] for k in range(n)]
    model = _model(machines, counts, families)
    shared = spark.sparkContext.broadcast(model)

    def stretched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(LENGTHS)
        for batch in batches:
            for _, part in H.pieces(batch.column(0), 1 << 21):
                for k, v in enumerate(_stretches(part, shared.value)):
                    step, at = np.unique(np.concatenate([seen[k][0], np.floor(v * STEPS).astype(np.int64)]), return_inverse=True)
                    seen[k] = step, np.bincount(at, weights=np.concatenate([seen[k][1], np.ones(len(v))]), minlength=len(step)).astype(np.int64)
        for k, (step, count) in enumerate(seen):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(step), k, np.int32)), pa.array(step), pa.array(count)], ["k", "step", "n"])

    found = labelled.where("h % 2 != 0").select("text").mapInArrow(stretched, "k int, step long, n long").groupBy("k", "step").agg(F.sum("n").alias("n")).toArrow().sort_by([("k", "ascending"), ("step", "ascending")])
    k, step, count = (found[c].to_numpy() for c in ("k", "step", "n"))
    if len(k):
        low = np.full(len(LENGTHS), -np.inf)
        for length in np.unique(k):
            upto = np.cumsum(count[k == length])
            low[length] = step[k == length][np.searchsorted(upto, (1 - KEEP) * (upto[-1] - 1), "right")] / STEPS
        model.floors = _above(low)
    shared.unpersist()
    return model


def judged(texts: pa.Array, model: Model) -> list[pa.Array]:
    """Family, language, margin, likelihood, and whether it is accepted, for each text."""
    values, likelihood, n = _raw(texts, model)
    family, language, margin = decide(values, model)
    likely = likelihood.max(1)
    empty = n == 0
    accepted = ~empty & (likely >= floor_at(n, model))
    none = pa.array(empty)
    return [
        pc.if_else(none, pa.scalar(None, pa.string()), pa.array(family, pa.string())),
        pc.if_else(none, pa.scalar(None, pa.string()), pa.array(language, pa.string())),
        pc.if_else(none, pa.scalar(None, pa.float64()), pa.array(np.round(margin, 6))),
        pc.if_else(none, pa.scalar(None, pa.float64()), pa.array(np.round(likely, 6))),
        pa.array(accepted),
    ]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, family, language, margin, likelihood, accepted) for each row, repeated rows and null ids included.

    A text that is null, empty or without two adjoining letters has no language and isn't accepted. Otherwise a text is rejected if its likelihood, the mean log
    probability of its grams in the likeliest language, lies below the floor for its number of grams. Texts of any length are read whole, in slices. Decisions that tie go to the first by name. Other columns are not read. An empty table gives no rows; without labelled rows the machines are all 0,
    so every text has the first language by name and is accepted.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in H.pieces(batch.column(1), 1 << 21):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), *judged(part, shared.value)], ["doc_id", "family", "language", "margin", "likelihood", "accepted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, family string, language string, margin double, likelihood double, accepted boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that ``identify`` accepts, with all their columns, whatever these are called; what it says of nulls, empty and long texts, repeated rows and ties holds here too. An empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in H.pieces(batch.column(at), 1 << 21):
                yield batch.slice(first, len(part)).filter(judged(part, shared.value)[-1])

    return docs.mapInArrow(run, docs.schema)
