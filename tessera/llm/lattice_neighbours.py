"""Operator 3: near duplicates among embeddings by lattice hashing.

In each of several tables a random projection takes a vector to 8 m dimensions; each block of eight is decoded to the
nearest point of the E8 lattice, and the m points are the vector's cell. A vector is stored in its own cell and looked up in that and in
the neighbouring cells nearest to it. What meets in a cell is verified there by its cosine, and counts in the first table in which it meets.

Equal vectors are one node. Blocks and scale are those of the least estimated work for the number of nodes; the number of tables follows from the rate at
which simulated pairs of exactly the threshold's cosine meet, so that all but a fiftieth of such pairs are found, and more of closer ones. Pairs are
counted where they are found and never leave a task: of the cells of a bucket come their nodes' numbers of links and one edge for each node. Entries travel
packed, many to a row, so that the work for each is that of numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _hashing as H
from tessera.llm._shared import dropped, joined, written
from tessera.llm.components import components

THRESHOLD, PROBES, RECALL, SEED = 0.95, 1, 0.98, 3
#: So many vectors of one cell at most are held by one task; larger cells are divided among tasks.
HELD = 1 << 16
#: Vectors whose cells are found together, those whose entries are packed together, and entries in one packed row; cosines in one product of matrices, and pairs that are looked at together.
CHUNK, GATHER, PACKED, TILE, PAIRS = 2048, 1 << 14, 1 << 10, 1 << 19, 1 << 19
#: Logarithms of the scale and of the number of cells that random unit vectors take up in one block, as measured.
_SCALES, _LOG_CELLS = np.log([1.0, 1.4, 2.0, 2.8, 4.0]), np.array([9.83, 7.61, 5.29, 3.56, 2.20])
#: Seconds of an entry and of one multiplication in a comparison, for the estimate.
_ENTRY_S, _FLOP_S = 2e-5, 2e-11


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    pairs = [[(s if k == i else t if k == j else 0.0) for k in range(8)] for i, j in combinations(range(8), 2) for s in (1.0, -1.0) for t in (1.0, -1.0)]
    halves = [v for v in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(pairs + [list(v) for v in halves])


ROOTS = _roots()


def _worst(e: np.ndarray, least: bool = False) -> np.ndarray:
    """Where the largest (or least) of each column's values is first."""
    best, at = e[0].copy(), np.zeros(e.shape[1:], np.int64)
    for k in range(1, len(e)):
        here = e[k] < best if least else e[k] > best
        best[here], at[here] = e[k][here], k
    return at


def _shift(x: np.ndarray, at: np.ndarray, by: np.ndarray) -> None:
    """Adds ``by`` to the values at the rows ``at`` of each column."""
    where = at * at.size + np.arange(at.size).reshape(at.shape)
    x.reshape(-1)[where] += by


def _d8(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest integer vectors of even sum (first axis), and the squared distances: round, and where the sum is odd, round the worst coordinate the other way."""
    r = np.rint(y)
    e = y - r
    size = np.abs(e)
    worst = _worst(size)
    odd = np.bitwise_and(r.sum(0).astype(np.int64), 1)
    e_worst = np.take_along_axis(e, worst[None], 0)[0]
    _shift(r, worst, np.where(e_worst >= 0, 1.0, -1.0) * odd)
    return r, (e * e).sum(0) + odd * (1 - 2 * np.abs(e_worst))


def _decoded(y: np.ndarray) -> np.ndarray:
    (a, da), (b, db) = _d8(y), _d8(y - 0.5)
    return np.where(da <= db, a, b + 0.5)


def decode(y: np.ndarray) -> np.ndarray:
    """The nearest point of E8 (last axis), which is D8 and D8 shifted by a half in each coordinate."""
    return np.moveaxis(_decoded(np.ascontiguousarray(np.moveaxis(y, -1, 0))), 0, -1)


_FACTORS = [np.uint64(int(k) | 1) for k in np.random.default_rng(8).integers(0, 2**63, 8)]


def _hash(points: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each lattice point (first axis)."""
    twice = (points * 2).astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        h = twice[0] * _FACTORS[0]
        for k in range(1, 8):
            h += twice[k] * _FACTORS[k]
    return H.mix(h)


def _nearest_root(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The root that points most nearly the way of e (first axis), and how far e reaches that way: the signs of the two largest coordinates, or halves, of which an even number is negative."""
    size, sign = np.abs(e), np.where(e >= 0, 1.0, -1.0)
    first = _worst(size)
    rest = size.copy()
    _shift(rest, first, np.full(first.shape, -np.inf))
    second = _worst(rest)
    least = _worst(size, least=True)
    odd = np.bitwise_and((e < 0).sum(0), 1)
    reach = np.take_along_axis(size, first[None], 0)[0] + np.take_along_axis(size, second[None], 0)[0]
    halves = size.sum(0) / 2 - odd * np.take_along_axis(size, least[None], 0)[0]
    half = sign / 2
    _shift(half, least, -odd * np.take_along_axis(sign, least[None], 0)[0])
    two = np.zeros_like(e)
    for at in (first, second):
        _shift(two, at, np.take_along_axis(sign, at[None], 0)[0])
    return np.where(reach >= halves, two, half), np.maximum(reach, halves)


_projections: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}


def _projection(dim: int, table: int, blocks: int, scale: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    key = dim, table, blocks, scale, seed
    if key not in _projections:
        rng = np.random.default_rng([seed, table, blocks, dim])
        turn = np.ascontiguousarray((rng.standard_normal((dim, 8 * blocks)) / scale).T)
        _projections[key] = turn, rng.random(8 * blocks)[:, None]
    return _projections[key]


def cells(x: np.ndarray, table: int, blocks: int, scale: float, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """Hashes of the own cell (first) and of the ``probes`` cells nearest beside it in any block, a row for each unit vector."""
    if len(x) > CHUNK:
        return np.concatenate([cells(x[k : k + CHUNK], table, blocks, scale, probes, seed) for k in range(0, len(x), CHUNK)])
    turn, shift = _projection(x.shape[1], table, blocks, scale, seed)
    y = np.ascontiguousarray((turn @ x.T + shift).reshape(blocks, 8, len(x)).transpose(1, 0, 2))  # coordinate, block, vector
    own = _decoded(y)
    h = _hash(own)
    salt = np.full(len(x), np.uint64(table * 1000003 + x.shape[1]))
    out = [H.join_hashes([*h, salt])]
    if probes == 1:
        root, reach = _nearest_root(y - own)
        best = _worst(reach)[None, None]
        there = _hash(np.take_along_axis(own, best, 1)[:, 0] + np.take_along_axis(root, best, 1)[:, 0])
        out.append(H.join_hashes([*(np.where(best[0, 0] == c, there, h[c]) for c in range(blocks)), salt]))
    elif probes:
        closeness = np.einsum("cbn,rc->nbr", y - own, ROOTS).reshape(len(x), -1)
        rows = np.arange(len(x))
        for _ in range(probes):
            best = closeness.argmax(1)
            closeness[rows, best] = -np.inf
            b, r = best // 240, best % 240
            there = _hash(own[:, b, rows] + ROOTS[r].T)
            out.append(H.join_hashes([*(np.where(b == c, there, h[c]) for c in range(blocks)), salt]))
    return np.stack(out, axis=1)


def meeting_rate(cosine: float, dim: int, blocks: int, scale: float, probes: int = PROBES, seed: int = SEED, n: int = 2000) -> float:
    """The share of n random pairs of the given cosine that meet in one table."""
    rng = np.random.default_rng(seed)
    x, z = rng.standard_normal((2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    norm = np.linalg.norm(z, axis=1, keepdims=True)
    y = cosine * x + np.sqrt(max(0.0, 1 - cosine**2)) * z / np.where(norm == 0, 1, norm)
    a, b = cells(x, 0, blocks, scale, probes, seed), cells(y, 0, blocks, scale, probes, seed)
    return float(((a == b[:, :1]).any(1) | (b == a[:, :1]).any(1)).mean())


def plan(dim: int, n: int, threshold: float = THRESHOLD, probes: int = PROBES, recall: float = RECALL, seed: int = SEED) -> tuple[int, float, int]:
    """(blocks, scale, tables) for n nodes of one dimension: of those that give the recall, the ones of the least estimated work."""
    if dim < 2 or n < 2:
        return 1, 2.0, 0
    best = (np.inf, 1, 2.0, 1)
    for blocks in (1, 2, 3):
        for scale in (1.0, 1.2, 1.4, 1.7, 2.0, 2.4, 2.8):
            spread = np.exp(blocks * np.interp(np.log(scale), _SCALES, _LOG_CELLS))
            work = (1 + probes) * (_ENTRY_S + n / spread * 2 * dim * _FLOP_S)
            if work >= best[0]:  # one table at least
                continue
            rate = meeting_rate(threshold, dim, blocks, scale, probes, seed)
            tables = max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - min(max(rate, 1e-3), 0.999)))))
            best = min(best, (work * tables, blocks, scale, tables))
    return best[1:]


def _matrix(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the lists that are vectors of ``dim`` finite numbers with a length, and which these are."""
    ok = np.zeros(len(lists), dtype=bool)
    n = pa.compute.fill_null(pa.compute.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    right = np.flatnonzero(n == dim)
    if not len(right) or not dim:
        return np.zeros((0, dim), np.float32), ok
    x = lists.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    with np.errstate(all="ignore"):
        norm = np.sqrt((x * x).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    ok[right[good]] = True
    return (x[good] / norm[good][:, None] + 0.0).astype(np.float32), ok


def _rows_of_bytes(x: np.ndarray) -> pa.Array:
    """The bytes of each row."""
    x = np.ascontiguousarray(x)
    size = x.itemsize * x.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * size), pa.py_buffer(x)])


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which rows, their vectors) for each dimension in a column of vectors' bytes."""
    size = pa.compute.binary_length(column).to_numpy(zero_copy_only=False)
    for k in np.unique(size):
        at = np.flatnonzero(size == k)
        part = column.take(pa.array(at)) if len(at) < len(column) else column
        yield at, np.frombuffer(b"".join(part.to_pylist()), np.float32).reshape(len(at), -1)


def _key(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each vector's numbers."""
    bits = x.view(np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(len(x), x.shape[1], np.uint64)
        for k in range(x.shape[1]):
            h = H.mix(h * np.uint64(0x9E3779B97F4A7C15) + bits[:, k])
    return h.view(np.int64)


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, key, vector) of each row; a row without direction has neither key nor vector."""
    for batch in batches:
        n = pa.compute.fill_null(pa.compute.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        for dim in np.unique(n):
            here = batch.filter(pa.array(n == dim))
            for lo in range(0, here.num_rows, 4000):
                part = here.slice(lo, 4000)
                x, ok = _matrix(part.column(1), int(dim))
                good, bad = part.filter(pa.array(ok)), part.filter(pa.array(~ok))
                names = ["vec_id", "key", "vector"]
                if len(x):
                    yield pa.RecordBatch.from_arrays([good.column(0), pa.array(_key(x)), _rows_of_bytes(x)], names)
                if bad.num_rows:
                    yield pa.RecordBatch.from_arrays([bad.column(0), pa.nulls(bad.num_rows, pa.int64()), pa.nulls(bad.num_rows, pa.binary())], names)


def _record(dim: int) -> np.dtype:
    """An entry of a node in a cell, or in one block of a large one, as it is packed with others: their hash, the node, whether it only probes the cell, and its vector."""
    return np.dtype([("code", "<u8"), ("key", "<i8"), ("rep", "<i8"), ("n", "<i8"), ("probes", "<i8"), ("x", "<f4", (dim,))])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(key, rep, n, unit vectors) of about GATHER nodes of one dimension at a time."""
    held: dict[int, list[tuple]] = {}
    for batch in batches:
        columns = [batch.column(k).to_numpy() for k in range(3)]
        for at, x in _matrices(batch.column(3)):
            mine = held.setdefault(x.shape[1], [])
            mine.append((*(c[at] for c in columns), x))
            if sum(len(m[0]) for m in mine) >= GATHER:
                yield tuple(np.concatenate(c) for c in zip(*held.pop(x.shape[1])))
    for mine in held.values():
        yield tuple(np.concatenate(c) for c in zip(*mine))


def _counted(batches: Iterator[pa.RecordBatch], plans: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
    """(cell, n) of the nodes' own cells in all tables; a cell may come several times."""
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def summed() -> tuple[np.ndarray, np.ndarray]:
        cell, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
        return cell, np.bincount(at, weights=np.concatenate([n for _, n in found])).astype(np.int64)

    def rows() -> Iterator[pa.RecordBatch]:
        cell, n = summed()
        found.clear()
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], ["cell", "n"])

    for _, _, _, x in _gathered(batches):
        blocks, scale, tables, _, seed = plans[x.shape[1]]
        x = x.astype(np.float64)
        found.extend(np.unique(cells(x, k, blocks, scale, 0, seed)[:, 0].view(np.int64), return_counts=True) for k in range(tables))
        if sum(len(c) for c, _ in found) > 1 << 20:
            yield from rows()
    if found:
        yield from rows()


def _packed(batches: Iterator[pa.RecordBatch], table: int, plans: dict[int, tuple], large: dict[int, int], buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, asks, dim, records) of the nodes' entries in one table: each in its own cell, where it is held, in the other blocks of that cell, if it is large, and in the cells it probes."""
    big = np.array(sorted(large), np.int64)
    for key, rep, n, x in _gathered(batches):
        dim = x.shape[1]
        blocks, scale, tables, probes, seed = plans[dim]
        if table >= tables:
            continue
        every = cells(x.astype(np.float64), table, blocks, scale, probes, seed)
        rows, code, asks, probing = [], [], [], []
        for p in range(every.shape[1]):
            cell = every[:, p]
            parts = np.ones(len(cell), np.int64)
            if len(big):
                for c in np.intersect1d(cell.view(np.int64), big):
                    parts[cell.view(np.int64) == c] = large[int(c)]
            home = key % parts
            for b in range(int(parts.max())):
                here = np.flatnonzero(parts > b)
                rows.append(here)
                code.append(H.join_hashes([cell[here], np.full(len(here), b, np.uint64)]))
                asks.append((home[here] != b) | (p > 0))
                probing.append(np.full(len(here), p > 0))
        rows, code, asks, probing = (np.concatenate(v) for v in (rows, code, asks, probing))
        place = (code % np.uint64(buckets)).astype(np.int64) * 2 + asks
        order = np.argsort(place, kind="stable")
        rows, place = rows[order], place[order]
        records = np.empty(len(rows), _record(dim))
        records["code"], records["probes"] = code[order], probing[order]
        for name, column in (("key", key), ("rep", rep), ("n", n), ("x", x)):
            records[name] = column[rows]
        cuts = np.flatnonzero(np.diff(place)) + 1
        starts = np.concatenate([np.arange(lo, hi, PACKED) for lo, hi in zip([0, *cuts], [*cuts, len(place)])])
        data = [records[lo:hi].tobytes() for lo, hi in zip(starts, [*starts[1:], len(place)])]
        for k in range(0, len(data), 256):
            at = place[starts[k : k + 256]]
            yield pa.RecordBatch.from_arrays([pa.array((at // 2).astype(np.int32)), pa.array((at % 2).astype(np.int8)), pa.array(np.full(len(at), dim, np.int32)), pa.array(data[k : k + 256], pa.binary())], ["bucket", "asks", "dim", "records"])


def _cells_of(x: np.ndarray, at: np.ndarray, table: int, how: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The cells in ``table`` of the vectors that ``at`` names, each found once, and the row of each of ``at`` among them."""
    there = np.zeros(len(x), bool)
    there[at] = True
    blocks, scale, _, probes, seed = how
    return cells(x[there].astype(np.float64), table, blocks, scale, probes, seed), (np.cumsum(there) - 1)[at]


def _first_met(xa: np.ndarray, i: np.ndarray, xb: np.ndarray, j: np.ndarray, table: int, how: tuple, probing: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which of the pairs of xa[i] and xb[j] that met in ``table`` are to count: those that met in no table before; and of two that both ask for the other's cell, the one that asks ``first``."""
    left = np.arange(len(i))
    for t in range(table + 1):
        if not len(left) or t == table and not probing[left].any():
            break
        (a, p), (b, q) = _cells_of(xa, i[left], t, how), _cells_of(xb, j[left], t, how)
        own_a, own_b = a[p, 0], b[q, 0]
        b_asks = np.zeros(len(left), bool)
        for k in range(1, b.shape[1]):
            b_asks |= b[q, k] == own_a
        if t == table:
            left = left[~(probing[left] & ~first[left] & b_asks)]
        else:
            met = b_asks | (own_a == own_b)
            for k in range(1, a.shape[1]):
                met |= a[p, k] == own_b
            left = left[~met]
    return left


def _linked(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least of the nodes 0 to n - 1 that links (a, b) connect each one with."""
    least = np.arange(n)
    while True:
        la, lb = least[a], least[b]
        apart = la != lb
        if not apart.any():
            return least
        a, b = a[apart], b[apart]
        np.minimum.at(least, np.maximum(la, lb)[apart], np.minimum(la, lb)[apart])
        while (least != (above := least[least])).any():
            least = above


class _Bucket:
    """The nodes of one dimension that are held in the cells of one bucket, sorted by cell; asked by others and by themselves, it says which are near."""

    def __init__(self, records: np.ndarray, table: int, how: tuple, threshold: float):
        self.table, self.how, self.threshold = table, how, threshold
        self.records, self.x, self.at = self._sorted(records)
        self.codes = self.records["code"][self.at[:-1]]

    def _sorted(self, records: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(records["code"], kind="stable")
        x, records = records["x"][order], records[["code", "key", "rep", "n", "probes"]][order]
        return records, x, np.concatenate([[0], np.flatnonzero(records["code"][1:] != records["code"][:-1]) + 1, [len(records)]])

    def themselves(self) -> Iterator[pa.RecordBatch]:
        def tiles():
            for lo, hi in zip(self.at[:-1], self.at[1:]):
                if hi - lo > 1:
                    step = max(1, TILE // (hi - lo))
                    for k in range(lo, hi, step):
                        yield k, min(k + step, hi), k, hi

        yield from self._near(self.records, self.x, tiles(), True)

    def asked(self, records: np.ndarray) -> Iterator[pa.RecordBatch]:
        records, x, at = self._sorted(records)
        code = records["code"][at[:-1]]
        there = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)

        def tiles():
            for g in np.flatnonzero(self.codes[there] == code):
                lo, hi = self.at[there[g]], self.at[there[g] + 1]
                step = max(1, TILE // (hi - lo))
                for k in range(at[g], at[g + 1], step):
                    yield k, min(k + step, at[g + 1]), lo, hi

        yield from self._near(records, x, tiles(), False)

    def _near(self, records: np.ndarray, x: np.ndarray, tiles: Iterator[tuple], same: bool) -> Iterator[pa.RecordBatch]:
        i, j, size = [], [], 0
        for a, b, lo, hi in tiles:
            s = (x[a:b] @ self.x[lo:hi].T).ravel()
            found = np.flatnonzero(s >= self.threshold - 1e-5)
            if same and len(found) == b - a:  # each with itself
                continue
            p, q = np.divmod(found, hi - lo)
            p, q, s = p + a, q + lo, s[found]
            keep = q > p if same else records["key"][p] != self.records["key"][q]
            unsure = np.flatnonzero(keep & (s < self.threshold + 1e-5))
            if len(unsure):
                u, v = x[p[unsure]].astype(np.float64), self.x[q[unsure]].astype(np.float64)
                keep[unsure] = np.einsum("ij,ij->i", u, v) / np.sqrt((u * u).sum(1) * (v * v).sum(1)) >= self.threshold - 1e-9
            i.append(p[keep])
            j.append(q[keep])
            size += len(i[-1])
            if size >= PAIRS:
                yield from self._counted(records, x, np.concatenate(i), np.concatenate(j), same)
                i, j, size = [], [], 0
        if size:
            yield from self._counted(records, x, np.concatenate(i), np.concatenate(j), same)

    def _counted(self, records: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray, same: bool) -> Iterator[pa.RecordBatch]:
        """(key, links, rep, root) of the nodes of the pairs that are to count. A node that asks in another block of its own cell is asked back there, so it alone is counted here."""
        mine = self.records
        probing = records["probes"][i] != 0
        new = _first_met(x, i, self.x, j, self.table, self.how, probing, records["key"][i] < mine["key"][j])
        i, j, probing = i[new], j[new], probing[new]
        if not len(i):
            return
        shift = 0 if same else len(mine)
        nodes, at = np.unique(np.concatenate([i + shift, j]), return_inverse=True)
        a, b = at[: len(i)], at[len(i) :]
        every = mine if same else np.concatenate([mine, records])
        links = np.bincount(a, weights=mine["n"][j], minlength=len(nodes)) + np.bincount(b, weights=records["n"][i] * (probing | same), minlength=len(nodes))
        rep = every["rep"][nodes]
        yield pa.RecordBatch.from_arrays([pa.array(every["key"][nodes]), pa.array(links.astype(np.int64)), pa.array(rep), pa.array(rep[_linked(a, b, len(nodes))])], ["key", "links", "rep", "root"])


def _meet(batches: Iterator[pa.RecordBatch], table: int, plans: dict[int, tuple], threshold: float) -> Iterator[pa.RecordBatch]:
    """(key, links, rep, root) of the nodes that have links in a bucket's cells, from packed entries sorted by bucket, those that are held first; a node may come several times."""
    held: dict[int, list[np.ndarray]] = {}
    asking: dict[int, list[np.ndarray]] = {}
    opened: dict[int, _Bucket] = {}

    def settle(dim: int) -> Iterator[pa.RecordBatch]:
        if dim in held:
            opened[dim] = _Bucket(np.concatenate(held.pop(dim)), table, plans[dim], threshold)
            yield from opened[dim].themselves()
        if dim in asking and dim in opened:
            yield from opened[dim].asked(np.concatenate(asking[dim]))
        asking.pop(dim, None)

    def close() -> Iterator[pa.RecordBatch]:
        for dim in sorted({*held, *asking}):
            yield from settle(dim)
        opened.clear()

    bucket = None
    for batch in batches:
        for at, asks, dim, data in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if at != bucket:
                yield from close()
                bucket = at
            (asking if asks else held).setdefault(dim, []).append(np.frombuffer(data, _record(dim)))
            if asks and sum(map(len, asking[dim])) >= HELD:
                yield from settle(dim)
    yield from close()


def near_classes(vectors: DataFrame, threshold: float = THRESHOLD, probes: int = PROBES, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """(vec_id, class_id, links) for each row: its class and the number of other rows of a cosine of ``threshold`` or more.

    A class is what links connect, and its id is the least vec_id in it. Vectors of each dimension are held against one another. Equal directions are linked; repeated
    rows are rows like others, and rows that share a vec_id are in one class. A null vector and one without direction (empty, all zero, not finite or holding a
    null) has no links and its own vec_id as class. A row without a vec_id gives no row. Other columns are not read. An empty table gives no rows. There are no ties.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    if probes < 1:
        raise ValueError("probes must be at least 1")
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).where("vec_id is not null")
    made = rows.mapInArrow(_prepared, "vec_id long, key long, vector binary")
    nodes = written(made.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vector").alias("vector")), "lattice-nodes")
    sizes = nodes.groupBy((F.length("vector") / 4).cast("int").alias("dim")).count().collect()  # a row for each dimension
    plans = {r["dim"]: (*plan(r["dim"], r["count"], threshold, probes, recall, seed), probes, seed) for r in sizes}
    tables = max([0, *(p[2] for p in plans.values())])
    total_nodes = sum(r["count"] for r in sizes)
    large: dict[int, int] = {}
    if total_nodes > HELD:
        counts = nodes.select("key", "rep", "n", "vector").mapInArrow(lambda batches: _counted(batches, plans), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
        large = {r["cell"]: -(-r["n"] // HELD) for r in counts.where(F.col("n") > HELD).collect()}  # at most tables * nodes / HELD
    buckets = max(1, -(-total_nodes // GATHER))
    found = []
    for t in range(tables):
        entries = nodes.select("key", "rep", "n", "vector").mapInArrow(lambda batches, t=t: _packed(batches, t, plans, large, buckets), "bucket int, asks byte, dim int, records binary")
        by = entries.repartition("bucket").sortWithinPartitions("bucket", "asks")
        found.append(written(by.mapInArrow(lambda batches, t=t: _meet(batches, t, plans, threshold), "key long, links long, rep long, root long"), "lattice-found", {"spark.sql.execution.arrow.maxBytesPerBatch": "8m"}))
    ids = written(made.select("vec_id", "key"), "lattice-ids")
    total = ids.count()
    links = nodes.select("key", "rep", "n", F.lit(0).cast("long").alias("links"))
    edges = spark.createDataFrame([], "a long, b long")
    for f in found:
        links = links.unionByName(f.select("key", F.lit(None).cast("long").alias("rep"), F.lit(0).cast("long").alias("n"), "links"))
        edges = edges.unionByName(f.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = links.groupBy("key").agg(F.min("rep").alias("rep"), F.sum("n").alias("n"), F.sum("links").alias("links"))
    # Rows of one vec_id with several vectors
    several = ids.groupBy("vec_id").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a != b").select("vec_id")
    edges = edges.unionByName(ids.join(several, "vec_id").join(nodes.select("key", "rep"), "key").select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    classes = components(edges)
    by_key = written(links.join(classes, links["rep"] == classes["node"], "left").select("key", "n", F.coalesce("least", "rep").alias("class_id"), (F.col("links") + F.col("n") - 1).alias("links")), "lattice-classes")
    dropped(nodes, *found)
    return joined(ids.where("key is not null"), by_key, "key", "n", total).select("vec_id", "class_id", "links").unionByName(ids.where("key is null").select("vec_id", F.col("vec_id").alias("class_id"), F.lit(0).cast("long").alias("links")))
