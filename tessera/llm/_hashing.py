"""Hashes of the words and n-grams of whole Arrow batches of texts in numpy, without a Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_rng.integers(0, 2**63)) * 2 + 1
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; kept, and grown by doubling."""
    p = _powers.get(base)
    if p is None or len(p) < n:
        p = np.ones(1, dtype=U)
        with np.errstate(over="ignore"):
            while len(p) < max(n, 1 << 16):
                p = np.concatenate([p, p * U(pow(base, len(p), 2**64))])
        _powers[base] = p
    return p[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts on end, and where each begins (one more than texts); a null is empty."""
    texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset :]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, dtype=np.uint8)
    return raw, at - at[0]


def pieces(texts: pa.Array, most: int = 1 << 22):
    """(first, part) slices of texts of about ``most`` bytes, so that memory doesn't grow with the batch."""
    n = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(n)
    i = 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right")))
        yield i, texts.slice(i, j - i)
        i = j


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-case words of all texts in order, and the number of words of each text."""
    parts = [_words(part) for _, part in pieces(texts, 1 << 20)]
    if not parts:
        return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
    return (parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts)))


def _words(texts: pa.Array, slice_: int = (1 << 18) - 1) -> tuple[np.ndarray, np.ndarray]:
    """As ``words``; bytes are taken in slices, and the value of a word that goes on in the next slice is carried into it."""
    raw, at = flat(pc.utf8_lower(texts))
    if not len(raw):
        return np.zeros(0, dtype=U), np.zeros(len(at) - 1, dtype=np.int64)
    values, lengths, starts = [], [], []
    with np.errstate(over="ignore"):
        for lo in range(0, len(raw), slice_):
            part = raw[lo : lo + slice_]
            inside = ~_SPACE[part]
            first = np.zeros(len(part) + 1, dtype=bool)
            first[at[np.searchsorted(at, lo) : np.searchsorted(at, lo + len(part), "right")] - lo] = True  # a text's first byte never goes on with the word before it
            start = np.flatnonzero(inside & (first[:-1] | np.concatenate([[True], ~inside[:-1]])))
            end = np.flatnonzero(inside & (first[1:] | np.concatenate([~inside[1:], [True]]))) + 1
            sums = np.zeros(len(part) + 1, dtype=U)
            np.cumsum(_BYTE[part] * _power(_BASE, len(part)), out=sums[1:])
            value, length = (sums[end] - sums[start]) * _power(_INVERSE, len(part) + 1)[start], (end - start).astype(U)
            if lo and inside[0] and not first[0] and not _SPACE[raw[lo - 1]]:
                k = next(i for i in reversed(range(len(values))) if len(values[i]))
                values[k][-1] += value[0] * U(pow(_BASE, int(lengths[k][-1]), 2**64))
                lengths[k][-1] += length[0]
                value, length, start = value[1:], length[1:], start[1:]
            values.append(value)
            lengths.append(length)
            starts.append(start + lo)
        h = mix(np.concatenate(values) + np.concatenate(lengths))
    return h, np.diff(np.searchsorted(np.concatenate(starts), at))


def join_hashes(parts: list[np.ndarray]) -> np.ndarray:
    """Hashes of sequences of words, from aligned arrays of the hashes of their words."""
    with np.errstate(over="ignore"):
        g = mix(parts[0] + U(len(parts)))
        for p in parts[1:]:
            g = mix(g * U(0x9E3779B97F4A7C15) + p)
    return g


def ngram_sets(texts: pa.Array, n: int):
    """Sorted distinct hashes of the word n-grams of each text; a shorter text has one gram of all its words, an empty one none."""
    h, count = words(texts)
    g = join_hashes([h[i : len(h) - n + 1 + i] for i in range(n)]) if len(h) >= n else np.zeros(0, dtype=U)
    at = np.concatenate([[0], np.cumsum(count)])
    for i, k in enumerate(count):
        a = at[i]
        if k >= n:
            yield np.unique(g[a : a + k - n + 1])
        elif k:
            yield join_hashes([h[a + j : a + j + 1] for j in range(k)])
        else:
            yield np.zeros(0, dtype=U)
