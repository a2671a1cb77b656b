"""Operator 8: secrets in texts, found by a character convolutional network over every candidate and its surroundings.

Candidates are all runs of 12 or more token characters with a digit, all values of 8 or more characters that are
assigned to a name such as token, password or secret_key, after a scheme such as Basic too, and passwords in URLs. The network sees the candidate and the characters around it. It is trained here, on
labelled findings of many formats made from a seed; its scores are calibrated on held-out findings, and for each kind of
candidate the threshold is the largest that keeps the recall asked for.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _hashing as H

BEFORE, AFTER = 32, 12
WIDTH, FILTERS, HIDDEN = 5, 24, 16
#: Places of a long window that are convolved together.
SLICE = 1 << 13
RECALL, FINDINGS, SEED = 0.995, 9000, 5
#: Findings before schemes and URLs come among them: fewer are too few to learn these as well.
PLAIN = 3000
NAMES = r"passw(?:or)?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth(?:orization)?|credential"
#: A name may go on, as in secret_key or tokenValue2; a scheme such as Basic may come before the value.
ASSIGNED = re.compile(rf"(?i)(?:{NAMES})[a-z0-9_.\-]{{0,40}}[\"']?\s{{0,3}}(?::=|=>|[:=])\s{{0,3}}[\"']?(?:(?:basic|bearer|digest|token|apikey)\s{{1,3}})?([^\s\"'<>]{{8,}})")
#: The password of user:password@host in a URL.
IN_URL = re.compile(r"://[^\s/:@\"'<>]{0,80}:([^\s/@\"'<>]{3,80})@")
RUN = re.compile(r"[A-Za-z0-9+/_=~.\-]{12,}")
DIGIT = re.compile(r"[0-9]")

#: Character classes: each ASCII character has its own, all others share one. Inside a candidate they are shifted by SIGNS.
SIGNS = 97


def _codes(text: str) -> np.ndarray:
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where((x >= 32) & (x < 127), x - np.uint32(31), np.uint32(96)).astype(np.int16)


def candidates(text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, kind) of all candidates, kind 1 being assigned values; one that overlaps an assigned value is part of it."""
    if not text:
        return []
    found = [(m.start(1), m.end(1), 1) for m in ASSIGNED.finditer(text)] if "=" in text or ":" in text else []
    found = [(a, a + len(text[a:b].rstrip(".,;!?)*#%&$]}")), 1) for a, b, _ in found]
    found = [x for x in found if x[1] - x[0] >= 8]
    for m in IN_URL.finditer(text) if "://" in text else ():
        found = [x for x in found if x[1] <= m.start(1) or m.end(1) <= x[0]] + [(m.start(1), m.end(1), 1)]
    found.sort()
    if DIGIT.search(text):
        taken, i = found[:], 0
        for m in RUN.finditer(text):
            a, b = m.start(), m.start() + len(m.group().rstrip(".-=")) if not m.group().endswith("=") else m.end()
            while i < len(taken) and taken[i][1] <= a:
                i += 1
            if i < len(taken) and taken[i][0] < b:
                continue
            if b - a >= 12 and DIGIT.search(text, a, b):
                found.append((a, b, 0))
    return sorted(found)


def window(text: str, start: int, end: int) -> np.ndarray:
    """Codes of a candidate, whole, with its surroundings; 0 is beyond the text."""
    left, right = text[max(0, start - BEFORE) : start], text[end : end + AFTER]
    x = np.concatenate([_codes(left), _codes(text[start:end]) + SIGNS, _codes(right)])
    return np.concatenate([np.zeros(BEFORE - len(left), np.int16), x, np.zeros(AFTER - len(right), np.int16)])


# Labelled findings

_WORDS = "the of and to in is that for was with on from this der die und das nicht ein une les dans pour que los las una para con value name file line page note".split()


def _pick(rng: np.random.Generator, letters: str, n: int) -> str:
    return "".join(letters[i] for i in rng.integers(0, len(letters), n))


def findings(n: int = FINDINGS, seed: int = SEED) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label) of n labelled findings: credentials of many formats in many surroundings, and what looks like them."""
    rng, more = np.random.default_rng(seed), np.random.default_rng([seed, 1])
    low, up, num = string.ascii_lowercase, string.ascii_uppercase, string.digits
    b64, hexa = low + up + num + "+/", num + "abcdef"

    def prose(k: int) -> str:
        made = ["".join(rng.choice(["er", "en", "th", "on", "an", "re", "tion", "ung", "que", "ado", "ou", "ch"], rng.integers(1, 4))) for _ in range(k)]
        words = [str(rng.choice(_WORDS)) if rng.random() < 0.5 else w for w in made]
        style = rng.integers(0, 6)
        return " ".join(w + ("***", "&&&", "$$$")[rng.integers(0, 3)] if style == 0 else w + " |" if style == 1 else w for w in words)

    secret = [
        lambda: _pick(rng, hexa, int(rng.choice([32, 40, 40, 64]))),
        lambda: _pick(rng, hexa, int(rng.choice([32, 40, 48, 64]))),
        lambda: _pick(rng, b64, int(rng.integers(24, 64))) + str(rng.choice(["", "=", "=="])),
        lambda: "AKIA" + _pick(rng, up + num, 16),
        lambda: str(rng.choice(["ghp_", "gho_", "glpat-", "sk-", "sk_live_", "xoxb-", "npm_", "hf_", "pk_live_"])) + _pick(rng, low + up + num, int(rng.integers(20, 44))),
        lambda: "eyJ" + _pick(rng, b64, 20) + "." + _pick(rng, b64, 40) + "." + _pick(rng, b64, 30),
        lambda: _pick(rng, low + up + num + "_-", int(rng.integers(20, 45))),
    ]
    password = lambda: _pick(rng, low + up + num + "!@#%^&*_-", int(rng.integers(10, 20))) + _pick(rng, num, 2)
    names = ["token", "secret", "password", "api_key", "apikey", "access_key", "auth", "SECRET_KEY", "client_secret", "passwd", "pwd", "credential", "TOKEN", "API-KEY"]
    harmless = [
        lambda: _pick(rng, num, int(rng.integers(12, 20))),
        lambda: ".".join(str(rng.integers(0, 256)) for _ in range(4)),
        lambda: f"{_pick(rng, low, 4)}.{rng.integers(10, 99)}@mail{rng.integers(1, 9)}.example.com",
        lambda: f"{rng.integers(1990, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}T{rng.integers(0, 24):02d}",
        lambda: "-".join(_pick(rng, hexa, k) for k in (8, 4, 4, 4, 12)),
        lambda: "".join(rng.choice(["er", "th", "on", "an", "tion", "ing", "ou"], 6)) + _pick(rng, num, 1),
        lambda: f"v{rng.integers(0, 20)}.{rng.integers(0, 30)}.{rng.integers(0, 99)}-release",
        lambda: "/".join("".join(rng.choice(["src", "lib", "data", "page", "img", "en"], 2)) for _ in range(3)) + f"/{rng.integers(1, 999)}.html",
        lambda: f"+1-{rng.integers(100, 999)}-555-{rng.integers(1000, 9999)}",
        lambda: f"{rng.integers(1, 99)}_{_pick(rng, low, 6)}_{_pick(rng, low, 5)}_{rng.integers(1, 999)}",
    ]
    placeholder = ["your_token_here", "changeme1234", "xxxxxxxxxxxxxxxx", "<your-api-key>", "EXAMPLE_KEY_123", "${SECRET_TOKEN}", "os.environ[KEY]", "********", "placeholder1", "None_specified", "required_field", "test_value_0001"]
    out = []
    for _ in range(n):
        label, case = int(rng.random() < 0.5), rng.random()
        before, after = prose(rng.integers(0, 9)), prose(rng.integers(0, 5))
        # Another credential close by says nothing of this candidate.
        near = rng.random()
        if near < 0.2:
            other = f'{rng.choice(names)} = "{secret[rng.integers(0, len(secret))]()}"'
            before, after = (f"{before} {other}", after) if near < 0.1 else (before, f"{other} {after}")
        if label:
            if case < 0.8:
                value = password() if rng.random() < 0.15 else secret[rng.integers(0, len(secret))]()
                lead = str(rng.choice(names)) + str(rng.choice([" = ", "=", ": ", ":", " := "]))
                quote = str(rng.choice(['"', "'", ""]))
                form = more.random() if len(out) >= PLAIN else 1.0
                if form < 0.04:
                    value, lead, quote = _pick(more, low + up, int(more.integers(16, 40))), "Authorization: " + str(more.choice(["Basic ", "Bearer "])), ""
                elif form < 0.08:
                    value, lead, quote = _pick(more, low + up + num + "!#%^&*_-", int(more.integers(8, 18))), f"{more.choice(['https', 'postgres', 'ftp', 'redis'])}://{_pick(more, low, 5)}:", ""
            else:
                value, lead, quote = secret[rng.integers(3, 6)](), str(rng.choice(["", "key ", "Bearer ", "use ", "login with "])), ""
        elif case < 0.15:
            value, lead, quote = str(rng.choice(placeholder)), str(rng.choice(names)) + str(rng.choice([" = ", ": ", "="])), str(rng.choice(['"', "'", ""]))
        elif case < 0.25:
            value, lead, quote = "".join(rng.choice(["er", "th", "on", "an", "tion", "ing", "ou", "re"], rng.integers(4, 7))), str(rng.choice(names)) + ": ", ""
        elif case < 0.32:
            value, lead, quote = _pick(rng, hexa, 40), str(rng.choice(["commit ", "sha1 ", "revision ", "digest ", "checksum ", "blob ", "etag "])), ""
        else:
            value, lead, quote = harmless[rng.integers(0, len(harmless))](), str(rng.choice(["", "", "", "call ", "see ", "id ", "at ", "version ", "http://"])), str(rng.choice(["", "", '"']))
        text, tail = f"{before} {lead}{quote}", f"{quote}{rng.choice(['', '###', '!!', '.', ',', '$$$', '&&&'])} {after}"
        if "://" in lead and label:
            tail = f"@{_pick(more, low, 6)}.example.com/{tail}"
        if rng.random() < 0.12:
            text, tail = text.upper(), tail.upper()
            value = value.upper() if rng.random() < 0.8 else value
        out.append((text + value + tail, len(text), len(text) + len(value), label))
    return out


# The network

@dataclass
class Network:
    table: np.ndarray  # (WIDTH, 2 * SIGNS, FILTERS): a convolution over one-hot characters is a sum of look-ups
    bias: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    slope: float = 1.0
    shift: float = 0.0
    thresholds: tuple[float, float] = (0.5, 0.5)
    recall: float = float("nan")  # of the held-out secrets, those that are no candidates among them

    def _padded(self, windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        lens = np.array([len(w) for w in windows])
        x = np.zeros((len(windows), max(int(lens.max()), WIDTH)), np.int64)
        for i, w in enumerate(windows):
            x[i, : len(w)] = w
        return x, lens

    def _pooled(self, x: np.ndarray, lens: np.ndarray):
        m = x.shape[1] - WIDTH + 1
        conv = self.bias + sum(self.table[k][x[:, k : k + m]] for k in range(WIDTH))
        conv = np.maximum(conv, 0) * (np.arange(m)[None, :] < (lens - WIDTH + 1)[:, None])[:, :, None]
        best = conv.argmax(1)
        mean = conv.sum(1) / (lens - WIDTH + 1)[:, None]
        return conv, best, np.concatenate([np.take_along_axis(conv, best[:, None, :], 1)[:, 0], mean], axis=1)

    def _pooled_long(self, window: np.ndarray) -> np.ndarray:
        """As ``_pooled`` for one window, in slices with running maxima and sums."""
        n = len(window) - WIDTH + 1
        best, total = np.zeros(FILTERS), np.zeros(FILTERS)
        for lo in range(0, n, SLICE):
            m = min(SLICE, n - lo)
            conv = np.maximum(self.bias + sum(self.table[k][window[lo + k : lo + k + m]] for k in range(WIDTH)), 0)
            best, total = np.maximum(best, conv.max(0)), total + conv.sum(0)
        return np.concatenate([best, total / n])[None, :]

    def logits(self, windows: list[np.ndarray]) -> np.ndarray:
        """Each window's value doesn't depend on the others; windows of like length go together, long ones alone."""
        out = np.zeros(len(windows))
        order = np.argsort([len(w) for w in windows], kind="stable")
        i = 0
        while i < len(order):
            j = i + 1
            long = len(windows[order[i]]) > SLICE
            while not long and j < len(order) and len(windows[order[j]]) <= SLICE and (j - i + 1) * len(windows[order[j]]) <= 1 << 14:
                j += 1
            pooled = self._pooled_long(windows[order[i]]) if long else self._pooled(*self._padded([windows[k] for k in order[i:j]]))[2]
            out[order[i:j]] = np.maximum(pooled @ self.w1 + self.b1, 0) @ self.w2 + self.b2
            i = j
        return out

    def probabilities(self, windows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(windows) + self.shift, -50, 50)))


def train(data: list[tuple[str, int, int, int]], recall: float = RECALL, epochs: int = 14, seed: int = 0) -> Network:
    """Adam on cross entropy over two thirds of the findings; Platt's calibration and the thresholds on the rest."""
    rng = np.random.default_rng(seed)
    windows, y = [window(*f[:3]) for f in data], np.array([f[3] for f in data], float)
    kinds = np.array([int(any(k == 1 and a == s for a, _, k in candidates(t))) for t, s, _, _ in data])
    held = np.arange(len(data)) % 3 == 2
    p = {
        "table": rng.normal(0, 0.15, (WIDTH, 2 * SIGNS, FILTERS)), "bias": np.zeros(FILTERS), "w1": rng.normal(0, 0.3, (2 * FILTERS, HIDDEN)),
        "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 0.3, HIDDEN), "b2": np.zeros(1),
    }
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    net = Network(p["table"], p["bias"], p["w1"], p["b1"], p["w2"], 0.0)
    rows = np.flatnonzero(~held)
    for epoch in range(epochs):
        order = rng.permutation(rows)
        for i in range(0, len(order), 64):
            at = order[i : i + 64]
            net.b2 = float(p["b2"][0])
            x, lens = net._padded([windows[k] for k in at])
            conv, best, pooled = net._pooled(x, lens)
            hidden = np.maximum(pooled @ p["w1"] + p["b1"], 0)
            d = (1 / (1 + np.exp(-(hidden @ p["w2"] + p["b2"][0]))) - y[at]) / len(at)
            g = {"w2": hidden.T @ d, "b2": np.array([d.sum()])}
            dh = np.outer(d, p["w2"]) * (hidden > 0)
            g["w1"], g["b1"] = pooled.T @ dh, dh.sum(0)
            dp = dh @ p["w1"].T
            dc = np.repeat((dp[:, FILTERS:] / (lens - WIDTH + 1)[:, None])[:, None, :], conv.shape[1], axis=1)
            r, c = np.arange(len(at))[:, None], np.arange(FILTERS)[None, :]
            dc[r, best, c] += dp[:, :FILTERS]
            dc *= conv > 0
            g["bias"], g["table"] = dc.sum((0, 1)), np.zeros_like(p["table"])
            flat = dc.reshape(-1, FILTERS)
            for k in range(WIDTH):
                ids = x[:, k : k + conv.shape[1]].ravel()
                by = np.argsort(ids, kind="stable")
                first = np.flatnonzero(np.concatenate([[True], np.diff(ids[by]) > 0]))
                g["table"][k][ids[by][first]] = np.add.reduceat(flat[by], first, axis=0)
            step += 1
            rate = 0.01 * (1 - epoch / epochs) + 1e-4
            for k in p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] * g[k] - v[k])
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net.b2 = float(p["b2"][0])
    z, t = net.logits([windows[k] for k in np.flatnonzero(held)]), y[held]
    a, b = 1.0, 0.0
    for _ in range(200):  # Newton's method on two parameters, a little regularised
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
        w = q * (1 - q)
        grad = np.array([((q - t) * z).sum() + 1e-2 * (a - 1), (q - t).sum() + 1e-2 * b])
        h = np.array([[(w * z * z).sum() + 1e-2, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-2]])
        step_ = np.linalg.solve(h, grad)
        a, b = a - np.clip(step_[0], -1, 1), b - np.clip(step_[1], -1, 1)
    net.slope, net.shift = float(a), float(b)
    q = net.probabilities([windows[k] for k in np.flatnonzero(held)])
    limits = []
    seen = np.array([any(a < e and s < b for a, b, _ in candidates(x)) for x, s, e, _ in (data[k] for k in np.flatnonzero(held))], bool)
    missed = int(((t == 1) & ~seen).sum())  # no threshold finds these: they use up what the recall allows to be missed
    for kind in (0, 1):
        yes = np.sort(q[(t == 1) & seen & (kinds[held] == kind)])
        limits.append(float(min(0.5, yes[max(0, int(np.floor((1 - recall) * (len(yes) + missed))) - missed)])) if len(yes) else 0.5)
    net.thresholds = (limits[0], limits[1])
    if (t == 1).any():
        net.recall = float((seen & (q >= np.array(limits)[kinds[held]]))[t == 1].mean())
    return net


_trained: dict[tuple, Network] = {}


def trained(n: int = FINDINGS, seed: int = SEED, recall: float = RECALL) -> Network:
    """The network fitted on ``findings(n, seed)``; fitted once in a process, since it depends on nothing else."""
    key = n, seed, recall
    if key not in _trained:
        _trained[key] = train(findings(n, seed), recall)
    return _trained[key]


def found(text: str, net: Network) -> list[tuple[int, int, float]]:
    """(start, end, probability) of the secrets of a text."""
    at = candidates(text)
    if not at:
        return []
    out, k = [], 0
    while k < len(at):  # windows of some 64 kB at a time
        j, size = k, 0
        while j < len(at) and (j == k or size < 1 << 16):
            size += at[j][1] - at[j][0] + BEFORE + AFTER
            j += 1
        q = net.probabilities([window(text, a, b) for a, b, _ in at[k:j]])
        out += [(a, b, float(p)) for (a, b, kind), p in zip(at[k:j], q) if p >= net.thresholds[kind]]
        k = j
    return out


def _worth_reading(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(texts, "[0-9=:]"), False).to_numpy(zero_copy_only=False)


def scan(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, start, length, probability) of each secret in each row, in characters, the secrets themselves left out.

    A null or empty text has none; a null doc_id stays null; repeated rows give repeated findings. A very long
    text or candidate is read to its end. Other columns are not read. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *f) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for f in found(t, shared.value)]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "start": pa.array([r[1] for r in rows], pa.int64()), "length": pa.array([r[2] - r[1] for r in rows], pa.int64()), "probability": pa.array([round(r[3], 6) for r in rows], pa.float64())})

    # No candidate is without a digit or an assignment.
    some = docs.select(F.col("doc_id").cast("long"), "text").where(F.col("text").rlike("[0-9=:]"))
    return some.mapInArrow(run, "doc_id long, start long, length long, probability double")


def redacted(docs: DataFrame, net: Network, mark: str = "[SECRET]") -> DataFrame:
    """All rows with all columns; in their texts each secret gives way to ``mark``, and n_chars, if there, follows.

    Null and empty texts, null ids, repeated rows and further columns stay as they are; very long texts are read whole; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    names = docs.columns
    at, n_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in H.pieces(batch.column(at), 1 << 22):
                rows = batch.slice(first, len(part))
                new = {}
                for i in np.flatnonzero(_worth_reading(part)):
                    text = part[int(i)].as_py()
                    secrets = found(text, shared.value)
                    for a, b, _ in reversed(secrets):
                        text = text[:a] + mark + text[b:]
                    if secrets:
                        new[int(i)] = text
                if not new:
                    yield rows
                    continue
                arrays = list(rows.columns)
                arrays[at] = pa.array([new.get(i, t) for i, t in enumerate(part.to_pylist())], part.type)
                if n_at is not None:
                    arrays[n_at] = pa.array([len(new[i]) if i in new else n for i, n in enumerate(rows.column(n_at).to_pylist())], rows.column(n_at).type)
                yield pa.RecordBatch.from_arrays(arrays, schema=rows.schema)

    return docs.mapInArrow(run, docs.schema)
