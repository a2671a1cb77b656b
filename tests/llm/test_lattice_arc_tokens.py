import collections
import gzip
import itertools
import json
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import arc_to_warc as A
from tessera.llm import lattice_neighbours as N
from tessera.llm import token_files as K




def test_decoding_finds_the_nearest_point():
    rng = np.random.default_rng(0)
    y = rng.uniform(-3, 3, (60, 8))
    got = N.decode(y)
    assert ((got * 2) % 1 == 0).all() and (got.sum(1) % 2 == 0).all()
    for row, p in zip(y, got):
        base = np.floor(row)
        best = min(((np.array(o) + base - row) ** 2).sum() for o in itertools.product((0, 1), repeat=8) if (np.array(o) + base).sum() % 2 == 0)
        half = np.floor(row - 0.5) + 0.5
        best = min(best, min(((np.array(o) + half - row) ** 2).sum() for o in itertools.product((0, 1), repeat=8) if (np.array(o) + half).sum() % 2 == 0))
        assert ((p - row) ** 2).sum() == pytest.approx(best)
    assert len({tuple(r) for r in N.ROOTS}) == 240 and np.allclose((N.ROOTS**2).sum(1), 2)


def vectors(seed, n, groups, noise, dim=24):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim))
    x = rng.standard_normal((n, dim))
    near = rng.random(n) < 0.5
    x[near] = centres[rng.integers(0, groups, near.sum())] + rng.standard_normal((near.sum(), dim)) * noise
    return x.astype(np.float32)


def brute(x, t):
    """Links and least connected row of each row."""
    x = x.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= t - 1e-9
    np.fill_diagonal(near, False)
    least = np.arange(len(x))
    while True:
        new = np.array([min(least[i], least[near[i]].min(initial=len(x))) for i in range(len(x))])
        if (new == least).all():
            return near.sum(1), least
        least = new


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)


def classes(df):
    rows = df.collect()
    got = {r["vec_id"]: (r["links"], r["class_id"]) for r in rows}
    assert len(rows) == len(got)
    return np.array([got[i][0] for i in range(len(got))]), np.array([got[i][1] for i in range(len(got))])


@pytest.mark.parametrize(("noise", "t"), [(0.05, 0.95), (0.25, 0.9), (0.3, 0.95)])
def test_recall_and_precision_against_brute_force(spark, noise, t):
    x = vectors(1, 700, 12, noise)
    (links, of), (want, least) = classes(N.near_classes(frame(spark, x), t)), brute(x, t)
    assert (links <= want).all() and links.sum() >= 0.97 * want.sum()
    assert (of >= least).all() and (least[of] == least).all() and (of == least).mean() >= 0.95
    assert ((links == 0) <= (of == np.arange(len(x)))).all()


def test_cells_that_are_divided_lose_nothing(spark, monkeypatch):
    x = vectors(2, 500, 3, 0.1)
    whole = classes(N.near_classes(frame(spark, x), 0.95))
    monkeypatch.setattr(N, "HELD", 20)
    parted = classes(N.near_classes(frame(spark, x), 0.95))
    assert (whole[0] == parted[0]).all() and (whole[1] == parted[1]).all()
    assert whole[0].sum() >= 0.97 * brute(x, 0.95)[0].sum()


@pytest.mark.parametrize("how", [(1, 1.4, 5), (2, 2.4, 6), (3, 2.8, 9)])
def test_every_plan_finds_the_pairs(spark, monkeypatch, how):
    """Blocks, scales and tables of larger inputs, on pairs of about the threshold's cosine."""
    rng = np.random.default_rng(4)
    a, z = rng.standard_normal((2, 300, 24))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z -= (z * a).sum(1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    x = np.concatenate([a, 0.952 * a + np.sqrt(1 - 0.952**2) * z]).astype(np.float32)
    monkeypatch.setattr(N, "plan", lambda *_: how)
    links, want = classes(N.near_classes(frame(spark, x), 0.95))[0], brute(x, 0.95)[0]
    assert (links <= want).all() and links.sum() >= 0.9 * want.sum()


def test_a_plan_meets_its_recall_at_any_size():
    for n in (1000, 10**6, 10**9):
        blocks, scale, tables = N.plan(64, n)
        assert 1 - (1 - N.meeting_rate(0.95, 64, blocks, scale, seed=9)) ** tables > 0.97
    assert N.plan(64, 1)[2] == N.plan(1, 100)[2] == 0


def test_the_work_on_large_inputs(monkeypatch):
    """Entries travel packed, cells are found once for each vector rather than for each pair, and 6 GB of vectors need few tables."""
    import pyarrow as pa

    assert N.plan(64, 14_800_000)[2] <= 6
    x = vectors(5, 1500, 2, 0.1, 64).astype(np.float64)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    numbers = pa.array(np.arange(len(x)))
    nodes = pa.RecordBatch.from_arrays([numbers, numbers, pa.array(np.ones(len(x), np.int64)), N._rows_of_bytes(x)], ["key", "rep", "n", "vector"])
    plans, made, got = {64: (2, 2.4, 6, N.PROBES, N.SEED)}, [0], np.zeros(len(x), np.int64)
    cells = N.cells
    monkeypatch.setattr(N, "cells", lambda x, *how: made.__setitem__(0, made[0] + len(x)) or cells(x, *how))
    for t in range(6):
        packed = pa.Table.from_batches(N._packed(iter([nodes]), t, plans, {}, 2))
        assert packed.num_rows <= 12
        for found in N._meet(iter(packed.sort_by([("bucket", "ascending"), ("asks", "ascending")]).to_batches()), t, plans, 0.95):
            np.add.at(got, found.column(0).to_numpy(), found.column(1).to_numpy())
    want = brute(x, 0.95)[0]
    assert want.sum() > 100_000 and (got <= want).all() and got.sum() >= 0.97 * want.sum()
    assert made[0] < 60 * len(x) < want.sum() / 2


def test_a_probed_cell_is_the_nearest_of_all():
    x = np.random.default_rng(7).standard_normal((500, 24))
    for blocks, scale in ((1, 1.4), (2, 2.4), (3, 2.8)):
        assert (N.cells(x, 2, blocks, scale, 1) == N.cells(x, 2, blocks, scale, 3)[:, :2]).all()


def test_odd_vectors_and_repeats(spark):
    a, b = [1.0, 2.0, 3.0], [-1.0, 0.5, 0.0]
    nan = float("nan")
    rows = [(1, a), (2, a), (3, [2.0, 4.0, 6.0]), (4, b), (5, None), (6, []), (7, [0.0, 0.0, 0.0]), (8, [nan, 1.0, 1.0]), (9, [1.0, None, 2.0]), (10, [1.0, 2.0]), (11, [1.01, 2.0]), (None, a), (1, a), (4, a), (12, [-5.0]), (13, [-2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("table", "cell", "key", "rep", "n", "links", "node", "least", "vector", "class_id")})
    got = sorted((r["vec_id"], r["class_id"], r["links"]) for r in N.near_classes(df).collect())
    # 4 has two vectors: one alone, one equal to those of 1, 2 and 3.
    assert got == [(1, 1, 4), (1, 1, 4), (2, 1, 4), (3, 1, 4), (4, 1, 0), (4, 1, 4), *((k, k, 0) for k in range(5, 10)), (10, 10, 1), (11, 10, 1), (12, 12, 1), (13, 12, 1)]
    assert N.near_classes(df.limit(0)).collect() == []
    assert sorted(map(tuple, N.near_classes(spark.createDataFrame([(1, []), (2, None)], "vec_id long, embedding array<float>")).collect())) == [(1, 1, 0), (2, 2, 0)]
    with pytest.raises(ValueError):
        N.near_classes(df, 0)


# Archives

PAGE = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hello</p>"


def parsed(data):
    return [dict(zip(A.COLUMNS, r)) for r in A.records(data, "x.arc")]


@pytest.mark.parametrize(("version", "packed"), list(itertools.product((1, 2), (False, True))))
def test_round_trip_of_archives(version, packed):
    rows = [("http://a.example/x y", "1.2.3.4", "20010203040506", "text/html", PAGE), ("dns:a.example", "0.0.0.0", "200102", "text/dns", b"a.example 1 IN A 1.2.3.4\n"), ("http://b.example/", "9.9.9.9", "20010101000000", "text/html", b""), ("http://b.example/", "9.9.9.9", "99", "text/html", b"\n\nnot http\n")]
    got = parsed(A.arc_bytes("x.arc", version, rows, packed))
    assert [r["warc_type"] for r in got] == ["warcinfo", "response", "resource", "resource", "resource"]
    assert [r["content_length"] for r in got[1:]] == [len(r[4]) for r in rows]
    assert [r["target_uri"] for r in got[1:]] == [r[0] for r in rows]
    assert {r["version"] for r in got} == {version}
    assert got[1]["warc_date"] == "2001-02-03T04:05:06Z" and got[2]["warc_date"] == "2001-02-01T00:00:00Z"
    assert got[4]["warc_date"] is None and got[4]["error"] == "bad date"
    assert got[1]["http_status"] == 200 and got[1]["payload_length"] == len(b"<p>hello</p>")
    assert got[1]["payload_digest"] == A.digest(b"<p>hello</p>") != got[1]["block_digest"] == A.digest(PAGE)
    assert got[2]["ip_address"] is None and got[1]["ip_address"] == "1.2.3.4"
    assert all(uuid.UUID(r["record_id"][10:-1]).version == 5 for r in got) and len({r["record_id"] for r in got}) == 5
    record = A.warc_bytes(got[1], PAGE)
    head, body = record.split(b"\r\n\r\n", 1)
    assert body == PAGE + b"\r\n\r\n" and b"WARC-Type: response" in head and f"Content-Length: {len(PAGE)}".encode() in head


def test_sha1_base32():
    assert A.digest(b"") == "sha1:3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


def test_broken_archives():
    whole = A.arc_bytes("x.arc", 1, [("http://a/", "1.1.1.1", "20010101000000", "text/html", PAGE)] * 3)
    assert parsed(None) == parsed(b"") == parsed(b"\n\n") == []
    assert [r["error"] for r in parsed(whole[:-20])] == [None, None, None, "block shorter than declared"]
    assert [r["error"] for r in parsed(whole[: whole.rindex(b"http://a/") + 5])] == [None, None, None, "header line without end"]
    assert [r["error"] for r in parsed(b"http://a/ 1.1.1.1 2001 text/html 3\nabc\n")] == ["no version block"]
    assert [r["error"] for r in parsed(whole.replace(b"text/html ", b"texthtml", 1))][:2] == [None, "bad header line"]
    small = gzip.compress(whole)
    assert [r["error"] for r in parsed(small)] == [None] * 4
    assert len(parsed(small[: len(small) // 2])) >= 1
    for cut in range(0, len(whole), 7):  # never more than one error, and never a crash
        assert sum(r["error"] is not None for r in parsed(whole[:cut])) <= 1


@pytest.mark.parametrize("bad", [0, 1, 2])
def test_a_broken_member_gives_an_error_and_the_rest(bad):
    members = [gzip.compress(x, mtime=0) for x in (A.arc_bytes("x.arc", 1, []), *(f"http://{c}/ 1.1.1.1 20010101000000 text/html {len(PAGE)}\n".encode() + PAGE + b"\n" for c in "abc"))]
    members[bad] = members[bad][:12] + b"\xff" * 8 + members[bad][20:]
    got = parsed(b"".join(members))
    assert [r["target_uri"] for r in got if not r["error"]] == [u for k, u in enumerate(["filedesc://x.arc", "http://a/", "http://b/", "http://c/"]) if k != bad]
    assert [r["error"] for r in got if r["error"]] == ["broken gzip member"]


def test_conversion_of_rows(spark):
    pages = [(1, "http://a.example/", "<p>x</p>"), (2, "https://b.example/ü", None), (2, "https://b.example/ü", None), (None, "http://c/", "x"), (4, None, "x"), (5, "http://d/", "y" * 300_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("archive", F.lit("z"))
    got = A.convert(A.archives_of(df)).collect()
    assert len(got) == 8
    assert sorted(r["payload_length"] for r in got if r["warc_type"] == "response") == [0, 0, 8, 300_000]
    odd = spark.createDataFrame([("n", None), (None, bytearray(b"")), (None, bytearray(A.arc_bytes("q", 2, [])))], "archive string, content binary")
    assert [(r["archive"], r["warc_type"]) for r in A.convert(odd).collect()] == [(None, "warcinfo")]
    assert A.convert(odd.limit(0)).collect() == A.convert(A.archives_of(df.limit(0))).collect() == []


def test_files(spark, tmp_path):
    for i, packed in enumerate((False, True)):
        (tmp_path / f"{i}.arc").write_bytes(A.arc_bytes(f"{i}.arc", 1 + i, [("http://a/", "1.1.1.1", "2001", "text/html", PAGE)], packed))
    got = A.read_arc(spark, str(tmp_path)).where("warc_type = 'response'").collect()
    assert sorted(r["version"] for r in got) == [1, 2]


def read_warc(data):
    """(headers, block) of each record, by the declared lengths alone."""
    out = []
    while data:
        head, data = data.split(b"\r\n\r\n", 1)
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.0"
        headers = dict(x.split(": ", 1) for x in lines[1:])
        n = int(headers["Content-Length"])
        out.append((headers, data[:n]))
        assert data[n : n + 4] == b"\r\n\r\n"
        data = data[n + 4 :]
    return out


def test_warc_files_hold_the_records(spark, tmp_path):
    rows = [(f"http://a/{i}", "1.1.1.1", "20010101000000", "text/html", PAGE + b"%d" % i * i) for i in range(300)]
    (tmp_path / "many.arc").write_bytes(A.arc_bytes("many.arc", 2, rows, True))
    (tmp_path / "one.arc").write_bytes(A.arc_bytes("one.arc", 1, rows[:1]) + b"broken line\n")
    records = A.read_arc(spark, str(tmp_path / "*.arc"))
    files = A.write_warc(records, f"file://{tmp_path}/out").collect()
    got = [x for f in files for x in read_warc(gzip.decompress((tmp_path / "out" / f["file"]).read_bytes()))]
    assert sum(f["records"] for f in files) == len(got) == 303 == len({h["WARC-Record-ID"] for h, _ in got}) + 1  # the same page from two archives has one id
    assert all(A.digest(b) == h["WARC-Block-Digest"] for h, b in got)
    assert sorted(b for h, b in got if h["WARC-Type"] == "response") == sorted([r[4] for r in rows] + [rows[0][4]])
    assert all(f["bytes"] == (tmp_path / "out" / f["file"]).stat().st_size for f in files)
    assert A.write_warc(records.limit(0), f"file://{tmp_path}/none").collect() == []


# Token files


def test_round_trip_of_token_files(spark, docs, texts):
    folder, rows = K.write_tokens(docs)
    rows = {(r["part"], r["row"]): r for r in rows.collect()}
    corpus = K.Corpus(folder)
    assert len(corpus) == len(rows) == docs.count() and corpus.dtype == np.uint16
    ends, seen = 0, []
    for i in range(len(corpus)):
        ids = corpus[i]
        k = int(np.searchsorted(corpus.first, i, "right")) - 1
        r = rows[corpus.parts[k]["part"], i - int(corpus.first[k])]
        assert r["tokens"] == len(ids) and r["base"] == corpus.parts[k]["base"] and r["base"] + r["offset"] == ends
        ends += len(ids)
        assert ids[-1] == K.END
        seen.append((r["doc_id"], K.encoding(K.TOKENIZER).decode(ids[:-1].tolist())))
    assert ends == corpus.tokens
    assert sorted(seen, key=str) == sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=str)
    with pytest.raises(IndexError):
        corpus[len(corpus)]


def test_files_are_flat_integers(spark, docs, tmp_path):
    folder, rows = K.write_tokens(docs.coalesce(1), f"file://{tmp_path}/out", end=None)
    m = json.loads((tmp_path / "out/manifest.json").read_text())
    assert m["dtype"] == "<u2" and len(m["parts"]) == 1
    name = m["parts"][0]["file"]
    raw = np.fromfile(tmp_path / f"out/{name}.ids", "<u2")
    offsets = np.fromfile(tmp_path / f"out/{name}.offsets", "<u8")
    assert len(raw) == m["parts"][0]["tokens"] == offsets[-1] and (np.diff(offsets.astype(np.int64)) >= 0).all()
    assert sorted(x.name for x in (tmp_path / "out").iterdir() if not x.name.startswith(".")) == sorted(["manifest.json", f"{name}.ids", f"{name}.offsets"])
    assert rows.agg(F.sum("tokens")).first()[0] == len(raw)
    with pytest.raises(ValueError, match="empty"):
        K.write_tokens(docs, f"file://{tmp_path}/out")


def test_attempts_whose_rows_are_not_kept_leave_nothing(spark, docs, monkeypatch):
    """After a shuffle another attempt of a task may have its rows in another order: ids, offsets and rows must come from one attempt."""
    kept = K.written

    def twice(df, name):
        df.collect()  # a whole run of attempts whose files are there and whose rows are lost
        return kept(df, name)

    monkeypatch.setattr(K, "written", twice)
    folder, rows = K.write_tokens(docs.repartition(3, F.rand()))
    corpus = K.Corpus(folder)
    rows = {(r["part"], r["row"]): r for r in rows.collect()}
    texts = collections.defaultdict(set)
    for r in docs.collect():
        texts[r["doc_id"]].add(r["text"] or "")
    for i in range(len(corpus)):
        k = int(np.searchsorted(corpus.first, i, "right")) - 1
        r = rows[corpus.parts[k]["part"], i - int(corpus.first[k])]
        assert K.encoding(K.TOKENIZER).decode(corpus[i][:-1].tolist()) in texts[r["doc_id"]] and len(corpus[i]) == r["tokens"]
    import os

    assert len([x for x in os.listdir(corpus.path) if not x.startswith(".")]) == 2 * len(corpus.parts) + 1


def test_file_systems():
    assert K.file_system("/tmp/x")[1] == "/tmp/x" == K.file_system("file:///tmp/x/")[1]


def test_empty_corpus_and_other_columns(docs, clashing, empty):
    folder, rows = K.write_tokens(empty)
    assert rows.collect() == [] and len(K.Corpus(folder)) == 0
    assert K.write_tokens(clashing)[1].count() == docs.count()


def test_types():
    assert [K.dtype_for(n).str for n in (255, 256, 65535, 65536, 2**32)] == ["|u1", "<u2", "<u2", "<u4", "<u8"]
