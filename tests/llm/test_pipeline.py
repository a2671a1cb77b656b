import corpus_pipeline as P
from tessera.llm import language_id, mixing, ngram_jaccard, packing, secret_scan
from tessera.llm._shared import documents

from .conftest import words_of
from .test_ngram_jaccard import brute


def test_stages_work_on_what_came_before(spark, sf_dir):
    """Each stage over a small table against its definition worked out on the driver."""
    docs = documents(spark, sf_dir).where("doc_id < 120")
    rows = [tuple(r) for r in docs.collect()]
    model = language_id.trained(docs)
    one = [tuple(r) for r in P.identify_language(spark, docs, sf_dir).collect()]
    verdict = {r["doc_id"]: r["accepted"] for r in language_id.identify(docs, model).collect()}
    assert sorted(one) == sorted(r for r in rows if verdict[r[0]])

    of = {a: c for a, c, _ in brute([r[:2] for r in one], ngram_jaccard.N, ngram_jaccard.THRESHOLD)}
    two = [tuple(r) for r in P.drop_near_duplicates(spark, spark.createDataFrame(one, docs.schema), sf_dir).collect()]
    assert sorted(two) == sorted(r for r in one if of[r[0]] == r[0])

    net, want = secret_scan.train(secret_scan.findings()), []
    for i, text, lang, source, n in two:
        for a, b, _ in reversed(secret_scan.found(text, net)):
            text = text[:a] + "[SECRET]" + text[b:]
        want.append((i, text, lang, source, len(text)))
    three = [tuple(r) for r in P.redact_secrets(spark, spark.createDataFrame(two, docs.schema), sf_dir).collect()]
    assert sorted(three) == sorted(want)

    frame = spark.createDataFrame(three, docs.schema)
    chosen = {r["doc_id"] for r in mixing.mix(frame).collect()}
    four = [tuple(r) for r in P.mix_sources(spark, frame, sf_dir).collect()]
    assert sorted(four) == sorted(r for r in three if r[0] in chosen)

    last = P.pack_sequences(spark, spark.createDataFrame(four, docs.schema), sf_dir).collect()
    packed = {}
    for r in last:
        packed[r["doc_id"]] = packed.get(r["doc_id"], 0) + r["length"]
    assert packed == {r[0]: len(words_of(r[1])) for r in four if words_of(r[1])}


def test_the_run_is_its_stages(spark, sf_dir):
    assert [len(s) for s in P.STAGES] == [2] * 5
    df = P.run(spark, sf_dir)
    assert df.columns == [c.split()[0] for c in packing.SCHEMA.split(", ")]
    again = sorted(map(str, P.run(spark, sf_dir).collect()))
    assert sorted(map(str, df.collect())) == again


def test_stages_take_nulls_and_no_rows(spark, docs, clashing, empty, sf_dir):
    for table in (clashing, empty):
        out = table
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, out, sf_dir)
            assert out.columns == table.columns
        kept = out.collect()
        assert len(kept) <= table.count()
        assert P.pack_sequences(spark, out, sf_dir).columns[0] == "shard"
