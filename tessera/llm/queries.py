"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import arc_to_warc, backoff_scores, language_id, lattice_neighbours, mixing, ngram_jaccard, ngram_scores, packing, secret_scan, token_files, weighted_minhash
from tessera.llm._shared import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = arc_to_warc.convert(arc_to_warc.archives_of(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return rows.withColumn("block", F.decode("block", "UTF-8"))  # these pages are text


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_id.identify(docs, language_id.trained(docs))


def op3_embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_neighbours.near_classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_tokens(documents(spark, sf_dir))[1]


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_scores.ngram_scores(documents(spark, sf_dir))


def op6_lm_scoring_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_scores.scores(documents(spark, sf_dir))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.near_classes(documents(spark, sf_dir))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir), secret_scan.trained())


def op9_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_minhash.fingerprints(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_arc_to_warc, op2_language_id, op3_embedding_neighbours, op4_source_mixing, op5_token_files, op6_lm_scoring, op6_lm_scoring_bigrams, op7_ngram_jaccard_join,
        op8_secret_scan, op9_sequence_packing, op10_fingerprints, pipeline,
    )
}

WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\r\f\v]+'), lambda x: x != '')"

N_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\v]+'))"


def _base32(column: str) -> str:
    """Base 32 of a SHA-1 in hexadecimal: eight groups of five digits, each four letters."""
    part = f"CAST('0x' || substr({column}, 1 + 5 * (i // 4), 5) AS BIGINT)"
    return f"'sha1:' || array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(({part} >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '')"


ORACLE_SQL: dict[str, str] = {
    "op1_arc_to_warc": f"""
WITH p AS (SELECT CAST(page_id AS BIGINT) AS i, url, coalesce(html, '') AS html, 1 + page_id % 2 AS v FROM pages WHERE page_id IS NOT NULL AND url IS NOT NULL),
r AS (
  SELECT 'page-' || i || '.arc' AS archive, CAST(0 AS BIGINT) AS position, CAST(v AS INTEGER) AS version, 'filedesc://page-' || i || '.arc' AS target_uri,
    CAST(NULL AS VARCHAR) AS ip_address, '19960101000000' AS digits, 'warcinfo' AS warc_type, 'application/warc-fields' AS content_type, CAST(NULL AS INTEGER) AS http_status,
    v || ' 0 tessera' || chr(10) || CASE v WHEN 1 THEN '{" ".join(arc_to_warc.V1)}' ELSE '{" ".join(arc_to_warc.V2)}' END || chr(10) || chr(10) AS block, NULL AS body
  FROM p
  UNION ALL
  SELECT 'page-' || i || '.arc', 1, CAST(v AS INTEGER), url, '10.' || (i // 65536 % 256) || '.' || (i // 256 % 256) || '.' || (i % 256),
    strftime(make_timestamp(CAST((946684800 + i % 1000000000) * 1000000 AS BIGINT)), '%Y%m%d%H%M%S'), 'response', 'application/http; msgtype=response', 200,
    'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html, html
  FROM p),
d AS (SELECT *, sha1(block) AS h, sha1(coalesce(body, block)) AS hp FROM r),
e AS (SELECT *, {_base32("h")} AS block_digest, {_base32("hp")} AS payload_digest FROM d),
u AS (SELECT *, sha1(from_hex('{arc_to_warc.SPACE.hex}') || encode(target_uri || ' ' || digits || ' ' || block_digest)) AS k FROM e)
SELECT archive, position, version, target_uri, ip_address, warc_type, content_type, http_status, block_digest, payload_digest,
  strftime(strptime(digits, '%Y%m%d%H%M%S'), '%Y-%m-%dT%H:%M:%SZ') AS warc_date,
  '<urn:uuid:' || substr(k, 1, 8) || '-' || substr(k, 9, 4) || '-5' || substr(k, 14, 3) || '-' || substr('89ab', 1 + CAST(CAST('0x' || substr(k, 17, 1) AS BIGINT) & 3 AS INTEGER), 1) || substr(k, 18, 3) || '-' || substr(k, 21, 12) || '>' AS record_id,
  CAST(strlen(block) AS BIGINT) AS content_length, CAST(strlen(coalesce(body, block)) AS BIGINT) AS payload_length, CAST(NULL AS VARCHAR) AS error, block
FROM u""",
    "op4_source_mixing": mixing.sql(words=N_WORDS),
    "op6_lm_scoring": f"""
WITH d AS (SELECT doc_id, {WORDS} AS w, row_number() OVER () AS r FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT doc_id, r, len(w) AS size, unnest(w) AS w, unnest(list_prepend(NULL, w[:-2])) AS v, unnest(list_prepend(NULL, list_prepend(NULL, w[:-3]))[:len(w)]) AS u FROM d WHERE len(w) > 0),
o1 AS (SELECT r, w, count(*) AS n FROM p GROUP BY ALL),
o2 AS (SELECT r, v, w, count(*) AS n FROM p WHERE v IS NOT NULL GROUP BY ALL),
o3 AS (SELECT r, u, v, w, count(*) AS n FROM p WHERE u IS NOT NULL GROUP BY ALL),
c1 AS (SELECT w, sum(n) AS n FROM o1 GROUP BY ALL),
c2 AS (SELECT v, w, sum(n) AS n FROM o2 GROUP BY ALL),
c3 AS (SELECT u, v, w, sum(n) AS n FROM o3 GROUP BY ALL),
t AS (SELECT count(*) AS n FROM p),
x AS (
  SELECT p.*, t.n AS total, c1.n - o1.n AS nw, c2.n - o2.n AS nvw, c3.n - o3.n AS nuvw, cv.n - ov.n AS nv, cuv.n - ouv.n AS nuv
  FROM p CROSS JOIN t JOIN c1 ON p.w = c1.w JOIN o1 ON p.r = o1.r AND p.w = o1.w
    LEFT JOIN c2 ON p.v = c2.v AND p.w = c2.w LEFT JOIN o2 ON p.r = o2.r AND p.v = o2.v AND p.w = o2.w
    LEFT JOIN c3 ON p.u = c3.u AND p.v = c3.v AND p.w = c3.w LEFT JOIN o3 ON p.r = o3.r AND p.u = o3.u AND p.v = o3.v AND p.w = o3.w
    LEFT JOIN c1 cv ON p.v = cv.w LEFT JOIN o1 ov ON p.r = ov.r AND p.v = ov.w
    LEFT JOIN c2 cuv ON p.u = cuv.v AND p.v = cuv.w LEFT JOIN o2 ouv ON p.r = ouv.r AND p.u = ouv.v AND p.v = ouv.w),
s AS (
  SELECT doc_id, CASE WHEN nuvw >= 1 THEN ln(nuvw) - ln(nuv)
    WHEN nvw >= 1 THEN ln(nvw) - ln(nv) + CASE WHEN u IS NULL THEN 0 ELSE ln(0.4) END
    ELSE ln(greatest(nw, 1)) - ln(greatest(total - size, 1)) + ln(0.4) * (CASE WHEN u IS NULL THEN 0 ELSE 1 END + CASE WHEN v IS NULL THEN 0 ELSE 1 END) END AS s
  FROM x)
SELECT doc_id, count(*) AS n_tokens, round(sum(s), 3) AS log_score, round(sum(s) / count(*), 6) AS mean_log_score
FROM s GROUP BY doc_id""",
    "op6_lm_scoring_bigrams": f"""
WITH w AS (SELECT doc_id, {WORDS} AS w, row_number() OVER () AS r FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT doc_id, unnest(w) AS w, unnest(list_prepend(NULL, w[:-2])) AS v FROM w WHERE len(w) > 0),
c1 AS (SELECT w, count(*) AS n FROM p GROUP BY w),
c2 AS (SELECT v, w, count(*) AS n FROM p WHERE v IS NOT NULL GROUP BY v, w HAVING count(*) >= 2),
t AS (SELECT count(*) AS n FROM p),
s AS (
  SELECT p.doc_id, CASE WHEN c2.n IS NOT NULL THEN ln(c2.n) - ln(cv.n)
                        ELSE ln(cw.n) - ln(t.n) + CASE WHEN p.v IS NULL THEN 0 ELSE ln(0.4) END END AS s
  FROM p CROSS JOIN t JOIN c1 cw ON p.w = cw.w LEFT JOIN c2 ON p.v = c2.v AND p.w = c2.w LEFT JOIN c1 cv ON p.v = cv.w)
SELECT doc_id, count(*) AS n_tokens, round(sum(s), 3) AS log_score, round(sum(s) / count(*), 6) AS mean_log_score
FROM s GROUP BY doc_id""",
    "op7_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                      WHEN len(w) >= 1 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS gram
  FROM w),
s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
h AS (
  SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS shared
  FROM g a JOIN s x ON a.doc_id = x.doc_id JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id JOIN s y ON b.doc_id = y.doc_id
  WHERE least(x.n, y.n) >= {ngram_jaccard.THRESHOLD} * greatest(x.n, y.n) - 1e-9
  GROUP BY 1, 2),
p AS (
  SELECT doc_a, doc_b FROM h JOIN s x ON doc_a = x.doc_id JOIN s y ON doc_b = y.doc_id
  WHERE shared >= {ngram_jaccard.THRESHOLD} / (1 + {ngram_jaccard.THRESHOLD}) * (x.n + y.n) - 1e-9),
c AS (SELECT doc_id, doc_id AS near FROM documents WHERE doc_id IS NOT NULL UNION SELECT c.doc_id, p.doc_b FROM c JOIN p ON c.near = p.doc_a),
l AS (SELECT doc_a, count(*) AS links FROM p GROUP BY 1)
SELECT c.doc_id, min(c.near) AS class_id, CAST(coalesce(any_value(l.links), 0) AS BIGINT) AS links
FROM c LEFT JOIN l ON c.doc_id = l.doc_a GROUP BY c.doc_id""",
}
