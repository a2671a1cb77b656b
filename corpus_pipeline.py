"""A pipeline from raw documents to packed training sequences: five stages, each of which works on all that its predecessor kept.

Language identification drops documents in none of the languages; of each group of near duplicates one stays; secrets give way to a mark;
sources are mixed to target weights; what remains is packed into sequences. Each stage is written as Parquet and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import language_id, mixing, ngram_jaccard, packing, secret_scan
from tessera.llm._shared import documents, dropped, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is likely in one of the languages; null, empty and letterless texts go, null ids, repeated rows and very long texts are judged like others."""
    return language_id.accepted(docs, language_id.trained(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of the least id; rows without an id or words stay, rows of one id stay or go together."""
    return ngram_jaccard.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; secrets in their texts give way to a mark, and n_chars follows. Null and empty texts stay as they are."""
    return secret_scan.redacted(docs, secret_scan.trained())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents within their sources' quotas. Rows without an id go, a null source is one of its own, texts without words count no tokens; ties go by name."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in its sequence. Texts without words have no pieces; long ones have several."""
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("source mixing", mix_sources),
    ("sequence packing", pack_sequences),
]

#: The support vector machines and the network can't be said in SQL; the tests hold run() against the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents. Each is written to the shared folder and read from there; what came before it goes then. Empty documents give no rows."""
    docs, before = documents(spark, sf_dir), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), f"stage-{k}")
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
