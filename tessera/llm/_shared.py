"""What the operators of this subpackage have in common: the shared folder, written tables, ids."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six; Python's bytes.split() agrees.
NOT_SPACE = r"[^ \t\n\r\f\x0B]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where it is unset, one of our own, in local mode only: on a cluster executors couldn't see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: While tables are written: shuffle files go when the write is done, and batches for Python stay small, since texts may be long.
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def written(df: DataFrame, name: str, settings: dict[str, str] | None = None) -> DataFrame:
    """The rows of ``df`` from a Parquet table in the shared folder: the lineage ends there and outlives executors, and its shuffle files go at once. ``settings`` hold while it is written."""
    path = new_folder(df.sparkSession, name)
    with _settings(df.sparkSession, WHILE_WRITING | (settings or {})):
        df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._written_to = path
    return made


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made, once all that was made of them is written itself."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A key counts as hot if it has more than this share of all rows; there are fewer hot keys than its inverse.
HOT = 2.0**-10


def joined(rows: DataFrame, of: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` with the one row of ``of`` that has their key; ``n`` says how many of ``total`` rows have it. What hot keys have is sent to all workers, so their rows stay where they are."""
    hot = F.broadcast(of.where(F.col(n) > F.lit(HOT * total)))
    cold = of.where(F.col(n) <= F.lit(HOT * total))
    rest = rows.join(F.broadcast(of.where(F.col(n) > F.lit(HOT * total)).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(cold, key))


def word_count(text: str | Column) -> Column:
    """Number of words; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE)), F.lit(0)).cast("long")


def seeded(seed: int, *cols: str | Column) -> Column:
    """An order that looks random, the same in every engine with MD5."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def shards_for(n_rows: int, rows_per_shard: int) -> int:
    return max(1, -(-n_rows // rows_per_shard))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
