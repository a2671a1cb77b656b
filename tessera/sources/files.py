"""Delimited files, ZIP archives and JSON records as DataFrames, and nested JSON out."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.relational import stripped


def delimited(spark: SparkSession, path: str | list[str], separator: str = "\t", columns: Sequence[str] | None = None) -> DataFrame:
    """All columns as strings under their trimmed names; an empty field is null. With ``columns``, those alone."""
    df = stripped(spark.read.csv(path, sep=separator, header=True, inferSchema=False, nullValue="", emptyValue=""))
    return df.select(*columns) if columns is not None else df


def unzipped(archives: DataFrame, suffix: str = "") -> DataFrame:
    """(path, name, content) of the files in ZIP archives given as (path, content); a broken archive gives a row with neither name nor content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows: list[tuple] = []
                try:
                    if data.is_valid:
                        with zipfile.ZipFile(io.BytesIO(data.as_py())) as z:
                            rows = [(path, i.filename, z.read(i)) for i in z.infolist() if not i.is_dir() and i.filename.endswith(suffix)]
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError):
                    rows = [(path, None, None)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.binary()))], ["path", "name", "content"])

    return archives.select("path", "content").mapInArrow(run, "path string, name string, content binary")


def zipped_table(archives: DataFrame, name: str, columns: Sequence[str], separator: str = "\t") -> DataFrame:
    """A delimited member of each archive, whatever the order of its columns: the path and the named columns as strings."""
    lines = unzipped(archives, name).select("path", F.split(F.regexp_replace(F.decode("content", "utf-8"), "\r\n", "\n"), "\n").alias("__l"))
    head = F.transform(F.split(F.get("__l", 0), f"\\Q{separator}\\E", -1), lambda c: F.trim(c))
    rows = lines.select("path", head.alias("__h"), F.explode(F.slice("__l", F.lit(2), F.greatest(F.size("__l"), F.lit(1)))).alias("__r")).where("__r != ''")
    cells = rows.withColumn("__c", F.split("__r", f"\\Q{separator}\\E", -1))
    return cells.select("path", *(F.nullif(F.get("__c", F.array_position("__h", F.lit(c)).cast("int") - 1), F.lit("")).alias(c) for c in columns))


def json_records(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """Files that hold a list of records, or a record a line; the file's name comes along. A broken record has nulls and its text in ``_corrupt``."""
    reader = spark.read.option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    return (reader.schema(schema) if schema is not None else reader).json(path).withColumn("source_file", F.input_file_name())


def unwrapped(df: DataFrame, wrapper: str = "result") -> DataFrame:
    """The fields of a wrapper, if the records have one; else the records."""
    if wrapper not in df.columns:
        return df
    return df.select(f"{wrapper}.*")


def newest_first(df: DataFrame, where: Column, order: Sequence[Column], columns: Sequence[str], n: int) -> DataFrame:
    """A remote query's four parts: predicate and projection are pushed to the scan, and the limit is taken of the order."""
    return df.where(where).select(*columns).orderBy(*order).limit(n)
