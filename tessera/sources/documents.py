"""Nested documents as DataFrames: one row per top-level key, read from text, binary or JSON files, and written back.

Files are read by Spark's own binary source, so any file system it knows will do, and parsed where they are read; a file is the unit of
parallelism, as its text can't be split safely. In binary files only the sections asked for are decoded.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.inference import infer, struct_type
from tessera.sources import binary, text
from tessera.sources.render import Style, to_text
from tessera.sources.values import Document, FormatError, from_json, kind_of, to_json, value_json

SCHEMA = "path string, position int, key string, kind string, json string, error string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def rows_of(path: str, data: bytes, form: str, keys: Sequence[str] | None) -> Iterator[tuple]:
    """The rows of one file; one that can't be read gives one row with its error."""
    try:
        if form == "binary":
            reader = binary.Reader(data)
            found = ((i, k, reader.get(k)) for i, k in enumerate(reader.keys()) if keys is None or k in keys)
        else:
            words = data.decode("utf-8-sig")
            # Includes lie beside the file on the machine that reads; other file systems have to hold them ready as one text.
            doc = from_json(words) if form == "json" else text.parse(words, path.removeprefix("file:") if path.startswith(("file:", "/")) else None)
            found = ((i, k, v) for i, (k, v) in enumerate(doc.data.items()) if keys is None or k in keys)
        for i, k, v in found:
            yield path, i, k, kind_of(v), value_json(v), None
    except (FormatError, UnicodeDecodeError) as e:
        yield path, None, None, None, None, str(e)


#: Bytes, about, after which converted documents or parsed rows leave Python. What comes in is a batch of Spark's, which may hold 10,000 documents.
SLICE_BYTES = 1 << 20


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, bytes | None]]:
    """Path and content, file by file; no more than one content is outside its batch."""
    for batch in batches:
        for path, data in zip(batch.column(0), batch.column(1)):
            yield path.as_py(), data.as_py()
        # Else they hold this batch while the next is read.
        batch = path = data = None


def _sliced(rows: Iterator[tuple], names: Sequence[str], types: Sequence[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Batches of about SLICE_BYTES, or of one row that is larger."""
    columns: list[list] = [[] for _ in names]
    size = 0
    for row in rows:
        for column, v in zip(columns, row):
            column.append(v)
            size += len(v) if isinstance(v, (str, bytes)) else 8
        row = v = None
        if size >= SLICE_BYTES:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
            columns, size = [[] for _ in names], 0
            yield made
            made = None
    if columns[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _rows(batches: Iterator[pa.RecordBatch], form: str, keys: Sequence[str] | None) -> Iterator[pa.RecordBatch]:
    rows = (row for path, data in _cells(batches) for row in rows_of(path or "", data or b"", form, keys))
    return _sliced(rows, NAMES, [pa.string(), pa.int32(), *[pa.string()] * 4])


def parsed(files: DataFrame, form: str, keys: Sequence[str] | None = None) -> DataFrame:
    """SCHEMA from (path, content) rows; ``form`` is text, binary or json. A null content is an empty file."""
    if form not in ("text", "binary", "json"):
        raise ValueError(f"no such form: {form}")
    return files.select("path", "content").mapInArrow(lambda batches: _rows(batches, form, keys), SCHEMA)


def read_documents(spark: SparkSession, path: str | list[str], form: str = "text", keys: Sequence[str] | None = None) -> DataFrame:
    return parsed(spark.read.format("binaryFile").load(path), form, keys)


def table_rows(sections: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of sections that are lists of objects, typed; ``path``, ``key`` and the row's place come first."""
    rows = sections.where("kind = 'array'").select("path", "key", F.posexplode(F.from_json("json", T.ArrayType(schema))).alias("row", "__r"))
    return rows.select("path", "key", "row", "__r.*")


def schema_of(doc: Document, key: str) -> T.StructType:
    """The Spark schema of a table of a document, as its struct says or as its rows suggest."""
    found = binary.Writer(doc).schema_for(key, doc.data[key]) or binary.Writer(infer(Document({key: doc.data[key]}))).schema_for(key, doc.data[key])
    if found is None:
        raise FormatError(f"{key} is no table")
    # A timestamp is JSON text here; its offset would be lost otherwise.
    typed = struct_type(found, doc.schemas)
    return T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.StructType) and f.dataType.names == ["ts", "tz_min"] else f.dataType) for f in typed])


CONVERT: dict[str, Callable[[Document], bytes]] = {
    "text": lambda d: to_text(d).encode(),
    "compact": lambda d: to_text(d, Style(True, True)).encode(),
    "binary": binary.to_binary,
    "json": lambda d: to_json(d).encode(),
    "compact json": lambda d: to_json(d, pretty=False).encode(),
}


def read(data: bytes, form: str) -> Document:
    return binary.from_binary(data) if form == "binary" else from_json(data.decode()) if form == "json" else text.parse(data.decode())


def converted(files: DataFrame, source: str, target: str, with_inference: bool = False) -> DataFrame:
    """(path, content, error) in another form. Forms are text, compact, binary, json and compact json; a null content stays null."""

    def one(data: bytes | None) -> tuple[bytes | None, str | None]:
        try:
            if data is None:
                return None, None
            doc = read(data, source)
            return CONVERT[target](infer(doc) if with_inference else doc), None
        except (FormatError, UnicodeDecodeError) as e:
            return None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sliced(((path, *one(data)) for path, data in _cells(batches)), ["path", "content", "error"], [pa.string(), pa.binary(), pa.string()])

    return files.select("path", "content").mapInArrow(run, "path string, content binary, error string")


def from_rows(df: DataFrame, group: Sequence[str], key: str, order: Sequence[str], name: str = "path") -> DataFrame:
    """(path, content): a JSON document per group with its rows in order under one key; the group's values, joined, are its path."""
    fields = F.to_json(F.struct(*(c for c in df.columns if c not in group)), {"ignoreNullFields": "false"})
    rows = F.transform(F.array_sort(F.collect_list(F.struct(*order, fields.alias("__row")))), lambda r: r["__row"])
    doc = F.concat(F.lit("{" + json.dumps(key) + ":["), F.array_join(rows, ","), F.lit("]}"))
    return df.groupBy(*group).agg(doc.cast("binary").alias("content")).select(F.concat_ws("/", *group).alias(name), "content")
