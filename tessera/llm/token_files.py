"""Operator 5: token ids as flat unsigned integers with 64-bit document offsets, to be memory-mapped.

Each partition is tokenised once and written as one file of ids and one of offsets, whose names hold the attempt that wrote them. The rows of that
attempt name its files, so what an attempt left behind whose rows Spark didn't keep is in no manifest, and goes. What remains is arithmetic on one row per partition: the prefix sums of their
numbers of tokens and documents are the partitions' bases in the whole corpus.
"""

from __future__ import annotations

import base64
import json
import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pfs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import new_folder, written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_encodings: dict[str, object] = {}


def encoding(path: str):
    """The byte-level BPE of a file of ranks; loaded once in a process."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def encode(text: str, tokenizer: str = TOKENIZER) -> list[int]:
    return encoding(tokenizer).encode_ordinary(text)


def dtype_for(largest: int) -> np.dtype:
    """The least of the unsigned types of 1, 2, 4 and 8 bytes, little-endian, that holds the largest id."""
    return np.dtype(next(t for t in ("u1", "<u2", "<u4", "<u8") if largest <= np.iinfo(t).max))


def file_system(folder: str) -> tuple[pfs.FileSystem, str]:
    """The file system of a folder's URI, or of a local path, and the path there."""
    folder = "s3" + folder[3:] if folder.startswith(("s3a:", "s3n:")) else folder  # the name that pyarrow knows
    fs, path = pfs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pfs.LocalFileSystem(), folder)
    return fs, path.rstrip("/")


def write_tokens(docs: DataFrame, folder: str | None = None, tokenizer: str = TOKENIZER, end: int | None = END) -> tuple[str, DataFrame]:
    """Writes the corpus to ``folder`` and returns it with (doc_id, part, row, tokens, offset, base): one row for each row of ``docs``.

    ``offset`` is where the document begins in the ids of its part, ``base`` where that part begins in the corpus. A document is its ids and then
    ``end``, if that is not None; a null or empty text has no ids but its end. Every row is written, repeated ones too; a null doc_id is written and stays
    null. The order is that of the partitions. A text of any length is one document. Other columns are not read. An empty table gives no files but a manifest.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    if fs.get_file_info(pfs.FileSelector(path)):
        raise ValueError(f"{folder} isn't empty")
    kind = dtype_for(max(encoding(tokenizer).n_vocab - 1, end or 0))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = encoding(tokenizer), TaskContext.get().partitionId()
        fs, path = file_system(folder)
        name = f"{part:06d}-{uuid.uuid4().hex[:12]}"
        own = f"{path}/{name}"
        row = total = 0
        with fs.open_output_stream(f"{own}.ids") as ids, fs.open_output_stream(f"{own}.offsets") as offsets:
            for batch in batches:
                n = []
                for text in batch.column(1):
                    made = code.encode_ordinary(text.as_py() or "")
                    if end is not None:
                        made.append(end)
                    ids.write(np.array(made, dtype=kind).tobytes())
                    n.append(len(made))
                n = np.array(n, dtype=np.int64)
                start = total + np.cumsum(n) - n
                offsets.write(start.astype("<u8").tobytes())
                k = len(n)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(k, part, np.int32)), pa.array([name] * k, pa.string()), pa.array(row + np.arange(k)), pa.array(n), pa.array(start)], ["doc_id", "part", "file", "row", "tokens", "offset"])
                row, total = row + k, total + int(n.sum())
            offsets.write(np.array([total], dtype="<u8").tobytes())
        if not row:
            for what in ("offsets", "ids"):
                fs.delete_file(f"{own}.{what}")

    # Written before it is read twice, so that no file is ever made again by another plan.
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(write, "doc_id long, part int, file string, row long, tokens long, offset long"), "token-rows")
    parts = rows.groupBy("part", "file").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents")).orderBy("part").toArrow()  # a row per partition
    tokens, documents = parts["tokens"].to_numpy(), parts["documents"].to_numpy()
    bases = (np.cumsum(tokens) - tokens).astype(np.int64)
    manifest = {"dtype": kind.str, "end": end, "parts": [{"part": p, "file": name, "tokens": int(t), "documents": int(d), "base": int(b), "first_document": int(f)} for p, name, t, d, b, f in zip(parts["part"].to_pylist(), parts["file"].to_pylist(), tokens, documents, bases, np.cumsum(documents) - documents)]}
    with fs.open_output_stream(posixpath.join(path, "manifest.json")) as out:
        out.write(json.dumps(manifest).encode())
    kept = {"manifest.json", *(f"{p['file']}.{what}" for p in manifest["parts"] for what in ("ids", "offsets"))}
    for left in fs.get_file_info(pfs.FileSelector(path)):
        if posixpath.basename(left.path) not in kept:  # of other attempts
            fs.delete_file(left.path)
    base = spark.createDataFrame(pa.table({"part": parts["part"].cast(pa.int32()), "base": pa.array(bases)}))
    return folder, rows.join(base, "part").select("doc_id", "part", "row", "tokens", "offset", "base")


class Corpus:
    """A written corpus on a file system of this machine; ids of document i are ``corpus[i]``, mapped, not read."""

    def __init__(self, folder: str):
        self.path = file_system(folder)[1]
        with open(f"{self.path}/manifest.json") as f:
            m = json.load(f)
        self.parts, self.dtype = m["parts"], np.dtype(m["dtype"])
        self.first = np.array([p["first_document"] for p in self.parts], dtype=np.int64)
        self.tokens = sum(p["tokens"] for p in self.parts)
        self._open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __len__(self) -> int:
        return sum(p["documents"] for p in self.parts)

    def part(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self._open:
            name = f"{self.path}/{self.parts[k]['file']}"
            n = self.parts[k]["tokens"]
            ids = np.memmap(f"{name}.ids", self.dtype, "r") if n else np.zeros(0, self.dtype)
            self._open[k] = ids, np.memmap(f"{name}.offsets", "<u8", "r")
        return self._open[k]

    def __getitem__(self, i: int) -> np.ndarray:
        if not 0 <= i < len(self):
            raise IndexError(i)
        k = int(np.searchsorted(self.first, i, "right")) - 1
        ids, offsets = self.part(k)
        j = i - int(self.first[k])
        return ids[int(offsets[j]) : int(offsets[j + 1])]
