"""Operator 1: legacy archive converter, from ARC files to WARC records.

An ARC file begins with a version block, ``filedesc://``, whose own lines give the version and name the fields of all header lines:
five in version 1, ten in version 2. A header line gives its record's length; records follow one another with a newline between. Each becomes a WARC record: its
identifier is made from its digests, so the same record has the same one always, its timestamp from the 14 digits (or fewer) of the
archive date, its type from scheme and content, its digests from its bytes.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._shared import written
from tessera.llm.token_files import file_system

V1 = ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length")
V2 = ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length")
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
SCHEMA = (
    "archive string, position long, version int, target_uri string, ip_address string, warc_date string, warc_type string, record_id string, content_type string, "
    "content_length long, http_status int, block_digest string, payload_digest string, payload_length long, error string, block binary"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def warc_date(digits: str) -> str | None:
    """ISO 8601 in UTC from 4 to 14 digits, the missing ones taken from the start of their year, month or day; None for no date."""
    if not (digits.isascii() and digits.isdigit() and len(digits) in (4, 6, 8, 10, 12, 14)):
        return None
    full = digits + "00000101000000"[len(digits) :]
    try:
        return datetime.strptime(full, "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return None


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _inflated(data: bytes) -> Iterator[bytes | None]:
    """The contents of an archive of gzip members on end, as stretches of whole ones; None stands for a broken member, after which the next that inflates goes on. Other data as they are."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    out, at, broken = [], 0, False
    while 0 <= at < len(data):
        d = zlib.decompressobj(31)
        try:
            part = d.decompress(data[at:] if at else data) + d.flush()
        except zlib.error:
            part = None
        if part is not None and d.eof:
            out.append(part)
            at, broken = len(data) - len(d.unused_data), False
            if data[at : at + 2] == b"\x1f\x8b" or not data[at:].strip(b"\0\r\n"):
                if not data[at:].strip(b"\0\r\n"):
                    break
                continue
        if not broken:
            yield b"".join(out)
            yield None
            out, broken = [], True
        at = data.find(b"\x1f\x8b\x08", at + 1)
    if out:
        yield b"".join(out)


def http_parts(block: bytes) -> tuple[int | None, bytes]:
    """Status and payload of an HTTP response; (None, block) if it isn't one."""
    line = block[: block.find(b"\n") if b"\n" in block[:512] else 64].split()
    if len(line) < 2 or not line[0].startswith(b"HTTP/") or not line[1].isdigit() or len(line[1]) != 3:
        return None, block
    ends = [(i, k) for mark, k in ((b"\r\n\r\n", 4), (b"\n\n", 2)) if (i := block.find(mark)) >= 0]
    return int(line[1]), block[min(ends)[0] + min(ends)[1] :] if ends else b""


def warc_type(url: str, status: int | None) -> str:
    """warcinfo for the version block, response for HTTP exchanges, resource for what was fetched otherwise, DNS answers among them."""
    if url.startswith("filedesc:"):
        return "warcinfo"
    return "response" if status is not None and url.lower().startswith(("http:", "https:")) else "resource"


def records(data: bytes | None, archive: str | None) -> Iterator[tuple]:
    """Rows of SCHEMA. What can't be read gives one row with an error; reading goes on at the declared length or, without one, at the next intact gzip member after a broken one."""
    if data is None:
        return
    state = {"version": 0, "fields": V1, "position": 0, "broken": False}
    for part in _inflated(bytes(data)):
        if part is None:
            state["broken"] = True
            yield (archive, state["position"], state["version"] or None, *[None] * (len(COLUMNS) - 5), "broken gzip member", None)
        else:
            yield from _records(part, archive, state)


def _records(data: bytes, archive: str | None, state: dict) -> Iterator[tuple]:
    """The records of one stretch; ``state`` is what the version block said and how many records came before. Past a broken member no version block need come first."""
    at, version, fields, position = 0, state["version"], state["fields"], state["position"]

    def failed(why: str) -> tuple:
        return (archive, position, version or None, *[None] * (len(COLUMNS) - 5), why, None)

    if not data.strip():
        return
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
        if end < 0:
            yield failed("header line without end")
            return
        is_first = line.startswith("filedesc:")
        if not version and not is_first and not state["broken"]:
            yield failed("no version block")
            return
        parts = line.split(" ")
        # The version block's own header line has the fields of version 1 or of version 2; which one its contents say.
        names = (V2 if len(parts) == len(V2) else V1) if is_first or not version else fields
        if len(parts) > len(names) and len(names) >= 5:  # spaces in a URL: the last fields are counted from the end
            extra = len(parts) - len(names)
            parts = [" ".join(parts[: extra + 1]), *parts[extra + 1 :]]
        if len(parts) != len(names) or not (parts[-1].isascii() and parts[-1].isdigit()):
            yield failed("bad header line")
            return
        head = dict(zip(names, parts))
        length = int(parts[-1])
        block = data[end + 1 : end + 1 + length]
        at = end + 1 + length
        if len(block) < length:
            yield failed("block shorter than declared")
            return
        if is_first:
            lines = block.split(b"\n")
            number = lines[0].split()[:1]
            version = int(number[0]) if number and number[0] in (b"1", b"2") else 1
            named = lines[1].decode("ascii", "replace").split() if len(lines) > 1 else []
            fields = tuple(named) if len(named) >= 5 and named[0] == "URL" and named[-1] == "Archive-length" else (V1, V2)[version - 1]
        url = head["URL"]
        status, payload = (None, block) if is_first else http_parts(block)
        date = warc_date(head.get("Archive-date", ""))
        kind = warc_type(url, status)
        of_block, of_payload = digest(block), digest(payload)
        name = f"{url} {head.get('Archive-date', '')} {of_block}"
        content = {"warcinfo": "application/warc-fields", "response": "application/http; msgtype=response"}.get(kind) or head.get("Content-type") or "application/octet-stream"
        ip = head.get("IP-address")
        yield (
            archive, position, version, url, None if ip in (None, "", "-", "0.0.0.0") else ip, date, kind, f"<urn:uuid:{uuid.uuid5(SPACE, name)}>", content,
            length, status, of_block, of_payload, len(payload), None if date else "bad date", block,
        )
        position += 1
        state.update(version=version, fields=fields, position=position)


def convert(archives: DataFrame) -> DataFrame:
    """One row of SCHEMA for each record of each (archive, content) row.

    Null and empty contents have no records. A broken archive gives its records up to the break and one row that names the error; a bad date alone
    leaves warc_date null. ``block`` holds the record's bytes. Very long records are read whole. Repeated rows and names are converted each. Gzip is recognised. An empty table gives no rows; other columns are not read.
    """

    schema = pa.schema([(c, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t]) for c, t in (x.split() for x in SCHEMA.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                rows, size = [], 0
                for r in records(data.as_py(), name.as_py()):
                    rows.append(r)
                    size += len(r[-1] or b"")
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pydict({c: [r[i] for r in rows] for i, c in enumerate(COLUMNS)}, schema=schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pydict({c: [r[i] for r in rows] for i, c in enumerate(COLUMNS)}, schema=schema)

    return archives.select(F.col("archive").cast("string"), "content").mapInArrow(run, SCHEMA)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all ARC files under a path, as ``convert`` gives them; a file is read whole by one task, up to 2 GB. No files give no rows."""
    return convert(spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content"))


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Writes the records (rows of SCHEMA without an error or with a bad date) as WARC files of one gzip member a record, one file for each partition, and returns (file, records, bytes) of each.

    Names hold the attempt that wrote the file; the rows returned name those that count. Rows without a block are left out; no rows give no file.
    """
    columns = COLUMNS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        name, n, size, out = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.warc.gz", 0, 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] is not None:
                    out = out or fs.open_output_stream(f"{path}/{name}", compression=None)
                    data = gzip.compress(warc_bytes(row, row["block"]), 6, mtime=0)
                    out.write(data)
                    n, size = n + 1, size + len(data)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": pa.array([name]), "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return written(records.select(*columns).mapInArrow(run, "file string, records long, bytes long"), "warc-files")


def warc_bytes(row, block: bytes) -> bytes:
    """The WARC record of a row of SCHEMA and its block."""
    head = ["WARC/1.0", f"WARC-Type: {row['warc_type']}", f"WARC-Record-ID: {row['record_id']}"]
    head += [f"WARC-Date: {row['warc_date']}"] if row["warc_date"] else []
    head += [f"WARC-Target-URI: {row['target_uri']}"] if row["warc_type"] != "warcinfo" else [f"WARC-Filename: {row['target_uri'].split('://', 1)[-1]}"]
    head += [f"WARC-IP-Address: {row['ip_address']}"] if row["ip_address"] else []
    head += [f"WARC-Block-Digest: {row['block_digest']}"]
    head += [f"WARC-Payload-Digest: {row['payload_digest']}"] if row["warc_type"] == "response" else []
    head += [f"Content-Type: {row['content_type']}", f"Content-Length: {row['content_length']}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def arc_bytes(name: str, version: int, rows: list[tuple[str, str, str, str, bytes]], packed: bool = False) -> bytes:
    """An ARC file of (url, ip, date, type, block) rows."""
    fields = (V1, V2)[version - 1]

    def line(url: str, ip: str, date: str, kind: str, length: int, at: int, status: str = "200") -> bytes:
        parts = [url, ip, date, kind, str(length)] if version == 1 else [url, ip, date, kind, status, "-", "-", str(at), name, str(length)]
        return " ".join(parts).encode() + b"\n"

    inner = f"{version} 0 tessera\n{' '.join(fields)}\n\n".encode()
    out, at = [], 0
    for url, ip, date, kind, block in [(f"filedesc://{name}", "0.0.0.0", "19960101000000", "text/plain", inner), *rows]:
        status = http_parts(block)[0]
        record = line(url, ip, date, kind, len(block), at, str(status or 200)) + block + b"\n"
        record = gzip.compress(record, 1, mtime=0) if packed else record
        out.append(record)
        at += len(record)
    return b"".join(out)


def archives_of(pages: DataFrame) -> DataFrame:
    """(archive, content) of pages (page_id, url, html): what a crawler of the time would have left, versions 1 and 2 in turn.

    Pages without an id or a URL are left out; a null html is an empty page. Each page has an archive of its own, so that the rows can be told apart in SQL.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, contents = [], []
            for i, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                body = (html or "").encode()
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
                date = datetime.fromtimestamp(946684800 + i % 1_000_000_000, timezone.utc).strftime("%Y%m%d%H%M%S")
                names.append(f"page-{i}.arc")
                contents.append(arc_bytes(names[-1], 1 + i % 2, [(url, f"10.{i // 65536 % 256}.{i // 256 % 256}.{i % 256}", date, "text/html", block)]))
            yield pa.RecordBatch.from_pydict({"archive": pa.array(names, pa.string()), "content": pa.array(contents, pa.binary())})

    return pages.select(F.col("page_id").cast("long"), "url", "html").where("page_id is not null and url is not null").mapInArrow(run, "archive string, content binary")
