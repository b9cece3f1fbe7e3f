"""WARC archives: a writer, and a reader that splits compressed archives by byte ranges.

Writing.  Every record is a gzip member of its own.  Of records with equal payloads the one with the least id is a ``response``,
the others are ``revisit`` records that refer to it.  Spark's text writer puts the members out as they are, so any store that Spark writes
to will do; the separator it needs is an empty gzip member, which ends each part of an archive as an end-of-file marker.

Reading.  Spark cuts files into byte ranges and its line reader, with the gzip magic as line separator, gives each task the
candidates that start inside its range, read to the next magic even beyond the range's end.  A candidate is a record if it
decompresses and what comes out begins with a WARC version line; a magic that is compressed data by chance fails this and is joined to
the member that it belongs to.  Where such a member crosses into the next range, both tasks hand their parts on and the parts are joined by
file and place.  Spark would decompress files named ``*.gz`` as one stream; they are read under other names, by links of Hadoop's view file
system that last for this read, and so are split like others.

Null html is an empty payload.  Very long payloads are one record.  Other columns are left out, whatever their names.  Equal payloads of rows with one id are all ``response``; a null id can only refer, never be referred
to, unless no row of its payload has one.  Empty tables give empty archives and no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, chunks

MAGIC = b"\x1f\x8b\x08"
#: A gzip member that holds nothing.
END = MAGIC + b"\x00\x00\x00\x00\x00\x00\xff\x03\x00" + bytes(8)
PART = 8_000_000
SMALLEST = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
COLUMNS = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to, revisit: bool, date: str) -> bytes:
    """One WARC record as a gzip member."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {re.sub(r'\s', '%20', url or 'about:blank')}", f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http;msgtype=response"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    data = "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    return gzip.compress(data, 6, mtime=0)


def write_archives(pages: DataFrame, path: str, smallest: int = SMALLEST, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) below ``path``."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    shared = rows.where(F.octet_length("html") >= smallest).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = checkpoint(shared)  # so that the join deals both sides out and can split a common payload's rows
    rows = rows.join(shared, "sha", "left").select("page_id", "url", "html", "first")

    def run(batches):
        held, size = [], 0
        for b in chunks(batches, "html"):
            for page_id, url, html, first in zip(*(c.to_pylist() for c in b.columns)):
                held.append(record(page_id, url, html.encode(), first, first is not None and page_id != first, date))
                size += len(held[-1])
                if size >= PART:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])

    parts = rows.mapInArrow(run, "value binary")
    parts.select(F.col("value").cast("string").alias("value")).write.option("lineSep", END.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def parse(data: bytes) -> dict | None:
    """The fields of a record, None if these aren't one's bytes."""
    if not data.startswith(b"WARC/1."):
        return None
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(fields.get("content-length", len(rest)))]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields.get("warc-type", "")
    declared = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    bare = lambda x: x[len("<urn:page:") : -1] if x.startswith("<urn:page:") else x
    return {
        "record_id": bare(fields.get("warc-record-id", "")),
        "record_type": kind,
        "target_uri": fields.get("warc-target-uri"),
        "refers_to": bare(fields["warc-refers-to"]) if "warc-refers-to" in fields else None,
        "payload_digest": digest(payload) if kind == "response" else fields.get("warc-payload-digest", "").removeprefix("sha1:"),
        "payload_bytes": len(payload) if kind == "response" else int(declared[1]) if declared else None,
        "payload": payload if kind == "response" else None,
    }


class Members:
    """Joins what lies between magics to members, in the order of a file's range."""

    def __init__(self):
        self.records: list[dict] = []
        self.before: list[bytes] = []  # candidates ahead of the first member: they belong to the range before
        self._raw: list[bytes] = []
        self._out: list[bytes] = []
        self._d = None

    def feed(self, piece: bytes) -> None:
        if self._d is None:
            self._d, self._raw, self._out = zlib.decompressobj(31), [], []
        self._raw.append(piece)
        try:
            self._out.append(self._d.decompress(piece))
        except zlib.error:
            return self._reject()
        seen = b"".join(self._out)[:7] if len(self._out) > 1 else self._out[0][:7]
        if len(seen) >= 7 and not seen.startswith(b"WARC/1."):
            return self._reject()
        if self._d.eof:
            data, self._d = b"".join(self._out), None
            if data and (found := parse(data)):
                self.records.append(found)
            elif data:
                self.before.extend(self._raw)

    def _reject(self) -> None:
        raw, self._d = self._raw, None
        if self.records and any(self._out):
            raise ValueError("a damaged member in a WARC archive")
        self.before.append(raw[0])
        for x in raw[1:]:
            self.feed(x)

    @property
    def rest(self) -> bytes:
        return b"".join(self._raw) if self._d is not None else b""


def _schema() -> pa.Schema:
    return pa.schema([("part", pa.int32()), ("path", pa.string()), ("at", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def _as_they_are(spark: SparkSession, path: str) -> DataFrame:
    """What lies between gzip magics in the files below ``path``, not decompressed whatever the files are called."""
    reader = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1")
    files = spark.read.text(path).inputFiles()
    if not any(f.endswith(".gz") for f in files):
        return reader.text(path)
    view = f"archives-{uuid.uuid4().hex}"
    for k, f in enumerate(files):
        reader = reader.option(f"fs.viewfs.mounttable.{view}.link./{k}.warc", f)
    return reader.text([f"viewfs://{view}/{k}.warc" for k in range(len(files))])


def read_archives(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """The records of all archives below ``path``: COLUMNS."""
    lines = _as_they_are(spark, path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"))

    def run(batches):
        kind, members, now = _schema(), Members(), None

        def flush(over: bool):
            rows = [{**r, "part": 0, "payload": r["payload"] if keep_payload else None} for r in members.records]
            members.records = members.records[-1:] if not over else []
            rows = rows[seen[0] :]
            seen[0] = 0 if over else len(members.records)
            if over and now:
                for k, x in ((1, b"".join(members.before)), (2, members.rest)):
                    if x:
                        rows.append({"part": k, "path": now[0], "at": now[1], "payload": x})
            return pa.RecordBatch.from_pylist(rows, kind)

        seen = [0]
        for b in batches:
            for value, file, at in zip(*(c.to_pylist() for c in b.columns)):
                if (file, at) != now:
                    yield flush(True)
                    members, now, first = Members(), (file, at), True
                if value or not first or at:
                    if first and at == 0:  # what precedes the first magic
                        if value.strip():
                            raise ValueError(f"{file} doesn't begin with a gzip member")
                    else:
                        members.feed(MAGIC + value)
                first = False
            yield flush(False)
        yield flush(True)

    columns = f"part int, path string, at bigint, {COLUMNS}"
    rows = lines.mapInArrow(run, columns)
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def stitch(g: pd.DataFrame) -> pd.DataFrame:
        members = Members()
        for _, data in sorted(zip(zip(g["at"], g["part"]), g["payload"]), key=lambda x: x[0]):
            for piece in data.split(MAGIC)[1:]:
                members.feed(MAGIC + piece)
        if members.rest or members.before:
            raise ValueError(f"{g['path'].iloc[0]}: a WARC archive ends within a member, or a member is damaged")
        out = [{**r, "payload": r["payload"] if keep_payload else None} for r in members.records]
        return pd.DataFrame(out, columns=names).astype({"payload_bytes": "Int64"})

    torn = rows.where("part > 0").select("path", "at", "part", "payload").groupBy("path").applyInPandas(stitch, COLUMNS)
    return rows.where("part = 0").select(*names).unionByName(torn)
