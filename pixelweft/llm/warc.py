"""WARC archives as a chunked record table.

An archive is a table of (record, chunk, chunks, data): the data of a record's
chunks in order are its bytes in the WARC/1.1 format, and all records one after
the other are the archive file. Spark cuts an oversized payload into chunk rows
where it is scanned; writer and reader see chunks only and carry the digest from one
to the next. As a record's header tells its digest, the writer makes the header of
such a record, its chunk 0, after the last chunk. Which records are revisits is
decided on ids and digests alone; the payload of a revisit goes no further than the
scan. Spark writes the table into the shared folder, wherever that is; records of
one chunk are read where they lie, only those of several are brought together.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, if_small, shared_dir

#: Bytes of a payload in one chunk.
CHUNK = 1 << 18
DATE = "2024-01-01T00:00:00Z"
#: chunks is the number of a record's chunks and stands with chunk 0; with the others, which are written before that is known, it is -1.
SCHEMA = "record string, chunk int, chunks int, data binary"
PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _uri(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def header(page_id: int | None, url: str | None, n_bytes: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """Header of a record, and the HTTP header that begins its block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:x-none")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_uri(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else n_bytes)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def records(pages: DataFrame, least_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of one record for each row of pages (page_id, url, html).

    Null payloads are empty ones. Of records with equal payloads of least_bytes or
    more, those with the smallest page_id are responses, the others revisits, also
    rows without an id where another row has one. Rows are not shuffled unless the
    payloads that occur more than once are more than BROADCAST_ROWS.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("sha1"), F.length("payload").cast("long").alias("n_bytes"))
    slim = rows.where(F.col("n_bytes") >= least_bytes).select("sha1", "n_bytes", "page_id")
    first = checkpointed(slim.groupBy("sha1", "n_bytes").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n"))
    rows = rows.join(if_small(first), ["sha1", "n_bytes"], "left").withColumn("revisit", F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")))
    size = F.lit(chunk).cast("long")
    last = F.when(F.col("revisit"), F.lit(0)).otherwise(F.greatest(F.floor((F.col("n_bytes") - 1) / size), F.lit(0))).cast("int")
    cut = rows.select("page_id", "url", "sha1", "n_bytes", "first_id", "revisit", last.alias("last"), "payload", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    data = F.when(~F.col("revisit"), F.col("payload").substr((F.col("chunk") * size + 1).cast("int"), size.cast("int")))
    chunks = cut.select("page_id", "url", "sha1", "n_bytes", "first_id", "revisit", "chunk", (F.col("chunk") == F.col("last")).alias("last"), data.alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, no, digest = TaskContext.get().partitionId(), 0, hashlib.sha1()
        for batch in batches:
            got: list[tuple] = []
            columns = [batch.column(k).to_pylist() for k in range(8)]
            for (page_id, url, sha1, n, first_id, revisit, k, last), data in zip(zip(*columns), batch.column(8)):
                body = data.as_py() or b""
                record = f"{task}-{no}"
                if not k:
                    digest = hashlib.sha1()
                digest.update(body)
                if last:
                    if not revisit and digest.hexdigest() != sha1:
                        raise ValueError("the chunks of a payload are not the payload")
                    head, no = header(page_id, url, n, base32_sha1(sha1), first_id, revisit), no + 1
                    if not k:
                        got.append((record, 0, 1, head + body + b"\r\n\r\n"))
                        continue
                    got.append((record, 0, k + 2, head))
                got.append((record, k + 1, -1, body + b"\r\n\r\n" * last))
            if got:
                yield _table(got)

    return chunks.mapInArrow(run, SCHEMA)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())], names=["record", "chunk", "chunks", "data"])


def write_archives(pages: DataFrame, path: str | None = None, least_bytes: int = 0, chunk: int = CHUNK) -> str:
    """Writes the archives of pages to path, or below the shared folder; returns the path."""
    path = path or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    records(pages, least_bytes, chunk).write.parquet(path)
    return path


class Reader:
    """Reads the chunks of one record, in order."""

    def __init__(self) -> None:
        self.head, self.fields, self.left, self.digest, self.n, self.tail = b"", None, 0, hashlib.sha1(), 0, b""

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            self.head += data
            if (end := self.head.find(b"\r\n\r\n")) < 0 or (http := self.head.find(b"\r\n\r\n", end + 4)) < 0:
                return
            version, *lines = self.head[:end].decode().split("\r\n")
            if version != "WARC/1.1":
                raise ValueError("not a WARC record")
            self.fields = dict(x.split(": ", 1) for x in lines)
            self.http = dict(x.split(": ", 1) for x in self.head[end + 4 : http].decode().split("\r\n")[1:])
            self.left = int(self.fields["Content-Length"]) - (http + 4 - end - 4)
            data, self.head = self.head[http + 4 :], b""
        body = data[: self.left]
        self.digest.update(body)
        self.n += len(body)
        self.left -= len(body)
        self.tail += data[len(body) :]

    def row(self) -> tuple[int | None, int, str, str, int | None]:
        if self.fields is None or self.left or self.tail != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        kind, said = self.fields["WARC-Type"], self.fields["WARC-Payload-Digest"].removeprefix("sha1:")
        page = lambda key: None if (x := self.fields.get(key, "<urn:x-page:none>")[len("<urn:x-page:") : -1]) == "none" else int(x)
        if kind == "revisit":
            return page("WARC-Record-ID"), int(self.http["Content-Length"]), said, kind, page("WARC-Refers-To")
        found = base64.b32encode(self.digest.digest()).decode()
        if found != said:
            raise ValueError("a payload does not have its digest")
        return page("WARC-Record-ID"), self.n, found, kind, None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record in the archives at path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader, seen, due = None, None, 0, 0
        for batch in batches:
            out = []
            for record, no, of, data in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                if record != now or no == 0:
                    if seen != due:
                        raise ValueError("a chunk is missing")
                    now, reader, seen, due = record, Reader(), 0, of
                if no != seen:
                    raise ValueError("a chunk is missing")
                reader.feed(data.as_py())
                seen += 1
                if seen == due:
                    out.append(reader.row())
            if out:
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if seen != due:
            raise ValueError("a chunk is missing")

    table = spark.read.schema(SCHEMA).parquet(path)
    whole = table.where("chunks = 1").mapInArrow(run, PAGE)
    long = table.where("chunks <> 1").repartition("record").sortWithinPartitions("record", "chunk").mapInArrow(run, PAGE)
    return whole.union(long)


def export_files(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Writes the chunk table at path as .warc files into folder, which every executor must see; returns (file, bytes).

    One file for each partition of the table, written chunk by chunk under another
    name first, so that a file is whole and a task may be tried again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, size = f"{folder}/part-{task.partitionId():05d}.warc", 0
        unfinished = f"{folder}/.part-{task.partitionId():05d}-{task.taskAttemptId()}"
        with open(unfinished, "wb") as f:
            for batch in batches:
                for x in batch.column(0):
                    size += f.write(x.as_py())
        os.replace(unfinished, name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64())], names=["file", "bytes"])

    table = spark.read.schema(SCHEMA).parquet(path)
    table = table.repartition("record").sortWithinPartitions("record", "chunk")
    return table.select("data").mapInArrow(run, "file string, bytes long")
