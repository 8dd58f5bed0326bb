"""WARC archives through a chunked record table.

A record is a run of rows (record, chunk number, bytes): payloads are cut into chunks of a fixed size, so neither writer nor
reader ever allocates a whole record. The writer takes the rows of a partition in order and streams them into one
archive in the shared folder; the reader streams an archive back into such rows, each with the digest of the payload so
far, so a record's last chunk carries the digest of all of it.

Of records with equal payloads of at least ``min_bytes`` the one with the largest page_id is a response, the others are
revisits of it without payload. Archives are named by task attempt, and only those named in the committed manifest are
read, so failed or repeated attempts leave nothing that counts.

Defined results: null payloads are empty; a row repeated with equal id and payload is the same record, so each repetition
has the same type; among equal payloads null ids are revisits, and responses if all ids are null; page ids are written as
text and so can be of any type; line breaks in urls are percent-encoded; with no pages there are no archives and no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_dir, table

CHUNK = 32 << 10
MIN_REVISIT_BYTES = 1000
# Field names and layout of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def decide(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to; revisits have no payload."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    groups = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
    groups = materialise(groups.where("n > 1").drop("n"), "warc-repeats")
    joined = rows.join(groups.withColumn("again", F.lit(True)), ["payload_digest", "payload_bytes"], "left")
    revisit = F.coalesce("again", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select(
        "page_id", "url", F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def chunk_rows(records: DataFrame, size: int = CHUNK) -> DataFrame:
    """One row per chunk, in order; a record without payload has one empty chunk."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("payload") / F.lit(size))).cast("int")
    rows = records.withColumn("n_chunks", n).withColumn("stored_bytes", F.octet_length("payload").cast("long")).select("*", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk_no"))
    return rows.withColumn("data", F.substring("payload", F.col("chunk_no") * F.lit(size) + 1, F.lit(size))).drop("payload")


def _head(row: dict) -> bytes:
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    fields = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", name(row["page_id"])),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", row["url"].replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"),
        ("Payload-Length", str(row["payload_bytes"])),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", str(row["stored_bytes"])),
    ]
    if row["record_type"] == "revisit":
        fields += [("WARC-Refers-To", name(row["refers_to"])), ("WARC-Profile", REVISIT_PROFILE)]
    return VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n"


def write(chunks: DataFrame, folder: str) -> DataFrame:
    """Stream chunk rows into archives; returns the committed manifest (file, n_records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        context = TaskContext.get()
        file = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.warc"
        out, n = None, 0
        for rb in batches:
            for k in range(rb.num_rows):
                row = rb.slice(k, 1).to_pylist()[0]
                if out is None:
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(f"{path}/{file}")
                if row["chunk_no"] == 0:
                    out.write(_head(row))
                out.write(row["data"])
                if row["chunk_no"] == row["n_chunks"] - 1:
                    out.write(b"\r\n\r\n")
                    n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{file}"]), pa.array([n], pa.int64())], ["file", "n_records"])

    order = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "stored_bytes", "n_chunks", "chunk_no", "data"]
    return materialise(chunks.select(*order).mapInArrow(run, "file string, n_records long"), "warc-manifest")


def stream_records(src: BinaryIO, size: int = CHUNK) -> Iterator[tuple[dict[str, str], int, bytes, bool]]:
    """(fields, chunk number, bytes, whether it is the last chunk) of each record of an open archive."""
    while line := src.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:60]!r}")
        fields: dict[str, str] = {}
        while (line := src.readline().rstrip(b"\r\n")):
            key, _, value = line.decode().partition(":")
            fields[key.strip().lower()] = value.strip()
        left, k = int(fields["content-length"]), 0
        while True:
            data = src.read(min(size, left))
            if left and not data:
                raise EOFError("the archive ends inside a record")
            left -= len(data)
            yield fields, k, data, not left
            k += 1
            if not left:
                break


_READ = "record string, chunk_no int, is_last boolean, chunk_bytes long, digest_so_far string, bytes_so_far long, record_type string, refers_to string, stated_bytes long, stated_digest string, url string"


def read(manifest: DataFrame, with_data: bool = False, size: int = CHUNK) -> DataFrame:
    """The chunk rows of all archives of a manifest, one archive at a time in each task."""
    schema = _READ + ", data binary" * with_data
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "long": pa.int64(), "binary": pa.binary()}
    kinds = [types[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for file in rb.column("file").to_pylist():
                store, path = fs.FileSystem.from_uri(file if "://" in file or file.startswith("file:") else f"file://{file}")
                rows: list[tuple] = []
                with store.open_input_stream(path, buffer_size=1 << 16) as raw:
                    digest, total = hashlib.sha1(), 0
                    for fields, k, data, last in stream_records(_Lines(raw), size):
                        if k == 0:
                            digest, total = hashlib.sha1(), 0
                        digest.update(data)
                        total += len(data)
                        row = (fields["warc-record-id"][10:-1], k, last, len(data), digest.hexdigest(), total, fields["warc-type"], fields.get("warc-refers-to", "<urn:page:>")[10:-1] or None, int(fields["payload-length"]), fields["warc-payload-digest"][5:], fields["warc-target-uri"])
                        rows.append((*row, data) if with_data else row)
                        if len(rows) >= (64 if with_data else 4096):
                            yield _batch(rows, names, kinds)
                            rows = []
                if rows:
                    yield _batch(rows, names, kinds)

    return manifest.select("file").repartition(max(1, manifest.count())).mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class _Lines:
    """readline and read over a stream that only reads blocks."""

    def __init__(self, raw: pa.NativeFile, block: int = 1 << 18) -> None:
        self.raw, self.block, self.held, self.at = raw, block, b"", 0

    def _fill(self) -> bool:
        more = self.raw.read(self.block)
        self.held, self.at = self.held[self.at :] + more, 0
        return bool(more)

    def readline(self) -> bytes:
        while (end := self.held.find(b"\n", self.at)) < 0:
            if not self._fill():
                end = len(self.held) - 1
                break
        line, self.at = self.held[self.at : end + 1], end + 1
        return line

    def read(self, n: int) -> bytes:
        while len(self.held) - self.at < n and self._fill():
            pass
        data = self.held[self.at : self.at + n]
        self.at += len(data)
        return data


def records(chunks: DataFrame, id_type: str = "long") -> DataFrame:
    """One row per record from its last chunk, whose digest and length are of the whole payload.

    A response whose bytes don't match what its header states raises an error.
    """
    wrong = (F.col("record_type") == "response") & ((F.col("digest_so_far") != F.col("stated_digest")) | (F.col("bytes_so_far") != F.col("stated_bytes")))
    digest = F.when(wrong, F.raise_error(F.concat(F.lit("damaged record "), F.col("record")))).otherwise(F.col("stated_digest"))
    return chunks.where("is_last").select(
        F.when(F.col("record") != "", F.col("record")).cast(id_type).alias("page_id"), F.col("stated_bytes").alias("payload_bytes"),
        digest.alias("payload_digest"), "record_type", F.col("refers_to").cast(id_type).alias("refers_to"),
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    manifest = write(chunk_rows(decide(pages)), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    return records(read(manifest), pages.schema["page_id"].dataType.simpleString())


QUERIES = {"op3_warc": op3_warc}
ORACLE_SQL = {
    "op3_warc": """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html) as payload_bytes, sha1(html) as payload_digest from p),
g as (select payload_digest, payload_bytes, max(page_id) as keep from d where payload_bytes >= 1000 group by 1, 2)
select d.page_id, d.payload_bytes, d.payload_digest,
  case when g.keep is not null and d.page_id is distinct from g.keep then 'revisit' else 'response' end as record_type,
  case when g.keep is not null and d.page_id is distinct from g.keep then g.keep end as refers_to
from d left join g using (payload_digest, payload_bytes)
"""
}
