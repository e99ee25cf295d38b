"""WARC archives: a deterministic sharded writer and its reader.

Records are dealt into ranges of ids of about equal bytes, sorted, and written one gzip member each into files that
roll at a compressed size. A task writes under a temporary name of its own; only the rows that the winning task
attempts return make the manifest, and the manifest's files are then given their final names. Names and contents
follow from the rows alone, so a run repeated after a loss writes the same bytes. Files are reached through
pyarrow's file systems, so the root is a path or URI that all executors share.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navloom.llm.ranges import even_ranges, in_range
from navloom.session import settle

LEAST_REVISIT = 100  # shorter payloads are written in full each time
SHARD_BYTES = 16 << 20  # payload bytes of a range of ids, about
ROLL_BYTES = 8 << 20  # compressed bytes after which a file is closed
DATE = "2024-01-01T00:00:00Z"  # WARC-Date of records, a parameter

MANIFEST = "file STRING, temporary STRING, records BIGINT, bytes BIGINT, sha256 STRING"
RECORD = "page_id BIGINT, url STRING, record_type STRING, payload_bytes BIGINT, payload_digest STRING, refers_to BIGINT, payload BINARY"


def record_id(page_id: int | None, digest: str, nth: int) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{digest[:16]}:{nth}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, nth: int, date: str) -> bytes:
    """One record: a response with its payload, or a revisit with the response's HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest, nth)}",
            f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if url:
        head.append("WARC-Target-URI: " + "".join(c if 0x20 < ord(c) < 0x7F else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if refers_to is None:
        block = http + payload
    else:
        block = http
        head += [f"WARC-Refers-To: {record_id(refers_to, digest, 0)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without a time stamp."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


class _Files:
    """The files of the shard at hand, each under a temporary name until the manifest is done."""

    def __init__(self, root: str, roll_bytes: int):
        self.system, self.base = fs.FileSystem.from_uri(root)
        self.system.create_dir(f"{self.base}/_temporary", recursive=True)
        self.roll_bytes, self.out, self.done = roll_bytes, None, []
        self.shard, self.number = None, 0

    def write(self, shard: int, data: bytes) -> None:
        if self.shard != shard:
            self.close()
            self.shard, self.number = shard, 0
        if self.out is None:
            self.name = f"shard-{shard:06d}-{self.number:05d}.warc.gz"
            self.temporary = f"_temporary/{self.name}.{uuid.uuid4().hex}"
            self.out = self.system.open_output_stream(f"{self.base}/{self.temporary}", compression=None)
            self.digest, self.size, self.records = hashlib.sha256(), 0, 0
        self.out.write(data)
        self.digest.update(data)
        self.size += len(data)
        self.records += 1
        if self.size >= self.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.temporary, self.records, self.size, self.digest.hexdigest()))
            self.out, self.number = None, self.number + 1

    def rows(self) -> pa.RecordBatch:
        done, self.done = self.done, []
        columns = list(zip(*done)) or [()] * 5
        types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["file", "temporary", "records", "bytes", "sha256"])


def _write(root: str, roll_bytes: int, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(root, roll_bytes)
        last, nth, revisits = None, 0, {}
        for batch in batches:
            for shard, page_id, digest, url, payload, refers_to in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if (shard, page_id) != last:
                    last, nth, revisits = (shard, page_id), 0, {}
                if payload is None:  # which payload of this id has its response elsewhere; comes before the rows
                    revisits[digest] = refers_to
                    continue
                files.write(shard, member(record(page_id, url, payload, digest, revisits.get(digest), nth, date)))
                nth += 1
            yield files.rows()
        files.close()
        yield files.rows()
    return write


def _name(root: str):
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for final, temporary in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if system.get_file_info(f"{base}/{temporary}").type != fs.FileType.NotFound:  # else an earlier try did it
                    system.move(f"{base}/{temporary}", f"{base}/{final}")
            yield batch
    return name


def write_archives(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_revisit: int = LEAST_REVISIT,
                   shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, date: str = DATE) -> DataFrame:
    """Writes a record per row under `root`, a new folder, and returns the manifest (also kept in `root`/manifest).

    Of rows with equal payloads of at least `least_revisit` bytes, the one with the smallest id is the response and
    the others revisit it; if several rows have that id, all are responses. A null payload is empty. A row with a
    null id is a response, sorted last. Repeated rows are so many records. Other columns are left out."""
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    pages = pages.withColumn("digest", F.sha2("payload", 256))
    light = settle(pages.select("page_id", "digest", F.octet_length("payload").cast("long").alias("size")), "payloads")
    repeated = light.where((F.col("size") >= least_revisit) & F.col("page_id").isNotNull())
    first = settle(repeated.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").drop("last"), "responses")
    revisits = repeated.join(first, "digest").where("page_id > first").select("page_id", "digest", "first").distinct()
    bounds = even_ranges(light, "page_id", "size", shard_bytes) or [0]
    rows = pages.select("page_id", "digest", "url", "payload", F.lit(None).cast("long").alias("refers_to"))
    marks = revisits.select("page_id", "digest", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), F.col("first").alias("refers_to"))
    rows = rows.unionByName(marks).withColumn("shard", in_range(F.col("page_id"), bounds))
    rows = rows.repartition(len(bounds), "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), F.col("payload").isNotNull(), "digest", "url")
    written = rows.select("shard", "page_id", "digest", "url", "payload", "refers_to").mapInArrow(_write(root, roll_bytes, date), MANIFEST)
    written.write.parquet(f"{root}/_manifest")  # the commit: only what finished tasks returned
    spark.read.parquet(f"{root}/_manifest").mapInArrow(_name(root), MANIFEST).drop("temporary").write.parquet(f"{root}/manifest")
    return spark.read.parquet(f"{root}/manifest")


def records_in(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a file of gzip members."""
    left = b""
    squeeze = zlib.decompressobj(31)
    chunks: list[bytes] = []
    while True:
        if not left:
            left = stream.read(1 << 20)
            if not left:
                break
        chunks.append(squeeze.decompress(left))
        left = b""
        if squeeze.eof:
            left, squeeze = squeeze.unused_data, zlib.decompressobj(31)
            head, _, rest = b"".join(chunks).partition(b"\r\n\r\n")
            chunks = []
            headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield headers, rest[:int(headers["Content-Length"])]
    if chunks and any(chunks):
        raise ValueError("the file ends inside a record")


def _read(root: str, with_payload: bool):
    def page_of(name: str) -> int | None:
        part = name.split(":")[2]
        return None if part == "none" else int(part)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                            ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with system.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for headers, block in records_in(stream):
                        if hashlib.sha256(block).hexdigest() != headers["WARC-Block-Digest"].removeprefix("sha256:"):
                            raise ValueError(f"{name}: block digest of {headers['WARC-Record-ID']} differs")
                        head, _, payload = block.partition(b"\r\n\r\n")
                        http = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                        digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha256:"), headers["WARC-Type"]
                        if kind == "response" and (len(payload) != int(http["Content-Length"]) or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{name}: payload of {headers['WARC-Record-ID']} differs")
                        rows.append((page_of(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), kind, int(http["Content-Length"]), digest,
                                     page_of(headers["WARC-Refers-To"]) if kind == "revisit" else None, payload if with_payload and kind == "response" else None))
                        if len(rows) >= 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    return read


def read_archives(spark: SparkSession, root: str, with_payload: bool = False) -> DataFrame:
    """The records of the manifest's files, digests verified. A revisit's sizes and digest are the full payload's."""
    files = spark.read.parquet(f"{root}/manifest").select("file")
    n = max(1, files.count())
    return files.repartition(n, "file").mapInArrow(_read(root, with_payload), RECORD)
