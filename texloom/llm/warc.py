"""WARC archives as chunked record tables (operator 6).

Payloads travel as rows (record, chunk number, bytes): the engine cuts them at CHUNK bytes, the writer streams
them into gzip members, one a record, and the reader gives them back as rows of the same form. Both carry
an incremental SHA-1, so no record is held whole, however long.

Of records with equal payloads the one with the largest id is a response, the others revisit it (payloads
shorter than `revisit_from` bytes are always responses). Ids of groups come from an aggregate joined by
digest; those of payloads with many rows (at most KEY_SHARE) go to the rows, so no payload is a hot key.

A task writes its own files, named by its attempt; the manifest lists those of committed attempts only, so a
lost executor leaves an unlisted file, never a doubled record. Files go through pyarrow's file systems
(file, hdfs, s3, gs) below the cluster's shared folder.

Defined results: a null payload is empty; null ids and null addresses are kept (a null id's record has a name
of its own, unlike any id's); rows that repeat the largest id of a payload are all responses; records come back in any order; an
empty table gives no archive and an empty result; columns other than id, address and payload are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from texloom.llm.common import fresh_path, join_by_key, limit_batches, shared_dir

CHUNK, FILE_BYTES, READ_BYTES = 1 << 20, 256 << 20, 1 << 18
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Names of records: of an id, percent-escaped, and of a null id.
NAME, NO_NAME = "urn:x-record:", "urn:x-no-record:"

MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType())])
RECORD = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("digest_ok", T.BooleanType()),
    ]
)
CHUNKS = T.StructType(
    [
        T.StructField("archive", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("chunk_no", T.LongType()),
        T.StructField("chunk", T.BinaryType()),
        T.StructField("digest_so_far", T.StringType()),
    ]
)


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _line(value: str) -> str:
    """A header value: control characters and line ends as percent escapes."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def _name(value: str | None) -> str:
    return NO_NAME if value is None else NAME + quote(value, safe="")


class _Archive:
    """A file of gzip members."""

    def __init__(self, folder: str, name: str):
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        self.path = f"{folder}/{name}"
        self.out = system.open_output_stream(f"{path}/{name}", compression=None)
        self.records, self.size, self.gzip = 0, 0, None

    def begin(self) -> None:
        self.gzip = zlib.compressobj(1, zlib.DEFLATED, 31)
        self.records += 1

    def write(self, data: bytes) -> None:
        if part := self.gzip.compress(data):
            self.size += len(part)
            self.out.write(part)

    def end(self) -> None:
        self.write(b"\r\n\r\n")
        part = self.gzip.flush()
        self.size += len(part)
        self.out.write(part)

    def row(self) -> tuple[str, int, int]:
        self.out.close()
        return self.path, self.records, self.size


def chunk_rows(pages: DataFrame, id_col: str, url_col: str, payload_col: str, revisit_from: int = 0, chunk: int = CHUNK) -> DataFrame:
    """pages -> (record_id, url, sha1, bytes, keeper, chunk_no, chunks, chunk): the chunks of a record follow each other."""
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    grouped = F.col("bytes") >= revisit_from
    last = rows.where(grouped).groupBy("sha1").agg(F.max("id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    own = join_by_key(rows.where(grouped), last, "sha1")
    keeper = F.when(~F.col("id").eqNullSafe(F.col("keeper")), F.col("keeper").cast("string"))
    rows = own.select("id", "url", "sha1", "bytes", keeper.alias("keeper"), "payload")
    if revisit_from > 0:
        short = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
        short = short.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload")).where(~grouped)
        rows = rows.unionByName(short.select("id", "url", "sha1", "bytes", F.lit(None).cast("string").alias("keeper"), "payload"))
    # a record becomes a row a chunk, each cut out when it is asked for: beside the payload there is one chunk at a time
    count = F.when(F.col("keeper").isNull(), F.greatest(F.ceil(F.col("bytes") / chunk), F.lit(1))).otherwise(F.lit(1)).cast("int")
    part = F.when(F.col("keeper").isNull(), F.substring(F.col("payload"), F.col("chunk_no") * chunk + 1, F.lit(chunk))).otherwise(F.lit(b""))
    rows = rows.select("id", "url", "sha1", "bytes", "keeper", "payload", count.alias("chunks"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk_no"))
    return rows.select(F.col("id").cast("string").alias("record_id"), "url", "sha1", "bytes", "keeper", "chunks", "chunk_no", part.alias("chunk"))


def write_archives(chunks: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write rows of `chunk_rows` as WARC files below folder; the manifest, written there as well."""
    spark = chunks.sparkSession
    limit_batches(spark)
    columns = ["record_id", "url", "sha1", "bytes", "keeper", "chunks", "chunk_no", "chunk"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        archive, number, done, digest = None, 0, [], None
        for batch in batches:
            for name, url, sha1, size, keeper, total, at, part in zip(*(batch.column(i).to_pylist() for i in range(len(columns))), strict=True):
                if archive is None:
                    archive = _Archive(folder, f"archive-{task.partitionId():06d}-{task.taskAttemptId()}-{number}.warc.gz")
                    number += 1
                if at == 0:
                    archive.begin()
                    digest = hashlib.sha1()
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
                    head = ["WARC/1.1", f"WARC-Type: {'response' if keeper is None else 'revisit'}", f"WARC-Record-ID: <{_name(name)}>", f"WARC-Date: {DATE}"]
                    head += [f"WARC-Target-URI: {_line(url)}"] if url is not None else []
                    head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_name(keeper)}>"] if keeper is not None else []
                    head += [f"WARC-Payload-Digest: sha1:{base32_sha1(bytes.fromhex(sha1))}", "Content-Type: application/http; msgtype=response"]
                    head += [f"Content-Length: {len(http) + (size if keeper is None else 0)}", "", ""]
                    archive.write("\r\n".join(head).encode() + http)
                digest.update(part)
                archive.write(part)
                if at == total - 1:
                    if keeper is None and digest.hexdigest() != sha1:
                        raise ValueError(f"the chunks of record {name} are not its payload")
                    archive.end()
                    if archive.size >= file_bytes:
                        done.append(archive.row())
                        archive = None
        if archive is not None:
            done.append(archive.row())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=MANIFEST.names)

    chunks.select(columns).mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


class _Stream:
    """The uncompressed bytes of a file of gzip members, a bounded part at a time."""

    def __init__(self, path: str):
        system, own = fs.FileSystem.from_uri(path)
        self.source = system.open_input_stream(own, compression=None)
        self.gzip, self.raw, self.buffer = zlib.decompressobj(31), b"", b""

    def more(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.source.read(READ_BYTES)
                if not self.raw:
                    return False
            if self.gzip.eof:
                self.gzip = zlib.decompressobj(31)
            part = self.gzip.decompress(self.raw, READ_BYTES)
            self.raw = self.gzip.unused_data if self.gzip.eof else self.gzip.unconsumed_tail
            if part:
                self.buffer += part
                return True

    def until(self, mark: bytes) -> bytes | None:
        begin = 0
        while (at := self.buffer.find(mark, begin)) < 0:
            begin = max(0, len(self.buffer) - len(mark) + 1)
            if not self.more():
                return None
        head, self.buffer = self.buffer[:at], self.buffer[at + len(mark) :]
        return head

    def take(self, n: int, part: int) -> Iterator[bytes]:
        """The next n bytes, in parts of `part` bytes."""
        while n:
            want = min(n, part)
            while len(self.buffer) < want:
                if not self.more():
                    raise EOFError("the archive ends inside a record")
            yield self.buffer[:want]
            self.buffer = self.buffer[want:]
            n -= want


def _headers(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")[1:])}


def _record_name(value: str | None) -> str | None:
    name = "" if value is None else value.strip("<>")
    return unquote(name.removeprefix(NAME)) if name.startswith(NAME) else None


def records_of(path: str, chunk: int = CHUNK) -> Iterator[tuple[dict, Iterator[bytes]]]:
    """The records of an archive: headers (with the HTTP ones under `http`), and the payload's parts. A record's parts
    are to be read before the next record."""
    stream = _Stream(path)
    while (block := stream.until(b"\r\n\r\n")) is not None:
        if not block.strip():
            continue
        head = _headers(block.lstrip(b"\r\n"))
        http = stream.until(b"\r\n\r\n")
        head["http"] = _headers(http)
        rest = int(head["content-length"]) - len(http) - 4
        parts = stream.take(rest, chunk)
        yield head, parts
        for _ in parts:
            pass


def _spread(manifest: DataFrame) -> DataFrame:
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(parts, "path")


def read_records(manifest: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """RECORD rows of the archives: sizes and digests of responses are counted over their streamed payloads, those of revisits are the
    referred payload's, as the record tells them. digest_ok: what was read has the digest that the record tells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for head, parts in records_of(path, chunk):
                    told = head["warc-payload-digest"].removeprefix("sha1:")
                    size, digest = 0, hashlib.sha1()
                    for part in parts:
                        size += len(part)
                        digest.update(part)
                    found = base32_sha1(digest.digest())
                    revisit = head["warc-type"] == "revisit"
                    rows.append(
                        (_record_name(head["warc-record-id"]), head.get("warc-target-uri"), head["warc-type"], _record_name(head.get("warc-refers-to")))
                        + ((int(head["http"]["content-length"]), told, True) if revisit else (size, found, found == told))
                    )
                    if len(rows) >= 5000:
                        yield _batch(rows, RECORD)
                        rows = []
                if rows:
                    yield _batch(rows, RECORD)

    return _spread(manifest).mapInArrow(run, RECORD)


def read_chunks(manifest: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """CHUNKS rows of the archives' responses: each with the digest of the payload up to its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                for head, parts in records_of(path, chunk):
                    digest = hashlib.sha1()
                    for number, part in enumerate(parts):
                        digest.update(part)
                        rows.append((path, _record_name(head["warc-record-id"]), number, part, base32_sha1(digest.digest())))
                        held += len(part)
                        if held >= 4 * CHUNK:
                            yield _batch(rows, CHUNKS)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, CHUNKS)

    return _spread(manifest).mapInArrow(run, CHUNKS)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {T.StringType: pa.string(), T.LongType: pa.int64(), T.BinaryType: pa.binary(), T.BooleanType: pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[type(f.dataType)]) for c, f in zip(zip(*rows, strict=True), schema.fields, strict=True)], names=schema.names)


def archive_folder(spark: SparkSession) -> str:
    shared_dir(spark)
    return fresh_path(spark, "warc")
