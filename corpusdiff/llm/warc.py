"""WARC archives as a PySpark data source, and crawls written as archives with revisit records.

Reading: partitions are planned from the archive files, small files together, one task per about ``partition_bytes``. Predicates on the record type and on
the other header columns are pushed into the reader. It parses a record's header first; a record that fails a predicate is skipped by its length, without reading
(plain files) or decoding its payload. With option ``payload`` false, payloads are not sent to Spark at all.

Writing: each task streams its rows to files of at most about ``file_bytes``, under names no other attempt uses. The commit writes a manifest of the files of
successful tasks, and readers of the folder go by it, so a lost executor or a second attempt leaves nothing visible.

Paths are URIs that ``pyarrow.fs`` opens (local and shared mounts, HDFS, object stores).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, IsNull, StringStartsWith,
    WriterCommitMessage,
)

from corpusdiff.llm.common import stored
from corpusdiff.session import scratch_table_path

MANIFEST = "_warc_manifest.json"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Header columns and the header each one holds.
HEADERS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
    "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "content_type": "content-type",
}
SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in HEADERS]
    + [T.StructField("headers", T.MapType(T.StringType(), T.StringType())), T.StructField("payload_bytes", T.LongType()),
       T.StructField("payload", T.BinaryType())]
)
ARROW = pa.schema([(c, pa.string()) for c in HEADERS] + [("headers", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
ROWS_AT_ONCE, BYTES_AT_ONCE = 1000, 8 << 20


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    """Archive files of one task."""

    paths: tuple[str, ...]

    def __init__(self, paths):
        super().__init__(tuple(paths))
        self.paths = tuple(paths)


def _split_http(block: bytes, content_type: str) -> tuple[dict[str, str], bytes]:
    """HTTP headers and payload of a block; a block that is no HTTP message is all payload."""
    if "application/http" not in content_type:
        return {}, block
    head, _, body = block.partition(b"\r\n\r\n")
    return _fields(head.split(b"\r\n")[1:]), body


def _fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.partition(b":") for line in lines if b":" in line)
    return {k.strip().lower().decode("utf-8", "replace"): v.strip().decode("utf-8", "replace") for k, _, v in pairs}


def records(stream, seekable: bool, wanted) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(header, block)`` of the records whose header passes ``wanted``."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        lines = []
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError("a WARC header without an end")
            if line[:1] in b" \t" and lines:
                lines[-1] += b" " + line.strip()
            else:
                lines.append(line.rstrip(b"\r\n"))
        header = _fields(lines)
        left = int(header["content-length"])
        if wanted(header):
            block = stream.read(left)
            if len(block) < left:
                raise ValueError("a WARC record without an end")
            yield header, block
        elif seekable:
            stream.seek(left, io.SEEK_CUR)
        else:
            while left and (part := stream.read(min(left, 1 << 20))):
                left -= len(part)


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.with_payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.partition_bytes = int(options.get("partition_bytes", 32 << 20))
        self.predicates = []

    def pushFilters(self, filters):
        for f in filters:
            known = isinstance(f, (EqualTo, EqualNullSafe, In, StringStartsWith, IsNotNull, IsNull)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS
            if known:
                self.predicates.append((type(f).__name__, HEADERS[f.attribute[0]], getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        system, root = _filesystem(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.File:
            found = [(root, info.size)]
        elif system.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
            with system.open_input_stream(f"{root}/{MANIFEST}") as f:
                found = [(f"{root}/{name}", size) for name, size in json.loads(f.read())]
        else:
            listed = system.get_file_info(fs.FileSelector(root, recursive=True))
            found = sorted((x.path, x.size) for x in listed if x.path.endswith((".warc", ".warc.gz")))
        parts, size = [[]], 0
        for path, n in found:
            if parts[-1] and size + n > self.partition_bytes:
                parts.append([])
                size = 0
            parts[-1].append(path)
            size += n
        return [Files(p) for p in parts]

    def _wanted(self, header: dict[str, str]) -> bool:
        for kind, name, value in self.predicates:
            own = header.get(name)
            if kind == "IsNull":
                passed = own is None
            elif kind == "EqualNullSafe" and value is None:
                passed = own is None
            elif own is None:
                passed = False
            elif kind in ("EqualTo", "EqualNullSafe"):
                passed = own == value
            elif kind == "In":
                passed = own in value
            elif kind == "StringStartsWith":
                passed = own.startswith(value)
            else:
                passed = True
            if not passed:
                return False
        return True

    def read(self, partition):
        system, _ = _filesystem(self.path)
        rows, size = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as raw:
                packed = path.endswith(".gz")
                stream = gzip.GzipFile(fileobj=raw) if packed else io.BufferedReader(raw, 1 << 20)
                for header, block in records(stream, not packed, self._wanted):
                    http, payload = _split_http(block, header.get("content-type", ""))
                    revisit = header.get("warc-type") == "revisit"
                    length = int(http.get("content-length", len(payload))) if revisit else len(payload)
                    digest = header.get("warc-payload-digest", "")
                    if self.verify and not revisit and digest.startswith("sha1:") and digest[5:] != sha1_base32(payload):
                        raise ValueError(f"payload of {header.get('warc-record-id')} in {path} does not match its digest")
                    rows.append((*(header.get(h) for h in HEADERS.values()), list(header.items()), length, payload if self.with_payload and not revisit else None))
                    size += len(payload) if self.with_payload else 0
                    if len(rows) >= ROWS_AT_ONCE or size >= BYTES_AT_ONCE:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


@dataclass
class _Written(WriterCommitMessage):
    files: list


def _line(name: str, value: str) -> str:
    """A header line; line ends in a value, which would end the header, are percent-encoded."""
    return f"{name}: {value.replace(chr(13), '%0D').replace(chr(10), '%0A')}\r\n"


def record_bytes(row: dict) -> bytes:
    """A response or revisit record. Either block has the HTTP header with the length of the full payload; only a response has the payload."""
    revisit = row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http if revisit else http + row["payload"]
    head = "WARC/1.1\r\n" + _line("WARC-Type", row["record_type"]) + _line("WARC-Record-ID", row["record_id"]) + _line("WARC-Date", row["date"])
    if row["target_uri"] is not None:
        head += _line("WARC-Target-URI", row["target_uri"])
    if revisit:
        head += _line("WARC-Profile", REVISIT_PROFILE) + _line("WARC-Refers-To", row["refers_to"])
    head += _line("WARC-Payload-Digest", f"sha1:{sha1_base32(row['payload'])}")
    head += _line("Content-Type", "application/http; msgtype=response") + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite):
        self.path, self.overwrite = options["path"], overwrite
        self.file_bytes = int(options.get("file_bytes", 64 << 20))
        self.packed = options.get("compression", "none").lower() == "gzip"

    def write(self, iterator):
        system, root = _filesystem(self.path)
        system.create_dir(root)
        files, out, name, size = [], None, "", 0
        for batch in iterator:
            for row in batch.to_pylist():
                data = record_bytes(row)
                data = gzip.compress(data, 6) if self.packed else data
                if out is None or size + len(data) > self.file_bytes:
                    if out is not None:
                        out.close()
                        files.append((name, size))
                    name, size = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.packed, 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            files.append((name, size))
        return _Written(files)

    def commit(self, messages):
        system, root = _filesystem(self.path)
        system.create_dir(root)
        manifest = sorted(tuple(f) for m in messages if m is not None for f in m.files)
        with system.open_output_stream(f"{root}/{MANIFEST}", compression=None) as f:
            f.write(json.dumps(manifest).encode())

    def abort(self, messages):
        system, root = _filesystem(self.path)
        for m in messages:
            for name, _ in m.files if m is not None else ():
                system.delete_file(f"{root}/{name}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def crawl_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 0, date: str = "2025-01-01T00:00:00Z") -> DataFrame:
    """The WARC record of each row. Of equal payloads of at least ``min_bytes``, that with the smallest id is the response, the others revisit it.

    A null body is an empty payload. Repeated rows with the smallest id are all responses. Ids that are null revisit if a response with an id exists. The smallest
    id per digest is a partial aggregate, so payloads with very many copies are no hot group, and the join that brings it back is split by Spark.
    """
    payload = F.coalesce(F.encode(F.col(body_col), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("target_uri"), payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    first = stored(rows.groupBy("sha1").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "payload-ids")
    size = F.length("payload").cast("long")
    revisit = F.coalesce(~F.col("id").eqNullSafe(F.col("first")) & F.col("first").isNotNull() & (size >= min_bytes), F.lit(False))
    return rows.join(first, "sha1", "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        _record_id(F.col("id")).alias("record_id"), "target_uri", F.lit(date).alias("date"),
        F.when(revisit, _record_id(F.col("first"))).alias("refers_to"), size.alias("payload_bytes"), "payload",
    )


def write_archive(records: DataFrame, path: str | None = None, **options: str) -> str:
    """Write records as an archive folder, by default a fresh one in the shared folder; returns its path."""
    spark = records.sparkSession
    register(spark)
    path = path or scratch_table_path(spark, "warc")
    records.write.format("warc").mode("append").options(**options).save(path)
    return path


def read_archive(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The records of a file or folder: ``SCHEMA``. Filters on the columns of ``HEADERS`` are pushed into the reader."""
    register(spark)
    return spark.read.format("warc").options(**options).load(path)


def id_of(record_id: Column, kind: str = "long") -> Column:
    """The id in a record id that ``crawl_records`` made; null for none."""
    return F.regexp_extract(record_id, r"^<urn:record:(.*)>$", 1).try_cast(kind)
