"""WARC: a Python data source that writes and reads web archives.

Reading plans one partition per archive file, takes over predicates on the record type and on headers that are columns,
parses a record's headers first and leaves unwanted payloads undecoded: a plain archive seeks past them, a compressed one
too where the member says how long it is (the `sl` extra field that writers of skippable archives use).

Writing makes one gzip member per record; files come into view under their final names only when the whole job commits, so a
task that runs twice, or dies, leaves nothing behind. Folders are reached through pyarrow's file systems: local, HDFS, S3 ...
"""

from __future__ import annotations

import hashlib
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    WriterCommitMessage,
)

from pagemill.llm.common import SALTS, shared_folder, ship

SCHEMA = (
    "path string, offset bigint, record_type string, record_id string, target_uri string, date string, payload_digest string, "
    "refers_to string, content_type string, content_length bigint, http_length bigint, payload binary"
)
#: What a writer takes; columns beyond these are refused.
WRITE_COLUMNS = ("record_type", "record_id", "target_uri", "date", "payload_digest", "refers_to", "payload", "http_length")
#: Columns that are headers, for predicates: those on others stay with Spark.
HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}
#: An archive file is closed at so many bytes.
FILE_BYTES = 256 << 20
#: A batch of records that a reader gives holds about so many bytes.
BATCH_BYTES = 4 << 20
ARROW = pa.schema(
    [(n, pa.int64() if t == "bigint" else pa.binary() if t == "binary" else pa.string()) for n, t in (c.split() for c in SCHEMA.split(", "))]
)
_CHUNK = 1 << 18


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{posixpath.abspath(path)}" if not path.startswith("file:") else "file://" + path[5:])


# ---- records as bytes ------------------------------------------------------------------------------------------------


def record_bytes(row: dict) -> bytes:
    """One record. A revisit has the HTTP headers alone, with the length that the payload had."""
    kind = row.get("record_type") or "response"
    payload = row.get("payload") or b""
    length = row.get("http_length")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if length is None else length}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {row['record_id']}"]
    lines += [f"WARC-Date: {row.get('date') or '1970-01-01T00:00:00Z'}"]
    if row.get("target_uri") is not None:
        lines.append("WARC-Target-URI: " + " ".join(str(row["target_uri"]).splitlines()))
    if row.get("payload_digest") is not None:
        lines.append(f"WARC-Payload-Digest: {row['payload_digest']}")
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if row.get("refers_to") is not None:
            lines.append(f"WARC-Refers-To: {row['refers_to']}")
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 3) -> bytes:
    """A gzip member whose extra field `sl` holds the member's length and that of its content."""
    squeezer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeezer.compress(data) + squeezer.flush()
    head = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff"
    total = len(head) + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return head + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _headers(lines: bytes) -> dict[str, str]:
    """Header names in lower case; a continued line joins the one before."""
    out: dict[str, str] = {}
    last = None
    for line in lines.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


class _Plain:
    """Bytes of an uncompressed archive, one record after another."""

    def __init__(self, stream, at: int = 0):
        self.stream, self.at, self.buffer = stream, at, b""
        stream.seek(at)

    def next_record(self) -> int | None:
        while True:
            if not self._fill(1):
                return None
            if self.buffer[:1] in b"\r\n":
                self.take(1)
                continue
            return self.at

    def _fill(self, n: int) -> bool:
        while len(self.buffer) < n:
            more = self.stream.read(max(_CHUNK, n - len(self.buffer)))
            if not more:
                return False
            self.buffer += more
        return True

    def until(self, mark: bytes) -> bytes:
        found = self.buffer.find(mark)
        while found < 0:
            before = len(self.buffer)
            if not self._fill(before + 1):
                raise EOFError(f"a record's headers end early at {self.at}")
            found = self.buffer.find(mark, max(0, before - len(mark)))
        return self.take(found + len(mark))

    def take(self, n: int) -> bytes:
        if not self._fill(n):
            raise EOFError(f"a record ends early at {self.at}")
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        self.at += n
        return out

    def skip(self, n: int) -> None:
        self.at += n
        if n <= len(self.buffer):
            self.buffer = self.buffer[n:]
        else:
            self.buffer = b""
            self.stream.seek(self.at)


class _Gzip:
    """Bytes of an archive of gzip members. skip() past the end of a record needs no decompression if the member tells its length
    and holds no other record. All records of a member have its offset."""

    def __init__(self, stream):
        self.raw, self.at, self.inner, self.data, self.end = _Plain(stream), 0, None, b"", None
        self.size = self.inflated = self.unread = 0

    def next_record(self) -> int | None:
        if self._another():
            return self.at
        self.at = at = self.raw.at
        if not self.raw._fill(1):
            return None
        head = self.raw.buffer[:12] if self.raw._fill(12) else self.raw.buffer
        self.end = None
        if len(head) == 12 and head[3] & 4:
            size = struct.unpack("<H", head[10:12])[0]
            if self.raw._fill(12 + size):
                extra = self.raw.buffer[12 : 12 + size]
                while len(extra) >= 4:
                    n = struct.unpack("<H", extra[2:4])[0]
                    if extra[:2] == b"sl" and n == 8:
                        total, self.size = struct.unpack("<II", extra[4:12])
                        self.end = at + total
                    extra = extra[4 + n :]
        self.inner, self.data, self.inflated, self.unread = zlib.decompressobj(31), b"", 0, 0
        return at

    def _more(self) -> bool:
        if self.inner is None or self.inner.eof or not self.raw._fill(1):
            return False
        chunk = self.raw.buffer[:_CHUNK]
        more = self.inner.decompress(chunk)
        self.data += more
        self.inflated += len(more)
        self.raw.take(len(chunk) - len(self.inner.unused_data))
        return True

    def _another(self) -> bool:
        """Goes to the next record of the member, or to its end if there is none."""
        if self.inner is None:
            return False
        rest = self.size - (self.inflated - len(self.data)) - self.unread
        if self.end is not None and self.end > self.raw.at and rest % 2**32 <= 4:  # blank lines
            self.raw.skip(self.end - self.raw.at)
        else:
            while True:
                gone = min(self.unread, len(self.data))
                self.data, self.unread = self.data[gone:], self.unread - gone
                if not self.unread:
                    self.data = self.data.lstrip(b"\r\n")
                if self.data:
                    return True
                if not self._more():
                    break
        self.inner = None
        return False

    def until(self, mark: bytes) -> bytes:
        while (found := self.data.find(mark)) < 0:
            if not self._more():
                raise EOFError(f"a record's headers end early at {self.raw.at}")
        return self.take(found + len(mark))

    def take(self, n: int) -> bytes:
        parts, have = [self.data], len(self.data)
        while have < n:
            self.data = b""
            if not self._more():
                raise EOFError(f"a record ends early at {self.raw.at}")
            parts.append(self.data)
            have += len(self.data)
        whole = b"".join(parts)
        self.data = whole[n:]
        return whole[:n]

    def skip(self, n: int) -> None:
        """The rest of the record, inflated only if another may follow in its member."""
        self.unread = n


def read_records(stream, compressed: bool, wanted: dict[str, frozenset], payloads: bool = True) -> Iterator[dict]:
    """The records whose headers are as wanted, payloads decoded for those alone."""
    source = _Gzip(stream) if compressed else _Plain(stream)
    while (at := source.next_record()) is not None:
        head = _headers(source.until(b"\r\n\r\n"))
        length = int(head.get("content-length") or 0)
        if any(head.get(HEADERS[name]) not in values for name, values in wanted.items()):
            source.skip(length)
            continue
        out = {name: head.get(header) for name, header in HEADERS.items()}
        out |= {"offset": at, "content_type": head.get("content-type"), "content_length": length, "http_length": None, "payload": None}
        if (head.get("content-type") or "").startswith("application/http"):
            http = source.until(b"\r\n\r\n") if length else b""
            declared = _headers(http).get("content-length")
            out["http_length"] = int(declared) if declared else None
            left = length - len(http)
        else:
            left = length
        if payloads and out["record_type"] != "revisit":
            out["payload"] = source.take(left)
        else:
            source.skip(left)
        yield out


# ---- the data source -------------------------------------------------------------------------------------------------


@dataclass
class _File(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payloads = options["path"], str(options.get("payloads", "true")).lower() == "true"
        self.wanted: dict[str, frozenset] = {}

    def pushFilters(self, filters):
        """Takes equality and IN on header columns with string values; a header that is asked for is never null."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            values = frozenset([f.value]) if isinstance(f, EqualTo) else frozenset(f.value) if isinstance(f, In) else None
            if name in HEADERS and values is not None and all(isinstance(v, str) for v in values):
                self.wanted[name] = self.wanted.get(name, values) & values
            elif not (isinstance(f, IsNotNull) and name in ("record_type", "path", "offset")) or isinstance(f, IsNull):
                yield f

    def partitions(self):
        store, path = _filesystem(self.path)
        files = [f for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and f.base_name.endswith((".warc", ".warc.gz"))]
        return [_File(f.path) for f in sorted(files, key=lambda f: -f.size)]

    def read(self, partition):
        if partition is None:
            return
        store, _ = _filesystem(self.path)
        rows, held = [], 0
        with store.open_input_file(partition.path) as stream:
            for r in read_records(stream, partition.path.endswith(".gz"), self.wanted, self.payloads):
                r["path"] = partition.path
                rows.append(r)
                held += len(r["payload"] or b"") + 500
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


@dataclass
class _Written(WriterCommitMessage):
    names: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.compressed = str(options.get("compressed", "true")).lower() == "true"
        self.level, self.job = int(options.get("level", 3)), uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        store, base = _filesystem(self.path)
        context = TaskContext.get()
        folder = f"{base}/_temporary-{self.job}"
        store.create_dir(folder, recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                for row in (r for at in range(0, batch.num_rows, 64) for r in batch.slice(at, 64).to_pylist()):
                    if out is None:
                        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{len(names)}.warc{'.gz' * self.compressed}"
                        out, size = store.open_output_stream(f"{folder}/{name}", compression=None), 0
                        names.append(name)
                    data = record_bytes(row)
                    data = gzip_member(data, self.level) if self.compressed else data
                    out.write(data)
                    size += len(data)
                    if size >= FILE_BYTES:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return _Written(names)

    def commit(self, messages) -> None:
        store, base = _filesystem(self.path)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                if f.base_name != f"_temporary-{self.job}":
                    (store.delete_file if f.is_file else store.delete_dir)(f.path)
        store.create_dir(base, recursive=True)
        for name in (n for m in messages if m for n in m.names):
            store.move(f"{base}/_temporary-{self.job}/{name}", f"{base}/{name}")
        self.abort(messages)

    def abort(self, messages) -> None:
        store, base = _filesystem(self.path)
        if store.get_file_info(f"{base}/_temporary-{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{base}/_temporary-{self.job}")


class WarcDataSource(DataSource):
    """spark.read.format("warc").option("payloads", "true").load(folder); df.write.format("warc").option("compressed", "true").save(folder)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        unknown = set(schema.fieldNames()) - set(WRITE_COLUMNS)
        if unknown or "record_id" not in schema.fieldNames():
            raise ValueError(f"a WARC record has record_id and some of {WRITE_COLUMNS}; not {sorted(unknown)}")
        return WarcWriter(self.options, overwrite)


def register(spark) -> None:
    ship(spark)
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# ---- pages to archives and back --------------------------------------------------------------------------------------

#: Payloads below this are never revisits.
REVISIT_BYTES = 100


def page_records(pages: DataFrame, min_bytes: int = REVISIT_BYTES) -> DataFrame:
    """A record per page; of equal payloads of min_bytes or more the smallest page_id has the response.

    The digests of repeated payloads are counted first (pre-aggregated where they are read), by parts that the pages are dealt into,
    and only those are joined back, to each part that has them: a payload which a third of the pages share is never gathered. Null
    html is an empty payload. Rows that repeat a page_id too are all responses, and so are rows with a null page_id; a payload has less than 2 GiB, as
    any Spark value. Other columns are ignored; an empty table gives an empty one.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    part = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    p = pages.select("page_id", F.col("url").alias("target_uri"), body.alias("payload"), part.alias("_p")).withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= min_bytes
    first = p.where(large).groupBy(F.col("digest").alias("_d"), "_p").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
    first = first.groupBy("_d").agg(F.min("_first").alias("_first"), F.sum("_n").alias("_n"), F.collect_set("_p").alias("_ps")).where("_n > 1")
    first = first.select("_d", "_first", F.explode("_ps").alias("_q"))
    again = F.col("_first").isNotNull() & (F.col("page_id") != F.col("_first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    return p.join(first, (F.col("digest") == F.col("_d")) & (F.col("_p") == F.col("_q")), "left").select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        urn("page_id").alias("record_id"),
        "target_uri",
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.when(again, urn("_first")).alias("refers_to"),
        F.octet_length("payload").cast("long").alias("http_length"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def archive_pages(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the pages' archives and returns what reading them gives."""
    spark = pages.sparkSession
    register(spark)
    page_records(pages).write.format("warc").mode("append").save(folder)
    return spark.read.format("warc").load(folder)


def query(spark, sf_dir: str) -> DataFrame:
    """Responses' lengths and digests come from the payloads read back, those of revisits from their headers."""
    records = archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), shared_folder(spark, "warc"))
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")
    response = F.col("record_type") == "response"
    return records.where(F.col("record_type").isin("response", "revisit")).select(
        number("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.regexp_replace("payload_digest", "^sha256:", "")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


def payload_digest(payload: bytes) -> str:
    return "sha256:" + hashlib.sha256(payload).hexdigest()


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) payload_bytes, sha256(h) payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> first THEN 'revisit' ELSE 'response' END record_type,
  CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> first THEN first END refers_to
FROM f"""
