"""WARC as a PySpark Python data source, for reading and writing.

Reading. Partitions are planned as one archive file each (the writer bounds its files); a large archive of others that is
compressed member by member is split by bytes, and a range begins with the first member that starts in it (a plain one is
one partition, as nothing marks where its records start). Filters on record_type and on the
other header columns are pushed into the reader: a record's headers are parsed first, and where a pushed predicate fails,
or no payload is asked for, the rest of the record is skipped without being decompressed. Compressed archives (one gzip
member per record) are skipped by the member length that the writer puts in an extra field of the gzip header; archives
of others, which lack it, are inflated to the member's end without keeping anything. Plain archives skip by seeking.

Writing. Each task writes files of bounded size under names of its own attempt and reports them; the commit lists the
reported files in a manifest, which readers obey, so retried or lost tasks leave no record behind.

Paths may be local, or anything that pyarrow's file systems open; the driver and the executors must share them.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from .common import BROADCAST_ROWS, join_on_id, materialize, new_path, small_batches, table

#: Bytes after which a task begins another file.
FILE_BYTES = 64 << 20
#: Bytes of a compressed archive that are one partition (option split_bytes).
SPLIT_BYTES = 128 << 20
MANIFEST = "_manifest.json"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
SCHEMA = "file string, record_type string, record_id string, target_uri string, warc_date string, refers_to string, payload_digest string, payload_length long, content_length long, headers map<string,string>, payload binary"
#: Header columns and the fields they are read from; filters on them can be pushed down.
FIELDS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "warc_date": "warc-date", "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest", "payload_length": "warc-x-payload-length", "content_length": "content-length",
}
_NUMBERS = ("payload_length", "content_length")


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    clean = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in headers if v is not None)
    return b"WARC/1.1\r\n" + clean.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def gzip_member(raw: bytes) -> bytes:
    """One gzip member whose extra field SL holds the member's whole length."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush()
    extra = b"SL" + struct.pack("<HQ", 8, 10 + 2 + 12 + len(body) + 8)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def parse_headers(raw: bytes) -> dict[str, str]:
    """Header fields with names in lower case; a line that begins with white space continues the one before."""
    out: dict[str, str] = {}
    last = None
    for line in raw.decode("utf-8", errors="replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            k, v = line.split(":", 1)
            last = k.strip().lower()
            out[last] = v.strip()
    return out


def header_columns(headers: dict[str, str]) -> dict[str, object]:
    row: dict[str, object] = {c: headers.get(f) for c, f in FIELDS.items()}
    for c in _NUMBERS:
        row[c] = int(row[c]) if str(row[c] or "").isdigit() else None
    return row


class Records:
    """Steps through an archive: headers first, then payload() or skip()."""

    def __init__(self, stream, start: int = 0):
        self.stream = stream
        stream.seek(0)
        self.gzip = stream.read(2) == b"\x1f\x8b"
        self.at = start
        if start:
            self._to_member()

    def _to_member(self) -> None:
        """To the first member at or after this place: gzip's mark, with data that inflate to the start of a record."""
        while True:
            self.stream.seek(self.at)
            data = self.stream.read(1 << 20)
            found = data.find(b"\x1f\x8b\x08")
            while found >= 0:
                self.stream.seek(self.at + found)
                try:
                    if zlib.decompressobj(31).decompress(self.stream.read(1 << 12), 8).startswith(b"WARC/"):
                        self.at += found
                        return
                except zlib.error:
                    pass
                found = data.find(b"\x1f\x8b\x08", found + 1)
            if len(data) < 1 << 20:  # none: what follows the end is nothing
                self.at += len(data)
                return
            self.at += len(data) - 2

    def __iter__(self) -> Iterator[dict[str, str]]:
        step = self._next_member if self.gzip else self._next_plain
        while (headers := step()) is not None:
            yield headers

    def _next_member(self):
        self.stream.seek(self.at)
        self.head = self.stream.read(1 << 14)
        if len(self.head) < 18 or self.head[:2] != b"\x1f\x8b":
            return None
        self.length = None
        if self.head[3] & 4:
            (size,) = struct.unpack_from("<H", self.head, 10)
            extra = self.head[12 : 12 + size]
            if extra[:2] == b"SL" and len(extra) >= 12:
                (self.length,) = struct.unpack_from("<Q", extra, 4)
        self.z = zlib.decompressobj(31)
        self.fed = self.head
        self.raw = bytearray()
        while b"\r\n\r\n" not in self.raw and not self.z.eof:
            part = self.z.decompress(self.fed, 1 << 12)
            self.raw += part
            self.fed = self.z.unconsumed_tail
            if not part and not self.fed and not self.z.eof:
                self.fed = self.stream.read(1 << 16)
                if not self.fed:
                    return None
        end = self.raw.find(b"\r\n\r\n")
        self.body_at = end + 4
        self.open = True
        return parse_headers(bytes(self.raw[: max(end, 0)]))

    def _inflate(self, keep: bool) -> None:
        while not self.z.eof:
            part = self.z.decompress(self.fed or self.z.unconsumed_tail or self.stream.read(1 << 16), 1 << 20)
            self.fed = self.z.unconsumed_tail
            if keep:
                self.raw += part
            if not part and not self.fed and not self.z.eof:
                more = self.stream.read(1 << 16)
                if not more:
                    break
                self.fed = more

    def _next_plain(self):
        self.stream.seek(self.at)
        raw = bytearray()
        while (end := raw.find(b"\r\n\r\n")) < 0:
            part = self.stream.read(1 << 12)
            if not part:
                return None
            raw += part
        lead = len(raw) - len(raw.lstrip(b"\r\n"))
        if lead:
            self.at += lead
            return self._next_plain()
        headers = parse_headers(bytes(raw[:end]))
        self.body_at = self.at + end + 4
        self.open = True
        return headers

    def block(self, headers: dict[str, str]) -> bytes:
        size = int(headers.get("content-length", 0))
        if self.gzip:
            self._inflate(True)
            return bytes(self.raw[self.body_at : self.body_at + size])
        self.stream.seek(self.body_at)
        return self.stream.read(size)

    def advance(self, headers: dict[str, str]) -> None:
        """To the next record; what was not read stays compressed."""
        if not self.gzip:
            self.at = self.body_at + int(headers.get("content-length", 0))
            return
        if self.length is None:
            self._inflate(False)
            self.length = self.stream.tell() - self.at - len(self.z.unused_data)
        self.at += self.length


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """What follows the HTTP header of a response or revisit; any other block as it is."""
    if headers.get("content-type", "").replace(" ", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


@dataclass
class ArchivePartition(InputPartition):
    files: list[str]
    start: int = 0
    end: int | None = None

    def __init__(self, files, start=0, end=None):
        self.files, self.start, self.end = files, start, end


def _holds(f: Filter, row: dict[str, object]) -> bool:
    if isinstance(f, Not):  # a comparison with null is neither true nor false
        known = isinstance(f.child, (IsNull, IsNotNull, EqualNullSafe)) or row[f.child.attribute[0]] is not None
        return known and not _holds(f.child, row)
    value = row[f.attribute[0]]
    if isinstance(f, IsNull):
        return value is None
    if isinstance(f, IsNotNull):
        return value is not None
    if isinstance(f, EqualNullSafe):
        return value == f.value
    if value is None:
        return False
    if isinstance(f, EqualTo):
        return value == f.value
    if isinstance(f, In):
        return value in f.value
    if isinstance(f, StringStartsWith):
        return str(value).startswith(f.value)
    if isinstance(f, StringEndsWith):
        return str(value).endswith(f.value)
    return f.value in str(value)


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.with_payload = str(options.get("payload", "true")).lower() == "true"
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.filters: list[Filter] = []

    def pushFilters(self, filters):  # noqa: N802  the API's name
        for f in filters:
            inner = f.child if isinstance(f, Not) else f
            if isinstance(inner, (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, StringStartsWith, StringEndsWith, StringContains)) and len(inner.attribute) == 1 and inner.attribute[0] in FIELDS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        system, root = _filesystem(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.File:
            return self._ranges(root, info.size)
        files = {x.base_name: x for x in system.get_file_info(fs.FileSelector(root))}
        if MANIFEST in files:
            with system.open_input_stream(files[MANIFEST].path) as s:
                names = json.loads(s.readall())["files"]
        else:
            names = [n for n in files if n.endswith((".warc", ".warc.gz"))]
        return [p for n in sorted(names) for p in self._ranges(files[n].path, files[n].size)] or [ArchivePartition([])]

    def _ranges(self, path: str, size: int) -> list[ArchivePartition]:
        if not path.endswith(".gz") or size <= 2 * self.split:
            return [ArchivePartition([path])]
        return [ArchivePartition([path], at, at + self.split) for at in range(0, size, self.split)]

    def read(self, partition):
        system, _ = _filesystem(self.path)
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = [pa.string()] * 7 + [pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
        schema = pa.schema(list(zip(names, kinds)))
        for path in partition.files:
            rows, held = [], 0
            with system.open_input_file(path) as stream:
                records = Records(stream, partition.start)
                for headers in records:
                    if partition.end is not None and records.at >= partition.end:
                        break
                    row = header_columns(headers)
                    if all(_holds(f, row) for f in self.filters):
                        payload = payload_of(headers, records.block(headers)) if self.with_payload else None
                        rows.append([path, *(row[c] for c in names[1:9]), list(headers.items()), payload])
                        held += len(payload or b"") + 1000
                    records.advance(headers)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema=schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite):
        self.path, self.gzip, self.overwrite = options["path"], str(options.get("compression", "gzip")).lower() == "gzip", overwrite
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))

    def write(self, iterator):
        system, root = _filesystem(self.path)
        system.create_dir(root, recursive=True)
        names, stream, size = [], None, 0
        for b in iterator:
            cols = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
            for i in range(b.num_rows):
                row = {n: c[i] for n, c in cols.items()}
                raw = self._record(row)
                if stream is None or size + len(raw) > self.file_bytes:
                    if stream is not None:
                        stream.close()
                    names.append(f"{uuid.uuid4().hex}.warc" + ".gz" * self.gzip)
                    stream, size = system.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                stream.write(raw)
                size += len(raw)
        if stream is not None:
            stream.close()
        return Written(names)

    def _record(self, row: dict) -> bytes:
        kind = row.get("record_type") or "resource"
        payload = row.get("payload") or b""
        http = kind in ("response", "revisit")
        block = HTTP + (payload if kind == "response" else b"") if http else payload
        headers = [
            ("WARC-Type", kind), ("WARC-Record-ID", row.get("record_id") or f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", row.get("warc_date") or "1970-01-01T00:00:00Z"),
            ("WARC-Target-URI", row.get("target_uri")), ("WARC-Refers-To", row.get("refers_to")),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if kind == "revisit" else None),
            ("WARC-Payload-Digest", row.get("payload_digest") or (f"sha1:{sha1_base32(payload)}" if kind != "revisit" else None)),
            ("WARC-X-Payload-Length", str(len(payload) if kind != "revisit" else row.get("payload_length") or 0)),
            ("Content-Type", "application/http; msgtype=response" if http else "application/octet-stream"),
        ]
        raw = record_bytes(headers, block)
        return gzip_member(raw) if self.gzip else raw

    def commit(self, messages):
        system, root = _filesystem(self.path)
        system.create_dir(root, recursive=True)
        names = sorted(n for m in messages if m is not None for n in m.files)
        if not self.overwrite:
            from pyarrow import fs

            if system.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
                with system.open_input_stream(f"{root}/{MANIFEST}") as s:
                    names = sorted({*names, *json.loads(s.readall())["files"]})
        with system.open_output_stream(f"{root}/{MANIFEST}", compression=None) as s:
            s.write(json.dumps({"files": names}).encode())

    def abort(self, messages):
        system, root = _filesystem(self.path)
        for n in (n for m in messages if m is not None for n in m.files):
            system.delete_file(f"{root}/{n}")


class WarcDataSource(DataSource):
    """Format warc. Options: path; payload (read: false leaves payload null and skips it); compression (write: gzip or
    none); file_bytes (write)."""

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


def payload_digest(payload) -> F.Column:
    """Base32 SHA-1 by SQL functions: each 10 hex digits are 8 digits of base 32, respelled in the WARC alphabet."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def archive_records(pages: DataFrame, least_bytes: int = 0, salts: int = 32) -> DataFrame:
    """Record rows of pages (page_id, url, html): of equal payloads of at least least_bytes, that with the largest page_id
    is a response and the others revisit it; all else are responses.

    A null html is an empty payload. Rows without a page_id are left out, as no record could name them; rows that repeat
    one count as one page with its least (html, url). Other columns are ignored. Payloads themselves are never shuffled
    by digest: digests and ids are, salted, so that a payload which very many pages share is dealt over tasks.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")).filter("page_id is not null")
    if rows.groupBy("page_id").count().filter("count > 1").limit(1).count():
        rows = rows.groupBy("page_id").agg(F.min(F.struct("payload", "url")).alias("r")).select("page_id", "r.url", "r.payload")
    ids = materialize(rows.select("page_id", payload_digest(F.col("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("size")), "digests")
    shared = ids.filter(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("latest"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    salted = ids.filter(F.col("size") >= least_bytes).withColumn("salt", F.pmod("page_id", F.lit(salts)))
    every = shared.select("digest", "latest", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    revisits = materialize(salted.join(every, ["digest", "salt"]).filter("page_id <> latest").select("page_id", "latest"), "revisits")
    typed = join_on_id(rows, revisits, "page_id", "left", BROADCAST_ROWS)
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.col(c).cast("string"), F.lit(">"))
    first = F.col("latest").isNull()
    return typed.select(
        F.when(first, "response").otherwise("revisit").alias("record_type"),
        name("page_id").alias("record_id"),
        F.col("url").alias("target_uri"),
        F.when(~first, name("latest")).alias("refers_to"),
        F.concat(F.lit("sha1:"), payload_digest(F.col("payload"))).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_length"),
        F.when(first, F.col("payload")).alias("payload"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the archives into the shared folder and reads them back: responses with their payloads, whose digest and
    length are taken anew, and revisits by their headers alone."""
    register(spark)
    small_batches(spark)
    path = new_path(spark, "warc")
    archive_records(table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(path)
    page = lambda c: F.regexp_extract(c, "^<urn:x-page:(-?[0-9]+)>$", 1).cast("long")
    full = spark.read.format("warc").load(path).filter("record_type = 'response'")
    bare = spark.read.format("warc").option("payload", "false").load(path).filter("record_type = 'revisit'")
    return full.select(
        page("record_id").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        payload_digest(F.col("payload")).alias("payload_digest"),
        "record_type",
        F.lit(None).cast("long").alias("refers_to"),
    ).unionByName(
        bare.select(page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))
    )


_DIGIT = "to_base(('0x' || substr(d, {i}, 10))::bigint, 32, 8)"
OP4_SQL = f"""
with p as (select page_id, coalesce(html, '') as h from pages where page_id is not null),
g as (select *, sha1(h) as d, max(page_id) over (partition by h) as latest from p)
select page_id, strlen(h)::bigint as payload_bytes,
  translate(upper({" || ".join(_DIGIT.format(i=i) for i in (1, 11, 21, 31))}), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') as payload_digest,
  case when page_id = latest then 'response' else 'revisit' end as record_type,
  case when page_id <> latest then latest end as refers_to
from g
"""


def read_foreign(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """All records of an archive in memory, by the same steps as the reader (for tests)."""
    out = []
    with pa.BufferReader(data) as stream:
        records = Records(stream)
        for h in records:
            out.append((h, payload_of(h, records.block(h))))
            records.advance(h)
    return out
