"""WARC archives as a Spark data source: writing, and reading with predicates pushed down to the headers."""

from __future__ import annotations

import base64
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from fieldtrace.llm.common import shared_folder

SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary"
#: Header that holds each column predicates can be pushed down to.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_manifest-"
#: A gzip member's head with the extra field "sl", and its length.
MEMBER, HEAD = "<4sIBBHccHII", 24
#: Bytes that are read at a time, and bytes of a skippable member that are inflated at a time.
PIECE, STEP = 1 << 16, 1 << 12


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path.removeprefix("file:"))


def member(data: bytes, level: int) -> bytes:
    """One gzip member, whose extra field 'sl' tells its length, so that a reader can pass over it."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    head = struct.pack(MEMBER, b"\x1f\x8b\x08\x04", 0, 0, 255, 12, b"s", b"l", 8, HEAD + len(body) + 8, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(kind: str, record_id: str, uri: str | None, refers_to: str | None, digest: str | None, length: int, payload: bytes | None, date: str) -> bytes:
    """A WARC record with an HTTP response as its block; a revisit has the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload or b"") if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in uri))
    if digest is not None:
        head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {SAME_PAYLOAD}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files of its own; a manifest, written at the commit, names those of the tasks that count."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.date = options["path"].rstrip("/"), options.get("date", "1970-01-01T00:00:00Z")
        self.level, self.most = int(options.get("level", "4")), int(options.get("maxFileBytes", str(256 << 20)))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        files: list[str] = []
        out, size = None, 0
        for batch in iterator:
            for i in range(batch.num_rows):
                r = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
                if out is None or size > self.most:
                    if out is not None:
                        out.close()
                    files.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
                data = member(record(r["record_type"], r["record_id"], r["target_uri"], r["refers_to"], r["payload_digest"], r["payload_length"] or 0, r["payload"], self.date), self.level)
                size += out.write(data) or len(data)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}") as out:
            out.write("\n".join(f for m in messages if m is not None for f in m.files).encode())

    def abort(self, messages: list) -> None:
        fs, root = opened(self.path)
        for f in (f for m in messages if m is not None for f in m.files):
            fs.delete_file(f"{root}/{f}")


def parsed(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


class Record:
    """A record that is taken from its stream only as far as it is asked for: more() gives further bytes, none at the end."""

    def __init__(self, more: Callable[[], bytes], data: bytes = b"") -> None:
        self.more, self.data = more, bytearray(data)

    def begins(self) -> bool:
        """Whether the stream has a record left; empty lines before it are passed over."""
        while not (rest := self.data.lstrip(b"\r\n")):
            piece = self.more()
            if not piece:
                return False
            self.data = bytearray(piece)
        self.data = rest
        return True

    def upto(self, start: int, most: int | None = None) -> int:
        """Where the first empty line after start ends; -1 without one (among `most` bytes)."""
        while (end := self.data.find(b"\r\n\r\n", start)) < 0:
            if most is not None and len(self.data) - start >= most or not (piece := self.more()):
                return -1
            self.data += piece
        return end + 4

    def headers(self) -> dict[str, str]:
        self.start = self.upto(0)
        if self.start < 0:
            raise ValueError("a record ends in its headers")
        head = parsed(bytes(self.data[: self.start - 4]))
        self.length = int(head.get("content-length", "0"))
        return head

    def http(self) -> bytes:
        """The HTTP headers at the head of the block, with the empty line that ends them."""
        end = self.upto(self.start, self.length)
        return bytes(self.data[self.start : end]) if 0 <= end <= self.start + self.length else b""

    def block(self) -> bytes:
        while len(self.data) < self.start + self.length and (piece := self.more()):
            self.data += piece
        return bytes(self.data[self.start : self.start + self.length])

    def rest(self) -> bytes:
        """What has been read of the stream after the block; the block's own bytes are passed over piece by piece."""
        need = self.start + self.length
        while need > len(self.data) and (piece := self.more()):
            need -= len(self.data)
            self.data = bytearray(piece)
        return bytes(self.data[need:])


def run_of(more: Callable[[], bytes]) -> Iterator[Record]:
    """The records of one stream, each read to its end before the next; all headers of a record must be read."""
    rest = b""
    while (r := Record(more, rest)).begins():
        yield r
        rest = r.rest()


def own_length(head: bytes) -> int | None:
    """The length of a gzip member that tells it in its extra field."""
    magic, _, _, _, extra, a, b, n, length, _ = struct.unpack(MEMBER, head.ljust(HEAD, b"\0"))
    return length if (magic, extra, a + b, n) == (b"\x1f\x8b\x08\x04", 12, b"sl", 8) else None


class Stream:
    """A file of gzip members, read once from front to back."""

    def __init__(self, f: arrow_fs.NativeFile) -> None:
        self.f, self.left = f, b""

    def take(self, n: int) -> bytes:
        """At most n bytes; none at the end of the file."""
        got, self.left = (self.left[:n], self.left[n:]) if self.left else (self.f.read(n), b"")
        return got

    def head(self) -> bytes:
        while len(self.left) < HEAD and (piece := self.f.read(HEAD - len(self.left))):
            self.left += piece
        return self.left[:HEAD]

    def own(self, length: int) -> Iterator[Record]:
        """The one record of a member of this module's writer, whose length is known: only what is asked for is inflated."""
        left = length
        inflate = zlib.decompressobj(31)

        def more() -> bytes:
            nonlocal left
            while not inflate.eof:
                source = inflate.unconsumed_tail
                if not source:
                    source = self.take(min(left, PIECE))
                    left -= len(source)
                piece = inflate.decompress(source, STEP)
                if piece or not source:
                    return piece
            return b""

        first = Record(more)
        if first.begins():
            yield first
        while left > 0 and (piece := self.take(min(left, PIECE))):
            left -= len(piece)

    def others(self) -> Iterator[Record]:
        """The records of members that don't tell their length, up to the next that does: one stream, whether a member holds one record, several or a part of one."""
        inflate = zlib.decompressobj(31)

        def more() -> bytes:
            nonlocal inflate
            while True:
                if inflate.eof:
                    self.left = inflate.unused_data + self.left
                    head = self.head()
                    if not head.startswith(b"\x1f\x8b") or own_length(head) is not None:
                        return b""
                    inflate = zlib.decompressobj(31)
                source = inflate.unconsumed_tail or self.take(PIECE)
                piece = inflate.decompress(source, PIECE)
                if piece or not source:
                    return piece

        yield from run_of(more)


def records_of(fs: arrow_fs.FileSystem, path: str) -> Iterator[Record]:
    """The records of a file, in pieces: no record is held whole unless its block is asked for."""
    with fs.open_input_stream(path, compression=None, buffer_size=1 << 20) as f:
        if not path.endswith(".gz"):
            yield from run_of(lambda: f.read(PIECE))
            return
        stream = Stream(f)
        while head := stream.head():
            length = own_length(head)
            if length is not None:
                yield from stream.own(length)
            elif head.startswith(b"\x1f\x8b"):
                yield from stream.others()
            else:
                raise ValueError(f"no gzip member: {head[:4]!r}")


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    """A partition for each pack of files; predicates on headers are tested before a payload is inflated."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.payload = options["path"].rstrip("/"), options.get("payload", "true").lower() == "true"
        self.pack, self.wanted = int(options.get("packBytes", str(16 << 20))), {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = f.attribute[0]
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            else:
                yield f

    def partitions(self) -> list[Files]:
        fs, root = opened(self.path)
        found = fs.get_file_info(arrow_fs.FileSelector(root, recursive=False, allow_not_found=True)) if fs.get_file_info(root).type == arrow_fs.FileType.Directory else [fs.get_file_info(root)]
        sizes = {x.base_name: x.size for x in found if x.is_file}
        if named := [x for x in sizes if x.startswith(MANIFEST)]:
            kept = {line for x in named for line in fs.open_input_stream(f"{root}/{x}").read().decode().split("\n") if line}
            sizes = {k: v for k, v in sizes.items() if k in kept}
        sizes = {k: v for k, v in sizes.items() if k.endswith((".warc", ".warc.gz"))}
        packs: list[Files] = []
        room = 0
        for name in sorted(sizes, key=lambda k: (sizes[k], k)):
            if not packs or sizes[name] > room:
                packs.append(Files([]))
                room = self.pack
            packs[-1].paths.append(name)
            room -= sizes[name]
        return packs or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, root = opened(self.path)
        kinds = {"payload_length": pa.int64(), "payload": pa.binary()}
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])
        rows: list[dict] = []
        size = 0
        single = fs.get_file_info(root).is_file
        for path in partition.paths:
            for m in records_of(fs, root if single else f"{root}/{path}"):
                head = m.headers()
                row = {c: head.get(h.lower()) for c, h in HEADERS.items()}
                for c in ("record_id", "refers_to"):
                    row[c] = row[c] and row[c].strip("<>")
                if (digest := row["payload_digest"]) and digest.lower().startswith("sha1:") and len(digest) == 37:
                    row["payload_digest"] = base64.b32decode(digest[5:].upper()).hex()
                if any(row[c] not in values for c, values in self.wanted.items()):
                    continue
                http = m.http() if head.get("content-type", "").startswith("application/http") else b""
                told = [x[15:].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                revisit = row["record_type"] == "revisit"
                row["payload_length"] = int(told[0]) if told and revisit else m.length - len(http)
                if self.payload and not revisit:
                    body = row["payload"] = m.block()[len(http) :]
                    size += len(body)
                rows.append(row)
                if len(rows) >= 2000 or size > 16 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)


class WarcDataSource(DataSource):
    """format("warc"). Options: path, payload (false: payloads stay in the file), packBytes; writing: date, level, maxFileBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """The WARC records of pages (page_id, url, html): of equal payloads of `least` bytes or more, the one with the
    largest page_id is a response and the others are revisits of it; all others are responses.

    A null html is an empty payload. A null url gives no target. Rows that repeat the largest page_id are all responses;
    a null page_id is smaller than any. An empty table gives an empty table; other columns of pages are left out.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("payload_length", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    kept = rows.where(F.col("payload_length") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("copies"))
    rows = rows.join(kept.where("copies > 1 AND kept IS NOT NULL").select("payload_digest", "kept"), "payload_digest", "left")
    revisit = F.col("kept").isNotNull() & ~F.col("kept").eqNullSafe(F.col("page_id"))
    name = F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    return rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), name.alias("record_id"), "target_uri",
        F.when(revisit, F.concat(F.lit("urn:page:"), F.col("kept").cast("string"))).alias("refers_to"), "payload_digest", "payload_length",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write(rows: DataFrame, path: str) -> None:
    register(rows.sparkSession)
    rows.write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write(records(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")), path)
    back = read(spark, path)
    page = lambda c: F.nullif(F.substring(c, 10, 30), F.lit("")).cast("long")  # noqa: E731  after "urn:page:"
    response = F.col("record_type") == "response"
    return back.select(
        page("record_id").alias("page_id"), "payload_length", F.when(response, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", page("refers_to").alias("refers_to"),
    ).withColumnRenamed("payload_length", "payload_bytes")


OP9_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), k AS (
  SELECT payload_digest, max(page_id) AS kept FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN kept IS NOT NULL AND kept IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN kept IS DISTINCT FROM page_id THEN kept END AS refers_to
FROM p LEFT JOIN k USING (payload_digest)
"""
