"""WARC archives as a Spark data source, and pages written to and read back from them.

``spark.read.format("warc")`` plans one partition for each file, parses a record's headers first, and
steps over the payloads of records that the pushed predicates refuse. Files ending in ``.gz`` hold a
gzip member for each record; the writer notes a member's length in its ``sl`` extra field, as the format's
annex on gzip recommends, so an unwanted record is skipped without inflating it. Members without it are
inflated to find their end.

Damaged archives are read as far as they go. A record whose length is missing, no number or not that of its block
comes out with ``error`` ``length``, one whose gzip member cannot be inflated with ``gzip``, the last
of a file that ends inside it with ``cut``. Its headers are given as far as they are legible; its payload is null
unless a gzip member bounds it. Reading goes on at the next place where a record begins, so its
neighbours come out as ever. Pushed predicates see the headers of damaged records as those of others.

Paths go through Arrow's file systems (local or shared folders, S3, HDFS where its client library is
found). A task's files count only once the job has committed them to the manifest, so lost or
repeated tasks leave nothing that a reader sees.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from tidemark.plans.durable import scratch_path
from tidemark.plans.sizing import left_join

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, refers_to string, "
    "payload_digest string, content_length bigint, payload_bytes bigint, file string, "
    "offset bigint, headers map<string,string>, computed_digest string, payload binary, error string"
)
NAMED = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
}
MANIFEST = "_manifest.json"
FILE_BYTES = 256 << 20
WINDOW_BYTES = 1 << 20
HEAD_BYTES = 4096
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20
BREAK = b"\r\n\r\n"
MARK = b"WARC/"
MAGIC = b"\x1f\x8b\x08"
# Heads of records longer than this are taken for damage.
LONGEST_HEAD = 16 << 20


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


class Window:
    """A file read in stretches; whatever is stepped over between them is never read."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size = file, file.size()
        self.start, self.data = 0, b""

    def get(self, at: int, count: int) -> bytes:
        count = min(count, self.size - at)
        if at < self.start or at + count > self.start + len(self.data):
            self.file.seek(at)
            self.start, self.data = at, self.file.read(max(count, WINDOW_BYTES))
        return self.data[at - self.start : at - self.start + count]


def _headers(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def _number(text: str | None) -> int | None:
    """A length as a header states it; None where it is missing or no count."""
    return int(text) if text is not None and re.fullmatch("[0-9]{1,18}", text) else None


def _found(window: Window, mark: bytes, at: int) -> int:
    """The next place at or after ``at`` where the mark stands, or the end of the file."""
    while at < window.size:
        raw = window.get(at, WINDOW_BYTES)
        place = raw.find(mark)
        if place >= 0:
            return at + place
        if at + len(raw) >= window.size:
            break
        at += len(raw) - len(mark) + 1
    return window.size


Record = tuple[int, dict[str, str], Callable[[], bytes], str | None]


def _member(window: Window, at: int) -> tuple[bytes, int | None]:
    """Of a gzip member: its inflated start, and its length if the header tells."""
    raw = window.get(at, HEAD_BYTES)
    length = None
    if len(raw) > 24 and raw[3] & 4 and raw[12:14] == b"sl":
        length = struct.unpack("<I", raw[16:20])[0]
        after = window.get(at + length, len(MAGIC)) if length > 24 and at + length <= window.size else b"?"
        if after not in (b"", MAGIC):
            length = None
    return zlib.decompressobj(31).decompress(raw[:length], HEAD_BYTES), length


def _inflated(window: Window, at: int) -> tuple[bytes, int | None]:
    """All of a member whose length is not known, and that length; None if the file ends inside it."""
    inflater, parts, here = zlib.decompressobj(31), [], at
    while not inflater.eof and here < window.size:
        raw = window.get(here, WINDOW_BYTES)
        parts.append(inflater.decompress(raw))
        here += len(raw)
    return b"".join(parts), here - at - len(inflater.unused_data) if inflater.eof else None


def _packed_record(window: Window, at: int) -> tuple[Record, int | None]:
    """The record of the gzip member at a place, and where the next begins, if that can be told."""
    nothing = lambda: b""
    start = b""
    try:
        start, length = _member(window, at)
        whole = lambda: zlib.decompress(window.get(at, length), 31)
        if length is None or BREAK not in start:
            full, length = _inflated(window, at)
            start, whole = full, lambda: full
    except zlib.error:
        return (at, _headers(start.partition(BREAK)[0]), nothing, "gzip"), None
    head, cut_at, _ = start.partition(BREAK)
    found = _headers(head)
    if length is None:
        return (at, found, nothing, "cut"), None
    if not cut_at or not start.startswith(MARK):
        return (at, found, nothing, "length"), at + length
    body, size = len(head) + len(BREAK), _number(found.get("content-length"))
    if size is None:
        return (at, found, lambda: whole()[body:].removesuffix(BREAK), "length"), at + length
    return (at, found, lambda: whole()[body : body + size], None), at + length


def _plain_record(window: Window, at: int) -> tuple[Record, int | None]:
    """The same in a file that is not compressed."""
    nothing = lambda: b""
    count = HEAD_BYTES
    raw = window.get(at, count)
    while BREAK not in raw and at + len(raw) < window.size and count < LONGEST_HEAD:
        count *= 4
        raw = window.get(at, count)
    head, cut_at, _ = raw.partition(BREAK)
    found = _headers(head) if raw.startswith(MARK) else {}
    if not cut_at:
        return (at, found, nothing, "cut" if at + len(raw) >= window.size else "length"), None
    if not raw.startswith(MARK):
        return (at, found, nothing, "length"), None
    body, size = at + len(head) + len(BREAK), _number(found.get("content-length"))
    if size is None:
        return (at, found, nothing, "length"), None
    end = body + size
    if end > window.size:
        # Cut off, or a wrong length with other records after it.
        cut = _found(window, BREAK + MARK, body) >= window.size
        return (at, found, nothing, "cut" if cut else "length"), None
    if end + len(BREAK) < window.size and window.get(end, len(BREAK)) != BREAK:
        return (at, found, nothing, "length"), None
    return (at, found, lambda: window.get(body, size), None), end + len(BREAK)


def records(window: Window, packed: bool, wanted: Callable[[dict[str, str]], bool]) -> Iterator[Record]:
    """(offset, headers, a way to the block, error) of each record whose headers are wanted."""
    at = 0
    while at < window.size:
        record, after = (_packed_record if packed else _plain_record)(window, at)
        if wanted(record[1]):
            yield record
        if after is None:
            # Always further on, wherever a record seems to begin.
            if packed:
                after = _found(window, MAGIC, at + 1)
                while after < window.size and not _begins(window, after):
                    after = _found(window, MAGIC, after + 1)
            else:
                after = min(_found(window, BREAK + MARK, at + 1) + len(BREAK), window.size)
        at = after


def _begins(window: Window, at: int) -> bool:
    """Whether a gzip member with a record begins at a place."""
    try:
        return zlib.decompressobj(31).decompress(window.get(at, HEAD_BYTES), len(MARK)) == MARK
    except zlib.error:
        return False


def _split_block(found: dict[str, str], block: bytes) -> tuple[bytes, int | None]:
    """Payload of a block, and the length that its HTTP head states."""
    if not found.get("content-type", "").startswith("application/http"):
        return block, None
    head, _, payload = block.partition(BREAK)
    return payload, _number(_headers(head).get("content-length"))


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names = schema.fieldNames()
        self.path = options["path"]
        self.payload = options.get("payload", "none")
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of the header columns with constants; Spark keeps the rest."""
        kinds = {EqualTo: "equal", EqualNullSafe: "equal", In: "in", StringStartsWith: "starts", IsNotNull: "known"}
        for test in filters:
            column = getattr(test, "attribute", ("",))
            kind = kinds.get(type(test))
            if kind is None or len(column) != 1 or column[0] not in NAMED:
                yield test
                continue
            self.tests.append((NAMED[column[0]], kind, getattr(test, "value", None)))

    def wanted(self, found: dict[str, str]) -> bool:
        for name, kind, value in self.tests:
            here = found.get(name)
            if name in _BARE:
                here = _bare(name, here)
            if kind == "equal" and here != value:
                return False
            if kind == "in" and (here is None or here not in value):
                return False
            if kind == "starts" and (here is None or not here.startswith(value)):
                return False
            if kind == "known" and here is None:
                return False
        return True

    def partitions(self) -> Sequence[InputPartition]:
        system, root = fs.FileSystem.from_uri(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.File:
            return [InputPartition(root)]
        manifest = f"{root}/{MANIFEST}"
        if system.get_file_info(manifest).type == fs.FileType.File:
            with system.open_input_stream(manifest) as file:
                names = json.loads(file.read())
        else:
            found = system.get_file_info(fs.FileSelector(root))
            names = [x.base_name for x in found if re.search(r"\.warc(\.gz)?$", x.base_name)]
        return [InputPartition(f"{root}/{name}") for name in sorted(names)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        rows: list[dict] = []
        held = 0
        with system.open_input_file(partition.value) as file:
            window = Window(file)
            for at, found, block, error in records(window, partition.value.endswith(".gz"), self.wanted):
                row = {
                    "content_length": _number(found.get("content-length")),
                    "error": error,
                    "file": partition.value,
                    "offset": at,
                    "headers": list(found.items()),
                    **{name: _bare(key, found.get(key)) for name, key in NAMED.items()},
                }
                content = None if self.payload == "none" else self._content(row, block)
                if content is not None:
                    payload, stated = _split_block(found, content)
                    whole = found.get("warc-type") != "revisit"
                    row["payload_bytes"] = len(payload) if whole else stated
                    if whole and self.payload == "digest":
                        row["computed_digest"] = base32_sha1(payload)
                    if whole and self.payload == "bytes":
                        row["payload"] = payload
                        held += len(payload)
                rows.append(row)
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _content(row: dict, block: Callable[[], bytes]) -> bytes | None:
        """The block; None, and an error noted, where there is none to be had."""
        try:
            content = block()
        except zlib.error:
            content, row["error"] = b"", "gzip"
        return None if row["error"] and not content else content

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {
            "content_length": pa.int64(),
            "payload_bytes": pa.int64(),
            "offset": pa.int64(),
            "headers": pa.map_(pa.string(), pa.string()),
            "payload": pa.binary(),
        }
        columns = [
            pa.array([row.get(name) for row in rows], kinds.get(name, pa.string()))
            for name in self.names
        ]
        return pa.RecordBatch.from_arrays(columns, self.names)


_BARE = {"warc-record-id", "warc-refers-to", "warc-payload-digest"}


def _bare(key: str, value: str | None) -> str | None:
    """Ids without angle brackets, digests without the name of their method."""
    if value is None or key not in _BARE:
        return value
    return value.removeprefix("sha1:") if key == "warc-payload-digest" else value.strip("<>")


def _record(row: dict, compress: bool) -> bytes:
    """A row (record_type, record_id, target_uri, date, refers_to, digest, payload, payload_bytes)."""
    payload = row["payload"] if row["record_type"] != "revisit" else b""
    size = row["payload_bytes"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}"
    block = http.encode() + BREAK + payload
    fields = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": f"<{row['record_id']}>",
        "WARC-Date": row["date"],
        "WARC-Target-URI": row["target_uri"],
        "WARC-Payload-Digest": f"sha1:{row['digest']}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if row["record_type"] == "revisit":
        fields["WARC-Refers-To"] = f"<{row['refers_to']}>"
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    lines = [f"{k}: {re.sub(r'[\x00-\x1f\x7f]', ' ', v)}" for k, v in fields.items() if v is not None]
    raw = "\r\n".join(["WARC/1.1", *lines]).encode() + BREAK + block + BREAK
    if not compress:
        return raw
    deflater = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflater.compress(raw) + deflater.flush()
    length = 24 + len(body) + 8
    head = struct.pack("<4BI2BH2sHII", 0x1F, 0x8B, 8, 4, 0, 0, 255, 12, b"sl", 8, length, len(raw))
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path = options["path"]
        self.compress = options.get("compression", "gzip") == "gzip"
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))
        self.overwrite = overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        names: list[str] = []
        out, size = None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or size >= self.file_bytes:
                        if out is not None:
                            out.close()
                        names.append(f"{uuid.uuid4().hex}.warc{'.gz' if self.compress else ''}")
                        # Else Arrow would compress by the name once more.
                        out = system.open_output_stream(f"{root}/{names[-1]}", compression=None)
                        size = 0
                    raw = _record(row, self.compress)
                    out.write(raw)
                    size += len(raw)
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        manifest, names = f"{root}/{MANIFEST}", []
        if not self.overwrite and system.get_file_info(manifest).type == fs.FileType.File:
            with system.open_input_stream(manifest) as file:
                names = json.loads(file.read())
        names += [name for message in messages if message is not None for name in message.names]
        with system.open_output_stream(manifest) as file:
            file.write(json.dumps(names).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Files of an aborted job are not in the manifest, so nobody reads them."""


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcSource(DataSource):
    """Format ``warc``. Options: path; reading: payload ``none``, ``digest`` or ``bytes`` (which payloads
    are decoded, and whether they or only their digests are returned); writing: compression ``gzip`` or
    ``none``, file_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def write_pages(pages: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write a record for each row of (page_id, url, html): a response, or a revisit of the response with
    the same payload and the smallest page_id.

    A null html counts as empty. Rows that repeat a page_id with the same payload are all responses where
    that id is the smallest; a null page_id never is the smallest unless all of its payload's are null.
    """
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    digest = F.sha1(html)
    rows = pages.select(F.col("page_id").cast("bigint"), digest.alias("own")).distinct()
    # Only payloads that several pages have need to learn which is the first; the list of their digests is joined
    # to the pages, which stay where they are unless it is too long to be sent to them.
    first = (
        rows.groupBy("own")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("own", "first")
    )
    found = pages.select(
        F.col("page_id").cast("bigint"), F.col("url").cast("string"), html.alias("payload"), digest.alias("own")
    )
    known = left_join(found, first, ["own"], ["page_id"])
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))

    def page(name: str) -> F.Column:
        return F.concat(F.lit("urn:x-page:"), F.coalesce(F.col(name).cast("string"), F.lit("null")))

    (
        known.select(
            F.when(revisit, "revisit").otherwise("response").alias("record_type"),
            page("page_id").alias("record_id"),
            F.col("url").alias("target_uri"),
            F.lit("1970-01-01T00:00:00Z").alias("date"),
            F.when(revisit, page("first")).alias("refers_to"),
            F.col("own").alias("digest"),
            F.octet_length("payload").cast("bigint").alias("payload_bytes"),
            F.when(~revisit, F.col("payload")).alias("payload"),
        )
        .mapInArrow(_named_digests, "record_type string, record_id string, target_uri string, date string, "
                    "refers_to string, digest string, payload_bytes bigint, payload binary")
        .write.format("warc")
        .option("path", path)
        .option("compression", compression)
        .mode("append")
        .save()
    )


def _named_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-1 in hex to base32."""
    for batch in batches:
        digests = [base64.b32encode(bytes.fromhex(x)).decode() for x in batch.column(5).to_pylist()]
        columns = [*batch.columns[:5], pa.array(digests, pa.string()), *batch.columns[6:]]
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def read_records(spark: SparkSession, path: str, payload: str = "none") -> DataFrame:
    """The records of an archive. Load anew for each filter: Spark keeps the predicates it has pushed
    into a loaded Python source for later queries on the same DataFrame."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("path", path).option("payload", payload).load()


def archived(pages: DataFrame, path: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read back from an archive of
    ``pages``, one row for each row.

    Length and digest of a response are computed from the payload as read, those of a revisit are the ones
    in its headers. Extra columns are ignored; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_pages(pages, path)
    kept = [
        _page_number("record_id").alias("page_id"),
        "payload_bytes",
        F.coalesce("computed_digest", "payload_digest").alias("payload_digest"),
        "record_type",
        _page_number("refers_to").alias("refers_to"),
    ]
    # Payloads are decoded for responses only.
    parts = [
        read_records(spark, path, "digest").filter(F.col("record_type") == kind).select(*kept)
        for kind in ("response", "revisit")
    ]
    return parts[0].unionByName(parts[1])


def _page_number(column: str) -> F.Column:
    return F.expr(f"try_cast(substring({column}, {len('urn:x-page:') + 1}) as bigint)")


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex
  FROM pages),
f AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    ((16 * (strpos('0123456789abcdef', substr(hex, 5 * i // 4 + 1, 1)) - 1)
      + strpos('0123456789abcdef', substr(hex, 5 * i // 4 + 2, 1)) - 1)
     // CAST(2 ** (3 - 5 * i % 4) AS BIGINT)) % 32 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (hex)
"""
