"""WARC records in ZIP-packaged archives, written by tasks and read back by byte ranges.

An archive is a ZIP file whose members are stored without compression: ``archive/data.warc.gz`` with one gzip member
per record, and ``indexes/index.cdx`` with one JSON line per record: its offset and length in the first member. The
reader parses the end record, the ZIP64 end record and the central directory, locates the members, range-reads the
index, and then each record alone; nothing is extracted.

Of pages whose payloads are equal and at least ``min_bytes`` long, the one with the least ``page_id`` is written as a
response, the others as revisits that refer to it; pages that repeat that id are responses too, and a null id counts as
larger than any. Ids are of any type that its string casts back to. Null html is an empty payload, always a response. An empty table gives no archive and an empty result.
Further columns of any name are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import spread_join
from ..plans.materialize import materialize, shared_dir
from .common import map_texts

MIN_BYTES = 100
#: Bytes of records after which a task begins the next archive.
ARCHIVE_BYTES = 32 << 20
#: Records that one reading task takes from an archive at a time.
RECORDS_PER_RANGE = 2000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"


def with_types(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``page_id, url, html, digest, size, record_type, refers_to``.

    Digests are grouped with partial aggregation; only digests that occur more than once are joined back, and a
    frequent one is spread over many tasks.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    base = pages.select(
        "page_id", "url", "html", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("bigint").alias("size")
    )
    first = base.filter(F.col("size") >= min_bytes).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("_n")
    ).filter("_n > 1 and first is not null").drop("_n")
    marked = spread_join(base, first, ["digest"], F.xxhash64("page_id", "url"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return marked.select(
        "page_id", "url", "html", "digest", "size", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def record_bytes(page_id, url, html, digest, size, record_type, refers_to) -> bytes:
    payload = b"" if record_type == "revisit" else (html or "").encode()
    head = [
        "WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {json.dumps(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {json.dumps(str(page_id))}")
    if refers_to is not None:
        head.append(f"X-Refers-To-Page-ID: {json.dumps(str(refers_to))}")
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers by lower-case name, and ``payload``."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    out: dict = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    size = int(out["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("record length does not match its content")
    out["payload"] = rest[:size]
    return out


class ArchiveBuilder:
    """Collects the records of one archive in memory, up to a bounded size."""

    def __init__(self):
        self.data, self.index = io.BytesIO(), []

    def add(self, raw: bytes) -> None:
        packed = gzip.compress(raw, 1, mtime=0)
        self.index.append({"offset": self.data.tell(), "length": len(packed)})
        self.data.write(packed)

    def to_zip(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            z.writestr(DATA, self.data.getvalue())
            z.writestr(INDEX, "".join(json.dumps(x) + "\n" for x in self.index))
        return out.getvalue()


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``records`` as archives into ``folder`` and return the stored manifest ``path, records, bytes``.

    File names are new for each attempt of a task; only archives in the manifest count, so an attempt that was lost
    leaves an unused file and nothing else.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = fs.FileSystem.from_uri(folder)
        now = ArchiveBuilder()

        def close() -> pa.RecordBatch:
            blob, name = now.to_zip(), f"{uuid.uuid4().hex}.wacz"
            with target.open_output_stream(f"{base}/{name}") as f:
                f.write(blob)
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [len(now.index)], "bytes": [len(blob)]})

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                now.add(record_bytes(*row))
                if now.data.tell() >= archive_bytes:
                    yield close()
                    now = ArchiveBuilder()
        if now.index:
            yield close()

    target, base = fs.FileSystem.from_uri(folder)
    target.create_dir(base, recursive=True)
    cols = records.select("page_id", "url", "html", "digest", "size", "record_type", "refers_to")
    return materialize(map_texts(cols, run, "path string, records bigint, bytes bigint"))


class Member(NamedTuple):
    name: str
    method: int
    header: int  # offset of the local header
    stored: int  # bytes in the file
    size: int


_END, _END64, _LOCATOR64, _CENTRAL, _LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF


class RangeReader:
    """Byte ranges of a file of any file system that Arrow opens."""

    def __init__(self, path: str):
        target, inner = fs.FileSystem.from_uri(path)
        self.file = target.open_input_file(inner)
        self.size = self.file.size()

    def __call__(self, offset: int, length: int) -> bytes:
        if offset < 0 or length < 0 or offset + length > self.size:
            raise ValueError("range outside the file")
        return self.file.read_at(length, offset)


def members(read, size: int) -> list[Member]:
    """Central directory of a ZIP file, found from its end; sizes and offsets may be ZIP64."""
    tail_at = max(0, size - 22 - _FULL16)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(_END)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(_END, 0, at)
    if at < 0:
        raise ValueError("no end record: not a ZIP file")
    _, _, _, count, length, offset, _ = struct.unpack_from("<HHHHIIH", tail, at + 4)
    if count == _FULL16 or _FULL32 in (length, offset):
        locator = read(tail_at + at - 20, 20) if tail_at + at >= 20 else b""
        if locator[:4] == _LOCATOR64:
            end64 = read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if end64[:4] != _END64:
                raise ValueError("broken ZIP64 end record")
            count, length, offset = struct.unpack_from("<QQQ", end64, 32)
    directory, out, at = read(offset, length), [], 0
    for _ in range(count):
        if directory[at:at + 4] != _CENTRAL:
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        stored, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
        header, = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46:at + 46 + n_name]
        extra, end = at + 46 + n_name, at + 46 + n_name + n_extra
        while extra + 4 <= end:
            kind, n = struct.unpack_from("<HH", directory, extra)
            if kind == 1:  # holds, in this order, only the values that do not fit above
                wide = iter(struct.unpack_from(f"<{n // 8}Q", directory, extra + 4))
                full = next(wide) if full == _FULL32 else full
                stored = next(wide) if stored == _FULL32 else stored
                header = next(wide) if header == _FULL32 else header
            extra += 4 + n
        out.append(Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method, header, stored, full))
        at = end + n_comment
    return out


def data_offset(read, member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if member.method:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by range")
    local = read(member.header, 30)
    if local[:4] != _LOCAL:
        raise ValueError("broken local header")
    n_name, n_extra = struct.unpack_from("<HH", local, 26)
    return member.header + 30 + n_name + n_extra


def record_ranges(archives: DataFrame, records_per_range: int = RECORDS_PER_RANGE) -> DataFrame:
    """``path, part, offset, length`` in the file of every record of the archives in ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                read = RangeReader(path)
                found = {m.name: m for m in members(read, read.size)}
                base, index = data_offset(read, found[DATA]), found[INDEX]
                lines = read(data_offset(read, index), index.stored).decode().splitlines()
                rows = [json.loads(x) for x in lines]
                yield pa.RecordBatch.from_pydict({
                    "path": [path] * len(rows), "part": [i // records_per_range for i in range(len(rows))],
                    "offset": [base + r["offset"] for r in rows], "length": [r["length"] for r in rows],
                })

    return map_texts(archives.select("path"), run, "path string, part bigint, offset bigint, length bigint")


def reading_tasks(ranges: DataFrame) -> int:
    """One task per archive's worth of bytes, and enough for all cores while there are ranges."""
    sums = ranges.agg(F.sum("length").alias("size"), F.count_if(F.col("offset").isNotNull()).alias("n")).first()
    cores = ranges.sparkSession.sparkContext.defaultParallelism
    return max(1, min(sums["n"], max(cores, -(-(sums["size"] or 0) // ARCHIVE_BYTES))))


def read_records(archives: DataFrame, records_per_range: int = RECORDS_PER_RANGE, id_type: str = "bigint") -> DataFrame:
    """One row per record: ``page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload``.

    The payload of every response is checked against its digest. ``id_type`` is the type of the page ids.
    """
    ranges = materialize(record_ranges(archives, records_per_range))
    dealt = ranges.repartition(reading_tasks(ranges), "path", "part").sortWithinPartitions("path", "offset")
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, read = None, None
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                rows = []
                for r in batch.slice(lo, 500).to_pylist():
                    if r["path"] != path:
                        path, read = r["path"], RangeReader(r["path"])
                    rows.append(_row(parse_record(gzip.decompress(read(r["offset"], r["length"])))))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    schema = "page_id string, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to string, payload binary"
    found = map_texts(dealt, run, schema)
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def _row(r: dict) -> tuple:
    digest = r["warc-payload-digest"].removeprefix("sha256:")
    if r["warc-type"] == "response" and hashlib.sha256(r["payload"]).hexdigest() != digest:
        raise ValueError("payload does not match its digest")
    value = lambda name: json.loads(r[name]) if name in r else None
    return (value("x-page-id"), value("warc-target-uri"), r["warc-type"], value("x-payload-length"), digest,
            value("x-refers-to-page-id"), r["payload"])


def round_trip(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write all pages as archives (in a new folder of the shared one, unless given) and read them back."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/archives-{uuid.uuid4().hex}"
    folder = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    archives = write_archives(with_types(pages, min_bytes), folder)
    return read_records(archives, id_type=pages.schema["page_id"].dataType.simpleString())
