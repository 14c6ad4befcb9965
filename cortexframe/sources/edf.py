"""EDF/BDF recordings as tables.

The files are listed by Spark as a table of paths and lengths, cut into byte ranges and dealt to tasks; no list of paths is
on the driver. A task reads the header and then seeks to the blocks that start in its range, so one long recording is read
by many tasks, and to the bytes of the wanted channels inside a record where that skips enough.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from datetime import datetime
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "blocks": "recording_id string, channel string, fs double, block_idx bigint, start_sample bigint, samples array<double>",
    "channels": "recording_id string, channel string, channel_order bigint, fs double, n_samples bigint, units string, meas_date timestamp",
    "annotations": "recording_id string, onset double, duration double, description string",
}
_TEXT, _REAL, _WHOLE = pa.string(), pa.float64(), pa.int64()
ARROW = {
    "blocks": pa.schema([("recording_id", _TEXT), ("channel", _TEXT), ("fs", _REAL), ("block_idx", _WHOLE),
                         ("start_sample", _WHOLE), ("samples", pa.list_(_REAL))]),
    "channels": pa.schema([("recording_id", _TEXT), ("channel", _TEXT), ("channel_order", _WHOLE), ("fs", _REAL),
                           ("n_samples", _WHOLE), ("units", _TEXT), ("meas_date", pa.timestamp("us", tz="UTC"))]),
    "annotations": pa.schema([("recording_id", _TEXT), ("onset", _REAL), ("duration", _REAL), ("description", _TEXT)]),
}
# Factor from the physical dimension to volts.
TO_VOLTS = {"uv": 1e-6, "µv": 1e-6, "mv": 1e-3, "nv": 1e-9, "v": 1.0}


@dataclass
class Header:
    data_at: int
    records: int
    seconds: float
    width: int
    labels: list[str]
    units: list[str]
    gain: np.ndarray
    offset: np.ndarray
    counts: list[int]
    start: datetime | None

    @property
    def record_bytes(self) -> int:
        return sum(self.counts) * self.width

    def is_text(self, i: int) -> bool:
        return self.labels[i] in ("EDF Annotations", "BDF Annotations")


def parse_header(f, size: int) -> Header:
    fixed = f.read(256)
    width = 3 if fixed[0] == 0xFF else 2
    text = fixed[1:].decode("latin-1") if width == 3 else fixed.decode("latin-1")[1:]
    text = " " + text
    at, records, seconds, ns = int(text[184:192]), int(text[236:244]), float(text[244:252]), int(text[252:256])
    rest = f.read(ns * 256).decode("latin-1")

    def column(start, length):
        base = start * ns
        return [rest[base + i * length:base + (i + 1) * length].strip() for i in range(ns)]

    labels, units = column(0, 16), column(96, 8)
    pmin, pmax, dmin, dmax = (np.array([float(v) for v in column(s, 8)]) for s in (104, 112, 120, 128))
    counts = [int(v) for v in column(216, 8)]
    span = np.where(dmax > dmin, dmax - dmin, 1.0)
    gain = (pmax - pmin) / span
    try:
        start = datetime.strptime(text[168:184], "%d.%m.%y%H.%M.%S")
    except ValueError:
        start = None
    head = Header(at, records, seconds, width, labels, units, gain, pmin - gain * dmin, counts, start)
    if head.records < 0 and head.record_bytes:
        head.records = (size - at) // head.record_bytes
    return head


def decode(raw: np.ndarray, width: int) -> np.ndarray:
    """Little-endian 16- or 24-bit integers from bytes."""
    if width == 2:
        return raw.view("<i2").astype(np.float64)
    b = raw.reshape(-1, 3).astype(np.int32)
    v = b[:, 0] | (b[:, 1] << 8) | (b[:, 2] << 16)
    return np.where(v >= 1 << 23, v - (1 << 24), v).astype(np.float64)


def parse_annotations(raw: bytes) -> list[tuple[float, float, str]]:
    """Annotations of one record; the record's own time mark has no text and is skipped."""
    out = []
    for item in raw.split(b"\x00"):
        m = re.match(rb"([+-][0-9.]+)(?:\x15([0-9.]+))?\x14(.*)\x14$", item, re.S)
        if not m:
            continue
        for text in m.group(3).split(b"\x14"):
            if text:
                out.append((float(m.group(1)), float(m.group(2) or 0), text.decode("utf-8", "replace")))
    return out


MIN_SKIP = 64 << 10  # bytes; a shorter gap between wanted bytes is read over


def read_records(f, head: Header, at: int, n: int, wanted: list[int], min_skip: int = MIN_SKIP) -> dict[int, np.ndarray]:
    """Bytes of the ``wanted`` channels in up to ``n`` records from byte ``at`` on, one row per record.

    A record is read in the stretches that hold wanted channels; if no gap reaches ``min_skip``, all records are one read.
    """
    edges = np.concatenate([[0], np.cumsum(head.counts)]) * head.width
    spans: list[list[int]] = []
    for i in wanted:
        lo, hi = int(edges[i]), int(edges[i + 1])
        if spans and lo - spans[-1][1] < min_skip:
            spans[-1][1] = hi
        else:
            spans.append([lo, hi])
    if not spans:
        return {}
    size = head.record_bytes
    if len(spans) == 1 and size - (spans[0][1] - spans[0][0]) < min_skip:
        spans = [[0, size]]
    if spans == [[0, size]]:
        f.seek(at)
        raw = np.frombuffer(f.read(n * size), dtype=np.uint8)
        rows = {0: raw[: len(raw) // size * size].reshape(-1, size)}
    else:
        pieces: dict[int, list[np.ndarray]] = {lo: [] for lo, _ in spans}
        for r in range(n):
            got = {}
            for lo, hi in spans:
                f.seek(at + r * size + lo)
                got[lo] = np.frombuffer(f.read(hi - lo), dtype=np.uint8)
            if any(len(got[lo]) < hi - lo for lo, hi in spans):
                break  # the file ends inside this record
            for lo, _ in spans:
                pieces[lo].append(got[lo])
        rows = {lo: np.stack(p) if p else np.zeros((0, hi - lo), np.uint8) for (lo, hi), p in zip(spans, pieces.values())}
    out = {}
    for i in wanted:
        lo = max(s for s in rows if s <= edges[i])
        out[i] = np.ascontiguousarray(rows[lo][:, edges[i] - lo:edges[i + 1] - lo])
    return out


def _open(path: str):
    from pyarrow import fs as arrow_fs

    if "://" in path or path.startswith("file:"):
        system, inner = arrow_fs.FileSystem.from_uri(path)
    else:
        system, inner = arrow_fs.LocalFileSystem(), path
    return system.open_input_file(inner)


def _channel_rows(f, name: str, size: int):
    h = parse_header(f, size)
    for i, label in enumerate(h.labels):
        if not h.is_text(i):
            yield (name, label, i, h.counts[i] / h.seconds, h.counts[i] * h.records, h.units[i], h.start)


def _blocks_in(f, size: int, lo: int, hi: int, seconds: float, choose, min_skip: int):
    """``header, block, its first record's number, bytes per channel`` of the blocks that start in ``[lo, hi)``."""
    h = parse_header(f, size)
    wanted = [i for i, label in enumerate(h.labels) if choose(h, i, label)]
    if not wanted or not h.record_bytes:
        return
    per = max(1, int(round(seconds / h.seconds))) if h.seconds > 0 else 1
    span = per * h.record_bytes
    first = max(0, -(-(lo - h.data_at) // span))
    for b in range(first, -(-h.records // per)):
        at = h.data_at + b * span
        if at >= hi:
            break
        yield h, b, b * per, read_records(f, h, at, min(per, h.records - b * per), wanted, min_skip)


def _sample_rows(f, name: str, size: int, lo: int, hi: int, seconds: float, names: set[str] | None, min_skip: int):
    def choose(h, i, label):
        return not h.is_text(i) and (names is None or label in names)

    for h, b, record, found in _blocks_in(f, size, lo, hi, seconds, choose, min_skip):
        for i, raw in found.items():
            volts = TO_VOLTS.get(h.units[i].lower(), 1.0)
            x = (decode(raw.reshape(-1), h.width) * h.gain[i] + h.offset[i]) * volts
            yield (name, h.labels[i], h.counts[i] / h.seconds, b, record * h.counts[i], x)


def _note_rows(f, name: str, size: int, lo: int, hi: int, seconds: float, min_skip: int):
    for _, _, _, found in _blocks_in(f, size, lo, hi, seconds, lambda h, i, label: h.is_text(i), min_skip):
        for raw in found.values():
            for record in raw:
                for note in parse_annotations(record.tobytes()):
                    yield (name, *note)


BATCH_BYTES = 8 << 20


def _batches(rows, kind: str):
    """Rows as Arrow batches of bounded size."""
    fields = ARROW[kind]

    def batch(part):
        return pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*part), fields)], schema=fields)

    part, held = [], 0
    for row in rows:
        part.append(row)
        held += row[-1].nbytes + 64 if kind == "blocks" else 128
        if held >= BATCH_BYTES:
            yield batch(part)
            part, held = [], 0
    if part:
        yield batch(part)


def recording_name(path: str, base: str) -> str:
    """Path below ``base`` without the ending; files of one name in two folders are two recordings."""
    inner, root = urlparse(path).path, urlparse(base).path.rstrip("/")
    rel = inner[len(root):].lstrip("/") if inner.startswith(root + "/") else os.path.basename(inner)
    return os.path.splitext(rel)[0]


def file_ranges(spark: SparkSession, path: str, step: int | None) -> DataFrame:
    """``path, length, lo, hi``: byte ranges of ``step`` bytes of all EDF/BDF files below ``path``; one per file if None."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.{[eE][dD][fF],[bB][dD][fF]}").load(path).select("path", "length")
    if step is None:
        return listed.select("path", "length", F.lit(0).cast("bigint").alias("lo"), F.col("length").alias("hi"))
    cut = listed.select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(step).cast("bigint"))).alias("lo"))
    return cut.withColumn("hi", F.least(F.col("lo") + step, "length"))


RANGES_PER_TASK = {"blocks": 1, "annotations": 4, "channels": 64}
MAX_TASKS = 100_000


def _load(spark: SparkSession, path: str, kind: str, channels: list[str] | None = None, block_seconds: float = 60.0,
          split_bytes: int = 64 << 20, min_skip: int = MIN_SKIP) -> DataFrame:
    ranges = file_ranges(spark, path, None if kind == "channels" else split_bytes)
    tasks = min(MAX_TASKS, max(1, -(-ranges.count() // RANGES_PER_TASK[kind])))
    names = None if channels is None else set(channels)

    def read(batches):
        for given in batches:
            for r in given.to_pylist():
                name = recording_name(r["path"], path)
                with _open(r["path"]) as f:
                    if kind == "channels":
                        rows = _channel_rows(f, name, r["length"])
                    elif kind == "annotations":
                        rows = _note_rows(f, name, r["length"], r["lo"], r["hi"], block_seconds, min_skip)
                    else:
                        rows = _sample_rows(f, name, r["length"], r["lo"], r["hi"], block_seconds, names, min_skip)
                    yield from _batches(rows, kind)

    return ranges.repartition(tasks, "path", "lo").mapInArrow(read, SCHEMAS[kind])


def read_edf(spark: SparkSession, path: str, channels: list[str] | None = None, block_seconds: float = 60.0,
             split_bytes: int = 64 << 20, min_skip: int = MIN_SKIP) -> DataFrame:
    """Signal blocks in volts of all EDF/BDF files below ``path``; unwanted channels are not decoded and, where they fill
    ``min_skip`` bytes in a row, not read."""
    return _load(spark, path, "blocks", channels, block_seconds, split_bytes, min_skip)


def read_edf_channels(spark: SparkSession, path: str) -> DataFrame:
    """Channel table from the headers only."""
    return _load(spark, path, "channels")


def read_edf_annotations(spark: SparkSession, path: str, min_skip: int = MIN_SKIP) -> DataFrame:
    """Annotations of all files below ``path``; of the records only the text channels are read."""
    return _load(spark, path, "annotations", min_skip=min_skip)
