import hashlib
import io
import struct
import zipfile

import pytest

from cortexframe.llm import warc_zip as W


class Bytes:
    def __init__(self, raw):
        self.raw, self.size = raw, len(raw)

    def __call__(self, offset, length):
        assert 0 <= offset and offset + length <= self.size
        return self.raw[offset:offset + length]


def test_members_of_a_plain_archive():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"x" * 300 + b"PK\5\6" + b"y" * 40
        z.writestr("a/ü.txt", "one")
        z.writestr("b", b"two" * 1000, compress_type=zipfile.ZIP_DEFLATED)
    read = Bytes(out.getvalue())
    found = W.members(read, read.size)
    assert [(m.name, m.method, m.size) for m in found] == [("a/ü.txt", 0, 3), ("b", 8, 3000)]
    at = W.data_offset(read, found[0])
    assert read(at, found[0].stored) == b"one"
    with pytest.raises(ValueError, match="compressed"):
        W.data_offset(read, found[1])


def test_zip64_directory_and_sizes():
    """An archive whose sizes, offsets and counts stand in the ZIP64 fields alone."""
    body, name = b"stored bytes", b"m"
    pad = b"leading bytes"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0, 0, 0, 0, 0, W._FULL32, W._FULL32, 1, 20) + name
    local += struct.pack("<HHQQ", 1, 16, len(body), len(body))
    extra = struct.pack("<HH", 99, 2) + b"??" + struct.pack("<HHQQQ", 1, 24, len(body), len(body), len(pad))
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0, 0, 0, 0, 0, W._FULL32, W._FULL32, 1, len(extra), 0, 0, 0, 0, W._FULL32)
    central += name + extra
    start = len(pad) + len(local) + len(body)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, 1, 1, len(central), start)
    locator = struct.pack("<4sIQI", b"PK\6\7", 0, start + len(central), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, W._FULL32, W._FULL32, 0)
    read = Bytes(pad + local + body + central + end64 + locator + end)
    (m,) = W.members(read, read.size)
    assert m == W.Member("m", 0, len(pad), len(body), len(body))
    assert read(W.data_offset(read, m), m.stored) == body


def test_broken_archives():
    for raw in (b"", b"no zip at all", b"PK\5\6" + b"\0" * 17):
        with pytest.raises(ValueError):
            W.members(Bytes(raw), len(raw))


@pytest.fixture(scope="module")
def pages(spark):
    long = "<p>" + "ü" * 100
    rows = [(i, f"http://h/{i}", f"page {i} " * 30) for i in range(40)]
    rows += [(50, None, None), (51, "u\r\nX: y", ""), (52, "a", "short"), (53, "a", "short"), (60, "b", long), (59, "b", long), (61, None, long)]
    rows += [(59, "b", long), (None, "n", long), (None, "n", "alone " * 50), (70, "big", "x" * 3_000_000), (71, "crlf", "a\r\n\r\nb\0" * 30)]
    return spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id bigint, url string, html string, size int, digest string").repartition(3)


def test_round_trip(spark, pages, tmp_path):
    rows = W.read_records(W.write_archives(W.with_types(pages), f"file://{tmp_path}", archive_bytes=2000), records_per_range=3).collect()
    assert len(list(tmp_path.iterdir())) > 3
    sent = pages.collect()
    assert sorted((str(r["page_id"]), str(r["url"])) for r in rows) == sorted((str(r["page_id"]), str(r["url"])) for r in sent)
    html = {(r["page_id"], r["url"], (r["html"] or "")[:5]): (r["html"] or "").encode() for r in sent}
    kinds = {}
    for r in rows:
        kinds.setdefault(r["page_id"], []).append((r["record_type"], r["refers_to"]))
        full = [v for (p, u, _), v in html.items() if p == r["page_id"] and u == r["url"]]
        assert (r["payload_digest"], r["payload_bytes"]) in [(hashlib.sha256(v).hexdigest(), len(v)) for v in full]
        assert bytes(r["payload"]) in (full if r["record_type"] == "response" else [b""])
    assert kinds[59] == [("response", None)] * 2 and kinds[60] == kinds[61] == [("revisit", 59)]
    assert sorted(map(str, kinds[None])) == ["('response', None)", "('revisit', 59)"]
    assert kinds[52] == kinds[53] == kinds[50] == kinds[51] == [("response", None)]


def test_no_pages(pages):
    assert W.round_trip(pages.limit(0)).count() == 0


def test_ids_that_are_strings_and_reading_tasks(spark, tmp_path):
    same = "x" * 200
    rows = [("b\r\n\r\n", "u", same), ("a é", "u", same), (None, None, same), ("7", "u", "")] + [(f"p{i}", "u", f"{i}" * 50) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    archives = W.write_archives(W.with_types(pages), f"file://{tmp_path}", archive_bytes=2000)
    got = {r["page_id"]: r["refers_to"] for r in W.read_records(archives, 3, "string").collect()}
    assert set(got) == {r[0] for r in rows} and got["b\r\n\r\n"] == got[None] == "a é" and got["p3"] is None
    assert W.reading_tasks(W.record_ranges(archives, 3)) == spark.sparkContext.defaultParallelism
    back = W.round_trip(pages, str(tmp_path / "again"))
    assert back.schema["page_id"].dataType.simpleString() == "string" and back.count() == len(rows)
