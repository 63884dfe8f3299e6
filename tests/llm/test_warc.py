import base64
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from hostlens.llm import warc
from hostlens.llm.common import shared_dir


def archive(n, zipped):
    rows = [(k, f"http://x/{k}", (b"<p>%d</p>" % k) * (k * 7 % 50 + 1)) for k in range(n)]
    raw = [warc.record(k, u, p, None, False) for k, u, p in rows]
    return rows, [warc.member(r) if zipped else r for r in raw]


def read(data):
    return list(warc.salvage(io.BytesIO(data)))


@pytest.mark.parametrize("zipped", [True, False])
def test_round_trip(zipped):
    rows, parts = archive(40, zipped)
    found = read(b"".join(parts))
    assert [f.payload for f in found] == [p for _, _, p in rows]
    assert [f.problem for f in found] == [None] * 40
    assert [(f.start, f.end) for f in found] == [(sum(map(len, parts[:k])), sum(map(len, parts[: k + 1]))) for k in range(40)]


@pytest.mark.parametrize("zipped", [True, False])
@pytest.mark.parametrize("damage", ["flip", "cut", "junk", "drop", "tail", "head"])
def test_salvage(zipped, damage):
    rows, parts = archive(20, zipped)
    k = 7
    if damage == "flip":
        at = len(parts[k]) // 2
        parts[k] = parts[k][:at] + bytes([parts[k][at] ^ 0xFF]) + parts[k][at + 1 :]
    elif damage == "cut":
        parts[k] = parts[k][: len(parts[k]) // 2]
    elif damage == "junk":
        parts[k] = random.Random(1).randbytes(5000)
    elif damage == "drop":
        parts[k] = parts[k][9:]
    elif damage == "tail":
        k, parts[19] = 19, parts[19][:-7]
    else:
        k, parts[0] = 0, b"\x00\x01" + parts[0][5:]
    found = read(b"".join(parts))
    good = [f for f in found if f.problem is None]
    assert [f.payload for f in good] == [p for j, (_, _, p) in enumerate(rows) if j != k]
    gaps = [f for f in found if f.problem]
    start = sum(map(len, parts[:k]))
    assert [(g.start, g.end) for g in gaps] == [(start, start + len(parts[k]))]


def test_no_valid_bytes():
    assert read(b"") == []
    (gap,) = read(b"WARC/1.1 nothing" * 1000)
    assert (gap.start, gap.end) == (0, 16000) and gap.problem


def test_long_payload_and_marks_inside():
    payload = (b"WARC/1.1\r\n\r\n\x1f\x8b\x08" * 50_000) + b"end"
    for zipped in (True, False):
        r = warc.record(1, None, payload, None, False)
        found = read((warc.member(r) if zipped else r) * 2)
        assert [f.payload == payload for f in found] == [True, True]


@pytest.mark.parametrize("zipped", [True, False])
def test_headers_of_any_length(zipped):
    url = "http://x/" + "u" * (1 << 20)
    parts = [warc.record(k, url if k == 1 else "http://y", b"p", None, False) for k in range(3)]
    found = read(b"".join(warc.member(p) if zipped else p for p in parts))
    assert [f.problem for f in found] == [None] * 3 and found[1].headers["warc-target-uri"] == url


class Counted(io.BytesIO):
    read_bytes = 0

    def read(self, n=-1):
        data = super().read(n)
        self.read_bytes += len(data)
        return data


def test_damage_costs_no_more_than_the_archive():
    """A wrong length is not believed, a bomb is not inflated, and marks without records are passed in one go."""
    good = warc.record(1, "u", b"p" * 5000, None, False)
    lie = good.replace(b"Content-Length: 5", b"Content-Length: 995", 1)
    file = Counted(lie + good * 3)
    found = list(warc.salvage(file))
    assert [f.problem is None for f in found] == [False, True, True, True]
    assert file.read_bytes < 10 * warc.READ
    bomb = warc.member(b"\0" * (200 << 20))
    found = read(bomb + warc.member(good))
    assert [f.problem is None for f in found] == [False, True]
    marks = Counted(b"WARC/1.1\r\nx: y\r\n" * 100_000 + good)
    found = list(warc.salvage(marks))
    assert found[-1].problem is None and found[-1].payload == b"p" * 5000
    assert marks.read_bytes < 100 << 20


def test_gaps_are_logged(spark, tmp_path):
    rows, parts = archive(10, True)
    parts[4] = parts[4][:-9]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts))
    m = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz", 10, 1)], warc.MANIFEST)
    found = warc.read_archives(m)
    assert sorted(r.page_id for r in found.filter("kind = 'record'").collect()) == [k for k in range(10) if k != 4]
    assert warc.quarantined(found, f"{tmp_path}/gaps") == 1
    gap = spark.read.parquet(f"{tmp_path}/gaps").first()
    assert (gap.start, gap.end) == (sum(map(len, parts[:4])), sum(map(len, parts[:5]))) and gap.problem
    assert warc.quarantined(found.filter("kind = 'record'"), f"{tmp_path}/none") == 0


PAGES = [(7, "http://long/" + "u" * (1 << 20), "long"), (1, "http://a", "same"), (2, "http://b", "same"), (3, "http://c", "other"), (4, None, None), (5, "x\r\ny", ""), (None, "http://n", "same"), (1, "http://a", "same"), (6, "http://é", "é" * 1000), (None, None, "alone"), (0, "u", "other")]


def test_pages(spark, folder):
    d = folder(pages=spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3))
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op10(spark, d).collect()), key=str)
    want = []
    for page, _, html in PAGES:
        data = (html or "").encode()
        ids = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        first = min(ids, default=None)
        again = first is not None and (page is None or page > first)
        want.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=str)


def test_small_archives_and_payloads(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    m = warc.write_archives(pages, shared_dir(spark, "w"), archive_bytes=300).persist()
    assert m.agg(F.sum("records")).first()[0] == len(PAGES) and m.count() > 1
    found = warc.read_archives(m, payloads=True).collect()
    assert {r.kind for r in found} == {"record"}
    assert sorted(bytes(r.payload).decode() for r in found if r.record_type == "response") == sorted(["long", "same", "same", "other", "", "é" * 1000, "alone"])
    assert warc.write_archives(pages.limit(0), shared_dir(spark, "w")).count() == 0
