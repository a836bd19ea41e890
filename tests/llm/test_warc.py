"""Archives: written, normalised, indexed and read back."""

from __future__ import annotations

import glob
import gzip
import hashlib

import pytest

from palisade.llm import warc

SCHEMA = "page_id bigint, url string, html string, digest int, record string, bytes string, first int, volume string"
LONG = "x" * 100 + "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"
ROWS = [
    (1, "u", None), (2, None, ""), (3, "u\r\nWARC-Type: none", LONG), (4, "u", LONG), (4, "u", LONG), (None, "u", LONG), (5, "u", "y" * 99), (6, "u", "y" * 99),
    (7, "u", "\0\n\r\n\x1f\x8b" * 1000), (-8, "u", "z\n" * 9_000_000), (9, "u", "z\n" * 9_000_000), (None, None, None), (None, "a", "q" * 200), (None, "b", "q" * 200),
    (10, "u", "w" * 200), (10, "v", "w" * 200), (11, "é", "﻿mark" * 40 + "\n"), (12, "u", "\n\n\r\r\n" * 30), (13, "u", "y" * 100), (14, "u", "y" * 100),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 1, "r", "b", 2, "v") for r in rows], SCHEMA).repartition(3)


def plain(rows) -> list[tuple]:
    known = [(i, (html or "").encode()) for i, _, html in rows]
    out = []
    for i, data in known:
        ids = [j for j, other in known if other == data and j is not None]
        again = len(data) >= 100 and bool(ids) and i != min(ids)
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", min(ids) if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert sorted(map(tuple, warc.round_trip(pages).collect()), key=str) == plain([(r.page_id, r.url, r.html) for r in pages.collect()])


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc"))
    warc.write_archives(table(spark), f"{path}/in")
    warc.normalise(spark, f"{path}/in", f"{path}/out", volume_bytes=2000)
    return f"{path}/out"


def test_odd_pages(spark, stored):
    got = warc.read_volumes(spark, stored).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=str) == plain(ROWS)


def test_archives_are_single_members_and_volumes_are_not(spark, stored):
    written = sorted(glob.glob(f"{stored}/../in/*.gz"))
    whole = b"".join(gzip.open(p).read() for p in written)
    volumes = glob.glob(f"{stored}/kind=members/*/*.txt")
    assert len(volumes) > len(written)
    again = b"".join(gzip.decompress(open(p, "rb").read()) for p in volumes)
    assert len(whole) == len(again) and sorted(whole.split(b"WARC/1.1")) == sorted(again.split(b"WARC/1.1"))


def test_index_gives_each_record(spark, stored):
    index = warc.read_index(spark, stored).collect()
    assert len(index) == len(ROWS)
    for r in index:
        (file,) = glob.glob(f"{stored}/kind=members/volume={r.volume}/*.txt")
        data = open(file, "rb").read()[r.offset : r.offset + r.length]
        text = gzip.decompress(data)
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode()) and r.record_id.encode() in text[:200]
        assert text.count(b"WARC-Record-ID") == 1 and text.endswith(b"\r\n\r\n")
    read = {(r.volume, r.offset, r.length) for r in warc.read_volumes(spark, stored).collect()}
    assert read == {(r.volume, r.offset, r.length) for r in index}


def test_large_record_is_followed_by_an_empty_member():
    small, large = warc.member_of(b"a"), warc.member_of(b"a" * (1 << 24))
    assert small[-1] == 0 == large[-1] and large.endswith(warc.EMPTY_MEMBER)
    assert warc.inflated(large + small, 0, "x") == (b"a" * (1 << 24) + b"\r\n\r\n", len(large))


def test_lookup(spark, stored):
    got = warc.lookup(spark, stored, spark.createDataFrame([("<urn:page:3>",), ("<urn:page:4>",), ("<urn:page:99>",)], "record_id string")).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(3, "response", None), (4, "revisit", 3), (4, "revisit", 3)]
    assert {bytes(r.payload) for r in got if r.payload is not None} == {LONG.encode()}


def test_members_are_taken_as_they_are(spark, stored, tmp_path):
    """An archive that has a member a record is read the same way."""
    record = b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 4\r\n\r\na\r\n\r" + warc.END.encode()
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record) * 3)
    source, to = str(tmp_path / "a.warc.gz"), str(tmp_path / "out")
    rows = warc.normalised(spark, source).where("kind = 'members'").collect()
    assert [gzip.decompress(bytes(r.value) + b"\0") for r in rows] == [record] * 3
    warc.normalise(spark, source, to)
    assert [r.record_type for r in warc.read_index(spark, to).collect()] == ["metadata"] * 3


def test_truncated_archive_is_an_error():
    stream = warc.RecordStream("a.gz")
    assert list(stream.add(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc")) == []
    with pytest.raises(ValueError, match="a.gz"):
        stream.close()


def test_pieces_of_any_size():
    record = b"WARC/1.1\r\nContent-Length: 6\r\n\r\n\r\n\r\na\n"
    whole = (record + b"\r\n\r\n") * 3
    for step in (1, 2, 3, 7, 1000):
        stream = warc.RecordStream("a")
        out = [r for i in range(0, len(whole), step) for r in stream.add(whole[i : i + step])]
        stream.close()
        assert out == [record] * 3


def test_empty(spark):
    assert warc.round_trip(table(spark, [])).collect() == []
