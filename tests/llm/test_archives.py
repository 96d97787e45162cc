"""Archives: round trips, damage of every kind, and the contract of pages."""

import gzip
import hashlib
import io
import os

import pytest

from voxelspark.llm import warc
from voxelspark.llm.warc import Gap, record_bytes, salvage

SCHEMA = "page_id long, url string, html string"


def record(k, body=b"", **headers):
    return record_bytes("resource", f"<urn:r:{k}>", "2020-01-01T00:00:00Z", body or b"body %d " % k * 40, **headers)


def read(data):
    """(number of each record, gaps as (offset, length))."""
    found = list(salvage(io.BytesIO(data), len(data)))
    return [int(x.headers["warc-record-id"][7:-1]) for x in found if not isinstance(x, Gap)], [(x.offset, x.length) for x in found if isinstance(x, Gap)]


@pytest.mark.parametrize("pack", [bytes, gzip.compress])
def test_whole_archives_have_no_gaps(pack):
    parts = [pack(record(k, b"\r\nWARC/1.0\r\n\r\n" + b"x" * n)) for k, n in enumerate((0, 5, 4096, 300_000, 7))]
    assert read(b"".join(parts)) == ([0, 1, 2, 3, 4], [])
    assert read(b"") == ([], [])


@pytest.mark.parametrize("pack", [bytes, gzip.compress])
@pytest.mark.parametrize("hurt", ["flip", "drop", "insert", "noise", "cut"])
def test_what_follows_damage_is_recovered(pack, hurt):
    parts = [pack(record(k)) for k in range(6)]
    middle = len(parts[2]) // 2
    at = middle if hurt != "noise" else 0
    piece = {
        "flip": lambda p: p[:at] + bytes([p[at] ^ 0xFF]) + p[at + 1 :],
        "drop": lambda p: p[:at] + p[at + 20 :],
        "insert": lambda p: p[:at] + os.urandom(33) + p[at:],
        "noise": lambda p: bytes(len(p)),
        "cut": lambda p: p[:at],
    }[hurt](parts[2])
    kept, gaps = read(b"".join(parts[:2]) + piece + b"".join(parts[3:]))
    assert kept == [0, 1, 3, 4, 5]
    assert gaps == [(len(parts[0] + parts[1]), len(piece))]


@pytest.mark.parametrize("pack", [bytes, gzip.compress])
def test_damage_at_the_ends(pack):
    parts = [pack(record(k)) for k in range(3)]
    whole = b"".join(parts)
    assert read(b"junk" + whole) == ([0, 1, 2], [(0, 4)])
    assert read(whole + b"junk") == ([0, 1, 2], [(len(whole), 4)])
    assert read(whole[:-40]) == ([0, 1], [(len(parts[0] + parts[1]), len(parts[2]) - 40)])
    # content whose digest holds is kept though its member is cut short; the cut is reported all the same
    assert read(whole[:-5]) == ([0, 1, 2] if pack is not bytes else [0, 1], [(len(parts[0] + parts[1]), len(parts[2]) - 5)])
    assert read(b"junk" * 100_000) == ([], [(0, 400_000)])


def test_false_starts_and_wrong_lengths():
    a, b = record(1), record(2)
    for bad in (b"WARC/1.0\r\n", b"WARC/1.0\r\nWARC-Type: x\r\n\r\n", b"WARC/1.0\r\nno header\r\n", b"\x1f\x8b\x08\x00", b"WARC/1.0\r\nWARC-Type: x\r\nContent-Length: 99999999999\r\n\r\n", gzip.compress(b"no record")):
        assert read(a + bad + b) == ([1, 2], [(len(a), len(bad))])
    # a length that swallows its neighbours: their records come back
    lying = record(3).replace(b"Content-Length: 280", b"Content-Length: 500")
    assert b"500" in lying
    assert read(lying + a + b) == ([1, 2], [(0, len(lying))])
    many = b"WARC/1.0\r\n" * 20_000
    assert read(many + a) == ([1], [(0, len(many))])


def test_several_records_of_one_member():
    good = [record(k) for k in range(5)]
    assert read(gzip.compress(b"".join(good))) == ([0, 1, 2, 3, 4], [])
    hurt = good[1].replace(b"body 1", b"body 9", 1)
    member = gzip.compress(good[0] + hurt + good[2]) + gzip.compress(good[3])
    kept, gaps = read(member)
    assert kept == [0, 2, 3] and gaps[0][0] == 0
    framed = good[1].replace(b"Content-Length: 280", b"Content-Length: 28")
    assert read(gzip.compress(good[0] + framed + good[2]))[0] == [0, 2]


def test_digests_in_hex_and_base_32():
    body = b"text"
    for declared in (hashlib.sha1(body).hexdigest(), "AAAA"):
        raw = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:r:1>\r\nWARC-Block-Digest: sha1:%s\r\nContent-Length: 4\r\n\r\ntext\r\n\r\n" % declared.encode()
        assert read(raw)[0] == [1]  # what is no digest is not checked
    assert read(raw.replace(b"AAAA", b"0" * 40))[0] == []
    assert warc.digest_hex("SHA-1:" + "a" * 32) == ("sha1", bytes(20).hex())
    assert warc.digest_hex("crc:12") is None and warc.digest_hex(None) is None


def test_pages_by_brute_force(spark, tmp_path):
    long, longer = "é" * 500, "<p>a</p>\r\nWARC/1.0\r\n" * 60
    pages = [
        (1, "http://a/1", long), (2, None, long), (3, "http://a/3\r\nX: y", long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""),
        (8, "u", longer), (9, "u", longer), (9, "u", longer), (None, "u", longer), (10, "u", "x" * 999), (11, "u", "x" * 999), (12, "u", "y" * 3_000_000), (-13, "u", "z"),
    ]
    best = {}
    for i, _, h in pages:
        if h and len(h.encode()) >= 1000 and i is not None:
            best[h] = max(best.get(h, i), i)
    want = []
    for i, _, h in pages:
        again = h in best and i != best[h]
        want.append((i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if again else "response", best[h] if again else None))
    df = spark.createDataFrame(pages, SCHEMA).selectExpr("*", "'x' as record_type", "1 as payload", "2 as key")
    got = warc.archive_pages(df, str(tmp_path / "a"))
    rows = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    assert "http://a/3%0D%0AX:%20y" in [r["url"] for r in got.collect()]
    # revisits resolve to the payload of their response
    whole = warc.resolved(warc.read_warc(spark, str(tmp_path / "a")).where("record_type in ('response', 'revisit')"))
    assert sorted(bytes(r["payload"]).decode() for r in whole.collect()) == sorted(h or "" for _, _, h in pages)


def test_an_empty_table(spark):
    got = warc.archive_pages(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] and got.count() == 0


def test_files_of_lost_attempts_do_not_count_and_gaps_are_rows(spark, tmp_path):
    rows = [("response", f"<urn:r:{k}>", "u", None, None, 5, b"hello") for k in range(30)]
    df = spark.createDataFrame(rows, "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary")
    for compress in (True, False):
        folder = tmp_path / str(compress)
        warc.write_warc(df.repartition(3), str(folder), compress=compress, file_bytes=1500, date="2020-01-01T00:00:00Z")
        files = sorted(p for p in folder.iterdir() if ".warc" in p.name)
        assert len(files) > 3
        (folder / f"stray.warc{'.gz' * compress}").write_bytes(files[0].read_bytes())
        assert warc.read_warc(spark, str(folder)).where("record_type = 'response'").count() == 30
        data = bytearray(files[0].read_bytes())
        middle = data.index(b"\x1f\x8b\x08" if compress else b"WARC/1.1", 40) + 30
        data[middle] ^= 255
        files[0].write_bytes(data)
        found = warc.read_warc(spark, str(folder)).collect()
        lost = [r for r in found if r["gap"]]
        assert len(lost) == 1 and lost[0]["path"].endswith(files[0].name) and lost[0]["offset"] <= middle < lost[0]["offset"] + lost[0]["length"]
        assert sum(r["record_type"] == "response" for r in found) == 29
