"""Archives: round trips, revisits, and recovery of damaged files."""

from __future__ import annotations

import gzip
import hashlib
import random

import pytest

from reviewshift.llm import queries, warc
from tests.conftest import SF_CHECK


def made(i, size=300):
    rng = random.Random(i)
    payload = bytes(rng.choices(b"abc \r\n<>", k=size)) + b"\r\n\r\nWARC/1.1\r\nWARC-Type: fake\r\n\r\n"
    return warc.record(i, f"http://x/{i}", payload, hashlib.sha256(payload).hexdigest(), None)


def archive(packed, n=12):
    parts = [warc.member(made(i)) if packed else made(i) for i in range(n)]
    starts = [sum(map(len, parts[:i])) for i in range(n + 1)]
    return b"".join(parts), starts


def test_members_are_plain_gzip():
    for data in (b"", made(1), b"x" * (1 << 24), bytes(1 << 24)):
        assert warc.member(data)[-1] == 0 and gzip.decompress(warc.member(data)) == data


@pytest.mark.parametrize("packed", [True, False])
def test_whole_archives_have_no_gaps(packed):
    data, starts = archive(packed)
    rows = list(warc.salvage(data))
    assert [(r["kind"], r["offset"], r["page_id"]) for r in rows] == [("record", s, i) for i, s in enumerate(starts[:-1])]


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("harm", ["flip", "cut", "insert", "head", "tail", "length"])
def test_later_records_are_recovered(packed, harm):
    data, starts = archive(packed)
    hurt = {5}
    if harm == "flip":
        at = (starts[5] + starts[6]) // 2 + 20
        data = data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1:]
    elif harm == "cut":
        data = data[:starts[5] + 40] + data[starts[6] - 3:]
    elif harm == "insert":
        data, hurt = data[:starts[5]] + b"\x1f\x8b\x08 junk WARC/1.junk" + data[starts[5]:], set()
    elif harm == "head":
        data = data[:starts[5]] + b"XX" + data[starts[5] + 2:]
    elif harm == "tail":
        data, hurt = data[:starts[11] + 50], {11}
    elif packed:
        data = data[:starts[5]] + gzip.compress(made(5).replace(b"Content-Length: 4", b"Content-Length: 9")) + data[starts[6]:]
    else:
        data = data[:starts[5]] + made(5).replace(b"Content-Length: 4", b"Content-Length: 9") + data[starts[6]:]
    rows = list(warc.salvage(data))
    assert [r["page_id"] for r in rows if r["kind"] == "record"] == [i for i in range(12) if i not in hurt]
    gaps = [r for r in rows if r["kind"] == "gap"]
    assert len(gaps) == 1 and gaps[0]["reason"]
    # records and gaps cover the file without overlap
    at = 0
    for r in rows:
        assert r["offset"] == at
        at += r["size"]
    assert at == len(data)


def test_only_junk_and_empty_files():
    assert list(warc.salvage(b"")) == []
    assert [r["kind"] for r in warc.salvage(b"no archive " * 50)] == ["gap"]


def brute(rows):
    first = {}
    for i, p in rows:
        data = (p or "").encode()
        if len(data) >= warc.MIN_REVISIT and i is not None:
            first[data] = min(i, first.get(data, i))
    out = []
    for i, p in rows:
        data = (p or "").encode()
        refers = first.get(data) if first.get(data) != i else None
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


def test_awkward_pages(spark):
    page = "<p>é🙂</p>\r\n\r\nWARC/1.1\r\n" * 20
    rows = [(3, "u", page), (1, "u\r\nX: y", page), (2, None, page), (2, None, page), (None, "u", page), (4, "u", None),
            (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "u", "x" * 99), (9, "u", "x" * 99), (10, "u", "y" * 100),
            (11, "u", "y" * 100), (12, "u", "\0\x1f" * 200), (13, "é", "z" * 300_000)]
    df = spark.createDataFrame([(*r, "a", "b", 1) for r in rows],
                               "page_id long, url string, html string, digest string, payload string, first_id int")
    out = warc.round_trip(df)
    assert out.filter("kind = 'gap'").count() == 0
    got = sorted((tuple(r) for r in out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    assert got == brute([(r[0], r[2]) for r in rows])
    assert warc.round_trip(df.limit(0)).count() == 0


def test_payloads_and_damage_through_spark(spark, tmp_path):
    data, starts = archive(True)
    (tmp_path / "a.warc.gz").write_bytes(data[:starts[4] + 9] + data[starts[5]:])
    (tmp_path / "b.warc").write_bytes(archive(False)[0])
    rows = warc.read(spark, str(tmp_path)).collect()
    assert sorted(r["page_id"] for r in rows if r["kind"] == "record") == sorted([*range(12), *(i for i in range(12) if i != 4)])
    assert [r["kind"] for r in rows].count("gap") == 1
    assert all(hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"] for r in rows if r["kind"] == "record")


def test_query_equals_brute_force(spark):
    rows = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{SF_CHECK}/pages.parquet").collect()]
    assert sorted(map(tuple, queries.op10_warc(spark, SF_CHECK).collect()), key=str) == brute(rows)


def ids(rows):
    return [r["page_id"] for r in rows if r["kind"] == "record"]


@pytest.mark.parametrize("level", [0, 9])
def test_bad_record_inside_a_member(level):
    parts = [made(i) for i in range(12)]
    parts[5] = parts[5].replace(b"sha256:", b"sha256:0")
    parts[8] = parts[8].replace(b"Content-Length: 4", b"Content-Length: 9")
    data = gzip.compress(b"".join(parts), level)
    rows = list(warc.salvage(made(20) + data + warc.member(made(21))))
    assert ids(rows) == [20, *(i for i in range(12) if i not in (5, 8)), 21]
    gaps = [r for r in rows if r["kind"] == "gap"]
    assert [(g["unpacked_offset"], g["unpacked_size"]) for g in gaps] == [
        (sum(map(len, parts[:i])), len(parts[i])) for i in (5, 8)]
    assert all(g["reason"] and (g["offset"], g["size"]) == (len(made(20)), len(data)) for g in gaps)


@pytest.mark.parametrize("level", [0, 9])
@pytest.mark.parametrize("harm", ["cut", "flip", "crc", "trailer"])
def test_damaged_member_of_several_records(level, harm):
    # payloads that hardly pack, so damage in the middle of the file is in the middle of the records
    payloads = [random.Random(i).randbytes(20_000) for i in range(12)]
    parts = [warc.record(i, "u", p, hashlib.sha256(p).hexdigest(), None) for i, p in enumerate(payloads)]
    data = gzip.compress(b"".join(parts), level)
    at = len(data) // 2 + 3000
    if harm == "cut":
        data = data[:at]
    elif harm == "flip":
        data = data[:at] + b"\xff" * 40 + data[at + 40:]
    elif harm == "crc":
        data = data[:-8] + bytes([data[-8] ^ 1]) + data[-7:]
    else:
        data = data[:-3]
    rows = list(warc.salvage(data + warc.member(made(21))))
    found = ids(rows)
    assert found[-1] == 21 and len(set(found)) == len(found)
    assert set(found) >= ({*range(12)} if harm in ("crc", "trailer") else {*range(6)})
    gaps = [r for r in rows if r["kind"] == "gap"]
    assert gaps and all(g["reason"] for g in gaps)
    # the file's bytes are covered without overlap
    places = sorted({(r["offset"], r["size"]) for r in rows})
    assert [p for p, _ in places] == [0, *(p + n for p, n in places[:-1])] and sum(n for _, n in places) == len(data) + len(warc.member(made(21)))


def test_files_are_cut_by_bytes(spark, scratch):
    """Pages that don't compress: files hold records up to the bound, and a greater record alone."""
    import glob
    import os
    rng = random.Random(12)
    noise = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(n))
    rows = [(i, "u", noise(3000)) for i in range(200)] + [(500, "u", noise(200_000)), (501, "u", "")]
    path = f"{scratch}/warc-bytes"
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write(df, path, file_bytes=100_000)
    sizes = sorted(os.path.getsize(f) for f in glob.glob(f"{path}/part-*"))
    assert len(sizes) > 10 and sizes[-2] <= 100_000 < sizes[-1]
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read(spark, path).collect()}
    assert got == {i: t for i, _, t in rows}


def test_a_damaged_own_archive_is_an_error(spark, monkeypatch):
    df = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    plain = warc.member
    monkeypatch.setattr(warc, "member", lambda data: plain(data.replace(b"page 7 ", b"page 8 ")))
    with pytest.raises(Exception, match="damaged archive"):
        warc.round_trip(df).collect()
