"""Archives: round trip, and salvage of damaged bytes."""

import base64
import gzip
import random
import hashlib

from tamarisk.llm.warc import payload_digest, read_archives, record, salvage, with_roles, write_archives


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "x"), (2, "http://a/ b", "x"), (3, None, None), (4, "u", ""), (5, "u", "é" * 9000),
            (6, "http://c/\r\nX: y", "WARC/1.1\r\n\r\n\x1f"), (None, "u", "x")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload_digest string")
    folder = str(tmp_path / "warc")
    write_archives(with_roles(pages), folder)
    got = read_archives(spark, folder, with_payload=True).collect()
    assert all(r.gap_reason is None for r in got)
    by_id = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    last = {}
    for i, _, html in rows:
        if i is not None:
            last[html or ""] = max(i, last.get(html or "", i))
    for i, _, html in rows:
        raw, r = (html or "").encode(), by_id[i]
        again = i != last[html or ""]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), digest(raw))
        assert (r.record_type, r.refers_to) == (("revisit", last[html or ""]) if again else ("response", None))
        assert r.payload == (None if again else raw)


def test_empty_table(spark, tmp_path):
    folder = str(tmp_path / "warc")
    write_archives(with_roles(spark.createDataFrame([], "page_id long, url string, html string")), folder)
    assert read_archives(spark, folder).collect() == []


def test_digest_column(spark):
    for data in (b"", b"abc", bytes(range(256))):
        row = spark.createDataFrame([(bytearray(data),)], "b binary").select(payload_digest("b")).first()
        assert row[0] == digest(data)


def test_salvage():
    plain = [record(i, f"http://h/{i}", b"p%d" % i, digest(b"p%d" % i), None, "2024-01-01T00:00:00Z") for i in range(5)]
    members = [gzip.compress(r, mtime=0) for r in plain]
    assert [h["warc-target-uri"] for _, _, h, _ in salvage(b"".join(members))] == [f"http://h/{i}" for i in range(5)]
    bad = bytearray(members[2])
    bad[len(bad) // 2] ^= 0xFF
    content = b"junk" + members[0] + plain[1] + bytes(bad) + members[3] + members[4][:-5]
    found = list(salvage(content))
    assert [h["warc-target-uri"] for _, _, h, _ in found if h] == ["http://h/0", "http://h/1", "http://h/3"]
    gaps = [(a, b) for a, b, h, _ in found if h is None]
    at = 4 + len(members[0]) + len(plain[1])
    assert gaps == [(0, 4), (at, at + len(bad)), (at + len(bad) + len(members[3]), len(content))]
    assert list(salvage(b"")) == []


def test_salvage_inside_members():
    url = "warc-target-uri"
    rng = random.Random(6)
    pay = [bytes(rng.randrange(256) for _ in range(3000)) for _ in range(6)]
    plain = [record(i, f"http://h/{i}", pay[i], digest(pay[i]), None, "2024-01-01T00:00:00Z") for i in range(6)]
    torn = plain[2].replace(pay[2][:9], b"otherwise", 1)
    sound = gzip.compress(b"".join([*plain[:2], torn, *plain[3:5]]), mtime=0)
    tail = gzip.compress(plain[5], mtime=0)
    found = list(salvage(sound + tail))
    assert [h[url] if h else (a, b, w) for a, b, h, w in found] == [
        "http://h/0", "http://h/1", "http://h/3", "http://h/4", (0, len(sound), "payload digest differs"), "http://h/5"]
    whole = gzip.compress(b"".join(plain), mtime=0)
    cut = whole[: len(whole) - 4000]
    found = list(salvage(cut + tail))
    assert [h[url] for _, _, h, _ in found if h] == [f"http://h/{i}" for i in (0, 1, 2, 3, 5)]
    assert [(a, b) for a, b, h, _ in found if h is None] == [(0, len(cut))]
    hurt = cut + b"\xff" * 200 + whole[len(cut) + 200 :]
    assert [h[url] for _, _, h, _ in salvage(hurt + tail) if h][:4] == [f"http://h/{i}" for i in range(4)]


def test_a_record_inside_a_damaged_payload_is_none(tmp_path):
    date = "2024-01-01T00:00:00Z"
    inner = record(77, "http://inside/", b"inner", digest(b"inner"), None, date)
    outer_pay = b"before " + inner + b" after"
    outer = record(1, "http://outer/", outer_pay, digest(outer_pay), None, date).replace(b"before", b"BEFORE", 1)
    after = record(2, "http://after/", b"x", digest(b"x"), None, date)
    for content, end in ((outer + after, len(outer)), (gzip.compress(outer + after, mtime=0), None)):
        found = list(salvage(content))
        assert [h["warc-target-uri"] for _, _, h, _ in found if h] == ["http://after/"]
        gaps = [(a, b, w) for a, b, h, w in found if h is None]
        assert gaps == [(0, end or len(content), "payload digest differs")]
    # where the end mark is gone too, the search goes on inside
    short = outer[: len(outer) - 8] + after
    assert [h["warc-target-uri"] for _, _, h, _ in salvage(short) if h] == ["http://inside/", "http://after/"]


def test_nulls_and_repeated_ids(spark, tmp_path):
    rows = [(1, "u", "same"), (1, "u", "same"), (None, None, None), (None, "u", "same"), (2, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    write_archives(with_roles(pages), str(tmp_path / "w"))
    got = read_archives(spark, str(tmp_path / "w")).collect()
    assert len(got) == len(rows) and all(r.gap_reason is None for r in got)
    assert sorted(r.payload_bytes for r in got) == [0, 0, 4, 4, 4]
    assert {r.refers_to for r in got if r.record_type == "revisit" and r.payload_bytes == 4} <= {1}
