import gzip
import hashlib
import random
import re
import time

from folioforge.llm import warc
from folioforge.llm.common import scratch
from folioforge.llm.warc import member, quarantined, read_warc, record_bytes, records, salvage, warc_round_trip, write_warc


def rec(i, body):
    return record_bytes(i, f"http://x/{i}", body, hashlib.sha1(body).hexdigest(), None, "response")


def test_members_are_plain_gzip():
    r = random.Random(0)
    for n in (0, 10, 5000, (1 << 24) + 5):
        data = r.randbytes(n)
        m = member(data)
        assert m[-1] == 0 and gzip.decompress(m) == data


def test_salvage_recovers_later_records():
    bodies = [b"", b"a" * 50, b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", b"\x1f\x8b\x08 no member", b"z" * 3000]
    for pack in (member, lambda x: x):
        parts = [pack(rec(i, b)) for i, b in enumerate(bodies)]
        whole = b"".join(parts)
        got = list(salvage(whole))
        assert [x[3]["page_id"] for x in got] == [0, 1, 2, 3, 4] and [x[3]["payload"] for x in got] == bodies
        # a byte of record 1 flips, and rubbish stands before record 4
        at = len(parts[0]) + len(parts[1]) - 30
        bad = bytearray(whole)
        bad[at] ^= 0xFF
        bad = bytes(bad[: -len(parts[4])]) + b"rubbish\x00" + parts[4]
        got = list(salvage(bad))
        assert [x[3]["page_id"] for x in got if x[0] == "record"] == [0, 2, 3, 4]
        gaps = [x[1:3] for x in got if x[0] == "gap"]
        assert gaps == [(len(parts[0]), len(parts[0]) + len(parts[1])), (len(bad) - len(parts[4]) - 8, len(bad) - len(parts[4]))]
        cut = list(salvage(whole[:-10]))
        assert cut[-1][0] == "gap" and cut[-1][2] == len(whole) - 10 and len([x for x in cut if x[0] == "record"]) == 4


def test_salvage_of_any_damage():
    r = random.Random(4)
    parts = [member(rec(i, r.randbytes(r.randrange(400)))) for i in range(12)]
    whole = b"".join(parts)
    for _ in range(200):
        a = r.randrange(len(whole))
        b = min(len(whole), a + r.randrange(1, 300))
        bad = whole[:a] + r.randbytes(r.randrange(60)) + whole[b:]
        got = list(salvage(bad))
        ids = [x[3]["page_id"] for x in got if x[0] == "record"]
        ends = [sum(map(len, parts[: i + 1])) for i in range(12)]
        safe = [i for i in range(12) if ends[i] <= a or ends[i] - len(parts[i]) >= b]
        assert [i for i in ids if i in safe] == safe
        at = 0
        for x in got:
            assert x[1] in (at, got[got.index(x) - 1][1])
            at = x[2]
        assert at == len(bad)


def test_salvage_inside_a_member():
    texts = [rec(i, bytes([97 + i]) * 300) for i in range(5)]
    whole = gzip.compress(b"".join(texts))
    assert [x[3]["page_id"] for x in salvage(whole)] == [0, 1, 2, 3, 4]
    # a payload that is not the one of the digest, and a length that is not the block's
    for bad in (texts[2].replace(b"c" * 300, b"c" * 299 + b"x"), re.sub(rb"(?i)(\r\ncontent-length: *)\d+", rb"\g<1>7", texts[2], count=1)):
        assert bad != texts[2]
        one = gzip.compress(b"".join([*texts[:2], bad, *texts[3:]]))
        got = list(salvage(one + whole))
        assert [x[3]["page_id"] for x in got if x[0] == "record"] == [0, 1, 3, 4, 0, 1, 2, 3, 4]
        assert [x[1:3] for x in got if x[0] == "gap"] == [(0, len(one))]
    # the checksum of the member, and its end
    for one in (whole[:-6] + b"\x00\x00" + whole[-4:], whole[:-8]):
        got = list(salvage(one))
        assert [x[3]["page_id"] for x in got if x[0] == "record"] == [0, 1, 2, 3, 4]
        assert [x[1:3] for x in got if x[0] == "gap"] == [(0, len(one))]


def test_round_trip(spark):
    big, other = "ü" * 600, "b" * 1000
    rows = [(1, "u", big), (2, "u", big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "a\r\nb", other), (None, "u", other), (8, "u", ""), (8, "u", ""), (9, "u", "c" * 999), (10, "u", "c" * 999)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, sha1 int")
    got = sorted((tuple(r) for r in warc_round_trip(df).collect()), key=repr)
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        to = 3 if h == big and i < 3 else None
        want.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if to else "response", to))
    assert got == sorted(want, key=repr)
    assert warc_round_trip(df.limit(0)).count() == 0


def test_archives_on_disk(spark):
    df = spark.range(200).selectExpr("id as page_id", "concat('http://h/', id) as url", "repeat(cast(id % 50 as string), 900) as html")
    path = scratch(spark, "t")
    write_warc(df, path)
    read = read_warc(spark, path)
    assert quarantined(read).count() == 0
    got = {r.page_id: r for r in records(read).collect()}
    assert len(got) == 200 and sum(r.record_type == "revisit" for r in got.values()) == 40 * 3
    for i, r in got.items():
        body = (str(i % 50) * 900).encode()
        assert r.payload_bytes == len(body) and r.url == f"http://h/{i}"
        assert bytes(r.payload) == body if r.record_type == "response" else r.refers_to == 150 + i % 50


def test_false_starts_cost_little():
    good = member(rec(1, b"x" * 500))
    for junk in (b"\x1f\x8b\x08" * 100_000, (b"\x1f\x8b\x08\x00" + b"\0" * 6) * 30_000, gzip.compress(b"no record " * 50)[:40] * 8_000, b"WARC/1.0\r\n" * 20_000, b"\x00" * 3_000_000):
        began = time.time()
        got = list(salvage(junk + good + junk + good))
        assert time.time() - began < 20, junk[:20]
        assert [x[3]["page_id"] for x in got if x[0] == "record"] == [1, 1]


def test_lying_lengths_are_linear():
    good = rec(1, b"x" * 500)

    def seconds(junk):
        began = time.time()
        got = list(salvage(junk + good))
        assert [x[3]["page_id"] for x in got if x[0] == "record"] == [1], junk[:30]
        return time.time() - began

    for line in (b"WARC/1.0\r\nContent-Length: 90000000\r\n\r\n", b"WARC/1.0\r\nContent-Length: 200000\r\n\r\n", b"a:WARC/1.0\r\n", b"WARC/1.0\r\na: b\r\n", b"WARC/1.0\r\nContent-Length: " + b"9" * 18 + b"\r\n\r\n", b"WARC/1.0\r\nContent-Length: x\r\n\r\n"):
        small, large = (seconds(line * (n // len(line))) for n in (1_250_000, 5_000_000))
        assert large < 10 and large < 8 * max(small, 0.2), line  # the square would be sixteen times as slow
        inside = seconds(gzip.compress(line * 20_000))
        assert inside < 10


def test_a_url_that_ends_like_a_version_line():
    one = rec(7, b"abc").replace(b"http://h/", b"http://h/WARC/1.0\r\nX: ", 1) if b"http://h/" in rec(7, b"abc") else rec(7, b"abc").replace(b"Content-Length", b"X: y/WARC/1.0\r\nContent-Length", 1)
    assert [x[3]["page_id"] for x in salvage(one + one)] == [7, 7]


def test_archives_are_bounded_in_bytes(spark):
    import os

    # a few large pages among many small ones, none of which compresses
    df = spark.range(400).selectExpr("id as page_id", "'u' as url", "array_join(transform(sequence(1, if(id % 97 = 0, 3000, 10)), x -> sha2(concat(id, x), 256)), '') as html").coalesce(1)
    path = scratch(spark, "t")
    write_warc(df, path, archive_bytes=300_000)
    sizes = [os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.startswith("part")]
    assert max(sizes) <= 300_000 and len(sizes) > 2
    assert records(read_warc(spark, path)).count() == 400


def test_versions_and_bombs(monkeypatch):
    for version in (b"WARC/0.17", b"WARC/0.18", b"WARC/1.0", b"WARC/1.1"):
        one = rec(3, b"abc").replace(b"WARC/1.1", version, 1)
        assert [x[3]["page_id"] for x in salvage(one + member(one))] == [3, 3]
    assert [x[0] for x in salvage(rec(3, b"abc").replace(b"WARC/1.1", b"WARC/9.9", 1))] == ["gap"]
    bomb = gzip.compress(rec(1, b"a") + b"\0" * 5_000_000 + rec(2, b"b"))
    text, _, wrong = warc._inflate(memoryview(bomb), 0, 1 << 16)
    assert len(text) == 1 << 16 and "too much" in wrong
    whole, stop, wrong = warc._inflate(memoryview(bomb), 0)
    assert stop == len(bomb) and wrong is None and len(whole) > 5_000_000


def test_pages_without_copies_are_not_shuffled(spark):
    df = spark.range(300).selectExpr("id as page_id", "'u' as url", "repeat(cast(if(id < 20, 7, id) as string), 1900) as html").repartition(5)
    path = scratch(spark, "t")
    write_warc(df, path, archive_bytes=20_000)
    read = read_warc(spark, path)
    assert read.select("file").distinct().count() > 10 and quarantined(read).count() == 0
    got = {r.page_id: r for r in records(read).collect()}
    assert len(got) == 300 and sum(r.record_type == "revisit" for r in got.values()) == 19 and {r.refers_to for r in got.values() if r.refers_to} == {19}
