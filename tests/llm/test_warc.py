import hashlib

from pyspark.sql import functions as F

from millrace.llm import warc

TRAP = "x WARC/1.1\r\nWARC-Type: response\r\nX-Page-Id: 77\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" * 4
SCHEMA = "page_id long, url string, html string"
ROWS = [(5, "http://a/ b\nc", TRAP), (9, "http://b", TRAP), (2, None, None), (3, "u", ""), (4, "u", "short"), (8, "u", "short"), (None, "n", "y" * 200), (11, "m", "y" * 200), (12, "m", "y" * 200), (12, "m", "y" * 200), (20, "ü", "é" * 60), (21, "ü", "é" * 49)]


def expected(rows):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            d = hashlib.sha256(b).hexdigest()
            first[d] = min(first.get(d, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        d = hashlib.sha256(b).hexdigest()
        f = first.get(d)
        revisit = len(b) >= 100 and f is not None and sum((x or "").encode() == b for _, _, x in rows) > 1 and f != i
        out.append((i, len(b), d, "revisit" if revisit else "response", f if revisit else None))
    return sorted(map(str, out))


def test_roundtrip_with_magic_in_payloads(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA).withColumn("digest", F.lit("clash")).coalesce(2)
    for options in ({}, {"file_records": 3}, {"broadcast_rows": 0}):
        assert sorted(map(str, map(tuple, warc.roundtrip(pages, **options).collect()))) == expected(ROWS)


def test_traps_are_candidates_but_not_records(spark, tmp_path):
    pages = spark.createDataFrame(ROWS[:1], SCHEMA)
    warc.write(pages, str(tmp_path / "w"))
    assert warc.candidates(spark, str(tmp_path / "w")).count() == 5
    got = warc.read(spark, str(tmp_path / "w")).collect()
    assert [r.page_id for r in got] == [5] and got[0].intact and got[0].at == 0


def test_files_are_plain_warc(spark, tmp_path):
    warc.write(spark.createDataFrame(ROWS, SCHEMA).coalesce(1), str(tmp_path / "w"))
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    at = n = 0
    while at < len(data):
        assert data.startswith(b"WARC/1.1\r\n", at)
        head, _, _ = data[at:].partition(b"\r\n\r\n")
        size = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
        at += len(head) + 4 + size
        assert data[at : at + 4] == b"\r\n\r\n"
        at, n = at + 4, n + 1
    assert n == len(ROWS)


def test_chain_of_many_steps(spark):
    files = {"f": sorted([(10 * i, 10 * i + 10) for i in range(1000)] + [(5, 1000), (1005, 1015), (1015, 1020)]), "g": [(3, 9)], "h": [(0, 4)]}
    want = {("f", 10 * i) for i in range(1000)} | {("h", 0)}
    for block in (7, 64, 1 << 20):
        rows = [(f, at, nxt, leap) for f, es in files.items() for (at, nxt), leap in zip(es, warc.leaps(es, block), strict=True)]
        edges = spark.createDataFrame(rows, "path string, at long, next long, leap long")
        assert {(r.path, r.at) for r in warc.chain(edges, block).collect()} == want


def test_empty(spark):
    assert warc.roundtrip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hostile_pages_are_read_in_linear_time():
    import time

    took = []
    for n in (20_000, 80_000):
        data = b"WARC/1.1\r\nA: b\r\n" * n
        began = time.perf_counter()
        assert list(warc.parse(data)) == []
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * max(took[0], 0.02)


def test_damaged_records_raise_or_are_passed_over(spark, tmp_path):
    import pytest

    rows = [(i, "u", f"page {i} " * 30) for i in range(20)]
    warc.write(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(tmp_path / "w"))
    file = next(p for p in (tmp_path / "w").glob("part-*") if p.stat().st_size)
    data = file.read_bytes()
    at = data.index(b"page 7 ")
    for crc in (tmp_path / "w").glob(".*.crc"):
        crc.unlink()
    file.write_bytes(data[:at] + data[at + 40 :])  # a payload shorter than its header says
    with pytest.raises(ValueError, match="damaged"):
        warc.read(spark, str(tmp_path / "w"))
    got = sorted(r.page_id for r in warc.read(spark, str(tmp_path / "w"), resume=True).collect())
    assert got == [i for i in range(20) if i != 7]


def test_large_pages_have_files_of_their_own(spark, tmp_path):
    rows = [(i, "u", ("x" * (200_000 if i % 10 == 0 else 50)) + str(i)) for i in range(100)]
    pages = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    warc.write(pages, str(tmp_path / "w"), file_bytes=300_000, file_records=100)
    assert max(p.stat().st_size for p in (tmp_path / "w").glob("part-*")) < 400_000
    assert sorted(r.page_id for r in warc.read(spark, str(tmp_path / "w")).collect()) == list(range(100))


def test_very_long_payload_and_revisits_of_it(spark):
    long = TRAP * 20_000
    rows = [(3, "a", long), (1, "b", long), (2, "c", None), (7, "d", long)]
    pages = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in ("first", "payload", "path", "at", "intact", "_page")})
    assert sorted(map(str, map(tuple, warc.roundtrip(pages).collect()))) == expected(rows)
