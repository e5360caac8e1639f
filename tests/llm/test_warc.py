"""Archives: round trips, revisits against brute force, and what the reader skips."""

import base64
import gzip
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from trackweave.llm import warc

SF = "/root/testdata/sf0.001"


def expected(rows):
    first: dict[bytes, int] = {}
    payloads = [(i, (h or "").encode()) for i, _, h in rows]
    for i, p in payloads:
        first[p] = min(first.get(p, i), i)
    return sorted((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if first[p] == i else "revisit", None if first[p] == i else first[p]) for i, p in payloads)


def got(df):
    return sorted(tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


ROWS = [(5, "http://a/", "x"), (3, None, "x"), (9, "http://b/\r\nWARC-Type: z", None), (2, "", ""), (7, "http://c/", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc"), (8, "u", "é\U0001f600\r\n\r\n" * 50_000), (4, "u", "y\x00\x1f\x8b")]


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_round_trip_of_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.collect()]
    assert got(warc.round_trip(pages)) == expected(rows)


def test_odd_pages(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumns({"payload": F.lit("own"), "_sha": F.lit("own"), "_n": F.lit(0), "record_type": F.lit("own")})
    assert got(warc.round_trip(df.repartition(3))) == expected(ROWS)
    assert got(warc.round_trip(df.limit(0))) == []
    twice = warc.round_trip(df.unionAll(df.filter("page_id = 4"))).filter("page_id = 4")
    assert [r["record_type"] for r in twice.collect()] == ["response", "response"]
    nameless = spark.createDataFrame([(None, "u", "x"), (1, "u", "x")], "page_id long, url string, html string")
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in warc.round_trip(nameless).collect()) == [(0, "revisit", 1), (1, "response", None)]


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_pushed_filters(spark, tmp_path, compression):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    warc.archive_pages(df, f"{tmp_path}/a", compression=compression)
    back = warc.read_warc(spark, f"{tmp_path}/a")
    assert back.count() == len(ROWS)
    assert {bytes(r["payload"]).decode() for r in back.filter("record_type = 'response'").collect()} == {h or "" for _, _, h in ROWS}
    assert back.filter("record_type = 'revisit' and content_length > 0").count() == 2
    assert back.filter(F.col("record_id").isin("<urn:page:7>", "<urn:page:8>", None)).count() == 2
    assert back.filter(F.col("refers_to").isNotNull()).count() == 2 and back.filter(F.col("refers_to").isNull()).count() == 5
    assert warc.read_warc(spark, f"{tmp_path}/a", "record_id string", record_types="revisit").count() == 2
    assert warc.read_warc(spark, f"{tmp_path}/a", "record_id string", header="WARC-Record-ID=<urn:page:8>").count() == 1
    for r in back.filter("record_type = 'response'").collect():
        assert r["payload_digest"] == f"sha1:{r['computed_digest']}"


def test_payloads_of_unwanted_records_are_not_taken(tmp_path, monkeypatch):
    with gzip.open(tmp_path / "a.warc.gz", "wb") as f:
        for k in range(5):
            f.write(warc.record_bytes(f"<urn:page:{k}>", "response", f"http://x/{k}", "2024-01-01T00:00:00Z", None, b"p" * 100_000))
    taken = []
    monkeypatch.setattr(warc._Members, "take", lambda self, n, f=warc._Members.take: taken.append(n) or f(self, n))
    from pyspark.sql.types import _parse_datatype_string  # the reader gets a schema as Spark hands it over

    reader = warc.WarcReader.__new__(warc.WarcReader)
    reader.columns, reader.options, reader.tests = ["record_id", "payload"], {"path": str(tmp_path)}, [("record_id", ("=", "<urn:page:3>"))]
    assert _parse_datatype_string is not None
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [r[0] for r in rows] == ["<urn:page:3>"] and len(taken) == 1
    reader.columns = ["record_id", "target_uri"]
    assert len([r for p in reader.partitions() for r in reader.read(p)]) == 1 and len(taken) == 1


def test_no_archives(spark, tmp_path):
    assert warc.read_warc(spark, f"{tmp_path}/none").collect() == []


def test_odd_archives(spark, tmp_path):
    """A length that can't be read ends its record at the next one's first line; long headers and well packed payloads are read in parts."""
    import gzip

    record = lambda n, body, length=None, more="": f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{n}>\r\n{more}Content-Length: {length or len(body)}\r\n\r\n{body}\r\n\r\n".encode()
    data = record(1, "lost", "four") + record(2, "x" * 9_000_000) + record(3, "end", more=f"X-Long: {'y' * 3_000_000}\r\n") + record(4, "last")
    (tmp_path / "plain").mkdir()
    (tmp_path / "packed").mkdir()
    (tmp_path / "plain" / "a.warc").write_bytes(data)
    (tmp_path / "packed" / "a.warc.gz").write_bytes(gzip.compress(data))
    spark.dataSource.register(warc.WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for folder in ("plain", "packed"):
        rows = spark.read.format("warc").load(f"file://{tmp_path}/{folder}").select("record_id", "payload_bytes", F.length("payload").alias("n")).collect()
        assert [(r["record_id"][-2:-1], r["payload_bytes"], r["n"]) for r in rows if r["record_id"][-2:-1] in "24"] == [("2", 9_000_000, 9_000_000), ("4", 4, 4)]


def http_record(n, body, named=None, kind="response"):
    head = f"HTTP/1.1 200 OK\r\n{'' if named is None else f'Content-Length: {named}' + chr(13) + chr(10)}\r\n".encode()
    block = head + body
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{n}>\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_http_lengths(spark, tmp_path):
    """What the block holds counts, whatever the HTTP head says; of a revisit, which leaves its payload out, what it says."""
    (tmp_path / "a.warc").write_bytes(http_record(1, b"hello", "abc") + http_record(2, b"hello") + http_record(3, b"hello", 999) + http_record(4, b"hello", 5) + http_record(5, b"", 77, "revisit") + http_record(6, b"", "x", "revisit"))
    spark.dataSource.register(warc.WarcSource)
    rows = spark.read.format("warc").load(f"file://{tmp_path}").select("record_id", "payload_bytes", "payload").collect()
    assert [(r["record_id"][-2], r["payload_bytes"], bytes(r["payload"])) for r in rows] == [*((str(k), 5, b"hello") for k in (1, 2, 3, 4)), ("5", 77, b""), ("6", 0, b"")]


def test_damaged_archives(spark, tmp_path):
    """Records of damaged members, and one that is cut off at the end, are left out; the others come."""
    import random

    r = random.Random(1)
    members = [gzip.compress(http_record(k, bytes(r.randrange(256) for _ in range(5000)))) for k in range(6)]
    members[1] = members[1][:2000] + b"\x00" * 200 + members[1][2200:]
    members[3] = members[3][:40] + b"\xff" * 20 + members[3][60:]
    (tmp_path / "g").mkdir()
    (tmp_path / "g/a.warc.gz").write_bytes(b"".join(members)[:-3000])
    plain = b"".join(http_record(k, b"x" * 3000) for k in range(3))
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.warc").write_bytes(plain[:-1000])
    spark.dataSource.register(warc.WarcSource)
    for columns in (["record_id", "payload"], ["record_id"], ["record_id", "payload_bytes"]):
        got = {f: sorted(x["record_id"][-2] for x in spark.read.format("warc").load(f"file://{tmp_path}/{f}").select(*columns).collect()) for f in "gp"}
        assert got == {"g": ["0", "2", "4"], "p": ["0", "1"]}
