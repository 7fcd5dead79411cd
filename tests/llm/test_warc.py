import hashlib
import io
import random
import zlib

import pyarrow as pa
import pytest

from voucherflow.llm import warc
from voucherflow.llm.common import new_path

DIGEST = "ab" * 32


def archive(n, seed=1):
    rng = random.Random(seed)
    out, at = b"", []
    for i in range(n):
        body = bytes(rng.randrange(256) for _ in range(rng.choice([0, 10, 3000, 40_000])))
        at.append(len(out))
        z = zlib.compressobj(rng.choice([0, 6]), zlib.DEFLATED, 31)
        out += z.compress(warc.record(i, f"http://x/{i}", body, hashlib.sha256(body).hexdigest(), None)) + z.flush()
    return out, at


@pytest.mark.parametrize("step", [700, 5_000, 60_000, 10**9])
def test_ranges_own_each_record_once(step):
    data, at = archive(40)
    source = pa.BufferReader(data)
    for start in range(0, len(data), step):
        end = min(start + step, len(data))
        got = [r["page_id"] for r in warc.read_range(source, start, end, len(data), ahead=2048)]
        assert got == [i for i, a in enumerate(at) if start <= a < end]


def test_magic_inside_a_payload_and_damage():
    body = b"x" * 500 + zlib.compress(b"WARC/1.1") + warc.MAGIC * 50
    z = zlib.compressobj(0, zlib.DEFLATED, 31)
    one = z.compress(warc.record(1, None, body, DIGEST, None)) + z.flush()
    data = one + one[: len(one) // 2]  # the second is cut off
    got = list(warc.read_range(pa.BufferReader(data), 0, len(data), len(data), ahead=10))
    assert [(r["page_id"], r["payload"], r["url"]) for r in got] == [(1, body, None)]
    assert list(warc.read_range(pa.BufferReader(data), 5, len(one), len(data))) == []
    assert list(warc.read_range(pa.BufferReader(b""), 0, 0, 0)) == []


def test_revisit_has_headers_but_no_payload():
    got = warc.parse(warc.record(9, "http://x/a b\r\nc", b"z" * 700, DIGEST, 3))
    assert (got["record_type"], got["refers_to"], got["payload_bytes"], got["payload"], got["payload_digest"]) == ("revisit", 3, 700, None, DIGEST)
    assert got["url"] == "http://x/a%20b%0D%0Ac"
    assert warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort") is None


def roundtrip(spark, pages, **kw):
    folder = new_path(spark, "warc-test")
    return warc.read_warc(spark, folder, warc.write_warc(pages, folder, **kw), range_bytes=3000)


def test_round_trip_and_revisits(spark):
    long, short = "Ä" * 60, "x" * 99
    rows = [(5, "u5", long), (3, "u3", long), (9, None, long), (None, "n", long), (3, "again", long), (7, "u7", short), (8, "u8", short), (1, "u1", None), (None, None, ""), (2, "u2", "y" * 300_000), (None, "n", "z" * 200), (None, "m", "z" * 200)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, `HTML` string")
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"], r["payload"] and bytes(r["payload"])) for r in roundtrip(spark, pages, archive_bytes=500).collect()), key=repr)
    b = long.encode()
    want = [(5, 120, "revisit", 3, None), (3, 120, "response", None, b), (3, 120, "response", None, b), (9, 120, "revisit", 3, None), (None, 120, "revisit", 3, None), (7, 99, "response", None, short.encode()), (8, 99, "response", None, short.encode()), (1, 0, "response", None, b""), (None, 0, "response", None, b""), (2, 300_000, "response", None, b"y" * 300_000), (None, 200, "response", None, b"z" * 200), (None, 200, "response", None, b"z" * 200)]
    assert got == sorted(want, key=repr)


def test_empty_table(spark):
    assert roundtrip(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_query_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.001/pages.parquet'")
    want = con.sql(warc.ORACLE).fetchall()
    assert sorted(map(tuple, warc.op2_warc_roundtrip(spark, "/root/testdata/sf0.001").collect())) == sorted(want)


def test_columns_named_like_the_operators_own(spark):
    rows = [(i, f"http://x/{i}", "y" * 200 if i < 3 else f"page {i}") for i in range(5)]
    names = "digest string, payload binary, first long, refers_to long, n int, offset double, record_type string, `PAGE_ID` string"
    clashing = spark.createDataFrame([(*r, "a", b"b", 3, 4, 5, 6.0, "r", "p") for r in rows], f"page_id long, url string, html string, {names}")
    plain = spark.createDataFrame(rows, "page_id long, url string, html string")
    a, b = (sorted((r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in roundtrip(spark, x).collect()) for x in (plain, clashing))
    assert a == b and [r[2:] for r in a[:3]] == [("response", None), ("revisit", 0), ("revisit", 0)]
