"""Archives: round trips, filters and what readers may meet."""

import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import DATA
from debatelens.llm import warc
from debatelens.llm.common import stored


def brute(rows):
    """page_id -> what the archive must say, for (page_id, html) with distinct ids."""
    top = {}
    for i, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000:
            top[data] = max(top.get(data, i), i)
    out = {}
    for i, html in rows:
        data = (html or "").encode()
        owner = top.get(data, i)
        kind = "response" if owner == i else "revisit"
        out[i] = (len(data), hashlib.sha1(data).hexdigest(), kind, None if owner == i else owner)
    return out


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "html").collect()]
    got = entry.queries()["op8_warc_source"](spark, DATA).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == brute(rows)
    assert len(got) == len(rows)


def pages(spark):
    long = "é" * 700 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a/1", long), (2, "http://a/2", long), (3, "http://b/3\r\nx: y", "short"), (4, None, None), (5, "http://b/5", "short")]
    rows += [(6, "http://b/6", ""), (7, "http://c/7", "z" * 300000), (None, "http://c/8", "é" * 700), (2, "http://a/2", long)]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")


def archive(spark, tmp_path, df=None):
    path = str(tmp_path / "archive")
    warc.write_warc(warc.page_records(pages(spark) if df is None else df), path)
    return path


def test_round_trip_with_revisits_nulls_and_repeats(spark, tmp_path):
    path = archive(spark, tmp_path)
    records = warc.read_warc(spark, path).where("record_type <> 'warcinfo'").collect()
    got = sorted(((r.record_id, r.record_type, r.refers_to, r.payload_bytes) for r in records), key=repr)
    long = len("é".encode()) * 700 + 14
    two = "<urn:page:2>"
    want = [("<urn:page:1>", "revisit", two, long), (two, "response", None, long), (two, "response", None, long)]
    want += [("<urn:page:3>", "response", None, 5), ("<urn:page:4>", "response", None, 0), ("<urn:page:5>", "response", None, 5)]
    want += [("<urn:page:6>", "response", None, 0), ("<urn:page:7>", "response", None, 300000), ("<urn:page:none>", "response", None, 1400)]
    assert got == sorted(want, key=repr)
    body = {r.record_id: bytes(r.payload) for r in records if r.record_type == "response"}
    assert body["<urn:page:7>"] == b"z" * 300000 and body[two].decode().endswith("WARC/1.1\r\n")
    assert all(hashlib.sha1(b).hexdigest() == r.payload_digest[5:] for r in records for b in [bytes(r.payload)] if r.record_type == "response")
    uri = {r.record_id: r.target_uri for r in records}
    assert uri["<urn:page:3>"] == "http://b/3%0D%0Ax: y" and uri["<urn:page:4>"] is None


def test_filters_reach_the_scan(spark, tmp_path):
    path = archive(spark, tmp_path)
    df = warc.read_warc(spark, path, ["record_id", "record_type", "target_uri"])
    some = df.where(F.col("record_type").isin("response", "revisit") & F.col("target_uri").startswith("http://a/"))
    assert sorted(r.record_id for r in some.collect()) == ["<urn:page:1>", "<urn:page:2>", "<urn:page:2>"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", ""), plan
    one = warc.read_warc(spark, path).where("record_type = 'revisit'").collect()
    assert [(r.record_id, r.payload_bytes, bytes(r.payload)) for r in one] == [("<urn:page:1>", 1414, b"")]


def test_reader_stops_unpacking_at_the_headers(tmp_path):
    import io

    block = b"HTTP/1.1 200 OK\r\nContent-Length: 900000\r\n\r\n" + bytes(i * 7 % 251 for i in range(900000))
    made = warc.record({"WARC-Type": "response", "Content-Type": "application/http"}, block)
    for data, most in ((warc.member(made) * 3, 40000), (made * 3, 40000), (gzip.compress(made) * 3, None)):
        seen = []

        class File(io.BytesIO):
            def readinto(self, b):
                n = super().readinto(b)
                seen.append(n)
                return n

        file = io.BufferedReader(File(data), 8192)
        found = list(warc.read_records(file, lambda h: True, False, True))
        assert [size for _, size, _ in found] == [900000] * 3
        assert most is None or sum(seen) < 3 * most
        again = list(warc.read_records(io.BufferedReader(io.BytesIO(data)), lambda h: True, True, True))
        assert all(body == block[-900000:] for _, _, body in again)


def test_empty_table_unknown_column_and_leftovers(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    path = archive(spark, tmp_path, none)
    df = warc.read_warc(spark, path, ["record_id", "record_type"]).where("record_type = 'response'")
    assert df.count() == 0
    (tmp_path / "archive" / "_temporary-x").mkdir()
    (tmp_path / "archive" / "_temporary-x" / "part.warc.gz").write_bytes(b"broken")
    assert df.count() == 0
    assert not [p for p in (tmp_path / "archive").glob("_temporary*") if p.name != "_temporary-x"]
    with pytest.raises(Exception, match="no"):
        spark.read.format("warc").schema("wrong string").load(path).count()
    assert stored(df, "w").count() == 0


def http(body, length=None, end=b"\r\n\r\n"):
    stated = len(body) if length is None else length
    return b"HTTP/1.1 200 OK\r\nContent-Length: " + str(stated).encode() + end + body


def records(data, payload=True):
    file = io.BufferedReader(io.BytesIO(data), 64)
    found = warc.read_records(file, lambda h: h.get("warc-type") != "warcinfo", payload, True)
    return [(h["warc-record-id"], size, body) for h, size, body in found]


def made(name, block, kind="response"):
    return warc.record({"WARC-Type": kind, "WARC-Record-ID": name, "Content-Type": "application/http"}, block)


def test_archive_in_one_gzip_stream():
    bodies = [b"one", b"", b"x" * 100_000, b"WARC/1.1\r\n\r\n", b"last"]
    plain = made("info", b"a: b", "warcinfo") + b"".join(made(str(i), http(b)) for i, b in enumerate(bodies))
    want = [(str(i), len(b), b) for i, b in enumerate(bodies)]
    cut = plain.index(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: 3")
    for data in (plain, gzip.compress(plain), warc.member(plain), gzip.compress(plain[:cut]) + gzip.compress(plain[cut:]),
                 warc.member(plain[:cut]) + gzip.compress(plain[cut:]), plain[:cut] + gzip.compress(plain[cut:])):
        assert records(data) == want
        assert records(data, payload=False) == [(i, n, None) for i, n, _ in want]


def test_lengths_that_are_wrong_or_no_numbers():
    for stated in ("x", "", "-3", "999", "2", "٣", "1e3"):
        data = made("a", http(b"abc", stated)) + made("b", http(b"", "700" if stated == "999" else stated), "revisit") + made("c", http(b"z"))
        later = 700 if stated == "999" else 2 if stated == "2" else 0
        for packed in (data, gzip.compress(data)):
            assert records(packed) == [("a", 3, b"abc"), ("b", later, b""), ("c", 1, b"z")]


def test_records_that_are_malformed():
    good = made("good", http(b"body"))
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: bad\r\n"
    for bad in (head + b"\r\nsome\r\n\r\nblock\r\n\r\n", head + b"Content-Length: ten\r\n\r\n0123456789\r\n\r\n"):
        for data in (bad + good, gzip.compress(bad + good), gzip.compress(bad) + warc.member(good)):
            assert records(data) == [("bad", None, None), ("good", 4, b"body")]
    open_end = made("open", http(b"no end of headers", end=b"\r\n"))
    assert records(open_end + good) == [("open", len(http(b"no end of headers", end=b"\r\n")), http(b"no end of headers", end=b"\r\n")), ("good", 4, b"body")]
    whole = made("cut", http(b"0123456789"))
    ((name, size, body),) = records(whole[:-8])
    assert (name, body) == ("cut", b"012345") and size == 10
    assert records(b"") == [] and records(b"junk\r\n\r\n" + good) == [("good", 4, b"body")]


def test_one_stream_archive_through_the_source(spark, tmp_path):
    (tmp_path / "a").mkdir()
    plain = b"".join(made(f"<{i}>", http(b"x" * i, "x")) for i in range(40))
    (tmp_path / "a" / "one.warc.gz").write_bytes(gzip.compress(plain))
    rows = warc.read_warc(spark, str(tmp_path / "a"), ["record_id", "payload_bytes"]).collect()
    assert {r.record_id: r.payload_bytes for r in rows} == {f"<{i}>": i for i in range(40)}
