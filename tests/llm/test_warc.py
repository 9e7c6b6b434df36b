"""ARC and WARC: versions, faults, separators inside payloads, revisits."""

from __future__ import annotations

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from cisloom.llm import warc

SCHEMA = "page_id bigint, url string, html string, id string, type string, of string"
INSIDE = "a\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\nWARC/1.1\r\nb"
PAGES = [
    (1, "http://a.example/x y", "<p>one</p>"), (2, None, "<p>one</p>"), (9, "http://b.example/", "<p>one</p>"), (3, "", None), (4, "u:\n1", ""), (5, "http://c.example/", INSIDE), (6, "http://c.example/", "end\r\n\r\n"),
    (7, "http://d.example/", "\r\n\r\n"), (8, "http://d.example/", "é日🙂\x00\x1f" * 500), (10, "http://d.example/", "x" * 300_000), (None, "http://e.example/", "<p>one</p>"), (None, None, None), (-4, "http://e.example/", "alone"), (11, "http://f/", "same"), (11, "http://f/", "same"),
]


def b32(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA)


@pytest.mark.parametrize("arc_bytes", [1 << 22, 500])
def test_pages_come_back(spark, tmp_path, monkeypatch, arc_bytes):
    path = str(tmp_path / "warc")
    monkeypatch.setattr(warc, "ARC_BYTES", arc_bytes)
    warc.pages_to_warc(pages(spark, PAGES).repartition(3), path)
    got = warc.read_warc(spark, path).withColumn("page", warc.page_of()).collect()
    assert {r["fault"] for r in got} == {""} and {r["type"] for r in got} == {"warcinfo", "response", "revisit"}
    ids = {r["id"]: r for r in got}
    assert len(ids) == len(got)
    rows = [r for r in got if r["type"] != "warcinfo"]
    want = sorted(((p is None, p or 0, (h or "").encode()) for p, _, h in PAGES))
    assert sorted((r["page"] is None, r["page"] or 0, bytes((ids[r["refers_to"]] if r["refers_to"] else r)["payload"])) for r in rows) == want
    for r in rows:
        body = bytes((ids[r["refers_to"]] if r["refers_to"] else r)["payload"])
        same = [p for p, _, h in PAGES if (h or "").encode() == body]
        assert r["payload_digest"] == b32(body)
        if r["refers_to"]:
            assert ids[r["refers_to"]]["type"] == "response" and r["payload"] == b"" and ids[r["refers_to"]]["page"] == max((p for p in same if p is not None), default=None)
    assert sum(r["type"] == "response" for r in rows) == len({h or "" for _, _, h in PAGES})


def test_small_payloads_are_all_answers(spark, tmp_path):
    path = str(tmp_path / "warc")
    warc.pages_to_warc(pages(spark, PAGES), path, least=5)
    got = warc.read_warc(spark, path).where("type = 'revisit'").withColumn("page", warc.page_of()).collect()
    assert sorted((r["page"] is None, r["page"] or 0) for r in got) == [(False, 1), (False, 2), (True, 0)]


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "warc")
    warc.pages_to_warc(pages(spark, []), path)
    assert warc.read_warc(spark, path).count() == 0


def arc(version, records, head=True, fields=None):
    block = f"{version} 0 Crawler\n{fields or warc.ARC_FIELDS[version]}\n\n".encode()
    tail = " 200 - - 0 x.arc" if version == 2 else ""
    out = f"filedesc://x.arc 0.0.0.0 19990102030405 text/plain{tail} {len(block)}\n".encode() + block + b"\n" if head else b""
    for url, date, mime, body, declared in records:
        out += f"{url} 10.0.0.1 {date} {mime}{tail} {len(body) if declared is None else declared}\n".encode() + body + b"\n"
    return out


HTTP = b"HTTP/1.0 200 OK\nServer: s\n\nhttp://no.example 1.1.1.1 is no header\nbody"
ROWS = [("http://a.example/with space", "19990102030405", "text/html", HTTP, None), ("dns:a.example", "199901020304", "text/dns", b"19990102\na.example. 1 IN A 1.2.3.4\n", None), ("http://b.example/", "19990203", "image/gif", b"GIF89a\x00\xff", None)]


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("packed", [False, True])
def test_arc_versions(spark, tmp_path, version, packed):
    data = arc(version, ROWS)
    if packed:  # one member for the version block, one for the rest
        at = data.index(b"http://a.example/with")
        data = gzip.compress(data[:at]) + gzip.compress(data[at:])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / f"v{version}.arc").write_bytes(data)
    files = spark.read.format("binaryFile").load(str(tmp_path / "in"))
    got = {r["uri"]: r for r in warc.convert(files).collect()}
    assert [got[u[0]]["type"] for u in ROWS] == ["response", "resource", "resource"] and got["filedesc://x.arc"]["type"] == "warcinfo"
    a, dns, gif = (got[u[0]] for u in ROWS)
    assert a["date"] == "1999-01-02T03:04:05Z" and dns["date"] == "1999-01-02T03:04:00Z" and gif["date"] == "1999-02-03T00:00:00Z"
    assert a["payload_digest"] == b32(HTTP[HTTP.index(b"\n\n") + 2 :]) and a["block_digest"] == b32(HTTP) and a["ip"] == "10.0.0.1" and gif["mime"] == "image/gif"
    assert {r["fault"] for r in got.values()} == {""} and {r["id"] for r in warc.convert(files).collect()} == {r["id"] for r in got.values()}


def test_arc_faults():
    wrong = arc(1, [ROWS[0], ("http://c.example/", "20000101000000", "text/html", b"HTTP/1.0 200 OK\n\nshort", 9), ("http://d.example/", "20000101000000", "text/html", b"tail", 900), ROWS[2]])
    got = [(r.head["URL"], r.fault, r.block) for r in warc.ArcReader(wrong)]
    assert [x[1] for x in got] == ["", "", "length", "length", ""]
    assert got[2][2] == b"HTTP/1.0 200 OK\n\nshort" and got[3][2] == b"tail" and got[4][2] == b"GIF89a\x00\xff"
    cut = arc(2, ROWS)[:-6]
    assert [r.fault for r in warc.ArcReader(cut)] == ["", "", "", "cut short"]
    assert list(warc.ArcReader(b"no header\nat all\n")) == [] and list(warc.ArcReader(b"")) == []
    assert [r.head["URL"] for r in warc.ArcReader(arc(1, ROWS, head=False))] == [r[0] for r in ROWS]
    own = "URL Archive-date Archive-length"
    odd = arc(1, [], fields=own) + b"http://z.example/ 20010101 4\nzzzz\n"
    assert [(r.head["URL"], r.block) for r in warc.ArcReader(odd)][1] == ("http://z.example/", b"zzzz")


def test_bad_gzip_member():
    assert warc.inflate(gzip.compress(b"one") + b"\x1f\x8bnonsense") == b"one" and warc.inflate(b"plain") == b"plain"


def test_uncompressed_files_of_others_in_many_splits(spark, tmp_path):
    def record(i, body, version="1.0", extra=""):
        return f"WARC/{version}\r\nwarc-type: response\r\nWARC-Record-ID: <{i}>\r\n{extra}Content-Type: application/http;\r\n msgtype=response\r\ncontent-length: {len(body) + 17}\r\n\r\nHTTP/1.1 200 OK\r\n".encode() + body + b"\r\n\r\n"

    bodies = [b"\r\n" + INSIDE.encode() * k + b"\xff\x00" * (k % 5) for k in range(60)]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc").write_bytes(b"".join(record(i, b, "1.1" if i % 2 else "1.0") for i, b in enumerate(bodies)))
    (tmp_path / "w" / "b.warc").write_bytes(record("z", b"\r\nfine", extra="WARC-Payload-Digest: sha1:" + b32(b"other") + "\r\n") + record("cut", b"\r\nlost")[:-9])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        read = warc.read_warc(spark, str(tmp_path / "w"), split=True)
        assert spark.read.option("lineSep", warc.BETWEEN).text(str(tmp_path / "w")).rdd.getNumPartitions() > 5
        got = {r["id"]: r for r in read.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [bytes(got[f"<{i}>"]["payload"]) for i in range(60)] == [b[2:] for b in bodies]
    assert got["<z>"]["fault"] == "digest" and got["<cut>"]["fault"] == "cut short" and len(got) == 62
    assert got["<0>"]["mime"] == "application/http; msgtype=response"


def test_query(spark, small):
    rows = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "html").collect()
    got = {r["page_id"]: tuple(r)[1:] for r in warc.op11_warc(spark, small).collect()}
    last = {}
    for i, h in rows:
        last[h or ""] = max(i, last.get(h or "", i))
    assert got == {i: (len((h or "").encode()), b32((h or "").encode()), "response" if last[h or ""] == i else "revisit", None if last[h or ""] == i else last[h or ""]) for i, h in rows}


def test_query_on_copies(spark, tmp_path):
    rows = [(i, "u", f"<p>{i % 7 if i % 3 else 'hot'}</p>" if i % 11 else None) for i in range(400)]
    pages(spark, rows).select("page_id", "url", "html").write.parquet(str(tmp_path / "pages.parquet"))
    got = warc.op11_warc(spark, str(tmp_path))
    last = {h or "": i for i, _, h in rows}
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in got.collect()} == {(i, "response" if last[h or ""] == i else "revisit", None if last[h or ""] == i else last[h or ""]) for i, _, h in rows}
    assert got.where(F.col("payload_bytes").isNull()).count() == 0
