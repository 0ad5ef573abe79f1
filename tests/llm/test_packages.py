"""Archive packages that this code has not written, true index lines, and reading by many tasks."""

from __future__ import annotations

import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tillsight.llm import warc


def foreign_record(n: int, kind: str, body: bytes, told: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + (body if kind == "response" else b"")
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{n}>", f"WARC-Target-URI: http://a.b/{n}", f"Content-Length: {len(http)}"]
    if told:
        lines.append(f"WARC-Payload-Digest: sha1:{warc.payload_digest(body)}")
    if kind == "revisit":
        lines.append("WARC-Refers-To: <urn:uuid:0>")
    return b"WARC/1.0\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + http + b"\r\n\r\n"


@pytest.mark.parametrize("packed", [False, True])
def test_a_package_of_another_writer(spark, tmp_path, packed):
    bodies = [b"first", b"<p>second</p>" * 100, b""]
    raw, lines, at = b"", ["!meta {}"], 0
    for n, (kind, body) in enumerate([*(("response", b) for b in bodies), ("revisit", bodies[0])]):
        part = gzip.compress(foreign_record(n, kind, body, told=n != 1))
        entry = {"url": f"http://a.b/{n}", "offset": at, "length": len(part), "filename": "data.warc.gz"}
        lines.append(f"b,a)/{n} 20210101000000 {json.dumps(entry)}")
        raw, at = raw + part, at + len(part)
    index = "\n".join(lines).encode()
    with zipfile.ZipFile(tmp_path / "x.wacz", "w", zipfile.ZIP_STORED) as z:
        z.writestr("pages/pages.jsonl", '{"format": "json-pages-1.0"}', zipfile.ZIP_DEFLATED)  # not needed, may be packed
        z.writestr("archive/data.warc.gz", raw)
        z.writestr("indexes/index.cdx.gz" if packed else "indexes/index.cdxj", gzip.compress(index) if packed else index)
        z.writestr("datapackage.json", "{}")
    got = warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/x.wacz",)], "archive string")).orderBy("page").collect()
    assert [(r["page"], r["url"], r["record_type"], r["refers_to"]) for r in got] == [
        (f"urn:uuid:{n}", f"http://a.b/{n}", "revisit" if n == 3 else "response", "urn:uuid:0" if n == 3 else None) for n in range(4)
    ]
    assert [bytes(r["payload"]) for r in got[:3]] == bodies and got[3]["payload"] is None
    assert [r["payload_digest"] for r in got] == [warc.payload_digest(b) for b in (*bodies, bodies[0])]
    assert [r["payload_bytes"] for r in got] == [len(b) for b in bodies] + [None]


def test_index_lines_are_sorted_and_name_the_records(spark, tmp_path):
    rows = [(i, u, f"body {i}") for i, u in enumerate(["https://B.example.org:8080/x y?q=1", "http://a.example.org", "no address", None, "http://[bad"])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    archive = warc.write_archives(warc.decide_records(pages), f"file://{tmp_path}/a").first()["archive"]
    with zipfile.ZipFile(archive.removeprefix("file://")) as z:
        lines = z.read(warc.INDEX).decode().splitlines()
        assert json.loads(z.read("datapackage.json"))["resources"] == [{"path": warc.INDEX}]
        assert lines == sorted(lines) and len(lines) == 5
        for line in lines:
            key, time, entry = line.split(" ", 2)
            entry = json.loads(entry)
            raw = z.read(f"archive/{entry['filename']}")[int(entry["offset"]) :][: int(entry["length"])]
            head, http, body = warc.parse_record(gzip.decompress(raw))
            assert time == "20200101000000" and key == warc.sort_key(entry["url"]) and head["warc-target-uri"] == entry["url"]
            assert entry["digest"] == f"sha1:{warc.payload_digest(body)}" and http["content-type"].startswith(entry["mime"])
    assert warc.sort_key("https://B.example.org:8080/x y?q=1") == "org,example,b)/x%20y?q=1"
    assert warc.sort_key("") == "-" and warc.sort_key("no address") == "no%20address"


def test_archives_are_read_by_as_many_tasks_as_their_bytes_ask_for(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "TASK_BYTES", 20_000)
    monkeypatch.setattr(warc, "UNIT_RECORDS", 20)
    pages = spark.range(1000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.sha2(F.col("id").cast("string"), 512).alias("html"))
    archives = warc.write_archives(warc.decide_records(pages), f"file://{tmp_path}/a")
    got = warc.read_archives(archives).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(got) >= 8 and sum(r["count"] for r in got) == 1000 and max(r["count"] for r in got) < 500
