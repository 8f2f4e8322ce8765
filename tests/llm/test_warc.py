import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from texloom.llm import warc
from texloom.llm.common import fresh_path

PAGES = [
    (1, "http://a/1", "same payload"),
    (2, "http://a/2\r\nX: y", "same payload"),
    (9, None, "same payload"),
    (3, "http://b", None),
    (4, "http://c", ""),
    (5, "http://d", "é" * 3000 + "\r\n\r\nWARC/1.1\r\n"),
    (6, "http://e", "other"),
    (6, "http://e", "other"),
    (None, "http://f", "null id"),
    (None, "http://g", "other"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def records(spark, pages, **more):
    manifest = warc.write_archives(warc.chunk_rows(pages, "page_id", "url", "html", **more), fresh_path(spark, "warc-test"))
    return manifest, warc.read_records(manifest, 1000).collect()


def test_round_trip(spark, pages):
    manifest, rows = records(spark, pages, chunk=100)
    assert len(rows) == len(PAGES) and all(r["digest_ok"] for r in rows)
    text = {p[0]: (p[2] or "").encode() for p in PAGES if p[0]}
    by = {}
    for r in rows:
        by.setdefault(r["record_id"], []).append(r)
    for name, raw in text.items():
        for r in by[str(name)]:
            assert r["payload_bytes"] == len(raw) and r["payload_digest"] == warc.base32_sha1(hashlib.sha1(raw).digest())
    kind = {k: (v[0]["record_type"], v[0]["refers_to"]) for k, v in by.items() if k}
    assert kind["1"] == kind["2"] == ("revisit", "9") and kind["9"] == ("response", None)
    assert kind["3"] == ("revisit", "4") and kind["4"] == ("response", None)
    assert [r["record_type"] for r in by["6"]] == ["response", "response"]
    assert {(r["record_type"], r["refers_to"]) for r in by[None]} == {("response", None), ("revisit", "6")}
    chunks = warc.read_chunks(manifest, 700).where("record_id = '5'").orderBy("chunk_no").collect()
    assert len(chunks) > 5 and b"".join(bytes(c["chunk"]) for c in chunks) == text[5]
    for i, c in enumerate(chunks):
        assert c["digest_so_far"] == warc.base32_sha1(hashlib.sha1(b"".join(bytes(x["chunk"]) for x in chunks[: i + 1])).digest())


def test_files_are_plain_warc(spark, pages):
    manifest, _ = records(spark, pages)
    raw = b"".join(gzip.open(r["path"].removeprefix("file://")).read() for r in manifest.collect())
    assert raw.count(b"WARC/1.1\r\nWARC-Type: ") == len(PAGES) and b"\nX: y" not in raw
    assert sum(r["records"] for r in manifest.collect()) == len(PAGES)


def test_short_payloads_never_revisit(spark, pages):
    _, rows = records(spark, pages, revisit_from=6)
    kinds = {(r["record_id"], r["record_type"]) for r in rows}
    assert ("3", "response") in kinds and ("1", "revisit") in kinds and (None, "revisit") not in kinds


def test_extra_columns_and_empty(spark, pages):
    more = pages.withColumn("sha1", F.lit("mine")).withColumn("keeper", F.lit(1))
    assert len(records(spark, more)[1]) == len(PAGES)
    assert records(spark, pages.limit(0))[1] == []


def test_payload_of_several_chunks_and_odd_names(spark):
    big = "".join(f"line {i} é\n" for i in range(230_000))
    rows = [("null", "http://a", "x"), (None, "http://b", "y"), ("a>b\r\nC: d %20", "http://c", big), ("z", "http://d", big), ("a", "http://e", big[:-1])]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    manifest = warc.write_archives(warc.chunk_rows(pages, "page_id", "url", "html"), fresh_path(spark, "warc-test"))
    found = {r["record_id"]: r for r in warc.read_records(manifest).collect()}
    assert set(found) == {r[0] for r in rows} and all(r["digest_ok"] for r in found.values())
    assert found["a>b\r\nC: d %20"]["refers_to"] == "z" and found["z"]["payload_bytes"] == len(big.encode()) > 2 * warc.CHUNK
    chunks = warc.read_chunks(manifest).where("record_id = 'z'").orderBy("chunk_no").collect()
    assert len(chunks) >= 3 and b"".join(bytes(c["chunk"]) for c in chunks).decode() == big


def test_no_array_of_chunks_is_built(spark, pages):
    """The plan cuts a chunk at a time: chunk numbers are exploded, not chunks."""
    plan = warc.chunk_rows(pages, "page_id", "url", "html")._jdf.queryExecution().executedPlan().toString()
    assert "explode(sequence" in plan and "transform(" not in plan
