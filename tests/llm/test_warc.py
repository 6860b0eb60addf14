import base64
import hashlib

import pytest

from pixelweft.llm import warc

PAGES = "page_id long, url string, html string, record string, chunk int, sha1 string"


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark, tmp_path):
    long = "é😀<p>\r\n\r\nWARC/1.1\r\n" * 5000
    rows = [(5, "http://a/ b\r\nX: y", "same", "", 0, ""), (2, "http://b", "same", "", 0, ""), (9, None, long, "", 0, ""), (3, "http://c", None, "", 0, ""), (4, "http://d", "", "", 0, ""), (8, "u", long, "", 0, ""), (None, "u", "alone", "", 0, ""), (2, "http://b", "same", "", 0, "")]
    pages = spark.createDataFrame(rows, PAGES)
    path = warc.write_archives(pages, str(tmp_path / "w"), chunk=1000)
    table = spark.read.parquet(path)
    assert table.selectExpr("max(length(data))").first()[0] < 3000 and table.where("chunks > 100").count() == 1 and table.where("chunks = -1").count() > 100
    got = sorted(warc.read_archives(spark, path).collect(), key=lambda r: (r.page_id is None, r.page_id))
    kinds = [(r.page_id, r.record_type, r.refers_to) for r in got]
    assert kinds == [(2, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3), (5, "revisit", 2), (8, "response", None), (9, "revisit", 8), (None, "response", None)]
    by = {r[0]: r[2] for r in rows}
    assert all((r.payload_bytes, r.payload_digest) == (len((by[r.page_id] or "").encode()), b32(by[r.page_id])) for r in got)
    files = tmp_path / "files"
    files.mkdir()
    made = warc.export_files(spark, path, str(files)).collect()
    data = b"".join(p.read_bytes() for p in files.iterdir())
    assert sum(r.bytes for r in made) == len(data) and data.startswith(b"WARC/1.1\r\n")
    assert data.count(b"WARC-Type: ") == len(rows)
    assert all(f.name.startswith("part-") for f in files.iterdir())
    # a revisit holds no payload
    assert data.count("é😀".encode()) == 5000


def test_small_payloads_and_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    path = warc.write_archives(pages, str(tmp_path / "w"), least_bytes=3)
    assert sorted((r.page_id, r.refers_to) for r in warc.read_archives(spark, path).where("record_type = 'revisit'").collect()) == [(4, 3)]
    none = warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_archives(spark, none).count() == 0


def test_chunks_that_are_lost_are_noticed(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc" * 1000), (2, "u", "xyz" * 1000)], "page_id long, url string, html string")
    path = warc.write_archives(pages, str(tmp_path / "w"), chunk=100)
    table = spark.read.parquet(path)
    assert table.selectExpr("max(length(data))").first()[0] < 700 and table.count() == 62
    for lost in ("chunk = 7", "chunk = 30", "chunk = 0"):
        table.where(f"not ({lost})").write.parquet(str(tmp_path / lost))
        with pytest.raises(Exception, match="missing|cut short"):
            warc.read_archives(spark, str(tmp_path / lost)).collect()


def test_many_equal_payloads_are_joined_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "if_small", lambda df: df)
    pages = spark.createDataFrame([(i, "u", f"page {i % 5}") for i in range(60)], "page_id long, url string, html string")
    data = [bytes(r.data) for r in warc.records(pages).select("data").collect()]
    assert sum(b"WARC-Type: revisit" in d for d in data) == 55
