import gzip
import hashlib
import random
from pathlib import Path

from lodestone.llm import warc

PAGES = "page_id long, url string, html string"


def expected(rows):
    top = {}
    for p, _, h in rows:
        top[h or ""] = max(p, top.get(h or "", -1))
    out = []
    for p, _, h in rows:
        body = (h or "").encode()
        again = len(body) >= 1000 and top[h or ""] != p
        out.append((p, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", top[h or ""] if again else None))
    return sorted(out)


def make():
    draw = random.Random(9)
    big = "é" * 500
    rows = [(k, f"http://h{k}.org/a b\r\nX: y", draw.choice([big, "x" * 999, "y" * 1000, "z\r\n\r\nWARC/1.0\r\n\r\n" * 90, "", "unique %d " % k * 200])) for k in range(120)]
    return rows + [(500, None, None), (501, "no scheme", "t" * 300_000), (502, "", "t" * 300_000)]


def test_roundtrip_and_revisits(spark):
    rows = make()
    pages = spark.createDataFrame([(*r, 1, "z") for r in rows], PAGES + ", payload int, file string")
    got = warc.archive_pages(pages.repartition(5))
    assert sorted(tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == expected(rows)


def test_skewed_joins_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 1)
    rows = make()
    assert sorted(tuple(r) for r in warc.archive_pages(spark.createDataFrame(rows, PAGES)).collect()) == expected(rows)


def test_repeated_rows_null_ids_and_empty(spark):
    body = "q" * 2000
    got = warc.archive_pages(spark.createDataFrame([(1, "u://a", body), (1, "u://a", body), (None, "u://b", body), (2, "u://c", body)], PAGES)).collect()
    assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in got) == [("1", "revisit", 2), ("1", "revisit", 2), ("2", "response", None), ("None", "revisit", 2)]
    assert warc.archive_pages(spark.createDataFrame([], PAGES)).count() == 0


def test_files_are_plain_warc(spark, tmp_path):
    rows = make()[:20]
    warc.write_archive(spark.createDataFrame(rows, PAGES).coalesce(1), f"file://{tmp_path}/a")
    data = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path, "a").glob("part-*"))
    records = list(warc.parse(data))
    assert len(records) == len(rows)
    for _, fields, block in records:
        head, _, payload = bytes(block).partition(b"\r\n\r\n")
        assert head.startswith(b"HTTP/1.1 200") and fields["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(payload).hexdigest()
        assert payload.decode() == dict((str(p), h or "") for p, _, h in rows)[fields["Page-ID"]]


def test_records_are_members_that_a_split_reader_finds(spark, tmp_path):
    """2,100 pages in one file, read in many splits; each record is a gzip member of its own."""
    rows = [(k % 700, f"u://{k}", f"page {k} " + "ab\u00e9 " * (k % 97)) for k in range(2100)]
    path = f"file://{tmp_path}/b"
    warc.write_archive(spark.createDataFrame(rows, PAGES).coalesce(1), path)
    (file,) = Path(tmp_path, "b").glob("part-*")
    members = file.read_bytes().split(warc.END)
    assert len(members) == 2101 and members[-1] == b"" and all(gzip.decompress(m).startswith(b"WARC/1.0") for m in members[:-1])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        headers = warc.read_headers(spark, path)
        assert headers.rdd.getNumPartitions() > 5
        got = headers.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == sorted((p, len(h.encode()), hashlib.sha1(h.encode()).hexdigest()) for p, _, h in rows)
    assert len({r["record_id"] for r in got}) == 2100


def test_long_urls_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_BYTES", 100)
    rows = [(k, "u://" + "x" * 200, "q" * 2000) for k in range(5)]
    assert sorted(tuple(r) for r in warc.archive_pages(spark.createDataFrame(rows, PAGES)).collect()) == expected(rows)
