"""WARC archives: writing, reading, and resolving records of equal payload to revisits.

Archives are WARC/1.0 files of gzip members, written by Spark's text sink: each record is a member of its
own, and the two CRLF that end it are the next one, of fixed bytes, which serve as the sink's line
separator. ``zcat`` gives byte for byte what the standard asks for, and a reader can begin at any record. Spark's
text source reads an archive by that separator, so files are split among tasks and a task holds
one record at a time, whatever the size of a file. The separator is no valid UTF-8, so neither
text nor what deflate keeps of it literally can hold it. Inside a record, reading goes by Content-Length.
Payloads stay compressed wherever rows are shuffled or joined; each step unpacks them in one pass at most.

deduplicate(): headers alone are shuffled by payload digest and length; of equal payloads of
at least ``least`` bytes the record of the largest page_id stays a response, the others become
revisits; records are joined to that decision and written anew with fresh headers. Of a group
with a third of all records only (digest, page_id) meet, and those are combined before the
shuffle. The join sides that list revisits or their originals are broadcast up to BROADCAST_ROWS rows
and BROADCAST_BYTES of text, counted first, and shuffled beyond, where adaptive execution splits hot ones.

Edge cases: null html is an empty payload; a null url is written as ``urn:page:<page_id>``; blanks
and control characters in an url are percent-encoded in the header, so none can end it. Rows that
repeat a page_id are records of their own (a record's id is drawn at random when it is written);
with equal payloads one of them is the response and the others refer to its page_id. A null page_id is written as an empty field
and read back as null; it is never preferred as the response. An empty table gives an empty
archive and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import new_path, remove, stored

LEAST_BYTES = 1000
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 50_000_000
BATCH_BYTES = 8 << 20
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
HEADER = "record_id string, page_id long, uri string, record_type string, payload_digest string, payload_bytes long, refers_to_id string"


def record(kind: str, record_id: str, page_id: int | None, uri: str, digest: str, payload: bytes | memoryview, original: tuple[str, str] | None = None) -> bytes:
    """A whole record but for its end; original: (record id, uri) of what a revisit refers to."""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Page-ID", "" if page_id is None else page_id)]
    if original:
        fields += [("WARC-Refers-To", f"<{original[0]}>"), ("WARC-Refers-To-Target-URI", original[1]), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(HTTP_HEAD) + len(payload))]
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n" + HTTP_HEAD
    return head.encode() + bytes(payload)


def _member(data: bytes, level: int = LEVEL) -> bytes:
    """data as one gzip member without name and time."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


#: The end of every record as a member of its own: stored without compression, the same bytes everywhere.
_HEAD = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff"
END = _HEAD + b"\x01\x04\x00\xfb\xff\r\n\r\n" + zlib.crc32(b"\r\n\r\n").to_bytes(4, "little") + (4).to_bytes(4, "little")
_BY_END = {"lineSep": END.decode("latin-1"), "encoding": "ISO-8859-1"}


def _in_batches(rows: Iterator[tuple[int, list]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows, each with its bytes, as batches of about BATCH_BYTES."""
    held, size = [], 0
    for n, row in rows:
        held.append(row)
        size += n
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _write(members: DataFrame, path: str) -> None:
    """members(value), binary."""
    members.select(F.col("value").cast("string")).write.options(**_BY_END, compression="none").text(path)


_PACKED = pa.schema([("value", pa.binary())])


def write_archive(pages: DataFrame, path: str) -> None:
    """A response record for each row of pages(page_id, url, html)."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def members() -> Iterator[tuple[int, dict]]:
            for b in batches:
                for page, url, html, uuid in zip(*(b.column(n) for n in ("page_id", "url", "html", "uuid")), strict=True):
                    page, url, payload = page.as_py(), url.as_py(), html.as_buffer() if html.is_valid else b""
                    uri = f"urn:page:{'' if page is None else page}" if url is None else re.sub(r"[\x00-\x20\x7f]", "%20", url)
                    member = _member(record("response", f"urn:uuid:{uuid}", page, uri, hashlib.sha1(payload).hexdigest(), memoryview(payload)))
                    yield len(member), {"value": member}

        yield from _in_batches(members(), _PACKED)

    rows = pages.select(F.col("page_id").cast("long"), "url", "html", F.uuid().alias("uuid"))
    _write(rows.mapInArrow(packed, "value binary"), path)


def parse(data: bytes) -> Iterator[tuple[int, dict[str, str], memoryview]]:
    """(offset, header fields, block) of each record of an uncompressed archive."""
    at, whole = 0, memoryview(data)
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if version != "WARC/1.0":
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines)
        length = int(fields["Content-Length"])
        yield at, fields, whole[end + 4 : end + 4 + length]
        at = end + 4 + length + 4


def _members(spark: SparkSession, path: str) -> DataFrame:
    """(value, key): packed records, known by the digest of their bytes, as no two have the same record id."""
    value = F.col("value").cast("binary")
    return spark.read.options(**_BY_END).text(path).select(value.alias("value"), F.sha1(value).alias("key"))


def _unpacked(member: pa.Scalar) -> tuple[dict[str, str], memoryview]:
    """(header fields, payload) of a packed record; a payload that differs from its digest is an error."""
    ((_, fields, block),) = parse(zlib.decompress(member.as_buffer(), 31))
    payload = block[bytes(block[:4096]).index(b"\r\n\r\n") + 4 :]
    if fields["WARC-Type"] == "response" and f"sha1:{hashlib.sha1(payload).hexdigest()}" != fields["WARC-Payload-Digest"]:
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} differs from its digest")
    return fields, payload


def _headers(spark: SparkSession, path: str) -> DataFrame:
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, dict]]:
            for b in batches:
                for member, key in zip(b.column("value"), b.column("key"), strict=True):
                    fields, payload = _unpacked(member)
                    full = fields["WARC-Type"] == "response"
                    yield 500, {
                        "record_id": fields["WARC-Record-ID"][1:-1], "page_id": int(fields["Page-ID"]) if fields["Page-ID"] else None, "uri": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"],
                        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "payload_bytes": len(payload) if full else None, "refers_to_id": None if full else fields["WARC-Refers-To"][1:-1], "key": key.as_py(),
                    }

        yield from _in_batches(rows(), pa.schema([(n, {"string": pa.string(), "long": pa.int64()}[t]) for n, t in names]))

    names = [tuple(x.split()) for x in (HEADER + ", key string").split(", ")]
    return _members(spark, path).mapInArrow(records, HEADER + ", key string")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """The columns of HEADER for each record of an archive, without payloads. Digest and length of
    responses are taken from the payload itself."""
    return _headers(spark, path).drop("key")


def _sized(df: DataFrame, text: str) -> DataFrame:
    """df, stored, for broadcast if its rows and the bytes of its longest column, text, allow it."""
    df = stored(df, "warc-side")
    n, size = df.select(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def deduplicate(spark: SparkSession, source: str, target: str, least: int = LEAST_BYTES) -> None:
    """Write the archive at source anew at target, with revisits for repeated payloads."""
    headers = stored(_headers(spark, source), "warc-headers")
    first = F.max(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "record_id", "uri")).alias("o")
    originals = headers.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(first, F.count("*").alias("n")).where("n > 1")
    originals = originals.select("payload_digest", "payload_bytes", F.col("o.record_id").alias("o_id"), F.col("o.uri").alias("o_uri"))
    revisits = headers.join(_sized(originals, "o_uri"), ["payload_digest", "payload_bytes"]).where("record_id != o_id").select("key", "o_id", "o_uri")

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def members() -> Iterator[tuple[int, dict]]:
            for b in batches:
                for member, o_id, o_uri in zip(b.column("value"), b.column("o_id").to_pylist(), b.column("o_uri").to_pylist(), strict=True):
                    fields, payload = _unpacked(member)
                    page = int(fields["Page-ID"]) if fields["Page-ID"] else None
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    told = fresh_id(fields["WARC-Record-ID"][1:-1]), page, fields["WARC-Target-URI"], digest
                    packed = _member(record("revisit", *told, b"", (fresh_id(o_id), o_uri)) if o_id else record("response", *told, payload))
                    yield len(packed), {"value": packed}

        yield from _in_batches(members(), _PACKED)

    marked = _members(spark, source).join(_sized(revisits, "o_uri"), "key", "left").select("value", "o_id", "o_uri")
    _write(marked.mapInArrow(rewritten, "value binary"), target)


def fresh_id(record_id: str) -> str:
    """The id that a record gets in the new archive, from its old one."""
    h = hashlib.md5(record_id.encode()).hexdigest()
    return f"urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


def resolve(headers: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of an archive's records;
    a revisit gets length and page of the response that it refers to."""
    revisits = headers.where("record_type = 'revisit'")
    wanted = revisits.select(F.col("refers_to_id").alias("record_id")).distinct()
    originals = headers.where("record_type = 'response'").join(_sized(wanted, "record_id"), "record_id", "left_semi")
    originals = originals.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full"))
    found = revisits.join(_sized(originals, "refers_to_id"), "refers_to_id", "left").select("page_id", F.col("full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    own = headers.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(found)


def archive_pages(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Archive pages, deduplicate the archive and give what resolve() reads back from it.

    The first archive is removed once the deduplicated one, kept in the shared folder, is written.
    """
    spark = pages.sparkSession
    raw, final = new_path(spark, "warc-raw"), new_path(spark, "warc-deduplicated")
    write_archive(pages, raw)
    deduplicate(spark, raw, final, least)
    remove(spark, raw)
    return resolve(stored(read_headers(spark, final), "warc-records"))
