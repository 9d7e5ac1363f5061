"""Web archives: writing, reading, and assembling the records of a capture.

``write`` makes three records per page: the request, the response (or a revisit of an
earlier equal payload) and metadata. Request and metadata name the response in
WARC-Concurrent-To. Records are built by DataFrame functions and written by Spark's own
text writer, whose line separator is the end mark of a record, as gzip files below a
shared folder: task attempts are committed as for any table.

``read`` reads any gzip WARC files through Spark's text reader. Pieces between end marks
are put together again by the byte counts in the headers, one record in memory at a time,
so payloads may hold end marks themselves. ``captures`` joins the records through the
concurrent-to identifiers and gives one nested row per capture.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprep.operators.lookup import fits_broadcast

from .common import pick, small_batches, stored, work_folder

LINE = "\r\n"
END = LINE + LINE
#: Kinds of records that stand for a capture.
TOPS = ("response", "revisit", "resource")
#: Fixed values of the formats: profile of revisits, base32 digits.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: So many payloads with the most copies meet their rows by broadcast where the table of copies is large.
HEAVY = 1_000
#: Records per file.
PER_FILE = 1_000_000

RECORD = ("record_id string, type string, target_uri string, date string, concurrent_to array<string>, refers_to string, "
          "content_type string, http_status int, fields array<struct<name: string, value: string>>, payload_digest string, "
          "digest_ok boolean, payload_bytes long, payload binary")


def base32(digest: Column) -> Column:
    """40 hex digits as 32 base32 digits."""
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def first_copies(rows: DataFrame, least: int) -> DataFrame:
    """``rows`` (row, page, digest, bytes, ...) with ``first`` (page, row): the copy that the others of its digest repeat.

    Only digests that occur twice have an entry. A table of entries of checked size is broadcast; of a larger
    one the entries with the most copies are, and the other rows are shuffled.
    """
    place = F.struct(F.col("page").isNull().alias("none"), "page", "row")
    copies = stored(rows.filter(F.col("bytes") >= least).groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n"))
                    .filter("n > 1").select(F.col("digest").alias("copied"), "first", "n"), "copies")
    if fits_broadcast(copies, copies.columns):
        return rows.join(F.broadcast(copies.drop("n")), F.col("digest") == F.col("copied"), "left").drop("copied")
    heavy = stored(copies.orderBy(F.desc("n"), "copied").limit(HEAVY).drop("n"), "copies-heavy")
    met = rows.join(F.broadcast(heavy), F.col("digest") == F.col("copied"), "left")
    rest = met.filter("copied IS NULL").drop("copied", "first").join(copies.drop("n"), F.col("digest") == F.col("copied"), "left")
    return met.filter("copied IS NOT NULL").unionByName(rest).drop("copied")


def _record(kind: str, ident: Column, date: str, uri: Column, headers: list[tuple[str, Column]], content: str, block: Column) -> Column:
    """One record without its end mark."""
    lines = [F.lit(f"WARC/1.1{LINE}WARC-Type: {kind}{LINE}WARC-Record-ID: "), ident,
             F.lit(f"{LINE}WARC-Date: {date}{LINE}WARC-Target-URI: "), uri]
    for name, value in headers:
        lines += [F.lit(f"{LINE}{name}: "), value]
    return F.concat(*lines, F.lit(f"{LINE}Content-Type: {content}{LINE}Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def write(pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", html: str = "html",
          least: int = 0, date: str = "2000-01-01T00:00:00Z", per_file: int = PER_FILE) -> str:
    """Write three records per row of ``pages`` as gzip files; the folder.

    Of rows with equal payloads of ``least`` bytes or more that with the smallest key is the response, and the
    others revisit it: null keys come last, and of rows with one key and payload one is first. A null html is the
    empty payload; a null url becomes ``urn:page``; line breaks in a url are percent-encoded. Texts of any length
    and repeated rows are written whole. An empty table gives a folder without records.
    """
    folder = folder or work_folder(pages.sparkSession, "warc")
    flat = pick(pages, page=key, url=url, html=html).select(
        F.monotonically_increasing_id().alias("row"), F.col("page").cast("string").alias("name"), "page", "url",
        F.coalesce("html", F.lit("")).alias("html"))
    # stored, so the row numbers stay as they are
    rows = stored(flat.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html").cast("long")), "payloads")
    known = first_copies(rows, least).withColumn("again", F.coalesce(F.col("first.row") != F.col("row"), F.lit(False)))

    def ident(kind: str, name: Column, row: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(name.cast("string"), F.lit("")), F.lit(":"), row.cast("string"), F.lit(f":{kind}>"))

    uri = F.coalesce(F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit("urn:page"))
    own, page, row = ident("capture", F.col("page"), F.col("row")), F.col("page"), F.col("row")
    with_top = [("WARC-Concurrent-To", own)]
    digest = [("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("digest"))))]
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "),
                    F.col("bytes").cast("string"), F.lit(END))
    answer = "application/http; msgtype=response"
    response = _record("response", own, date, uri, digest, answer, F.concat(http, F.col("html")))
    revisit = _record("revisit", own, date, uri, [
        *digest, ("WARC-Profile", F.lit(SAME_PAYLOAD)), ("WARC-Refers-To", ident("capture", F.col("first.page"), F.col("first.row")))], answer, http)
    request = _record("request", ident("request", page, row), date, uri, with_top, "application/http; msgtype=request",
                      F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{END}")))
    fields = F.concat(F.when(page.isNull(), "").otherwise(F.concat(F.lit("page-id: "), F.col("name"), F.lit(LINE))),
                      F.lit("via: table"), F.lit(LINE))
    metadata = _record("metadata", ident("metadata", page, row), date, uri, with_top, "application/warc-fields", fields)
    known.select(F.concat(request, F.lit(END), F.when(F.col("again"), revisit).otherwise(response), F.lit(END), metadata).alias("value")) \
        .write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", max(1, per_file // 3)).text(folder)
    return folder


def _headers(raw: bytes) -> list[tuple[str, str]]:
    """(lower-case name, value) of header lines; lines without a colon are left out."""
    pairs = (line.partition(":") for line in raw.decode("utf-8", "replace").split(LINE))
    return [(name.strip().lower(), value.strip()) for name, colon, value in pairs if colon]


def parse_record(head: bytes, block: bytes, payloads: bool = True) -> dict:
    """One record as a row of ``RECORD``."""
    named = _headers(head)
    one = dict(reversed(named))  # the first of a repeated name counts
    kind, content = one.get("warc-type"), one.get("content-type", "")
    payload, status, fields, size = block, None, [], len(block)
    if content.startswith("application/http"):
        start, _, payload = block.partition(END.encode())
        http = dict(reversed(_headers(start)))
        code = start.split(LINE.encode(), 1)[0].split(b" ")
        status = int(code[1]) if kind in TOPS and len(code) > 1 and code[1].isdigit() else None
        size = len(payload)
        if kind == "revisit":  # the header of the full payload stays in the block
            size = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
    elif content.startswith("application/warc-fields"):
        fields = [{"name": n, "value": v} for n, v in _headers(block)]
    stated = one.get("warc-payload-digest", "").removeprefix("sha1:") or None
    digest = stated
    if kind != "revisit":
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return {"record_id": one.get("warc-record-id"), "type": kind, "target_uri": one.get("warc-target-uri"), "date": one.get("warc-date"),
            "concurrent_to": [v for n, v in named if n == "warc-concurrent-to"], "refers_to": one.get("warc-refers-to"),
            "content_type": content or None, "http_status": status, "fields": fields, "payload_digest": digest,
            "digest_ok": None if stated is None or kind == "revisit" else stated == digest,
            "payload_bytes": size, "payload": bytes(payload) if payloads else None}


def _records(payloads: bool):
    """Batches of (file, piece) as batches of records."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema, mark = to_arrow_schema(StructType.fromDDL(RECORD)), END.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, buffer, head, need = None, bytearray(), b"", None

        def left() -> None:
            if need is not None or buffer.strip(b"\r\n"):
                raise ValueError(f"{path}: the last record is cut off, or the file is not compressed as gzip")

        for batch in batches:
            rows, held = [], 0
            for file, piece in zip(batch.column(0).to_pylist(), batch.column(1)):
                if file != path:
                    left()
                    path, need = file, None
                    buffer.clear()
                buffer += piece.as_buffer() or b""
                buffer += mark
                while True:
                    if need is None:
                        while buffer[:2] == b"\r\n":
                            del buffer[:2]
                        at = buffer.find(mark)
                        if at < 0:
                            break
                        head = bytes(buffer[:at])
                        length = dict(_headers(head)).get("content-length", "")
                        if not head.startswith(b"WARC/") or not length.isdigit():
                            raise ValueError(f"{path}: not a WARC record: {head[:80]!r}")
                        del buffer[:at + len(mark)]
                        need = int(length)
                    if len(buffer) < need:
                        break
                    row = parse_record(head, bytes(buffer[:need]), payloads)
                    del buffer[:need]
                    need = None
                    rows.append(row)
                    held += len(row["payload"] or b"")
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)
        left()

    return run


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """All records of the gzip files in ``folder``, as ``RECORD``; without ``payloads`` their bytes are left out.

    The digest is computed from the payload and compared with the stated one; for revisits, which hold
    none, the stated digest and the length in the HTTP header are taken. A file that is cut off or is no
    WARC file raises. A folder without records gives an empty table.
    """
    pieces = spark.read.format("text").option("lineSep", END).schema("value string").load(folder)
    small_batches(pieces)
    return pieces.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece")) \
        .mapInArrow(_records(payloads), RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, top (response, revisit or resource), requests, metadata, others.

    A record belongs to the top record that it names in concurrent-to or that names it, else to that of a record
    it is so linked with (metadata naming only the request). A record linked to no top record is a capture
    without ``top`` of its own. Of several tops the smallest identifier counts; equal records count once. Records
    without an identifier are captures of their own kind under the null identifier. A row holds the records of
    one capture, however many these are.
    """
    kept = stored(records, "records")
    links = kept.select("record_id", F.explode("concurrent_to").alias("other"))
    links = stored(links.union(links.select("other", "record_id")).distinct(), "record-links")
    tops = kept.filter(F.col("type").isin(*TOPS)).select(F.col("record_id").alias("top_id")).distinct()
    near = stored(links.join(tops, F.col("other") == F.col("top_id")).groupBy("record_id").agg(F.min("top_id").alias("top_id")), "record-tops")
    through = near.select(F.col("record_id").alias("by"), "top_id")
    far = links.join(near.select("record_id"), "record_id", "left_anti").join(through, F.col("other") == F.col("by")) \
        .groupBy("record_id").agg(F.min("top_id").alias("top_id"))
    found = near.union(far).select(F.col("record_id").alias("member"), "top_id")
    is_top = F.col("type").isin(*TOPS)
    parts = kept.join(found, F.col("record_id") == F.col("member"), "left").select(
        F.when(is_top, F.col("record_id")).otherwise(F.coalesce("top_id", "record_id")).alias("capture_id"), "type",
        F.struct(*kept.columns).alias("record"))
    some = lambda when: F.array_sort(F.collect_set(F.when(when, F.col("record"))))
    kind = F.col("type")
    return parts.groupBy("capture_id").agg(
        F.min(F.when(kind.isin(*TOPS), F.col("record"))).alias("top"), some(kind == "request").alias("requests"),
        some(kind == "metadata").alias("metadata"), some(kind.isNull() | ~kind.isin("request", "metadata", *TOPS)).alias("others"))
