"""WARC archives with revisit records.

Headers (payload digest, page_id, length) are summed by digest; digests that occur more than
once name their original, the smallest page_id. Only those are joined back to the pages, so
a table without copies moves no payload. Every page then becomes one WARC/1.1 record:
a response with its payload, or a revisit that names the original and has no payload. Spark's
text writer writes the records (the blank lines that end a record are its line separator).
Pages are written by size, each size with as many records to a file as keep its payloads within
``FILE_BYTES``; a longer page has a file of its own. Reading takes one file at a time, by ``Content-Length``,
recomputes length and digest of each payload and resolves revisits by a join on the digest.

Edge cases: a null html is an empty payload. A null page_id comes last; it is written
without an id and read back as null. Rows that repeat both page_id and payload are alike:
if theirs is the smallest page_id, all are responses. A url with control characters is
percent-encoded in its header; a null url is left out. An empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import shared_dir, written

END = "\r\n\r\n"
#: Most records of a file, and most bytes of its payloads if there are several, so that a file fits a task's memory.
FILE_RECORDS, FILE_BYTES = 1000, 1 << 26
#: Pages of one size: their payloads differ by this factor at most, the shortest aside.
SIZES = 4
#: Payloads with fewer bytes are always responses.
LEAST_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# The alphabet of base32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of SHA-1, in the JVM: five hexadecimal digits are four letters."""
    digits = F.sha1(payload)
    letters = []
    for part in range(8):
        value = F.conv(F.substring(digits, 5 * part + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(BASE32), F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*letters)


def record_id(page_id: Column, digest: Column) -> Column:
    """A urn that depends on page and payload alone."""
    h = F.md5(F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("")), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def resolved(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, bytes, and original: the page_id of the response of a payload that is not unique."""
    rows = pages.select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("html")
    ).withColumns({"digest": base32_sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html").cast("long")})
    copies = written(
        rows.where(F.col("bytes") >= LEAST_BYTES).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("original"))
        .where("n > 1").select("digest", "original")
    )
    return rows.join(copies, "digest", "left")


def records(rows: DataFrame) -> Column:
    """The text of each record without the blank lines that end it."""
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    url = F.col("url")
    for code in (*range(33), 127):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.col("digest"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
        line("WARC-Refers-To", F.when(revisit, record_id(F.col("original"), F.col("digest")))),
        line("X-Page-Id", F.col("page_id")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block)),
    )
    return F.concat(head, F.lit("\r\n"), block)


def write(pages: DataFrame, path: str) -> None:
    """Write every page as a WARC record into files under ``path``."""
    rows = resolved(pages)
    longest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    low, high = -1, FILE_BYTES // FILE_RECORDS
    while low < longest or low < 0:
        if high >= FILE_BYTES:
            high = longest
        some = rows.where((F.col("bytes") > low) & (F.col("bytes") <= high))
        at_most = max(1, min(FILE_RECORDS, FILE_BYTES // max(1, high)))
        (
            some.select(records(some).alias("value"))
            .write.mode("append").option("lineSep", END).option("maxRecordsPerFile", at_most).text(path)
        )
        low, high = high, max(1, high) * SIZES


def parsed(data: bytes):
    """(headers, payload) of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines)
        start, size = end + 4, int(headers["Content-Length"])
        block = memoryview(data)[start : start + size]
        if len(block) < size or data[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut short")
        body = data.index(b"\r\n\r\n", start, start + size) + 4
        yield headers, block[body - start :]
        at = start + size + 4


FIELDS = "page_id long, record_type string, record_id string, refers_to_id string, payload_digest string, payload_bytes long, payload string"


def read(spark, path: str, payloads: bool = True) -> DataFrame:
    """One row per record: page_id, record_type, record_id, refers_to_id, payload_digest, payload_bytes, payload.

    Digest and length of a response are computed from its payload and must agree with its
    header; a revisit has none of its own (null), only the digest that its header names.
    """

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for headers, payload in parsed(data.as_py()):
                    named = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    page, length, text = headers.get("X-Page-Id"), None, None
                    if headers["WARC-Type"] == "response":
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != named:
                            raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
                        length = len(payload)
                        text = bytes(payload).decode("utf-8") if payloads else None
                    rows.append((page and int(page), headers["WARC-Type"], headers["WARC-Record-ID"], headers.get("WARC-Refers-To"), named, length, text))
                    size += len(text or "")
                    if size > 1 << 24:
                        yield made(rows)
                        rows, size = [], 0
                yield made(rows)

    names = [f.split()[0] for f in FIELDS.split(", ")]
    kinds = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string()]

    def made(rows):
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("content")
    return files.mapInArrow(run, FIELDS)


def resolve(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of records that were read."""
    originals = (
        found.where("record_type = 'response'").groupBy("payload_digest")
        .agg(F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("original_bytes"))
    )
    revisit = F.col("record_type") == "revisit"
    return found.join(originals, "payload_digest", "left").select(
        "page_id",
        F.coalesce("payload_bytes", "original_bytes").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.when(revisit, F.col("refers_to")).alias("refers_to"),
    )


def archive(pages: DataFrame) -> DataFrame:
    """Write the pages as archives in the shared folder, read these back and resolve the revisits."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/warc/{uuid.uuid4().hex}"
    write(pages, path)
    return resolve(written(read(spark, path, payloads=False)))
