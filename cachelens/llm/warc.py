"""WARC archives: a writer in DataFrame functions and a reader that salvages damaged files.

The writer turns rows into WARC/1.1 records and leaves the files to Spark's text writer, so they can go to any
file system that Spark writes to and a lost executor's part is written again. Equal payloads are stored once:
the record with the smallest page_id is the response, the others are revisit records that refer to it.

The reader walks through a file record by record, plain or in gzip members. After a failed check (version
line, headers, length, gzip, digest) it searches for the next gzip member or version line, goes on from there and
logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import stored, work_dir

#: Records and payload bytes of a file. A file is read by one task at a time.
FILE_RECORDS, FILE_BYTES = 1000, 1 << 29
#: Headers are looked for in so many bytes.
HEADER_BYTES = 1 << 18
CRLF = "\r\n"
VERSION = b"WARC/1."
GZIP = b"\x1f\x8b\x08"


def base32_of_hex(digest: Column) -> Column:
    """Base32 of a SHA-1 in hex: 5 hex digits are 4 base32 digits."""
    digits = F.concat(*[F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def one_line(col: Column) -> Column:
    """A header value: line ends and other control characters as %XX."""
    for code in (13, 10, 0):
        col = F.replace(col, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return col


def warc_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, record) for ``pages`` (page_id, url, html): the text of each WARC record, without its end.

    Of pages with equal payloads of at least ``least_bytes`` bytes the smallest page_id is the response. Rows
    with that same page_id and payload are all responses. A null html is empty, a null url has no target. A null
    page_id can't be referred to: such a row is a revisit of a smaller page_id if there is one, else a response.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    meta = rows.select("page_id", F.octet_length("html").alias("size"), F.sha1(F.col("html").cast("binary")).alias("sha1")).filter(F.col("size") >= least_bytes)
    first = meta.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("rows")).filter("rows > 1 AND first IS NOT NULL").drop("rows")
    # Only ids and hashed digests of repeated payloads meet the pages again. They are written first, so that the
    # planner knows their size: up to the broadcast threshold the pages needn't be shuffled.
    tag = F.xxhash64("sha1")
    later = stored(meta.join(first, "sha1").filter(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("later"), tag.alias("tag"), "first").distinct(), "revisits")
    rows = rows.withColumn("sha1", F.sha1(F.col("html").cast("binary"))).join(later, F.col("page_id").eqNullSafe(F.col("later")) & (tag == F.col("tag")), "left")
    size = F.octet_length("html").cast("string")
    digest = F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha1")))
    revisit = F.col("first").isNotNull()

    def uri(col: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(col).cast("string"), F.lit("none")), F.lit(">"))

    def header(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise(F.lit(""))

    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size, F.lit(CRLF + CRLF))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        header("WARC-Record-ID", uri("page_id")), header("WARC-Date", F.lit("1970-01-01T00:00:00Z")), header("WARC-Target-URI", one_line(F.col("url"))),
        header("WARC-Payload-Digest", digest), header("WARC-Refers-To", F.when(revisit, uri("first"))),
        header("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        header("Content-Type", F.lit("application/http;msgtype=response")), header("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF),
    )
    return rows.select("page_id", F.concat(head, block).alias("record"))


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Writes ``pages`` as WARC files below ``path``, each task its own, of at most FILE_RECORDS records and FILE_BYTES of payloads.

    Pages of more than their even share of a file are written apart, as many a file as the largest allows.
    """
    records = warc_records(pages, least_bytes)
    size = F.octet_length(F.coalesce(F.col("html").cast("string"), F.lit("")))
    most = pages.agg(F.max(size)).first()[0] or 0
    share = FILE_BYTES // FILE_RECORDS
    parts = [(records, FILE_RECORDS)]
    if most > share:
        large = F.octet_length("record") > share
        parts = [(records.filter(~large), FILE_RECORDS), (records.filter(large), max(1, FILE_BYTES // most))]
    for rows, limit in parts:
        rows.select("record").write.mode("append").option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", limit).text(path)


def header_end(data: bytes, at: int) -> int:
    return data.find(b"\r\n\r\n", at, at + HEADER_BYTES)


def parse_record(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """(headers, block, position behind the record); ValueError if a check fails."""
    if not re.match(rb"WARC/1\.[01]\r\n", data[at : at + 10]):
        raise ValueError("no version line")
    end = header_end(data, at)
    if end < 0:
        raise ValueError("headers don't end")
    headers = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("broken header")
        headers[name.strip().lower().decode("ascii", "replace")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not length.isdigit():
        raise ValueError("no length")
    begin, stop = end + 4, end + 4 + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("block doesn't end where its length says")
    block = data[begin:stop]
    http, body = block.partition(b"\r\n\r\n")[::2]
    digest = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") == "response" and digest.lower().startswith("sha1:"):
        if base64.b32encode(hashlib.sha1(body).digest()).decode() != digest[5:]:
            raise ValueError("payload digest differs")
    headers["http"] = http.decode("latin-1")
    return headers, body, stop + 4


#: Bytes of a member that are unpacked at once.
PIECE = 1 << 16


def member(data: bytes, at: int) -> tuple[bytes, int, str]:
    """A gzip member's contents, the position behind it, and why it is not whole, if so; then what could be read."""
    unzip, parts, why = zlib.decompressobj(31), [], "gzip: cut off"
    view = memoryview(data)
    for k in range(at, len(data), PIECE):
        before = unzip.copy()
        try:
            parts.append(unzip.decompress(view[k : k + PIECE]))
        except zlib.error as e:
            why = f"gzip: {e}"
            try:
                for x in range(k, min(k + PIECE, len(data))):
                    parts.append(before.decompress(view[x : x + 1]))
            except zlib.error:
                pass
            break
        if unzip.eof:
            return b"".join(parts), min(k + PIECE, len(data)) - len(unzip.unused_data), ""
    return b"".join(parts), len(data), why


def parse_member(plain: bytes, whole: bool) -> tuple[list[tuple], list[tuple], str]:
    """(headers, body) of a member's records, (length, reason) of the gaps between them, and the first reason.

    Of a member that isn't whole, a record counts if its digest was checked and another version line follows.
    """
    found, gaps, first, at, gap = [], [], "", 0, None
    while at < len(plain):
        try:
            headers, body, stop = parse_record(plain, at)
            checked = headers.get("warc-type") == "response" and headers.get("warc-payload-digest", "").lower().startswith("sha1:")
            if not whole and not (checked and plain.startswith(VERSION, stop)):
                raise ValueError("not confirmed in a broken member")
        except ValueError as e:
            gap, first = gap or (at, str(e)), first or str(e)
            at = plain.find(VERSION, at + 1)
            at = len(plain) if at < 0 else at
            continue
        if gap:
            gaps.append((at - gap[0], gap[1]))
            gap = None
        found.append((headers, body))
        at = stop
    if gap:
        gaps.append((len(plain) - gap[0], gap[1]))
    return found, gaps, first


class Starts:
    """Where the next member or version line may begin from a position on that never falls; the end if there is none."""

    def __init__(self, data: bytes):
        self.data, self.found = data, {VERSION: -1, GZIP: -1}

    def after(self, at: int) -> int:
        for mark, place in self.found.items():
            if place < at:
                place = self.data.find(mark, at)
                self.found[mark] = place if place >= 0 else len(self.data)
        return min(self.found.values())


def salvage(data: bytes) -> Iterator[tuple]:
    """("record", offset, headers, body) and ("gap", offset, length, reason) for a whole file, in order.

    A gap takes in the broken record itself. Adjoining gaps are one, with the first reason. A whole member with
    broken records gives the others, and a gap at its offset, in unpacked bytes, for each run of broken ones. A
    member that isn't whole gives the records that are sure, and is a gap itself.
    """
    at, gap, starts = 0, None, Starts(data)
    while at < len(data):
        try:
            if data.startswith(GZIP, at):
                plain, stop, why = member(data, at)
                found, lost, first = parse_member(plain, not why)
                if not found and (why or first):
                    raise ValueError(why or first)
            else:
                headers, body, stop = parse_record(data, at)
                found, lost, why = [(headers, body)], [], ""
        except ValueError as e:
            gap = gap or (at, str(e))
            at = starts.after(at + 1)
            continue
        if gap:
            yield "gap", gap[0], at - gap[0], gap[1]
            gap = None
        for headers, body in found:
            yield "record", at, headers, body
        if why:
            gap = at, why
            at = starts.after(at + 1)
            continue
        for length, reason in lost:
            yield "gap", at, length, f"in a member: {reason}"
        at = stop
    if gap:
        yield "gap", gap[0], len(data) - gap[0], gap[1]


RECORD_FIELDS = "file string, offset long, kind string, record_id string, record_type string, url string, payload string, payload_bytes long, payload_digest string, refers_to string, gap_bytes long, reason string"


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps (kind: record or gap) of all files below ``path``; see RECORD_FIELDS.

    payload_bytes is the stored payload's size, for a revisit the size in its HTTP headers; without
    ``payloads`` the payloads are checked and counted but not returned. A file is held by one task.
    """
    names = [x.split()[0] for x in RECORD_FIELDS.split(", ")]

    def row(name: str, item: tuple) -> dict:
        if item[0] == "gap":
            return {"file": name, "offset": item[1], "kind": "gap", "gap_bytes": item[2], "reason": item[3]}
        _, at, headers, body = item
        size = re.search(r"(?im)^content-length:\s*(\d+)", headers["http"])
        stored = headers.get("warc-type") != "revisit"
        digest = headers.get("warc-payload-digest", "")
        return {
            "file": name, "offset": at, "kind": "record", "record_id": headers.get("warc-record-id"), "record_type": headers.get("warc-type"), "url": headers.get("warc-target-uri"),
            "payload": body.decode("utf-8", "replace") if payloads and stored else None, "payload_bytes": len(body) if stored else int(size[1]) if size else None,
            "payload_digest": digest.partition(":")[2] or None, "refers_to": headers.get("warc-refers-to"),
        }

    kinds = {"offset": pa.int64(), "payload_bytes": pa.int64(), "gap_bytes": pa.int64()}
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, data = batch["path"][k].as_py(), batch["content"][k].as_py()
                held = []
                for item in salvage(data):
                    held.append(row(name, item))
                    if len(held) >= 500:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held = []
                yield pa.RecordBatch.from_pylist(held, schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(task, RECORD_FIELDS)


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), read back from archives written of ``pages``."""
    spark = pages.sparkSession
    path = path or work_dir(spark, "warc")
    write_warc(pages, path)
    number = F.regexp_extract("record_id", r"^<urn:page:(-?\d+)>$", 1)
    other = F.regexp_extract("refers_to", r"^<urn:page:(-?\d+)>$", 1)
    rows = read_warc(spark, path, payloads=False).filter("kind = 'record'")
    return rows.select(F.when(number != "", number.cast("long")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(other != "", other.cast("long")).alias("refers_to"))


def archive_sql(table: str = "pages") -> str:
    """The same rows in DuckDB SQL, from the pages themselves."""
    digits = " || ".join(f"lpad(to_base(('0x' || substr(sha, {1 + 5 * k}, 5))::BIGINT, 32), 4, '0')" for k in range(8))
    return f"""
    WITH rows AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM {table}),
    firsts AS (SELECT sha, min(page_id) AS first FROM rows GROUP BY sha)
    SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
        translate({digits}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
        CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
    FROM rows JOIN firsts USING (sha)"""
