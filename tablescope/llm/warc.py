"""WARC as a content-addressed archive.

Payload bytes are stored once under their SHA-256, record headers exactly as written in a table of their own. Reading joins
them again: every payload's address is recomputed on the way out, and two payloads that share an address but not
their bytes stop the writing. Any record can be rebuilt byte for byte.

Defined results: a null text is an empty payload; a null URL gives an empty WARC-Target-URI; blanks and control characters of
URLs and of text ids are percent-encoded in headers, so none can begin a header line of its own; ids may be numbers or texts; of repeated rows that share the largest id of
a payload one is the response and the others revisit it; null ids sort lowest; an empty table gives an empty
archive. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.llm.common import column, discard, numbered, shared_folder, write

UNSAFE = r"[\x00-\x20<>\x7F%]"  # characters that ids don't show as they are in a header
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"  # given tables carry no crawl time
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: str) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary column; 160 bits are 8 times 20, so there is no padding."""
    twenty = f"CAST(conv(substr(d, 5 * k + 1, 5), 16, 10) AS int)"
    letters = ", ".join(f"substr('{BASE32}', (shiftright({twenty}, {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0))
    return F.expr(f"array_join(transform(array(sha1({payload})), d -> array_join(transform(sequence(0, 7), "
                  f"k -> concat({letters})), '')), '')")


def one_line(value: Column, unsafe: str = UNSAFE) -> Column:
    """``value`` with its unsafe characters percent-encoded."""
    signs = F.transform(F.split(value, ""), lambda c: F.when(c.rlike(f"^{unsafe}$"), F.concat(
        F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c))
    return F.when(value.rlike(unsafe), F.array_join(signs, "")).otherwise(value)


def write_archive(pages: DataFrame, folder: str, *, key: str = "page_id", url: str = "url", body: str = "html",
                  min_bytes: int = 0) -> None:
    """One record per row: payloads to ``folder``/payloads, headers to ``folder``/headers.

    Of records with equal payloads of at least ``min_bytes`` the one with the largest key is the response and the others are
    revisits; smaller payloads are all responses.
    """
    numbers = shared_folder(pages.sparkSession, "pages")
    rows, row = numbered(pages.select(column(key).alias("id"), column(url).alias("url"),
                                      F.coalesce(column(body), F.lit("")).cast("binary").alias("payload")), numbers)
    rows = rows.withColumnRenamed(row, "row").withColumn("address", F.unhex(F.sha2("payload", 256)))
    same = (F.min(F.xxhash64("payload")) == F.max(F.xxhash64("payload"))) & (
        F.min(F.octet_length("payload")) == F.max(F.octet_length("payload")))
    kept = rows.groupBy("address").agg(
        F.max(F.struct("id", "row")).alias("holder"), F.first("payload").alias("payload"), same.alias("same"))
    kept = kept.select("address", "holder", F.when(F.col("same"), F.col("payload")).otherwise(
        F.raise_error(F.lit("two payloads share an address"))).alias("payload"))
    payloads = write(kept.select("address", "payload", "holder", base32_sha1("payload").alias("sha1"),
                                 F.octet_length("payload").cast("long").alias("bytes")), f"{folder}/payloads")
    heads = payloads.select("address", "holder", "sha1", "bytes")
    records = rows.select("id", "row", "url", "address").join(heads, "address")
    revisit = (F.col("bytes") >= min_bytes) & (F.col("row") != F.col("holder.row"))
    line = F.lit("\r\n")
    md5 = F.md5(F.concat_ws("/", F.col("id").cast("string"), F.col("row").cast("string")).cast("binary"))
    uuid = F.concat_ws("-", *[F.substring(md5, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), line,
        F.lit("WARC-Record-ID: <urn:uuid:"), uuid, F.lit(">\r\n"), F.lit(f"WARC-Date: {DATE}\r\n"),
        F.lit("WARC-Target-URI: "), one_line(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]"), line,
        F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1"), line,
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:"),
                                 one_line(F.coalesce(F.col("holder.id").cast("string"), F.lit(""))), F.lit(">\r\n"))).otherwise(F.lit("")),
        F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string")), F.lit("\r\n\r\n"))
    write(records.select("id", "address", header.cast("binary").alias("header")), f"{folder}/headers")
    discard(pages.sparkSession, numbers)


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Every record: id, header, payload (for revisits that of the record referred to), record_type, refers_to,
    payload_bytes and payload_digest of the stored bytes, whose address is checked."""
    stored = spark.read.parquet(f"{folder}/payloads").select("address", "payload")
    sound = F.unhex(F.sha2("payload", 256)) == F.col("address")
    stored = stored.select(
        "address", "payload",
        F.when(sound, F.octet_length("payload").cast("long")).otherwise(
            F.raise_error(F.lit("a stored payload does not match its address")).cast("long")).alias("payload_bytes"),
        base32_sha1("payload").alias("payload_digest"))
    headers = spark.read.parquet(f"{folder}/headers")
    fields = F.col("header").cast("string")
    refers = F.regexp_extract(fields, "\r\nWARC-Refers-To: <urn:page:([^>\r\n]*)>\r\n", 1)
    refers = F.url_decode(F.replace(refers, F.lit("+"), F.lit("%2B")))
    kind = headers.schema["id"].dataType
    headers = headers.select("id", "address", "header", F.regexp_extract(fields, "^WARC/1.1\r\nWARC-Type: ([a-z]+)\r\n", 1).alias("record_type"),
                             F.when(refers != "", refers.cast(kind)).alias("refers_to"))
    return headers.join(stored, "address")


def record_bytes(records: DataFrame) -> DataFrame:
    """id and the record as it stands in a WARC file: header, payload unless it is a revisit, two line ends."""
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return records.select("id", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"))


def archived_pages(pages: DataFrame, *, key: str = "page_id", url: str = "url", body: str = "html", min_bytes: int = 0) -> DataFrame:
    """Archive ``pages`` in the shared folder and report what reading it back gives, one row per page."""
    folder = shared_folder(pages.sparkSession, "warc")
    write_archive(pages, folder, key=key, url=url, body=body, min_bytes=min_bytes)
    return read_archive(pages.sparkSession, folder).select(
        F.col("id").alias(key), "payload_bytes", "payload_digest", "record_type", "refers_to")
