"""Content-addressed WARC archive.

An archive is a folder of two Parquet tables in the shared store:

* payloads: sha256 (the address), payload. Each payload is there once, under the digest of its bytes.
* records: page_id, headers (the exact header block of the WARC record in UTF-8), sha256, payload_bytes.

read_archive joins the two and gives the original records again. Each payload is verified against its address and its
length before it is used; a record whose payload is missing or damaged raises an error in its task. record_bytes gives
the records as a .warc file holds them: the header block as stored, byte for byte, a blank line, the block. A response's
block is its payload; a revisit's is empty, so its header block says Content-Length: 0.

Header values are one line: control characters, U+0085, U+2028 and U+2029 in a URL are percent-encoded as UTF-8. Header
lines end at CR LF alone. A record's id is made of page_id and payload digest, so rows of one page_id with different
payloads have different ids and exact repeats of a row are one record. WARC-Date is a column of pages if one is named,
else the time of writing, the same in all records.

Of records with equal payloads the one with the largest page_id is the response and the others are revisits that refer
to it (smaller payloads than `revisit_from` bytes are always responses). A null payload counts as empty. Repeated rows
of one page_id with equal payloads are alike: each is a response if the page_id is the largest. Rows with a null page_id
are never referred to; if no equal payload has a page_id, all of them are responses. Extra columns are ignored; an empty
table gives an empty archive.

A payload that a third of all rows share costs one row after the map-side combine of the group-by; the joins on the
address are joins of plain tables whose hot key AQE splits on the records' side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import scratch_path, stored

#: Fixed value: the alphabet of base32 (RFC 4648).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
#: Fixed value: the profile of revisits with an identical payload (WARC 1.1).
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of a SHA-1 digest: five hex digits are four base32 digits."""
    digits = F.sha1(payload)
    out = []
    for group in range(8):
        n = F.conv(F.substring(digits, 5 * group + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(n, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*out)


#: What no header value may hold: characters that end lines somewhere, and other control characters.
UNSAFE = [*map(chr, range(0x20)), "\x7f", *map(chr, range(0x80, 0xA0)), "\u2028", "\u2029"]


def _one_line(c: Column) -> Column:
    """The value with UNSAFE characters percent-encoded; only values that have any are taken apart."""
    c = F.coalesce(c, F.lit(""))
    out = c
    for u in UNSAFE:
        out = F.replace(out, F.lit(u), F.lit("".join(f"%{b:02X}" for b in u.encode())))
    return F.when(F.regexp_like(c, F.lit(r"[\x00-\x1F\x7F-\x9F\u2028\u2029]")), out).otherwise(c)


def _record_id(page_id: Column, sha1: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), sha1, F.lit(">"))


def write_archive(pages: DataFrame, path: str, payload: str = "html", key: str = "page_id", uri: str | None = "url", revisit_from: int = 0, date: str | None = None) -> None:
    """Write one record per row of pages into the archive at path (a new folder that all machines share).

    date: a timestamp column for WARC-Date.
    """
    body = F.encode(F.col(f"`{payload}`").cast("string"), "UTF-8") if dict(pages.dtypes)[payload] != "binary" else F.col(f"`{payload}`")
    body = F.coalesce(body, F.lit(b"").cast("binary"))
    target = F.col(f"`{uri}`").cast("string") if uri else F.lit("")
    time = F.col(f"`{date}`").cast("timestamp") if date else F.current_timestamp()
    time = F.date_format(F.to_utc_timestamp(F.coalesce(time, F.current_timestamp()), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("page_id"), target.alias("uri"), time.alias("date"), body.alias("payload"))
    rows = rows.withColumn("sha256", F.sha2("payload", 256))

    once = rows.groupBy("sha256").agg(F.first("payload").alias("payload"))
    once.write.option("compression", "zstd").parquet(f"{path}/payloads")

    narrow = rows.select("page_id", "uri", "date", "sha256", F.octet_length("payload").cast("long").alias("n"), base32_sha1(F.col("payload")).alias("sha1"))
    shared = narrow.filter(F.col("n") >= revisit_from).groupBy("sha256").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("rows_n"))
    shared = stored(shared.filter("rows_n > 1").select("sha256", "response_id"), "shared")
    told = narrow.join(shared, "sha256", "left")
    revisit = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("sha1"))),
        F.concat(F.lit("WARC-Date: "), F.col("date")),
        F.concat(F.lit("WARC-Target-URI: "), _one_line(F.col("uri"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("response_id"), F.col("sha1")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string"))),
    ]
    told = told.select("page_id", F.encode(F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF)), "UTF-8").alias("headers"), "sha256", F.col("n").alias("payload_bytes"))
    told.write.option("compression", "zstd").parquet(f"{path}/records")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, headers (binary), payload (binary, verified): the original records, joined together again."""
    payloads = spark.read.parquet(f"{path}/payloads")
    intact = F.sha2("payload", 256) == F.col("sha256")
    payloads = payloads.select("sha256", F.when(intact, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256")))).alias("payload"))
    records = spark.read.parquet(f"{path}/records")
    joined = records.join(payloads, "sha256", "left")
    n, said = F.octet_length("payload"), header_value(F.col("headers"), "Content-Length").try_cast("long")
    revisit = header_value(F.col("headers"), "WARC-Type") == "revisit"
    whole = (n == F.col("payload_bytes")) & (said == F.when(revisit, 0).otherwise(n))
    sound = F.when(whole, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("no whole payload for "), F.col("sha256"))))
    return joined.select("page_id", "headers", sound.alias("payload"))


def header_value(headers: Column, name: str) -> Column:
    """One field of a header block, whose lines end at CR LF; null if it isn't there."""
    found = F.regexp_extract(F.decode(headers, "UTF-8"), rf"\r\n{name}: ?([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def record_bytes(records: DataFrame) -> DataFrame:
    """page_id and record: the exact bytes of each WARC record of read_archive, as a .warc file holds them."""
    revisit = header_value(F.col("headers"), "WARC-Type") == "revisit"
    block = F.when(revisit, F.lit(b"").cast("binary")).otherwise(F.col("payload"))
    end = F.lit(CRLF.encode()).cast("binary")
    return records.select("page_id", F.concat("headers", end, block, end, end).alias("record"))


def archive_report(records: DataFrame) -> DataFrame:
    """Per record of read_archive: length and digest of the payload as read, kind and reference as in the header block."""
    refers = F.regexp_extract(header_value(F.col("headers"), "WARC-Refers-To"), r"<urn:page:(-?\d+):", 1).try_cast("long")
    return records.select(
        "page_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        header_value(F.col("headers"), "WARC-Type").alias("record_type"),
        refers.alias("refers_to"),
    )


def archive_round_trip(pages: DataFrame, payload: str = "html", key: str = "page_id", uri: str | None = "url", revisit_from: int = 0) -> DataFrame:
    """Write pages to a new archive in the shared folder, read it back and report on each record."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archive(pages, path, payload, key, uri, revisit_from)
    return archive_report(read_archive(pages.sparkSession, path))
