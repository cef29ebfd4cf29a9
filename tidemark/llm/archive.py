"""A content-addressed WARC archive.

Payload bytes are stored once per SHA-256 digest; every record keeps its exact header bytes in a
second table.  Records of a payload of at least `REVISIT_BYTES` bytes after the first (smallest id)
are `revisit` records and refer to the first one's.  Reading verifies each stored payload against
its digest and rebuilds the original records by joins.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import fresh_path

#: Shorter payloads are always stored as responses.
REVISIT_BYTES = 100
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page_id: Column, digest: Column) -> Column:
    """A stable URN for a page id (a null id has one, too) and what it holds."""
    hexed = F.md5(F.concat(F.coalesce(F.concat(F.lit("page:"), page_id.cast("string")), F.lit("null")), F.lit(" "), digest).cast("binary"))
    part = lambda a, n: F.substring(hexed, a, n)
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)))


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str | None = None) -> None:
    """Write `path`/payloads (digest, payload) and `path`/records (page_id, digest, type, header and HTTP header bytes).

    A null payload is stored as an empty one, a null url as an empty target.  Rows with equal ids and
    payloads give equal records, as often as they occur.  Other columns are ignored; an empty table gives
    an empty archive.  `date` is the WARC-Date of all records (RFC 3339 in UTC), by default now.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # One row per digest: the partial aggregation keeps one payload of each digest per task.
    rows.groupBy("digest").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    slim = rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("payload_bytes"))
    firsts = slim.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
    firsts = firsts.where("copies > 1").drop("copies")
    records = slim.join(firsts, "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    records = records.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("http_header", http)
    block = F.octet_length("http_header") + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    header = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<"), _record_id(F.col("page_id"), F.col("digest")), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", F.concat(F.lit("<"), _record_id(F.col("first_id"), F.col("digest")), F.lit(">"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", block.cast("string")),
        F.lit(CRLF),
    )
    refers = F.when(revisit, F.col("first_id")).alias("refers_to")
    records.select("page_id", "digest", header.cast("binary").alias("header"), F.col("http_header").cast("binary").alias("http_header"), refers).write.option("compression", "zstd").parquet(f"{path}/records")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(digest, payload, payload_bytes), failing on a payload whose bytes don't have its digest."""
    stored = spark.read.parquet(f"{path}/payloads")
    sound = F.when(F.sha2("payload", 256) == F.col("digest"), F.octet_length("payload").cast("long"))
    return stored.withColumn("payload_bytes", F.coalesce(sound, F.raise_error(F.concat(F.lit("payload does not have the digest "), F.col("digest"))).cast("long")))


def header_field(header: Column, name: str) -> Column:
    return F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """What the stored headers say of each record, with the bytes of the payload that its digest names."""
    text = F.decode("header", "UTF-8")
    records = spark.read.parquet(f"{path}/records").select("page_id", "refers_to", header_field(text, "WARC-Type").alias("record_type"), F.regexp_replace(header_field(text, "WARC-Payload-Digest"), "^sha256:", "").alias("digest"))
    return records.join(read_payloads(spark, path).select("digest", "payload_bytes"), "digest")


def rebuild_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, warc): the exact bytes of every original record, payloads joined back by digest; as many rows as were
    written, with null and repeated ids as they were.
    Only responses need the bytes, so a payload that many pages share isn't sent to its revisits."""
    records = spark.read.parquet(f"{path}/records").withColumn("want", F.when(F.col("refers_to").isNull(), F.col("digest")))
    payloads = read_payloads(spark, path).where("payload_bytes >= 0").select(F.col("digest").alias("want"), "payload")
    end = F.lit(CRLF + CRLF).cast("binary")
    return records.join(payloads, "want", "left").select("page_id", F.concat("header", "http_header", F.coalesce("payload", F.lit("").cast("binary")), end).alias("warc"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archive of all pages says of each when it is read back."""
    path = fresh_path(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_records(spark, path).select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS d FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS f FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id IS DISTINCT FROM f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id IS DISTINCT FROM f THEN f END AS refers_to
FROM m
"""
