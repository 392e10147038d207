"""Content-addressed web archive: payloads once by strong digest, record headers apart.

``write_archive`` stores two Parquet tables in a folder: ``payloads`` (SHA-256, size, bytes; one row
per distinct payload) and ``records`` (exact WARC and HTTP header bytes of every page, in order of
nothing). ``read_archive`` joins them by digest, checks every stored payload against its digest and
rebuilds the records: responses carry headers and payload, revisits headers alone, and both get the
full payload beside the record.

Of records with equal payloads of at least ``least`` bytes the one with the largest page_id is the
response and the others revisit it; smaller ones are all responses.

Defined cases: a null html is an empty payload; a null url leaves its header out; line breaks in a
url are percent-encoded in the header and come back as they were; a null page_id ranks below all others and is written without an id, and if
a group has no other it is a response; repeated rows of the largest page_id are all responses; an
empty table gives an empty archive; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table

LEAST = 1000
DATE = "2024-01-01T00:00:00Z"
#: End of a header line, of a header block, of a record.
LINE, BLOCK_END, RECORD_END = "\r\n", "\r\n\r\n", "\r\n\r\n"


def _uri(url: Column) -> Column:
    """A url on one line; a per cent sign that would read as an escape of this kind is escaped itself."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "%(?=(?:25)*0[DA])", "%25"), "\r", "%0D"), "\n", "%0A")


def _url(uri: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(uri, "%0D", "\r"), "%0A", "\n"), "%25(?=(?:25)*0[DA])", "%")


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page.cast("string"), F.lit(">"))


def write_archive(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Write the payloads and records of pages (page_id, url, html) under path."""
    own = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    own = own.withColumn("sha256", F.sha2("payload", 256))
    # The partial aggregate drops copies before the shuffle: a hot payload travels once per task.
    stored = own.groupBy("sha256").agg(F.max(F.struct("page_id", "payload")).alias("top"))
    stored.select(
        "sha256", F.octet_length("top.payload").cast("long").alias("payload_bytes"), F.col("top.page_id").alias("holder"),
        F.sha1("top.payload").alias("sha1"), F.col("top.payload").alias("payload"),
    ).write.mode("overwrite").parquet(f"{path}/payloads")
    known = pages.sparkSession.read.parquet(f"{path}/payloads").select("sha256", "payload_bytes", "holder", "sha1")
    records = own.select("page_id", "url", "sha256").join(known, "sha256")
    revisit = (F.col("payload_bytes") >= least) & F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(BLOCK_END)
    )
    head = F.concat(
        F.lit(f"WARC/1.1{LINE}WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.coalesce(F.concat(F.lit(f"{LINE}WARC-Record-ID: "), _urn(F.col("page_id"))), F.lit("")),
        F.coalesce(F.concat(F.lit(f"{LINE}WARC-Target-URI: "), _uri(F.col("url"))), F.lit("")),
        F.lit(f"{LINE}WARC-Date: {DATE}{LINE}WARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.coalesce(F.when(revisit, F.concat(F.lit(f"{LINE}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{LINE}WARC-Refers-To: "), _urn(F.col("holder")))), F.lit("")),
        F.lit(f"{LINE}Content-Type: application/http; msgtype=response{LINE}Content-Length: "),
        (F.octet_length("http") + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))).cast("string"), F.lit(BLOCK_END),
    )
    records.withColumn("http", http).select(
        "sha256", F.encode(head, "UTF-8").alias("warc_header"), F.encode("http", "UTF-8").alias("http_header")
    ).write.mode("overwrite").parquet(f"{path}/records")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records rebuilt from an archive: page_id, url, record_type, refers_to, digest, record, payload.

    A payload whose bytes do not match its digest fails the job.
    """
    payloads = spark.read.parquet(f"{path}/payloads").select("sha256", "payload")
    checked = payloads.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256"))).cast("binary")))
    joined = spark.read.parquet(f"{path}/records").join(checked, "sha256")
    head = joined.withColumn("head", F.decode("warc_header", "UTF-8"))
    field = lambda name, pattern, group=1: F.nullif(F.regexp_extract("head", rf"\r\n{name}: {pattern}\r\n", group), F.lit(""))
    end = F.encode(F.lit(RECORD_END), "UTF-8")
    kind = field("WARC-Type", "([a-z]+)")
    return head.select(
        field("WARC-Record-ID", "<urn:page:(-?[0-9]+)>").cast("long").alias("page_id"),
        _url(field("WARC-Target-URI", "([^\r\n]*)")).alias("url"),
        kind.alias("record_type"),
        field("WARC-Refers-To", "<urn:page:(-?[0-9]+)>").cast("long").alias("refers_to"),
        field("WARC-Payload-Digest", "sha1:([0-9a-f]+)").alias("header_digest"),
        F.when(kind == "revisit", F.concat("warc_header", "http_header", end)).otherwise(F.concat("warc_header", "http_header", "payload", end)).alias("record"),
        "payload",
    )


def parse_records(df: DataFrame) -> DataFrame:
    """df (record, payload, ...) with what the record's own bytes say.

    Adds ``parsed_type``, ``parsed_page``, ``parsed_refers_to``, ``parsed_digest`` and ``parsed_payload``
    (of a revisit null). A record whose lengths do not add up, or whose payload is not that of its
    digest, fails the job.
    """
    # One character per byte, so places in the text are places in the record.
    head_end = F.instr(F.decode("record", "ISO-8859-1"), BLOCK_END)
    out = df.withColumn("__end", head_end).withColumn("__head", F.decode(F.expr("substring(record, 1, __end + 1)"), "UTF-8"))
    field = lambda name, pattern: F.nullif(F.regexp_extract("__head", rf"\r\n{name}: {pattern}\r\n", 1), F.lit(""))
    length = field("Content-Length", "([0-9]+)").cast("int")
    out = out.withColumn("__length", length).withColumn("__block", F.expr("substring(record, __end + 4, __length)"))
    out = out.withColumn("__http", F.instr(F.decode("__block", "ISO-8859-1"), BLOCK_END)).withColumn("parsed_type", field("WARC-Type", "([a-z]+)"))
    payload = F.when(F.col("parsed_type") == "response", F.expr("substring(__block, __http + 4)"))
    out = out.withColumn("parsed_digest", field("WARC-Payload-Digest", "sha1:([0-9a-f]+)")).withColumn("__payload", payload)
    whole = (F.octet_length("record") == F.col("__end") + 3 + F.col("__length") + 4) & (F.sha1(F.coalesce("__payload", "payload")) == F.col("parsed_digest"))
    checked = F.when(whole, F.col("__payload")).otherwise(F.raise_error(F.concat(F.lit("damaged record "), F.coalesce("__head", F.lit("")))).cast("binary"))
    page = lambda name: field(name, "<urn:page:(-?[0-9]+)>").cast("long")
    return out.select(*df.columns, "parsed_type", page("WARC-Record-ID").alias("parsed_page"), page("WARC-Refers-To").alias("parsed_refers_to"), "parsed_digest", checked.alias("parsed_payload"))


def op3_content_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per page, written to an archive, rebuilt from it and parsed."""
    path = shared_dir(spark)
    write_archive(table(spark, sf_dir, "pages"), path)
    # What a response says comes out of its own bytes; a revisit's payload is the one that it refers to.
    full = F.coalesce("parsed_payload", "payload")
    return parse_records(read_archive(spark, path).select("record", "payload")).select(
        F.col("parsed_page").alias("page_id"), F.octet_length(full).cast("long").alias("payload_bytes"), F.col("parsed_digest").alias("payload_digest"),
        F.col("parsed_type").alias("record_type"), F.col("parsed_refers_to").alias("refers_to"),
    )


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS holder FROM p GROUP BY html)
SELECT p.page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN octet_length(encode(p.html)) >= 1000 AND p.page_id <> g.holder THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN octet_length(encode(p.html)) >= 1000 AND p.page_id <> g.holder THEN g.holder END AS refers_to
FROM p JOIN g ON p.html = g.html
"""
