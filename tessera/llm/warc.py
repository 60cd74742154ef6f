"""A content-addressed WARC archive: payloads once by verified digest, exact headers beside them."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_folder, stage, table

CRLF = "\r\n"
#: Digits of Spark's base 32 and those of RFC 4648, in the same order (fixed values).
DIGITS, RFC4648 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


class Archive(NamedTuple):
    headers: DataFrame
    payloads: DataFrame


def sha1_base32(data: Column) -> Column:
    """SHA-1 in base 32, upper case: ten hexadecimal digits are eight of base 32."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), DIGITS, RFC4648)


def _uuid(*of: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in of]))
    return F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def write_archive(pages: DataFrame, *, id_col="page_id", url_col="url", body_col="html", date="2024-01-01T00:00:00Z", least=0, buckets=0) -> Archive:
    """Write a WARC/1.1 record for each page, and read the archive's two tables back.

    Of pages with equal payloads of at least `least` bytes, that with the largest id is the
    response and the others are revisits of it. headers: row, page_id, digest (SHA-256), header
    (exact bytes, to the blank line). payloads: digest, payload, once each, in buckets by
    digest. A null body is an empty payload, a null url an empty target; of rows that repeat,
    one is the response; ids may be null (they rank below others). An empty table gives empty
    tables, whose other columns are not looked at.
    """
    spark = pages.sparkSession
    body = F.encode(F.coalesce(F.col(body_col), F.lit("")), "UTF-8")
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("page_id"),
        F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.octet_length(body).cast("long").alias("bytes"),
        F.sha2(body, 256).alias("digest"), sha1_base32(body).alias("sha1"),
    )
    rows = stage(rows, "warc-digests")
    newest = rows.groupBy("digest").agg(F.max(F.struct(F.coalesce("page_id", F.lit(-(2**63))), "row", "page_id")).alias("top"))
    marked = rows.join(newest.select("digest", F.col("top.row").alias("top_row"), F.col("top.page_id").alias("top_id")), "digest")
    first = (F.col("row") == F.col("top_row")) | (F.col("bytes") < least)
    about = lambda page_id: F.concat(F.lit("<urn:uuid:"), _uuid(page_id, F.col("digest")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    kind = F.when(first, "response").otherwise("revisit")
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", kind), line("WARC-Record-ID", about(F.col("page_id"))),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(first, F.lit("")).otherwise(F.concat(
            line("WARC-Refers-To", about(F.col("top_id"))),
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        )),
        line("Content-Length", F.when(first, F.col("bytes")).otherwise(0).cast("string")), F.lit(CRLF),
    )
    headers = stage(marked.select("row", "page_id", "digest", F.encode(header, "UTF-8").alias("header")), "warc-headers")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"tessera_payloads_{uuid.uuid4().hex}"
    (
        # equal digests are equal bytes: each task passes a payload on once, and one shuffle by digest deals the buckets
        pages.select(body.alias("payload")).select(F.sha2("payload", 256).alias("digest"), "payload").dropDuplicates(["digest"])
        .write.bucketBy(buckets, "digest").option("compression", "zstd")
        .option("path", f"{shared_folder(spark)}/tessera/{name}").saveAsTable(name)
    )
    return Archive(headers, spark.table(name))


def field(header: Column, name: str) -> Column:
    """The value of a header line; '' if there is none."""
    return F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)", 1)


def read_records(archive: Archive) -> DataFrame:
    """Original records, one row each: row, page_id, digest, header, record (its exact bytes).

    Only a response's record holds its payload, so that payloads join once each.
    """
    text = F.decode("header", "UTF-8")
    own = archive.headers.withColumn("kind", field(text, "WARC-Type"))
    full = own.where("kind = 'response'").join(archive.payloads, "digest")
    end = F.encode(F.lit(CRLF * 2), "UTF-8")
    out = ["row", "page_id", "digest", "header", "kind"]
    return full.select(*out, "payload", F.concat("header", "payload", end).alias("record")).unionByName(
        own.where("kind <> 'response'").select(*out, F.lit(None).cast("binary").alias("payload"), F.concat("header", end).alias("record"))
    )


def verified_pages(archive: Archive) -> DataFrame:
    """What the archive says of each page, with every stored payload held against its digests.

    Raises where a payload differs from its address, its length or the digest in its header, and
    where a revisit's response is missing.
    """
    records = read_records(archive).withColumn("text", F.decode("header", "UTF-8"))
    told = F.regexp_extract(field(F.col("text"), "WARC-Payload-Digest"), "^sha1:(.*)$", 1)
    length = field(F.col("text"), "Content-Length").cast("long")
    sound = (F.sha2("payload", 256) == F.col("digest")) & (sha1_base32(F.col("payload")) == told) & (F.octet_length("payload") == length)
    stored = records.where("kind = 'response'").select(
        "digest", "page_id", field(F.col("text"), "WARC-Record-ID").alias("record_id"),
        F.when(sound, length).otherwise(F.raise_error(F.lit("a stored payload differs from its digest"))).alias("payload_bytes"), told.alias("payload_digest"),
    )
    stored = stage(stored, "warc-verified")
    again = archive.headers.select("page_id", "digest", F.decode("header", "UTF-8").alias("text")).where(field(F.col("text"), "WARC-Type") == "revisit")
    again = again.select("page_id", "digest", field(F.col("text"), "WARC-Refers-To").alias("refers"))
    found = again.join(stored.withColumnRenamed("page_id", "refers_to"), "digest", "left")
    matched = F.when(F.col("refers") == F.col("record_id"), F.col("payload_bytes")).otherwise(F.raise_error(F.lit("a revisit has no response")))
    return stored.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(
        found.select("page_id", matched.alias("payload_bytes"), "payload_digest", F.lit("revisit").alias("record_type"), "refers_to")
    )


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified_pages(write_archive(table(spark, sf_dir, "pages")))


def oracle() -> str:
    groups = " || ".join(
        f"substr('{RFC4648}', 1 + ((('0x' || substr(h, {1 + 5 * i}, 5))::BIGINT >> {5 * (3 - j)}) & 31)::INT, 1)" for i in range(8) for j in range(4)
    )
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, {groups} AS payload_digest,
  max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM q
"""
