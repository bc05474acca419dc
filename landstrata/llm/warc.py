"""Content-addressed web archive.

``write_archive`` stores every distinct payload once under its SHA-256 digest (``payloads``) and the exact header bytes
of every record apart from it (``headers``). ``read_archive`` joins both by digest, verifies the digest of the stored
bytes and rebuilds the original records. Of records with equal payloads of at least ``min_revisit`` bytes the one with
the smallest key is the response and the others revisit it; smaller payloads are responses all.

Defined cases: a null payload is empty; a null url gives no target line; line breaks in a url are written as %0D and %0A;
a record with null key is a response unless its payload has a keyed response, which it then revisits; records that
repeat the smallest key are responses alike; other columns are ignored; an empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = "\r\n"


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))


def _uri(key: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), key.cast("string"), F.lit(">"))


def _header(date: str) -> Column:
    """Exact header of one record, up to and with the empty line."""
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit(f"WARC/1.1{END}"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", F.coalesce(_uri(F.col("key")), F.concat(F.lit("<urn:sha256:"), F.col("digest"), F.lit(">")))),
        _line("WARC-Target-URI", url),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(F.col("record_type") == "revisit", _line("WARC-Refers-To", _uri(F.col("refers_to")))).otherwise(F.lit("")),
        _line("Content-Type", F.lit("text/html; charset=UTF-8")),
        _line("Content-Length", F.col("n").cast("string")),
        F.lit(END),
    ).cast("binary")


def write_archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html",
                  min_revisit: int = 100, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write ``path/payloads`` (digest, payload) and ``path/headers`` (key, digest, header)."""
    records = pages.select(
        F.col(key).alias("key"), F.col(url).alias("url"),
        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    # copies of a payload are dropped on the map side first, so one copy a task is shuffled
    records.groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads", compression="zstd")
    lines = records.select("key", "url", "digest", F.octet_length("payload").alias("n"))
    firsts = lines.filter(F.col("n") >= min_revisit).groupBy("digest").agg(F.min("key").alias("first_key"))
    revisit = F.col("first_key").isNotNull() & ~F.col("key").eqNullSafe(F.col("first_key"))
    (
        lines.join(firsts, "digest", "left")
        .withColumn("record_type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")))
        .withColumn("refers_to", F.when(revisit, F.col("first_key")))
        .select("key", "digest", _header(date).alias("header"))
        .write.parquet(f"{path}/headers", compression="zstd")
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The original records: ``key, header, payload, record`` (header, payload and the two closing line breaks).

    A payload that is missing or differs from its digest fails the job, so no record is left out silently."""
    stored = spark.read.parquet(f"{path}/payloads").withColumn(
        "payload",
        F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload"))
        .otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest "), F.col("digest"))).cast("binary")))
    return (
        spark.read.parquet(f"{path}/headers").join(stored, "digest", "left")
        .withColumn("payload", F.coalesce("payload", F.raise_error(F.concat(F.lit("no payload has the digest "), F.col("digest"))).cast("binary")))
        .select("key", "header", "payload", F.concat("header", "payload", F.lit((END * 2).encode())).alias("record"))
    )


def record_fields(record: Column, header: Column) -> dict[str, Column]:
    """Fields of a rebuilt record, read from its bytes."""
    text = header.cast("string")
    n = F.regexp_extract(text, r"\r\nContent-Length: (\d+)\r\n", 1).cast("int")
    refers = F.regexp_extract(text, r"\r\nWARC-Refers-To: <urn:page:([^>]*)>\r\n", 1)
    return {
        "payload_bytes": n.cast("bigint"),
        "payload": F.substring(record, F.octet_length(header) + 1, n),
        "record_type": F.regexp_extract(text, r"\r\nWARC-Type: (\w+)\r\n", 1),
        "refers_to": F.when(refers != "", refers),
    }
