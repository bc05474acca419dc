import hashlib

import pytest
from pyspark.sql import functions as F

from landstrata.llm import warc
from landstrata.session import scratch_path

BIG, SMALL = "<p>é😀</p>" * 20, "<p>x</p>"


def archive(spark, rows):
    pages = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id bigint, url string, html string, digest string, payload int")
    path = scratch_path(spark, "warc-test")
    warc.write_archive(pages, path)
    return path


def fields(spark, path):
    field = warc.record_fields(F.col("record"), F.col("header"))
    return warc.read_archive(spark, path).select("key", "header", "record", "payload", *[c.alias("f_" + n) for n, c in field.items()])


def test_records_come_back_byte_by_byte(spark):
    rows = [(5, "http://a", BIG), (3, "http://b", BIG), (9, None, BIG), (1, "u", SMALL), (2, "u", SMALL), (7, "x\r\ny", None), (8, "z", ""),
            (None, "n", BIG), (3, "again", BIG), (11, "long", "y" * 300_000)]
    path = archive(spark, rows)
    got = fields(spark, path).collect()
    assert len(got) == len(rows)
    texts = {}
    for k, _, h in rows:
        texts.setdefault(k, set()).add((h or "").encode())
    for r in got:
        body = bytes(r["f_payload"])
        assert body in texts[r["key"]] and r["f_payload_bytes"] == len(body)
        assert bytes(r["record"]) == bytes(r["header"]) + body + b"\r\n\r\n" and bytes(r["header"]).endswith(b"\r\n\r\n")
        assert hashlib.sha256(body).hexdigest().encode() in bytes(r["header"]) and bytes(r["header"]).count(b"\r\n\r\n") == 1
    kind = {(r["key"], r["f_record_type"], r["f_refers_to"]) for r in got}
    assert kind == {(5, "revisit", "3"), (3, "response", None), (9, "revisit", "3"), (1, "response", None), (2, "response", None),
                    (7, "response", None), (8, "response", None), (None, "revisit", "3"), (11, "response", None)}


def test_a_payload_is_stored_once(spark):
    path = archive(spark, [(i, "u", BIG) for i in range(50)] + [(60, "u", SMALL), (61, "u", None)])
    assert spark.read.parquet(f"{path}/payloads").count() == 3 and spark.read.parquet(f"{path}/headers").count() == 52


def test_damaged_payload_is_noticed(spark):
    path = archive(spark, [(1, "u", BIG)])
    stored = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"other")).collect()
    spark.createDataFrame(stored, "digest string, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_archive(spark, path).collect()


def test_empty_table(spark):
    assert fields(spark, archive(spark, [])).count() == 0


def test_a_missing_payload_fails(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 200), (2, "v", "x" * 200), (3, "w", "y")], "page_id bigint, url string, html string")
    path = scratch_path(spark, "broken")
    warc.write_archive(pages, f"{path}/whole")
    spark.read.parquet(f"{path}/whole/headers").write.parquet(f"{path}/less/headers")
    spark.read.parquet(f"{path}/whole/payloads").filter("length(payload) > 1").write.parquet(f"{path}/less/payloads")
    with pytest.raises(Exception, match="no payload has the digest"):
        warc.read_archive(spark, f"{path}/less").collect()
