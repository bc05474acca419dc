"""Corpus pipeline over ``documents``: each stage is one operator of ``landstrata.llm``, written as Parquet and read again.

toxicity drops documents scored 0.5 or more; near_duplicates keeps one document of each group (five-word shingles, 0.8);
decontamination drops documents that hold a benchmark item; secrets replaces each secret by a mark; packing cuts and
packs the token ids. Decisions hold for a document's id and text, so rows that share an id but not the text are judged
apart, and rows without an id are judged like others. A null text is empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landstrata.llm import decontam, jaccard, packing, secrets, toxicity
from landstrata.llm._joins import shipped_if_small
from landstrata.session import scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _rows(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, hash of the text) is (left_semi) or is not (left_anti) among ``keys``."""
    keys = shipped_if_small(keys).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key"))
    return docs.select(*COLUMNS).join(keys, same, how)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    scored = toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _rows(docs, _stored(scored.filter("score >= 0.5").select("doc_id", "text_key").distinct(), "toxic"), "left_anti")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays (one without id only if none has any), and
    of rows that repeat it one. Documents without words stay."""
    placed = jaccard.link_documents(docs, k=5, percent=80).filter("group IS NOT NULL")
    rows = _stored(placed.groupBy("group", "doc_id", "text_key").agg(F.count("*").alias("n")), "placed")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    best = rows.groupBy("group").agg(F.min(order).alias("best"))
    ranked = rows.join(best, "group").withColumn("stays", order.eqNullSafe(F.col("best")))
    gone = _stored(ranked.filter("NOT stays").select("doc_id", "text_key"), "gone")
    again = _stored(ranked.filter("stays AND n > 1").select("doc_id", "text_key"), "repeated")
    if again.isEmpty():
        return _rows(docs, gone, "left_anti")
    once = _rows(docs, again, "left_semi").dropDuplicates(["doc_id", "text"])
    dropped = _stored(gone.unionByName(again), "dropped")
    return _rows(docs, dropped, "left_anti").unionByName(once)


def reject_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, asked anew or word by word, go."""
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64("text").cast("string"))
    found = decontam.contaminated(docs.withColumn("row_key", key), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc="row_key")
    hit = _stored(found.select(F.col("doc_id").alias("_key")).distinct(), "contaminated")
    return docs.select(*COLUMNS).join(shipped_if_small(hit), key == F.col("_key"), "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts become a mark; every document stays."""
    marked = secrets.scan(docs.select(*COLUMNS)).withColumn("marked", secrets.redact(F.col("text"), F.col("spans")))
    n_chars = F.when(F.size("spans") > 0, F.length("marked").cast("bigint")).otherwise(F.col("n_chars"))
    return marked.withColumn("n_chars", n_chars).withColumn("text", F.col("marked")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in pieces, each with its sequence and offset."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", one_of_each_group),
    ("decontamination", reject_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Learnt scores and token ids have no SQL form; tests compare with a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = _stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
