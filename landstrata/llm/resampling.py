"""Importance resampling towards a target distribution over hashed n-grams.

Words of a text are joined by single spaces and every run of up to ``n`` words is a feature. Its bucket is its CRC-32 modulo
the number of buckets. A bucket's gain is the scaled log ratio of its smoothed shares in target and source; a document's
weight is the floored mean of its features' gains, and Gumbel noise from a hash of its id turns the highest scores
into a sample without replacement.

CRC-32 without its initial and final values is linear: a message's value is the XOR of one contribution per byte that
depends only on the byte and its distance from the end. A position table holds these contributions for distances below
``SPAN``. Features of one length whose first words are a multiple of that length apart do not overlap, so they tile the text:
their bytes' contributions are looked up together and folded by ``bitwise_xor.reduceat`` over the spans; a constant per length
puts initial and final values back. Longer spans are cut into blocks of SPAN bytes from the end, and neighbouring blocks
fold pairwise, the left one shifted over the bytes of the right one.

Two scans read the texts, one for the source's bucket counts and one for weights. What is shipped has one number a bucket.

Defined cases: a null text or one without words has no features, weight 0 and is never drawn; a null id reads as an empty text
in the noise and comes last among ties; repeated rows are drawn one by one; texts of any length are read whole; other columns
are ignored; an empty target gives every bucket its smoothed share; no rows give no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landstrata.operators.ranks import global_rank
from landstrata.session import scratch_path

from . import _text

SPAN = 64  # bytes that the position table covers
SCALE = 1000
_POLYNOMIAL = 0xEDB88320  # fixed value: CRC-32, reflected
_shifts: list = []

#: Bytes of words: digits, letters, and all bytes of characters beyond ASCII.
MEMBER = np.zeros(256, bool)
MEMBER[48:58] = MEMBER[65:91] = MEMBER[97:123] = MEMBER[128:] = True


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(_POLYNOMIAL), c >> 1)
    return c


_BYTE = _byte_table()


def _position_table() -> np.ndarray:
    """Contribution of byte b at distance d from the end, at d * 256 + b."""
    rows = [_BYTE]
    for _ in range(SPAN - 1):
        rows.append(_BYTE[rows[-1] & 255] ^ (rows[-1] >> 8))
    return np.concatenate(rows)


_POSITION = _position_table()
_CONSTANT = np.array([zlib.crc32(bytes(n)) for n in range(SPAN + 1)], np.uint32)


def _shifted(x: np.ndarray, level: int) -> np.ndarray:
    """Values moved over SPAN * 2**level zero bytes; an operator is four tables, one for each byte of a value."""
    while len(_shifts) <= level:
        one = np.arange(256, dtype=np.uint32)
        tables = [one << np.uint32(8 * j) for j in range(4)]
        if _shifts:
            twice = len(_shifts) - 1
            tables = [_shifted(_shifted(t, twice), twice) for t in tables]
        else:
            for _ in range(SPAN):
                tables = [_BYTE[t & 255] ^ (t >> 8) for t in tables]
        _shifts.append(tables)
    t = _shifts[level]
    return t[0][x & 255] ^ t[1][(x >> 8) & 255] ^ t[2][(x >> 16) & 255] ^ t[3][x >> 24]


def _contributions(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XOR of the contributions of each span of at most SPAN bytes; spans may lie anywhere but are not empty."""
    n = ends - starts
    first = np.cumsum(n) - n
    at = np.arange(int(n.sum()), dtype=np.int64)
    byte = data[at + np.repeat(starts - first, n)]
    distance = np.repeat(first + n - 1, n) - at
    return np.bitwise_xor.reduceat(_POSITION[(distance << 8) + byte], first)


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of the bytes of each span."""
    n = ends - starts
    out = np.empty(len(n), np.uint32)
    short = n <= SPAN
    if short.any():
        out[short] = _contributions(data, starts[short], ends[short]) ^ _CONSTANT[n[short]]
    if not short.all():
        long = np.flatnonzero(~short)
        blocks = -(-n[long] // SPAN)
        owner = np.repeat(long, blocks)
        from_end = np.repeat(np.cumsum(blocks), blocks) - 1 - np.arange(len(owner))  # the block's number from the end
        stop = ends[owner] - from_end * SPAN
        value, level = _contributions(data, np.maximum(stop - SPAN, starts[owner]), stop), 0
        while blocks.max() > 1:
            even = blocks + (blocks & 1)
            padded = np.zeros(int(even.sum()), np.uint32)  # a zero block in front changes nothing
            place = np.arange(len(value)) + np.repeat(np.cumsum(even) - np.cumsum(blocks), blocks)
            padded[place] = value
            value, blocks, level = _shifted(padded[0::2], level) ^ padded[1::2], even // 2, level + 1
        lengths, which = np.unique(n[long], return_inverse=True)
        out[long] = value ^ np.array([zlib.crc32(bytes(int(m))) for m in lengths], np.uint32)[which]
    return out


def _features(texts: pa.Array, n: int, buckets: int):
    """(first row, words per row, [(buckets, rows) of the features of one tiling]) for successive parts of a column."""
    for at, data, offsets in _text.slices(texts):
        rows = len(offsets) - 1
        starts, ends, row = _text.runs(MEMBER[data], offsets)
        length = ends - starts
        first = np.cumsum(length + 1) - (length + 1)  # words in a buffer of their own, a space behind each
        line = np.full(int(length.sum()) + len(length), 32, np.uint8)
        within = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        line[np.repeat(first, length) + within] = _text.LOWER[data[np.repeat(starts, length) + within]]
        last = first + length

        def tilings():
            for words in range(1, n + 1):
                for phase in range(words):
                    i = np.arange(phase, len(first) - words + 1, words)
                    i = i[row[i] == row[i + words - 1]]
                    if len(i):
                        yield (crc32_spans(line, first[i], last[i + words - 1]) % np.uint32(buckets)).astype(np.int64), row[i]

        yield at, np.bincount(row, minlength=rows), tilings()
    _text.give_back()


def bucket_counts(docs: DataFrame, n: int, buckets: int, text: str = "text") -> np.ndarray:
    """Features of all texts in each bucket; a task sends one row a bucket."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, tilings in _features(batch.column(0), n, buckets):
                for bucket, _ in tilings:
                    total += np.bincount(bucket, minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    found = docs.select(F.col(text).alias("text")).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in found.collect():  # at most one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Scaled log ratio of each bucket's share in target and source, every bucket counted once more."""
    s, t, buckets = source.astype(float), target.astype(float), len(source)
    return np.floor(SCALE * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, n: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight``: floored mean gain of each row's features."""
    def run(batches):
        for batch in batches:
            for at, words, tilings in _features(batch.column(1), n, len(gain)):
                total, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
                for bucket, row in tilings:
                    of, first = np.unique(row, return_index=True)  # rows ascend
                    total[of] += np.add.reduceat(gain[bucket], first)
                    count += np.bincount(row, minlength=len(words))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(words)), pa.array(words.astype(np.int64)), pa.array(count), pa.array(total // np.maximum(count, 1))],
                    ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(doc: Column, seed: int) -> Column:
    """Gumbel noise of an id, scaled and floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, n: int = 2, buckets: int = 10_000, seed: int = 7,
             doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank``: of the documents with ``least_words`` words or more the given
    percentage is drawn by score, ties to the smaller id; ``rank`` is null for the others."""
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, n, buckets, text), bucket_counts(target, n, buckets))
    path = scratch_path(spark, "scores")
    weigh(docs, gain, n, doc, text).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).write.parquet(path)
    rows = spark.read.parquet(path)
    fits = F.col("n_words") >= least_words
    draw = percent * rows.filter(fits).count() // 100
    order = [F.when(fits, 0).otherwise(1), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    place = global_rank(rows, order, "place")
    return place.select("doc_id", "n_words", "n_features", "weight", "score", F.when(fits & (F.col("place") <= draw), F.col("place")).alias("rank"))
