"""Sequence packing: shortest pack first over the histogram of lengths.

Documents become token ids and a closing id, cut at every ``size`` ids; what is left over is a shorter piece. Pieces with
ids and a checksum are written once, numbered per length inside each task. The histogram of lengths, at most ``size``
numbers, is all that packing needs: lengths are placed longest first into the packs that are shortest so far, and what
is kept is a count per pattern of lengths. Pieces get their rank among the pieces of their length and find their place in the patterns by it.

Defined cases: a null text is empty and consists of the closing id; rows that repeat an id are packed each; a null id
stays null; other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from landstrata.session import scratch_path

from ._text import give_back

CACHE = 250_000  # remembered strings of a Python worker, some 50 MB
CHARS = 250_000  # encoded at once, or one longer text; what the tokenizer makes of them takes some fifty times the room
_tokenizers: dict = {}

#: Letters whose class no Unicode version changes; texts with others are split by the tokenizer itself.
_PLAIN = re.compile(r"[\t\n\r -~¡-©«¬®-±´-¸»¿-ɏ‐-‧€]*")
_WORD_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space that touches a space.
_LOOSE = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")


class ByteBpe:
    """Ids of a byte-level BPE file as little-endian 32-bit bytes; strings between spaces are remembered.

    ``ranks`` holds the same vocabulary as ranks: it serves single words of plain letters, where the ids are the same and
    come faster. All other texts go through the tokenizer file.
    """

    def __init__(self, path: str, ranks: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.words = Encoding("words", pat_str=_WORD_PATTERN, mergeable_ranks=table, special_tokens={})
        self.known: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        out, other = [b""] * len(texts), []
        if len(self.known) > CACHE:
            self.known.clear()
        for i, text in enumerate(texts):
            if not _PLAIN.fullmatch(text) or any(x in text for x in _LOOSE) or text[:1] == " " or text[-1:] == " ":
                other.append(i)
                continue
            # no space touches another one, so no word of the pattern crosses the start of " x"
            first, *rest = text.split(" ")
            out[i] = self._word(first) + self._joined(rest)
        for i, ids in zip(other, self._encode([texts[i] for i in other])):
            out[i] = ids
        return out

    def _joined(self, words: list[str]) -> bytes:
        known = self.known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            for x in words:
                if x not in known:
                    known[x] = self._word(" " + x)
            return b"".join(map(known.__getitem__, words))

    def _word(self, text: str) -> bytes:
        return array("I", self.words.encode_ordinary(text)).tobytes()


def tokenizer(path: str, ranks: str) -> ByteBpe:
    """One per Python worker and file."""
    if path not in _tokenizers:
        _tokenizers[path] = ByteBpe(path, ranks)
    return _tokenizers[path]


def cut(batches, encoder, part: int, size: int, closing: bytes):
    """Record batches of the pieces of (id, text) batches, from CHARS characters at a time; memory goes back after each batch."""
    count = np.zeros(size + 1, np.int64)
    for batch in batches:
        names, texts = batch.column(0), batch.column(1)
        at = 0
        while at < len(texts):
            chunk, chars, to = [], 0, at
            while to < len(texts) and chars < CHARS:
                chunk.append(texts[to].as_py() or "")
                chars += len(chunk[-1])
                to += 1
            rows: list = [[] for _ in range(8)]
            for name, ids in zip(names.slice(at, to - at).to_pylist(), encoder.encode(chunk)):
                ids += closing
                for s in range(0, len(ids), 4 * size):
                    piece = ids[s : s + 4 * size]
                    n = len(piece) // 4
                    for column, x in zip(rows, (name, s // 4, n, len(ids) // 4, piece, zlib.crc32(piece), part, int(count[n]))):
                        column.append(x)
                    count[n] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(rows, [pa.int64()] * 4 + [pa.binary(), pa.int64(), pa.int32(), pa.int64()])],
                ["doc_id", "start", "length", "doc_tokens", "ids", "ids_crc32", "part", "local"])
            at = to
        del batch, names, texts
        give_back()


def pieces(docs: DataFrame, vocabulary: str, ranks: str, size: int, end: int, doc: str, text: str) -> DataFrame:
    """``doc_id, start, length, doc_tokens, ids, ids_crc32, part, local``: the cut documents, ``local`` counts per task and length."""
    closing = np.array([end], "<u4").tobytes()

    def run(batches):
        yield from cut(batches, tokenizer(vocabulary, ranks), TaskContext.get().partitionId(), size, closing)

    return docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary, ids_crc32 bigint, part int, local bigint")


def plan(histogram: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Patterns of lengths and how often each is used; shortest pack first, longest lengths first."""
    open_: dict[int, list[tuple[list[int], int]]] = {}  # patterns by space left
    done: list[tuple[list[int], int]] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            space = max((s for s in open_ if s >= length), default=None)
            if space is None:
                lengths, count, space = [], left, size
            else:
                lengths, count = open_[space].pop()
                if not open_[space]:
                    del open_[space]
                if count > left:
                    open_.setdefault(space, []).append((lengths, count - left))
                    count = left
            left -= count
            grown = ([*lengths, length], count)
            if space == length:
                done.append(grown)
            else:
                open_.setdefault(space - length, []).append(grown)
    return done + [p for s in sorted(open_) for p in open_[s]]


def places(patterns: list[tuple[list[int], int]], size: int) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, first sequence, offset): ranks from one row's to the next's fill one slot of a pattern."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for lengths, count in patterns:
        offset = 0
        for n in lengths:
            slots.setdefault(n, []).append((used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + count
            offset += n
        sequence += count
    return {n: np.array(rows, np.int64) for n, rows in slots.items()}


def pack(docs: DataFrame, vocabulary: str, ranks: str, size: int = 1024, end: int = 0, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, ids, ids_crc32, sequence_id, offset``."""
    spark = docs.sparkSession
    path = scratch_path(spark, "pieces")
    pieces(docs, vocabulary, ranks, size, end, doc, text).write.parquet(path, compression="zstd")
    cut = spark.read.parquet(path)
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = scratch_path(spark, "ranks")
    counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")).write.parquet(first)
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    table = places(plan(histogram, size), size)

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = np.empty((len(length), 2), np.int64)
        n, r = length.to_numpy(), rank.to_numpy()
        for value in np.unique(n):
            rows = np.flatnonzero(n == value)
            slot = table[int(value)]
            at = np.searchsorted(slot[:, 0], r[rows], "right") - 1
            out[rows, 0] = slot[at, 1] + r[rows] - slot[at, 0]
            out[rows, 1] = slot[at, 2]
        return pd.DataFrame({"sequence_id": out[:, 0], "offset": out[:, 1]})

    ranked = cut.join(spark.read.parquet(first), ["part", "length"]).withColumn("at", place("length", F.col("local") + F.col("first")))
    return ranked.select("doc_id", "start", "length", "doc_tokens", "ids", "ids_crc32", "at.sequence_id", "at.offset")
