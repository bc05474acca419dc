import zlib
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import docs
from tokenizers import Tokenizer

from landstrata.llm import packing

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [
    "", " ", "  a", "a  ", "\n\n x\n y", "a b  c", "it's we'll I'VE 's x' 's", "x²½Ⅷ ª º µ", "naïve café ½ 12a3 _x_ __ 3.14,5", "日本語 テキスト 😀😀", "a b\x1cc\x85d\xa0e",
    "<|endoftext|> x", "\t\ttab x \n", "é combining", "… — “q” ‘’ €", "a\r\nb \r\n c", "The quick brown fox\njumps over, the (lazy) dog. " * 400,
    "ß Ü ü ÄÖ ñ¿¡ «x»", "a b ​ c", "x" * 5000, "THE!! A!! %%% $$$ ###", "퟿ ",
]


def ids_of(text):
    t = Tokenizer.from_file(FILES[0])
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids + [0]


def run(spark, rows, size=1024):
    return packing.pack(docs(spark, rows, "part int, local int, length string, ids int"), *FILES, size=size).collect()


def check(rows, got, size):
    want = Counter()
    for i, t in rows:
        want[i, np.array(ids_of(t), "<u4").tobytes()] += 1
    pieces = {}
    for r in got:
        assert r["length"] == len(r["ids"]) // 4 > 0 and r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    if len({i for i, _ in rows}) == len(rows):
        for (i, n), parts in pieces.items():
            parts.sort(key=lambda r: r["start"])
            assert [r["start"] for r in parts] == list(np.cumsum([0, *[r["length"] for r in parts]])[:-1])
            assert want[i, b"".join(bytes(r["ids"]) for r in parts)] == 1 and sum(r["length"] for r in parts) == n
    assert sum(r["length"] for r in got) == sum(len(b) // 4 * n for (_, b), n in want.items())
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences)


def test_ids_pieces_and_sequences(spark):
    rows = list(enumerate([None, *TEXTS])) + [(None, "no id")]
    check(rows, run(spark, rows), 1024)


def test_small_sequences_have_little_padding(spark):
    rows = [(i, "word and more, " * (i % 37)) for i in range(400)]
    n = check(rows, run(spark, rows, 32), 32)
    tokens = sum(len(ids_of(t)) for _, t in rows)
    assert n <= -(-tokens // 32) * 1.05


def test_repeated_rows_and_no_rows(spark):
    rows = [(1, "same text " * 300)] * 40 + [(2, None)] * 5
    check(rows, run(spark, rows), 1024)
    assert run(spark, []) == []


def test_plan_uses_the_histogram_up_and_never_overfills():
    rng = np.random.default_rng(0)
    for size in (8, 100, 1024):
        histogram = {int(n): int(c) for n, c in zip(rng.integers(1, size + 1, 60), rng.integers(1, 10**9, 60))}
        patterns = packing.plan(histogram, size)
        used = Counter()
        for lengths, count in patterns:
            assert sum(lengths) <= size and count > 0
            for n in lengths:
                used[n] += count
        assert used == histogram
        assert len(patterns) <= 2 * len(histogram) + size
    assert packing.plan({}, 10) == []


def test_remembered_words_do_not_change_ids(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 3)
    encoder = packing.ByteBpe(*FILES)
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() + [0] for b in encoder.encode(TEXTS)] == [ids_of(t) for t in TEXTS]


@pytest.mark.parametrize("words", [1, 40, 3000])
def test_a_worker_encodes_little_at_once_and_gives_memory_back(monkeypatch, words):
    """A batch of wide texts is encoded in parts of bounded size, and the freed memory is returned behind each batch."""
    seen, back = [], []

    class Encoder:
        def encode(self, texts):
            seen.append([len(t) for t in texts])
            return [array("I", range(t.count(" "))).tobytes() for t in texts]

    monkeypatch.setattr(packing, "give_back", lambda: back.append(len(seen)))
    texts = ["word " * (words * (i % 3)) for i in range(400)] + [None, "long " * 200_000, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    rows = [r for b in packing.cut(iter([batch, batch]), Encoder(), 3, 1024, np.array([0], "<u4").tobytes()) for r in b.to_pylist()]
    assert [n for part in seen for n in part] == [len(t or "") for t in texts] * 2
    assert all(sum(part[:-1]) < 250_000 for part in seen)
    assert back == [len(seen) // 2, len(seen)]
    assert sum(r["length"] for r in rows) == 2 * sum((t or "").count(" ") + 1 for t in texts)
    assert {(r["length"], r["local"]) for r in rows} == {(n, i) for n, c in Counter(r["length"] for r in rows).items() for i in range(c)}
