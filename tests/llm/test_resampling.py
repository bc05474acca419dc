import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import ASCII_LOWER, docs
from test_jaccard import families

from landstrata.llm import resampling

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, n):
    words = WORDS.findall((text or "").translate(ASCII_LOWER))
    return len(words), [" ".join(words[i:i + m]) for m in range(1, n + 1) for i in range(len(words) - m + 1)]


def brute_force(rows, target, percent, least, n, buckets, seed):
    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for f in features(t, n)[1]:
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out

    s, t = counts(x for _, x in rows), counts(target)
    gain = [math.floor(1000 * math.log(float((y + 1) * (sum(s) + buckets)) / float((x + 1) * (sum(t) + buckets)))) for x, y in zip(s, t)]
    out = []
    for i, text in rows:
        words, found = features(text, n)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for place, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[5] = place
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("n, buckets, percent, least", [(2, 10_000, 25, 20), (1, 7, 100, 1), (3, 100, 50, 5)])
def test_equals_brute_force(spark, n, buckets, percent, least):
    long = " ".join(f"Wort{i % 997}" for i in range(30_000))
    rows = [(i, t) for i, t in enumerate(families(5, 40))]
    rows += [(9001, None), (9002, ""), (9003, " .,! "), (9004, "Ünï çode 12ab-34 日本語のとても長い単語" * 9), (9005, long), (9006, "z" * 70_001 + " end"), (None, "no id " * 20),
             (None, "no id " * 20), (9007, "same id " * 30), (9007, "same id " * 30), (9007, "other text of it " * 30)]
    target = [t for _, t in rows[:60:7]] + [None, "a word more"]
    items = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = resampling.resample(docs(spark, rows, "score int, rank string, n_words int, place int"), items, percent, least, n, buckets, 7).collect()
    assert sorted(map(tuple, got), key=repr) == brute_force(rows, target, percent, least, n, buckets, 7)


def test_empty_tables(spark):
    none = docs(spark, [])
    assert resampling.resample(none, none).collect() == []
    rows = [(i, "word " * 30) for i in range(8)]
    got = resampling.resample(docs(spark, rows), none).collect()
    assert sorted(map(tuple, got), key=repr) == brute_force(rows, [], 25, 20, 2, 10_000, 7)


def test_spans_of_all_lengths_equal_the_library_crc():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 300_000).astype(np.uint8)
    n = np.concatenate([np.arange(1, 700), rng.integers(1000, 40_000, 40)])
    starts = rng.integers(0, 250_000, len(n))
    want = [zlib.crc32(data[a:a + m].tobytes()) for a, m in zip(starts.tolist(), n.tolist())]
    assert resampling.crc32_spans(data, starts, starts + n).tolist() == want
    assert resampling.crc32_spans(data, starts[:0], n[:0]).tolist() == []


def test_features_do_not_depend_on_the_slice(monkeypatch):
    texts = pa.array(["a b c", None, "", "é ü ß" * 50, "long" * 400 + " tail", "A-b.C"])

    def found():
        out = {}
        for at, _, tilings in resampling._features(texts, 2, 1 << 31):
            for bucket, row in tilings:
                for b, r in zip(bucket.tolist(), row.tolist()):
                    out.setdefault(at + r, []).append(b)
        return {r: sorted(b) for r, b in out.items()}

    whole = found()
    monkeypatch.setattr(resampling._text, "SLICE", 16)
    assert found() == whole and sorted(whole) == [0, 3, 4, 5]
