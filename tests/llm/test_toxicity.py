import random
import zlib

from helpers import docs
from pyspark.sql import functions as F

from landstrata.llm import toxicity

BAD = ["scum", "idiot", "moron"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        text, toxic = rng.choices(words, k=rng.randint(20, 80)), int(rng.random() < 0.25)
        if toxic:
            for _ in range(rng.randint(2, 5)):
                text.insert(rng.randrange(len(text)), rng.choice(BAD) if rng.random() < 0.8 else "achlich" + rng.choice(words))
        rows.append((i, " ".join(text)))
        labels.append((i, toxic))
    return rows, labels


def label_table(spark, labels):
    return spark.createDataFrame([(*r, "en", 0.5) for r in labels], "doc_id bigint, toxic int, lang string, score double")


def test_held_out_accuracy_and_edge_rows(spark):
    rows, labels = corpus(900)
    odd = [(5000, None), (5001, ""), (None, "you idiot scum moron idiot scum moron"), (5002, " ".join(["clean"] * 50_000)), (rows[3][0], rows[3][1]), (5003, "\n"), (5004, "😀!!!")]
    scored = toxicity.score(docs(spark, rows + odd, "x int, features string, label string, role int"), label_table(spark, labels + [(1, None), (None, 1), (labels[0][0], labels[0][1])]))
    got = scored.select("doc_id", "score", toxicity.held_out(F.col("doc_id")).alias("held")).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in got)
    for r in got:
        assert r["held"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    truth = dict(labels)
    held = [(r["score"] >= 0.5) == bool(truth[r["doc_id"]]) for r in got if r["held"] and r["doc_id"] in truth]
    assert sum(held) / len(held) > 0.95
    assert all(r["score"] < 0.5 for r in got if r["doc_id"] in (5000, 5001, 5002, 5003, 5004)) and next(r for r in got if r["doc_id"] is None)["score"] > 0.5
    assert len({r["score"] for r in got if r["doc_id"] in (5000, 5001)}) == 1
    assert len({r["score"] for r in got if r["doc_id"] == rows[3][0]}) == 1


def test_held_out_labels_are_never_read(spark):
    _, labels = corpus(200)
    drawn = toxicity.sample_labels(label_table(spark, labels + labels[:20]), 100)
    ids = [r["id"] for r in drawn.collect()]
    assert len(ids) == len(set(ids)) == 100 and all(zlib.crc32(str(i).encode()) % 5 for i in ids)


def test_one_row_of_a_labelled_id_is_learnt_from(spark, monkeypatch):
    dense = spark.range(0, 900, 1, 6).selectExpr("id % 30 AS doc_id", "hash(id) * 1L AS text_key", "array(CAST(id AS double)) AS x")
    part = F.broadcast(spark.createDataFrame([(i, i % 2, 4) for i in range(20)], "doc_id bigint, toxic int, role int"))
    got = toxicity.training_rows(dense, part)
    least = {r["doc_id"]: r["x"] for r in dense.groupBy("doc_id").agg(F.min_by("x", "text_key").alias("x")).collect()}
    assert sorted((r["doc_id"], r["x"], r["toxic"]) for r in got.collect()) == [(i, least[i], i % 2) for i in range(20)]
    plan = got._jdf.queryExecution().toString()
    assert got.rdd.getNumPartitions() == 2 and "RoundRobinPartitioning(2)" in plan and "Coalesce " not in plan

    rows, labels = corpus(300)
    again = [(i, " ".join(reversed(t.split()))) for i, t in rows[:5] for _ in range(100)]
    written = []
    monkeypatch.setattr(toxicity, "scratch_path", lambda s, name, f=toxicity.scratch_path: written.append((name, f(s, name))) or written[-1][1])
    scored = toxicity.score(docs(spark, rows + again), label_table(spark, labels))
    assert scored.count() == 800
    learnt = [spark.read.parquet(path).count() for name, path in written if name in ("lexicon-texts", "training")]
    assert sum(learnt) == sum(zlib.crc32(str(i).encode()) % 5 > 0 for i, _ in labels)


def test_without_labels_or_rows(spark):
    rows, labels = corpus(40)
    none = toxicity.score(docs(spark, rows), label_table(spark, []))
    assert {r["score"] for r in none.collect()} == {0.0} and none.count() == 40
    clean = toxicity.score(docs(spark, rows), label_table(spark, [(i, 0) for i, _ in labels]))
    assert {r["score"] for r in clean.collect()} == {0.0}
    assert toxicity.score(docs(spark, []), label_table(spark, labels)).count() == 0


def test_features():
    f = toxicity.Featurizer({"scum.": 4.0, "idiot.": 3.5, "achlich": 2.0})
    plain = f("a calm text about rivers and mills")
    bad = f("You SCUM, you 1d10t! achlichkeit")
    assert len(plain) == len(bad) == toxicity.FEATURES and plain[1] == 0 and bad[1] > 0 and bad[4] > 0 and bad[9] > 0 and bad[15] > 0 and bad[11] > plain[11]
    assert f("") == f("  ")[:13] + f("")[13:]


def test_features_of_long_tokens_take_linear_time():
    import re
    import time

    featurize = toxicity.Featurizer({"idiot.": 4.0, "moron": 2.0})
    for token in ("a" + "1" * 5_000_000, "1" * 5_000_000, "x" * 5_000_000, "@_" * 2_500_000 + "a"):
        start = time.perf_counter()
        featurize(token)
        assert time.perf_counter() - start < 5
    slow = re.compile(r"(?<!\S)(?=\S*[^\W\d_])(?=\S*[0-9@$*!|]\S*[^\W\d_])\S+")
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choices("aé1٣@_ .!\n\t-Z", k=rng.randint(0, 14)))
        assert toxicity._MIXED.findall(text) == slow.findall(text), text


def test_labels_without_documents_are_not_drawn(spark):
    _, labels = corpus(200)
    ids = spark.range(50, 60).toDF("id")
    drawn = toxicity.sample_labels(label_table(spark, labels), 5, ids=ids).collect()
    assert len(drawn) == 5 and all(50 <= r["id"] < 60 for r in drawn)
