"""The pipeline's stages on a small corpus, against what each is to keep."""

import re

import corpus_pipeline as cp
import pytest
from helpers import groups, shingle_set
from pyspark.sql import functions as F

from landstrata.session import scratch_path

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
HEX = "0123456789abcdef" * 2


@pytest.fixture(scope="module")
def corpus(spark):
    path = scratch_path(spark, "pipeline-test")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = spark.read.parquet(f"{LARGER}/labels.parquet").filter("toxic = 1 AND doc_id >= 200")  # enough to learn from
    docs = docs.unionByName(spark.read.parquet(f"{LARGER}/documents.parquet").join(toxic, "doc_id", "left_semi"))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    base = " ".join(f"river{i} stone" for i in range(60))
    rows = [(9001, base), (9002, base + " more"), (9003, base), (None, base), (9003, base), (9004, f"A tale. {item} The end."), (9005, f"token = {HEX} of mine {base[:200]}"),
            (9006, None), (9007, ""), (9007, ""), (9008, "scum idiot moron trash loser stupid clown " * 5), (None, "a text that has no id and no twin in this table at all"),
            (None, "this one has no id and a twin"), (None, "this one has no id and a twin"), (9003, "the same id but quite another text than the others with it")]
    added = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    both = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(added).withColumn("doc", F.lit(1)).withColumn("hash", F.lit("x"))
    both.write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").unionByName(toxic).write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, corpus):
    docs, out = spark.read.parquet(f"{corpus}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        path = scratch_path(spark, f"test-{name}")
        stage(spark, docs, corpus).write.parquet(path)
        out[name] = (docs, spark.read.parquet(path))
        docs = out[name][1]
    return out


def rows(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=repr)


def test_columns(stages):
    for name, (_, out) in list(stages.items())[:-1]:
        assert out.columns == list(cp.COLUMNS), name


def test_toxic_documents_go(stages):
    before, after = map(rows, stages["toxicity"])
    gone = [r for r in before if r not in after]
    assert any(i == 9008 for i, _ in gone) and not any(i in (9001, 9005, 9006, 9007) for i, _ in gone)
    assert len(gone) < 0.5 * len(before) and all(before.count(r) == after.count(r) for r in after)


def test_one_document_of_each_group_stays(stages):
    before, after = map(rows, stages["near_duplicates"])
    sets = [shingle_set(t, 5) for _, t in before]
    best = {}
    for (i, t), s, g in zip(before, sets, groups(sets, 80)):
        if s:
            best[g] = min(best.get(g, (True, 0, "")), (i is None, i or 0, t if i is None else ""))
    want_ids = sorted(i for unnamed, i, _ in best.values() if not unnamed)
    words = [(i, t) for i, t in after if shingle_set(t, 5)]
    assert sorted(i for i, _ in words if i is not None) == want_ids
    assert sum(i is None for i, _ in words) == sum(unnamed for unnamed, *_ in best.values())
    assert [r for r in after if not shingle_set(r[1], 5)] == [r for r in before if not shingle_set(r[1], 5)]


def test_benchmark_passages_go(stages):
    before, after = map(rows, stages["decontamination"])
    gone = {i for i, t in before if (i, t) not in after}
    assert any(i == 9004 for i, _ in before)
    assert 9004 in gone and not gone & {9001, 9005, 9006, 9007} and len(gone) < 0.1 * len(before)


def test_secrets_are_marked_and_nothing_else(stages):
    before, after = stages["secrets"]
    old = {r["doc_id"]: r for r in before.filter("doc_id IS NOT NULL").collect()}
    new = after.filter("doc_id IS NOT NULL").collect()
    assert before.count() == after.count()
    for r in new:
        text = r["text"]
        if text is not None and "[SECRET]" in text:
            assert not re.search("[0-9a-f]{24}|AKIA[A-Z0-9]{16}", text) and r["n_chars"] == len(text)
        else:
            assert text == old[r["doc_id"]]["text"]
    assert any("[SECRET]" in (r["text"] or "") for r in new if r["doc_id"] == 9005)


def test_every_token_is_packed_once(stages):
    from test_packing import check

    before, after = stages["packing"]
    check([(r["doc_id"], r["text"]) for r in before.collect()], after.collect(), 1024)


def test_run_gives_the_stages_result(spark, corpus, stages):
    got = cp.run(spark, corpus)
    want = stages["packing"][1]
    assert got.columns == want.columns and got.count() == want.count()
    assert got.agg(F.sum("length")).first() == want.agg(F.sum("length")).first()
