"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Labels are learnt from a bounded sample of labelled documents outside the held-out fifth. The sample is split by a hash
of the id: one part yields a lexicon (words and word beginnings that toxic documents use more, with their log odds), one
trains the trees, one fits the calibration, so no part is judged on what it was learnt from. Features are densities of
the lexicon, its nearness to second-person words, capitals, punctuation and obfuscation; language, source, id and labels
are never among them. The trees' margin and the calibration are applied to every document.

Defined cases: a null text is empty; an empty text gets the score of a text without any sign of toxicity; rows that
repeat an id are scored each, and one of them is learnt from; a document is labelled toxic if any of its labels says so, null labels are ignored; a null
id is not held out; without labels of both kinds every score is the share of toxic labels (0 without labels); other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landstrata.session import scratch_path

from ._text import give_back

SAMPLE = 30_000  # labelled documents to learn from, at most
TERMS = 3_000  # entries of the lexicon, at most, chosen among ten times as many of the most frequent terms of toxic documents
STRONG, WEAK = 3.0, 1.4  # log odds
NEAR = 5  # words

#: Second-person words of the languages at hand.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen deiner euch euer eure ihr tu te toi ton ta tes vous votre vos "
    "tú ti tuyo tuya vosotros usted ustedes vuestro".split())
#: Signs that stand for letters.
_LETTERS = str.maketrans("0134578@$!|", "oieastbasil")
_WORD = re.compile(r"[^\W_]+")
#: What white space separates, if a letter follows on a sign or digit; possessive, so that a token is read once.
_MIXED = re.compile(r"(?<!\S)[^\s0-9@$*!|]*+[0-9@$*!|](?:[\d_]|[^\w\s])*+[^\W\d_]\S*+")
_SIZES = range(5, 10)  # lengths of word beginnings
FEATURES = 17


def held_out(doc: Column) -> Column:
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _terms(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    return {w + "." for w in words} | {w[:n] for w in words for n in _SIZES if len(w) >= n}


def sample_labels(labels: DataFrame, rows: int, doc: str = "doc_id", label: str = "toxic", ids: DataFrame | None = None) -> DataFrame:
    """``id, toxic, role`` of at most ``rows`` documents outside the held-out fifth, drawn by a hash of the id; with ``ids``
    (one column ``id``) only labels of these documents are drawn."""
    spark, path = labels.sparkSession, scratch_path(labels.sparkSession, "labels")
    known = labels.filter(F.col(label).isNotNull() & F.col(doc).isNotNull() & ~held_out(F.col(doc)))
    known = known.groupBy(F.col(doc).cast("bigint").alias("id")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    known = known if ids is None else known.join(ids, "id", "left_semi")
    drawn = known.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(rows)
    drawn.withColumn("role", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(10)).cast("int")).write.parquet(path)
    return spark.read.parquet(path)


def learn_lexicon(docs: DataFrame, sample: DataFrame, doc: str, text: str, terms: int = TERMS) -> dict[str, float]:
    """Log odds of words ("word.") and word beginnings among the toxic documents of roles 0 to 3."""
    def count(batches):
        seen = (Counter(), Counter())
        for batch in batches:
            for body, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[toxic].update(_terms(body or ""))
        keys = list(seen[1])  # terms of toxic documents only; of the clean ones the others are not asked for
        for at in range(0, len(keys), 100_000):
            part = keys[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([seen[1][k] for k in part], pa.int64())], ["term", "bad"])

    def count_clean(terms: frozenset):
        def run(batches):
            seen = Counter()
            for batch in batches:
                for body in batch.column(0).to_pylist():
                    seen.update(terms & _terms(body or ""))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "good"])
        return run

    part = F.broadcast(sample.filter("role < 4").select(F.col("id").alias("__id"), F.col("toxic").alias("__toxic")))  # at most SAMPLE rows
    texts = docs.select(F.col(doc).cast("bigint").alias("__id"), F.col(text).alias("__text")).join(part, "__id")
    texts = texts.groupBy("__id", "__toxic").agg(F.min("__text").alias("__text")).select("__text", "__toxic")  # one text of an id
    path = scratch_path(docs.sparkSession, "lexicon-texts")
    texts.write.parquet(path)
    texts = docs.sparkSession.read.parquet(path)
    n = dict(texts.groupBy("__toxic").count().collect())
    bad = texts.filter("__toxic = 1").mapInArrow(count, "term string, bad bigint").groupBy("term").agg(F.sum("bad").alias("bad"))
    often = {r["term"]: r["bad"] for r in bad.filter(f"bad >= {max(4, n.get(1, 0) // 500)}").orderBy(F.desc("bad"), "term").limit(10 * terms).collect()}
    good = texts.filter("__toxic = 0").select("__text").mapInArrow(count_clean(frozenset(often)), "term string, good bigint")
    clean = {r["term"]: r["good"] for r in good.groupBy("term").agg(F.sum("good").alias("good")).collect()}
    odds = {t: math.log((a + 0.5) / (n.get(1, 0) + 1)) - math.log((clean.get(t, 0) + 0.5) / (n.get(0, 0) + 1)) for t, a in often.items()}
    best = sorted((t for t in odds if odds[t] >= WEAK), key=lambda t: (-odds[t] * often[t], t))[:terms]
    return {t: round(odds[t], 6) for t in best}


class Featurizer:
    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.gate = frozenset(t.rstrip(".")[:5] for t in lexicon)
        self.known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        """Largest log odds of the word or one of its beginnings."""
        if word[:5] not in self.gate:
            return 0.0
        if word not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            get = self.lexicon.get
            self.known[word] = max([get(word + ".", 0.0), *(get(word[:n], 0.0) for n in _SIZES if len(word) >= n)])
        return self.known[word]

    def __call__(self, text: str) -> list[float]:
        words = _WORD.findall(text.lower())
        n = max(1, len(words))
        gate = self.gate
        hits = [(i, self.weight(w)) for i, w in enumerate(words) if w[:5] in gate]
        strong = [i for i, w in hits if w >= STRONG]
        weak = sum(WEAK <= w < STRONG for _, w in hits)
        person = [i for i, w in enumerate(words) if w in SECOND_PERSON]
        near = 0
        if strong and person:
            at = np.searchsorted(person, strong)
            there = np.concatenate([[-(10**9)], person, [10**9]])
            near = int((np.minimum(np.array(strong) - there[at], there[at + 1] - np.array(strong)) <= NEAR).sum())
        mixed = _MIXED.findall(text)
        hidden = sum(self.weight(w) >= STRONG for x in mixed for w in _WORD.findall(x.strip("!?.,;:|").lower().translate(_LETTERS)))
        upper = sum(map(str.isupper, text)) if not text.isascii() else len(text) - len(text.translate(_NO_CAPITALS))
        letters = max(1, sum(map(len, words)))
        shout = text.count("!") + text.count("?")
        return [
            math.log1p(len(words)), len(strong) / n, math.log1p(len(strong)), math.log1p(len({words[i] for i in strong})),
            weak / n, math.log1p(weak), max((w for _, w in hits), default=0.0), sum(w for _, w in hits) / n,
            math.log1p(near), near / n, len(person) / n, upper / letters, shout / n,
            (len(text) - sum(map(len, words)) - text.count(" ")) / max(1, len(text)), len(mixed) / n, hidden / n, len(set(words)) / n,
        ]


_NO_CAPITALS = {i: None for i in range(65, 91)}


def features(docs: DataFrame, lexicon: dict[str, float], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_key`` (a hash of the text) and the dense features ``x`` of every row."""
    def run(batches):
        featurize = Featurizer(lexicon)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                values = [featurize(t.as_py() or "") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(values, pa.list_(pa.float64()))], ["doc_id", "text_key", "x"])
            give_back()

    rows = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_key"))
    return rows.mapInArrow(run, "doc_id bigint, text_key bigint, x array<double>")


def training_rows(dense: DataFrame, part: DataFrame) -> DataFrame:
    """``doc_id, text_key, x, toxic, role``: one row of ``dense`` for each labelled id, gathered in two tasks behind the join."""
    one = F.min_by(F.struct("text_key", "x"), "text_key").alias("one")
    rows = dense.join(part, "doc_id").groupBy("doc_id", "toxic", "role").agg(one)
    return rows.select("doc_id", "one.*", "toxic", "role").repartition(2)


def score(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, doc: str = "doc_id", text: str = "text", label: str = "toxic",
          label_doc: str = "doc_id", terms: int = TERMS) -> DataFrame:
    """``doc_id, text_key, score`` for every row of ``docs``; at most ``rows`` labelled documents are learnt from, and the
    lexicon has at most ``terms`` entries."""
    spark = docs.sparkSession
    sample = sample_labels(labels, rows, label_doc, label, docs.select(F.col(doc).cast("bigint").alias("id")))
    lexicon = learn_lexicon(docs, sample, doc, text, terms)
    path = scratch_path(spark, "features")
    features(docs, lexicon, doc, text).write.parquet(path)
    dense = spark.read.parquet(path)

    part = F.broadcast(sample.filter("role >= 4").withColumnRenamed("id", "doc_id"))  # at most SAMPLE rows
    path = scratch_path(spark, "training")
    training_rows(dense, part).write.parquet(path)
    known = spark.read.parquet(path).select(array_to_vector("x").alias("features"), F.col("toxic").cast("double").alias("label"), "role")
    kinds = {(r["role"] < 8, r["label"]) for r in known.select("role", "label").distinct().collect()}
    if len({x for role, x in kinds if role}) < 2:
        share = sample.agg(F.coalesce(F.avg(F.col("toxic").cast("double")), F.lit(0.0))).first()[0]
        return dense.select("doc_id", "text_key", F.lit(share).alias("score"))
    trees = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.3, minInstancesPerNode=5, subsamplingRate=1.0, seed=7).fit(known.filter("role < 8"))

    def margin(df):
        return df.withColumn("p", vector_to_array("probability")[1])

    fitted = margin(trees.transform(known.filter("role >= 8" if any(not role for role, _ in kinds) else "role < 8")))
    steps = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="calibrated").fit(fitted.select("p", "label"))
    scored = steps.transform(margin(trees.transform(dense.withColumn("features", array_to_vector("x")))))
    # steps of the calibration are flat; a small share of the trees' own estimate keeps the order inside them
    blend = 0.98 * F.col("calibrated") + 0.02 * F.col("p")
    return scored.select("doc_id", "text_key", F.greatest(F.lit(0.0), F.least(F.lit(1.0), blend)).alias("score"))
