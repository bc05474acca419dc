"""Spelling variants: words at one insertion, deletion or replacement from each other, found by pairs of trie nodes.

Words are numbered twice: every prefix is a node of a trie, every suffix a node of the trie of reversed words. A pair
(prefix node, suffix node) then names the rest of a word around a position by two integers. Two words that differ
by a replaced code point share the pair around it, with the position skipped in both; a word with one more code point
shares the pair that skips it with the pair between two code points of the shorter word. Nodes are exact, so the join of
pairs gives exact neighbours without any comparison of spellings. Of equal neighbouring code points only the last is skipped
for insertions, so each pair of words meets once.

A trie is numbered without passing through one task: words are sorted into range partitions and each task walks its words
depth first, numbering what its last word did not have. Only prefixes of a partition's first word can occur in
two partitions; they get their numbers from the list of these first words, one a partition.

A pair of nodes holds at most one word for each letter of the alphabet, and one whole word: no listing of pairs of words is
needed, a window over them gives each word the number of its partners and the most frequent one. Forms double in frequency at
each step, so chains are short and roots come by pointer jumping.

Defined cases: a null text holds no words; a null id reads as an empty text in the hash; repeated rows count each; words of any
length are taken whole, in rows linear in their length; of equally frequent forms the smallest by code point wins; a
word without form is its own root; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landstrata.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-zÀ-ÿ]+"
GAP, SKIPPED, LAST_SKIPPED = 0, 1, 2  # a pair between two code points; around one; around the last of equal ones
PART = 1 << 36  # numbers of a partition


def misspelt(doc: Column, run: Column, every: int) -> Column:
    """The run as the table holds it: where ``every`` divides the hash of id and run, one code point is lost."""
    h = F.crc32(F.concat(F.coalesce(doc.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, least_length: int = 5, least_count: int = 3, every: int = 97, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n`` of the words that are long and frequent enough."""
    runs = docs.select(F.col(doc).alias("doc"), F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= least_length)
    words = runs.select(misspelt(F.col("doc"), F.translate("run", UPPER, LOWER), every).alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    lo, hi = 0, most  # a[:lo] is shared, a[:hi] is not
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class Trie:
    """Numbers the nodes of sorted words, a partition after the other in any order; ``firsts`` are the first words of
    all partitions, ascending."""

    def __init__(self, firsts: list[tuple[int, str]]):
        self.place = {part: j for j, (part, _) in enumerate(firsts)}
        self.firsts = [w for _, w in firsts]
        self.owners: list[list[int]] = []  # by first word: the earliest partition that starts with each of its prefixes
        for j, w in enumerate(self.firsts):
            shared = _shared(w, self.firsts[j - 1]) if j else 0
            self.owners.append([0, *(self.owners[j - 1][1 : shared + 1] if j else []), *[j] * (len(w) - shared)])
        self.part, self.count = None, 0
        self.word, self.path = "", [-1]

    def nodes(self, part: int, word: str) -> list[int]:
        """The node of each prefix of the word, the empty one first; the list is good until the next call."""
        if part != self.part:
            self.part, self.count, self.word, self.path = part, 0, "", [-1]
        j = self.place[part]
        known = _shared(word, self.word)
        del self.path[known + 1 :]
        here = _shared(word, self.firsts[j])
        after = _shared(word, self.firsts[j + 1]) if j + 1 < len(self.firsts) else 0
        for depth in range(known + 1, len(word) + 1):
            if depth <= here:
                self.path.append(-1 - (self.owners[j][depth] * PART + depth))
            elif depth <= after:
                self.path.append(-1 - (self.owners[j + 1][depth] * PART + depth))
            else:
                self.path.append(j * PART + self.count)
                self.count += 1
        self.word = word
        return self.path


def _dealt(words: DataFrame, key: Column) -> tuple[DataFrame, list[tuple[int, str]]]:
    """The rows with ``part`` and ``key``, sorted by both inside a task, and each part's first key."""
    spark = words.sparkSession
    path = scratch_path(spark, "trie")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words.withColumn("key", key).repartitionByRange(n, "key").withColumn("part", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    firsts = sorted((r["key"], r["part"]) for r in rows.groupBy("part").agg(F.min("key").alias("key")).collect())  # one a partition
    return rows.repartition("part").sortWithinPartitions("part", "key"), [(part, key) for key, part in firsts]


def _prefix_nodes(words: DataFrame) -> DataFrame:
    """``id, word, n, prefixes``: the id ascends with the word, ``prefixes`` holds the nodes of all its prefixes."""
    rows, firsts = _dealt(words, F.col("word"))

    def run(batches):
        trie, part, count = Trie(firsts), None, 0
        for batch in batches:
            ids, nodes, ends = [], [], [0]
            for p, word in zip(batch.column(2).to_pylist(), batch.column(0).to_pylist()):
                part, count = (p, count + 1) if p == part else (p, 0)
                nodes += trie.nodes(p, word)
                ends.append(len(nodes))
                ids.append(trie.place[p] * PART + count)
            lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(nodes, pa.int64())).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), batch.column(0), batch.column(1), lists], ["id", "word", "n", "prefixes"])

    return rows.select("word", "n", "part").mapInArrow(run, "id bigint, word string, n bigint, prefixes array<bigint>")


def _pairs(words: DataFrame) -> DataFrame:
    """``a, b, kind, id, n``: each word's pairs of a prefix node and a suffix node, between and around its code points."""
    rows, firsts = _dealt(words, F.reverse("word"))

    def run(batches):
        trie = Trie(firsts)
        for batch in batches:
            a, b, kind, ids, counts = [], [], [], [], []
            for i, n, prefixes, p, key in zip(*(batch.column(c).to_pylist() for c in range(5))):
                suffixes, size = trie.nodes(p, key)[::-1], len(key)
                word = key[::-1]
                a += prefixes + prefixes[:-1]
                b += suffixes + suffixes[1:]
                kind += [GAP] * (size + 1) + [LAST_SKIPPED if x != y else SKIPPED for x, y in zip(word, word[1:])] + [LAST_SKIPPED]
                ids += [i] * (2 * size + 1)
                counts += [n] * (2 * size + 1)
                if len(a) > 1 << 18:
                    yield out(a, b, kind, ids, counts)
                    a, b, kind, ids, counts = [], [], [], [], []
            if a:
                yield out(a, b, kind, ids, counts)

    def out(a, b, kind, ids, counts):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((a, pa.int64()), (b, pa.int64()), (kind, pa.int8()), (ids, pa.int64()), (counts, pa.int64()))],
                                          ["a", "b", "kind", "id", "n"])

    return rows.select("id", "n", "prefixes", "part", "key").mapInArrow(run, "a bigint, b bigint, kind tinyint, id bigint, n bigint")


def _neighbours(pairs: DataFrame) -> DataFrame:
    """``id, n_near, best``: how many words are near, and (minus count, id) of the most frequent of them."""
    skipped, last = F.col("kind") > GAP, F.col("kind") == LAST_SKIPPED
    me = F.struct((-F.col("n")).alias("m"), F.col("id").alias("id"))
    group = Window.partitionBy("a", "b")
    ordered = group.orderBy(F.col("kind") == GAP, F.col("n").desc(), "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = pairs.withColumn("me", me).select(
        "id", "me", "kind",
        F.count(F.when(skipped, 1)).over(ordered).alias("skipped"), F.count(F.when(last, 1)).over(ordered).alias("longer"),
        F.max(F.when(~skipped, F.col("me"))).over(ordered).alias("whole"), F.min(F.when(last, F.col("me"))).over(ordered).alias("longest"),
        F.first("me").over(ordered).alias("first"), F.nth_value(F.when(skipped, F.col("me")), 2).over(ordered).alias("second"))
    other = F.when(F.col("first") == F.col("me"), F.col("second")).otherwise(F.col("first"))
    shorter = F.when(last & F.col("whole").isNotNull(), F.col("whole"))
    found = met.select(
        "id", F.when(skipped, F.col("skipped") - 1 + F.when(shorter.isNotNull(), 1).otherwise(0)).otherwise(F.col("longer")).alias("near"),
        F.when(skipped, F.least(other, shorter)).otherwise(F.col("longest")).alias("best"))
    return found.filter("near > 0").groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``id, root`` for rows ``id, form``; each round doubles the steps that a row has gone."""
    spark = forms.sparkSession
    rows = forms.select("id", F.col("form").alias("root"))
    while True:
        path = scratch_path(spark, "roots")
        further = rows.select(F.col("id").alias("root"), F.col("root").alias("next"))
        rows.join(further, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")).write.parquet(path)
        moved = spark.read.parquet(path)
        rows = moved.select("id", "root")
        if moved.filter("moved").isEmpty():
            return rows


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word (``word, n``; distinct words): its most frequent near word, if that
    occurs ``ratio`` times as often or more, and the end of the chain of forms."""
    spark = words.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    numbered = stored(_prefix_nodes(words), "prefixes")
    names = numbered.select("id", "word", "n")
    near = stored(_neighbours(_pairs(numbered)), "near")
    placed = names.join(near, "id", "left")
    good = -F.col("best.m") >= ratio * F.col("n")
    placed = stored(placed.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                                  F.when(good, F.col("best.id")).alias("form_id"), F.when(good, -F.col("best.m")).alias("form_n")), "forms")
    changed = placed.filter("form_id IS NOT NULL")
    root = _roots(changed.select("id", F.col("form_id").alias("form")))
    spelt = names.select(F.col("id").alias("form_id"), F.col("word").alias("form"))
    ends = names.select(F.col("id").alias("root_id"), F.col("word").alias("root"))
    changed = changed.join(root.withColumnRenamed("root", "root_id"), "id").join(spelt, "form_id").join(ends, "root_id")
    kept = placed.filter("form_id IS NULL").withColumn("form", F.lit(None).cast("string")).withColumn("root", F.col("word"))
    out = ["word", "n", "n_near", "form", "form_n", "root"]
    return changed.select(*out).unionByName(kept.select(*out))
