"""N-gram Jaccard join by parity sketches.

A document's set is its distinct k-word shingles. A parity sketch toggles one bit per element, so the Hamming distance
of two sketches is at most the size of the sets' symmetric difference, and similarity bounds that difference by
``D = (100 - percent) * (a + b) / (100 + percent)`` for sets of a and b elements. Sizes fall into bands as wide as the
size ratio that a link allows, so linked sets lie in one band or two neighbouring ones and both enter the join of the
upper band. There the sketch has more parts than D can touch: linked sets agree in a whole part and meet on its value.

An empty part says little, so it is left out; to keep the guarantee there are some more parts than needed, and a set
with more empty parts than those joins on its empty parts too.

Passages that many documents share make large buckets of documents that are not alike. So there are some more parts still,
``_parts`` says how many: linked sets then agree in more parts than a set may leave out, and each set leaves out its largest
buckets, in one order of all buckets. The smallest bucket that two linked sets share is among the largest ones of
neither, so they still meet there.

Sets that are equal are one class from the start. In the bucket of a part value each class is paired with the first one
in one of ORDERS orders, which the part chooses, so a class meets different pivots in its buckets. Pairs whose parity
sketches are near enough are verified on the full sets, and links give components. Buckets that hold several components
still are compared inside tasks, in blocks of bounded size. The pairs of different components with near sketches are a
graph, of which a block gives a spanning forest only, so a bucket never gives more pairs than it has classes. The forests'
components are families: two classes with near sketches are in one. The full sets of a family then meet in tasks, in blocks
of bounded size again, and the links that join two components leave them, one for each that joins. So no link between
components is lost, and a large group of near copies costs a few rows a document instead of all pairs, also where its pairs
lie just below the limit. The verified links span each component (``verified_links``); those inside a component are not
all looked for.

What travels with the rows of a bucket is bounded: sets of more than SAMPLED elements are compared there on a sketch of the
elements whose hash begins with some zero bits, so many that at most SAMPLED are expected. The symmetric difference among
them follows a binomial law, and the limit on it is set so that a linked pair fails with a probability below 1e-18. Pairs
that pass are compared on sketches of all elements before they are verified.

Elements, sets and sketches use 64-bit hashes. Defined cases: a null text or one without words is an empty set, linked
with nothing; a text with fewer than k words has its whole sequence as its one shingle; repeated rows are equal sets;
a null id never is a component's name unless all its ids are null; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landstrata.session import scratch_path

from . import _text
from ._components import components
from ._joins import shipped_if_small

U = np.uint64
ORDERS = 8
PART_BITS = 1 << 20  # so many that parts with a single element rarely agree by chance
BLOCK = 2048  # classes of a bucket that meet in one task, at most twice as many
ELEMENTS = 1 << 19  # of a family's full sets that meet in one task, about twice as many in all
SAMPLED = 512  # elements of the sketch that travels with buckets
LEFT_OUT = 20  # one part for so many of the needed ones may be left out
HELD = 1 << 16  # rows of a bucket that wait in a task for its size; larger buckets count as this large


def bound(a, b, percent: int):
    """Largest symmetric difference of linked sets with a and b elements."""
    return (100 - percent) * (a + b) // (100 + percent)


def _band(n: np.ndarray, percent: int) -> np.ndarray:
    return np.floor(np.log(n) / math.log(100 / percent) + 1e-9).astype(np.int64)


def _parts(band: int, percent: int) -> tuple[int, int, int]:
    """Parts of a join band's sketch, how many of them are spare for empty ones, and how many may be left out."""
    largest = math.ceil((100 / percent) ** (band + 1) * (1 + 1e-9))
    need = bound(largest, largest, percent) + 1
    spare, left_out = 1 + need // 50, need // LEFT_OUT
    return need + spare + left_out, spare, left_out


def _allowances(n: np.ndarray, percent: int) -> list[np.ndarray]:
    """Parts that sets of n elements may leave out in join bands of even and of odd number."""
    out = [np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)]
    rows = np.flatnonzero(n >= _least_size(percent))
    if len(rows):
        band = _band(n[rows], percent)
        table = np.array([_parts(j, percent)[2] for j in range(int(band.max()) + 2)], np.int64)
        for parity in (0, 1):
            out[parity][rows] = table[band + ((band & 1) != parity)]
    return out


def _least_size(percent: int) -> int:
    """Smaller sets link with equal ones only."""
    n = 1
    while bound(n, 100 * n // percent, percent) < 1:
        n += 1
    return n


def _sizes(bounds: np.ndarray) -> np.ndarray:
    return np.diff(bounds)


def _fingerprints(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(hashes) + 1, U)
    np.cumsum(_text.mix(hashes ^ U(0xA5A5A5A5A5A5A5A5)), out=sums[1:])
    return _text.mix(sums[bounds[1:]] - sums[bounds[:-1]] + _sizes(bounds).astype(U) * U(0x2545F4914F6CDD1D)).view(np.int64)


def _words(n: np.ndarray) -> np.ndarray:
    return 1 << np.ceil(np.log2(np.maximum(n, 16) / 16)).astype(np.int64)


def _level(n: np.ndarray) -> np.ndarray:
    """Zero bits that a hash must begin with to be sampled."""
    return np.maximum(np.frexp(np.maximum(n, 1) - 1)[1] - (SAMPLED.bit_length() - 1), 0).astype(np.int64)


def _sketches(hashes: np.ndarray, bounds: np.ndarray, sampled: bool = False) -> list[bytes]:
    """Parity sketches of at least four bits per element, a power of two long; of the sampled elements, or of all."""
    n = _sizes(bounds)
    words = np.minimum(_words(n), SAMPLED // 16) if sampled else _words(n)
    first = np.concatenate([[0], np.cumsum(words)])
    cells = np.zeros(first[-1], U)
    row = np.repeat(np.arange(len(n)), n)
    bit = _text.mix(hashes + U(77))
    above = (bit >> U(32)).astype(np.int64)
    if sampled:
        level = _level(n)[row]
        inside = above & ((1 << level) - 1) == 0
        row, bit, above = row[inside], bit[inside], (above >> level)[inside]
    np.bitwise_xor.at(cells, first[row] + (above & (words[row] - 1)), U(1) << (bit & U(63)))
    return [cells[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def _part_keys(hashes: np.ndarray, bounds: np.ndarray, percent: int):
    """(key, row) of all sketch parts on which the sets join."""
    n = _sizes(bounds)
    rows = np.flatnonzero(n >= _least_size(percent))
    keys, owners = [], []
    if not len(rows):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    band = np.zeros(len(n), np.int64)
    band[rows] = _band(n[rows], percent)
    table = [_parts(j, percent) for j in range(int(band.max()) + 2)]
    member = np.repeat(np.arange(len(n)), n)
    inside = (n >= _least_size(percent))[member]
    member, hashes = member[inside], hashes[inside]
    which = _text.mix(hashes + U(1))
    toggle = _text.mix((_text.mix(hashes + U(2)) & U(PART_BITS - 1)) + U(0x51ED270B))  # a bit of a part
    for step in (0, 1):
        join = band + step
        parts = np.array([table[j][0] for j in join.tolist()], np.int64)
        spare = np.array([table[j][1] for j in join.tolist()], np.int64)
        parts[n < _least_size(percent)] = 0
        first = np.concatenate([[0], np.cumsum(parts)])
        cells = np.zeros(first[-1], U)
        np.bitwise_xor.at(cells, first[member] + (which % parts[member].astype(U)).astype(np.int64), toggle)
        owner = np.repeat(np.arange(len(n)), parts)
        number = np.arange(len(cells)) - first[owner]
        parity = (join[owner] & 1).astype(U)
        empty = np.bincount(owner[cells == 0], minlength=len(n))
        keep = (cells != 0) | (empty > spare)[owner]
        name = _text.mix((join[owner] * 1_000_003 + number).astype(U) + U(0xC0FFEE))
        # 47 bits tell parts apart, and pack; the last one is the join band's
        keys.append(((_text.mix(cells[keep] ^ name[keep]) >> U(17)) << U(1) | parity[keep]).view(np.int64))
        owners.append(owner[keep])
    return np.concatenate(keys), np.concatenate(owners)


def signatures(docs: DataFrame, k: int, percent: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_key, n, fp, sketch, sampled, even, odd``: a hash of the text; size, fingerprint and sketches of its
    set, of all elements and of sampled ones; parts it may leave out in join bands of even and of odd number."""
    def run(batches):
        for batch in batches:
            for at, hashes, bounds in _text.word_sets(batch.column(1), k):
                n = _sizes(bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(n)), batch.column(2).slice(at, len(n)), pa.array(n), pa.array(_fingerprints(hashes, bounds)),
                     pa.array(_sketches(hashes, bounds), pa.binary()), pa.array(_sketches(hashes, bounds, True), pa.binary()),
                     *[pa.array(x) for x in _allowances(n, percent)]],
                    ["doc_id", "text_key", "n", "fp", "sketch", "sampled", "even", "odd"])

    rows = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_key"))
    return rows.mapInArrow(run, "doc_id bigint, text_key bigint, n bigint, fp bigint, sketch binary, sampled binary, even bigint, odd bigint")


def _place(key: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """The class's place in the order that the key chooses."""
    return _text.mix(fp.view(U) ^ _text.mix(key.view(U) & U(ORDERS - 1))).view(np.int64)


def _class(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The class at a place, see ``_place``."""
    return (_text.unmix(place.view(U)) ^ _text.mix(key.view(U) & U(ORDERS - 1))).view(np.int64)


def _keys(docs: DataFrame, k: int, percent: int, text: str) -> DataFrame:
    """``key, place``: the parts on which each document's class joins."""
    def run(batches):
        for batch in batches:
            for _, hashes, bounds in _text.word_sets(batch.column(0), k):
                key, owner = _part_keys(hashes, bounds, percent)
                place = _place(key, _fingerprints(hashes, bounds)[owner])
                for a in range(0, len(key), 1 << 18):
                    part = slice(a, a + (1 << 18))
                    yield pa.RecordBatch.from_arrays([pa.array(key[part]), pa.array(place[part])], ["key", "place"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "key bigint, place bigint")


def _shared_buckets(keys: DataFrame) -> DataFrame:
    """``key, fp, pivot, size`` of keys with two classes or more; the pivot is the first of the key's order. Sorted rows
    stream by; a task keeps back the bucket that is still open, up to HELD rows of it."""
    def run(batches):
        held = np.empty(0, np.int64), np.empty(0, np.int64)
        large = False  # more than HELD rows of the open bucket are out; its first and its last one are held
        for batch in _ended(batches):
            key, place = held
            if batch is not None:
                key, place = np.concatenate([key, np.asarray(batch.column(0))]), np.concatenate([place, np.asarray(batch.column(1))])
            if not len(key):
                continue
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (place[1:] != place[:-1])
            out = np.ones(len(key), bool)
            out[: 2 if large else 0] = False
            key, place, out = key[new], place[new], out[new]
            start = np.ones(len(key), bool)
            start[1:] = key[1:] != key[:-1]
            run_of, first = np.cumsum(start) - 1, np.flatnonzero(start)
            size = np.minimum(np.bincount(run_of), HELD)
            if large:
                size[0] = HELD
            large = batch is not None and bool(size[-1] == HELD)
            if large:
                held = key[[first[-1], -1]], place[[first[-1], -1]]
            elif batch is not None:
                held = key[first[-1] :], place[first[-1] :]
                out[first[-1] :] = False
            out &= (size > 1)[run_of]
            if out.any():
                k = key[out]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k), pa.array(_class(k, place[out])), pa.array(_class(k, place[first][run_of][out])), pa.array(size[run_of][out])],
                    ["key", "fp", "pivot", "size"])

    return keys.repartition("key").sortWithinPartitions("key", "place").mapInArrow(run, "key bigint, fp bigint, pivot bigint, size bigint")


def _ended(batches):
    """The batches, then None."""
    yield from batches
    yield None


def _without_largest(buckets: DataFrame, classes: DataFrame) -> DataFrame:
    """``key, place`` without the largest buckets that each class may leave out."""
    place = F.row_number().over(Window.partitionBy("fp", "parity").orderBy(F.desc("size"), "key"))
    rows = buckets.select("key", "fp", "size", F.col("key").bitwiseAND(1).alias("parity")).join(classes.select("fp", "even", "odd"), "fp")
    kept = rows.withColumn("nth", place).filter(F.col("nth") > F.when(F.col("parity") == 0, F.col("even")).otherwise(F.col("odd")))

    def run(batches):
        for batch in batches:
            key = np.asarray(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_place(key, np.asarray(batch.column(1))))], ["key", "place"])

    return kept.select("key", "fp").mapInArrow(run, "key bigint, place bigint")


def _fold(cells: np.ndarray, words: int) -> np.ndarray:
    """Sketches, one a row, brought to fewer words."""
    while cells.shape[1] > words:
        half = cells.shape[1] // 2
        cells = cells[:, :half] ^ cells[:, half:]
    return cells


def _lift(cells: np.ndarray, levels: int) -> np.ndarray:
    """Sketches of the elements whose hashes have so many further zero bits; without words where none are left to tell."""
    for _ in range(levels):
        cells = cells[:, 0::2] if cells.shape[1] > 1 else cells[:, :0]
    return cells


def _stack(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), U).reshape(len(sketches), -1)


def _limit(most, level):
    """Largest difference among sampled elements, for sets that differ by ``most`` elements at the most."""
    mean = most / (1 << level)
    return np.where(level == 0, most, np.minimum(most, mean + 13.9 + np.sqrt(193 + 83 * mean)))


def _ratio(a, b, percent: int):
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def _near_pairs(pairs: DataFrame, classes: DataFrame, percent: int, sampled: bool) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link."""
    def run(batches):
        for batch in batches:
            a, b, na, nb = (np.asarray(batch.column(i)) for i in range(4))
            keep = _ratio(na, nb, percent)
            left, right = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            la, lb = (_level(na), _level(nb)) if sampled else (np.zeros_like(na), np.zeros_like(nb))
            alike: dict = {}
            for i in np.flatnonzero(keep).tolist():
                alike.setdefault((len(left[i]), len(right[i]), int(la[i]), int(lb[i])), []).append(i)
            for (_, _, x, y), rows in alike.items():
                level = max(x, y)
                u, v = _lift(_stack([left[i] for i in rows]), level - x), _lift(_stack([right[i] for i in rows]), level - y)
                words = min(u.shape[1], v.shape[1])
                if words:
                    near = np.bitwise_count(_fold(u, words) ^ _fold(v, words)).sum(axis=1)
                    keep[rows] = near <= _limit(bound(na[rows], nb[rows], percent), level)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    sketch = "sampled" if sampled else "sketch"
    left = classes.select(F.col("fp").alias("a"), F.col("n").alias("na"), F.col(sketch).alias("sa"))
    right = classes.select(F.col("fp").alias("b"), F.col("n").alias("nb"), F.col(sketch).alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _sets(asked: DataFrame, docs: DataFrame, classes: DataFrame, k: int, doc: str, text: str) -> DataFrame:
    """``fp, elements``: the full sets of the classes ``asked`` (fp), and maybe others."""
    spark = docs.sparkSession
    ids = classes.join(asked, "fp").select(F.col("doc_id").alias("__id"))
    path = scratch_path(spark, "ids")
    ids.distinct().write.parquet(path)
    ids = shipped_if_small(spark.read.parquet(path))

    def sets(batches):
        for batch in batches:
            for _, hashes, bounds in _text.word_sets(batch.column(0), k):
                cuts = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
                fp = _fingerprints(hashes, bounds)
                for a in range(0, len(cuts), 256):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(fp[a : a + 256]), pa.array([hashes[x:y].tobytes() for x, y in cuts[a : a + 256]], pa.binary())],
                        ["fp", "elements"])

    rows = docs.select(F.col(doc), F.col(text)).join(ids, F.col(doc).cast("bigint").eqNullSafe(F.col("__id")), "left_semi").select(F.col(text).alias("text"))
    path = scratch_path(spark, "sets")
    rows.mapInArrow(sets, "fp bigint, elements binary").write.parquet(path, compression="none")
    found = spark.read.parquet(path)
    if found.count() > found.select("fp").distinct().count():  # rows that share an id or a text
        found = found.groupBy("fp").agg(F.first("elements").alias("elements"))
    return found


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int, doc: str, text: str) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    found = _sets(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), docs, classes, k, doc, text)

    def verify(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            left, right = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(left[i].as_py(), U), np.frombuffer(right[i].as_py(), U)
                both = np.concatenate([x, y])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * same >= percent * (len(both) - same)
            if keep.any():
                yield pa.RecordBatch.from_arrays([batch.column(j).filter(pa.array(keep)) for j in (0, 1)], ["a", "b"])

    return (
        pairs.join(found.withColumnsRenamed({"fp": "a", "elements": "ea"}), "a")
        .join(found.withColumnsRenamed({"fp": "b", "elements": "eb"}), "b")
        .select("a", "b", "ea", "eb").mapInArrow(verify, "a bigint, b bigint")
    )


def _in_blocks(rows: DataFrame, compare) -> DataFrame:
    """``a, b``: what ``compare(own, fp, comp, n, data, lo, hi)`` gives for each block; ``rows``: key, fp, comp, n, data, chunks.

    The rows of a key are dealt into its number of chunks, and each two chunks meet in one task.
    """
    dealt = (
        rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "fp", "comp", "n", "data")
    )

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not table.num_rows:
                continue
            ids = np.stack([np.asarray(table.column(i)) for i in range(3)])
            cuts = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1
            yield from emit(table, ids, [0, *cuts.tolist()])
            held = table.slice(int(cuts[-1]) if len(cuts) else 0)
        if held is not None and held.num_rows:
            ids = np.stack([np.asarray(held.column(i)) for i in range(3)])
            yield from emit(held, ids, [0, held.num_rows])

    def emit(table, ids, cuts):
        a, b = [], []
        own, fp, comp, n = (np.asarray(table.column(i)) for i in range(3, 7))
        for s, e in zip(cuts[:-1], cuts[1:]):
            x, y = compare(own[s:e], fp[s:e], comp[s:e], n[s:e], table.column(7).slice(s, e - s).to_pylist(), ids[1][s], ids[2][s])
            a += x
            b += y
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(run, "a bigint, b bigint")


def _block_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Spanning forests of the near pairs of different components within buckets; ``rows``: key, fp, comp, n, sampled,
    size of the bucket. A block has about BLOCK classes of each of its two chunks."""
    def compare(own, fp, comp, n, sketches, lo, hi):
        levels = _level(n)
        level = int(levels.max())
        lifted = [_lift(_stack([x]), level - at) for x, at in zip(sketches, levels.tolist())]
        words = min(x.shape[1] for x in lifted)
        cells = np.concatenate([_fold(x, words) for x in lifted]) if words else np.zeros((len(fp), 0), U)
        left = np.argsort(fp, kind="stable")  # classes that no tree has reached; buckets with the same classes give the same pairs
        a, b, reached = [], [], []
        while len(left):
            if reached:
                i = reached.pop()
            else:
                i, left = int(left[0]), left[1:]
            ok = (comp[left] != comp[i]) & _ratio(n[left], n[i], percent)
            if lo != hi:  # pairs inside a chunk meet where the chunk meets itself
                ok &= own[left] != own[i]
            if ok.any():
                at = left[ok]
                near = np.bitwise_count(cells[at] ^ cells[i]).sum(axis=1) <= _limit(bound(n[at], n[i], percent), level)
                ok[ok] = near
                a += [int(fp[i])] * int(near.sum())
                b += fp[at[near]].tolist()
                reached += at[near].tolist()
                left = left[~ok]
        return a, b

    rows = rows.withColumn("chunks", F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")).withColumnRenamed("sampled", "data")
    return _in_blocks(rows, compare).distinct()


def _family_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links between components of a family, as many as join them; ``rows``: key (the family), fp, comp, n, elements.

    Elements of a block are sorted once, so a class meets all others of the block by the places of its own elements.
    """
    def compare(own, fp, comp, n, sets, lo, hi):
        hashes = np.frombuffer(b"".join(sets), U)
        first = np.concatenate([[0], np.cumsum(n)])
        order = np.argsort(hashes, kind="stable")
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[order][1:] != hashes[order][:-1]
        holder = np.repeat(np.arange(len(n)), n)[order]  # classes by element
        start = np.flatnonzero(new)
        held = np.diff(np.append(start, len(hashes)))
        number = np.empty(len(hashes), np.int64)
        number[order] = np.cumsum(new) - 1
        group = np.unique(comp, return_inverse=True)[1]
        by_group = np.argsort(group, kind="stable")
        edges = np.concatenate([[0], np.cumsum(np.bincount(group))])
        left = np.ones(len(n), bool)  # classes whose component no tree has reached
        a, b, reached = [], [], []

        def reach(g):
            members = by_group[edges[g] : edges[g + 1]]
            left[members] = False
            reached.extend(members.tolist())

        while left.any():
            if not reached:
                reach(group[left.argmax()])
                continue
            i = reached.pop()
            ok = left & _ratio(n, n[i], percent)
            if lo != hi:
                ok &= own != own[i]
            if not ok.any():
                continue
            of = number[first[i] : first[i + 1]]
            size = held[of]
            at = np.repeat(start[of] - np.cumsum(size) + size, size) + np.arange(size.sum())
            same = np.bincount(holder[at], minlength=len(n))
            for j in np.flatnonzero(ok & (100 * same >= percent * (n + n[i] - same))).tolist():
                if left[j]:
                    a.append(int(fp[i]))
                    b.append(int(fp[j]))
                    reach(group[j])
        return a, b

    sizes = rows.groupBy("key").agg(F.ceil(F.sum("n") / F.lit(ELEMENTS)).cast("int").alias("chunks"))
    return _in_blocks(rows.join(sizes, "key").withColumnRenamed("elements", "data"), compare).distinct()


def _linked(docs: DataFrame, k: int, percent: int, doc: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows with their class, classes, verified links between classes, and the component of each linked class."""
    spark = docs.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    rows = stored(signatures(docs, k, percent, doc, text), "signatures")
    classes = stored(
        rows.filter(F.col("n") >= _least_size(percent)).groupBy("fp")
        .agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n", "sketch", "sampled", "even", "odd")]), "classes")
    met = stored(_shared_buckets(_keys(docs, k, percent, text)), "met")
    buckets = stored(_shared_buckets(_without_largest(met, classes)), "buckets")
    pairs = buckets.filter("fp <> pivot").select(F.least("pivot", "fp").alias("a"), F.greatest("pivot", "fp").alias("b")).distinct()

    near = stored(_near_pairs(pairs, classes, percent, True), "near")
    near = stored(_near_pairs(near, classes, percent, False), "near")
    links = stored(_verified(near, docs, classes, k, percent, doc, text), "links")

    # buckets that hold several components besides their pivot's pairs
    known = components(links)
    other = buckets.filter("fp <> pivot").join(known.withColumnsRenamed({"id": "fp", "root": "comp"}), "fp", "left")
    other = other.select("key", "fp", F.coalesce("comp", "fp").alias("comp"))
    mixed = other.groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y")
    members = other.join(mixed.select("key", "size"), "key").join(classes.select("fp", "n", "sampled"), "fp")
    forest = stored(_block_pairs(members, percent), "forest")
    if not forest.isEmpty():
        family = stored(components(forest).select(F.col("root").alias("key"), F.col("id").alias("fp")), "families")
        sets = _sets(family.select("fp"), docs, classes, k, doc, text)
        family = family.join(known.withColumnsRenamed({"id": "fp", "root": "comp"}), "fp", "left").join(classes.select("fp", "n"), "fp").join(sets, "fp")
        more = stored(_family_links(family.select("key", "fp", F.coalesce("comp", "fp").alias("comp"), "n", "elements"), percent), "more")
        links = links.unionByName(more)
        known = components(links)
    return rows, classes, links, known


def verified_links(docs: DataFrame, k: int = 5, percent: int = 80, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``a, b``: links that were verified, between the smallest ids of sets that differ; a null id where a set has no other.
    They span each component, and documents with equal sets are linked besides."""
    _, classes, links, _ = _linked(docs, k, percent, doc, text)
    name = classes.select("fp", "doc_id")
    return links.join(name.withColumnsRenamed({"fp": "a", "doc_id": "x"}), "a").join(name.withColumnsRenamed({"fp": "b", "doc_id": "y"}), "b").select(
        F.least("x", "y").alias("a"), F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.greatest("x", "y")).alias("b"))


def link_documents(docs: DataFrame, k: int = 5, percent: int = 80, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_key, n_shingles, component_id, group`` for every row (``group`` is null without words): documents link at ``percent`` of Jaccard similarity or more."""
    rows, _, _, known = _linked(docs, k, percent, doc, text)
    placed = rows.select("doc_id", "text_key", "n", "fp").join(known.withColumnRenamed("id", "fp"), "fp", "left").select(
        "doc_id", "text_key", "n", F.when(F.col("n") > 0, F.coalesce("root", "fp")).alias("root"))
    names = placed.filter(F.col("n") > 0).groupBy("root").agg(F.min("doc_id").alias("name"))
    return placed.join(names, "root", "left").select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("doc_id")).alias("component_id"), F.col("root").alias("group"))
