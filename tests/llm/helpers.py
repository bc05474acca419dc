"""Small tables and plain Python versions that the operators are compared with."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def shingle_set(text, k):
    words = WORD.findall((text or "").translate(ASCII_LOWER))
    if not words:
        return frozenset()
    if len(words) < k:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1))


def linked(a, b, percent):
    return bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)


def groups(sets, percent):
    """Group number of each set, by comparing all."""
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if linked(sets[i], sets[j], percent):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


def docs(spark, rows, extra="__doc string, spans string, hash int, key string, doc string"):
    """Documents table with columns that bear names the operators use inside."""
    names = [c.split()[0] for c in extra.split(",")] if extra else []
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint" + (", " + extra if extra else "")
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), *[None] * len(names)) for i, t in rows], schema)
