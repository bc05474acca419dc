import random
import re
import zlib
from collections import Counter

import pytest
from helpers import ASCII_LOWER, docs

from landstrata.llm import spelling


def near(a, b):
    """One inserted, deleted or replaced code point apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_vocabulary(rows, length, least, every):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= length and n >= least}


def brute_variants(words, ratio=2):
    forms, out = {}, []
    for w, n in words.items():
        others = sorted(((-m, v) for v, m in words.items() if near(w, v)))
        forms[w] = others[0][1] if others and -others[0][0] >= ratio * n else None
        out.append([w, n, len(others), forms[w], -others[0][0] if forms[w] else None])
    for r in out:
        root = r[0]
        while forms[root]:
            root = forms[root]
        r.append(root)
    return sorted(map(tuple, out))


def run(spark, words, ratio=2):
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n bigint"), ratio).collect()
    return sorted(map(tuple, got))


@pytest.mark.parametrize("seed, letters, size", [(1, "ab", 7), (2, "abcdé", 5), (3, "abcdefgh", 4)])
def test_equals_comparing_all(spark, seed, letters, size):
    rng = random.Random(seed)
    words = {"".join(rng.choices(letters, k=rng.randint(1, size))): rng.choice([3, 3, 4, 8, 9, 20, 50, 200]) for _ in range(400)}
    assert run(spark, words) == brute_variants(words)


def test_repeated_letters_long_words_and_chains(spark):
    long = "ab" * 20_000
    words = {"aaaaa": 3, "aaaa": 6, "aaa": 12, "aa": 24, "a": 48, "b": 48, "ba": 24, "aaaab": 3, "abaab": 3, long: 3, long[:-1]: 9, long[1:]: 9, long[:9] + "z" + long[9:]: 4, "àaaaa": 3, "Àaaaa": 7}
    assert run(spark, words) == brute_variants(words)


def test_a_whole_alphabet_at_one_position(spark):
    """A pair of nodes with as many words as there are letters, all of one partner count."""
    alphabet = [chr(c) for c in range(97, 123)] + [chr(c) for c in range(0xC0, 0x100)]
    words = {f"gr{c}nd": 3 + i % 5 for i, c in enumerate(alphabet)} | {"grnd": 100}
    got = run(spark, words)
    assert got == brute_variants(words) and {r[2] for r in got} == {len(alphabet)}


def test_vocabulary(spark):
    rng = random.Random(5)
    stems = ["mountain", "Moúntain", "RIVERS", "rivér", "tiny", "naïve×half", "ßtraße"]
    rows = [(i, " ".join(rng.choice(stems) + rng.choice(["", "'s", "-", "9"]) for _ in range(60))) for i in range(40)]
    rows += [(None, "mountain rivers mountain"), (None, "mountain"), (77, None), (78, ""), (79, "..."), (80, "x" * 300_000), (81, "X" * 300_000), (82, "x" * 300_000), (7, "rivers"), (7, "rivers")]
    frame = docs(spark, rows, "word string, run string, n int, key string, part int, doc string")
    got = {r["word"]: r["n"] for r in spelling.vocabulary(frame, 5, 3, 5).collect()}
    assert got == brute_vocabulary(rows, 5, 3, 5)
    got = sorted(map(tuple, spelling.variants(spelling.vocabulary(frame, 5, 1, 5)).collect()))
    assert got == brute_variants(brute_vocabulary(rows, 5, 1, 5))


def test_empty_table(spark):
    assert spelling.variants(spelling.vocabulary(docs(spark, []))).collect() == []


@pytest.mark.parametrize("parts", [1, 2, 5, 40])
def test_nodes_are_the_same_in_all_partitions(parts):
    """A number stands for one prefix and a prefix for one number, wherever the cuts lie."""
    rng = random.Random(parts)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(0, 6))) for _ in range(300)})
    cuts = sorted(rng.sample(range(1, len(words)), parts - 1))
    dealt = [words[a:b] for a, b in zip([0, *cuts], [*cuts, len(words)])]
    names = rng.sample(range(100), parts)
    firsts = [(names[j], part[0]) for j, part in enumerate(dealt)]
    of, seen = {}, {}
    trie = spelling.Trie(firsts)
    for j in rng.sample(range(parts), parts):
        for word in dealt[j]:
            for depth, node in enumerate(trie.nodes(names[j], word)):
                assert of.setdefault(node, word[:depth]) == word[:depth] and seen.setdefault(word[:depth], node) == node
