import math
import random

import public_tokenizers
from helpers import docs

from landstrata.llm import tokencount

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def plain(text, scores):
    """(tokens, cost) word by word, without a trie."""
    byte = (round(1000 * math.log(len(scores) + 2)) << tokencount.SHIFT) + 1
    total = 0
    for word in text.split():
        word = tokencount.MARK + word
        best = [0]
        for e in range(1, len(word) + 1):
            best.append(min([best[e - 1] + byte * len(word[e - 1].encode("utf8", "surrogatepass"))]
                            + [best[s] + scores[word[s:e]] for s in range(max(0, e - 40), e) if word[s:e] in scores]))
        total += best[-1]
    return total & ((1 << tokencount.SHIFT) - 1), total >> tokencount.SHIFT


def test_equals_plain_dynamic_programming(spark):
    rng = random.Random(1)
    words = ["the", "them", "theme", "then", "thntion", "é", "日本語", "😀", "a", "ab", "abc", "x" * 300, "Don't", "ungewöhnlich", "123,456", "ab­c"]
    texts = [None, "", " \n", *[" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(60)], "y" * 20_000, "a b\x1cc"]
    rows = list(enumerate(texts)) + [(None, "no id"), (3, texts[4]), (3, texts[4])]
    scores = tokencount.load_pieces(VOCABULARY)
    got = tokencount.count_tokens(docs(spark, rows, "n_words string, cost int"), VOCABULARY).collect()
    want = [(i, len((t or "").split()), *plain(t or "", scores)) for i, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_prefixes_are_scored_once(monkeypatch):
    model = tokencount.Unigram(tokencount.load_pieces(VOCABULARY))
    asked = []

    class Spy(dict):
        def get(self, key, default=None):
            asked.append(key)
            return dict.get(self, key, default)

    model.scores = Spy(model.scores)
    model.count(["internation international internationally internationals"])
    assert len(asked) == sum(range(1, 17)) + 15  # 16 nodes of the longest word with its mark and one more, of depth 15, for the "s"


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokencount, "CACHE", 1)
    model = tokencount.Unigram(tokencount.load_pieces(VOCABULARY))
    first = model.count(["the quick brown fox", "the fox"])
    assert model.count(["the quick brown fox", "the fox"]) == first


def test_empty_table(spark):
    assert tokencount.count_tokens(docs(spark, []), VOCABULARY).count() == 0
