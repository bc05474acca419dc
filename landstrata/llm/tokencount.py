"""Token counts of a unigram model, by dynamic programming over a trie.

Words are what white space separates, with the word mark in front. The distinct words of a batch that are not known yet
are put in order, which walks their trie depth first: the forward scores of a prefix stay on a stack and serve every word
that shares it, so each node of the trie is computed once. The score at a word's end holds the least cost and the number
of tokens, and documents add up their words'.

The model takes the pieces of a vocabulary file: a piece of rank r costs ``round(1000 * ln(r + 2))``, characters that no
piece covers fall back to their bytes at the cost of the last rank. Of segmentations with equal cost the one with fewer tokens counts.

Defined cases: a null or empty text has no words and no tokens; repeated rows are counted each; a null id stays null;
words of any length are taken whole; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
SHIFT = 40  # a score is (cost << SHIFT) + tokens
CACHE = 250_000  # remembered words of a Python worker
_models: dict = {}


def load_pieces(vocabulary: str) -> dict[str, int]:
    """Score of each piece of a vocabulary file; control, unknown and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    ranked = [model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {piece: (round(1000 * math.log(rank + 2)) << SHIFT) + 1 for rank, piece in enumerate(ranked)}


class Unigram:
    def __init__(self, scores: dict[str, int]):
        self.scores = scores
        self.longest = max(map(len, scores))
        self.byte = (round(1000 * math.log(len(scores) + 2)) << SHIFT) + 1
        self.known: dict[str, int] = {}

    def forward(self, words: list[str]) -> None:
        """Scores of sorted words; the stack holds those of the prefixes of the last one."""
        get, longest, known = self.scores.get, self.longest, self.known
        stack, last = [0], ""
        for word in words:
            shared, most = 0, min(len(last), len(word))
            while shared < most and last[shared] == word[shared]:
                shared += 1
            del stack[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                best = stack[end - 1] + self.byte * len(word[end - 1].encode("utf8", "surrogatepass"))
                for start in range(max(0, end - longest), end):
                    piece = get(word[start:end])
                    if piece is not None and stack[start] + piece < best:
                        best = stack[start] + piece
                stack.append(best)
            known[word] = stack[-1]
            last = word

    def count(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(words, tokens, cost) of each text."""
        split = [t.split() for t in texts]
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        fresh = {w for words in split for w in words if w not in known}
        self.forward_marked(fresh)
        totals = [sum(map(known.__getitem__, words)) for words in split]
        return [(len(words), t & ((1 << SHIFT) - 1), t >> SHIFT) for words, t in zip(split, totals)]

    def forward_marked(self, words) -> None:
        """Scores of words behind their mark, which every path of the trie starts with."""
        known = self.known
        self.known = marked = {}
        self.forward(sorted(MARK + w for w in words))
        self.known = known
        known.update((w[1:], score) for w, score in marked.items())


def count_tokens(docs: DataFrame, vocabulary: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_tokens, cost`` of every row."""
    def run(batches):
        if vocabulary not in _models:
            _models[vocabulary] = Unigram(load_pieces(vocabulary))
        model = _models[vocabulary]
        for batch in batches:
            texts, at = batch.column(1), 0
            while at < len(texts):
                part, chars, to = [], 0, at
                while to < len(texts) and chars < 4_000_000:
                    part.append(texts[to].as_py() or "")
                    chars += len(part[-1])
                    to += 1
                counted = list(zip(*model.count(part)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), *[pa.array(c, pa.int64()) for c in counted]], ["doc_id", "n_words", "n_tokens", "cost"])
                at = to

    return docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id bigint, n_words bigint, n_tokens bigint, cost bigint")
