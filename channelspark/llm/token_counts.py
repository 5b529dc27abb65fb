"""Token counts of a unigram tokenizer by count-only Viterbi.

An Aho-Corasick automaton enumerates the vocabulary's matches in a word; dynamic programming over
their ends carries the best score and its number of pieces, never the pieces. Ties follow the
tokenizer: of equal scores the earlier start wins, and the unknown piece only wins outright.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from channelspark.llm.common import TOKENIZERS, packed, text_of

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
MEMO_ENTRIES = 400_000


class Counter:
    """Counts the pieces of words under a scored vocabulary.

    A run of unknown characters (and of the unknown piece's own name) costs one piece per UTF-8 byte
    with ``byte_fallback``, else one.
    """

    def __init__(self, pieces: Sequence[tuple[str, float]], byte_fallback: bool = True, unknown: int = 0):
        self.trie = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(pieces):
            if piece:
                self.trie.add_word(piece, (len(piece), score, i == unknown))
        self.trie.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.byte_fallback, self.name = byte_fallback, pieces[unknown][0]
        self.memo: dict[str, tuple[int, float]] = {}

    def word(self, word: str) -> tuple[int, float]:
        """Number of pieces and score of the best segmentation of one pre-split word."""
        ends: list[list[tuple[int, float, bool]]] = [[] for _ in word]
        for end, match in self.trie.iter(word):  # longest first at each end
            ends[end].append(match)
        best, count, begun = [0.0], [0], [-1]
        for end, matches in enumerate(ends):
            top, start, run, single = None, end, False, False
            for length, score, unknown in matches:
                total = best[end + 1 - length] + score
                if top is None or total > top:
                    top, start, run = total, end + 1 - length, unknown
                single |= length == 1
            if not single and (top is None or best[end] + self.unknown > top):
                top, start, run = best[end] + self.unknown, end, True
            if run and begun[start] >= 0:
                start = begun[start]  # one run of unknown characters is counted anew as a whole
            new = 1
            if run and self.byte_fallback and word[start : end + 1] != self.name:
                new = len(word[start : end + 1].encode("utf-8", "replace"))
            best.append(top)
            count.append(count[start] + new)
            begun.append(start if run else -1)
        return count[-1], best[-1]

    def _new(self, word: str) -> tuple[int, float]:
        if len(self.memo) >= MEMO_ENTRIES:
            self.memo.clear()
        found = self.memo[word] = self.word(SPACE + word)
        return found

    def text(self, text: str) -> tuple[int, float]:
        """Totals of a text, whose words begin at spaces."""
        if not text:
            return 0, 0.0
        words = text.replace(" ", SPACE).split(SPACE)
        known, new = self.memo.get, self._new
        found = [known(w) or new(w) for w in (words[1:] if not words[0] else words)]
        return sum(n for n, _ in found), sum(s for _, s in found)


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a vocabulary file."""
    file = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(file.id_to_piece(i), file.get_score(i)) for i in range(file.get_piece_size())]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One per Python worker, built on first use."""
    return Counter(vocabulary(path))


def count_tokens(docs: DataFrame, path: str = f"{TOKENIZERS}/piece_bpe_32k.model", text_col: str = "text") -> DataFrame:
    """``row`` (the input row), ``n_tokens`` and ``score`` of every whole text.

    The file's pieces and scores are read as a unigram vocabulary with byte fallback. Null and empty
    texts have 0 tokens and score 0. Rows are independent, so repeats and ties do not matter.
    """

    @F.pandas_udf("struct<n_tokens: bigint, score: double>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = counter(path)
        for batch in texts:
            yield pd.DataFrame([own.text(t) for t in batch], columns=["n_tokens", "score"])

    source = docs.select(packed(docs).alias("row"), text_of(text_col).alias("text"))
    return source.select("row", run("text").alias("out")).select("row", "out.n_tokens", "out.score")
