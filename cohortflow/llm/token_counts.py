"""Operator 5, token counts: count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates every vocabulary piece in a word, in
order of their ends; dynamic programming carries, for each place, the best
score, the number of pieces on that path and whether it ends in an unknown
character.  No segmentation is ever kept.  Ties are decided as the unigram
model of the ``tokenizers`` library decides them: among the pieces that end at
a place only a strictly better score replaces an earlier start, a character
that is no piece costs the least score minus 10, and neighbouring unknown
characters are one token.

The vocabulary is that of a fixed sentencepiece file and its scores.  Texts
are split at blanks, each word led by the mark of a blank, as the library's
``Metaspace`` does; a word's count is remembered, so frequent words are
counted once.

Nulls and edge cases: a null or empty text has no tokens.  Rows that repeat a
doc_id are counted each for itself.  An empty table gives an empty result.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm.common import query, table, texts_of, tokenizer_path

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Most words whose count a worker remembers, and the longest.
CACHE, CACHED_CHARS = 300_000, 48


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, in order of their ids."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class Counter:
    """Token counts of whole texts."""

    def __init__(self, vocab: list[tuple[str, float]]):
        import ahocorasick

        self.find = ahocorasick.Automaton()
        for piece, score in vocab:
            if piece:
                self.find.add_word(piece, (len(piece), score))
        self.find.make_automaton()
        self.unknown = min(s for _, s in vocab) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Pieces on the best path through one word."""
        n = len(word)
        ends: list[list] = [[] for _ in range(n)]
        for e, piece in self.find.iter(word):
            ends[e].append(piece)
        score, count, open_ = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for e in range(1, n + 1):
            best, at, known = None, 0, False
            single = False
            for size, s in sorted(ends[e - 1], reverse=True):  # the earliest start first
                single = single or size == 1
                total = s + score[e - size]
                if best is None or total > best:
                    best, at, known = total, e - size, True
            if not single:
                total = self.unknown + score[e - 1]
                if best is None or total > best:
                    best, at, known = total, e - 1, False
            score[e] = best
            open_[e] = not known
            count[e] = count[at] + (0 if not known and open_[at] else 1)
        return count[n]

    def text(self, text: str) -> int:
        if not text:
            return 0
        first, *rest = text.replace(MARK, " ").split(" ")
        words = ([MARK + first] if first or not rest else []) + [MARK + w for w in rest]
        total = 0
        known = self.known
        for w in words:
            n = known.get(w)
            if n is None:
                n = self.word(w)
                if len(w) <= CACHED_CHARS:
                    if len(known) < CACHE:
                        known[w] = n
            total += n
        return total


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens."""
    path = path or tokenizer_path("piece_bpe_32k.model")

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if path not in _counters:
            _counters[path] = Counter(vocabulary(path))
        c = _counters[path]
        for b in batches:
            yield pd.Series([c.text(t) for t in texts_of(b)], dtype="int64")

    return docs.select("doc_id", count(F.col("text")).alias("n_tokens"))


@query()
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
