"""Operator 1, language ID: segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary (32,000 pieces of a sentencepiece
model, lower-cased) have a probability in each language.  A forward algorithm
sums over all segmentations of a word into pieces, so a text's likelihood is
that of its words under every segmentation at once.  Probabilities are learnt
by expectation maximisation: Spark counts the words of a bounded sample of
labelled rows (``ROWS_PER_LANGUAGE``), and each round sums the expected piece
counts of a forward and a backward pass over all distinct words.  Single
letters outside the vocabulary have a small fixed probability.

A word is a run of letters, of any length.  Words repeat, so workers remember
the likelihoods of frequent ones.  One longer than ``LONGEST`` letters goes through
the same forward sum on its own, with only the last places kept (as many as the
longest piece has letters), and is scored whole; such words are not learnt from.

Nulls and edge cases: a text that is null or has no letter is ``und`` with
score 0.  Equal likelihoods go to the first language in sort order.  Rows that
repeat a doc_id are judged each for itself.  Without labelled rows every text
is ``und``.  An empty table gives an empty result.  Columns other than doc_id,
text and lang are not read, and lang only to learn.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm.common import in_train, query, single_thread, staged, table, texts_of, tokenizer_path

#: Sample rows of each language that train the model, at most (about); EM rounds.
ROWS_PER_LANGUAGE = 1000
ROUNDS = 3
#: Most languages a model may have: bounds what is broadcast (pieces x languages).
MOST_LANGUAGES = 256
#: Longest words that are learnt from and remembered.
LONGEST = 32
FLOOR = 1e-7
MARK = "▁"
CACHE = 300_000
RUN = re.compile(r"[^\W\d_]+")


def vocabulary(path: str) -> dict[str, int]:
    """Lower-cased pieces of letters, with or without the mark of a word's start."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: dict[str, int] = {}
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i).lower()
        if p.removeprefix(MARK).isalpha():
            pieces.setdefault(p, len(pieces))
    return pieces


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters, each with the mark of a word's start."""
    return [MARK + (w if w.isalpha() else "".join(c for c in w if c.isalpha())) for w in RUN.findall(text.lower())]


_automata: list[tuple] = []


def automaton_of(pieces: dict[str, int]):
    """Aho-Corasick automaton of the pieces (number * 64 + letters), built once a worker."""
    for own, auto in _automata:
        if own is pieces:
            return auto
    import ahocorasick

    auto = ahocorasick.Automaton()
    for p, n in pieces.items():
        auto.add_word(p, (n << 6) + len(p))
    auto.make_automaton()
    _automata[:] = [*_automata[-1:], (pieces, auto)]
    return auto


class Lattice:
    """All pieces that match somewhere in some words, as arrays by end place."""

    def __init__(self, words: list[str], pieces: dict[str, int]):
        self.sizes = np.array([len(w) for w in words], dtype=np.int64)
        self.n = len(words)
        offset = np.cumsum(self.sizes + 1) - (self.sizes + 1)
        of = np.repeat(np.arange(self.n), self.sizes + 1)  # the word of each letter (and of the gap after it)
        found = list(automaton_of(pieces).iter("\n".join(words))) if pieces and words else []
        last, value = np.array(found, dtype=np.int64).reshape(-1, 2).T
        size, piece = value & 63, value >> 6
        alone = np.ones(len(of), bool)
        alone[last[size == 1]] = False
        alone[offset + self.sizes] = False
        spare = np.flatnonzero(alone)  # a letter, or the mark, that is no piece
        end = np.concatenate((last, spare)) + 1
        start = end - np.concatenate((size, np.ones(len(spare), np.int64)))
        piece = np.concatenate((piece, np.full(len(spare), len(pieces))))
        word = of[start]
        start, end = start - offset[word], end - offset[word]
        order = np.lexsort((start, word, end))
        self.word, self.start, self.end, self.piece = word[order], start[order], end[order], piece[order]
        cuts = np.searchsorted(self.end, np.arange(2, int(self.sizes.max(initial=1)) + 1))
        self.by_end = np.split(np.arange(len(order)), cuts)

    def forward(self, prob: np.ndarray) -> np.ndarray:
        """alpha[word, place, language]: sum over the segmentations of the first letters."""
        alpha = np.zeros((self.n, int(self.sizes.max(initial=0)) + 1, prob.shape[1]))
        alpha[:, 0] = 1
        for e, m in enumerate(self.by_end, 1):
            w = self.word[m]
            first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1]))) if len(m) else []
            if len(m):
                alpha[w[first], e] = np.add.reduceat(alpha[w, self.start[m]] * prob[self.piece[m]], first, axis=0)
        return alpha

    def total(self, prob: np.ndarray) -> np.ndarray:
        return self.forward(prob)[np.arange(self.n), self.sizes]

    def expected(self, prob: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected piece counts, given how often each language has each word."""
        alpha = self.forward(prob)
        beta = np.zeros_like(alpha)
        total = alpha[np.arange(self.n), self.sizes]
        beta[np.arange(self.n), self.sizes] = counts / total
        out = np.zeros_like(prob)
        for m in reversed(self.by_end):
            e = self.end[m]
            w = self.word[m]
            flow = beta[w, e] * prob[self.piece[m]]
            np.add.at(out, self.piece[m], alpha[w, self.start[m]] * flow)
            np.add.at(beta, (w, self.start[m]), flow)
        return out


class Model:
    def __init__(self, pieces: dict[str, int], languages: list[str], prob: np.ndarray):
        self.pieces, self.languages, self.prob = pieces, languages, prob
        self.longest = max(map(len, pieces), default=1)

    def log_words(self, words: list[str]) -> np.ndarray:
        return np.log(Lattice(words, self.pieces).total(self.prob))

    def log_long(self, word: str) -> np.ndarray:
        """The same sum for a word of any length: only the last ``longest`` places are kept, scaled to their greatest."""
        alpha, scale = [np.ones(self.prob.shape[1])], np.zeros(self.prob.shape[1])
        get, unknown = self.pieces.get, len(self.pieces)
        for e in range(1, len(word) + 1):
            now = np.zeros(self.prob.shape[1])
            for back, before in enumerate(reversed(alpha), 1):
                piece = get(word[e - back : e], unknown if back == 1 else None)
                if piece is not None:
                    now = now + before * self.prob[piece]
            alpha = [*alpha[-(self.longest - 1) :], now] if self.longest > 1 else [now]
            if e % 16 == 0:
                top = np.maximum.reduce(alpha)
                alpha = [a / top for a in alpha]
                scale += np.log(top)
        return np.log(alpha[-1]) + scale


def fit_on(docs: DataFrame, path: str, rows: int = ROWS_PER_LANGUAGE, rounds: int = ROUNDS) -> Model:
    """EM on the word counts of about ``rows`` rows of each language, chosen by a hash of the id."""
    pieces = vocabulary(path)
    have = docs.select("doc_id", "lang").filter(in_train() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["count"] for r in have.groupBy("lang").count().sort("lang").limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values of lang")
    languages = sorted(sizes)
    if not languages:
        return Model(pieces, [], np.zeros((len(pieces) + 1, 0)))
    parts = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1_000_000, 1 + 1_000_000 * rows // sizes[lang]))])
    draw = F.pmod(F.xxhash64(F.lit(1), F.col("doc_id")), F.lit(1_000_000)) < parts[F.col("lang")]
    sample = docs.select("doc_id", "lang", "text").filter(in_train() & F.col("lang").isNotNull() & F.col("text").isNotNull() & draw)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c: Counter = Counter()
            for lang, text in zip(b["lang"], b["text"]):
                c.update((lang, w) for w in words_of(text) if len(w) <= LONGEST)
            yield pd.DataFrame([(lang, w, n) for (lang, w), n in c.items()], columns=["lang", "word", "n"])

    place = F.create_map(*[F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)])
    words = sample.mapInPandas(count, "lang string, word string, n long").groupBy("word").agg(
        F.collect_list(F.struct(place[F.col("lang")].alias("k"), "n")).alias("ns"))  # a list of at most one entry for each batch
    words = staged(words, "langid-words")
    size = len(pieces) + 1
    prob = np.full((size, len(languages)), 1.0 / size)
    spark = docs.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, prob))

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pieces, prob = shared.value
            total = np.zeros_like(prob)
            for b in batches:
                for at in range(0, len(b), 2000):
                    some = b.iloc[at : at + 2000]
                    counts = np.zeros((len(some), prob.shape[1]))
                    for i, ns in enumerate(some["ns"]):
                        for r in ns:
                            counts[i, r["k"]] += r["n"]
                    total += Lattice(some["word"].tolist(), pieces).expected(prob, counts)
            piece, lang = np.nonzero(total)
            yield pd.DataFrame({"piece": piece, "lang": lang, "n": total[piece, lang]})

        sums = words.mapInPandas(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        prob = np.zeros((size, len(languages)))
        prob[sums["piece"], sums["lang"]] = sums["n"]
        prob = np.maximum(prob / np.maximum(prob.sum(axis=0), 1e-300), FLOOR)
    return Model(pieces, languages, prob)


def predict_texts(model: Model, texts: list[str], known: dict[str, int], table_: list[np.ndarray]) -> Iterator[tuple[str, float]]:
    """Language and posterior of each text.  ``known`` numbers the words whose
    log likelihoods fill ``table_`` (one array that grows by doubling)."""
    split = [words_of(t) for t in texts]
    long = [[w for w in ws if len(w) > LONGEST] for ws in split]
    split = [[w for w in ws if len(w) <= LONGEST] if lo else ws for ws, lo in zip(split, long)]
    new = list({w for ws in split for w in ws if w not in known})
    if len(known) + len(new) > CACHE:
        known.clear()
        new = list({w for ws in split for w in ws})
    if new:
        logs = np.concatenate([model.log_words(new[i : i + 2000]) for i in range(0, len(new), 2000)])
        need = len(known) + len(new)
        if need > len(table_[0]):
            grown = np.zeros((max(need, 2 * len(table_[0])), logs.shape[1]), np.float32)
            grown[: len(table_[0])] = table_[0]
            table_[0] = grown
        at = len(known)
        table_[0][at:need] = logs
        known.update(zip(new, range(at, need)))
    for ws, lo in zip(split, long):
        if not (ws or lo) or not model.languages:
            yield "und", 0.0
            continue
        s = table_[0][[known[w] for w in ws]].sum(axis=0, dtype=np.float64)
        for w in lo:
            s = s + model.log_long(w)
        best = int(s.argmax())
        yield model.languages[best], float(1 / np.exp(s - s[best]).sum())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def language(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        single_thread()
        m = shared.value
        known: dict[str, int] = {}
        rows = [np.zeros((1 << 14, len(m.languages)), np.float32)]
        for b in batches:
            texts = texts_of(b)
            out = [r for i in range(0, len(texts), 512) for r in predict_texts(m, texts[i : i + 512], known, rows)]
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    return docs.select("doc_id", language(F.col("text")).alias("found")).select("doc_id", "found.lang_pred", "found.score")


@query()
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, fit_on(docs, tokenizer_path("piece_bpe_32k.model")))
    return out.select("doc_id", (~in_train()).alias("held_out"), "lang_pred", "score")
