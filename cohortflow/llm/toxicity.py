"""Operator 6, toxicity: a convolutional text classifier.

A word's hash picks an embedding; filters of several widths run over the
words of the whole text, each is pooled to its maximum and a logistic layer
gives a probability.  The model learns from every labelled row that may be learnt,
a fourth of which only calibrates: for each language a threshold is chosen,
and scores are bent so that it lies at ``CUT``.  A text's language is guessed
from the same hashed words, never from a column; texts of languages with too
few labelled rows get the common threshold.

The rows are dealt by a hash of their id over shards of about ``SHARD_ROWS``,
each a partition of one settled table.  Every epoch is a Spark job: a task
trains the shared model on its shard, and the models are averaged in a tree
(an embedding over the shards that changed it).  The words' counts, those of
the languages and the calibration are sums over the shards.  What reaches the
driver is one model, or one row a score of the calibrating rows, which are
rounded to five digits if they are more than ``EXACT_SCORES``.

Words that a smaller share than ``LEAST_SHARE`` of the labelled texts hold have no embedding, so
that words never seen in training do not speak.

Nulls and edge cases: a null or empty text, or one without letters, gets the
score of the empty text.  Rows that repeat a doc_id are scored each for itself;
a doc_id with contradicting labels teaches the larger one.  Without labelled
rows, or with labels of one kind, every score is the share of toxic labels
bent below ``CUT``.  An empty table gives an empty result.  Columns other than
doc_id, text and lang are not read, and lang only to learn the guess.
"""

from __future__ import annotations

import copy
import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm.common import in_train, lean, query, release, single_thread, sized, table, texts_of
from cohortflow.session import settled

#: Labelled rows, and hashed words, of a shard (about): what one task trains on before the models are averaged.
SHARD_ROWS, SHARD_WORDS = 12_000, 16_000_000
#: Calibrating rows whose scores are taken as they are; those of more rows are rounded.
EXACT_SCORES = 100_000
BUCKETS = 1 << 18
DIM, FILTERS, WIDTHS = 16, 16, (1, 2, 3)
EPOCHS, RATE = 5, 0.05
#: A word has an embedding if this share of the sample's texts hold it, and three at least.
LEAST_SHARE = 1 / 600
#: Texts whose error is smaller teach nothing more.
SETTLED = 0.02
CUT = 0.3
#: Positive and negative calibration rows that a language needs for its own threshold.
OWN_THRESHOLD = (20, 60)
GAP = max(WIDTHS) - 1
CACHE = 100_000
WORD = re.compile(r"[^\W\d_]+")


def buckets(texts: list[str], known: dict[str, int] | None = None) -> list[np.ndarray]:
    """Hashed words of each text; 0 is kept for padding.  ``known`` remembers the first CACHE words."""
    out = []
    known = {} if known is None else known
    get = known.get
    for t in texts:
        words = WORD.findall(t.lower())
        ids = [get(w) for w in words]
        if None in ids:
            for i, x in enumerate(ids):
                if x is None:
                    ids[i] = 1 + zlib.crc32(words[i].encode()) % (BUCKETS - 1)
                    if len(known) < CACHE:
                        known[words[i]] = ids[i]
        out.append(np.array(ids, dtype=np.int32))
    return out


class Model:
    """Parameters and forward pass; rows of ``embed`` are kept only for words that were learnt."""

    def __init__(self, rows: np.ndarray, embed: np.ndarray, rng: np.random.Generator):
        self.rows, self.embed = rows, embed  # rows: bucket -> row of embed, 0 for words without one
        self.conv = [rng.normal(0, (w * DIM) ** -0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
        self.shift = np.float32(-2.0)
        self.languages: list[str] = []
        self.lang_table = np.zeros((len(embed), 0), np.float32)
        self.thresholds = np.zeros(0)
        self.common = 0.5

    def maps(self, x: np.ndarray) -> list[np.ndarray]:
        """Filter responses at each place; places beyond the end are padding."""
        n = len(x)
        x = np.concatenate((x, np.zeros((GAP, DIM), np.float32)))
        return [sum(x[j : n + j] @ w[j] for j in range(len(w))) + b for w, b in zip(self.conv, self.bias)]

    def pooled(self, ids: list[np.ndarray]) -> np.ndarray:
        """Max-pooled, rectified filters of each text, in blocks of about 50,000 words."""
        out = np.zeros((len(ids), FILTERS * len(WIDTHS)), np.float32)
        at = 0
        while at < len(ids):
            end, size = at, 0
            while end < len(ids) and (size < 50_000 or end == at):
                size += len(ids[end]) + GAP
                end += 1
            sizes = np.array([len(x) + GAP for x in ids[at:end]])
            cat = np.zeros(int(sizes.sum()), np.int32)
            starts = np.cumsum(sizes) - sizes
            for s, x in zip(starts, ids[at:end]):
                cat[s : s + len(x)] = self.rows[x]
            z = self.maps(self.embed[cat])
            # places after a text's last word would see the next text: as in training, they are no places
            after = (starts[1:, None] - np.arange(1, GAP + 1)).ravel()
            after = np.append(after, len(cat) - np.arange(1, GAP + 1))
            for m in z:
                m[after] = 0  # below nothing: responses are rectified
            out[at:end] = np.concatenate([np.maximum.reduceat(m, starts, axis=0) for m in z], axis=1)
            at = end
        return np.maximum(out, 0)

    def raw(self, ids: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.pooled(ids) @ self.out + self.shift).astype(np.float64)))

    def language(self, ids: list[np.ndarray]) -> np.ndarray:
        if not self.languages:
            return np.full(len(ids), -1)
        return np.array([int(self.lang_table[self.rows[x]].sum(axis=0).argmax()) if len(x) else -1 for x in ids])

    def score(self, ids: list[np.ndarray]) -> np.ndarray:
        """Probability bent, per language, so that the threshold lies at CUT."""
        p, lang = self.raw(ids), self.language(ids)
        t = np.append(self.thresholds, self.common)[lang]
        return np.clip(np.where(p < t, CUT * p / t, CUT + (1 - CUT) * (p - t) / (1 - t)), 0, 1)

    def ready(self) -> None:
        """Sums of squared gradients, which go with the model from epoch to epoch."""
        self.sums = [np.full(np.shape(x), 1e-3, np.float32) for x in self.dense()]
        self.acc_e = np.full(self.embed.shape, 1e-3, np.float32)

    def dense(self) -> list[np.ndarray]:
        return [*self.conv, *self.bias, self.out]

    def train(self, ids: list[np.ndarray], y: np.ndarray, share: float, rng: np.random.Generator) -> np.ndarray:
        """An epoch of Adagrad on the log loss, kinds of label in equal shares (``share``: that of label 1 among all);
        the maximum passes its gradient to its place alone.  Returns which embeddings were changed."""
        places = {("w", k): k for k in range(len(WIDTHS))} | {("b", k): len(WIDTHS) + k for k in range(len(WIDTHS))} | {"out": -1}
        acc_e, changed = self.acc_e, np.zeros(len(self.embed), bool)

        def step(name, value, grad):
            acc = self.sums[places[name]]
            acc += grad * grad
            value -= RATE * grad / np.sqrt(acc)

        weight = np.where(y == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
        for i in rng.permutation(len(ids)):
            rows = self.rows[ids[i]]
            if not len(rows):
                continue
            x = np.concatenate((self.embed[rows], np.zeros((GAP, DIM), np.float32)))
            z = self.maps(x[: len(rows)])
            best = [m.argmax(axis=0) for m in z]
            pooled = np.concatenate([np.maximum(m[b, np.arange(FILTERS)], 0) for m, b in zip(z, best)])
            p = 1 / (1 + np.exp(-float(pooled @ self.out + self.shift)))
            if abs(p - y[i]) < SETTLED:
                continue
            g = np.float32(weight[i] * (p - y[i]))
            back = g * self.out * (pooled > 0)
            grad_x: dict[int, np.ndarray] = {}
            for k, w in enumerate(self.conv):
                gk = back[k * FILTERS : (k + 1) * FILTERS]
                grad_w = np.zeros_like(w)
                for j in range(len(w)):
                    grad_w[j] = (x[best[k] + j] * gk[:, None]).T
                    for place, part in zip((best[k] + j).tolist(), (w[j] * gk).T):
                        if place < len(rows):
                            row = int(rows[place])
                            if row:
                                grad_x[row] = grad_x.get(row, 0) + part
                step(("w", k), w, grad_w)
                step(("b", k), self.bias[k], gk)
            step("out", self.out, g * pooled + np.float32(1e-4) * self.out)
            self.shift -= np.float32(0.01) * g
            for row, grad in grad_x.items():
                acc_e[row] += grad * grad
                self.embed[row] -= RATE * grad / np.sqrt(acc_e[row])
                changed[row] = True
        return changed

    def learn_languages(self, counts: dict[str, np.ndarray]) -> None:
        """Smoothed log shares of each word in each language, from its occurrences."""
        self.languages = sorted(counts)
        table = np.full((len(self.embed), len(counts)), 0.1, np.float64)
        for k, lang in enumerate(self.languages):
            table[:, k] += counts[lang]
        table[0] = 1
        self.lang_table = np.log(table / table.sum(axis=0)).astype(np.float32)

    def calibrate(self, p: np.ndarray, hits: np.ndarray, lang: np.ndarray, n: np.ndarray | None = None) -> None:
        """Thresholds of greatest F0.5 (precision counts more), halfway between the two scores that they part; ``n`` rows
        (one, if not given), ``hits`` of them with label 1, have the score ``p`` and the guessed language ``lang``."""
        n = np.ones(len(p), np.int64) if n is None else n

        def best(own):
            scores, at = np.unique(-p[own], return_inverse=True)  # falling; ties are one score
            rows, good = (np.cumsum(np.bincount(at, x[own], len(scores))) for x in (n, hits))
            k = int((1.25 * good / (rows + 0.25 * good[-1])).argmax())
            below = -scores[k + 1] if k + 1 < len(scores) else 0.0
            return float(np.clip((-scores[k] + below) / 2, 1e-4, 1 - 1e-4))

        self.common = best(n > 0) if hits.any() else 0.5
        self.thresholds = np.full(len(self.languages), self.common)
        for k in range(len(self.languages)):
            own = lang == k
            if hits[own].sum() >= OWN_THRESHOLD[0] and (n - hits)[own].sum() >= OWN_THRESHOLD[1]:
                self.thresholds[k] = best(own)


class Shard:
    """Labelled rows in the order of their ids; every fourth calibrates, the rest trains."""

    def __init__(self, ids: list[np.ndarray], y: np.ndarray, langs: list, number: int = 0):
        self.ids, self.y, self.langs, self.number = ids, y, langs, number

    def calibrates(self, all_rows: bool = False) -> np.ndarray:
        return (np.arange(len(self.ids)) % 4 == 3) | all_rows

    def counts(self):
        """Texts that hold each bucket, and (rows, rows of label 1) in all and among those that calibrate."""
        docs = np.zeros(BUCKETS, np.int64)
        for x in self.ids:
            docs[np.unique(x)] += 1
        cal = self.calibrates()
        return docs, np.array([len(self.y), self.y.sum(), cal.sum(), self.y[cal].sum()], np.int64)

    def languages(self, m: Model) -> dict[str, np.ndarray]:
        """Occurrences of the learnt words in the texts of each language."""
        out: dict[str, np.ndarray] = {}
        for x, lang in zip(self.ids, self.langs):
            if lang is not None:
                out[lang] = out.get(lang, 0) + np.bincount(m.rows[x], minlength=len(m.embed))
        return out

    def epoch(self, m: Model, rngs: dict, seed: int, train_all: bool, share: float):
        """Sums over one shard of what ``averaged`` needs: parameters and sums of squares after an epoch, which embeddings
        were changed, the number of shards and the state of the draws."""
        rng = copy.deepcopy(rngs[self.number]) if self.number in rngs else np.random.default_rng([seed, self.number])
        m, mine = copy.deepcopy(m), np.flatnonzero(~self.calibrates() | train_all)
        if not len(mine):
            return None
        changed = m.train([self.ids[i] for i in mine], self.y[mine].astype(np.float64), share, rng)
        rows = np.flatnonzero(changed)
        embed = np.zeros((len(m.embed), 2 * DIM + 1), np.float32)
        embed[rows] = np.concatenate((m.embed[rows], m.acc_e[rows], np.ones((len(rows), 1), np.float32)), axis=1)
        return embed, [*m.dense(), *m.sums, np.float32(m.shift)], 1, {self.number: rng}

    def scored(self, m: Model, cal_all: bool, digits: int | None):
        """(score, language) of the calibrating rows with the number of rows and of those with label 1."""
        mine = np.flatnonzero(self.calibrates(cal_all))
        ids, out = [self.ids[i] for i in mine], {}
        p, lang = m.raw(ids), m.language(ids)
        for key, y in zip(zip((p if digits is None else p.round(digits)).tolist(), lang.tolist()), self.y[mine].tolist()):
            n, hits = out.get(key, (0, 0))
            out[key] = n + 1, hits + y
        return out


def both(a, b):
    """Sum of two results of a step, part by part."""
    if a is None or b is None:
        return b if a is None else a
    if isinstance(a, dict):
        return a | {k: both(a.get(k), v) for k, v in b.items()}
    if isinstance(a, (tuple, list)):
        return type(a)(both(x, y) for x, y in zip(a, b))
    return a + b


def averaged(m: Model, sums) -> dict:
    """Puts the mean of the shards' models into m; returns the states of the draws."""
    embed, dense, n, rngs = sums
    rows = np.flatnonzero(embed[:, -1])
    mean = embed[rows, :-1] / embed[rows, -1:]
    m.embed[rows], m.acc_e[rows] = mean[:, :DIM], mean[:, DIM:]
    for mine, x in zip([*m.dense(), *m.sums], dense):
        mine[:] = x / np.float32(n)
    m.shift = np.float32(dense[-1] / np.float32(n))
    return rngs


def learn(over: Callable, seed: int = 7) -> Model:
    """A calibrated model of all shards; ``over(step, *values)`` is the sum of ``step(shard, *values)`` over them."""
    rng = np.random.default_rng(seed)
    docs, (n, good, n_cal, good_cal) = over(Shard.counts) or (np.zeros(BUCKETS, np.int64), (0, 0, 0, 0))
    docs[0] = 0
    learnt = np.flatnonzero(docs >= max(3, LEAST_SHARE * n))
    rows = np.zeros(BUCKETS, np.int32)
    rows[learnt] = np.arange(1, len(learnt) + 1)
    embed = rng.normal(0, 0.1, (len(learnt) + 1, DIM)).astype(np.float32)
    embed[0] = 0
    m = Model(rows, embed, rng)
    if good in (0, n):
        m.out[:] = 0
        share = float(np.clip(good / n if n else 0.0, 1e-3, 0.999))
        m.shift, m.common = np.float32(np.log(share / (1 - share))), 0.9999
        return m
    m.learn_languages(over(Shard.languages, m) or {})
    cal_all = not good_cal  # no calibrating row has label 1: all rows calibrate, and all train
    train_all = cal_all or good == good_cal
    share = good / n if train_all else (good - good_cal) / (n - n_cal)
    m.ready()
    rngs = {0: rng}
    for _ in range(EPOCHS):
        rngs = averaged(m, over(Shard.epoch, m, rngs, seed, train_all, share))
    found = over(Shard.scored, m, cal_all, None if (n if cal_all else n_cal) <= EXACT_SCORES else 5)
    (p, lang), (rows_at, hits) = np.array([*found]).T, np.array([*found.values()]).T
    m.calibrate(p, hits, lang.astype(int), rows_at)
    del m.sums, m.acc_e
    return m


def fit(texts: list[str], y: np.ndarray, langs: list, seed: int = 7) -> Model:
    """A calibrated model of one shard, here."""
    shard = Shard(buckets(texts), np.asarray(y), langs)
    return learn(lambda step, *values: step(shard, *values), seed)


def fit_on(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on every labelled row that may be learnt: each step runs in the tasks that hold the shards."""
    spark = docs.sparkSession
    marked = labels.select(F.col("doc_id").alias("tid"), "toxic").filter("tid is not null and toxic is not null")
    marked = sized(marked.filter(in_train("tid")).groupBy("tid").agg((F.max("toxic") > 0).cast("int").alias("y")))
    cols = [F.col("doc_id"), F.col("text"), F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")]
    got = docs.select(*cols).filter("text is not null").filter(in_train()).join(marked, F.col("doc_id") == F.col("tid"))

    @F.pandas_udf("binary")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, int] = {}
        for b in batches:
            yield pd.Series([x.tobytes() for x in buckets(b.tolist(), known)], dtype=object)

    rows = settled(got.select("doc_id", hashed("text").alias("ids"), "lang", "y"))
    n, words = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("ids")) / 4).first()
    shards = max(1, -(-n // SHARD_ROWS), int((words or 0) // SHARD_WORDS))
    rows = settled(rows.repartition(shards, "doc_id").sortWithinPartitions("doc_id", "ids", "lang"))
    held, groups = rows.select("ids", "lang", "y").rdd, math.isqrt(shards)

    def over(step, *values):
        shared = spark.sparkContext.broadcast(values)

        def run(number, part):
            single_thread()
            part = [(np.frombuffer(r.ids, np.int32), r.y, r.lang) for r in part]
            try:
                if part:
                    yield number % groups, step(Shard([x for x, _, _ in part], np.array([y for _, y, _ in part]), [lang for _, _, lang in part], number), *shared.value)
            finally:
                release()

        try:
            return held.mapPartitionsWithIndex(run).reduceByKey(both, groups).values().treeAggregate(None, both, both)
        finally:
            shared.destroy()

    return learn(over)


def score_udf(spark: SparkSession, model: Model):
    shared = spark.sparkContext.broadcast(model)

    @lean
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        single_thread()
        known: dict[str, int] = {}
        for b in batches:
            texts = texts_of(b)
            yield pd.Series(np.concatenate([shared.value.score(buckets(texts[i : i + 128], known)) for i in range(0, len(texts), 128)]) if texts else np.zeros(0))

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from judged(batches)

    return toxicity


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    toxicity = score_udf(docs.sparkSession, fit_on(docs, labels))
    out = docs.select("doc_id", (~in_train()).alias("held_out"), toxicity(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs whose score is below CUT; one pass, no join."""
    toxicity = score_udf(docs.sparkSession, fit_on(docs, labels))
    return docs.filter(toxicity(F.col("text")) < CUT)


@query()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
