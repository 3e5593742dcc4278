"""Operator 13, hard-negative mining by slot-decomposed selection.

An anchor's positives are the best other rows of its label; a positive's negatives are
the best rows of other labels whose score lies in the window from ``share`` of the positive's score
up to that score.  The windows of one anchor overlap, so they are not answered one by one: the
positives' scores (upper limits) split the scores into disjoint slots, a row falls into the slot below the
least upper limit that its score does not exceed, and only the first k rows of a slot can be
needed by any window.  Tasks combine to k rows for each (anchor, slot), Spark merges those to k again, and
the first k of window i are the first k of the slots i, i+1, ... in this (descending) order, cut at the
window's lower limit.

Scores are exact integers.  The quantised rows are written once; anchors are the stated query set and
go through in blocks of about ``ANCHOR_BYTES``, each a broadcast against all rows, in two passes
(positives, then slots).  A task holds ``ROWS`` rows and at most k answers for each anchor and slot.

Defined results: rows with a null label or vector, or a null or non-finite component, take no part.  A row with a
null vec_id is no anchor but may be chosen; its id is null and comes last among equal scores.  Rows that repeat a
vec_id are rows of their own: each is an anchor, and each may be chosen by the other.  A shorter vector
counts as filled up with zeros; an empty one scores 0.  A score that a long cannot hold raises.
Labels are compared, never reduced, but for the shifted ones.  An anchor without positives or a positive without
negatives has no row.  An empty table gives an empty result.  Columns other than vec_id, embedding and label are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortflow.llm.common import NO_ID, lean, query, scratch, settings, staged, table

POSITIVES = NEGATIVES = 5
ANCHOR_EVERY, SHIFT_EVERY, LABELS, SCALE = 100, 7, 10, 256
#: A window reaches from LOW to HIGH hundredths of the positive's score.
LOW, HIGH = 80, 100
#: Vector bytes of a block of anchors, and rows and anchors multiplied at a time.
ANCHOR_BYTES, ROWS, ANCHORS = 16 << 20, 4096, 256
_EXACT = 2.0**53


def quantised(rows: DataFrame) -> DataFrame:
    """row, vec_id (NO_ID for null), label, vec (array of long) of the rows that take part; staged."""
    vec = F.col("embedding").cast("array<double>")
    sound = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col("vec_id") % SHIFT_EVERY == 0, (F.col("label").cast("long") + 1) % LABELS).otherwise(F.col("label").cast("long"))
    out = rows.filter(F.coalesce(sound, F.lit(False))).select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), label.alias("label"), F.transform(vec, lambda x: F.floor(SCALE * x).cast("double")).alias("vec")
    )
    return staged(out.withColumn("row", F.monotonically_increasing_id()), "quantised")


def _matrix(vecs, width: int = 0) -> np.ndarray:
    vecs = [np.asarray(v, float) for v in vecs]
    out = np.zeros((len(vecs), max([width, *map(len, vecs)])))
    for i, v in enumerate(vecs):
        out[i, : len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number vectors as longs: by doubles where no sum can reach
    2**53, by Python integers elsewhere."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * width < _EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in v] for v in m], object)
    got = whole(a) @ whole(b).T
    if max(map(abs, got.ravel())) >= 2**63:
        raise OverflowError("a score does not fit in a long")
    return got.astype(np.int64)


class Anchors:
    """A block of anchors and, for the second pass, the upper limits of each (descending, padded)."""

    def __init__(self, rows: list, limits: np.ndarray | None = None):
        self.row = np.array([r.row for r in rows], np.int64)
        self.label = np.array([r.label for r in rows], np.int64)
        self.vecs = _matrix([r.vec for r in rows])
        self.limits = limits


#: key: slot (0 for positives) of an anchor; score; vec_id and row of the chosen one.
KEPT = ("anchor", "slot", "score", "vec_id", "row")


def _first(kept: np.ndarray, k: int) -> np.ndarray:
    """The first k of each (anchor, slot): highest score, then smallest vec_id, then row."""
    kept = kept[np.lexsort((kept[:, 4], kept[:, 3], -kept[:, 2], kept[:, 1], kept[:, 0]))]
    new = np.concatenate(([True], (np.diff(kept[:, :2], axis=0) != 0).any(axis=1)))
    starts = np.flatnonzero(new)
    rank = np.arange(len(kept)) - np.repeat(starts, np.diff(np.append(starts, len(kept))))
    return kept[rank < k]


NONE = np.iinfo(np.int64).min


def _slots(score: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Slot of each score: the last upper limit (they descend) that it does not exceed; -1 above all of them."""
    return (score[..., None] <= limits).sum(axis=-1) - 1


def _combine(anchors, k: int):
    """A task's first k rows of each (anchor, slot)."""

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: Anchors = anchors.value
        n_slots = 1 if own.limits is None else own.limits.shape[1]
        bar = np.full((len(own.row), n_slots), NONE)  # the k-th score so far: less cannot be needed
        kept = np.empty((0, 5), np.int64)
        for b in batches:
            vecs = _matrix(b["vec"])
            label, vec_id, row = (b[c].to_numpy(np.int64) for c in ("label", "vec_id", "row"))
            got = []
            for a in range(0, len(own.row), ANCHORS):
                part = slice(a, a + ANCHORS)
                score = products(own.vecs[part], vecs)
                same = own.label[part, None] == label
                if own.limits is None:
                    i, j = np.nonzero(same & (own.row[part, None] != row) & (score >= bar[part, :1]))
                    slot = np.zeros(len(i), np.int64)
                else:
                    top = own.limits[part, :1]
                    last = np.where(own.limits[part] == NONE, np.inf, own.limits[part]).min(axis=1)
                    i, j = np.nonzero(~same & (score <= top) & (score * 100.0 >= (LOW * last - np.abs(last) * 1e-9 - 1.0)[:, None]))
                    slot = _slots(score[i, j], own.limits[part][i])
                    fits = score[i, j] >= bar[part][i, slot]
                    i, j, slot = i[fits], j[fits], slot[fits]
                got.append(np.stack([i + a, slot, score[i, j], vec_id[j], row[j]], axis=1))
            new = np.concatenate([kept, *got])
            if len(new) > len(kept):
                kept = _first(new, k)
                full = np.flatnonzero(np.concatenate(((np.diff(kept[:, :2], axis=0) != 0).any(axis=1), [True])))
                sizes = np.diff(np.concatenate(([-1], full)))
                done = full[sizes == k]
                bar[kept[done, 0], kept[done, 1]] = kept[done, 2]
        yield pd.DataFrame(kept, columns=KEPT)

    return run


def _merged(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _pass(rows: DataFrame, anchors: Anchors, k: int, name: str) -> DataFrame:
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(anchors)
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(ROWS)}):
        found = rows.mapInPandas(_combine(shared, k), "anchor long, slot long, score long, vec_id long, row long")
        out, at = _merged(found, k).select("anchor", "slot", "rank", "score", "vec_id"), scratch(spark, name)
        out.write.parquet(at)
    shared.destroy()
    return spark.read.schema(out.schema).parquet(at)


def _windows(slots: DataFrame, positives: DataFrame, k: int) -> DataFrame:
    """The first k negatives of each positive's window, from the slots of its anchor.  Slots in
    order are scores in descending order, so a window is a suffix of them."""
    chosen = slots.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", F.col("rank").alias("at"), "score", "vec_id"))).alias("all"))
    own = positives.select("anchor", F.col("rank").alias("nth"), F.col("score").alias("positive_score"), F.col("vec_id").alias("positive"))
    fits = F.filter("all", lambda x: (x["slot"] >= F.col("nth") - 1) & (F.lit(LOW).cast("decimal(20,0)") * F.col("positive_score") <= F.lit(100).cast("decimal(20,0)") * x["score"]))
    return own.join(chosen, "anchor").select("anchor", "positive", "positive_score", F.posexplode(F.slice(fits, 1, k)).alias("at", "negative"))


def mine(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = rows.sparkSession
    rows = quantised(rows)
    asked = rows.filter((F.col("vec_id") % ANCHOR_EVERY == 0) & (F.col("vec_id") != NO_ID))
    size = asked.agg(F.sum(F.size("vec") * 8 + 32)).first()[0] or 0
    blocks = max(1, -(-int(size) // anchor_bytes)) if size else 0
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for k in range(blocks):  # a bounded block of the query set at a time
        block = sorted(asked.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == k).collect(), key=lambda r: r.row)
        if not block:
            continue
        found = _pass(rows, Anchors(block), positives, "positives")
        limits = np.full((len(block), positives), NONE)
        for r in found.select("anchor", "rank", "score").collect():  # at most ``positives`` an anchor
            limits[r["anchor"], r["rank"] - 1] = r["score"]
        slots = _pass(rows, Anchors(block, limits), negatives, "slots")
        ids = F.broadcast(spark.createDataFrame([(i, r.vec_id) for i, r in enumerate(block)], "anchor long, anchor_id long"))
        own = _windows(slots, found, negatives).join(ids, "anchor")
        null_or = lambda c: F.when(c != NO_ID, c)
        out = out.unionByName(own.select(
            "anchor_id", null_or(F.col("positive")).alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"),
            null_or(F.col("negative.vec_id")).alias("negative_id"), "positive_score", F.col("negative.score").alias("negative_score"),
        ))
    return out


SQL = """
WITH v AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.vec, b.vec) AS BIGINT) AS score
           FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
     p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS nth FROM s WHERE same) WHERE nth <= 5),
     n AS (SELECT p.anchor_id, p.other AS positive_id, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score,
                  row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) AS rank
           FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


@query(SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))
