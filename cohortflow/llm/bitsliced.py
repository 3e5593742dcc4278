"""Operator 12, ranked lexical search by bit-sliced Bloom signatures.

Index (``build``): documents are dealt, inside the task that reads them, to
blocks of documents with about as many signature keys.  The keys of a document are
its terms, once for each power of two that their frequency reaches.  A block
keeps its signatures bit-sliced: for each signature bit one bitmap with a bit for
each document, so a key's documents are the AND of ``HASHES`` slices - never too few,
sometimes too many.  Next to them stand each document's length, and, read only for
rescoring, the texts themselves.  A table holds the exact document frequency of every term.

Search: the presence bitmaps of a term, level by level, bound its frequency in each
document, hence its share of the score; summed with the terms' weights over the
documents of a block (one product of matrices) they bound every document's score from above.
One pass over the slices alone finds the ``top`` documents of highest bound, whose
exact scores give each item a threshold that its last answer cannot be below.  The second pass scores exactly
every document whose bound reaches the threshold, from its whole text, and
keeps the ``top`` best of a task; Spark merges them.  What is not scored is provably
below ``top`` others.  Items go through in blocks of about ``ITEM_TERMS`` terms, one broadcast at a time.

Defined results: null and empty texts and items have no terms; they have no answers and are in no answer.  Items are
told apart by item_id: rows that share one (null is one id too) are one item with the terms of all.
Rows that repeat a doc_id, null among them, are ranked each for itself; equal scores go by doc_id, null last.
An empty table gives an empty result.  Columns other than doc_id, text and item_id are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortflow.llm.common import id_in, id_out, lean, query, settings, staged, table
from cohortflow.llm.textops import mix, utf8

TOP = 10
#: Hash functions of a signature and bits for each key that the fullest document of a block may have.
HASHES, BITS = 3, 8
#: A block ends at so many documents, or so many bytes of text.
BLOCK_DOCS, BLOCK_BYTES = 4096, 2 << 20
#: Terms of the items that one broadcast carries, and presence cells (terms x documents) held at a time.
ITEM_TERMS, CELLS = 20_000, 2 << 20
#: FIXED VALUES: the terms and the weights of the score.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xFF]+")
ONE, FLAT, LONG_ = 1_000_000_000, 10, 90

_U = np.uint64


def terms_of(raw: bytes) -> Counter:
    """Terms (bytes, A-Z lower-cased) and their occurrences."""
    return Counter(TERM.findall(raw.lower()))


def term_hash(terms: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in terms), np.uint64, len(terms))


def levels(tf: np.ndarray) -> np.ndarray:
    """How many keys a term has: one for each power of two up to its occurrences."""
    return np.frexp(tf)[1].astype(np.int64)


def slots(hashes: np.ndarray, level: np.ndarray | int, bits: int) -> np.ndarray:
    """The HASHES signature bits of (term, level) keys."""
    with np.errstate(over="ignore"):
        h = mix(hashes + _U(0x9E3779B97F4A7C15) * np.asarray(level, _U))
        step = (h >> _U(32)) | _U(1)
        return np.stack([((h + step * _U(i)) % _U(bits)).astype(np.int64) for i in range(HASHES)])


class Block:
    """Documents with about as many keys, gathered by a task."""

    def __init__(self, size_class: int):
        self.bits = BITS << size_class
        self.ids: list[int] = []
        self.raws: list[bytes] = []
        self.counts: list[int] = []
        self.marks: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id: int, raw: bytes, hashes: np.ndarray, tf: np.ndarray) -> None:
        lv = levels(tf)
        key = np.repeat(np.arange(len(tf)), lv)
        level = np.arange(len(key)) - np.repeat(np.cumsum(lv) - lv, lv)
        self.marks.append(np.unique(slots(hashes[key], level, self.bits).ravel()).astype(np.int32))
        self.ids.append(doc_id)
        self.raws.append(raw)
        self.counts.append(int(tf.sum()))
        self.bytes += len(raw)

    def row(self) -> tuple:
        import zstandard

        n = len(self.ids)
        wide = -(-n // 8)
        slices = np.zeros((self.bits, wide), np.uint8)
        doc = np.repeat(np.arange(n), [len(m) for m in self.marks])
        np.bitwise_or.at(slices, (np.concatenate(self.marks), doc >> 3), (0x80 >> (doc & 7)).astype(np.uint8))
        squeeze = zstandard.ZstdCompressor(level=1).compress
        sizes = np.array([len(r) for r in self.raws], "<i8").tobytes()
        return n, sum(self.counts), self.bits, np.array(self.ids, "<i8").tobytes(), np.array(self.counts, "<i8").tobytes(), squeeze(slices.tobytes()), sizes, squeeze(b"".join(self.raws))


BLOCKS = "docs int, tokens long, bits int, ids binary, counts binary, slices binary, sizes binary, texts binary"
BUILT = BLOCKS + ", terms array<string>, df array<long>"


class Index:
    """blocks: staged BLOCKS with ``block``; frequencies: term, df; documents, terms: N and L."""

    def __init__(self, blocks: DataFrame, frequencies: DataFrame):
        self.blocks, self.frequencies = blocks, frequencies
        n, total = blocks.agg(F.sum("docs"), F.sum("tokens")).first()
        self.documents, self.terms = int(n or 0), int(total or 0)


def build(docs: DataFrame) -> Index:
    """The index of all documents that hold a term; no document is shuffled."""

    @lean
    def blocks(batches: Iterator) -> Iterator:
        import pyarrow as pa

        open_: dict[int, Block] = {}
        vocabulary: Counter = Counter()

        types = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5, pa.list_(pa.string()), pa.list_(pa.int64())]

        def emit(size_class: int):
            """A row for a full block, with the terms of the documents read since the last one."""
            row = (*open_.pop(size_class).row(), [k.decode() for k in vocabulary], list(vocabulary.values()))
            vocabulary.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], [c.split()[0] for c in BUILT.split(", ")])

        for b in batches:
            for doc_id, raw in zip(b.column("doc_id").to_pylist(), utf8(b.column("text"))):
                tf = terms_of(raw)
                if not tf:
                    continue
                vocabulary.update(tf.keys())
                n = np.fromiter(tf.values(), np.int64, len(tf))
                size_class = int(levels(n).sum() - 1).bit_length()
                block = open_.setdefault(size_class, Block(size_class))
                block.add(doc_id, raw, term_hash(list(tf)), n)
                if len(block.ids) >= BLOCK_DOCS or block.bytes >= BLOCK_BYTES:
                    yield emit(size_class)
            if sum(x.bytes for x in open_.values()) > 8 * BLOCK_BYTES:
                biggest = max(open_, key=lambda c: open_[c].bytes)
                yield emit(biggest)
        for size_class in list(open_):
            yield emit(size_class)

    built = staged(docs.select(id_in(), "text").mapInArrow(blocks, BUILT).withColumn("block", F.monotonically_increasing_id()), "signatures")
    words = built.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.df").alias("df"))
    return Index(built.drop("terms", "df"), staged(words, "term-frequencies"))


def weight(documents: int, df: Column) -> Column:
    return F.floor(1000 * F.log(F.lit(2 * documents + 2).cast("double") / (2 * df + 1).cast("double"))).cast("long")


class Items:
    """A block of items: their distinct terms, and for each item its terms' numbers and weights."""

    def __init__(self, found: list[tuple], index: Index):
        self.documents, self.total = index.documents, index.terms
        names = sorted({t for _, t, _ in found})
        at = {t: i for i, t in enumerate(names)}
        self.of = {t.encode(): i for t, i in at.items()}
        self.hashes = term_hash(list(self.of))
        own: dict[tuple, list] = {}
        for item, t, w in found:
            own.setdefault(item, []).append((at[t], w))
        self.items = sorted(own)
        self.weights = [tuple(np.array(sorted(own[i]), np.int64).T) for i in self.items]  # (terms, weights)

    def mass(self, counts: np.ndarray) -> np.ndarray:
        """8 times the m of documents with so many terms."""
        return 8 * (FLAT + (LONG_ * counts * self.documents) // self.total)

    def bounds(self, counts: np.ndarray, slices: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores: items x documents of a block (whole numbers, exact as doubles)."""
        n, bits = len(counts), len(slices)
        m = self.mass(counts)
        out = np.zeros((len(self.items), n))
        step = max(1, CELLS // n)
        for a in range(0, len(self.hashes), step):
            hashes = self.hashes[a : a + step]
            there = np.full((len(hashes), slices.shape[1]), 255, np.uint8)
            share = np.zeros((len(hashes), n))
            live, before, level = np.arange(len(hashes)), np.zeros(n), 0
            while len(live) and (1 << level) <= counts.max():  # a term absent at one level is absent above
                for at in slots(hashes[live], level, bits):
                    there[live] &= slices[at]
                live = live[there[live].any(axis=1)]
                most = np.minimum((2 << level) - 1, counts)
                gain = (ONE * most) // (1000 * most + m)
                share[live] += np.unpackbits(there[live], axis=1, count=n) * (gain - before)
                before, level = gain, level + 1
            for i, (terms, weights) in enumerate(self.weights):
                low, high = np.searchsorted(terms, (a, a + step))
                if high > low:
                    out[i] += weights[low:high] @ share[terms[low:high] - a]
        return out

    def scores(self, raw: bytes, wanted: np.ndarray) -> np.ndarray:
        """Exact scores of a document for the wanted items."""
        tf = terms_of(raw)
        m = int(self.mass(np.array([sum(tf.values())]))[0])
        share = np.zeros(len(self.of), np.int64)
        for t, n in tf.items():
            if t in self.of:
                share[self.of[t]] = (ONE * n) // (1000 * n + m)
        return np.array([int((self.weights[i][1] * share[self.weights[i][0]]).sum()) for i in wanted], np.int64)


def _arrays(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    import zstandard

    ids, counts = np.frombuffer(row.ids, "<i8"), np.frombuffer(row.counts, "<i8")
    raw = zstandard.ZstdDecompressor().decompress(row.slices)
    return ids, counts, np.frombuffer(raw, np.uint8).reshape(row.bits, -1)


def _texts(row) -> tuple[np.ndarray, bytes]:
    import zstandard

    return np.concatenate(([0], np.cumsum(np.frombuffer(row.sizes, "<i8")))), zstandard.ZstdDecompressor().decompress(row.texts)


def _best(kept: list[np.ndarray], top: int) -> np.ndarray:
    """Of rows (item, score, doc_id, ...) the top of each item: highest score, then smallest id."""
    got = np.concatenate(kept)
    got = got[np.lexsort((got[:, 2], -got[:, 1], got[:, 0]))]
    starts = np.flatnonzero(np.concatenate(([True], np.diff(got[:, 0]) != 0)))
    rank = np.arange(len(got)) - np.repeat(starts, np.diff(np.append(starts, len(got))))
    return got[rank < top]


FOUND = "item int, score long, doc_id long, block long, place int"


def _frame(kept: list[np.ndarray], top: int) -> pd.DataFrame:
    return pd.DataFrame(_best(kept, top), columns=[c.split()[0] for c in FOUND.split(", ")])


def _highest_bounds(items, top: int):
    """Of a task's blocks the documents of highest bound for each item; reads no text."""

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[np.ndarray] = []
        for b in batches:
            for row in b.itertuples():
                ids, counts, slices = _arrays(row)
                bound = items.value.bounds(counts, slices).astype(np.int64)
                k = min(top, len(ids))
                at = np.argpartition(-bound, k - 1, axis=1)[:, :k]
                item = np.repeat(np.arange(len(bound)), k)
                at = at.ravel()
                kept.append(np.stack([item, bound[item, at], ids[at], np.full(len(at), row.block), at], axis=1))
                kept = [_best(kept, top)]
        if kept:
            yield _frame(kept, top)

    return run


def _rescored(items, top: int, least: np.ndarray | None = None, only: dict | None = None):
    """Exact scores of a task's documents: those named in ``only`` (block: (item, place) pairs), or all
    whose bound reaches ``least``."""

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, kept = items.value, []
        for b in batches:
            for row in b.itertuples():
                if only is not None:
                    item, place = np.array(only[row.block], np.int64).T
                    ids = np.frombuffer(row.ids, "<i8")
                else:
                    ids, counts, slices = _arrays(row)
                    item, place = np.nonzero(own.bounds(counts, slices) >= least[:, None])
                if not len(item):
                    continue
                cut, text = _texts(row)
                by = np.argsort(place, kind="stable")
                item, place = item[by], place[by]
                edges = np.flatnonzero(np.concatenate(([True], np.diff(place) != 0, [True])))
                score = np.concatenate([own.scores(text[cut[place[a]] : cut[place[a] + 1]], item[a:z]) for a, z in zip(edges, edges[1:])])
                got = np.stack([item, score, ids[place], np.full(len(item), row.block), place], axis=1)[score > 0]
                kept = [_best([*kept, got], top)] if len(got) else kept
        if kept:
            yield _frame(kept, top)

    return run


def _top(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id", "block", "place")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _search(index: Index, found: list[tuple], top: int) -> tuple[DataFrame, list]:
    """Answers of a block of items: item (number), rank, doc_id, score; staged."""
    spark = index.blocks.sparkSession
    items = spark.sparkContext.broadcast(Items(found, index))
    n = len(items.value.items)
    slim = index.blocks.drop("texts", "sizes")
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "8"}):
        high = _top(slim.mapInPandas(_highest_bounds(items, top), FOUND), top).collect()  # top rows an item
        only: dict[int, list] = {}
        for r in high:
            only.setdefault(r.block, []).append((r.item, r.place))
        named = index.blocks.filter(F.col("block").isin(list(only)))
        least = np.zeros(n, np.int64)
        first = _top(named.mapInPandas(_rescored(items, top, only=only), FOUND), top).groupBy("item").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
        for r in first.collect():  # one row an item
            least[r["item"]] = r["least"] if r["n"] == top else 0
        out = _top(index.blocks.mapInPandas(_rescored(items, top, least=np.maximum(least, 1)), FOUND), top)
        out = staged(out.select("item", "rank", "doc_id", "score"), "answers")
    names = items.value.items
    items.destroy()
    return out, names


def item_terms(benchmark: DataFrame, index: Index) -> DataFrame:
    """key (item number), item_id, term, w of the terms that some document holds; staged."""

    @lean
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, none, raw in zip(b["item_id"].tolist(), b["none"].tolist(), utf8(b["text"])):
                words = [t.decode() for t in terms_of(raw)]
                if words:
                    yield pd.DataFrame({"item_id": [key] * len(words), "none": [none] * len(words), "term": words})

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(0)).alias("item_id"), F.col("item_id").isNull().alias("none"), "text")
    terms = rows.mapInPandas(split, "item_id long, none boolean, term string").distinct()
    return staged(terms.join(index.frequencies, "term").select("item_id", "none", "term", weight(index.documents, F.col("df")).alias("w")), "item-terms")


def search(docs: DataFrame, benchmark: DataFrame, top: int = TOP, item_block_terms: int = ITEM_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the top documents of every item."""
    spark = docs.sparkSession
    index = build(docs)
    terms = item_terms(benchmark, index)
    count = max(1, -(-terms.count() // item_block_terms))
    out = None
    for k in range(count):  # a bounded block of the query set at a time
        part = terms.filter(F.pmod(F.xxhash64("item_id", "none"), F.lit(count)) == k).select("item_id", "none", "term", "w")
        found = [((r.none, r.item_id), r.term, r.w) for r in part.collect()]
        if not found or not index.documents:
            continue
        got, names = _search(index, found, top)
        ids = spark.createDataFrame([(i, None if none else item) for i, (none, item) in enumerate(names)], "item int, item_id long")
        got = got.join(F.broadcast(ids), "item").select("item_id", "rank", id_out().alias("doc_id"), "score")
        out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
     s AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
     q AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM benchmark),
     t AS (SELECT row, doc_id, 100 - 90 + (90 * CAST(n AS BIGINT) * n_docs) // n_terms AS m, term, count(*) AS tf
           FROM (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM d WHERE len(w) > 0), s WHERE term IN (SELECT term FROM q) GROUP BY ALL),
     f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM t, s GROUP BY term),
     r AS (SELECT item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN t USING (term) JOIN f USING (term) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 10
"""


@query(SQL)
def op12_bitsliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
