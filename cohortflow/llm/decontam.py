"""Operator 8, benchmark decontamination: Wu-Manber multi-pattern search.

The alphabet is words (64-bit hashes of their lower-cased bytes) and a block
is two neighbouring words.  Test windows of one length share a shift table: it
tells for the block that ends at the cursor how far the cursor may move
without passing an occurrence; a block of no window moves it by length - 1
words.  Where the shift is 0, the block is the last one of some windows: its
suffix-hash bucket, narrowed by the hash of the window's first block, selects
the test strings, and direct comparison of the bytes confirms.  All cursors of
a batch move together, one for each run of ``RUN`` windows.

Documents stay where they are: the tables of a bounded block of the benchmark
(``BLOCK_CHARS`` characters at most beyond one item) are broadcast, and a
larger benchmark is searched block after block in the same pass over the
partitions, without a shuffle of documents.

Nulls and edge cases: a null or empty text has no words; an item without words
is never found; an item of fewer words than a window is one window; items that
repeat a text or an id all count, ids once each; null item ids are ignored.  An
empty documents or benchmark table is allowed.  Columns other than doc_id,
text and item_id are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm.common import lean, query, table
from cohortflow.llm.textops import _ODD, ALNUM_WORDS, mix, utf8, word_hashes

WINDOW = 10
RUN = 256
BLOCK_CHARS = 16_000_000


def _block(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` (1 or 2) words that start at each place."""
    with np.errstate(over="ignore"):
        h = words[at] * _ODD[0]
        return mix(h + words[at + 1] * _ODD[1] if width == 2 else h)


class LengthTables:
    """Shift table and buckets of the distinct windows of one length."""

    def __init__(self, windows: list[bytes], length: int):
        self.length, self.width = length, min(2, length)
        self.texts = windows  # words joined by blanks
        hashes = word_hashes(windows, ALNUM_WORDS)
        words = np.concatenate(hashes)
        first = np.arange(len(windows)) * length
        last = length - self.width
        bits = max(12, int(len(windows) * (last + 1)).bit_length() + 3)
        self.down = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, last + 1, dtype=np.uint8 if length < 256 else np.int32)
        for j in range(last + 1):
            slot = (_block(words, first + j, self.width) >> self.down).astype(np.int64)
            np.minimum.at(self.shift, slot, last - j)
        key = self.key(words, first)
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]

    def key(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Suffix block and first block of the window that starts at each place."""
        with np.errstate(over="ignore"):
            return mix(_block(words, first + self.length - self.width, self.width) * _ODD[2] + _block(words, first, self.width))

    def find(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, window) of each candidate in the texts words[bounds[i]:bounds[i+1]]."""
        sizes = np.diff(bounds) - self.length + 1  # windows of each text
        runs = np.maximum(0, -(-sizes // RUN))
        text = np.repeat(np.arange(len(sizes)), runs)
        k = np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs)
        at = bounds[text] + k * RUN
        stop = bounds[text] + np.minimum(sizes[text], (k + 1) * RUN)
        found = []
        last = self.length - self.width
        while len(at):
            step = self.shift[(_block(words, at + last, self.width) >> self.down).astype(np.int64)]
            zero = at[step == 0]
            if len(zero):
                found.append(zero)
            at = at + np.maximum(step, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.concatenate(found)
        key = self.key(words, at)
        low, high = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, "right")
        n = high - low
        which = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.order[which]


class Benchmark:
    """Search tables of some items, and the items of each window."""

    def __init__(self, items: list[tuple], window: int):
        owners: dict[tuple[int, bytes], set] = {}
        raws = [t.encode() for _, t in items]
        for (item, _), raw, (_, a, z) in zip(items, raws, word_hashes(raws, ALNUM_WORDS, spans=True)):
            words = [raw[i:j].lower() for i, j in zip(a.tolist(), z.tolist())]
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                owners.setdefault((size, b" ".join(words[i : i + size])), set()).add(item)
        self.tables, self.items = [], []
        for size in sorted({k[0] for k in owners}):
            own = [(t, sorted(o)) for (n, t), o in owners.items() if n == size]
            self.tables.append(LengthTables([t for t, _ in own], size))
            self.items.append([o for _, o in own])

    def search(self, raws: list[bytes]) -> Iterator[tuple[int, list[int], list]]:
        """Per text: number of words, starts and ends (in words) of maximal hit runs, items."""
        at = 0
        while at < len(raws):  # groups of about 1 MB
            end, size = at, 0
            while end < len(raws) and (size < 1_000_000 or end == at):
                size += len(raws[end])
                end += 1
            yield from self._group(raws[at:end])
            at = end

    def _group(self, raws: list[bytes]):
        spans = word_hashes(raws, ALNUM_WORDS, spans=True)
        bounds = np.concatenate(([0], np.cumsum([len(x[0]) for x in spans]))).astype(np.int64)
        words = np.concatenate([x[0] for x in spans]) if spans else np.empty(0, np.uint64)
        cover = np.zeros(len(words) + 1, dtype=np.int64)
        items: dict[int, set] = {}
        for tab, owners in zip(self.tables, self.items):
            starts, wins = tab.find(words, bounds)
            texts = np.searchsorted(bounds, starts, "right") - 1
            for s, w, t in zip(starts.tolist(), wins.tolist(), texts.tolist()):
                _, a, z = spans[t]
                i = s - int(bounds[t])
                raw = raws[t]
                if b" ".join([raw[a[i + j] : z[i + j]].lower() for j in range(tab.length)]) == tab.texts[w]:
                    cover[s] += 1
                    cover[s + tab.length] -= 1
                    items.setdefault(t, set()).update(owners[w])
        # a run that reaches a text's end stops there: no window crosses it
        hit = np.cumsum(cover[:-1]) > 0
        for t in range(len(raws)):
            a, z = int(bounds[t]), int(bounds[t + 1])
            if t in items:
                edge = np.flatnonzero(np.diff(np.concatenate(([0], hit[a:z].view(np.int8), [0]))))
                yield z - a, edge[::2].tolist(), edge[1::2].tolist(), list(items[t])
            else:
                yield z - a, [], [], []


FOUND = "n_words long, starts array<long>, ends array<long>, items array<long>"


def search_udf(spark: SparkSession, items: list[tuple], window: int):
    tables = spark.sparkContext.broadcast(Benchmark(items, window))

    @lean
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(list(tables.value.search(utf8(b))), columns=["n_words", "starts", "ends", "items"])

    @F.pandas_udf(FOUND)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from found(batches)

    return search


def benchmark_blocks(benchmark: DataFrame, block_chars: int) -> Iterable[list[tuple]]:
    """The items in blocks of about ``block_chars`` characters, chosen by a hash of id and text."""
    rows = benchmark.select(F.col("item_id").alias("item"), F.col("text").alias("test")).filter("item is not null and test is not null")
    chars = rows.agg(F.sum(F.length("test"))).first()[0] or 0
    n = max(1, -(-int(chars) // block_chars))
    for k in range(n):
        yield [tuple(r) for r in rows.filter(F.pmod(F.xxhash64("item", "test"), F.lit(n)) == k).collect()]


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs with one more column ``wm_found`` per block of the benchmark (an
    array): words, hit runs and items of each text."""
    found: list[Column] = []
    for items in benchmark_blocks(benchmark, block_chars):
        found.append(search_udf(docs.sparkSession, items, window)(F.col("text")))
    return docs.withColumn("wm_found", F.array(*found))


def _covered() -> Column:
    """Words inside any hit run, over all blocks: sorted runs, swept once."""
    runs = F.array_sort(F.flatten(F.transform("wm_found", lambda f: F.arrays_zip(f["starts"].alias("s"), f["ends"].alias("e")))))
    swept = F.aggregate(
        runs,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda acc, r: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), r["e"] - F.greatest(r["s"], acc["to"]))).alias("n"), F.greatest(acc["to"], r["e"]).alias("to")),
    )
    return swept["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item ids (array), contaminated."""
    found = matches(docs.select("doc_id", "text"), benchmark, window, block_chars).select("doc_id", "wm_found")
    items = F.array_distinct(F.flatten(F.transform("wm_found", lambda f: f["items"])))
    out = found.select("doc_id", F.col("wm_found")[0]["n_words"].alias("n_words"), _covered().alias("n_hit"), items.alias("items"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the rows that hold a window of the benchmark; one pass, no join."""
    found = matches(docs, benchmark, window)
    return found.filter(~F.exists("wm_found", lambda f: F.size(f["items"]) > 0)).select(*[docs[c] for c in docs.columns])


SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower_az, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
            FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)),
     bw AS (SELECT item_id, list_filter(regexp_split_to_array(lower_az, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
            FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM benchmark)),
     win AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s
             FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM bw WHERE len(w) > 0)),
     ks AS (SELECT DISTINCT k FROM win),
     pos AS (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM dw, ks WHERE len(w) >= k),
     hits AS (SELECT p.doc_id, p.i, p.k, win.item_id FROM (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM pos) p JOIN win ON win.k = p.k AND win.s = p.s),
     n AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + k - 1)) AS at FROM hits) GROUP BY doc_id),
     it AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@query(SQL)
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), "contaminated")
