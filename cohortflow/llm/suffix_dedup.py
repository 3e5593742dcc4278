"""Operator 9, suffix-array dedup by bucket-pointer refinement.

A byte goes when some 50-byte string that covers it also starts in a document
with a smaller doc_id.  Suffixes are bucketed by their q-grams and the buckets
are refined by later offsets, but only at anchors: the q-grams that are least
in some 50-byte window.  Equal windows hold the same least q-gram at the same
place, so every repeat is seen at an anchor, and one anchor (the last least
one) owns a window.

1. Texts are packed, compressed, into blocks of a few megabytes and
   written once.
2. Every block sends the hashes of its anchors to initial q-gram buckets, each
   hash once; buckets answer which of them more than one document has.
3. Those anchors' contexts (the windows they own) go to the buckets, each
   distinct context of a block once, with its least and greatest doc_id.
   There suffixes are refined: the suffixes that start at the anchor are
   sorted by the bucket identifiers of their next eight bytes, the new
   identifiers are sorted with those of the following eight, and so on; the
   prefixes to the left likewise.  Two windows are equal when q-gram, left and
   right bucket agree at the window's lengths.  The least doc_id of every
   window goes back to the blocks.
4. Blocks mark the windows that a smaller doc_id has, and cut.  The kept bytes
   and the removed spans of every document are written once; counts and digests
   are derived from them.

A hash or context that a third of all documents hold costs each block one
entry.  Only hashes, contexts and answers are shuffled freely; a block's texts
move twice, compressed, to meet their answers.

Nulls and edge cases: a null text is empty; a text shorter than a string loses
nothing.  Rows that repeat a doc_id are not smaller than each other, so they
do not cut one another.  A null doc_id counts as larger than all others and
never cuts.  An empty table gives an empty result.  Columns other than doc_id
and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm.common import NO_ID, drop_staged, id_in, id_out, query, settings, staged, table
from cohortflow.llm.hashblocks import ANSWERED, BUCKET_BYTES, PACKED, SENT, answer, pack_blocks, send, shared, unpack_block
from cohortflow.llm.textops import anchors, mix

LENGTH, Q = 50, 16
#: Text bytes whose blocks and buckets one task of a shuffle gets (about).
TASK_BYTES = 24 << 20
#: Places of windows before an anchor travel as this: ``length`` - ``q`` must fit.
PLACE = "<u2"
_U = np.uint64


class Block:
    """Texts of a block, one after the other, and their anchors."""

    def __init__(self, row, length: int, q: int):
        self.ids, self.offs, raw = unpack_block(row)
        self.raw = np.frombuffer(raw, np.uint8)
        self.length, self.q = length, q
        self.at, self.hash = anchors(self.raw, self.offs, length, q)
        self.text = np.searchsorted(self.offs, self.at, "right") - 1

    def keep(self, on: np.ndarray) -> None:
        self.at, self.hash, self.text = self.at[on], self.hash[on], self.text[on]

    def reach(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last offset, before each anchor, of the windows of its text that hold it."""
        w = self.length - self.q
        lo = np.maximum(0, w - (self.at - self.offs[self.text]))
        return lo, np.minimum(w, self.offs[self.text + 1] - self.at - self.q)

    def contexts(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The bytes of each anchor's windows first..last, zero elsewhere; an anchor stands at length - q."""
        w = self.length - self.q
        pad = np.concatenate((np.zeros(w, np.uint8), self.raw, np.zeros(w, np.uint8)))
        ctx = np.lib.stride_tricks.sliding_window_view(pad, 2 * w + self.q)[self.at].copy()
        cols = np.arange(ctx.shape[1], dtype=np.int32)
        ctx[(cols < first[:, None]) | (cols >= (last.astype(np.int32) + self.length)[:, None])] = 0
        return ctx


def owned(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Windows that this anchor alone judges: those in which no least q-gram
    comes later.  Anchors are in order; the next one that is no larger ends it,
    an earlier smaller one starts it."""
    w = block.length - block.q
    n = len(block.at)
    first, last = block.reach()
    before = np.full(n, -1, np.int64)  # the last earlier anchor that is smaller
    after = np.full(n, -1, np.int64)  # the first later anchor that is not larger
    stack: list[int] = []
    h, t = block.hash.tolist(), block.text.tolist()
    for i in range(n):
        while stack and (t[stack[-1]] != t[i] or h[stack[-1]] >= h[i]):
            j = stack.pop()
            if t[j] == t[i]:
                after[j] = i
        if stack:
            before[i] = stack[-1]
        stack.append(i)
    has = before >= 0  # windows start after it
    first[has] = np.maximum(first[has], w + 1 - (block.at[has] - block.at[before[has]]))
    has = after >= 0  # windows end before its last byte
    last[has] = np.minimum(last[has], block.at[after[has]] - block.at[has] - 1)
    return first.astype(np.uint16), np.maximum(last, -1).astype(np.int32)


def _groups(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts by the keys (last one first), and where a group starts."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
    return order, new


def send_hashes(length: int, q: int, buckets: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, row in b.iterrows():
                block = Block(row, length, q)
                order, new = _groups([block.hash])
                starts = np.flatnonzero(new)
                doc = block.ids[block.text[order]]
                many = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts) if len(starts) else np.empty(0, bool)
                yield send(block.hash[order][starts], many, row["block"], buckets)

    return run


def send_contexts(length: int, q: int, buckets: int) -> Callable:
    def run(key: tuple, blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, row in blocks.iterrows():
            block = Block(row, length, q)
            # own windows are settled among all anchors, before any is left out
            first, last = owned(block)
            uniq, back = np.unique(block.hash, return_inverse=True)
            on = shared(uniq, answers, buckets)[back] & (first <= last)
            block.keep(on)
            rows += _entries(row["block"], block, first[on], last[on].astype(np.uint16), buckets)
        return pd.DataFrame(rows, columns=["bucket", "block", "n", "packed"])

    return run


def _context_key(ctx: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    pad = np.zeros((len(ctx), -(-ctx.shape[1] // 8) * 8), np.uint8)
    pad[:, : ctx.shape[1]] = ctx
    key = mix((first.astype(_U) << _U(32)) | last.astype(_U))
    for col in np.ascontiguousarray(pad).view("<u8").T:
        key = mix(key ^ col)
    return key


def _entries(block_no: int, block: Block, first: np.ndarray, last: np.ndarray, buckets: int) -> list[tuple]:
    """Distinct contexts, by bucket: the anchor's place in the block (of the
    first instance), hash, least and greatest doc_id, own windows, bytes."""
    import zstandard

    if not len(block.at):
        return []
    ctx = block.contexts(first, last)
    key = _context_key(ctx, first, last)
    order, new = _groups([key, block.hash])
    starts = np.flatnonzero(new)
    doc = block.ids[block.text[order]]
    one = order[starts]
    low, high = np.minimum.reduceat(doc, starts), np.maximum.reduceat(doc, starts)
    bucket = (block.hash[one] % _U(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.concatenate(([True], np.diff(bucket[by]) != 0)))
    squeeze = zstandard.ZstdCompressor(level=3).compress
    out = []
    for s, e in zip(cut, np.append(cut[1:], len(by))):
        k = by[s:e]
        i = one[k]
        raw = b"".join((block.at[i].astype("<i4").tobytes(), block.hash[i].tobytes(), low[k].tobytes(), high[k].tobytes(), first[i].astype(PLACE).tobytes(), last[i].astype(PLACE).tobytes(), ctx[i].tobytes()))
        out.append((int(bucket[k[0]]), block_no, len(k), squeeze(raw)))
    return out


def _ids_by_length(ctx_side: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Bucket identifiers of the suffixes ``ctx_side`` (rows of bytes, nearest to
    the anchor first) at every length 0..w: rows start in their initial bucket
    and are refined by the identifiers of eight later bytes at a time."""
    n, w = ctx_side.shape
    wide = -(-w // 8) * 8
    pad = np.zeros((n, wide), np.uint8)
    pad[:, :w] = ctx_side
    eights = pad.view(">u8").astype(_U)  # big-endian: numbers in byte order
    ident = bucket.astype(np.int64)
    for j in range(eights.shape[1]):
        pointer = np.unique(eights[:, j], return_inverse=True)[1].astype(np.int64)
        ident = np.unique(ident * (int(pointer.max()) + 1) + pointer, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(ident, kind="stable")  # suffixes in order, bucket by bucket
    rows, own = ctx_side[order], bucket[order]
    same = rows[1:] == rows[:-1]
    common = np.where(same.all(axis=1), w, same.argmin(axis=1))
    common[own[1:] != own[:-1]] = -1  # not even the q-gram
    out = np.empty((n, w + 1), np.int32)
    for size in range(w + 1):
        out[order, size] = np.concatenate(([0], np.cumsum(common < size)))
    return out


def judge(length: int, q: int) -> Callable:
    """Least doc_id of every own window, where it is less than the greatest of the entry."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        w = length - q
        width = 2 * w + q
        cols: list[list] = [[] for _ in range(7)]
        for block, n, packed in zip(g["block"], g["n"], g["packed"]):
            raw, at = unpack(packed), 0
            for c, (kind, per) in enumerate((("<i4", 1), ("<u8", 1), ("<i8", 1), ("<i8", 1), (PLACE, 1), (PLACE, 1), ("u1", width))):
                step = n * per * np.dtype(kind).itemsize
                cols[c].append(np.frombuffer(raw[at : at + step], kind).reshape(n, per) if per > 1 else np.frombuffer(raw[at : at + step], kind))
                at += step
        blocks = np.repeat(g["block"].to_numpy(np.int64), g["n"].to_numpy(np.int64))
        place, h, low, high, first, last, ctx = (np.concatenate(c) for c in cols)
        # initial q-gram buckets; those with one document are settled
        bucket = np.unique(h, return_inverse=True)[1]
        least, most = np.full(bucket.max() + 1, NO_ID), np.full(bucket.max() + 1, np.iinfo(np.int64).min)
        np.minimum.at(least, bucket, low)
        np.maximum.at(most, bucket, high)
        on = np.flatnonzero((least < most)[bucket])
        if not len(on):
            return pd.DataFrame({"block": [], "answers": []})
        blocks, place, low, high, first, last, ctx, bucket = (x[on] for x in (blocks, place, low, high, first, last, ctx, bucket))
        # equal contexts of several blocks are one from here on
        order, new = _groups([_context_key(ctx, first, last), bucket])
        starts = np.flatnonzero(new)
        one = order[starts]
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(new) - 1
        c_low = np.minimum.reduceat(low[order], starts)
        right = _ids_by_length(ctx[one][:, w:], bucket[one])  # from the q-gram on, whose bytes are compared too
        left = _ids_by_length(ctx[one][:, w - 1 :: -1] if w else ctx[one][:, :0], bucket[one])
        got = np.full((len(one), w + 1), NO_ID)
        for o in range(w + 1):
            own = np.flatnonzero((first[one] <= o) & (o <= last[one]))
            if len(own):
                pair = left[own, w - o].astype(np.int64) * (len(one) + 1) + right[own, q + o]
                by = np.argsort(pair, kind="stable")
                start = np.flatnonzero(np.concatenate(([True], np.diff(pair[by]) != 0)))
                mins = np.minimum.reduceat(c_low[own[by]], start)
                got[own[by], o] = np.repeat(mins, np.diff(np.append(start, len(by))))
        out = []
        edge = np.ones((len(one), w + 1), bool)
        edge[:, 1:] = got[:, 1:] != got[:, :-1]
        hit_rows = np.flatnonzero(got[entry].min(axis=1) < high)
        order = hit_rows[np.argsort(blocks[hit_rows], kind="stable")]
        cut = np.flatnonzero(np.concatenate(([True], np.diff(blocks[order]) != 0))) if len(order) else []
        for s, e in zip(cut, np.append(cut[1:], len(order)).astype(int) if len(order) else []):
            rows = order[s:e]
            r, o = np.nonzero(edge[entry[rows]] & (got[entry[rows]] < high[rows][:, None]))
            # a run of equal minima ends where the next edge is
            ends = _run_ends(edge[entry[rows]])[r, o]
            val = got[entry[rows]][r, o]
            packed = b"".join((place[rows][r].astype("<i4").tobytes(), o.astype(PLACE).tobytes(), ends.astype(PLACE).tobytes(), val.astype("<i8").tobytes()))
            out.append((int(blocks[rows[0]]), zstandard.ZstdCompressor(level=1).compress(packed)))
        return pd.DataFrame(out, columns=["block", "answers"])

    return run


def _run_ends(edge: np.ndarray) -> np.ndarray:
    """Last column of the run that starts at each edge."""
    n, w = edge.shape
    out = np.empty((n, w), np.int64)
    end = np.full(n, w - 1)
    for o in range(w - 1, -1, -1):
        out[:, o] = end
        end = np.where(edge[:, o], o - 1, end)
    return out


def cut_texts(length: int, q: int) -> Callable:
    def run(key: tuple, blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        frames = []
        for _, row in blocks.iterrows():
            block = Block(row, length, q)
            w = length - q
            cover = np.zeros(len(block.raw) + 1, np.int64)
            raws = [unpack(x) for x in answers["answers"]]
            if raws:
                parts = [(np.frombuffer(r[: 4 * (n := len(r) // 16)], "<i4"), np.frombuffer(r[4 * n : 6 * n], PLACE), np.frombuffer(r[6 * n : 8 * n], PLACE), np.frombuffer(r[8 * n :], "<i8")) for r in raws]
                place, o1, o2, least = (np.concatenate(c) for c in zip(*parts))
                first, last = owned(block)
                reps = np.searchsorted(block.at, np.unique(place))
                on = np.isin(block.hash, block.hash[reps]) & (first <= last)
                block.keep(on)
                first, last = first[on], last[on].astype(np.uint16)
                ctx = block.contexts(first, last)
                key_of = _context_key(ctx, first, last)
                # instances of each representative's context
                order, new = _groups([key_of, block.hash])
                number = np.empty(len(order), np.int64)
                number[order] = np.cumsum(new) - 1
                starts = np.append(np.flatnonzero(new), len(order))
                group = number[np.searchsorted(block.at, place)]
                n = starts[group + 1] - starts[group]
                ans = np.repeat(np.arange(len(place)), n)
                inst = order[np.repeat(starts[group], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
                less = least[ans] < block.ids[block.text[inst]]
                ans, inst = ans[less], inst[less]
                np.add.at(cover, block.at[inst] - w + o1[ans], 1)
                np.add.at(cover, block.at[inst] - w + o2[ans].astype(np.int64) + length, -1)
            gone = np.cumsum(cover[:-1]) > 0
            out = []
            for k, (s, e) in enumerate(zip(block.offs[:-1].tolist(), block.offs[1:].tolist())):
                g = gone[s:e]
                turns = np.flatnonzero(np.diff(g, prepend=False, append=False))
                out.append((int(block.ids[k]), e - s, turns[::2], turns[1::2], block.raw[s:e][~g].tobytes()))
            frames.append(pd.DataFrame(out, columns=["doc_id", "n_bytes", "start", "end", "kept"]))
        return pd.concat(frames) if frames else pd.DataFrame(columns=["doc_id", "n_bytes", "start", "end", "kept"])

    return run


def cut(docs: DataFrame, length: int = LENGTH, q: int = Q) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (the removed byte ranges of
    the UTF-8 text, end exclusive) and kept (the bytes that stay; a cut may
    split a character); staged."""
    texts = docs.select(id_in(), "text")
    blocks = staged(texts.mapInPandas(pack_blocks, PACKED).withColumn("block", F.monotonically_increasing_id()), "sd-blocks")
    total = blocks.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    tasks = max(8, -(-total // TASK_BYTES))  # so that a task's share does not grow with the corpus

    def by(df: DataFrame, key: str):
        return df.repartition(tasks, key).groupBy(key)

    hashes = blocks.mapInPandas(send_hashes(length, q, buckets), SENT)
    answers = staged(by(hashes, "bucket").applyInPandas(answer, ANSWERED), "sd-shared")
    entries = by(blocks, "block").cogroup(by(answers, "block")).applyInPandas(send_contexts(length, q, buckets), "bucket long, block long, n long, packed binary")
    judged = staged(by(entries, "bucket").applyInPandas(judge(length, q), "block long, answers binary"), "sd-judged")
    drop_staged(answers)
    out = by(blocks, "block").cogroup(by(judged, "block")).applyInPandas(cut_texts(length, q), "doc_id long, n_bytes long, start array<long>, end array<long>, kept binary")
    out = out.select(id_out().alias("doc_id"), "n_bytes", F.arrays_zip("start", "end").alias("spans"), "kept")
    with settings(docs.sparkSession, {"spark.sql.parquet.compression.codec": "zstd"}):
        out = staged(out, "sd-result")
    drop_staged(blocks, judged)
    return out


def repeats(docs: DataFrame, length: int = LENGTH, q: int = Q) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    removed = F.col("n_bytes") - F.octet_length("kept")
    return cut(docs, length, q).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
     n AS (SELECT doc_id, h, length(h) // 2 AS n FROM b),
     w AS (SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 100) AS s FROM (SELECT doc_id, h, unnest(generate_series(0, n - 50)) AS i FROM n WHERE n >= 50)),
     m AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM w) WHERE m < doc_id),
     g AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS new FROM m),
     r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
     sp AS (SELECT doc_id, run, min(i) AS s, max(i) + 50 AS e FROM r GROUP BY doc_id, run),
     k AS (SELECT doc_id, s, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS p FROM sp),
     agg AS (SELECT k.doc_id, sum(e - s) AS n_removed, count(*) AS n_spans, max(e) AS e,
                    string_agg(substr(h, CAST(2 * p + 1 AS BIGINT), CAST(2 * (s - p) AS BIGINT)), '' ORDER BY s) AS kept FROM k JOIN n USING (doc_id) GROUP BY k.doc_id)
SELECT n.doc_id, n.n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN agg.doc_id IS NULL THEN h ELSE kept || substr(h, CAST(2 * e + 1 AS BIGINT)) END)) AS kept_sha256
FROM n LEFT JOIN agg ON agg.doc_id = n.doc_id
"""


@query(SQL)
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
