"""Operator 4, MinHash near-dedup with sequential Bayesian verification.

1. Each text's distinct k-word shingles give a signature of ``BANDS * ROWS``
   minima; texts with the same shingle set are one representative from here
   on, so groups of copies cost one row each.
2. Representatives that agree on a band share a bucket.  A bucket is never
   expanded into all its pairs: its members are compared with a few pivots
   (the members of least hash, the same ones in every band), links are
   contracted to components, and only members that are still outside their
   bucket's largest component are compared with the members of other
   components, in tiles whose pairs never leave their task.  In the end any
   two members of a bucket either are in one component or have been compared,
   so no link between components is lost.
3. A pair is compared batch by batch of signature places.  After each batch
   the posterior of the similarity (uniform prior, so a beta distribution)
   is known; the pair goes when the chance that it reaches the threshold is
   below ``MISS``.  Survivors are confirmed on their full shingle sets.

At similarity 0.8 a pair shares no band with probability
(1 - 0.8**5)**32 < 4e-6, and is pruned with probability of the order of MISS.

Nulls and edge cases: a null or empty text, or one of white space alone, has
no shingles and is linked with nothing; a text of fewer words than a shingle
is one shingle.  Rows that repeat a doc_id are compared each for itself; the
component_id is the least doc_id of their component, of which the first row
stays.  In ``near_duplicates`` a null doc_id is linked with nothing and stays
(its component_id is null); ``keep_one`` links such rows, too, and drops row by
row.  An empty table gives an empty result.  Columns other than doc_id and text
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm.common import drop_staged, id_in, id_out, ids_tell_rows, lean, numbered, query, sized, staged, table, without
from cohortflow.llm.components import components
from cohortflow.llm.textops import SPACE_WORDS, mix, shingles, slices, utf8, word_hashes

BANDS, ROWS = 32, 5
THRESHOLD = 80  # percent
PIVOTS = 4
MISS = 1e-9
BATCH = 32
TILE = 64

_SLOPE = mix(np.arange(7000, 7000 + BANDS * ROWS, dtype=np.uint64)) | np.uint64(1)


def signature(sh: np.ndarray) -> np.ndarray:
    """Minima of the shingle hashes under odd multipliers, upper 32 bits."""
    low = np.full(len(_SLOPE), np.uint64(0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        for at in range(0, len(sh), 2048):
            np.minimum(low, (sh[at : at + 2048, None] * _SLOPE).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype("<u4")


def describe(k: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """doc_id, n_shingles, set_key (128-bit hash of the set), bands, signature."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            rows = []
            for words in word_hashes(utf8(b["text"]), SPACE_WORDS):
                sh = shingles(words, k)
                if not len(sh):
                    rows.append((0, None, None, None))
                    continue
                with np.errstate(over="ignore"):
                    key = np.array([sh.sum(), mix(sh ^ np.uint64(0x5DEECE66D)).sum() ^ np.uint64(len(sh))], dtype="<u8").tobytes()
                    sig = signature(sh)
                    band = np.arange(BANDS, dtype=np.uint64)
                    for part in sig.reshape(BANDS, ROWS).T:
                        band = mix(band ^ part)
                rows.append((len(sh), key, band.astype(np.int64).tolist(), sig.tobytes()))
            out = pd.DataFrame(rows, columns=["n_shingles", "set_key", "bands", "sig"])
            out.insert(0, "doc_id", b["doc_id"].values)
            yield out

    return lean(run)


def least_matches(total: int, batch: int, threshold: float, miss: float) -> np.ndarray:
    """For 1, 2, ... batches the fewest matches at which the posterior chance
    of a similarity of at least ``threshold`` is ``miss`` or more.  With a
    uniform prior that chance is P(Binomial(n + 1, threshold) <= matches)."""
    out = []
    for n in range(batch, total + 1, batch):
        p, m = 0.0, 0
        while True:
            p += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if p >= miss:
                break
            m += 1
        out.append(m)
    return np.array(out)


def prune(threshold: float, miss: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Pairs whose signatures leave the threshold possible."""
    need = least_matches(BANDS * ROWS, BATCH, threshold, miss)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches, 2048):
            a = np.frombuffer(b"".join(b["sig_a"]), dtype="<u4").reshape(len(b), -1)
            z = np.frombuffer(b"".join(b["sig_b"]), dtype="<u4").reshape(len(b), -1)
            on, matches = np.arange(len(b)), np.zeros(len(b), dtype=np.int64)
            for k, least in enumerate(need):
                part = slice(k * BATCH, (k + 1) * BATCH)
                matches[on] += (a[on, part] == z[on, part]).sum(axis=1)
                on = on[matches[on] >= least]
            yield b.iloc[on][["a", "b"]]

    return lean(run)


def squeeze(k: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Texts in compressed form, to be moved to the pairs that need them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for b in slices(batches):
            yield pd.DataFrame({"rep": b["rep"].values, "packed": [pack(x) for x in utf8(b["text"])]})

    return lean(run)


def confirm(k: int, percent: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Pairs whose full shingle sets reach the similarity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for b in slices(batches):
            keep = []
            sets: list[dict] = []
            for side in ("packed_a", "packed_b"):
                texts = list(dict.fromkeys(b[side]))
                sets.append(dict(zip(texts, (shingles(w, k) for w in word_hashes([unpack(x) for x in texts], SPACE_WORDS)))))
            for x, y in zip(b["packed_a"], b["packed_b"]):
                p, q = sets[0][x], sets[1][y]
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield b[np.array(keep, dtype=bool)][["a", "b"]]

    return lean(run)


def _packed(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """rep, packed: the texts of the documents of the staged ``ids``; staged."""
    texts = docs.join(sized(ids), docs["doc_id"] == ids["rep"], "left_semi").select(F.col("doc_id").alias("rep"), "text")
    return staged(texts.mapInPandas(squeeze(k), "rep long, packed binary"), "nd-texts")


def _links(pairs: DataFrame, sigs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The staged pairs (a < b) that are links: by signatures, then by full sets."""
    two = pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a")
    two = two.join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
    alive = staged(two.select("a", "b", "sig_a", "sig_b").mapInPandas(prune(percent / 100, MISS), "a long, b long"), "nd-alive")
    ids = staged(alive.select(F.col("a").alias("rep")).unionByName(alive.select(F.col("b").alias("rep"))).distinct(), "nd-ids")
    texts = _packed(docs, ids, k)
    two = alive.join(texts.select(F.col("rep").alias("a"), F.col("packed").alias("packed_a")), "a")
    two = two.join(texts.select(F.col("rep").alias("b"), F.col("packed").alias("packed_b")), "b")
    return staged(two.select("a", "b", "packed_a", "packed_b").mapInPandas(confirm(k, percent), "a long, b long"), "nd-links")


def compare(k: int, percent: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Links between the queries and the members of one tile: signatures are
    compared batch by batch, survivors by their full sets.  Only links leave the task."""
    need = least_matches(BANDS * ROWS, BATCH, percent / 100, MISS)

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        g = g.sort_values(["query", "rep"])
        sets = [shingles(w, k) for w in word_hashes([unpack(x) for x in g["packed"]], SPACE_WORDS)]
        sig = np.frombuffer(b"".join(g["sig"]), dtype="<u4").reshape(len(g), -1)
        rep, root, query = g["rep"].to_numpy(), g["root"].to_numpy(), g["query"].to_numpy()
        members = np.flatnonzero(~query)
        out = []
        for i in np.flatnonzero(query):
            on = members[root[members] != root[i]]
            matches = np.zeros(len(on), dtype=np.int64)
            for n, least in enumerate(need):
                part = slice(n * BATCH, (n + 1) * BATCH)
                matches = matches + (sig[on, part] == sig[i, part]).sum(axis=1)
                on, matches = on[matches >= least], matches[matches >= least]
            for j in on:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    out.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def _outside_links(torn: DataFrame, sigs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Staged links of the members outside their bucket's largest component
    (``top``) with the others that meet that component, in tiles of at most
    ``TILE`` queries and ``TILE`` members, so that no large group is one task
    and no pairs are shuffled."""
    met = staged(torn.select("top", F.col("q").alias("rep"), "root").distinct(), "nd-met")
    sizes = met.groupBy("top").agg(F.ceil(F.sum((F.col("root") != F.col("top")).cast("long")) / TILE).alias("rows"), F.ceil(F.count(F.lit(1)) / TILE).alias("cols"))
    sizes = staged(sizes, "nd-sizes")
    texts = _packed(docs, staged(met.select("rep").distinct(), "nd-met-ids"), k)
    full = met.join(sizes, "top").join(sigs.select("rep", "sig"), "rep").join(texts, "rep")
    tile = F.xxhash64("rep", "top")
    queries = full.filter("root <> top").withColumn("i", F.pmod(tile, "rows")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cols") - 1)))
    members = full.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).withColumn("j", F.pmod(tile, "cols"))
    cols = ["top", "i", "j", "rep", "root", "sig", "packed"]
    tiles = queries.select(*cols, F.lit(True).alias("query")).unionByName(members.select(*cols, F.lit(False).alias("query")))
    return staged(tiles.groupBy("top", "i", "j").applyInPandas(compare(k, percent), "a long, b long").distinct(), "nd-more")


def _pairs(df: DataFrame) -> DataFrame:
    return df.filter("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if ids_tell_rows(docs.filter("doc_id is not null")):
        return _components(docs, _described(docs, k), k, percent)
    rows, row = numbered(docs)
    judged = _by_row(rows.filter("doc_id is not null"), row, k, percent).drop(row)
    none = _described(rows.filter("doc_id is null"), k)
    none = none.select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return judged.unionByName(none)


def _described(docs: DataFrame, k: int) -> DataFrame:
    sets = docs.select(id_in(), "text").mapInPandas(describe(k), "doc_id long, n_shingles long, set_key binary, bands array<long>, sig binary")
    return staged(sets.withColumn("doc_id", id_out()), "nd-sets")


def _by_row(rows: DataFrame, row: str, k: int, percent: int) -> DataFrame:
    """row, doc_id, n_shingles, component_id, kept of rows with a number in the
    column ``row``: the numbers are compared in place of doc_ids, and of each
    component the row of least doc_id (null last), then of least number, stays."""
    alone = rows.select(F.col(row).alias("doc_id"), "text")
    judged = _components(alone, _described(alone, k), k, percent).select(F.col("doc_id").alias(row), "n_shingles", F.col("component_id").alias("component"))
    judged = staged(judged.join(rows.select(row, F.col("doc_id").cast("long").alias("doc_id")), row), "nd-rows")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col(row).alias("at"))
    first = staged(judged.groupBy("component").agg(F.min(order).alias("first")), "nd-firsts")
    return judged.join(first, "component").select(row, "doc_id", "n_shingles", F.col("first.id").alias("component_id"), (F.col(row) == F.col("first.at")).alias("kept"))


def _components(docs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    reps = staged(sets.filter("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep")), "nd-reps")
    mine = sets.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    sigs = staged(mine.select(F.col("doc_id").alias("rep"), "sig", "bands"), "nd-sigs")
    bands = sigs.select(F.col("rep").alias("q"), F.explode("bands").alias("band"))
    # pivots: per bucket the members of least hash, by map-side combined minima
    draws = [F.min(F.struct(F.xxhash64(F.lit(i), F.col("q")).alias("h"), F.col("q").alias("p"))).alias(f"m{i}") for i in range(PIVOTS)]
    buckets = bands.groupBy("band").agg(F.count(F.lit(1)).alias("size"), *draws).filter("size > 1")
    buckets = staged(buckets.select("band", F.array_distinct(F.array(*[F.col(f"m{i}.p") for i in range(PIVOTS)])).alias("pivots")), "nd-buckets")
    members = staged(bands.join(buckets.select("band"), "band", "left_semi"), "nd-members")
    first = staged(_pairs(members.join(buckets, "band").select("q", F.explode("pivots").alias("p"))), "nd-first")
    links = _links(first, sigs, docs, k, percent)
    root = components(links)

    # what is outside its bucket's largest component meets the other components
    marked = members.join(root.withColumnRenamed("node", "q"), "q", "left").select("band", "q", F.coalesce("root", "q").alias("root"))
    marked = staged(marked, "nd-marked")
    shares = marked.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
    top = shares.groupBy("band").agg(F.max(F.struct("n", "root")).alias("top"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    top = staged(top.select("band", F.col("top.root").alias("top")), "nd-top")
    more = _outside_links(marked.join(top, "band"), sigs, docs, k, percent)
    if not more.isEmpty():
        up = root.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        up2 = root.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        over = more.join(up, "a", "left").join(up2, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        hung = root.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        root = components(over.filter("a <> b").unionByName(hung))
    of_set = staged(reps.join(root, reps["rep"] == root["node"], "left").select("set_key", F.coalesce("root", "rep").alias("component")), "nd-of-set")
    drop_staged(members, marked)
    out = sets.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key"))
    linked = out.filter("set_key is not null").join(of_set, "set_key").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = out.filter("set_key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, k: int = 5, percent: int = THRESHOLD) -> DataFrame:
    """docs with one row of each group of near duplicates."""
    if ids_tell_rows(docs):
        return without(docs, staged(near_duplicates(docs, k, percent).filter("not kept").select("doc_id"), "nd-gone"))
    rows, row = numbered(docs)
    gone = staged(_by_row(rows, row, k, percent).filter("not kept").select(row), "nd-gone")
    return without(rows, gone, row).drop(row)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
                                     ELSE list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) END) AS sh FROM w),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     -- two sets of similarity 0.8 share a shingle among the rarest fifth of either, whatever the order
     df AS (SELECT sh, count(*) AS df FROM s GROUP BY sh),
     pre AS (SELECT doc_id, sh, n, row_number() OVER (PARTITION BY doc_id ORDER BY df, sh) AS r FROM s JOIN df USING (sh) JOIN n USING (doc_id)),
     cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM pre a JOIN pre b ON a.sh = b.sh AND a.doc_id < b.doc_id
              WHERE a.r <= a.n - (80 * a.n + 99) // 100 + 1 AND b.r <= b.n - (80 * b.n + 99) // 100 + 1),
     inter AS (SELECT a, b, na, nb, count(*) AS k FROM cand JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.sh = x.sh GROUP BY ALL),
     link AS (SELECT a, b FROM inter WHERE 100 * k >= 80 * (na + nb - k)),
     both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
     reach AS (SELECT DISTINCT a AS doc_id, a AS to_id FROM both_ways UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.to_id),
     c AS (SELECT doc_id, min(to_id) AS c FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, w.doc_id) AS component_id, coalesce(c.c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


@query(SQL)
def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)
