"""Operator 2, exact dedup [native]: stateful streaming deduplication.

A stream of digests runs through one keyed aggregation.  Its state lives on
disk (RocksDB state store, checkpointed to the shared folder) and never
expires; per digest it retains the identifier and locator of the row that
stays and the number of rows.  Hits, i.e. rows of a digest that more than one
row has, are then compared by their full normalised bytes; should a digest
ever hold two different texts, its rows are grouped by the bytes themselves.
DataFrame and SQL functions only; no text is shuffled but that of hits, and of
those one per digest and task (least and greatest text).

Nulls and edge cases: a null text counts as empty; all empty texts are equal.
A null doc_id comes after every other.  Rows that repeat doc_id and text are
told apart by their locator, so one of them stays.  ``keep_first`` decides row
by row, too: one row of each text stays, also where a doc_id is null or
repeated.  A state may be kept for later calls (``dedup_next``).  An empty table gives an empty result.  Columns other than doc_id and
text are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm.common import ids_tell_rows, numbered, query, scratch, settings, sized, staged, table, whole_text, without

WHITE = r"[\x20\x09-\x0D]+"
_STORE = "spark.sql.streaming.stateStore."
STATE_CONF = {
    _STORE + "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    _STORE + "rocksdb.boundedMemoryUsage": "true",
    _STORE + "rocksdb.maxMemoryUsageMB": "64",
    # many small stores: no space is set aside for the logs of each
    _STORE + "rocksdb.allowFAllocate": "false",
}


def normalised() -> Column:
    return F.regexp_replace(whole_text(), WHITE, "")


def sha256(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


def _located(row: str | None) -> Column:
    return F.col(row) if row else F.monotonically_increasing_id()


def digest_rows(docs: DataFrame, digest: Callable[[Column], Column] = sha256, row: str | None = None) -> DataFrame:
    """doc_id, digest, code points and locator of each row, written to the
    shared folder (no text); the locator is the column ``row`` or numbers the
    rows as written."""
    norm = docs.select("doc_id", normalised().alias("norm"), F.char_length(whole_text()).alias("points"), _located(row).alias("locator"))
    return staged(norm.select("doc_id", digest(F.col("norm")).alias("digest"), "points", "locator"), "digests")


def _first() -> Column:
    """Order in which a row is preferred: most code points, smallest doc_id, locator."""
    return F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("locator").alias("at"))


def run_state(spark: SparkSession, source: str, schema, state_dir: str) -> DataFrame:
    """Feed every file of ``source`` that this state has not seen into the
    keyed state, then read the state: digest, keep, group_size.  Calling it
    again with the same folder goes on where it stopped."""
    with settings(spark, STATE_CONF):
        rows = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(1 << 38)).parquet(source)
        state = rows.groupBy("digest").agg(F.min(_first()).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        run = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", state_dir).trigger(availableNow=True).start()
        run.awaitTermination()
        if run.lastProgress is None:
            return spark.createDataFrame([], state.schema)
        stored = spark.read.format("statestore").load(state_dir)
    keep, size = stored.schema["value"].dataType.fieldNames()[:2]
    return stored.select("key.digest", F.col("value")[keep].alias("keep"), F.col("value")[size].alias("group_size"))


def dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, state_dir: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest.  With ``state_dir``, a shared folder that
    calls after one another name, the rows are judged among all rows of the calls so far (``dedup_next``)."""
    return dedup_next(docs, state_dir, digest) if state_dir else _judged(docs, digest).drop("locator")


def dedup_next(docs: DataFrame, state_dir: str, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The rows of ``docs`` against all rows that earlier calls brought into the state: doc_id, keep_id, group_size,
    kept, digest.  The state's folder holds its input (``rows``: digests and normalised texts, found again by the
    locator, which no two calls share), the stream's checkpoint and the stores (``state``).  A row that an
    earlier call kept may give way to a later one that goes before it; its own verdict was that of its time."""
    spark, call = docs.sparkSession, uuid.uuid4().hex
    source = f"{state_dir}/rows"
    at = F.concat(F.lit(call + ":"), F.monotonically_increasing_id().cast("string"))
    norm = docs.select("doc_id", normalised().alias("norm"), F.char_length(whole_text()).alias("points"), at.alias("locator"))
    rows = norm.select("doc_id", digest(F.col("norm")).alias("digest"), "points", "locator", "norm")
    rows.write.mode("append").parquet(source)
    state = staged(run_state(spark, source, rows.drop("norm").schema, f"{state_dir}/state"), "dedup-groups")
    stored = spark.read.schema(rows.schema).parquet(source)
    hits = stored.join(state.filter("group_size > 1").select("digest"), "digest", "left_semi")
    torn = staged(hits.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("z")).filter("a <> z").select("digest"), "dedup-torn")
    mine = F.col("locator").startswith(call)
    verdict = ["doc_id", F.col("keep.id").alias("keep_id"), "group_size", (F.col("locator") == F.col("keep.at")).alias("kept"), "digest"]
    out = stored.filter(mine).join(state, "digest").select(*verdict)
    if torn.isEmpty():
        return out
    texts = stored.join(torn, "digest", "left_semi")
    groups = staged(texts.groupBy("norm").agg(F.min(_first()).alias("keep"), F.count(F.lit(1)).alias("group_size")), "dedup-torn-groups")
    return out.join(torn, "digest", "left_anti").select("doc_id", "keep_id", "group_size", "kept", "digest").unionByName(texts.filter(mine).join(groups, "norm").select(*verdict))


def _judged(docs: DataFrame, digest: Callable[[Column], Column] = sha256, row: str | None = None) -> DataFrame:
    """The verdicts of one call, with the locator of each row."""
    spark = docs.sparkSession
    rows = digest_rows(docs, digest, row)
    state = staged(run_state(spark, rows._staged_at, rows.schema, scratch(spark, "dedup-state")), "dedup-groups")
    hits = staged(rows.join(state.filter("group_size > 1").select("digest"), "digest", "left_semi").select("doc_id").distinct(), "dedup-hits")
    ids = sized(hits.withColumnRenamed("doc_id", "hit"))
    at = [row] if row else []
    texts = docs.select("doc_id", "text", *at).join(ids, F.col("doc_id").eqNullSafe(F.col("hit")), "left_semi").select("doc_id", normalised().alias("norm"), F.char_length(whole_text()).alias("points"), *at)
    texts = texts.withColumn("digest", digest(F.col("norm")))
    torn = staged(texts.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("z")).filter("a <> z").select("digest"), "dedup-torn")
    out = rows.join(state, "digest").select("doc_id", F.col("keep.id").alias("keep_id"), "group_size", (F.col("locator") == F.col("keep.at")).alias("kept"), "digest", "locator")
    if torn.isEmpty():
        return out
    # a digest that holds different texts: its rows by their bytes
    texts = staged(texts.join(torn, "digest").withColumn("locator", _located(row)), "dedup-torn-texts")
    groups = staged(texts.groupBy("norm").agg(F.min(_first()).alias("keep"), F.count(F.lit(1)).alias("group_size")), "dedup-torn-groups")
    again = texts.join(groups, "norm").select("doc_id", F.col("keep.id").alias("keep_id"), "group_size", (F.col("locator") == F.col("keep.at")).alias("kept"), "digest", "locator")
    return out.join(torn, "digest", "left_anti").select(again.columns).unionByName(again)


def keep_first(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """docs without the rows whose text an earlier choice holds.  Where a
    doc_id does not tell its row (null or repeated), docs are written once
    with a number for each row, and rows are dropped by that."""
    if ids_tell_rows(docs):
        return without(docs, staged(dedup(docs, digest).filter("not kept").select("doc_id"), "dedup-gone"))
    rows, row = numbered(docs)
    gone = staged(_judged(rows, digest, row=row).filter("not kept").select(F.col("locator").alias(row)), "dedup-gone")
    return without(rows, gone, row).drop(row)


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t, length(coalesce(text, '')) AS c FROM documents),
     k AS (SELECT doc_id, t, first_value(doc_id) OVER (PARTITION BY t ORDER BY c DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM k
"""


@query(SQL)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")
