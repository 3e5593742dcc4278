"""What the operators share: scratch tables in the shared folder and size-checked broadcasts."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.session import checkpoint_dir

#: Most ids that are broadcast to filter documents; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Rows that Spark hands to Python at a time while scratch tables are written.
BATCH_ROWS = 1000


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the jobs of a block."""
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def release() -> None:
    """Give freed memory of this Python worker back to the machine.  Workers
    are kept for later tasks, and what their allocators hold would add up."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run over a task's batches, and release when the task ends."""

    @functools.wraps(run)
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return task


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again: its lineage ends
    there, and a lost executor costs no more than the tasks it ran."""
    path = scratch(df.sparkSession, name)
    with settings(df.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS)}):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop_staged(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._staged_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def sized(ids: DataFrame) -> DataFrame:
    """A staged one-column table with a broadcast hint if it is small enough
    for one (counted from file footers)."""
    return F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids


def without(docs: DataFrame, gone: DataFrame, by: str = "doc_id") -> DataFrame:
    """Rows of docs whose doc_id (or column ``by``) is not in the staged table
    ``gone``; all columns stay, whatever their names; a null doc_id stays."""
    key = f"gone_{uuid.uuid4().hex[:8]}"
    ids = sized(gone.select(F.col(by).alias(key)))
    return docs.join(ids, docs[by] == ids[key], "left_anti")


def ids_tell_rows(docs: DataFrame) -> bool:
    """Whether every row has a doc_id that no other row has (reads no text)."""
    return docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null").isEmpty()


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs written once with a number for each row, and the name of that column."""
    row = f"row_{uuid.uuid4().hex[:8]}"
    return staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


#: Stands for a null doc_id inside tasks, where a column of numbers with nulls would lose its integers.
NO_ID = 2**63 - 1


def id_in() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")


def id_out() -> Column:
    return F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))


def in_train(doc_id: str = "doc_id") -> Column:
    """Rows whose label may be learnt: crc32(doc_id as text) mod 4 is not 2 (a null id may)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2, F.lit(True))


def sample_by_id(df: DataFrame, rows: int, seed: int, doc_id: str = "doc_id") -> DataFrame:
    """About ``rows`` rows at most, chosen by a hash of the id: the same rows
    on every run.  Counting reads no text."""
    n = df.select(doc_id).count()
    if n <= rows:
        return df
    part = max(1, int(1_000_000 * rows / n))
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id)), F.lit(1_000_000)) < part)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def texts_of(series: pd.Series) -> list[str]:
    return [x if isinstance(x, str) else "" for x in series]


def single_thread() -> None:
    """One task, one core: libraries inside tasks start no threads of their own."""
    for k in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "RAYON_NUM_THREADS"):
        os.environ.setdefault(k, "1")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register opN_<name>(spark, sf_dir) under its own name."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
