"""Artifact store between pipeline stages.

Artifacts are Parquet tables under a shared root, partitioned by
``(model, cse)`` or ``(cse, snapshot, patient_type)``; reads prune
partitions.  Nothing goes through the driver but paths and the existence
check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    """S4 helper: does ``path`` exist (Hadoop FileSystem, any scheme)?"""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def compute_once(spark: SparkSession, path: str, build) -> DataFrame:
    """Write ``build()`` to ``path`` unless it exists, then read it back
    (no interactive prompt; concurrent writers are ignored by mode=ignore)."""
    if not exists(spark, path):
        build().write.mode("ignore").parquet(path)
    return spark.read.parquet(path)


def save(df: DataFrame, root: str, name: str, model: str, mode: str = "overwrite") -> None:
    """Store an artifact under ``root/name`` partitioned by
    (model, cse)."""
    out = df.withColumn("model", F.lit(model))
    if "cse" not in out.columns:
        out = out.withColumn("cse", F.lit("Overall"))
    out.write.mode(mode).partitionBy("model", "cse").parquet(f"{root}/{name}")


def get(spark: SparkSession, root: str, name: str, model: str | None = None, cse: str | None = None) -> DataFrame:
    """Read an artifact, partition-pruned on model / cse."""
    df = spark.read.parquet(f"{root}/{name}")
    if model is not None:
        df = df.filter(F.col("model") == model)
    if cse is not None:
        df = df.filter(F.col("cse") == cse)
    return df


def write_snapshot(df: DataFrame, root: str, data_type: str, snapshot: str) -> None:
    """S8 writer: ``root/data_type/cse=/snapshot=/patient_type=``."""
    df.withColumn("snapshot", F.lit(snapshot)).write.mode("append") \
        .partitionBy("cse", "snapshot", "patient_type").parquet(f"{root}/{data_type}")


def latest_snapshots(spark: SparkSession, root: str, data_type: str, cse: str | None = None) -> DataFrame:
    """S8 + S9: per cohort, the lexicographically last snapshot; all cohorts
    unioned (one partitioned read, the max computed per cohort)."""
    df = spark.read.parquet(f"{root}/{data_type}")
    if cse is not None:
        df = df.filter(F.col("cse") == cse)
    last = df.select("cse", "snapshot").distinct().groupBy("cse").agg(F.max("snapshot").alias("snapshot"))
    return df.join(F.broadcast(last), ["cse", "snapshot"], "left_semi")


#: Texts hold line ends and quotes: every field is quoted, quotes are doubled.
CSV = {"header": "true", "multiLine": "true", "quoteAll": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "emptyValue": ""}


def export_per_cohort(annotations: DataFrame, texts: DataFrame, out: str) -> None:
    """Annotations joined with their note texts, one CSV folder per cohort."""
    annotations.join(texts.select("note_id", "cse", "note_text"), ["note_id", "cse"]) \
        .write.mode("overwrite").options(**CSV).partitionBy("cse").csv(out)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read.options(**CSV)
    return r.schema(schema).csv(path) if schema else r.option("inferSchema", False).csv(path)
