"""Session helpers.

Library code never creates a session: every operator takes DataFrames.  These
helpers are for tests, the bench and command-line use.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "cohortflow",
              driver_memory: str = "8g", extra: dict | None = None) -> SparkSession:
    """A session; a local one whose configuration names no ``spark.checkpoint.dir`` is built again with
    a scratch folder for it (one machine: its folder is shared), since it cannot be set at run time."""
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = driver_memory
    conf.update(extra or {})

    def build() -> SparkSession:
        b = SparkSession.builder.master(master).appName(app)
        for k, v in conf.items():
            b = b.config(k, v)
        return b.getOrCreate()

    spark = build()
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.master.startswith("local["):
        spark.stop()
        conf["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="cohortflow-ckpt-")
        spark = build()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session's ``spark.checkpoint.dir``."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(d)
    return d


def settled(df: DataFrame) -> DataFrame:
    """df computed once, into the shared checkpoint folder; its lineage ends there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
