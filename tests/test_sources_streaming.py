"""Artifact store and streaming extraction."""

import tempfile

from pyspark.sql import functions as F

from cohortflow.operators import cohort
from cohortflow.plans.registry import tables
from cohortflow.sources import artifacts
from cohortflow.streaming import notes_stream

SF = "/root/testdata/sf0.001"


def test_compute_once_and_store(spark):
    root = tempfile.mkdtemp(prefix="cf-art-", dir="/tmp")
    t = tables(spark, SF)
    calls = []

    def build():
        calls.append(1)
        return cohort.stratification(t)

    a = artifacts.compute_once(spark, f"{root}/strata", build)
    b = artifacts.compute_once(spark, f"{root}/strata", build)
    assert len(calls) == 1 and a.count() == b.count() > 0
    artifacts.save(a, root, "strata_store", model="m1")
    got = artifacts.get(spark, root, "strata_store", model="m1", cse="cse180032")
    assert got.count() == a.filter(F.col("cse") == "cse180032").count()


def test_latest_snapshot_per_cohort(spark):
    root = tempfile.mkdtemp(prefix="cf-snap-", dir="/tmp")
    df = spark.createDataFrame([(1, "c1", "inpatient"), (2, "c2", "inpatient")], "x long, cse string, patient_type string")
    artifacts.write_snapshot(df, root, "texts", "2021-01-01")
    artifacts.write_snapshot(df.withColumn("x", F.col("x") + 10), root, "texts", "2022-06-01")
    got = sorted(r["x"] for r in artifacts.latest_snapshots(spark, root, "texts").collect())
    assert got == [11, 12]


def test_export_per_cohort(spark):
    out = tempfile.mkdtemp(prefix="cf-csv-", dir="/tmp") + "/export"
    ann = spark.createDataFrame([(1, "c1", "A")], "note_id long, cse string, label_name string")
    tx = spark.createDataFrame([(1, "c1", "text one")], "note_id long, cse string, note_text string")
    artifacts.export_per_cohort(ann, tx, out)
    back = artifacts.read_csv(spark, out)
    assert back.count() == 1 and "cse" in back.columns


def test_streaming_extraction_matches_batch(spark):
    src = tempfile.mkdtemp(prefix="cf-stream-src-", dir="/tmp") + "/notes"
    sink = tempfile.mkdtemp(prefix="cf-stream-out-", dir="/tmp") + "/ents"
    t = tables(spark, SF)
    notes = cohort.notes(t).select("note_id", "visit_occurrence_id", "person_id", "note_class_source_value",
                                   "note_text", "note_datetime")
    notes.repartition(4).write.parquet(src)
    ck = tempfile.mkdtemp(prefix="cf-stream-ck-", dir="/tmp") + "/ck"
    q = notes_stream.start(spark, src, sink, name="t_entities", trigger_once=True, checkpoint=ck)
    q.awaitTermination(300)
    streamed = spark.read.parquet(sink).count()
    from cohortflow.operators import entities
    assert streamed == entities.extract_entities(notes).count() > 0
