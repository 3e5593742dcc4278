"""Texts are moved once, and only where they are read: what is chosen or counted before stays narrow."""

from __future__ import annotations

from cohortflow.operators import ml
from cohortflow.plans import common
from cohortflow.plans.eval_jobs import Eval
from cohortflow.plans.registry import tables

SF = "/root/testdata/sf0.001"


def moves(df, spark) -> int:
    """Shuffles of rows that hold a text, with no join small enough for a broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = df._jdf.queryExecution().sparkPlan()
        full = df._jdf.queryExecution().executedPlan().toString()
        assert plan is not None
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    n, lines = 0, full.split("\n")
    for i, line in enumerate(lines):
        if "Exchange" in line and "Broadcast" not in line:
            below = next((x for x in lines[i + 1 :] if "Project" in x or "FileScan" in x or "Join" in x or "MapInArrow" in x), "")
            n += "note_text" in below or " text#" in below
    return n


def test_corpus_moves_texts_once(spark):
    t = tables(spark, SF)
    assert moves(common.texts(t), spark) == 1
    assert moves(common.all_texts(t), spark) == 1


def test_entities_of_every_note_move_no_text(spark):
    assert moves(common.all_rule_entities(tables(spark, SF)), spark) == 0


def test_lengths_move_no_text(spark):
    e = Eval(spark, SF)
    assert sorted(map(tuple, e.lengths.collect())) == sorted((r["note_id"], len(r["note_text"])) for r in e.texts.collect())


def test_corpus_entities_move_no_text(spark, monkeypatch):
    """The rule entities of the corpus are found where the documents are read."""
    e, plans = Eval(spark, SF), []
    monkeypatch.setattr("cohortflow.plans.eval_jobs.settled", lambda df: plans.append(df) or df)
    assert moves(e.rule, spark) == 0 and len(plans) == 2
    want = common.rule_entities(e.t, e.texts)
    assert sorted(map(str, e.rule.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_fits_run_on_few_partitions(spark, monkeypatch):
    """What a step of a fit shuffles is a vector a partition, so their number must not grow with the rows."""
    seen = []

    class Kept:
        def fit(self, data):
            seen.append(data.rdd.getNumPartitions())
            raise InterruptedError

    monkeypatch.setattr(ml, "pipeline", lambda **_: Kept())
    monkeypatch.setattr(ml, "classifier", lambda **_: Kept())
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(400).repartition(4 * cores).selectExpr("id as note_id", "'a b' as model_text", "1.0D as label", "1.0D as weight", "true as to_keep", "'c' as cse")
    for run in (lambda: ml.fit(rows), lambda: ml.grid_search(rows, rows, [{"reg": [0.1]}]), lambda: ml.predictions_by_cohort(rows, ["c"], "c")):
        try:
            run()
        except InterruptedError:
            pass
    assert len(seen) == 3 and max(seen) <= cores
