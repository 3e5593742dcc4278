"""Helper operators: span collection (X10), prediction assignment (X12),
person cap (T2), test limit (T7), murmur3 strata (P11)."""

import pytest
from pyspark.sql import functions as F

from cohortflow.operators import cohort, context
from cohortflow.plans.registry import tables

SF = "/root/testdata/sf0.001"


def test_collect_spans_dedup_and_exclude(spark):
    df = spark.createDataFrame([(1, 5, 8, "A", "ents"), (1, 5, 8, "A", "ents"), (1, 1, 3, "B", "pollutions"),
                                (1, 0, 2, "C", "discarded")],
                               "note_id long, offset_begin int, offset_end int, label_name string, span_group string")
    out = context.collect_spans(df).collect()
    assert sorted((r["offset_begin"], r["label_name"]) for r in out) == [(0, "C"), (5, "A")]


def test_assign_predictions(spark):
    df = spark.createDataFrame([(1, (True, 0.9))], "id long, prediction struct<keep:boolean, score:double>")
    out = context.assign_predictions(df, mapping={"keep": "to_keep"})
    assert out.columns == ["id", "to_keep"] and out.first()["to_keep"] is True


def test_sample_persons_and_limit(spark):
    t = tables(spark, SF)
    strata = cohort.stratification(t)
    total = strata.count()
    s = cohort.sample_persons(strata, 40, total)
    assert 0 < s.count() < total
    assert cohort.sample_persons(strata, 10 * total, total).count() == total   # fraction clamped to 1


def test_murmur3_strata_person_unique(spark):
    t = tables(spark, SF)
    s = cohort.stratification(t, mode="murmur3")
    assert s.groupBy("person_id").count().filter(F.col("count") > 1).count() == 0
    assert s.filter((F.col("stratum") < 0) | (F.col("stratum") > 9)).count() == 0


def test_one_prediction_per_span(spark):
    from cohortflow.operators import ml
    rows = [(1, 0, True), (1, 0, True), (2, 5, False)]
    schema = "note_id long, offset_begin long, ml_to_keep boolean"
    got = ml.one_prediction(spark.createDataFrame(rows, schema), ["note_id", "offset_begin"]).collect()
    assert sorted(map(tuple, got)) == [(1, 0, True, 2), (2, 5, False, 1)]
    torn = spark.createDataFrame([*rows, (2, 5, True)], schema)
    with pytest.raises(Exception, match="predictions differ for span 2 5"):
        ml.one_prediction(torn, ["note_id", "offset_begin"]).collect()


def test_merged_predictions_where_gold_spans_meet(spark, tmp_path, monkeypatch):
    """Two gold rows moved onto one span keep a prediction each: nothing fails, nothing is multiplied."""
    from cohortflow.plans import model_rows_jobs as jobs

    schema = "note_id long, cse string, label_name string, label_value string, offset_begin int, offset_end int, to_keep boolean"
    gold = spark.createDataFrame([(1, "c", "A", "1", 5, 8, True), (1, "c", "A", "1", 5, 8, False), (1, "c", "A", "1", 9, 12, True),
                                  (1, "c", "A", "1", 9, 12, True), (2, "c", "A", "1", 5, 8, False)], schema)

    class Given:
        def __init__(self, *_):
            pass

        def ents(self, method):
            return gold

    monkeypatch.setattr(jobs, "Eval", Given)
    got = sorted((r["note_id"], r["offset_begin"], r["gold_to_keep"], r["ml_to_keep"], r["dup"]) for r in jobs.merged_predictions(spark, "").collect())
    assert [x[:3] for x in got] == [(1, 5, False), (1, 5, True), (1, 9, True), (1, 9, True), (2, 5, False)]
    assert [x[4] for x in got] == [2, 2, 2, 2, 1]
    assert got[0][3] == got[1][3] and got[2][3] == got[3][3]
