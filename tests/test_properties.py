"""Properties and plan checks on the driver's tables (sf0.001)."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from cohortflow.operators import entities, resample
from cohortflow.plans import common
from cohortflow.plans.registry import tables

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() == 27 and "cim10_diabetes" in df.columns


def test_every_query_has_callable_and_oracles_subset():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 50


def test_sentences_tile_text(spark):
    t = tables(spark, SF)
    tx = common.texts(t)
    s = entities.sentences(tx).groupBy("note_id").agg(F.array_join(F.sort_array(F.collect_list(
        F.struct("sent_idx", "sentence"))).getField("sentence"), "").alias("joined"))
    bad = s.join(tx, "note_id").filter(F.col("joined") != F.col("note_text")).count()
    assert bad == 0


def test_entity_variant_matches_text(spark):
    t = tables(spark, SF)
    tx = common.texts(t)
    e = entities.extract_entities(tx)
    j = e.join(tx.select("note_id", "note_text"), "note_id")
    bad = j.filter(F.substring("note_text", F.col("offset_begin") + 1, F.col("offset_end") - F.col("offset_begin"))
                   != F.col("lexical_variant")).count()
    assert bad == 0


def test_bootstrap_keeps_n_and_ci_ordered(spark):
    st = spark.createDataFrame([("A", "c", 5, 3, 2), ("B", "c", 0, 0, 0), ("C", "c", 10, 1, 4)],
                               "label_name string, cse string, TP long, FN long, FP long")
    reps = resample.replicate_counts(st, ["label_name", "cse"], iterations=50)
    bad = reps.join(st.select("label_name", (F.col("TP") + F.col("FN") + F.col("FP")).alias("n")), "label_name") \
        .filter(F.col("TP") + F.col("FN") + F.col("FP") != F.col("n")).count()
    assert bad == 0 and reps.count() == 150
    again = resample.replicate_counts(st.repartition(3), ["label_name", "cse"], iterations=50)
    assert sorted(map(tuple, reps.collect())) == sorted(map(tuple, again.collect()))


@pytest.mark.parametrize("name", ["note_metrics_rule_based", "claim_phenotypes", "prevalence"])
def test_same_result_with_1_and_64_partitions(spark, name):
    fn = E.queries()[name]
    res = []
    for n in ("1", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        res.append(sorted(tuple(str(round(x, 9)) if isinstance(x, float) else str(x) for x in r)
                          for r in fn(spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert res[0] == res[1]


@pytest.mark.parametrize("name", ["claim_phenotypes", "entities_all_notes", "entity_metrics_rule_based",
                                  "snippet_texts", "history_phenotype"])
def test_plans_have_no_cartesian_or_row_python(spark, name):
    plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan


def test_scan_prunes_columns(spark):
    plan = E.queries()["visit_phenotype_regex"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all("l_comment" not in s and "l_quantity" not in s for s in schemas)
