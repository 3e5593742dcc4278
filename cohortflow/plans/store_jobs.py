"""Registered jobs of the sources and sinks: code sheets (S6), the artifact store (S4, S8-S11) and the export per cohort
(S12).  Each writes rows of the given tables to a folder of the shared one and returns what it reads back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortflow import config
from cohortflow.functions.exprs import md5_unit
from cohortflow.operators import cohort
from cohortflow.plans import common
from cohortflow.plans import eval_sql as es
from cohortflow.plans.eval_jobs import EVAL_PREFIX, Eval
from cohortflow.plans.registry import register, tables
from cohortflow.plans.sqlmodel import lit, values, with_model
from cohortflow.session import checkpoint_dir
from cohortflow.sources import artifacts, sheets

COMORBS = [c[0] for c in config.COMORBIDITIES]
#: Sheets of the code list by owner: one each, and a second one for the list-type comorbidities.
SHEET_OWNERS = {c[0]: [f"s{i:02d}"] + ([f"s{i:02d}b"] if c[2] == "list" else []) for i, c in enumerate(config.COMORBIDITIES)}
SHEETS = [s for own in SHEET_OWNERS.values() for s in own] + ["notes"]


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("code_sheets", sql=f"""
WITH sh AS (SELECT CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE chr(CAST(65 + p_partkey % 20 AS INTEGER)) || CAST(p_partkey AS VARCHAR) END AS code,
                   p_name AS libelle, CAST(p_size % 3 AS VARCHAR) AS status, CASE WHEN p_size % 2 = 0 THEN 'Principal' ELSE 'Fille' END AS hierarchie,
                   [{", ".join(lit(s) for s in SHEETS)}][CAST(p_partkey % {len(SHEETS)} AS INTEGER) + 1] AS sheet FROM part)
SELECT code, libelle, status, o.comorb, hierarchie FROM sh
JOIN {values([(s, c) for c, own in SHEET_OWNERS.items() for s in own], ["sheet", "comorb"])} o USING (sheet) WHERE code IS NOT NULL""")
def code_sheets(spark, sf_dir):
    """Code lists made from the parts, written as one folder per sheet and read as one dimension."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    key = F.col("p_partkey")
    code = F.when(key % 7 != 0, F.concat(F.chr(65 + key % 20), key.cast("string")))
    names = F.array(*[F.lit(s) for s in SHEETS])
    rows = p.select(code.alias("code"), F.col("p_name").alias("libelle"), (F.col("p_size") % 3).cast("string").alias("status"),
                    F.when(F.col("p_size") % 2 == 0, "Principal").otherwise("Fille").alias("hierarchie"),
                    F.element_at(names, (key % len(SHEETS)).cast("int") + 1).alias("sheet"))
    root = _folder(spark, "code-sheets")
    sheets.write_sheets(rows, root)
    return sheets.read_sheets(spark, root, SHEET_OWNERS)


@register("stored_strata", sql=with_model("person", "strata") + "\nSELECT person_id, cse, stratum FROM strata")
def stored_strata(spark, sf_dir):
    """The stratification computed once and read again; the second request must not compute."""
    path = _folder(spark, "strata")
    artifacts.compute_once(spark, path, lambda: cohort.stratification(tables(spark, sf_dir)).select("person_id", "cse", "stratum"))

    def never():
        raise RuntimeError("computed a second time")

    return artifacts.compute_once(spark, path, never)


_GOLD = EVAL_PREFIX + f""",
gold AS ({common.method_sql("gold")})"""
_ROWS = "note_id, visit_occurrence_id, cse, patient_type, label_name, label_value, offset_begin, offset_end, to_keep"


@register("latest_snapshots", sql=_GOLD + f"""
SELECT {_ROWS}, CASE WHEN cse = '{config.CSE_PROJECTS[0]}' THEN '20210101' ELSE '20210601' END AS snapshot FROM gold
WHERE cse = '{config.CSE_PROJECTS[0]}' OR {common._md5_unit_sql("'late|' || CAST(note_id AS VARCHAR)")} < 0.5""")
def latest_snapshots(spark, sf_dir):
    """S8 + S9: gold annotations in dated snapshots (the first cohort has one, the others a later and smaller one too),
    read as the last snapshot of each cohort."""
    gold, root = Eval(spark, sf_dir).ents("gold"), _folder(spark, "snapshots")
    artifacts.write_snapshot(gold, root, "gold", "20210101")
    later = gold.filter((F.col("cse") != config.CSE_PROJECTS[0]) & (md5_unit(F.lit("late"), "note_id") < 0.5))
    artifacts.write_snapshot(later, root, "gold", "20210601")
    return artifacts.latest_snapshots(spark, root, "gold").withColumn("snapshot", F.col("snapshot").cast("string"))


@register("stored_predictions", sql=_GOLD + f""",
pred AS ({common.fixed_predictions_sql("gold")}),
mine AS (SELECT * FROM pred WHERE trained_on = '{config.CSE_PROJECTS[1]}'),
st AS (SELECT label_name, cse, count(*) AS n, count_if(to_keep) AS kept FROM ({es.overall("mine")}) GROUP BY ALL)
SELECT label_name, n, kept, '{config.CSE_PROJECTS[1]}' AS model, cse FROM st WHERE cse = 'Overall'""")
def stored_predictions(spark, sf_dir):
    """S10 + S11: a table per model saved under (model, cse) and one model's Overall rows read back, pruned by partition."""
    pred, root = common.fixed_predictions(Eval(spark, sf_dir).ents("gold")), _folder(spark, "artifacts")
    from cohortflow.operators.labels import OVERALL, add_overall

    counts = add_overall(pred).groupBy("trained_on", "label_name", "cse").agg(F.count(F.lit(1)).alias("n"), F.count_if("to_keep").alias("kept"))
    for model in common.TRAINED_ON[1:]:
        artifacts.save(counts.filter(F.col("trained_on") == model).drop("trained_on"), root, "counts", model, mode="append")
    return artifacts.get(spark, root, "counts", config.CSE_PROJECTS[1], OVERALL)


@register("exported_annotations", sql=_GOLD + """
SELECT g.cse, CAST(g.note_id AS VARCHAR) AS note_id, g.label_name, CAST(g.offset_begin AS VARCHAR) AS offset_begin, md5(t.note_text) AS text_md5
FROM gold g JOIN texts t USING (note_id, cse)""")
def exported_annotations(spark, sf_dir):
    """Gold annotations joined with their texts, exported as CSV per cohort and read back (texts as digests)."""
    e, root = Eval(spark, sf_dir), _folder(spark, "export")
    artifacts.export_per_cohort(e.ents("gold").select("note_id", "cse", "label_name", "offset_begin"), e.texts, root)
    return artifacts.read_csv(spark, root).select("cse", "note_id", "label_name", "offset_begin", F.md5("note_text").alias("text_md5"))
