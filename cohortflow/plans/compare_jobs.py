"""Registered comparison and report jobs: methods side by side with intervals (A28, A29, C7, C8), report tables of
text cells (T5, U7, U8), up-sampled notes (A18), validation visits and enriched notes (X16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortflow import config
from cohortflow.operators import cohort, entities, labels, metrics, reports, resample, snippets
from cohortflow.operators.joins import checked_join
from cohortflow.plans import boot_sql as bs
from cohortflow.plans import common
from cohortflow.plans import eval_sql as es

from cohortflow.plans.eval_jobs import EVAL_PREFIX, G4, Eval, _claim_sql, _entity_metrics_sql, _nl_sql, _note_metrics_sql
from cohortflow.plans.extra_jobs import CLAIM_KEPT
from cohortflow.plans.registry import ORACLES, register, tables
from cohortflow.plans.resample_jobs import _confusion_sql
from cohortflow.plans.score_jobs import PHENO_COLS, pheno_wide_sql
from cohortflow.plans.snippet_jobs import annotation_notes
from cohortflow.plans.sqlmodel import inpatient_notes_sql

COMPARED = ["ml", "rule_based", "no_qual", "icd10"]
MEASURES = ["PPV", "Sensitivity", "F1", "Specificity"]


def compared_cells(e: Eval):
    """Note-level metrics of all methods on the inpatient notes of all cohorts, with intervals, in one grouped job
    (the method is a key)."""
    gold, parts = e.note_labels("gold"), []
    for m in COMPARED:
        algo = e.claim_labels().withColumn("patient_type", F.lit("inpatient")) if m == "icd10" else e.note_labels(m)
        c = metrics.note_confusion(algo, gold, m, G4).filter((F.col("cse") == labels.OVERALL) & (F.col("patient_type") == "inpatient"))
        parts.append(c.withColumn("method", F.lit(m)).drop("patient_type"))
    counts = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return resample.metrics_with_intervals(counts, ["method", "cse"], e.denominators(("cse",), inpatient_only=True))


def compared(cells):
    """One row per (label, metric), one text column per method; only averages keep their interval."""
    cells = labels.remove_aggregated_label(cells)
    total = F.col("label_name") == labels.TOTAL
    rows = cells.select(F.when(total, F.col("label_value")).otherwise(F.col("label_name")).alias("label_name"), "method",
                        *[F.when(total, F.col(m)).otherwise(F.substring_index(m, " ", 1)).alias(m) for m in MEASURES])
    return rows.unpivot(["label_name", "method"], MEASURES, "metric", "cell").groupBy("label_name", "metric").pivot("method", COMPARED).agg(F.first("cell"))


@register("compare_all_methods")
def compare_all_methods(spark, sf_dir):
    """A29 / C8 over ml, rule_based, no_qual and claims, with intervals on the averages; ml from the fixed predictions."""
    return compared(compared_cells(Eval(spark, sf_dir)))


@register("compare_all_methods_ml")
def compare_all_methods_ml(spark, sf_dir):
    """A29 / C8 with the predictions of the trained qualifier."""
    from cohortflow.plans.ml_jobs import scored_entities

    e = Eval(spark, sf_dir)
    e.predicted = scored_entities(e)
    return compared(compared_cells(e))


@register("qualifier_metrics_by_method")
def qualifier_metrics_by_method(spark, sf_dir):
    """A28, pivoted: keep decisions of ml (fixed predictions), rule_based and no_qual on the gold spans that the dictionary
    finds, Overall."""
    e = Eval(spark, sf_dir)
    key = ["note_id", "label_name", "label_value", "offset_begin"]
    gold = common.fixed_predictions(e.ents("gold")).filter(F.col("trained_on") == labels.OVERALL).withColumnRenamed("to_keep", "ml")
    d = checked_join(gold, e.ents("rule_based").select(*key, F.col("to_keep").alias("rule_based")), key, "inner", "m:1", what="dictionary spans")
    flags = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), c.alias("to_keep")) for m, c in
                                (("ml", F.col("ml")), ("rule_based", F.col("rule_based")), ("no_qual", F.lit(True)))])).alias("f")
    long = d.select("label_name", "label_value", "cse", "gold_to_keep", flags).select("*", "f.*").drop("f")
    m = metrics.add_avg_metrics(metrics.classification_metrics(resample.keep_confusion(long, ["method"])), ["method", "cse"])
    return m.filter(F.col("cse") == labels.OVERALL).groupBy("label_name", "label_value").pivot("method", ["ml", "rule_based", "no_qual"]).agg(
        *[F.first(c).alias(c) for c in ("F1", "PPV", "Sensitivity")])


@register("entity_metrics_intervals")
def entity_metrics_intervals(spark, sf_dir):
    """Entity-level metrics of the rule-based method with intervals.  Misses are Support - TP, which a method that finds
    several entities in one gold span can push below 0: such a row is resampled with no miss."""
    e = Eval(spark, sf_dir)
    m = metrics.entity_metrics(e.ents("rule_based"), e.ents("gold"), ["label_name", "label_value", "cse"]).filter(F.col("label_name") != labels.TOTAL)
    counts = m.select("label_name", "label_value", "cse", *[F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).alias(c) for c in ("TP", "FN", "FP")])
    return resample.metrics_with_intervals(counts, ["cse"])


# ---------------------------------------------------------------------------
# Report tables
# ---------------------------------------------------------------------------


def _upsampled_gold(spark, sf_dir):
    """Gold entities; an md5-keyed quarter of the notes counts as up-sampled."""
    from cohortflow.functions.exprs import md5_unit

    return Eval(spark, sf_dir).ents("gold").withColumn("upsampled", md5_unit(F.lit("upsampled"), "note_id") < 0.25)


@register("cohort_stats_upsampled")
def cohort_stats_upsampled(spark, sf_dir):
    """A18 with up-sampled notes, which count for n_docs_upsampled alone."""
    return reports.cohort_stats_per_label(_upsampled_gold(spark, sf_dir))


@register("report_table_1_conditions")
def report_table_1_conditions(spark, sf_dir):
    """``n (mean)`` per label, cohort and patient type."""
    return reports.condition_table(reports.cohort_stats_per_label(_upsampled_gold(spark, sf_dir)))


@register("report_table_2")
def report_table_2(spark, sf_dir):
    """U8, table 2: note-level metrics of the rule-based method per cohort, one decimal, "-" where undefined."""
    e = Eval(spark, sf_dir)
    m = metrics.note_metrics(e.note_labels("rule_based"), e.note_labels("gold"), "rule_based", e.denominators(("cse",)), ["label_name", "label_value", "cse"])
    return reports.cell_table(m, ["PPV", "Sensitivity", "F1", "Specificity"])


@register("report_table_3")
def report_table_3(spark, sf_dir):
    """U8, table 3: shares found by NLP only and by claims only among the gold positives, and their number, per cohort."""
    v = metrics.claim_vs_nlp(Eval(spark, sf_dir).side_by_side(("label_name", "label_value", "cse")))
    return reports.cell_table(v, ["pct_nlp_only", "pct_claim_only", "Support"])


# ---------------------------------------------------------------------------
# Enriched annotation notes (J6, J8, X16) and up-sampled entities
# ---------------------------------------------------------------------------


@register("enriched_annotation_notes")
def enriched_annotation_notes(spark, sf_dir):
    """J6 + J8: the annotated notes with the visit, person and dates of the note that their composite id names; an id
    that names no note or several fails."""
    t = tables(spark, sf_dir)
    a = snippets.note_id_parts(annotation_notes(spark, sf_dir))
    meta = cohort.notes(t).select(F.col("note_id").alias("parsed_note_id"), "visit_occurrence_id", "person_id", "note_datetime")
    out = checked_join(a, meta, ["parsed_note_id"], "inner", "m:1", what="notes")
    v = cohort.visits(t).select("visit_occurrence_id", "visit_start_datetime", "visit_end_datetime")
    out = checked_join(out, v, ["visit_occurrence_id"], "left", "m:1", what="visits")
    return out.select("note_id", "old_note_id", "label_name", "title", "note_text", "visit_occurrence_id", "person_id", "note_datetime", "visit_start_datetime", "visit_end_datetime")


@register("annotated_entities_clean")
def annotated_entities_clean(spark, sf_dir):
    """Entities of the annotation documents under the documents' composite ids; on a document made for a rare label
    only that label's entities stay."""
    e = Eval(spark, sf_dir)
    docs = e.rule.filter(F.col("patient_type") == "inpatient").select(F.col("label_name").alias("sampled_for"), F.col("note_id").alias("old_note_id")).distinct()
    rows = e.rule.select(F.col("note_id").alias("old_note_id"), "label_name", "offset_begin", "offset_end").join(docs, "old_note_id")
    rows = rows.withColumn("note_id", F.concat_ws("-", "sampled_for", F.lit("inpatient"), F.col("old_note_id").cast("string")))
    return entities.clean_upsampled(rows).select("note_id", "label_name", "offset_begin", "offset_end")


# ---------------------------------------------------------------------------
# SQL twins
# ---------------------------------------------------------------------------


def _compare_sql():
    sql = EVAL_PREFIX + _nl_sql("gold") + "".join(_nl_sql(m) for m in COMPARED[:3]) + _claim_sql()
    sql += """,
nl_claim AS (SELECT *, 'inpatient' AS patient_type FROM nl_icd10),
nl_gin AS (SELECT * FROM nl_gold WHERE patient_type = 'inpatient')"""
    for m in COMPARED:
        sql += _confusion_sql("nl_claim" if m == "icd10" else f"nl_{m}", "nl_gin" if m == "icd10" else "nl_gold", m, G4, f"c_{m}")
    sql += ",\ncnt AS (" + " UNION ALL ".join(
        f"SELECT '{m}' AS method, * EXCLUDE (patient_type) FROM c_{m} WHERE cse = 'Overall' AND patient_type = 'inpatient'" for m in COMPARED) + ")"
    sql += f""",
den_0 AS (SELECT note_id, cse FROM texts WHERE patient_type = 'inpatient'),
den_1 AS ({es.overall("den_0")}),
den AS (SELECT method, cse, count(DISTINCT note_id) AS N FROM den_1, (SELECT unnest({COMPARED}) AS method) GROUP BY method, cse),"""
    sql += bs.with_intervals("cnt", ["method", "cse"], "den")
    short = ", ".join(f"CASE WHEN label_name = 'Total' THEN {m} ELSE split_part({m}, ' ', 1) END AS {m}" for m in MEASURES)
    return sql + f""",
rl AS ({es.removed_aggregated("cell")}),
rn AS (SELECT CASE WHEN label_name = 'Total' THEN label_value ELSE label_name END AS label_name, method, {short} FROM rl),
lg AS (SELECT * FROM rn UNPIVOT INCLUDE NULLS (cell FOR metric IN ({", ".join(MEASURES)})))
SELECT label_name, metric, {", ".join(f"first(cell) FILTER (WHERE method = '{m}') AS {m}" for m in COMPARED)} FROM lg GROUP BY label_name, metric"""


ORACLES["compare_all_methods"] = _compare_sql()

_METHODS = ["ml", "rule_based", "no_qual"]
ORACLES["qualifier_metrics_by_method"] = EVAL_PREFIX + f""",
gold AS ({common.method_sql("gold")}),
pred AS ({common.fixed_predictions_sql("gold")}),
rbe AS ({common.method_sql("rule_based")}),
qd AS (SELECT p.label_name, p.label_value, p.cse, p.gold_to_keep, p.to_keep AS ml, r.to_keep AS rule_based, TRUE AS no_qual
       FROM pred p JOIN rbe r USING (note_id, label_name, label_value, offset_begin) WHERE p.trained_on = 'Overall'),
ql AS (SELECT * FROM qd UNPIVOT (k FOR method IN (ml, rule_based, no_qual))),
qa AS ({es.aggregated("ql")}),
qo AS ({es.overall("qa")}),
qc AS (SELECT label_name, label_value, method, cse, count_if(k AND gold_to_keep) AS TP, count_if(NOT k AND gold_to_keep) AS FN, count_if(k AND NOT gold_to_keep) AS FP FROM qo GROUP BY ALL),
qm AS ({es.with_metrics("qc")}),
qf AS ({es.avg_metrics("qm", ["method", "cse"], ["TP", "FN", "FP", "Support", "PPV", "Sensitivity", "F1"])})
SELECT label_name, label_value, {", ".join(f"first({c}) FILTER (WHERE method = '{m}') AS {m}_{c}" for m in _METHODS for c in ("F1", "PPV", "Sensitivity"))}
FROM qf WHERE cse = 'Overall' GROUP BY label_name, label_value"""

_K3 = ["label_name", "label_value", "cse"]
_ENT = EVAL_PREFIX + f""",
gold_e AS ({common.method_sql("gold")}),
rb_e AS ({common.method_sql("rule_based")})""" + _entity_metrics_sql("rb_e", _K3, True)
ORACLES["entity_metrics_intervals"] = _ENT.rsplit("\nSELECT", 1)[0] + """,
cnt AS (SELECT label_name, label_value, cse, greatest(coalesce(TP, 0), 0) AS TP, greatest(coalesce(FN, 0), 0) AS FN, greatest(coalesce(FP, 0), 0) AS FP FROM fin),""" \
    + bs.with_intervals("cnt", ["cse"], p="w_") + "\nSELECT * FROM w_cell"

_UP = EVAL_PREFIX + f""",
gold AS ({common.method_sql("gold")}),
g0 AS (SELECT *, {common._md5_unit_sql("'upsampled|' || CAST(note_id AS VARCHAR)")} < 0.25 AS upsampled FROM gold),
g1 AS ({es.overall("g0")}),
g2 AS (SELECT * FROM g1 UNION ALL SELECT * REPLACE ('Total' AS label_name, '1' AS label_value) FROM g1 WHERE label_name NOT IN {es.RARE}),
pd AS (SELECT cse, patient_type, label_name, note_id, count(*) AS n, count_if(upsampled) AS n_up, count_if(NOT upsampled) AS n_normal FROM g2 WHERE to_keep GROUP BY ALL),
pl AS (SELECT cse, patient_type, label_name, count_if(n_normal > 0) AS n_docs_normal, count_if(n_up > 0) AS n_docs_upsampled,
       CAST(sum(n_normal) AS DOUBLE) / CAST(NULLIF(count_if(n_normal > 0), 0) AS DOUBLE) AS mean_entity_per_doc, stddev_samp(n) AS std_entity_per_doc FROM pd GROUP BY ALL)"""
ORACLES["cohort_stats_upsampled"] = _UP + "\nSELECT * FROM pl"


def _pivot_cells(src: str, rows: str, columns, missing: str) -> str:
    return f"\nSELECT {rows}, " + ", ".join(f"coalesce(first(cell) FILTER (WHERE col = '{c}'), '{missing}') AS {c}" for c in columns) + f" FROM {src} GROUP BY {rows}"


_ALL = config.CSE_PROJECTS + ["Overall"]
ORACLES["report_table_1_conditions"] = _UP + f""",
ce AS (SELECT label_name, cse || '_' || patient_type AS col, n_docs_normal || ' (' || {bs.one_decimal("mean_entity_per_doc")} || ')' AS cell FROM pl)""" \
    + _pivot_cells("ce", "label_name", [f"{c}_{p}" for c in _ALL for p in config.PATIENT_TYPES], "0")


def _cell_sql(src: str, ms) -> str:
    return f""",
cl AS (SELECT * FROM (SELECT label_name, label_value, cse, {", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in ms)} FROM {src}) UNPIVOT INCLUDE NULLS (value FOR metric IN ({", ".join(ms)}))),
ce AS (SELECT label_name, label_value, cse || '_' || metric AS col, {bs.one_decimal("value")} AS cell FROM cl WHERE cse <> 'Overall')""" \
        + _pivot_cells("ce", "label_name, label_value", [f"{c}_{m}" for c in config.CSE_PROJECTS for m in ms], "-")


ORACLES["report_table_2"] = EVAL_PREFIX + _nl_sql("gold") + _nl_sql("rule_based") + _note_metrics_sql("nl_rule_based", "rule_based", _K3, final_select=False) \
    + _cell_sql("fin", ["PPV", "Sensitivity", "F1", "Specificity"])


def _table_3_sql():
    from cohortflow.plans.eval_jobs import _side_sql

    return EVAL_PREFIX + _side_sql(("label_name", "label_value", "cse")) + f""",
cv AS (SELECT label_name, label_value, cse, {es.pct("count_if(nlp AND NOT claim)", "count(*)")} AS pct_nlp_only,
              {es.pct("count_if(claim AND NOT nlp)", "count(*)")} AS pct_claim_only, count(*) AS Support FROM side WHERE gold GROUP BY ALL)""" \
        + _cell_sql("cv", ["pct_nlp_only", "pct_claim_only", "Support"])


ORACLES["report_table_3"] = _table_3_sql()

_ANNOTATED = ORACLES["annotation_notes"].rsplit("\nSELECT label_name || ", 1)
ORACLES["enriched_annotation_notes"] = _ANNOTATED[0] + """
SELECT a.label_name || '-inpatient-' || CAST(a.note_id AS VARCHAR) AS note_id, a.note_id AS old_note_id, a.label_name, a.label_name || ' - CR-HOSP' AS title,
       a.snippet_note_text AS note_text, n.visit_occurrence_id, n.person_id, n.note_datetime, v.visit_start_datetime, v.visit_end_datetime
FROM txt a JOIN clinical_note n USING (note_id) LEFT JOIN visit_occurrence v ON v.visit_occurrence_id = n.visit_occurrence_id"""

ORACLES["annotated_entities_clean"] = EVAL_PREFIX + """,
sf AS (SELECT DISTINCT label_name AS sampled_for, note_id FROM rb WHERE patient_type = 'inpatient')
SELECT sampled_for || '-inpatient-' || CAST(note_id AS VARCHAR) AS note_id, label_name, offset_begin, offset_end
FROM rb JOIN sf USING (note_id) WHERE """ + " AND ".join(f"NOT (sampled_for = '{r}' AND label_name <> '{r}')" for r in config.RARE_COMORBS)

_BLANK = [c for c in PHENO_COLS if not c.endswith(tuple("_" + k for k in CLAIM_KEPT))]
ORACLES["validation_visits"] = EVAL_PREFIX + f""",
tp AS (SELECT person_id FROM strata WHERE stratum >= {config.TEST_THRESHOLD}),
av AS (SELECT * FROM visit_occurrence WHERE visit_source_value = 'Hosp' AND person_id IN (SELECT person_id FROM tp)),
vn AS (SELECT n.note_id, n.person_id, n.visit_occurrence_id, av.visit_start_datetime FROM clinical_note n
       LEFT JOIN av ON av.person_id = n.person_id AND av.visit_occurrence_id = n.visit_occurrence_id
       WHERE n.person_id IN (SELECT person_id FROM tp) AND n.note_id IN (SELECT note_id FROM rb WHERE patient_type = 'inpatient')),
cond2 AS (SELECT * FROM condition_occurrence WHERE visit_occurrence_id IN (SELECT visit_occurrence_id FROM vn)),
cv AS (SELECT * FROM av WHERE visit_occurrence_id IN (SELECT visit_occurrence_id FROM cond2)),
selv AS ({inpatient_notes_sql("inpatient", "cv")})""" + pheno_wide_sql("selv", "av").replace("condition_occurrence", "cond2") + f""",
wv AS (SELECT s.person_id, s.visit_occurrence_id, s.visit_start_datetime, w.* EXCLUDE (visit_occurrence_id)
              REPLACE ({", ".join(f"'{config.ABSENCE}' AS {c}" for c in _BLANK)}) FROM selv s JOIN wide w USING (visit_occurrence_id))
SELECT * FROM wv UNION ALL
SELECT person_id, visit_occurrence_id, visit_start_datetime, {", ".join(f"'{config.ABSENCE}' AS {c}" for c in PHENO_COLS)}
FROM vn WHERE visit_occurrence_id NOT IN (SELECT visit_occurrence_id FROM wv)"""

