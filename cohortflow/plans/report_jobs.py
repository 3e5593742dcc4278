"""Registered cohort-statistics and report jobs (C4, A4, A5, A17, A18, A34,
U8, T5, P26)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortflow import config
from cohortflow.operators import cohort, entities, metrics, reports
from cohortflow.plans import common
from cohortflow.plans import eval_sql as es
from cohortflow.plans.eval_jobs import G4, Eval, EVAL_PREFIX, _nl_sql, _note_metrics_sql
from cohortflow.plans.registry import ORACLES, register, tables
from cohortflow.plans.sqlmodel import MODEL, values, with_model
from cohortflow.sources import dims


def _demo(spark, sf_dir):
    t = tables(spark, sf_dir)
    return reports.cohort_demographics(common.texts(t, with_text=False), cohort.visits(t), cohort.persons(t))


@register("cohort_demographics")
def cohort_demographics(spark, sf_dir):
    """C4: age at admission and sex of the stays of the evaluation corpus."""
    return _demo(spark, sf_dir)


@register("cohort_stats")
def cohort_stats(spark, sf_dir):
    """Age mean/sd and sex split per cohort and patient type (+Overall)."""
    return reports.cohort_stats(_demo(spark, sf_dir))


@register("cohort_stats_per_label")
def cohort_stats_per_label(spark, sf_dir):
    """A18 on the gold entities (no up-sampled notes in this corpus)."""
    t = tables(spark, sf_dir)
    g = common.method_entities(t, "gold").withColumn("upsampled", F.lit(False))
    return reports.cohort_stats_per_label(g)


@register("cohort_table")
def cohort_table(spark, sf_dir):
    """Cohort description table (A17 block over the A18 block)."""
    t = tables(spark, sf_dir)
    g = common.method_entities(t, "gold").withColumn("upsampled", F.lit(False))
    return reports.cohort_table(reports.cohort_stats(_demo(spark, sf_dir)), reports.cohort_stats_per_label(g))


@register("qualifier_shares")
def qualifier_shares(spark, sf_dir):
    """Qualifier shares of the rule-based entities per cohort."""
    t = tables(spark, sf_dir)
    return reports.qualifier_shares(common.rule_entities(t), ["cse"])


@register("entity_counts")
def entity_counts(spark, sf_dir):
    """A4: entities per configured label over all notes, zero-filled."""
    t = tables(spark, sf_dir)
    return reports.entity_counts(entities.extract_entities(cohort.notes(t), qualify=False),
                                 dims.comorb_config(spark))


@register("entities_per_doc")
def entities_per_doc(spark, sf_dir):
    """Entities per note (zero-filled) with their 1-based rank."""
    t = tables(spark, sf_dir)
    n = cohort.notes(t)
    return reports.entities_per_doc(entities.extract_entities(n, qualify=False), n)


@register("metric_table")
def metric_table(spark, sf_dir):
    """U8 (+T5, P26): note-level PPV / Sensitivity / F1 of the rule-based
    method, one column per cohort."""
    e = Eval(spark, sf_dir)
    m = metrics.note_metrics(e.note_labels("rule_based"), e.note_labels("gold"), "rule_based",
                             e.denominators(), G4).filter(F.col("patient_type") == "inpatient")
    return reports.metric_table(m)


# ---------------------------------------------------------------------------
# SQL twins
# ---------------------------------------------------------------------------

DEMO_SQL = EVAL_PREFIX.replace("WITH person AS", "WITH person AS", 1) + """,
tv AS (SELECT DISTINCT visit_occurrence_id, cse, patient_type FROM texts),
demo AS (SELECT tv.cse, tv.patient_type,
                CAST(floor(date_diff('day', CAST(p.birth_datetime AS DATE), CAST(v.visit_start_datetime AS DATE))
                           / 365.2425) AS INTEGER) AS age_at_adm,
                p.gender_source_value
         FROM visit_occurrence v JOIN person p USING (person_id) JOIN tv USING (visit_occurrence_id))"""

ORACLES["cohort_demographics"] = DEMO_SQL + "\nSELECT * FROM demo"
ORACLES["cohort_stats"] = DEMO_SQL + f""",
d AS ({es.overall("demo")})
SELECT cse, patient_type, count(*) AS n, avg(age_at_adm) AS age_mean, stddev_samp(age_at_adm) AS age_std,
       CAST(trunc(100.0 * avg(CASE WHEN gender_source_value = 'M' THEN 1.0 ELSE 0.0 END)) AS INTEGER) AS pct_male,
       CAST(trunc(100.0 * (1.0 - avg(CASE WHEN gender_source_value = 'M' THEN 1.0 ELSE 0.0 END))) AS INTEGER)
         AS pct_female
FROM d GROUP BY cse, patient_type"""

RARE = "(" + ", ".join(f"'{x}'" for x in config.RARE_COMORBS) + ")"
ORACLES["cohort_stats_per_label"] = EVAL_PREFIX + f""",
gold AS ({common.method_sql("gold")}),
g0 AS (SELECT *, FALSE AS upsampled FROM gold),
g1 AS ({es.overall("g0")}),
g2 AS (SELECT * FROM g1 UNION ALL
       SELECT * REPLACE ('Total' AS label_name, '1' AS label_value) FROM g1 WHERE label_name NOT IN {RARE}),
pd AS (SELECT cse, patient_type, label_name, note_id, count(*) AS N, count_if(upsampled) AS N_up,
              count_if(NOT upsampled) AS N_normal FROM g2 WHERE to_keep GROUP BY ALL)
SELECT cse, patient_type, label_name, count_if(N_normal > 0) AS n_docs_normal, count_if(N_up > 0) AS n_docs_upsampled,
       CAST(sum(N_normal) AS DOUBLE) / CAST(NULLIF(count_if(N_normal > 0), 0) AS DOUBLE) AS mean_entity_per_doc,
       stddev_samp(N) AS std_entity_per_doc
FROM pd GROUP BY ALL"""

ORACLES["qualifier_shares"] = EVAL_PREFIX + """
SELECT cse, count(*) AS n,
       100.0 * avg(CAST(negation AS DOUBLE)) AS pct_negation, 100.0 * avg(CAST(hypothesis AS DOUBLE)) AS pct_hypothesis,
       100.0 * avg(CAST(family AS DOUBLE)) AS pct_family, 100.0 * avg(CAST(NOT to_keep AS DOUBLE)) AS pct_discarded
FROM rb GROUP BY cse"""

ALL_NER = with_model("clinical_note") + ",\n" + common.ner_sql("clinical_note", extra=("visit_occurrence_id",))

ORACLES["entity_counts"] = ALL_NER + f""",
cfg AS ({MODEL["comorb_cfg"]}),
c AS (SELECT label_name, count(*) AS n FROM ner GROUP BY ALL)
SELECT cfg.label_name, coalesce(c.n, 0) AS n_entities FROM cfg LEFT JOIN c USING (label_name)"""

ORACLES["entities_per_doc"] = ALL_NER + """,
c AS (SELECT note_id, count(*) AS n FROM ner GROUP BY ALL),
d AS (SELECT o.note_id, coalesce(c.n, 0) AS N FROM clinical_note o LEFT JOIN c USING (note_id))
SELECT note_id, N, row_number() OVER (ORDER BY N, note_id) AS "index" FROM d"""

_CSES = config.CSE_PROJECTS + ["Overall"]
_DISPLAY = values(sorted(config.DISPLAY_NAMES.items()), ["k", "v"])
_RANK = values([(c[1], c[7]) for c in config.COMORBIDITIES], ["k", "r"])
ORACLES["metric_table"] = EVAL_PREFIX + _nl_sql("gold") + _nl_sql("rule_based") + _note_metrics_sql(
    "nl_rule_based", "rule_based", G4, final_select=False) + f""",
nm AS (SELECT * FROM fin WHERE patient_type = 'inpatient'),
lg AS (SELECT * FROM (SELECT label_name, label_value, cse, CAST(PPV AS DOUBLE) AS PPV,
                       CAST(Sensitivity AS DOUBLE) AS Sensitivity, CAST(F1 AS DOUBLE) AS F1 FROM nm)
       UNPIVOT INCLUDE NULLS (value FOR metric IN (PPV, Sensitivity, F1)))
SELECT coalesce(dn.v, lg.label_name) AS label, lg.label_name, lg.label_value, lg.metric,
       {", ".join(f"first(lg.value) FILTER (WHERE lg.cse = '{c}') AS {c}" for c in _CSES)},
       coalesce(rk.r, 1000) AS rank
FROM lg LEFT JOIN {_DISPLAY} dn ON dn.k = lg.label_name LEFT JOIN {_RANK} rk ON rk.k = lg.label_name
GROUP BY ALL"""


def _cohort_table_sql():
    keys = [(c, p) for c in config.CSE_PROJECTS + ["Overall"] for p in config.PATIENT_TYPES]
    stats = ORACLES["cohort_stats"].split("\nSELECT cse, patient_type, count(*) AS n")[0]
    per_label = ORACLES["cohort_stats_per_label"][len(EVAL_PREFIX):].split(
        "\nSELECT cse, patient_type, label_name, count_if")[0]
    return stats + """,
st AS (SELECT cse, patient_type, CAST(count(*) AS DOUBLE) AS n, CAST(avg(age_at_adm) AS DOUBLE) AS age_mean,
              CAST(stddev_samp(age_at_adm) AS DOUBLE) AS age_std,
              CAST(CAST(trunc(100.0 * avg(CASE WHEN gender_source_value = 'M' THEN 1.0 ELSE 0.0 END)) AS INTEGER)
                   AS DOUBLE) AS pct_male,
              CAST(CAST(trunc(100.0 * (1.0 - avg(CASE WHEN gender_source_value = 'M' THEN 1.0 ELSE 0.0 END)))
                   AS INTEGER) AS DOUBLE) AS pct_female
       FROM d GROUP BY cse, patient_type),
la AS (SELECT 'Descriptive data' AS metric_type, metric, cse, patient_type, value
       FROM st UNPIVOT INCLUDE NULLS (value FOR metric IN (age_mean, age_std, pct_male, pct_female, n)))""" \
        + per_label + """,
pl AS (SELECT cse, patient_type, label_name, CAST(count_if(N_normal > 0) AS DOUBLE) AS n_docs_normal,
              CAST(sum(N_normal) AS DOUBLE) / CAST(NULLIF(count_if(N_normal > 0), 0) AS DOUBLE) AS mean_entity_per_doc
       FROM pd GROUP BY ALL),
lb AS (SELECT 'condition' AS metric_type, label_name || ' / ' || stat AS metric, cse, patient_type, value
       FROM pl UNPIVOT INCLUDE NULLS (value FOR stat IN (n_docs_normal, mean_entity_per_doc))),
lg AS (SELECT * FROM la UNION ALL SELECT * FROM lb)
SELECT metric_type, metric, """ + ", ".join(
        f"first(value) FILTER (WHERE cse = '{c}' AND patient_type = '{p}') AS {c}_{p}" for c, p in keys) + """
FROM lg GROUP BY metric_type, metric"""


ORACLES["cohort_table"] = _cohort_table_sql()
