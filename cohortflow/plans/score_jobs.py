"""Registered score jobs: reported scores (C5) and Charlson comparison (C11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortflow import config
from cohortflow.operators import cohort, entities, labels, phenotype, scores
from cohortflow.operators.joins import one_per_key
from cohortflow.plans import common
from cohortflow.plans import eval_sql as es
from cohortflow.plans.cohort_jobs import REGEX_MAP_SQL, _visit_pheno_sql
from cohortflow.plans.registry import ORACLES, register, tables
from cohortflow.plans.sqlmodel import MODEL, inpatient_notes_sql, values, with_model
from cohortflow.sources import dims
from cohortflow.session import settled
from cohortflow.sources import tables as src

COMORBS = phenotype.COMORBS
PHENO_COLS = [f"cim10_{c}" for c in COMORBS] + [f"all_cim10_{c}" for c in COMORBS]


def mentioned_visits(spark, sf_dir):
    """Inpatient stays whose notes report a score (max per stay), their
    last note, claim phenotypes (history over the reporting stays, as in the
    study) and care site."""
    t = tables(spark, sf_dir)
    allv = cohort.visits(t, "inpatient")
    notes = cohort.notes(t).join(allv.select("visit_occurrence_id"), "visit_occurrence_id", "left_semi")
    kept = scores.visit_max_score(scores.score_mentions(notes)).join(allv, "visit_occurrence_id")
    sel_notes, sel_visits = cohort.select_notes(t, "inpatient", visits_df=kept)
    wide = phenotype.claim_phenotypes(sel_visits, kept, cohort.conditions(t), dims.icd10_codes(spark),
                                      via_regex=True)
    care = src.care_site(t).select(F.substring("location_cd", 5, 3).alias("care_site_id"),
                                   "visit_occurrence_id").distinct()
    out = (wide.join(care, "visit_occurrence_id", "left")
           .join(sel_notes.select("person_id", "visit_occurrence_id", "note_id", "note_text")
                 .join(kept.select("visit_occurrence_id", F.col("score_value").alias("reported_score")),
                       "visit_occurrence_id"),
                 ["person_id", "visit_occurrence_id"]))
    return out


@register("mentioned_scores")
def mentioned_scores(spark, sf_dir):
    return mentioned_visits(spark, sf_dir).select(
        "person_id", "visit_occurrence_id", "visit_start_datetime", "note_id", "care_site_id",
        "reported_score", *PHENO_COLS)


def _score_inputs(spark, sf_dir, revision="quan"):
    t = tables(spark, sf_dir)
    strata = cohort.stratification(t).select("person_id", "cse")
    mv = mentioned_visits(spark, sf_dir).join(strata, "person_id")
    # Notes and visits are told apart by (note, visit), and a visit has one note here, or the job fails
    mv = one_per_key(mv.dropDuplicates(["note_id", "visit_occurrence_id"]), ["visit_occurrence_id"], "notes")
    mv = settled(mv)
    notes = mv.select("note_id", "visit_occurrence_id", "cse", "note_text")
    ents = entities.extract_entities(notes, keep=("visit_occurrence_id", "cse"))
    ents = ents.withColumn("to_keep", entities.to_keep("rule_based")).withColumn("to_keep", common.fixed_ml_keep())
    ml = labels.note_labels(ents, "ml", ("label_name", "cse"), with_aggregated=False)
    vsev = phenotype.visit_severity(cohort.conditions(t), dims.icd10_codes(spark), via_regex=True)
    icd = labels.claim_labels(vsev.join(mv.select("visit_occurrence_id"), "visit_occurrence_id", "left_semi"),
                              notes, with_aggregated=False)
    cols = ["cse", "note_id", "source", "label_name", "label_value"]
    sc = scores.charlson_scores(ml.select(*cols).unionByName(icd.select(*cols)), spark, revision)
    return sc, mv


@register("charlson_scores_base")
def charlson_scores_base(spark, sf_dir):
    """A25 / A26 with the weights of the base revision."""
    sc, _ = _score_inputs(spark, sf_dir, "base")
    return sc


@register("score_mentions")
def score_mentions(spark, sf_dir):
    """P6 + X6: every note that reports a score, with the score's name and value."""
    return scores.score_mentions(cohort.notes(tables(spark, sf_dir))).select("note_id", "visit_occurrence_id", "score_name", "score_value")


@register("charlson_scores")
def charlson_scores(spark, sf_dir):
    """A25 (+A26 weights, J16): Charlson score per (cse, note, source)."""
    sc, _ = _score_inputs(spark, sf_dir)
    return sc


def _deltas(spark, sf_dir):
    sc, mv = _score_inputs(spark, sf_dir)
    return scores.score_deltas(sc, mv.select("cse", "note_id", "reported_score"))


@register("charlson_deltas")
def charlson_deltas(spark, sf_dir):
    """Per-note scores by source and the deltas to the NLP score."""
    return _deltas(spark, sf_dir)


@register("charlson_delta_stats")
def charlson_delta_stats(spark, sf_dir):
    """Mean / sd / quartiles of the deltas per cohort."""
    return scores.delta_stats(_deltas(spark, sf_dir))


@register("charlson_delta_histogram")
def charlson_delta_histogram(spark, sf_dir):
    """Integer histogram (percent) of the claim-vs-NLP delta."""
    return scores.delta_histogram(_deltas(spark, sf_dir))


# ---------------------------------------------------------------------------
# SQL twins
# ---------------------------------------------------------------------------

def pheno_wide_sql(sel: str, allv: str) -> str:
    own = ", ".join(f"coalesce(max(CASE WHEN o.comorb = '{c}' THEN o.status END), '{config.ABSENCE}') AS cim10_{c}"
                    for c in COMORBS)
    hist = ", ".join(f"coalesce(max(CASE WHEN h.comorb = '{c}' THEN h.status END), '{config.ABSENCE}') "
                     f"AS all_cim10_{c}" for c in COMORBS)
    return f""",
vp AS ({_visit_pheno_sql(REGEX_MAP_SQL)}),
hist AS (SELECT s.visit_occurrence_id, vp.comorb, max(vp.status) AS status
         FROM {sel} s JOIN {allv} a ON a.person_id = s.person_id AND s.visit_start_datetime >= a.visit_start_datetime
         JOIN vp ON vp.visit_occurrence_id = a.visit_occurrence_id GROUP BY ALL),
own AS (SELECT s.visit_occurrence_id, vp.comorb, vp.status FROM {sel} s JOIN vp USING (visit_occurrence_id)),
ow AS (SELECT s.visit_occurrence_id, {own} FROM {sel} s LEFT JOIN own o USING (visit_occurrence_id) GROUP BY ALL),
hw AS (SELECT s.visit_occurrence_id, {hist} FROM {sel} s LEFT JOIN hist h USING (visit_occurrence_id) GROUP BY ALL),
wide AS (SELECT * FROM ow JOIN hw USING (visit_occurrence_id))"""


MV_SQL = with_model("person", "strata", "visit_occurrence", "condition_occurrence", "clinical_note", "care_site") + f""",
allv AS (SELECT * FROM visit_occurrence WHERE visit_source_value = 'Hosp'),
mn AS (SELECT note_id, visit_occurrence_id,
              regexp_extract(lower(note_text), '{config.SCORE_KEYWORD}[^0-9]{{0,{config.SCORE_WINDOW}}}([0-9]+)', 1) AS v
       FROM clinical_note WHERE visit_occurrence_id IN (SELECT visit_occurrence_id FROM allv)
         AND regexp_matches(lower(note_text), '{config.SCORE_KEYWORD}')),
ks AS (SELECT visit_occurrence_id, max(TRY_CAST(v AS BIGINT)) AS score_value FROM mn WHERE TRY_CAST(v AS BIGINT) IS NOT NULL GROUP BY ALL),
kv AS (SELECT a.*, ks.score_value FROM allv a JOIN ks USING (visit_occurrence_id)),
sel AS ({inpatient_notes_sql("inpatient", "kv")}),
selv AS (SELECT s.*, kv.score_value FROM sel s JOIN kv USING (person_id, visit_occurrence_id))""" \
    + pheno_wide_sql("selv", "kv") + """,
care AS (SELECT DISTINCT substr(location_cd, 5, 3) AS care_site_id, visit_occurrence_id FROM care_site),
mv AS (SELECT s.person_id, s.visit_occurrence_id, s.visit_start_datetime, s.note_id, s.note_text, c.care_site_id,
              s.score_value AS reported_score, w.* EXCLUDE (visit_occurrence_id)
       FROM selv s JOIN wide w USING (visit_occurrence_id) LEFT JOIN care c USING (visit_occurrence_id))"""

ORACLES["mentioned_scores"] = MV_SQL + f"""
SELECT person_id, visit_occurrence_id, visit_start_datetime, note_id, care_site_id, reported_score,
       {", ".join(PHENO_COLS)} FROM mv"""

WEIGHTS_SQL = values(dims.charlson_weight_rows("quan"), ["label_name", "family", "label_value",
                                                         "weight"])

SCORES_SQL = MV_SQL + """,
c5t AS (SELECT m.note_id, m.visit_occurrence_id, st.cse, m.note_text FROM mv m JOIN strata st USING (person_id)),
""" + common.ner_sql("c5t", extra=("visit_occurrence_id", "cse")) + f""",
ml0 AS (SELECT label_name, cse, note_id, max(label_value) AS label_value FROM rb WHERE {common.fixed_ml_keep_sql()} GROUP BY ALL),
ml1 AS ({es.overall("ml0")}),
ml AS (SELECT cse, note_id, 'ml' AS source, label_name, label_value FROM ml1),
cfg AS ({MODEL["comorb_cfg"]}),
ic0 AS (SELECT DISTINCT t.note_id, t.cse, cfg.label_name, substr(vp.status, 1, 1) AS label_value
        FROM c5t t JOIN vp ON vp.visit_occurrence_id = t.visit_occurrence_id JOIN cfg ON cfg.pipe_name = vp.comorb
        WHERE substr(vp.status, 1, 1) <> '0'),
ic1 AS ({es.overall("ic0")}),
ic AS (SELECT cse, note_id, 'icd10' AS source, label_name, label_value FROM ic1),
lab AS (SELECT * FROM ml UNION ALL SELECT * FROM ic),
w AS {WEIGHTS_SQL},
fam AS (SELECT l.cse, l.note_id, l.source, coalesce(w.family, l.label_name) AS family,
               max(w.weight) AS w FROM lab l LEFT JOIN w USING (label_name, label_value) GROUP BY ALL),
sc AS (SELECT cse, note_id, source, CAST(sum(w) AS BIGINT) AS score FROM fam GROUP BY ALL),
men0 AS (SELECT c.cse, c.note_id, 'reported' AS source, m.reported_score AS score
         FROM mv m JOIN c5t c USING (note_id)),
men AS ({es.overall("men0")}),
u AS (SELECT * FROM sc UNION ALL SELECT * FROM men),
wide2 AS (SELECT cse, note_id,
                 coalesce(first(score) FILTER (WHERE source = 'icd10'), 0) AS icd10,
                 coalesce(first(score) FILTER (WHERE source = 'ml'), 0) AS ml,
                 coalesce(first(score) FILTER (WHERE source = 'reported'), 0) AS reported
          FROM u GROUP BY ALL),
deltas AS (SELECT *, -(icd10 - ml) AS claim_vs_nlp, -(reported - ml) AS reported_vs_nlp FROM wide2)"""

ORACLES["charlson_scores"] = SCORES_SQL + "\nSELECT cse, note_id, source, score FROM sc"
ORACLES["charlson_scores_base"] = ORACLES["charlson_scores"].replace(
    WEIGHTS_SQL, values(dims.charlson_weight_rows("base"), ["label_name", "family", "label_value", "weight"]))
ORACLES["score_mentions"] = with_model("clinical_note") + f"""
SELECT DISTINCT note_id, visit_occurrence_id, 'charlson' AS score_name, v AS score_value
FROM (SELECT *, TRY_CAST(regexp_extract(lower(note_text), '{config.SCORE_KEYWORD}[^0-9]{{0,{config.SCORE_WINDOW}}}([0-9]+)', 1) AS BIGINT) AS v
      FROM clinical_note WHERE regexp_matches(lower(note_text), '{config.SCORE_KEYWORD}')) WHERE v IS NOT NULL"""
ORACLES["charlson_deltas"] = SCORES_SQL + "\nSELECT * FROM deltas"
ORACLES["charlson_delta_stats"] = SCORES_SQL + """
SELECT cse, count(*) AS n,
  avg(claim_vs_nlp) AS claim_vs_nlp_mean, stddev_samp(claim_vs_nlp) AS claim_vs_nlp_std,
  quantile_cont(claim_vs_nlp, 0.25) AS claim_vs_nlp_q1, quantile_cont(claim_vs_nlp, 0.5) AS claim_vs_nlp_median,
  quantile_cont(claim_vs_nlp, 0.75) AS claim_vs_nlp_q3,
  avg(reported_vs_nlp) AS reported_vs_nlp_mean, stddev_samp(reported_vs_nlp) AS reported_vs_nlp_std,
  quantile_cont(reported_vs_nlp, 0.25) AS reported_vs_nlp_q1,
  quantile_cont(reported_vs_nlp, 0.5) AS reported_vs_nlp_median,
  quantile_cont(reported_vs_nlp, 0.75) AS reported_vs_nlp_q3,
  avg(reported) AS reported_mean, quantile_cont(reported, 0.5) AS reported_median
FROM deltas GROUP BY cse"""
ORACLES["charlson_delta_histogram"] = SCORES_SQL + """,
hc AS (SELECT cse, claim_vs_nlp AS delta, count(*) AS n FROM deltas GROUP BY ALL),
ht AS (SELECT cse, count(*) AS total FROM deltas GROUP BY ALL)
SELECT hc.cse, hc.delta, hc.n, 100.0 * (CAST(hc.n AS DOUBLE) / CAST(ht.total AS DOUBLE)) AS percent
FROM hc JOIN ht USING (cse)"""
