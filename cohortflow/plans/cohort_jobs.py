"""Registered cohort and phenotype jobs (C1, C2, C3 and their parts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortflow import config
from cohortflow.functions.exprs import recode
from cohortflow.operators import cohort, phenotype
from cohortflow.plans.registry import register, tables
from cohortflow.plans.sqlmodel import inpatient_notes_sql, lit, values, with_model
from cohortflow.sources import dims
from cohortflow.sources import tables as src

COMORBS = phenotype.COMORBS

# ---------------------------------------------------------------------------
# Stratification and split
# ---------------------------------------------------------------------------


@register("cohort_strata", sql=with_model("person", "strata") + """
SELECT person_id, cse, stratum FROM strata""")
def cohort_strata(spark, sf_dir):
    return cohort.stratification(tables(spark, sf_dir))


@register("cohort_test_split", sql=with_model("person", "strata") + """
SELECT person_id, cse, stratum FROM strata WHERE stratum >= 3""")
def cohort_test_split(spark, sf_dir):
    return cohort.split(cohort.stratification(tables(spark, sf_dir)), "test")


@register("cohort_train_split", sql=with_model("person", "strata") + f"""
SELECT person_id, cse, stratum, 'train' AS part FROM strata WHERE stratum < {config.TEST_THRESHOLD}
UNION ALL SELECT person_id, cse, stratum, 'second' FROM strata WHERE stratum = 1
UNION ALL SELECT person_id, cse, stratum, 'all' FROM strata""")
def cohort_train_split(spark, sf_dir):
    """The training cohort, one stratum of it, and everyone."""
    s = cohort.stratification(tables(spark, sf_dir))
    parts = [cohort.split(s, "train").withColumn("part", F.lit("train")), cohort.split(s, "train", 1).withColumn("part", F.lit("second")),
             cohort.split(s, "all").withColumn("part", F.lit("all"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("sampled_persons", sql=with_model("person") + f"""
SELECT person_id FROM person WHERE (('0x' || substr(md5('{config.SEED}|persons|' || CAST(person_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0)
  < least(1.0, CAST(300 AS DOUBLE) / (SELECT count(*) FROM person))""")
def sampled_persons(spark, sf_dir):
    """About 300 persons (the cap is the operator)."""
    ids = cohort.persons(tables(spark, sf_dir)).select("person_id")
    return cohort.sample_persons(ids, 300, ids.count())


@register("cohort_test_visits", sql=with_model("person", "strata", "visit_occurrence") + """
SELECT v.person_id, v.visit_occurrence_id, v.visit_start_datetime, v.visit_source_value
FROM visit_occurrence v
WHERE v.visit_source_value = 'Hosp'
  AND v.person_id IN (SELECT person_id FROM strata WHERE stratum >= 3)""")
def cohort_test_visits(spark, sf_dir):
    """Model table restricted to the test cohort (left-semi)."""
    t = tables(spark, sf_dir)
    ids = cohort.split(cohort.stratification(t), "test")
    return cohort.visits(t, "inpatient", ids=ids).select(
        "person_id", "visit_occurrence_id", "visit_start_datetime", "visit_source_value")


# ---------------------------------------------------------------------------
# Note selection
# ---------------------------------------------------------------------------


@register("coded_inpatient_visits", sql=with_model("visit_occurrence", "condition_occurrence") + """
SELECT person_id, visit_occurrence_id, visit_start_datetime, visit_end_datetime, visit_source_value
FROM visit_occurrence
WHERE visit_source_value = 'Hosp'
  AND visit_occurrence_id IN (SELECT visit_occurrence_id FROM condition_occurrence)""")
def coded_inpatient_visits(spark, sf_dir):
    t = tables(spark, sf_dir)
    return cohort.coded_visits(cohort.visits(t, "inpatient"), cohort.conditions(t))


def _notes_sql(pt):
    return with_model("visit_occurrence", "condition_occurrence", "clinical_note") + f""",
sel AS ({inpatient_notes_sql(pt)})
SELECT note_id, visit_occurrence_id, person_id, note_class_source_value, note_datetime,
       visit_start_datetime, length(note_text) AS n_chars
FROM sel"""


def _notes_job(pt):
    def job(spark, sf_dir):
        n, _ = cohort.select_notes(tables(spark, sf_dir), pt)
        return n.select("note_id", "visit_occurrence_id", "person_id", "note_class_source_value",
                        "note_datetime", "visit_start_datetime", F.length("note_text").alias("n_chars"))
    return job


register("last_notes_inpatient", sql=_notes_sql("inpatient"))(_notes_job("inpatient"))
register("last_notes_outpatient", sql=_notes_sql("outpatient"))(_notes_job("outpatient"))


@register("note_sample", sql=with_model("visit_occurrence", "condition_occurrence", "clinical_note") + f""",
sel AS ({inpatient_notes_sql("inpatient")})
SELECT note_id, visit_occurrence_id, person_id
FROM sel
ORDER BY ('0x' || substr(md5('{config.SEED}|' || CAST(note_id AS VARCHAR)), 1, 15))::BIGINT, note_id
LIMIT 50""")
def note_sample(spark, sf_dir):
    """Seeded sample of 50 selected notes (the limit is the operator)."""
    n, _ = cohort.select_notes(tables(spark, sf_dir), "inpatient", n_notes=50)
    return n.select("note_id", "visit_occurrence_id", "person_id")


# ---------------------------------------------------------------------------
# Claim phenotypes
# ---------------------------------------------------------------------------

CODES_SQL = values(dims.code_rows(), ["code", "libelle", "status", "comorb", "hierarchie"])

EXACT_MAP_SQL = f"""SELECT code, comorb, min(status) AS status FROM {CODES_SQL} c
  WHERE code IS NOT NULL GROUP BY code, comorb"""

REGEX_MAP_SQL = f"""SELECT d.code, p.comorb, min(p.status) AS status
  FROM (SELECT DISTINCT condition_source_value AS code FROM condition_occurrence) d
  JOIN (SELECT * FROM {CODES_SQL} c WHERE hierarchie = 'Principal') p
    ON contains(d.code, p.code)
  GROUP BY d.code, p.comorb"""


def _visit_pheno_sql(cmap):
    return f"""SELECT c.visit_occurrence_id, m.comorb, max(m.status) AS status
  FROM condition_occurrence c JOIN ({cmap}) m ON c.condition_source_value = m.code
  GROUP BY c.visit_occurrence_id, m.comorb"""


@register("visit_phenotype_exact", sql=with_model("condition_occurrence") + "\n"
          + _visit_pheno_sql(EXACT_MAP_SQL))
def visit_phenotype_exact(spark, sf_dir):
    t = tables(spark, sf_dir)
    return phenotype.visit_phenotypes(cohort.conditions(t), dims.icd10_codes(spark), via_regex=False)


@register("visit_phenotype_regex", sql=with_model("condition_occurrence") + "\n"
          + _visit_pheno_sql(REGEX_MAP_SQL))
def visit_phenotype_regex(spark, sf_dir):
    t = tables(spark, sf_dir)
    return phenotype.visit_phenotypes(cohort.conditions(t), dims.icd10_codes(spark), via_regex=True)


HISTORY_SQL = f""",
sel AS ({inpatient_notes_sql("inpatient")}),
vp AS ({_visit_pheno_sql(REGEX_MAP_SQL)}),
allv AS (SELECT * FROM visit_occurrence WHERE visit_source_value = 'Hosp')
SELECT s.visit_occurrence_id, vp.comorb, max(vp.status) AS status
FROM sel s
JOIN allv a ON a.person_id = s.person_id AND s.visit_start_datetime >= a.visit_start_datetime
JOIN vp ON vp.visit_occurrence_id = a.visit_occurrence_id
GROUP BY s.visit_occurrence_id, vp.comorb"""


def _history(spark, sf_dir, method):
    t = tables(spark, sf_dir)
    _, vis = cohort.select_notes(t, "inpatient")
    cond = cohort.conditions(t)
    codes = dims.icd10_codes(spark)
    vsev = phenotype.visit_severity(cond, codes, via_regex=True)
    allv = cohort.visits(t, "inpatient")
    return phenotype.with_labels(phenotype.history_phenotypes(vis, allv, vsev, method=method), codes)


@register("history_phenotype", sql=with_model("visit_occurrence", "condition_occurrence", "clinical_note")
          + HISTORY_SQL)
def history_phenotype(spark, sf_dir):
    """A2 (range self-join semantics) via first-reached severities."""
    return _history(spark, sf_dir, "first_reached")


@register("history_phenotype_window", sql=with_model("visit_occurrence", "condition_occurrence", "clinical_note")
          + HISTORY_SQL)
def history_phenotype_window(spark, sf_dir):
    """A2 via the cumulative RANGE window."""
    return _history(spark, sf_dir, "window")


def _wide_sql():
    own = ", ".join(f"coalesce(max(CASE WHEN o.comorb = '{c}' THEN o.status END), '{config.ABSENCE}') AS cim10_{c}"
                    for c in COMORBS)
    hist = ", ".join(f"coalesce(max(CASE WHEN h.comorb = '{c}' THEN h.status END), '{config.ABSENCE}') "
                     f"AS all_cim10_{c}" for c in COMORBS)
    return (with_model("visit_occurrence", "condition_occurrence", "clinical_note") + HISTORY_SQL.replace(
        "SELECT s.visit_occurrence_id, vp.comorb, max(vp.status) AS status",
        ", hist AS (SELECT s.visit_occurrence_id, vp.comorb, max(vp.status) AS status", 1)
        + f"""),
own AS (SELECT s.visit_occurrence_id, vp.comorb, vp.status FROM sel s JOIN vp USING (visit_occurrence_id)),
ow AS (SELECT s.visit_occurrence_id, {own} FROM sel s LEFT JOIN own o USING (visit_occurrence_id)
       GROUP BY s.visit_occurrence_id),
hw AS (SELECT s.visit_occurrence_id, {hist} FROM sel s LEFT JOIN hist h USING (visit_occurrence_id)
       GROUP BY s.visit_occurrence_id)
SELECT s.person_id, s.visit_occurrence_id, s.visit_start_datetime, s.note_id,
       {", ".join(f"ow.cim10_{c}" for c in COMORBS)},
       {", ".join(f"hw.all_cim10_{c}" for c in COMORBS)}
FROM sel s JOIN ow USING (visit_occurrence_id) JOIN hw USING (visit_occurrence_id)""")


@register("claim_phenotypes", sql=_wide_sql())
def claim_phenotypes(spark, sf_dir):
    """Flagship: last note of each coded inpatient stay with its claim
    phenotype for the stay (``cim10_*``) and the patient history
    (``all_cim10_*``)."""
    t = tables(spark, sf_dir)
    notes, vis = cohort.select_notes(t, "inpatient")
    wide = phenotype.claim_phenotypes(vis, cohort.visits(t, "inpatient"), cohort.conditions(t),
                                      dims.icd10_codes(spark), via_regex=True)
    return wide.join(notes.select("visit_occurrence_id", "note_id"), "visit_occurrence_id").select(
        "person_id", "visit_occurrence_id", "visit_start_datetime", "note_id",
        *[f"cim10_{c}" for c in COMORBS], *[f"all_cim10_{c}" for c in COMORBS])


# ---------------------------------------------------------------------------
# Care sites
# ---------------------------------------------------------------------------

TRIGRAMS_SQL = values(sorted(config.CARE_SITE_TRIGRAMS.items()), ["code", "trigram"])


@register("care_sites", sql=with_model("care_site") + f"""
SELECT d.care_site_id, d.visit_occurrence_id, t.trigram
FROM (SELECT DISTINCT substr(location_cd, 5, 3) AS care_site_id, visit_occurrence_id FROM care_site) d
LEFT JOIN {TRIGRAMS_SQL} t ON t.code = d.care_site_id""")
def care_sites(spark, sf_dir):
    t = tables(spark, sf_dir)
    cs = src.care_site(t).select(F.substring("location_cd", 5, 3).alias("care_site_id"),
                                 "visit_occurrence_id").distinct()
    m = F.create_map(*[F.lit(x) for kv in sorted(config.CARE_SITE_TRIGRAMS.items()) for x in kv])
    return cs.select("care_site_id", "visit_occurrence_id", m[F.col("care_site_id")].alias("trigram"))


__all__ = ["recode", "lit"]
