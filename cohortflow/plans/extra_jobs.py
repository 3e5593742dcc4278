"""Registered jobs: validation-set extraction and enrichment (X15, X16, J6-J9,
P22, P23, T3, U2), entity lists per note (A32), labelled regex matcher (X19)
and method comparison (A29)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortflow import config
from cohortflow.operators import cohort, entities, labels, metrics, phenotype
from cohortflow.plans import common
from cohortflow.plans.eval_jobs import G4, Eval
from cohortflow.plans.registry import ORACLES, register, tables
from cohortflow.plans.sqlmodel import with_model
from cohortflow.session import settled
from cohortflow.sources import dims
from cohortflow.sources.tables import note_texts


def validation_notes(t, patient_type="inpatient", sample: int | None = None):
    """X15 (T3, P4, P5): notes of the test cohort of one class, long enough;
    a seeded sample of them only if ``sample`` says how many."""
    ids = cohort.split(cohort.stratification(t), "test")
    note_class = config.PATIENT_TYPES[patient_type][1]
    n = cohort.notes(t, ids).filter((F.col("note_class_source_value") == note_class) & (F.col("note_length") > 500))
    return n if sample is None else cohort.sample_top(n, sample)


@register("validation_entities")
def validation_entities(spark, sf_dir):
    """Qualified entities of the validation notes (test cohort)."""
    t = tables(spark, sf_dir)
    e = entities.extract_entities(validation_notes(t))
    return e.withColumn("to_keep", entities.to_keep("rule_based")).select(
        "note_id", "visit_occurrence_id", "label_name", "label_value", "offset_begin", "offset_end", "to_keep")


@register("validation_sample")
def validation_sample(spark, sf_dir):
    """A seeded sample of 20 validation notes (the limit is the operator)."""
    return validation_notes(tables(spark, sf_dir), sample=20).select("note_id", "visit_occurrence_id", "person_id")


#: Comorbidities too rare to be annotated, whose claim value is kept.
CLAIM_KEPT = [c for c in phenotype.COMORBS if c.startswith(("AIDS", "hemi"))]


@register("validation_visits")
def validation_visits(spark, sf_dir):
    """X16 (J6, J7, J9, P23, U2; J8 and P22 are ``enriched_annotation_notes``): visits of the annotated notes with
    their claim phenotypes; visits without a phenotype are appended with
    ``0:Absence``; only the rare labels keep their claim value."""
    t = tables(spark, sf_dir)
    ids = Eval(spark, sf_dir).rule.filter(F.col("patient_type") == "inpatient").select("note_id", "patient_type").distinct()
    test_ids = cohort.split(cohort.stratification(t), "test")
    allv = cohort.visits(t, "inpatient", ids=test_ids)
    notes = cohort.notes(t, test_ids).drop("note_text").join(ids, "note_id")                       # J6
    notes = notes.join(allv.select("person_id", "visit_occurrence_id", "visit_start_datetime"),
                       ["person_id", "visit_occurrence_id"], "left")
    notes = settled(notes)  # ids and dates of the annotated notes: read below three times
    cond = cohort.conditions(t).join(notes.select("visit_occurrence_id"), "visit_occurrence_id", "left_semi")  # J7
    _, sel_visits = cohort.select_notes(t, "inpatient", ids=test_ids,
                                        visits_df=cohort.coded_visits(allv, cond))
    wide = phenotype.claim_phenotypes(sel_visits, allv, cond, dims.icd10_codes(spark), via_regex=True)
    blank = {f"{level}_{c}": F.lit(config.ABSENCE) for level in ("cim10", "all_cim10")
             for c in phenotype.COMORBS if c not in CLAIM_KEPT}
    wide = wide.withColumns(blank)                                                            # P23
    missing = (notes.select("visit_occurrence_id", "person_id", "visit_start_datetime")
               .join(wide.select("visit_occurrence_id"), "visit_occurrence_id", "left_anti"))  # J9
    return wide.unionByName(missing, allowMissingColumns=True).na.fill(
        config.ABSENCE, [f"{level}_{c}" for level in ("cim10", "all_cim10") for c in phenotype.COMORBS])  # U2


@register("gold_entity_lists")
def gold_entity_lists(spark, sf_dir):
    """Per note, its gold entities as one ordered list (begin:end:label)."""
    t = tables(spark, sf_dir)
    g = common.method_entities(t, "gold")
    item = F.concat_ws(":", F.lpad(F.col("offset_begin").cast("string"), 8, "0"),
                       F.lpad(F.col("offset_end").cast("string"), 8, "0"), F.col("label_name"))
    return g.groupBy("note_id").agg(F.array_join(F.array_sort(F.collect_list(item)), "|").alias("ents"),
                                    F.count(F.lit(1)).alias("n"))


REGEX_PATTERNS = {
    "ip_address": [r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"],
    "phone": [r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}"],
}


@register("regex_matches")
def regex_matches(spark, sf_dir):
    """Labelled regex matcher over every note, with offsets."""
    t = tables(spark, sf_dir)
    return entities.regex_matches(cohort.notes(t), REGEX_PATTERNS)


@register("compare_methods")
def compare_methods(spark, sf_dir):
    """Overall inpatient note-level metrics of several methods side by
    side (aggregated labels collapsed, averages labelled by kind)."""
    e = Eval(spark, sf_dir)
    parts = []
    for m in ("rule_based", "no_qual"):
        nm = metrics.note_metrics(e.note_labels(m), e.note_labels("gold"), m, e.denominators(), G4)
        parts.append(nm.withColumn("method", F.lit(m)))
    df = parts[0].unionByName(parts[1])
    df = df.filter((F.col("cse") == labels.OVERALL) & (F.col("patient_type") == "inpatient"))
    df = labels.remove_aggregated_label(df)
    df = df.withColumn("label_name", F.when(F.col("label_name") == labels.TOTAL, F.col("label_value"))
                       .otherwise(F.col("label_name")))
    long = df.select("label_name", "method", *[F.col(c).cast("double") for c in
                                               ("PPV", "Sensitivity", "Specificity", "F1")]) \
        .unpivot(["label_name", "method"], ["PPV", "Sensitivity", "Specificity", "F1"], "metric", "value")
    return long.groupBy("label_name", "metric").pivot("method", ["rule_based", "no_qual"]).agg(F.first("value"))


# ---------------------------------------------------------------------------
# SQL twins
# ---------------------------------------------------------------------------

_VAL = with_model("person", "strata", "clinical_note") + f""",
vn AS (SELECT n.* FROM clinical_note n
       WHERE n.person_id IN (SELECT person_id FROM strata WHERE stratum >= 3)
         AND n.note_class_source_value = 'CR:CRH-HOSPI' AND n.note_text IS NOT NULL AND length(n.note_text) > 500),
""" + common.ner_sql("vn", extra=("visit_occurrence_id",))

ORACLES["validation_entities"] = _VAL + """
SELECT note_id, visit_occurrence_id, label_name, label_value, offset_begin, offset_end, to_keep FROM rb"""

ORACLES["validation_sample"] = _VAL.split(",\ntk AS (")[0] + f"""
SELECT note_id, visit_occurrence_id, person_id FROM vn
ORDER BY ('0x' || substr(md5('{config.SEED}|' || CAST(note_id AS VARCHAR)), 1, 15))::BIGINT, note_id LIMIT 20"""

ORACLES["gold_entity_lists"] = with_model("person", "strata", "visit_occurrence", "condition_occurrence",
                                          "clinical_note") + ",\n" + common.TEXTS_SQL + ",\n" + common.ner_sql("texts") \
    + f""",
gold AS ({common.method_sql("gold")})
SELECT note_id,
       string_agg(lpad(CAST(offset_begin AS VARCHAR), 8, '0') || ':' || lpad(CAST(offset_end AS VARCHAR), 8, '0')
                  || ':' || label_name, '|' ORDER BY lpad(CAST(offset_begin AS VARCHAR), 8, '0') || ':'
                  || lpad(CAST(offset_end AS VARCHAR), 8, '0') || ':' || label_name) AS ents,
       count(*) AS n
FROM gold GROUP BY note_id"""


def _regex_sql():
    parts = []
    for label, pats in REGEX_PATTERNS.items():
        pat = "|".join(f"(?:{p})" for p in pats).replace("'", "''")
        parts.append(f"""SELECT note_id, '{label}' AS label,
       CAST(sum(length(pc)) OVER w - length(pc) + sum(coalesce(length(mt), 0)) OVER w - coalesce(length(mt), 0)
            + length(pc) AS INTEGER) AS offset_begin, mt AS lexical_variant
  FROM (SELECT note_id, unnest(pcs) AS pc, unnest(mts) AS mt, generate_subscripts(pcs, 1) AS i
        FROM (SELECT note_id, string_split_regex(note_text, '{pat}') AS pcs,
                     regexp_extract_all(note_text, '{pat}') AS mts FROM clinical_note))
  WINDOW w AS (PARTITION BY note_id ORDER BY i)""")
    body = "\nUNION ALL\n".join(f"SELECT * FROM ({p}) WHERE lexical_variant IS NOT NULL" for p in parts)
    return with_model("clinical_note") + f""",
rm AS ({body})
SELECT note_id, label, offset_begin, CAST(offset_begin + length(lexical_variant) AS INTEGER) AS offset_end,
       lexical_variant FROM rm"""


ORACLES["regex_matches"] = _regex_sql()


def _compare_sql():
    from cohortflow.plans.eval_jobs import EVAL_PREFIX, _nl_sql, _note_metrics_sql
    from cohortflow.plans import eval_sql as es
    sql = EVAL_PREFIX + _nl_sql("gold") + _nl_sql("rule_based") + _nl_sql("no_qual")
    for m in ("rule_based", "no_qual"):
        sql += _note_metrics_sql(f"nl_{m}", m, G4, p=f"{m}_", final_select=False)
    sql += f""",
cmp_both AS (SELECT *, 'rule_based' AS method FROM rule_based_fin UNION ALL SELECT *, 'no_qual' AS method FROM no_qual_fin),
ov AS (SELECT * FROM cmp_both WHERE cse = 'Overall' AND patient_type = 'inpatient'),
ov2 AS ({es.removed_aggregated("ov")}),
ov3 AS (SELECT CASE WHEN label_name = 'Total' THEN label_value ELSE label_name END AS label_name, method,
               CAST(PPV AS DOUBLE) AS PPV, CAST(Sensitivity AS DOUBLE) AS Sensitivity,
               CAST(Specificity AS DOUBLE) AS Specificity, CAST(F1 AS DOUBLE) AS F1 FROM ov2),
lg AS (SELECT * FROM ov3 UNPIVOT INCLUDE NULLS (value FOR metric IN (PPV, Sensitivity, Specificity, F1)))
SELECT label_name, metric, first(value) FILTER (WHERE method = 'rule_based') AS rule_based,
       first(value) FILTER (WHERE method = 'no_qual') AS no_qual
FROM lg GROUP BY label_name, metric"""
    return sql


ORACLES["compare_methods"] = _compare_sql()


@register("gold_token_aligned_all_notes")
@register("gold_token_aligned")
def gold_token_aligned(spark, sf_dir):
    """Gold spans of every note (inside it) expanded to token boundaries."""
    t = tables(spark, sf_dir)
    from cohortflow.operators import context
    once, again = common.once_and_again(t, settled(common.note_visits(t)))
    g = common.gold_beside_texts(note_texts(t), context.TOKEN_FIELDS, context.grown_to_tokens)
    out = g.join(once.select("note_id"), "note_id") \
        .select("note_id", "label_name", "offset_begin", "offset_end", "token_begin", "token_end")
    if again is None:
        return out
    t = common.with_documents_of(t, again)
    g = common.perturb_gold(common.rule_entities_of(t, again))
    lengths = note_texts(t).select("note_id", F.length("note_text").alias("_n")).join(again, "note_id")
    g = g.join(lengths.select("note_id", "_n"), "note_id") \
        .filter(F.col("offset_end") <= F.col("_n")).drop("_n")
    return out.unionByName(context.expand_to_tokens(g.select("note_id", "label_name", "offset_begin", "offset_end"),
                                                    cohort.with_texts(t, again)))


def gold_raw(t):
    """The gold annotation layout of the study: one row per annotated entity
    (label, value as a status label, three qualifier flags) plus placeholder
    rows (null label) for annotated notes without entities."""
    from cohortflow.functions.exprs import md5_unit
    tx = common.texts(t)
    g = common.method_entities(t, "gold", base=common.rule_entities(t, tx))
    u = md5_unit(F.lit("qual"), "note_id", "offset_begin")
    st = entities.status_label(F.col("label_name"), F.col("label_value"))
    ents = g.select("note_id", "visit_occurrence_id", "cse", "patient_type", "offset_begin", "offset_end",
                    F.col("label_name").alias("gold_label_name"),
                    F.when(md5_unit(F.lit("zero"), "note_id", "offset_begin") < 0.05, F.lit("False"))
                    .otherwise(st).alias("gold_label_value"),
                    (~F.col("to_keep") & (u < 0.5)).alias("gold_negation_value"),
                    (~F.col("to_keep") & (u >= 0.5)).alias("gold_hypothesis_value"),
                    F.lit(False).alias("gold_family_value"))
    empty = tx.select("note_id", "visit_occurrence_id", "cse", "patient_type").join(
        g.select("note_id"), "note_id", "left_anti")
    return ents.unionByName(empty, allowMissingColumns=True)


@register("gold_clean")
def gold_clean(spark, sf_dir):
    """Placeholder rows dropped, value normalised, value "0" dropped,
    qualifier flags merged into ``to_keep``."""
    t = tables(spark, sf_dir)
    return labels.clean_gold(gold_raw(t)).select(
        "note_id", "cse", "patient_type", "label_name", "label_value", "offset_begin", "offset_end", "to_keep")


_G_PREFIX = with_model("person", "strata", "visit_occurrence", "condition_occurrence", "clinical_note") + ",\n" \
    + common.TEXTS_SQL + ",\n" + common.ner_sql("texts") + f""",
gold AS ({common.method_sql("gold")})"""

ORACLES["gold_token_aligned"] = _G_PREFIX + r""",
gx AS (SELECT g.note_id, g.label_name, g.offset_begin, g.offset_end, t.note_text FROM gold g JOIN texts t USING (note_id)
       WHERE g.offset_end <= length(t.note_text)),
gy AS (SELECT *, substr(note_text, offset_begin + 1, 1) AS at_b, substr(note_text, offset_end, 1) AS lst,
              reverse(substr(note_text, 1, offset_begin)) AS rev, substr(note_text, offset_end + 1) AS rest FROM gx)
SELECT note_id, label_name, offset_begin, offset_end,
       offset_begin - CASE WHEN regexp_matches(at_b, '^\p{L}$') THEN length(regexp_extract(rev, '^\p{L}+'))
                           WHEN regexp_matches(at_b, '^\p{N}$') THEN length(regexp_extract(rev, '^\p{N}+'))
                           ELSE 0 END AS token_begin,
       offset_end + CASE WHEN regexp_matches(lst, '^\p{L}$') THEN length(regexp_extract(rest, '^\p{L}+'))
                         WHEN regexp_matches(lst, '^\p{N}$') THEN length(regexp_extract(rest, '^\p{N}+'))
                         ELSE 0 END AS token_end
FROM gy"""


def _gold_clean_sql():
    from cohortflow.plans.common import status_rows
    from cohortflow.plans.sqlmodel import values
    st = values(status_rows(), ["label_name", "k", "status_label"])
    u = lambda tag: (f"(('0x' || substr(md5('{tag}|' || CAST(note_id AS VARCHAR) || '|' || "  # noqa: E731
                     f"CAST(offset_begin AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0)")
    return _G_PREFIX + f""",
gs AS (SELECT g.*, coalesce(s1.status_label, s2.status_label) AS stl FROM gold g
       LEFT JOIN {st} s1 ON s1.label_name = g.label_name AND s1.k = g.label_value
       LEFT JOIN {st} s2 ON s2.label_name = g.label_name AND s2.k = '1'),
raw AS (SELECT note_id, cse, patient_type, offset_begin, offset_end, label_name AS gold_label_name,
               CASE WHEN {u("zero")} < 0.05 THEN 'False' ELSE stl END AS gold_label_value,
               (NOT to_keep AND {u("qual")} < 0.5) AS neg, (NOT to_keep AND {u("qual")} >= 0.5) AS hyp, FALSE AS fam
        FROM gs),
norm AS (SELECT *, CASE WHEN lower(gold_label_value) = 'true' THEN '1' WHEN lower(gold_label_value) = 'false' THEN '0'
                        ELSE substr(gold_label_value, 1, 1) END AS label_value FROM raw)
SELECT note_id, cse, patient_type, gold_label_name AS label_name, label_value, offset_begin, offset_end,
       NOT (neg OR fam OR hyp) AS to_keep
FROM norm WHERE gold_label_name IS NOT NULL AND label_value <> '0'"""


ORACLES["gold_clean"] = _gold_clean_sql()

ORACLES["gold_token_aligned"] = ORACLES["gold_token_aligned_all_notes"] = common.over_all_notes(ORACLES["gold_token_aligned"])
