"""Registered text jobs: entity extraction, qualification, sentences (X1-X4,
X11, P16-P19)."""

from __future__ import annotations

from cohortflow.functions import spans
from cohortflow.operators import cohort, entities
from cohortflow.plans import common
from cohortflow.plans.registry import ORACLES, register, tables
from cohortflow.plans.sqlmodel import with_model

EVAL_PREFIX = with_model("person", "strata", "visit_occurrence", "condition_occurrence", "clinical_note") + ",\n" \
    + common.TEXTS_SQL + ",\n" + common.ner_sql("texts")

NER_OUT = ["note_id", "visit_occurrence_id", "label_name", "label_value", "status", "offset_begin",
           "offset_end", "lexical_variant", "negation", "hypothesis", "family"]


@register("entities_all_notes", sql=with_model("clinical_note") + ",\n" + common.ner_sql("clinical_note", extra=("visit_occurrence_id",))
          + f"\nSELECT {', '.join(NER_OUT)} FROM ner")
def entities_all_notes(spark, sf_dir):
    """X1-X3 over every note of the warehouse (whole texts)."""
    t = tables(spark, sf_dir)
    return entities.extract_entities(cohort.notes(t)).select(*NER_OUT)


@register("eval_entities_rule_based", sql=EVAL_PREFIX + """
SELECT note_id, visit_occurrence_id, cse, patient_type, label_name, label_value, status,
       offset_begin, offset_end, lexical_variant, negation, hypothesis, family, to_keep FROM rb""")
def eval_entities_rule_based(spark, sf_dir):
    """X4 (rule-based qualifiers): entity table of the evaluation corpus."""
    t = tables(spark, sf_dir)
    return common.rule_entities(t).select(
        "note_id", "visit_occurrence_id", "cse", "patient_type", "label_name", "label_value", "status",
        "offset_begin", "offset_end", "lexical_variant", "negation", "hypothesis", "family", "to_keep")


@register("gold_entities", sql=EVAL_PREFIX + ",\ngold AS (" + common.method_sql("gold") + ")\nSELECT * FROM gold")
def gold_entities(spark, sf_dir):
    t = tables(spark, sf_dir)
    return common.method_entities(t, "gold")


SENT_SQL = r"""
SELECT note_id, CAST(i - 1 AS INTEGER) AS sent_idx,
       CAST(sum(length(s)) OVER w - length(s) AS INTEGER) AS sent_begin,
       CAST(sum(length(s)) OVER w AS INTEGER) AS sent_end
FROM (SELECT note_id, unnest(l) AS s, generate_subscripts(l, 1) AS i
      FROM (SELECT note_id, regexp_extract_all(note_text, '[^.!?\n]*[.!?\n]+|[^.!?\n]+\z') AS l FROM texts))
WINDOW w AS (PARTITION BY note_id ORDER BY i)"""


@register("sentences_all_notes")
@register("sentences")
def sentences(spark, sf_dir):
    """X11: sentence table of every note (pieces tile each text)."""
    t = tables(spark, sf_dir)
    return entities.sentences(common.all_texts(t)).select("note_id", "sent_idx", "sent_begin", "sent_end")


ORACLES["sentences"] = ORACLES["sentences_all_notes"] = with_model("clinical_note") + ",\n" + common.ALL_TEXTS_SQL + SENT_SQL

#: X2 for the jobs below: lower case, accents folded, license lines and addresses blanked.
NORMAL = spans.Normaliser(lower=True, accents=True, pollution=(r"(?m)^(?:Copyright|SPDX)[^\n]*$", r"https?://[^ \n]+"))
NORMAL_PATTERNS = {"folded_word": [r"\b(?:eau|ete|cion)[a-z]*\b"], "address": [r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"]}


@register("normalised_entities")
def normalised_entities(spark, sf_dir):
    """X1 + X2 over every note: the lexicon matched on the normalised text (accents folded, pollution
    blanked); offsets and wording are the original's."""
    t = tables(spark, sf_dir)
    e = entities.extract_entities(cohort.notes(t), normaliser=NORMAL, qualify=False)
    return e.select("note_id", "label_name", "label_value", "offset_begin", "offset_end", "lexical_variant")


@register("normalised_regex_matches")
def normalised_regex_matches(spark, sf_dir):
    """X19 + X2 over every note: labelled patterns matched on the normalised text in one pass."""
    return entities.regex_matches(cohort.notes(tables(spark, sf_dir)), NORMAL_PATTERNS, normaliser=NORMAL)


# The texts hold composed letters only, whose folding keeps the length: SQL needs no alignment there.
_MASKED = """masked AS (SELECT note_id, visit_occurrence_id, note_text AS original,
    lower(strip_accents(array_to_string(list_transform(regexp_extract_all(note_text,
      '(?m:^(?:Copyright|SPDX)[^\\n]*$)|https?://[^ \\n]+|[\\s\\S]'),
      lambda x: CASE WHEN length(x) > 1 THEN repeat(' ', length(x)) ELSE x END), ''))) AS note_text
  FROM clinical_note)"""


def _normalised_regex_sql():
    parts = []
    for label, pats in NORMAL_PATTERNS.items():
        pat = "|".join(f"(?:{p})" for p in pats)
        parts.append(f"""SELECT note_id, '{label}' AS label, mt, original,
       CAST(sum(length(pc)) OVER w + sum(coalesce(length(mt), 0)) OVER w - coalesce(length(mt), 0) AS INTEGER) AS b
  FROM (SELECT note_id, original, unnest(pcs) AS pc, unnest(mts) AS mt, generate_subscripts(pcs, 1) AS i
        FROM (SELECT note_id, original, string_split_regex(note_text, '{pat}') AS pcs,
                     regexp_extract_all(note_text, '{pat}') AS mts FROM masked))
  WINDOW w AS (PARTITION BY note_id ORDER BY i)""")
    return with_model("clinical_note") + ",\n" + _MASKED + ",\nrm AS (" + "\nUNION ALL\n".join(f"SELECT * FROM ({x}) WHERE mt IS NOT NULL" for x in parts) + """)
SELECT note_id, label, b AS offset_begin, CAST(b + length(mt) AS INTEGER) AS offset_end,
       substr(original, b + 1, length(mt)) AS lexical_variant FROM rm"""


ORACLES["normalised_regex_matches"] = _normalised_regex_sql()
ORACLES["normalised_entities"] = with_model("clinical_note") + ",\n" + _MASKED + ",\n" \
    + common.ner_sql("masked", extra=("original",), fold=True) + """
SELECT note_id, label_name, label_value, offset_begin, offset_end,
       substr(original, offset_begin + 1, offset_end - offset_begin) AS lexical_variant FROM ner"""
