"""Registered snippet / annotation jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortflow import config
from cohortflow.operators import cohort, entities, snippets
from cohortflow.plans import common
from cohortflow.plans.registry import ORACLES, register, tables
from cohortflow.plans.sqlmodel import lit, with_model
from cohortflow.session import settled
from cohortflow.sources.tables import note_texts

SNIPPET_LENGTH = 100
MAX_NOTES = 50

EVAL_PREFIX = with_model("person", "strata", "visit_occurrence", "condition_occurrence", "clinical_note") + ",\n" \
    + common.TEXTS_SQL + ",\n" + common.ner_sql("texts")


def _rule(spark, sf_dir):
    """The corpus' texts and their entities, extracted once (the snippets need them several times)."""
    t = tables(spark, sf_dir)
    tx = common.texts(t)
    return tx, settled(common.rule_entities(t, tx))


def _all_snippets(spark, sf_dir, *more):
    """X13 over every note: the entities are found once, each with its window of the text, where the documents are read."""
    t = tables(spark, sf_dir)
    once, again = common.once_and_again(t, settled(common.note_visits(t)))
    cols = ["label_name", "note_id", "offset_begin", "offset_end", *more]
    e = entities.extract_entities(note_texts(t), keep=(), context=("character", SNIPPET_LENGTH / 2))
    e = settled(e.select(*cols, "context_begin", "context").join(once.select("note_id"), "note_id"))
    out, text = snippets.concat_snippets(e, None, SNIPPET_LENGTH)
    if again is not None:
        t = common.with_documents_of(t, again)
        e = settled(common.rule_entities_of(t, again).select(*cols))
        more_out, more_text = snippets.concat_snippets(e, cohort.with_texts(t, again), SNIPPET_LENGTH)
        out, text = out.unionByName(more_out), text.unionByName(more_text)
    return out, text


@register("snippet_entities_all_notes")
@register("snippet_entities")
def snippet_entities(spark, sf_dir):
    """Entities of every note re-based into the concatenated snippets of their
    (label, note), with the re-cut variant (P27 check column)."""
    out, _ = _all_snippets(spark, sf_dir, "lexical_variant")
    return out.select("label_name", "note_id", "offset_begin", "offset_end", "snippet_num",
                      "new_offset_begin", "new_offset_end",
                      (F.col("new_lexical_variant") == F.col("lexical_variant")).alias("variant_ok"))


@register("snippet_texts_all_notes")
@register("snippet_texts")
def snippet_texts(spark, sf_dir):
    """One concatenated snippet text per (label, note), over every note."""
    _, text = _all_snippets(spark, sf_dir)
    return text.select("label_name", "note_id", "n_snippets", "snippet_note_text")


@register("annotation_notes")
def annotation_notes(spark, sf_dir):
    """Per label at most 50 sampled inpatient notes turned into
    annotation documents (new id, title, concatenated snippets)."""
    tx, e = _rule(spark, sf_dir)
    e = e.filter(F.col("patient_type") == "inpatient").select("label_name", "note_id", "offset_begin", "offset_end")
    _, notes = snippets.annotation_set(e, tx, SNIPPET_LENGTH, MAX_NOTES, "inpatient")
    return notes.select("note_id", "old_note_id", "label_name", "title", "note_text")


@register("annotation_ids")
def annotation_ids(spark, sf_dir):
    """The composite ids of the annotation set, built and parsed back."""
    return snippets.note_id_parts(annotation_notes(spark, sf_dir)).select(
        "note_id", "parsed_label", "parsed_patient_type", "parsed_note_id")


@register("snippet_variant_mismatches")
def snippet_variant_mismatches(spark, sf_dir):
    """Snippets checked and counted by label: re-cut entities, and those whose wording differs (none may)."""
    out, _ = _all_snippets(spark, sf_dir, "lexical_variant")
    bad = snippets.variant_mismatches(out).groupBy("label_name").agg(F.count(F.lit(1)).alias("bad"))
    n = out.groupBy("label_name").agg(F.count(F.lit(1)).alias("entities"))
    return n.join(bad, "label_name", "left").select("label_name", "entities", F.coalesce("bad", F.lit(0)).alias("mismatches"))


@register("gold_note_infos")
def gold_note_infos(spark, sf_dir):
    """Gold entities with a +-200 character snippet and the
    lexical variant read from the note."""
    t = tables(spark, sf_dir)
    tx = common.texts(t)
    g = common.method_entities(t, "gold", base=common.rule_entities(t, tx))
    return snippets.add_note_infos(g, tx.select("note_id", "visit_occurrence_id", "cse", "patient_type",
                                                "note_text"))


# ---------------------------------------------------------------------------
# SQL twins
# ---------------------------------------------------------------------------

def _snip_sql(ents_cte: str) -> str:
    L = SNIPPET_LENGTH
    sep = lit(config.SNIPPET_SEP)
    return f""",
e1 AS (SELECT *, lag(offset_end) OVER (PARTITION BY label_name, note_id ORDER BY offset_begin, offset_end) AS pe
       FROM {ents_cte}),
e2 AS (SELECT *, sum(CASE WHEN pe IS NULL OR offset_begin - pe > {L} THEN 1 ELSE 0 END)
                 OVER (PARTITION BY label_name, note_id ORDER BY offset_begin, offset_end
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS snippet_num FROM e1),
isl AS (SELECT label_name, note_id, snippet_num, min(offset_begin) AS b, max(offset_end) AS e FROM e2 GROUP BY ALL),
isl2 AS (SELECT i.*, greatest(0, CAST(trunc(b - {L / 2}) AS INTEGER)) AS ss,
                least(CAST(trunc(e + {L / 2}) AS INTEGER), length(t.note_text)) AS se, t.note_text
         FROM isl i JOIN texts t USING (note_id)),
isl3 AS (SELECT label_name, note_id, snippet_num, ss, substr(note_text, ss + 1, se - ss) || {sep} AS st,
                se + {len(config.SNIPPET_SEP)} - ss AS sl FROM isl2),
isl4 AS (SELECT *, coalesce(sum(sl) OVER (PARTITION BY label_name, note_id ORDER BY snippet_num
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so FROM isl3),
txt AS (SELECT label_name, note_id, string_agg(st, '' ORDER BY snippet_num) AS snippet_note_text,
               count(*) AS n_snippets FROM isl4 GROUP BY ALL),
se AS (SELECT e2.*, CAST(e2.offset_begin + i.so - i.ss AS INTEGER) AS new_offset_begin,
              CAST(e2.offset_end + i.so - i.ss AS INTEGER) AS new_offset_end
       FROM e2 JOIN isl4 i USING (label_name, note_id, snippet_num))"""


ORACLES["snippet_entities"] = EVAL_PREFIX + """,
se0 AS (SELECT label_name, note_id, offset_begin, offset_end, lexical_variant FROM rb)""" + _snip_sql("se0") + """
SELECT s.label_name, s.note_id, s.offset_begin, s.offset_end, CAST(s.snippet_num AS INTEGER) AS snippet_num,
       s.new_offset_begin, s.new_offset_end,
       substr(t.snippet_note_text, s.new_offset_begin + 1, s.new_offset_end - s.new_offset_begin) = s.lexical_variant
         AS variant_ok
FROM se s JOIN txt t USING (label_name, note_id)"""

ORACLES["snippet_texts"] = EVAL_PREFIX + """,
se0 AS (SELECT label_name, note_id, offset_begin, offset_end FROM rb)""" + _snip_sql("se0") + """
SELECT label_name, note_id, n_snippets, snippet_note_text FROM txt"""

ORACLES["annotation_notes"] = EVAL_PREFIX + f""",
pairs AS (SELECT DISTINCT label_name, note_id FROM rb WHERE patient_type = 'inpatient'),
chosen AS (SELECT label_name, note_id FROM (
    SELECT *, row_number() OVER (PARTITION BY label_name ORDER BY
      ('0x' || substr(md5('{config.SEED}|' || label_name || '|' || CAST(note_id AS VARCHAR)), 1, 15))::BIGINT,
      note_id) AS rn FROM pairs) WHERE rn <= {MAX_NOTES}),
se0 AS (SELECT r.label_name, r.note_id, r.offset_begin, r.offset_end FROM rb r
        JOIN chosen c USING (label_name, note_id) WHERE r.patient_type = 'inpatient')""" + _snip_sql("se0") + """
SELECT label_name || '-inpatient-' || CAST(note_id AS VARCHAR) AS note_id, note_id AS old_note_id, label_name,
       label_name || ' - CR-HOSP' AS title, snippet_note_text AS note_text FROM txt"""

ORACLES["annotation_ids"] = ORACLES["annotation_notes"].rsplit("SELECT label_name || ", 1)[0] + """
SELECT note_id, regexp_extract(note_id, '^(.*)-([^-]*)-([^-]*)$', 1) AS parsed_label,
       regexp_extract(note_id, '^(.*)-([^-]*)-([^-]*)$', 2) AS parsed_patient_type,
       CAST(regexp_extract(note_id, '^(.*)-([^-]*)-([^-]*)$', 3) AS BIGINT) AS parsed_note_id
FROM (SELECT label_name || '-inpatient-' || CAST(note_id AS VARCHAR) AS note_id FROM txt)"""

ORACLES["snippet_variant_mismatches"] = common.over_all_notes(EVAL_PREFIX + """,
se0 AS (SELECT label_name, note_id, offset_begin, offset_end, lexical_variant FROM rb)""" + _snip_sql("se0") + """
SELECT s.label_name, count(*) AS entities,
       count_if(strip_accents(substr(t.snippet_note_text, s.new_offset_begin + 1, s.new_offset_end - s.new_offset_begin))
                <> strip_accents(s.lexical_variant)) AS mismatches
FROM se s JOIN txt t USING (label_name, note_id) GROUP BY ALL""")

ORACLES["gold_note_infos"] = EVAL_PREFIX + f""",
gold AS ({common.method_sql("gold")})
SELECT g.*, substr(t.note_text, greatest(0, g.offset_begin - 200) + 1,
                   least(length(t.note_text), g.offset_end + 200) - greatest(0, g.offset_begin - 200)) AS snippet,
       substr(t.note_text, g.offset_begin + 1, g.offset_end - g.offset_begin) AS lexical_variant
FROM gold g JOIN texts t USING (note_id, visit_occurrence_id, cse, patient_type)"""

for _name in ("snippet_entities", "snippet_texts"):
    ORACLES[_name] = ORACLES[_name + "_all_notes"] = common.over_all_notes(ORACLES[_name])
