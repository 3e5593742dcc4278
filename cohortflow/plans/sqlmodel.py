"""SQL twins of the model binding and configuration dimensions, for the DuckDB
oracles.  The strings only use the pre-registered driver views (``customer``,
``orders``, ``lineitem``, ``documents`` ...)."""

from __future__ import annotations

from cohortflow import config
from cohortflow.sources import dims


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("'", "''") + "'"


def values(rows, cols) -> str:
    body = ",\n    ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES\n    {body}) AS v({', '.join(cols)}))"


def str_list(xs) -> str:
    return "[" + ", ".join(lit(x) for x in xs) + "]"


VISIT_TYPE_SQL = ("CASE o_orderstatus "
                  + " ".join(f"WHEN {lit(k)} THEN {lit(config.VISIT_TYPE_MAPPING[v])}"
                             for k, v in config.ORDER_STATUS_TO_VISIT_CODE.items())
                  + " END")

MODEL = {
    "person": """SELECT c_custkey AS person_id,
        CAST(DATE '1930-01-01' + CAST((c_custkey * 37) % 25000 AS INTEGER) AS TIMESTAMP) AS birth_datetime,
        CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender_source_value
      FROM customer""",
    "visit_occurrence": f"""SELECT o_custkey AS person_id, o_orderkey AS visit_occurrence_id,
        o_orderdate AS visit_start_datetime,
        o_orderdate + to_days(CAST(o_orderkey % 10 AS INTEGER)) AS visit_end_datetime,
        {VISIT_TYPE_SQL} AS visit_source_value
      FROM orders""",
    "condition_occurrence": """SELECT l_orderkey AS visit_occurrence_id,
        CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS condition_occurrence_id,
        CASE WHEN l_returnflag = 'R' THEN 'DP' ELSE 'DAS' END AS condition_status_source_value,
        (chr(CAST(65 + l_partkey % 20 AS INTEGER))
               || lpad(CAST((((l_partkey // 20) + l_suppkey) % 50) + 1 AS VARCHAR), 2, '0'))
          AS condition_source_value
      FROM lineitem""",
    "clinical_note": """SELECT CASE WHEN doc_id % 3 = 2 THEN 'CR:CR-CONS' ELSE 'CR:CRH-HOSPI' END AS note_class_source_value,
        o_orderkey AS visit_occurrence_id, o_custkey AS person_id, doc_id AS note_id, text AS note_text,
        o_orderdate + to_hours(CAST(doc_id % 3 AS INTEGER)) AS note_datetime
      FROM documents JOIN orders ON doc_id // 2 = o_orderkey""",
    "care_site": """SELECT 'UFR:' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 3, '0') || ':'
        || CAST(o_orderkey % 7 AS VARCHAR) AS location_cd, o_orderkey AS visit_occurrence_id FROM orders""",
    "strata": f"""SELECT person_id,
        {str_list(config.CSE_PROJECTS)}[CAST(h % {len(config.CSE_PROJECTS)} AS INTEGER) + 1] AS cse,
        CAST(('0x' || substr(md5(CAST(h AS VARCHAR)), 1, 8))::BIGINT % {config.SPLIT_RATIO} AS INTEGER) AS stratum
      FROM (SELECT person_id,
              ('0x' || substr(md5(strftime(birth_datetime, '%Y-%-m-%-d')), 1, 8))::BIGINT AS h
            FROM person)""",
    "codes": values(dims.code_rows(), ["code", "libelle", "status", "comorb", "hierarchie"]),
    "comorb_cfg": values([(c[0], c[1], c[2], c[6], c[7]) for c in config.COMORBIDITIES],
                         ["pipe_name", "label_name", "selection_type", "family", "position"]),
    "lexicon": values(config.LEXICON, ["term", "label_name", "label_value"]),
}


def with_model(*names: str) -> str:
    """``WITH`` prefix defining the requested model views (in order)."""
    return "WITH " + ",\n".join(f"{n} AS ({MODEL[n]})" for n in names)


def inpatient_notes_sql(patient_type: str = "inpatient", visits: str = "visit_occurrence") -> str:
    """C1 as SQL (body of a CTE named by the caller)."""
    vt, nc = config.PATIENT_TYPES[patient_type]
    coded = ("AND visit_occurrence_id IN (SELECT visit_occurrence_id FROM condition_occurrence)"
             if patient_type == "inpatient" else "")
    return f"""SELECT * FROM (
        SELECT n.*, v.visit_start_datetime,
               row_number() OVER (PARTITION BY n.visit_occurrence_id
                                  ORDER BY n.note_datetime DESC, n.note_id DESC) AS rn
        FROM clinical_note n
        JOIN (SELECT * FROM {visits} WHERE visit_source_value = {lit(vt)} {coded}) v
          ON n.person_id = v.person_id AND n.visit_occurrence_id = v.visit_occurrence_id
        WHERE n.note_class_source_value = {lit(nc)} AND n.note_text IS NOT NULL AND length(n.note_text) > 500
      ) WHERE rn = 1"""
