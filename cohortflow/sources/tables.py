"""Scans of the driver's tables, bound to the clinical data model.

The driver ships TPC-H-ish tables.  They are projected onto the study's model
(person, visit_occurrence, condition_occurrence, clinical_note, care_site) with
deterministic column expressions only -- every rule here has a one-line SQL
twin in ``cohortflow.plans.oracles`` so the DuckDB oracle sees the same model.

Scans select only the columns they need, so Parquet column pruning and
predicate pushdown reach the files.  Nothing is cached: downstream operators
decide what to reuse.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow import config

# SQL twins of the binding rules (also used verbatim by the oracles).
BIRTH_SQL = "date_add(DATE '1930-01-01', CAST((c_custkey * 37) % 25000 AS INT))"
CODE_SQL = (
    "concat('CIM10:', chr(CAST(65 + l_partkey % 20 AS INT)), "
    "lpad(CAST((((l_partkey DIV 20) + l_suppkey) % 50) + 1 AS STRING), 2, '0'))"
)


@dataclass
class Tables:
    """Lazy access to the driver's parquet tables in one scale-factor folder."""

    spark: SparkSession
    sf_dir: str
    _cache: dict = field(default_factory=dict, repr=False)

    def raw(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._cache[name]


def _case_map(col: Column, mapping: dict[str, str]) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == k, v) if expr is None else expr.when(col == k, v)
    return expr


def person(t: Tables) -> DataFrame:
    """customer -> person(person_id, birth_datetime, gender_source_value)."""
    c = t.raw("customer").select("c_custkey")
    return c.select(
        F.col("c_custkey").alias("person_id"),
        F.expr(BIRTH_SQL).cast("timestamp").alias("birth_datetime"),
        F.when(F.col("c_custkey") % 2 == 0, "M").otherwise("F").alias("gender_source_value"),
    )


def visit_occurrence_raw(t: Tables) -> DataFrame:
    """orders -> visit_occurrence with the raw visit-type code (I/O/U)."""
    o = t.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    return o.select(
        F.col("o_custkey").alias("person_id"),
        F.col("o_orderkey").alias("visit_occurrence_id"),
        F.col("o_orderdate").alias("visit_start_datetime"),
        (F.col("o_orderdate") + F.make_interval(days=(F.col("o_orderkey") % 10).cast("int")))
        .alias("visit_end_datetime"),
        _case_map(F.col("o_orderstatus"), config.ORDER_STATUS_TO_VISIT_CODE).alias("visit_source_value"),
    )


def condition_occurrence_raw(t: Tables) -> DataFrame:
    """lineitem -> condition_occurrence with raw ``CIM10:`` codes.

    Built from lineitem alone (no join): the diagnosis code is a function of
    the part and supplier keys, the status (principal / associated) of the
    return flag.  Person ids are not materialised here; cohort restriction of
    diagnoses goes through their visit (a visit belongs to one person).
    """
    li = t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return li.select(
        F.col("l_orderkey").alias("visit_occurrence_id"),
        F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber")).alias("condition_occurrence_id"),
        F.when(F.col("l_returnflag") == "R", "DP").otherwise("DAS").alias("condition_status_source_value"),
        F.expr(CODE_SQL).alias("condition_source_value"),
    )


def note_texts(t: Tables) -> DataFrame:
    """note_id, note_text."""
    return t.raw("documents").select(F.col("doc_id").alias("note_id"), F.col("text").alias("note_text"))


def clinical_note(t: Tables) -> DataFrame:
    """documents ⋈ orders -> notes.

    Two documents per visit (visit = doc_id DIV 2); the note class is the
    discharge summary except for every third document (consultation report);
    note time = visit start + (doc_id % 3) hours.
    """
    d = t.raw("documents").select("doc_id", "text", "n_chars")
    o = t.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = d.join(o, F.expr("doc_id DIV 2") == o.o_orderkey, "inner")
    return j.select(
        F.when(F.col("doc_id") % 3 == 2, "CR:CR-CONS").otherwise("CR:CRH-HOSPI").alias("note_class_source_value"),
        F.col("o_orderkey").alias("visit_occurrence_id"),
        F.col("o_custkey").alias("person_id"),
        F.col("doc_id").alias("note_id"),
        F.col("text").alias("note_text"),
        (F.col("o_orderdate") + F.make_interval(hours=(F.col("doc_id") % 3).cast("int"))).alias("note_datetime"),
        # stored text length (= length(text)): length filters never read the text
        F.col("n_chars").alias("note_length"),
    )


def care_site(t: Tables) -> DataFrame:
    """orders -> care-site observations (location_cd, visit_occurrence_id)."""
    o = t.raw("orders").select("o_orderkey")
    return o.select(
        F.concat(F.lit("UFR:"), F.lpad((F.col("o_orderkey") % 100).cast("string"), 3, "0"),
                 F.lit(":"), (F.col("o_orderkey") % 7).cast("string")).alias("location_cd"),
        F.col("o_orderkey").alias("visit_occurrence_id"),
    )


def training_documents(t: Tables) -> DataFrame:
    """documents ⋈ labels -> (entity_id, note_text, to_keep) training examples."""
    d = t.raw("documents").select("doc_id", "text")
    lab = t.raw("labels").select("doc_id", "quality")
    return d.join(lab, "doc_id").select(
        F.col("doc_id").alias("entity_id"),
        F.col("text").alias("note_text"),
        (F.col("quality") == 1).alias("to_keep"),
    )
