"""Label tables: Overall / Total roll-ups, aggregated list labels, note-level
labels per source, claim labels, side-by-side flags (A6, A7, A19-A22, P19).

Row duplication (``Overall`` cohort, aggregated value ``3``) is written as
``explode`` of a 1- or 2-element array -- one pass, no union, no join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow import config
from cohortflow.functions.exprs import normalize_label_value
from cohortflow.sources import dims

OVERALL = "Overall"
TOTAL = "Total"


def add_overall(df: DataFrame, on_cse: bool = True, on_comorb: bool = False) -> DataFrame:
    """Duplicate rows under cse ``Overall``; optionally add a ``Total``
    label (rare labels excluded, value ``"1"``)."""
    out = df
    if on_cse and "cse" in df.columns:
        out = out.withColumn("cse", F.explode(F.array(F.col("cse"), F.lit(OVERALL))))
    if on_comorb and "label_name" in out.columns:
        is_rare = F.col("label_name").isin(config.RARE_COMORBS)
        pair = F.when(is_rare, F.array(F.struct(F.col("label_name").alias("n"), F.col("label_value").alias("v")))) \
            .otherwise(F.array(F.struct(F.col("label_name").alias("n"), F.col("label_value").alias("v")),
                               F.struct(F.lit(TOTAL).alias("n"), F.lit("1").alias("v"))))
        out = (out.withColumn("_p", F.explode(pair))
               .withColumn("label_name", F.col("_p.n")).withColumn("label_value", F.col("_p.v")).drop("_p"))
    return out


def add_aggregated_label(df: DataFrame) -> DataFrame:
    """List-type labels get an extra copy with value ``"3"``."""
    is_list = F.col("label_name").isin(dims.list_type_labels())
    return df.withColumn("label_value", F.explode(
        F.when(is_list, F.array(F.col("label_value"), F.lit("3"))).otherwise(F.array(F.col("label_value")))))


def remove_aggregated_label(df: DataFrame) -> DataFrame:
    """List-type labels keep only their aggregated (``3`` / average)
    rows, relabelled ``"1"``; a table that holds a single label value stays as
    it is (decided by a scalar subquery)."""
    is_list = F.col("label_name").isin(dims.list_type_labels())
    single = df.agg(F.coalesce(F.min("label_value") == F.max("label_value"), F.lit(True))).scalar()
    keep = single | ~is_list | F.col("label_value").rlike(r"\b(3|average)")
    value = F.when(is_list & ~single, F.lit("1")).otherwise(F.col("label_value"))
    out = df.filter(keep)
    return out.select(*[value.alias(c) if c == "label_value" else F.col(c) for c in df.columns])


def note_labels(entities: DataFrame, source: str, group_columns=("label_name", "cse", "patient_type"),
                with_aggregated: bool = True, with_overall: bool = True) -> DataFrame:
    """Note-level label = max value of kept entities per (group, note)."""
    g = [c for c in group_columns if c in entities.columns]
    df = (entities.filter(F.col("to_keep"))
          .groupBy(*g, "note_id").agg(F.max("label_value").alias("label_value")))
    if with_aggregated:
        df = add_aggregated_label(df)
    if with_overall:
        df = add_overall(df)
    return df.withColumn("source", F.lit(source))


def claim_labels(visit_status: DataFrame, texts: DataFrame, with_aggregated: bool = True,
                 with_overall: bool = True) -> DataFrame:
    """Claim (ICD-10) labels per note from the long visit phenotype.

    visit_status: (visit_occurrence_id, comorb, severity) -- present comorbs
    texts: (note_id, visit_occurrence_id, cse)
    Works on the long table directly (no wide -> long round trip); absent
    statuses (value 0) never appear.
    """
    pipe_to_label = F.create_map(*[F.lit(x) for c in config.COMORBIDITIES for x in (c[0], c[1])])
    df = (visit_status.filter(F.col("severity") > 0)
          .join(texts.select("note_id", "visit_occurrence_id", "cse"), "visit_occurrence_id")
          .select("note_id", "cse", pipe_to_label[F.col("comorb")].alias("label_name"),
                  F.col("severity").cast("string").alias("label_value"))
          .distinct())
    if with_aggregated:
        df = add_aggregated_label(df)
    df = df.withColumn("source", F.lit("icd10"))
    if with_overall:
        df = add_overall(df)
    return df


def side_by_side(algo: DataFrame, gold: DataFrame, icd10: DataFrame, rule_based: DataFrame,
                 label_type: str = "ml", group_columns=("label_name", "label_value", "cse")) -> DataFrame:
    """Presence flags of each source per (label, value, cse, note),
    inpatient notes only (claims are inpatient by construction)."""
    cols = list(group_columns) + ["note_id", "source"]

    def inp(df):
        return df.filter(F.col("patient_type") == "inpatient").select(*cols)

    u = inp(algo).unionByName(inp(gold)).unionByName(inp(rule_based)).unionByName(icd10.select(*cols))
    return u.groupBy(*group_columns, "note_id").agg(
        F.bool_or(F.col("source") == "gold").alias("gold"),
        F.bool_or(F.col("source") == label_type).alias("nlp"),
        F.bool_or(F.col("source") == "rule_based").alias("rule_based"),
        F.bool_or(F.col("source") == "icd10").alias("claim"),
    )


def clean_gold(gold_raw: DataFrame) -> DataFrame:
    """Drop placeholder rows (no label), normalise the value, drop value
    "0", merge the three qualifier flags into ``to_keep``."""
    g = gold_raw.filter(F.col("gold_label_name").isNotNull())
    g = g.withColumn("label_value", normalize_label_value("gold_label_value")).filter(F.col("label_value") != "0")
    return g.select(
        "*",
        (~(F.col("gold_negation_value") | F.col("gold_family_value") | F.col("gold_hypothesis_value"))).alias("to_keep"),
    ).withColumnRenamed("gold_label_name", "label_name")
