"""Cohort statistics and report tables (A4, A5, A17, A18, A34, C4, P15, P24,
P25, P26, T5, U3-U9, W8).

Report tables are long (unpivot) and pivoted with explicit value lists, so
no value-discovery job runs and the wide layout is produced by a single
grouped aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortflow import config
from cohortflow.functions.exprs import age_years, display_name
from cohortflow.session import checkpoint_dir
from cohortflow.operators.labels import OVERALL, add_overall


# ---------------------------------------------------------------------------
# C4 / A17 / A18
# ---------------------------------------------------------------------------

def cohort_demographics(texts: DataFrame, visits: DataFrame, persons: DataFrame) -> DataFrame:
    """C4 (P24, J19, P15): (cse, patient_type, age_at_adm, gender) per
    distinct (visit, cohort, patient type) of the cohort notes."""
    tv = texts.select("visit_occurrence_id", "cse", "patient_type").distinct()
    v = visits.join(tv.select("visit_occurrence_id"), "visit_occurrence_id", "left_semi")   # P24
    v = v.join(persons, "person_id")                                                        # J19
    v = v.withColumn("age_at_adm", age_years("visit_start_datetime", "birth_datetime"))     # P15
    return v.join(tv, "visit_occurrence_id").select("cse", "patient_type", "age_at_adm", "gender_source_value")


def cohort_stats(demo: DataFrame, with_overall: bool = True) -> DataFrame:
    """Age mean / sample sd and % male / % female (truncated) per group."""
    d = add_overall(demo) if with_overall else demo
    m = F.avg((F.col("gender_source_value") == "M").cast("double"))
    return d.groupBy("cse", "patient_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("age_at_adm").alias("age_mean"), F.stddev_samp("age_at_adm").alias("age_std"),
        (F.lit(100.0) * m).cast("int").alias("pct_male"),
        (F.lit(100.0) * (F.lit(1.0) - m)).cast("int").alias("pct_female"))


def cohort_stats_per_label(gold: DataFrame, with_overall: bool = True,
                           with_qualification: bool = True) -> DataFrame:
    """Per (cse, patient_type, label): documents with an entity
    (normally sampled / up-sampled), mean entities per document having any,
    sample sd of entities per document."""
    g = add_overall(gold, on_comorb=True) if with_overall else gold
    if with_qualification:
        g = g.filter("to_keep")
    up = F.coalesce(F.col("upsampled").cast("boolean"), F.lit(False))
    per_doc = g.groupBy("cse", "patient_type", "label_name", "note_id").agg(
        F.count(F.lit(1)).alias("N"), F.count_if(up).alias("N_up"), F.count_if(~up).alias("N_normal"))
    return per_doc.groupBy("cse", "patient_type", "label_name").agg(
        F.count_if(F.col("N_normal") > 0).alias("n_docs_normal"),
        F.count_if(F.col("N_up") > 0).alias("n_docs_upsampled"),
        F.try_divide(F.sum("N_normal").cast("double"), F.count_if(F.col("N_normal") > 0).cast("double"))
        .alias("mean_entity_per_doc"),
        F.stddev_samp("N").alias("std_entity_per_doc"))


def qualifier_shares(ents: DataFrame, by=()) -> DataFrame:
    """% of entities negated / hypothetical / family / not kept."""
    pct = lambda c: (F.lit(100.0) * F.avg(F.col(c).cast("double"))).alias(f"pct_{c}")
    return ents.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), pct("negation"), pct("hypothesis"), pct("family"),
                                 (F.lit(100.0) * F.avg((~F.col("to_keep")).cast("double"))).alias("pct_discarded"))


# ---------------------------------------------------------------------------
# A4 / A5 / W8
# ---------------------------------------------------------------------------

def entity_counts(ents: DataFrame, cfg: DataFrame) -> DataFrame:
    """A4: entities per label, zero-filled over the configured labels."""
    c = ents.groupBy("label_name").agg(F.count(F.lit(1)).alias("n_entities"))
    return cfg.select("label_name").join(c, "label_name", "left").select(
        "label_name", F.coalesce("n_entities", F.lit(0)).alias("n_entities"))


def dense_index(df: DataFrame, order_cols: list[str], name: str = "index") -> DataFrame:
    """1-based position in the global order ``order_cols`` without a
    single-partition window over rows: rows are range-partitioned and sorted
    once (reliable checkpoint), each numbers itself inside its partition, and
    the only global window runs over one count per partition."""
    checkpoint_dir(df.sparkSession)
    d = (df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
         .withColumn("_at", F.monotonically_increasing_id()).checkpoint(eager=True))
    part = F.shiftright("_at", 33)
    sizes = d.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    out = d.withColumn("_part", part).join(F.broadcast(sizes), "_part")
    return out.withColumn(name, F.col("_off") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_off", "_at")


def entities_per_doc(ents: DataFrame, notes: DataFrame) -> DataFrame:
    """A5: entities per note (zero-filled), 1-based index in (N, note) order."""
    c = ents.groupBy("note_id").agg(F.count(F.lit(1)).alias("N"))
    d = notes.select("note_id").join(c, "note_id", "left").select("note_id", F.coalesce("N", F.lit(0)).alias("N"))
    return dense_index(d, ["N", "note_id"])


# ---------------------------------------------------------------------------
# U3-U9 / T5 / P25 / P26
# ---------------------------------------------------------------------------

def unpivot(df: DataFrame, ids: list[str], values: list[str], var: str = "metric", val: str = "value") -> DataFrame:
    """Wide -> long."""
    return df.unpivot(ids, values, var, val)


def label_rank() -> F.Column:
    """T5: domain order of labels (configured position; Total last)."""
    kv = []
    for c in config.COMORBIDITIES:
        kv += [F.lit(c[1]), F.lit(c[7])]
    return F.coalesce(F.create_map(*kv)[F.col("label_name")], F.lit(1000))


def metric_table(df: DataFrame, metrics=("PPV", "Sensitivity", "F1"), split_per_cse: bool = True,
                 cses=None) -> DataFrame:
    """U8: per (label, value, metric) one column per cohort (``split_per_cse``)
    or the Overall column only; display names (P26) and domain order (T5)."""
    cses = cses or (config.CSE_PROJECTS + [OVERALL] if split_per_cse else [OVERALL])
    ids = [c for c in ("label_name", "label_value", "cse") if c in df.columns]
    long = unpivot(df.select(*ids, *[F.col(m).cast("double") for m in metrics]), ids, list(metrics))
    wide = long.groupBy("label_name", "label_value", "metric").pivot("cse", cses).agg(F.first("value"))
    return wide.select(display_name("label_name").alias("label"), "*", label_rank().alias("rank")) \
        .orderBy("rank", "label_name", "label_value", "metric")


def parse_ci(c: str) -> list[F.Column]:
    """P25: ``"v (lo - hi)"`` -> value (double) and the CI string."""
    return [F.nullif(F.regexp_extract(F.col(c), r"^\s*([-0-9.]+)", 1), F.lit("")).try_cast("double").alias("value"),
            F.nullif(F.regexp_extract(F.col(c), r"(\([^)]*\))", 1), F.lit("")).alias("ci")]


def cohort_table(stats: DataFrame, per_label: DataFrame, cses=None, patient_types=None) -> DataFrame:
    """Descriptive block (age mean / sd, % male / female, number of
    records -- the real count) over the per-label block (documents with an
    entity, mean entities per document); one numeric column per
    (cohort, patient type), built long then pivoted with an explicit list."""
    cses = cses or (config.CSE_PROJECTS + [OVERALL])
    pts = patient_types or list(config.PATIENT_TYPES)
    a_cols = ["age_mean", "age_std", "pct_male", "pct_female", "n"]
    a = stats.select("cse", "patient_type", *[F.col(c).cast("double") for c in a_cols]) \
        .unpivot(["cse", "patient_type"], a_cols, "metric", "value") \
        .withColumn("metric_type", F.lit("Descriptive data"))
    b_cols = ["n_docs_normal", "mean_entity_per_doc"]
    b = per_label.select("cse", "patient_type", "label_name", *[F.col(c).cast("double") for c in b_cols]) \
        .unpivot(["cse", "patient_type", "label_name"], b_cols, "stat", "value") \
        .select("cse", "patient_type", F.concat_ws(" / ", "label_name", "stat").alias("metric"), "value",
                F.lit("condition").alias("metric_type"))
    long = a.unionByName(b).withColumn("col", F.concat_ws("_", "cse", "patient_type"))
    keys = [f"{c}_{p}" for c in cses for p in pts]
    return long.groupBy("metric_type", "metric").pivot("col", keys).agg(F.first("value"))


# ---------------------------------------------------------------------------
# Report tables of text cells
# ---------------------------------------------------------------------------

#: FIXED VALUES: order of the columns of the report tables by cohort (T5); rows go by label.
COLUMN_ORDER = {"cse180032": 0, "cse200055": 2, "cse200093": 3, OVERALL: 99}
PATIENT_TYPE_ORDER = list(config.PATIENT_TYPES)


def ordered_cohorts(cses) -> list[str]:
    """T5 for columns: cohorts in their domain order, unknown ones last."""
    return sorted(cses, key=lambda c: (COLUMN_ORDER.get(c, 98), c))


def _cells(long: DataFrame, rows: list[str], columns: list[str], missing: str) -> DataFrame:
    """Rows x ``col`` of ``cell``, missing cells filled, in the domain order of the labels."""
    wide = long.groupBy(*rows).pivot("col", columns).agg(F.first("cell")).na.fill(missing, columns)
    return wide.orderBy(label_rank(), *rows)


def condition_table(per_label: DataFrame, cses=None) -> DataFrame:
    """U7 (second block): per label ``n (mean)``: documents with an entity and entities per document, one column
    per cohort and patient type in domain order, "0" where there are none."""
    cell = F.concat(F.col("n_docs_normal").cast("string"), F.lit(" ("), F.format_string("%.1f", F.floor(F.col("mean_entity_per_doc") * 10 + 0.5) / 10), F.lit(")"))
    cell = F.when(F.col("mean_entity_per_doc").isNotNull(), cell)
    long = per_label.select("label_name", F.concat_ws("_", "cse", "patient_type").alias("col"), cell.alias("cell"))
    columns = [f"{c}_{p}" for c in ordered_cohorts(cses or config.CSE_PROJECTS + [OVERALL]) for p in PATIENT_TYPE_ORDER]
    return _cells(long, ["label_name"], columns, "0")


def cell_table(df: DataFrame, metrics: list[str], split_per_cse: bool = True) -> DataFrame:
    """U8 (tables 2 and 3): per (label, value) one text column per cohort (or Overall alone) and metric, numbers with one
    decimal, "-" where a metric is undefined or a cohort has no such label."""
    cses = ordered_cohorts(config.CSE_PROJECTS) if split_per_cse else [OVERALL]
    ids = ["label_name", "label_value", "cse"]
    long = df.filter(F.col("cse").isin(cses)).select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(ids, metrics, "metric", "value")
    long = long.select("label_name", "label_value", F.concat_ws("_", "cse", "metric").alias("col"), F.format_string("%.1f", F.floor(F.col("value") * 10 + 0.5) / 10).alias("_t"), "value")
    long = long.withColumn("cell", F.when(F.col("value").isNotNull(), F.col("_t")))
    return _cells(long, ["label_name", "label_value"], [f"{c}_{m}" for c in cses for m in metrics], "-")
