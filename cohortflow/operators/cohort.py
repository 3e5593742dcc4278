"""Cohort selection: model scans, stratification, note selection (S1-S3, P1-P5,
P11-P12, J1-J3, W1, T1-T4, A35, C1, C3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow import config
from cohortflow.functions.exprs import md5_int, md5_unit, recode, strip_prefix
from cohortflow.sources import tables as src


# ---------------------------------------------------------------------------
# Model tables, optionally restricted to a cohort
# ---------------------------------------------------------------------------

def restrict(df: DataFrame, ids: DataFrame | None, key: str = "person_id") -> DataFrame:
    """Keep rows whose ``key`` is in ``ids`` (left-semi: never duplicates)."""
    if ids is None:
        return df
    return df.join(ids.select(key), on=key, how="left_semi")


def visits(t: src.Tables, patient_type: str | None = None, ids: DataFrame | None = None,
           visit_type: str | None = None) -> DataFrame:
    """visit_occurrence with recoded visit type (P2) and type filter."""
    v = src.visit_occurrence_raw(t).withColumn(
        "visit_source_value", recode("visit_source_value", config.VISIT_TYPE_MAPPING))
    if visit_type is None and patient_type is not None:
        visit_type = config.PATIENT_TYPES[patient_type][0]
    if visit_type is not None:
        v = v.filter(F.col("visit_source_value") == visit_type)
    return restrict(v, ids)


def conditions(t: src.Tables, visits_df: DataFrame | None = None) -> DataFrame:
    """condition_occurrence with the ``CIM10:`` prefix removed (P1); optionally
    restricted to the given visits (cohort restriction through the visit)."""
    c = src.condition_occurrence_raw(t).withColumn(
        "condition_source_value", strip_prefix("condition_source_value"))
    if visits_df is not None:
        c = c.join(visits_df.select("visit_occurrence_id"), "visit_occurrence_id", "left_semi")
    return c


def notes(t: src.Tables, ids: DataFrame | None = None) -> DataFrame:
    return restrict(src.clinical_note(t), ids)


def persons(t: src.Tables, ids: DataFrame | None = None) -> DataFrame:
    return restrict(src.person(t), ids)


# ---------------------------------------------------------------------------
# Stratification and split
# ---------------------------------------------------------------------------

def stratification(t: src.Tables, mode: str = "md5") -> DataFrame:
    """Per person: project (cohort ``cse``) and stratum 0..9.

    Keyed on the birth-date string, so two records of one person (same birth
    date) can never land in two projects.  ``md5`` mode is reproducible in
    any engine; ``murmur3`` mode uses Spark's ``hash`` (long-cast before abs).
    """
    p = src.person(t).select("person_id", "birth_datetime")
    bd = F.date_format("birth_datetime", "y-M-d")
    if mode == "md5":
        h = md5_int(bd)
        h2 = md5_int(h)
    elif mode == "murmur3":
        h = F.abs(F.hash(bd).cast("long"))
        h2 = F.abs(F.hash(h).cast("long"))
    else:
        raise ValueError(mode)
    projects = F.array(*[F.lit(c) for c in config.CSE_PROJECTS])
    return p.select(
        "person_id",
        F.element_at(projects, (h % len(config.CSE_PROJECTS)).cast("int") + 1).alias("cse"),
        (h2 % config.SPLIT_RATIO).cast("int").alias("stratum"),
    )


def split(strata: DataFrame, what: str = "train", stratum: int | None = None) -> DataFrame:
    """train = strata < 3 (or a single stratum), test = strata >= 3."""
    if what == "train":
        if stratum is None:
            return strata.filter(F.col("stratum") < config.TEST_THRESHOLD)
        return strata.filter(F.col("stratum") == stratum)
    if what == "test":
        return strata.filter(F.col("stratum") >= config.TEST_THRESHOLD)
    if what == "all":
        return strata
    raise ValueError(what)


def sample_persons(ids: DataFrame, max_number: int, total: int, seed: int = config.SEED) -> DataFrame:
    """Approximate cap ~max_number persons: each is kept with the chance max_number / total (1 at most), by a hash
    of the id, so that the same persons are kept on every run and partitioning."""
    return ids.filter(md5_unit(F.lit(seed), F.lit("persons"), "person_id") < min(1.0, max_number / max(total, 1)))


# ---------------------------------------------------------------------------
# Notes and visits for a patient type
# ---------------------------------------------------------------------------

def _long(min_length: int):
    """P5 on the stored text length (a length implies a text): no text is read."""
    return F.col("note_length") > min_length


def with_texts(t: src.Tables, ids: DataFrame) -> DataFrame:
    """The chosen notes with their texts: ids are chosen on narrow columns, the texts are read and moved once."""
    return ids.join(src.note_texts(t), "note_id")


def select_notes_all(t: src.Tables, patient_types=("inpatient", "outpatient"), min_length: int = 500,
                     ids: DataFrame | None = None, with_text: bool = True) -> DataFrame:
    """C1 for several patient types in one pass over the notes: each type's
    visits (coded ones only for inpatients), notes of the matching class,
    length filter, last note per visit; adds ``patient_type``."""
    vparts = []
    for pt in patient_types:
        vt, nc = config.PATIENT_TYPES[pt]
        v = visits(t, visit_type=vt, ids=ids)
        if pt == "inpatient":
            v = coded_visits(v, conditions(t))
        vparts.append(v.select("person_id", "visit_occurrence_id", "visit_start_datetime",
                               F.lit(pt).alias("patient_type"), F.lit(nc).alias("_class")))
    v = vparts[0]
    for p in vparts[1:]:
        v = v.unionByName(p)
    classes = [config.PATIENT_TYPES[pt][1] for pt in patient_types]
    n = (notes(t, ids).drop("note_text")
         .filter(F.col("note_class_source_value").isin(classes)).filter(_long(min_length)))
    n = n.join(v, ["person_id", "visit_occurrence_id"]).filter(F.col("note_class_source_value") == F.col("_class")) \
        .drop("_class")
    n = last_note_per_visit(n)
    return with_texts(t, n) if with_text else n


def coded_visits(v: DataFrame, c: DataFrame) -> DataFrame:
    """Visits having at least one diagnosis (left-semi, no distinct)."""
    return v.join(c.select("visit_occurrence_id"), "visit_occurrence_id", "left_semi")


def last_note_per_visit(n: DataFrame) -> DataFrame:
    """The latest note of each visit (ties broken by the larger note_id).

    Written as an aggregation (``max_by``) on the narrow (visit, time, id)
    projection, which combines map-side -- a visit holding a huge share of
    the notes costs one row per task, not one sorted partition -- then a
    join back on the unique (visit, note) key.
    """
    last = (n.select("visit_occurrence_id", "note_id", "note_datetime")
            .groupBy("visit_occurrence_id")
            .agg(F.max_by("note_id", F.struct("note_datetime", "note_id")).alias("note_id")))
    return n.join(last, ["visit_occurrence_id", "note_id"], "left_semi")


def sample_top(df: DataFrame, n: int, key: str = "note_id", seed: int = config.SEED) -> DataFrame:
    """Seeded random sample of ``n`` rows (top-n by md5(seed, key)).

    Deterministic whatever the partitioning; ``orderBy().limit()`` is planned
    as a distributed TakeOrderedAndProject (n rows per task)."""
    return df.orderBy(md5_int(F.lit(seed), key, digits=15), F.col(key)).limit(n)


def select_notes(t: src.Tables, patient_type: str = "inpatient", keep_last_note_only: bool = True,
                 n_notes: int | None = None, ids: DataFrame | None = None,
                 min_length: int = 500, seed: int = config.SEED,
                 visits_df: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """C1 (P4 J2 J3 P5 W1 A35 T1): notes and visits of a patient type.

    Returns ``(notes, visits)``; visits = distinct (person, visit, start) of
    the selected notes.  ``visits_df`` replaces the visit table (e.g. visits
    already restricted upstream).
    """
    visit_type, note_class = config.PATIENT_TYPES[patient_type]
    v = visits(t, visit_type=visit_type, ids=ids) if visits_df is None else visits_df
    if patient_type == "inpatient":
        v = coded_visits(v, conditions(t))
    n = (notes(t, ids).drop("note_text")
         .filter(F.col("note_class_source_value") == note_class)          # P4
         .filter(_long(min_length)))                                        # P5
    n = n.join(v.select("person_id", "visit_occurrence_id", "visit_start_datetime"),
               ["person_id", "visit_occurrence_id"], "inner")              # J3
    if keep_last_note_only:
        n = last_note_per_visit(n)
    if n_notes is not None:
        n = sample_top(n, n_notes, seed=seed)
    sel_visits = n.select("person_id", "visit_occurrence_id", "visit_start_datetime")
    if not keep_last_note_only or n_notes is not None:
        sel_visits = sel_visits.distinct()                                 # A35
    return with_texts(t, n), sel_visits
