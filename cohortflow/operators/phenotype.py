"""Claim (ICD-10) phenotypes per visit and over a patient's history
(P7-P10, A1, A2, J4, J5, W5, C2).

Phenotypes are kept LONG -- (visit_occurrence_id, comorb, status) for the
comorbidities a visit actually has -- and pivoted to the wide
``cim10_<comorb>`` layout only at the edge (``to_wide``), with an explicit
value list so the pivot needs no extra job.

Status strings sort by severity (``"0:…" < "1:…" < "2:…"``), so the most
severe status is ``max``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow import config
from cohortflow.session import settled

COMORBS = [c[0] for c in config.COMORBIDITIES]


# ---------------------------------------------------------------------------
# Code -> (comorb, status) maps
# ---------------------------------------------------------------------------

def exact_code_map(codes: DataFrame) -> DataFrame:
    """A code listed under several statuses of one comorbidity gets the
    first status in ascending order (the mildest).  Computed on the small
    dictionary, never on the fact table."""
    return (codes.filter(F.col("code").isNotNull())
            .groupBy("code", "comorb").agg(F.min("status").alias("status")))


def regex_code_map(codes: DataFrame, condition_codes: DataFrame, anchored: bool = False) -> DataFrame:
    """Principal codes matched *anywhere* in a diagnosis code (the
    escaped-alternation ``rlike`` of the study), rewritten as an equi-join.

    An alternation of escaped literals matches a code iff one literal is a
    substring of it, so every distinct diagnosis code is expanded to its
    substrings (prefixes only when ``anchored``) of the lengths that principal
    codes have, and equi-joined to the principal codes.  The fan-out is linear
    in the code's length, nothing here scans the fact table with a regex and
    there is no cross join.  (The lengths are read from the dictionary, which
    is configuration.)
    """
    principal = (codes.filter((F.col("hierarchie") == "Principal") & F.col("code").isNotNull())
                 .select(F.col("code").alias("literal"), "comorb", "status"))
    distinct_codes = condition_codes.select(F.col("condition_source_value").alias("code")).distinct()
    lengths = sorted(r["n"] for r in principal.select(F.length("literal").alias("n")).distinct().collect() if r["n"])
    n = F.length("code")

    def cut(size: int):
        last = F.lit(1) if anchored else n - size + 1
        return F.when(n >= size, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), last)),
                                             lambda s: F.substring("code", s, F.lit(size)))).otherwise(F.array())

    subs = F.concat(*[cut(size) for size in lengths]) if lengths else F.array().cast("array<string>")
    expanded = distinct_codes.filter(n > 0).select("code", F.explode(F.array_distinct(subs)).alias("literal"))
    matched = expanded.join(F.broadcast(principal), "literal")
    # statuses tested in ascending order: the first (mildest) matching wins per code
    return matched.groupBy("code", "comorb").agg(F.min("status").alias("status"))


# ---------------------------------------------------------------------------
# A1: visit phenotype
# ---------------------------------------------------------------------------

def severity(c="status"):
    """Ordered severity of a status label (``"2:…"`` -> 2)."""
    return F.substring(F.col(c), 1, 1).cast("int")


def status_labels(codes: DataFrame) -> DataFrame:
    """(comorb, severity) -> status label; tiny (comorbs x levels)."""
    return (codes.filter(F.col("code").isNotNull())
            .select("comorb", severity().alias("severity"), "status")
            .groupBy("comorb", "severity").agg(F.max("status").alias("status")))


def with_labels(long: DataFrame, codes: DataFrame) -> DataFrame:
    """Attach status labels to (…, comorb, severity) rows (broadcast lookup)."""
    return long.join(F.broadcast(status_labels(codes)), ["comorb", "severity"]).drop("severity")


def visit_severity(cond: DataFrame, codes: DataFrame, via_regex: bool = False,
                   anchored: bool = False) -> DataFrame:
    """A1 on integer severities: (visit_occurrence_id, comorb, severity).

    Aggregating an int keeps the plan on HashAggregate (a string max would
    fall back to sort-based aggregation)."""
    c = cond.select("visit_occurrence_id", F.col("condition_source_value").alias("code"))
    cmap = regex_code_map(codes, cond, anchored) if via_regex else exact_code_map(codes)
    cmap = cmap.select("code", "comorb", severity().alias("severity"))
    # the map may come from the data's codes: its size decides at run time how it is joined
    return (c.join(cmap, "code")
            .groupBy("visit_occurrence_id", "comorb")
            .agg(F.max("severity").alias("severity")))


def visit_phenotypes(cond: DataFrame, codes: DataFrame, via_regex: bool = False,
                     anchored: bool = False) -> DataFrame:
    """A1: most severe status per (visit, comorb) over the visit's diagnoses.

    Long output (visit_occurrence_id, comorb, status); comorbidities without
    a matching code are absent (their status is ``0:Absence``, filled by
    ``to_wide``).  The code map is tiny and broadcast; the aggregation
    combines map-side.
    """
    return with_labels(visit_severity(cond, codes, via_regex, anchored), codes)


# ---------------------------------------------------------------------------
# History phenotype
# ---------------------------------------------------------------------------

def history_phenotypes(targets: DataFrame, all_visits: DataFrame, visit_status: DataFrame,
                       method: str = "first_reached", comorbs: list[str] | None = None,
                       salts: int = 8) -> DataFrame:
    """A2: for each target visit, the most severe status over every visit of
    the same person that started at or before it (equal starts included).

    ``first_reached`` (default): for each (person, comorb, status) the
    earliest start at which it was recorded -- a min-aggregation that
    combines map-side, so a person with a huge history never becomes one
    sorted partition.  These (few) firsts become one array per person, and
    each target looks up its own array: no aggregate follows the join.  The
    targets of a person are dealt over ``salts`` keys and the person's one
    row is repeated for each, so a person with very many stays is several
    tasks.

    ``window``: cumulative RANGE window max per (person, comorb) (W5).

    targets: (visit_occurrence_id, person_id, visit_start_datetime)
    all_visits: (visit_occurrence_id, person_id, visit_start_datetime)
    visit_status: (visit_occurrence_id, comorb, severity)  -- ``visit_severity``
    Output: (visit_occurrence_id, comorb, severity).
    """
    av = all_visits.select("visit_occurrence_id", "person_id", "visit_start_datetime")
    tg = targets.select("visit_occurrence_id", "person_id", "visit_start_datetime")
    vs = visit_status.join(av, "visit_occurrence_id")
    if method == "first_reached":
        firsts = (vs.groupBy("person_id", "comorb", "severity")
                  .agg(F.min("visit_start_datetime").alias("first_start")))
        per = firsts.groupBy("person_id").agg(F.collect_list(F.struct("comorb", "severity", "first_start")).alias("fs"))
        per = per.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        dealt = tg.withColumn("salt", F.pmod(F.hash("visit_occurrence_id"), F.lit(salts)))
        j = dealt.join(per, ["person_id", "salt"]).select("visit_occurrence_id", F.filter(
            "fs", lambda x: x["first_start"] <= F.col("visit_start_datetime")).alias("fs"))
        top = F.filter("fs", lambda x: ~F.exists("fs", lambda y: (y["comorb"] == x["comorb"])
                                                 & (y["severity"] > x["severity"])))
        return j.select("visit_occurrence_id", F.explode(top).alias("x")).select(
            "visit_occurrence_id", "x.comorb", "x.severity")
    if method == "window":
        from pyspark.sql import Window
        # one row per (person, visit, comorb) including targets without status
        marks = (tg.select("person_id", "visit_occurrence_id", "visit_start_datetime",
                           F.lit(None).cast("int").alias("severity"), F.lit(True).alias("is_target"),
                           F.explode(F.array(*[F.lit(c) for c in (comorbs or COMORBS)])).alias("comorb"))
                 .unionByName(vs.select("person_id", "visit_occurrence_id", "visit_start_datetime", "severity",
                                        F.lit(False).alias("is_target"), "comorb")))
        w = (Window.partitionBy("person_id", "comorb").orderBy("visit_start_datetime")
             .rangeBetween(Window.unboundedPreceding, Window.currentRow))
        return (marks.withColumn("hist", F.max("severity").over(w))
                .filter("is_target AND hist IS NOT NULL")
                .select("visit_occurrence_id", "comorb", F.col("hist").alias("severity")))
    raise ValueError(method)


# ---------------------------------------------------------------------------
# Edge: wide layout
# ---------------------------------------------------------------------------

def to_wide(base: DataFrame, long: DataFrame, prefix: str = "cim10",
            fill_absence: bool = True) -> DataFrame:
    """J4 + pivot: ``base`` ⟕ one ``<prefix>_<comorb>`` column per comorbidity.

    The pivot uses the fixed comorbidity list (no value-discovery job).  With
    ``fill_absence`` missing statuses become ``0:Absence`` (the study fills
    the status column only, never the other columns).
    """
    wide = long.groupBy("visit_occurrence_id").pivot("comorb", COMORBS).agg(F.max("status"))
    for c in COMORBS:
        wide = wide.withColumnRenamed(c, f"{prefix}_{c}")
    out = base.join(wide, "visit_occurrence_id", "left")
    if fill_absence:
        out = out.select(*base.columns, *[
            F.coalesce(F.col(f"{prefix}_{c}"), F.lit(config.ABSENCE)).alias(f"{prefix}_{c}") for c in COMORBS])
    return out


def claim_phenotypes(targets: DataFrame, all_visits: DataFrame, cond: DataFrame, codes: DataFrame,
                     via_regex: bool = True, history_method: str = "first_reached") -> DataFrame:
    """Target visits with ``cim10_*`` (visit) and ``all_cim10_*``
    (history) columns, as the study's visit table."""
    # narrow rows (ids, dates, severities) that the stay and the history both need: counted once
    targets, vsev = settled(targets), settled(visit_severity(cond, codes, via_regex=via_regex))
    hist = history_phenotypes(targets, all_visits, vsev, method=history_method)
    own = vsev.join(targets.select("visit_occurrence_id"), "visit_occurrence_id", "left_semi")
    both = own.withColumn("level", F.lit("cim10")).unionByName(hist.withColumn("level", F.lit("all_cim10")))
    cells = with_labels(both, codes).select("visit_occurrence_id", F.concat_ws("_", "level", "comorb").alias("col"), "status")
    names = [f"{level}_{c}" for level in ("cim10", "all_cim10") for c in COMORBS]
    wide = cells.groupBy("visit_occurrence_id").pivot("col", names).agg(F.max("status"))
    return targets.join(wide, "visit_occurrence_id", "left").select(
        *targets.columns, *[F.coalesce(F.col(c), F.lit(config.ABSENCE)).alias(c) for c in names])
