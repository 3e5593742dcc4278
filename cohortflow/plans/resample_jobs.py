"""Registered resampling jobs (B1-B6, C9, J17, M7, P25, U9).  Draws come from hashes, so SQL repeats
every replicate, average and interval; only the model fits of ``cross_cohort_intervals_ml`` have no twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortflow.operators import labels, metrics, ml, reports, resample
from cohortflow.plans import boot_sql as bs
from cohortflow.plans import common
from cohortflow.plans import eval_sql as es
from cohortflow.plans.eval_jobs import EVAL_PREFIX, Eval, _nl_sql
from cohortflow.plans.registry import ORACLES, register

KEYS = ["label_name", "label_value", "cse"]
METRICS = ["PPV", "Sensitivity", "Specificity", "F1"]


def _note_counts(e: Eval):
    """Note-level confusion counts (both patient types summed) per label/value/cse."""
    return metrics.note_confusion(e.note_labels("rule_based"), e.note_labels("gold"), "rule_based",
                                  ["label_name", "label_value", "cse"])


@register("bootstrap_note_metrics")
def bootstrap_note_metrics(spark, sf_dir):
    """B1 + B2 + B5: 200 resamples of the note-level counts, metrics and
    averages per replicate (the long replicate table kept for testing)."""
    e = Eval(spark, sf_dir)
    den = e.denominators(("cse",))
    return resample.bootstrap_metric_table(_note_counts(e), ["cse"], with_specificity=True, denominators=den)


@register("bootstrap_ci")
def bootstrap_ci(spark, sf_dir):
    """B3 + J17 + P25: point metrics with their 95 % interval formatted
    ``"v (lo - hi)"``, and the string parsed back into value and interval."""
    e = Eval(spark, sf_dir)
    den = e.denominators(("cse",))
    counts = _note_counts(e)
    point = metrics.add_avg_metrics(metrics.classification_metrics(counts, den, True), ["cse"],
                                    with_specificity=True, denominators=den)
    reps = resample.bootstrap_metric_table(counts, ["cse"], with_specificity=True, denominators=den)
    ci = resample.confidence_intervals(reps, KEYS, METRICS)
    out = resample.with_ci(point, ci, KEYS, METRICS)
    value, interval = reports.parse_ci("F1")
    return out.select("*", value.alias("F1_parsed_value"), interval.alias("F1_parsed_ci"))


@register("stratified_bootstrap")
def stratified_bootstrap(spark, sf_dir):
    """B4 (B6 shape): per-cohort counts resampled within each cohort, summed
    per label, zero-safe micro / macro / weighted metrics with 95 % CI."""
    e = Eval(spark, sf_dir)
    c = metrics.note_confusion(e.note_labels("rule_based", ("label_name", "cse")),
                               e.note_labels("gold", ("label_name", "cse")), "rule_based", ["label_name", "cse"])
    c = c.filter((F.col("cse") != labels.OVERALL) & (F.col("label_name") != labels.TOTAL))
    return resample.stratified_bootstrap(c, "cse")


# ---------------------------------------------------------------------------
# Models by training cohort
# ---------------------------------------------------------------------------

MATRIX_COLUMNS = ["validated_on", "method", "metric", *common.TRAINED_ON]


def _gold_predictions(spark, sf_dir):
    return common.fixed_predictions(Eval(spark, sf_dir).ents("gold"))


def _note_counts_by_model(e, predicted):
    """Note-level confusion of every model (training cohort as a key): gold spans kept by the model against
    those kept by the gold flag."""
    by = ("trained_on", "label_name", "cse")
    algo = labels.note_labels(predicted, "ml", by)
    gold = labels.note_labels(predicted.withColumn("to_keep", F.col("gold_to_keep")), "gold", by)
    return metrics.note_confusion(algo, gold, "ml", ["trained_on", "label_name", "label_value", "cse"])


@register("cross_cohort_intervals")
def cross_cohort_intervals(spark, sf_dir):
    """B6 (on gold entities): averages with 95 % intervals of four models, trained on Overall or one cohort,
    on every cohort; fixed predictions."""
    return resample.cohort_effect(resample.keep_confusion(_gold_predictions(spark, sf_dir), ["trained_on"]))


@register("cross_cohort_note_intervals")
def cross_cohort_note_intervals(spark, sf_dir):
    """B6 (at note level) on the fixed predictions."""
    e = Eval(spark, sf_dir)
    return resample.cohort_effect(_note_counts_by_model(e, common.fixed_predictions(e.ents("gold"))))


@register("cross_cohort_interval_matrix")
def cross_cohort_interval_matrix(spark, sf_dir):
    """validated_on x trained_on of ``v (lo - hi)``, Overall among both; fixed predictions."""
    return resample.cohort_matrix(cross_cohort_intervals(spark, sf_dir), common.TRAINED_ON).select(*MATRIX_COLUMNS)


@register("cross_cohort_zero_safe")
def cross_cohort_zero_safe(spark, sf_dir):
    """B6 by the zero-safe scheme: each (training, validation) cohort pair resampled on its own."""
    return resample.zero_safe_cohort_effect(resample.keep_confusion(_gold_predictions(spark, sf_dir), ["trained_on"]))


@register("same_cohort_bootstrap")
def same_cohort_bootstrap(spark, sf_dir):
    """Models on the cohort that trained them, resampled per cohort and summed per label."""
    return resample.same_cohort_effect(resample.keep_confusion(_gold_predictions(spark, sf_dir), ["trained_on"]))


@register("cross_cohort_intervals_ml")
def cross_cohort_intervals_ml(spark, sf_dir):
    """C9 with trained models (M4, M7): one qualifier per training cohort and one on all, scored on the
    validation notes of every cohort, in the same grouped job."""
    from cohortflow.plans.ml_jobs import _gold_contexts

    ctx = _gold_contexts(Eval(spark, sf_dir))
    predicted = ml.predictions_by_cohort(ml.training_frame(ctx), common.TRAINED_ON, labels.OVERALL)
    return resample.cohort_matrix(resample.cohort_effect(resample.keep_confusion(predicted, ["trained_on"])), common.TRAINED_ON).select(*MATRIX_COLUMNS)


# ---------------------------------------------------------------------------
# SQL twins
# ---------------------------------------------------------------------------


def _confusion_sql(algo: str, gold: str, label_type: str, group, out: str = "cnt") -> str:
    g = ", ".join(group)
    return f""",
{out}_u AS (SELECT {g}, note_id, source FROM {algo} UNION ALL SELECT {g}, note_id, source FROM {gold}),
{out}_n AS (SELECT {g}, note_id, bool_or(source = '{label_type}') AS a, bool_or(source = 'gold') AS g FROM {out}_u GROUP BY {g}, note_id),
{out} AS (SELECT {g}, count_if(a AND g) AS TP, count_if(NOT a AND g) AS FN, count_if(a AND NOT g) AS FP FROM {out}_n GROUP BY {g})"""


DEN_SQL = f""",
den_0 AS (SELECT note_id, cse FROM texts),
den_1 AS ({es.overall("den_0")}),
den AS (SELECT cse, count(DISTINCT note_id) AS N FROM den_1 GROUP BY cse)"""

_COUNTS = EVAL_PREFIX + _nl_sql("gold") + _nl_sql("rule_based") + _confusion_sql("nl_rule_based", "nl_gold", "rule_based", KEYS)

ORACLES["bootstrap_note_metrics"] = _COUNTS + DEN_SQL + "," + bs.replicates("cnt", KEYS) + "," \
    + bs.metric_rows("reps", ["cse"], "den", rep=True) \
    + "\nSELECT rep, label_name, label_value, cse, TP, FN, FP, Support, PPV, Sensitivity, F1, TN, Specificity FROM fin"

ORACLES["bootstrap_ci"] = _COUNTS + DEN_SQL + "," + bs.with_intervals("cnt", ["cse"], "den") + """
SELECT *, TRY_CAST(split_part(F1, ' ', 1) AS DOUBLE) AS F1_parsed_value, nullif(regexp_extract(F1, '\\(.*\\)'), '') AS F1_parsed_ci FROM cell"""

ORACLES["stratified_bootstrap"] = EVAL_PREFIX + _nl_sql("gold", ("label_name", "cse")) + _nl_sql("rule_based", ("label_name", "cse")) \
    + _confusion_sql("nl_rule_based", "nl_gold", "rule_based", ["label_name", "cse"]) + """,
own AS (SELECT * FROM cnt WHERE cse <> 'Overall' AND label_name <> 'Total'),""" + bs.zero_safe_intervals("own", [], "cse") \
    + "\nSELECT metric, method, value, CI FROM out"

_PREDICTED = EVAL_PREFIX + f""",
gold AS ({common.method_sql("gold")}),
pred AS ({common.fixed_predictions_sql("gold")})"""

_BY_MODEL = ["trained_on", "cse"]
_KEPT = _PREDICTED + f""",
pa AS ({es.aggregated("pred")}),
po AS ({es.overall("pa")}),
cnt AS (SELECT trained_on, label_name, label_value, cse, count_if(to_keep AND gold_to_keep) AS TP, count_if(NOT to_keep AND gold_to_keep) AS FN,
               count_if(to_keep AND NOT gold_to_keep) AS FP FROM po GROUP BY ALL)"""

_EFFECT = """,
tot AS (SELECT trained_on, cse AS validated_on, lower(split_part(label_value, ' ', 1)) AS method, PPV, Sensitivity, F1 FROM cell WHERE label_name = 'Total'),
lg AS (SELECT * FROM tot UNPIVOT INCLUDE NULLS (cell FOR metric IN (PPV, Sensitivity, F1))),
eff AS (SELECT trained_on, validated_on, method, metric, TRY_CAST(split_part(cell, ' ', 1) AS DOUBLE) AS value,
               nullif(regexp_extract(cell, '\\(.*\\)'), '') AS CI, cell FROM lg)"""

ORACLES["cross_cohort_intervals"] = _KEPT + "," + bs.with_intervals("cnt", _BY_MODEL) + _EFFECT \
    + "\nSELECT trained_on, validated_on, method, metric, value, CI FROM eff"

ORACLES["cross_cohort_interval_matrix"] = _KEPT + "," + bs.with_intervals("cnt", _BY_MODEL) + _EFFECT + f"""
SELECT validated_on, method, metric, {", ".join(f"first(cell) FILTER (WHERE trained_on = '{c}') AS {c}" for c in common.TRAINED_ON)}
FROM eff GROUP BY validated_on, method, metric"""


def _note_level(name: str, flag: str) -> str:
    src = f"(SELECT * REPLACE ({flag} AS to_keep) FROM pred)"
    return f""",
{name}_0 AS (SELECT trained_on, label_name, cse, note_id, max(label_value) AS label_value FROM {src} WHERE to_keep GROUP BY ALL),
{name}_1 AS ({es.aggregated(f"{name}_0")}),
{name}_2 AS ({es.overall(f"{name}_1")}),
{name} AS (SELECT *, '{"ml" if flag == "to_keep" else "gold"}' AS source FROM {name}_2)"""


ORACLES["cross_cohort_note_intervals"] = _PREDICTED + _note_level("na", "to_keep") + _note_level("ng", "gold_to_keep") \
    + _confusion_sql("na", "ng", "ml", ["trained_on", *KEYS]) + "," + bs.with_intervals("cnt", _BY_MODEL) + _EFFECT \
    + "\nSELECT trained_on, validated_on, method, metric, value, CI FROM eff"

ORACLES["cross_cohort_zero_safe"] = _KEPT + f""",
cr AS ({es.removed_aggregated("cnt")}),
cv AS (SELECT * EXCLUDE (label_value) RENAME (cse AS validated_on) FROM cr),""" + bs.zero_safe_intervals("cv", ["trained_on", "validated_on"]) \
    + "\nSELECT trained_on, validated_on, metric, method, value, CI FROM out"

ORACLES["same_cohort_bootstrap"] = _KEPT + f""",
own AS (SELECT * FROM cnt WHERE cse = trained_on AND cse <> 'Overall'),
cr AS ({es.removed_aggregated("own")}),
cv AS (SELECT * EXCLUDE (label_value, trained_on) FROM cr),""" + bs.zero_safe_intervals("cv", [], "cse") \
    + "\nSELECT metric, method, value, CI FROM out"
