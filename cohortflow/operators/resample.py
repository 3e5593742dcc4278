"""Bootstrap resampling and confidence intervals.

Replicates are a column (``rep``), not a loop: each count row is expanded to
B replicate rows with ``explode(sequence)`` (B is a small fixed parameter).
Every replicate draws its multinomial (TP, FN, FP) counts as two conditional
binomials, each the inverse of its distribution at a uniform number that is a
hash of (seed, draw, key, rep): the same on any engine and partitioning.  The
metric / average operators run once with ``rep`` in the grouping key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow import config
from cohortflow.functions.exprs import md5_int
from cohortflow.operators import metrics as mt
from cohortflow.operators.labels import TOTAL, add_aggregated_label, add_overall, remove_aggregated_label
from cohortflow.session import settled

#: Up to so many trials a binomial is inverted term by term; beyond, by the normal quantile with a correction
#: for skewness (at least 1000 trials: off by less than a hundredth of the standard deviation).
EXACT_TRIALS = 1000


def uniform(*parts) -> Column:
    """A number inside (0, 1) from a hash of the parts."""
    return (md5_int(*parts) + F.lit(0.5)) / F.lit(float(16 ** 8))


def normal_quantile(u: Column) -> Column:
    """Inverse of the standard normal distribution by rational approximation (relative error 1.2e-9)."""
    # FIXED VALUES: coefficients of the published approximation (centre: a / b; tails: c / d)
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)

    def poly(coefficients, x):
        out = F.lit(coefficients[0])
        for k in coefficients[1:]:
            out = out * x + F.lit(k)
        return out

    def tail(v):
        t = F.sqrt(F.lit(-2.0) * F.log(v))
        return poly(c, t) / poly(d, t)

    m = u - F.lit(0.5)
    return F.when(u < 0.02425, tail(u)).when(u > 1 - 0.02425, -tail(F.lit(1.0) - u)).otherwise(poly(a, m * m) * m / poly(b, m * m))


def with_binomial(df: DataFrame, out: str, n: Column, p: Column, u: Column) -> DataFrame:
    """df with ``out``: the number k for which the distribution function of ``n`` trials of chance ``p``
    first reaches ``u``.  Chances above a half are drawn by the misses, which keeps the first term above 0."""
    d = df.withColumn("_n", n.cast("long")).withColumn("_p", p)
    d = d.withColumn("_q", F.least("_p", F.lit(1.0) - F.col("_p"))).withColumn("_v", F.when(F.col("_p") <= 0.5, u).otherwise(F.lit(1.0) - u))
    n, q, v = F.col("_n"), F.col("_q"), F.col("_v")
    none = F.pow(F.lit(1.0) - q, n)
    state = lambda k, term, total: F.struct(k.cast("long").alias("k"), term.cast("double").alias("term"), total.cast("double").alias("total"))

    def step(s, i):
        term = s["term"] * ((n - i + 1) / i) * (q / (F.lit(1.0) - q))
        return F.when(s["total"] >= v, s).otherwise(state(i, term, s["total"] + term))

    exact = F.aggregate(F.when((n > 0) & (n <= EXACT_TRIALS), F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<long>")),
                        state(F.lit(0), none, none), step)["k"]
    z = normal_quantile(v)
    rough = F.floor(n * q + z * F.sqrt(n * q * (F.lit(1.0) - q)) + (F.lit(1.0) - q * 2) * (z * z - 1) / 6 + 0.5)
    hits = F.when(n <= EXACT_TRIALS, exact).otherwise(F.greatest(F.lit(0).cast("long"), F.least(n, rough)))
    return d.withColumn(out, F.when(F.col("_p") <= 0.5, hits).otherwise(n - hits).cast("long")).drop("_n", "_p", "_q", "_v")


def replicate_counts(stats: DataFrame, key_cols: list[str], iterations: int = config.BOOTSTRAP_ITERATIONS,
                     seed: int = config.SEED) -> DataFrame:
    """B1: (rep, key..., TP, FN, FP) -- ``iterations`` resamples of each row: n = TP+FN+FP outcomes
    with the observed shares."""
    rep = F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("rep")
    r = stats.select(*key_cols, *[F.col(c).cast("long").alias(c) for c in ("TP", "FN", "FP")], rep)
    share = lambda x, of: F.coalesce(F.try_divide(x.cast("double"), of.cast("double")), F.lit(0.0))
    n, rest = F.col("TP") + F.col("FN") + F.col("FP"), F.col("FN") + F.col("FP")
    r = with_binomial(r, "_tp", n, share(F.col("TP"), n), uniform(F.lit(seed), F.lit("first"), *key_cols, "rep"))
    r = with_binomial(r, "_fn", n - F.col("_tp"), share(F.col("FN"), rest), uniform(F.lit(seed), F.lit("second"), *key_cols, "rep"))
    return r.select("rep", *key_cols, F.col("_tp").alias("TP"), F.col("_fn").alias("FN"), (n - F.col("_tp") - F.col("_fn")).alias("FP"))


def bootstrap_metric_table(stats: DataFrame, group_cols: list[str], label_cols=("label_name", "label_value"),
                           iterations: int = config.BOOTSTRAP_ITERATIONS, seed: int = config.SEED,
                           with_specificity: bool = False, denominators: DataFrame | None = None) -> DataFrame:
    """Per replicate, the metrics of every label row plus the
    micro / macro / weighted averages (label rows only are resampled; the
    averages are recomputed per replicate).  Long replicate table."""
    keys = list(label_cols) + list(group_cols)
    base = stats.filter(F.col("label_name") != "Total")
    reps = replicate_counts(base, keys, iterations, seed)
    den = None
    if denominators is not None:
        den = denominators.select("*", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("rep"))
    m = mt.classification_metrics(reps, den, with_specificity)
    return mt.add_avg_metrics(m, group_cols=list(group_cols) + ["rep"], with_specificity=with_specificity,
                              denominators=den, label_cols=label_cols)


def one_decimal(x: Column) -> Column:
    """One decimal, halves up."""
    return F.format_string("%.1f", F.floor(x * 10 + 0.5) / 10)


def _interval(lo: Column, hi: Column) -> Column:
    """``"(lo - hi)"``, NULL where there is no interval."""
    return F.when(lo.isNotNull() & hi.isNotNull(), F.concat(F.lit("("), one_decimal(lo), F.lit(" - "), one_decimal(hi), F.lit(")")))


def confidence_intervals(reps: DataFrame, keys: list[str], metrics: list[str],
                         q=config.CI_QUANTILES) -> DataFrame:
    """Linear-interpolated quantiles per key and metric, plus the
    ``"(lo - hi)"`` string (1 decimal)."""
    aggs = []
    for m in metrics:
        # one undefined replicate leaves the metric without an interval
        whole = F.count(m) == F.count(F.lit(1))
        aggs += [F.when(whole, F.percentile(m, q[k])).alias(f"{m}_{end}") for k, end in enumerate(("lo", "hi"))]
    ci = reps.groupBy(*keys).agg(*aggs)
    return ci.select(*keys, *[c for m in metrics for c in (f"{m}_lo", f"{m}_hi")],
                     *[_interval(F.col(f"{m}_lo"), F.col(f"{m}_hi")).alias(f"{m}_ci") for m in metrics])


def with_ci(point: DataFrame, ci: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Point metrics joined with their intervals, formatted
    ``"v (lo - hi)"``."""
    j = point.join(ci, keys, "left")
    cell = {m: F.when(F.col(m).isNotNull(), F.concat_ws(" ", one_decimal(F.col(m)), F.col(f"{m}_ci")))
            for m in metrics}  # NULL for an undefined metric, the value alone without an interval
    return j.select(*keys, *[cell[m].alias(m) for m in metrics], *[F.col(m).alias(f"{m}_value") for m in metrics])


# ---------------------------------------------------------------------------
# A30 / A31 (study's zero-safe scheme) and B4
# ---------------------------------------------------------------------------

def all_metrics(stats: DataFrame, group_cols=()) -> DataFrame:
    """A30 + A31: micro (every label, rare ones included), macro (mean over
    non-rare labels, divided by the number of labels with support) and
    support-weighted (non-rare) PPV / Sensitivity / F1 / Support.  Long
    output: group..., method, metric, value."""
    g = list(group_cols)
    ms = ["PPV", "Sensitivity", "F1", "Support"]
    per = mt.zero_safe_metrics(stats.groupBy(*g, "label_name").agg(*[F.sum(c).cast("double").alias(c) for c in ("TP", "FP", "FN")]))
    micro = mt.zero_safe_metrics(per.groupBy(*g).agg(*[F.sum(c).alias(c) for c in ("TP", "FP", "FN")])).select(*g, F.lit("micro").alias("method"), *ms)
    nr = per.filter(~F.col("label_name").isin(["Total"] + config.RARE_COMORBS))
    n_lab = F.count_if(F.col("Support") > 0).cast("double")
    macro = nr.groupBy(*g).agg(*[F.try_divide(F.sum(m), n_lab).alias(m) for m in ms]) \
        .withColumn("method", F.lit("macro"))
    weighted = nr.groupBy(*g).agg(*[F.try_divide(F.sum(F.col(m) * F.col("Support")), F.sum("Support")).alias(m)
                                    for m in ms]).withColumn("method", F.lit("weighted"))
    wide = micro.unionByName(macro).unionByName(weighted)
    return wide.unpivot(g + ["method"], ms, "metric", "value")


def zero_safe_intervals(stats: DataFrame, keys=(), stratify: str | None = None,
                        iterations: int = config.BOOTSTRAP_ITERATIONS, seed: int = config.SEED) -> DataFrame:
    """A31 with intervals for every group of ``keys``: point values of the true counts, quantiles over
    the replicates.  With ``stratify`` the rows of each stratum are resampled, then summed per label (B4).
    Output keys, metric, method, value, CI."""
    k = list(keys)
    stats = settled(stats)
    point = all_metrics(stats, k)
    reps = replicate_counts(stats, [*k, *([stratify] if stratify else []), "label_name"], iterations, seed)
    summed = reps.groupBy(*k, "rep", "label_name").agg(*[F.sum(c).alias(c) for c in ("TP", "FP", "FN")])
    ci = confidence_intervals(all_metrics(summed, [*k, "rep"]), [*k, "method", "metric"], ["value"]).withColumnRenamed("value_ci", "CI")
    return point.join(ci, [*k, "method", "metric"]).select(*k, "metric", "method", "value", "CI")


def stratified_bootstrap(stats: DataFrame, stratify: str = "cse", iterations: int = config.BOOTSTRAP_ITERATIONS,
                         seed: int = config.SEED) -> DataFrame:
    """Resample each (stratum, label) row, sum per label over strata,
    compute A31 per replicate; point values on the summed true counts;
    output metric, method, value, CI."""
    return zero_safe_intervals(stats, (), stratify, iterations, seed)


# ---------------------------------------------------------------------------
# Metrics with intervals (B3, C6-C8) and per training cohort
# ---------------------------------------------------------------------------

INTERVAL_METRICS = ["PPV", "Sensitivity", "F1"]


def metrics_with_intervals(counts: DataFrame, group_cols: list[str], denominators: DataFrame | None = None,
                           iterations: int = config.BOOTSTRAP_ITERATIONS, seed: int = config.SEED) -> DataFrame:
    """Point metrics and averages of a confusion table, each as ``"v (lo - hi)"`` (and ``<metric>_value``);
    Specificity too where the denominators are known."""
    specific = denominators is not None
    keys, names = ["label_name", "label_value", *group_cols], INTERVAL_METRICS + (["Specificity"] if specific else [])
    counts = settled(counts.select(*keys, "TP", "FN", "FP"))
    point = mt.add_avg_metrics(mt.classification_metrics(counts, denominators, specific), group_cols, with_specificity=specific, denominators=denominators)
    reps = bootstrap_metric_table(counts, group_cols, iterations=iterations, seed=seed, with_specificity=specific, denominators=denominators)
    return with_ci(point, confidence_intervals(reps, keys, names), keys, names)


def keep_confusion(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Confusion counts of keep flags on the gold spans (A28 counts) for each key of ``by`` that is not
    a label or cohort, with the aggregated labels and the Overall cohort.
    predictions: by..., label_name, label_value, cse, gold_to_keep, to_keep."""
    keys = [*by, "label_name", "label_value", "cse"]
    # counted first, rolled up afterwards: the roll-up sees labels, not entities
    k, g = F.col("to_keep"), F.col("gold_to_keep")
    c = predictions.groupBy(*keys).agg(F.count_if(k & g).alias("TP"), F.count_if(~k & g).alias("FN"), F.count_if(k & ~g).alias("FP"))
    return add_overall(add_aggregated_label(c)).groupBy(*keys).agg(*[F.sum(x).alias(x) for x in ("TP", "FN", "FP")])


def cohort_effect(counts: DataFrame, iterations: int = config.BOOTSTRAP_ITERATIONS, seed: int = config.SEED) -> DataFrame:
    """The averages of every model on every cohort with their intervals, from the confusion counts of
    all models (trained_on, label_name, label_value, cse) in one grouped job; the training cohort, Overall
    among them, is a key.  Output trained_on, validated_on, method, metric, value, CI."""
    cells = metrics_with_intervals(counts, ["trained_on", "cse"], None, iterations, seed).filter(F.col("label_name") == TOTAL)
    long = cells.select("trained_on", F.col("cse").alias("validated_on"), F.lower(F.substring_index("label_value", " ", 1)).alias("method"),
                        *INTERVAL_METRICS).unpivot(["trained_on", "validated_on", "method"], INTERVAL_METRICS, "metric", "cell")
    value, ci = (F.nullif(F.regexp_extract("cell", p, 1), F.lit("")) for p in (r"^\s*([-0-9.]+)", r"(\([^)]*\))"))  # P25
    return long.select("trained_on", "validated_on", "method", "metric", value.try_cast("double").alias("value"), ci.alias("CI"))


def zero_safe_cohort_effect(counts: DataFrame, iterations: int = config.BOOTSTRAP_ITERATIONS, seed: int = config.SEED) -> DataFrame:
    """B6 by the zero-safe scheme (A30 / A31), labels collapsed: trained_on, validated_on, metric, method, value, CI."""
    c = remove_aggregated_label(settled(counts.filter(F.col("label_name") != TOTAL))).withColumnRenamed("cse", "validated_on")
    return zero_safe_intervals(c.drop("label_value"), ["trained_on", "validated_on"], None, iterations, seed)


def same_cohort_effect(counts: DataFrame, iterations: int = config.BOOTSTRAP_ITERATIONS, seed: int = config.SEED) -> DataFrame:
    """B4 over models that are validated on the cohort that trained them, resampled per cohort."""
    own = counts.filter((F.col("cse") == F.col("trained_on")) & (F.col("cse").isin(config.CSE_PROJECTS)) & (F.col("label_name") != TOTAL))
    return zero_safe_intervals(remove_aggregated_label(settled(own)).drop("label_value", "trained_on"), (), "cse", iterations, seed)


def cohort_matrix(effect: DataFrame, cohorts: list[str]) -> DataFrame:
    """One row per (validated_on, method, metric), one column ``v (lo - hi)`` per training cohort."""
    cell = F.concat_ws(" ", one_decimal(F.col("value")), "CI")
    return effect.groupBy("validated_on", "method", "metric").pivot("trained_on", cohorts).agg(F.first(F.when(F.col("value").isNotNull(), cell)))
