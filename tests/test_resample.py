"""Draws against the binomial distribution, intervals and the matrix of training cohorts."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from cohortflow.operators import resample

KEYS = "label_name string, label_value string, cse string, TP long, FN long, FP long"


def quantile(n, p, u):
    """Smallest k whose distribution function reaches u, from log-factorials."""
    total = 0.0
    for k in range(n + 1):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + (k * math.log(p) if k else 0) + ((n - k) * math.log1p(-p) if n - k else 0))
        if total >= u:
            return k
    return n


def test_binomial_is_the_inverse(spark):
    cases = [(n, p, u) for n in (1, 2, 7, 60, 999) for p in (0.001, 0.2, 0.5) for u in (1e-9, 0.025, 0.31, 0.47, 0.975, 1 - 1e-9)]
    cases += [(0, 0.0, 0.5), (5, 0.0, 0.9), (5, 1.0, 0.1)]
    df = spark.createDataFrame(cases, "n long, p double, u double")
    got = {(r.n, r.p, r.u): r.x for r in resample.with_binomial(df, "x", F.col("n"), F.col("p"), F.col("u")).collect()}
    for (n, p, u), x in got.items():
        assert x == (0 if n == 0 or p == 0 else n if p == 1 else quantile(n, p, u)), (n, p, u)


def test_large_counts_follow_the_distribution(spark):
    df = spark.createDataFrame([(n, p, (i + 0.5) / 400) for n in (1001, 10**6, 10**12) for p in (0.01, 0.5, 0.97) for i in range(400)], "n long, p double, u double")
    for (n, p), g in resample.with_binomial(df, "x", F.col("n"), F.col("p"), F.col("u")).toPandas().groupby(["n", "p"]):
        sd = math.sqrt(n * p * (1 - p))
        assert abs(g["x"].mean() - n * p) < 0.02 * sd + 0.05 and abs(g["x"].std() / sd - 1) < 0.02
    near = spark.createDataFrame([(1000 + d, 0.3, u) for d in (0, 1) for u in (0.001, 0.1, 0.5, 0.9, 0.999)], "n long, p double, u double")
    both = {(r.n, r.u): r.x for r in resample.with_binomial(near, "x", F.col("n"), F.col("p"), F.col("u")).collect()}
    assert all(abs(both[(1001, u)] - quantile(1001, 0.3, u)) <= 1 and abs(both[(1000, u)] - both[(1001, u)]) <= 2 for u in (0.001, 0.1, 0.5, 0.9, 0.999))


def test_normal_quantile(spark):
    us = [1e-10, 0.01, 0.3, 0.5, 0.8, 0.99, 1 - 1e-10]
    got = [r.z for r in spark.createDataFrame([(u,) for u in us], "u double").select(resample.normal_quantile(F.col("u")).alias("z")).collect()]
    back = [0.5 * math.erfc(-z / math.sqrt(2)) for z in got]
    assert np.allclose(back, us, rtol=1e-7, atol=1e-15)


def test_replicates_draw_the_shares(spark):
    st = spark.createDataFrame([("A", "1", "c", 60, 30, 10), ("B", "1", "c", 0, 0, 0), ("C", "1", "c", 0, 4, 0), ("D", "1", "c", 10**10, 10**9, 10**8)], KEYS)
    reps = resample.replicate_counts(st, ["label_name", "label_value", "cse"], 500).toPandas()
    a = reps[reps.label_name == "A"]
    assert (a.TP + a.FN + a.FP == 100).all() and abs(a.TP.mean() - 60) < 1 and abs(a.FN.mean() - 30) < 1
    assert abs(np.cov(a.TP, a.FN)[0, 1] + 18) < 4  # -n p q
    assert (reps[reps.label_name == "B"][["TP", "FN", "FP"]] == 0).all(axis=None)
    assert (reps[reps.label_name == "C"].FN == 4).all()
    d = reps[reps.label_name == "D"]
    assert (d.TP + d.FN + d.FP == 11_100_000_000).all() and d.TP.nunique() > 400


def test_cohort_effect(spark):
    rows = [(t, lab, "1", c, tp, 5, 5) for t in ("Overall", "x") for c in ("Overall", "y") for lab, tp in (("IDM", 90), ("SIDA", 1), ("Cancer", 0))]
    counts = spark.createDataFrame(rows, "trained_on string, " + KEYS)
    eff = resample.cohort_effect(counts, iterations=50)
    got = {(r.trained_on, r.validated_on, r.method, r.metric): r for r in eff.collect()}
    assert len(got) == 2 * 2 * 3 * 3
    r = got[("x", "y", "micro", "PPV")]  # the rare label is left out: 90 of 100
    assert r.value == 90.0 and r.CI.startswith("(") and float(r.CI[1:].split(" - ")[0]) < 90 < float(r.CI[:-1].split(" - ")[1])
    wide = resample.cohort_matrix(eff, ["Overall", "x"]).filter("method = 'micro' and metric = 'PPV'").collect()
    assert sorted((w.validated_on, w.x) for w in wide) == [("Overall", f"90.0 {got[('x', 'Overall', 'micro', 'PPV')].CI}"), ("y", f"90.0 {r.CI}")]
    zs = resample.zero_safe_cohort_effect(counts, 20).filter("metric = 'Support' and method = 'micro'").collect()
    assert [z.value for z in zs] == [106.0] * 4
    assert resample.cohort_effect(counts.limit(0), 5).filter("value is not null").count() == 0
