"""Imports every job module so the registry is complete."""

from cohortflow.plans import (  # noqa: F401
    cohort_jobs, compare_jobs, eval_jobs, extra_jobs, ml_jobs, model_rows_jobs, report_jobs, resample_jobs, score_jobs, snippet_jobs, store_jobs, text_jobs)
from cohortflow.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
