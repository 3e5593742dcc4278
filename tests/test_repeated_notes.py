"""A note whose id comes twice meets its texts through a join; no other text is moved or searched for that."""

from __future__ import annotations

import pytest

from cohortflow.operators import cohort
from cohortflow.plans import common, extra_jobs, snippet_jobs
from cohortflow.sources.tables import Tables, note_texts

JOBS = [(snippet_jobs, snippet_jobs.snippet_entities), (snippet_jobs, snippet_jobs.snippet_texts),
        (snippet_jobs, snippet_jobs.snippet_variant_mismatches), (extra_jobs, extra_jobs.gold_token_aligned)]
TEXT = "There is no license for thing, and erble. " * 9


def _tables(spark):
    """Notes 0 to 11: note 3 comes twice, the stay of notes 8 and 9 too, and note 11 has no stay."""
    t = Tables(spark, "")
    documents = [(i, f"{i} {TEXT}") for i in [*range(12), 3]] + [(None, TEXT), (None, TEXT)]
    t._cache["documents"] = spark.createDataFrame(documents, "doc_id long, text string")
    t._cache["orders"] = spark.createDataFrame([(i,) for i in [*range(5), 4]], "o_orderkey long")
    return t


def _ids(df):
    return sorted(r["note_id"] for r in df.select("note_id").collect())


@pytest.mark.parametrize("module, job", JOBS, ids=[j.__name__ for _, j in JOBS])
def test_only_repeated_texts_meet_their_ids(spark, monkeypatch, module, job):
    t, met, real = _tables(spark), [], cohort.with_texts
    monkeypatch.setattr(module, "tables", lambda *_: t)
    monkeypatch.setattr(cohort, "with_texts", lambda t, ids: met.append([r["note_id"] for r in note_texts(t).collect()]) or real(t, ids))
    few = sorted(map(str, job(spark, "").collect()))
    monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    assert sorted(map(str, job(spark, "").collect())) == few and few
    assert sorted(met[0]) == [3, 3, 8, 9] and len(met) == 2 and len(met[1]) == t.raw("documents").count()


def test_documents_of_few_ids_are_not_shuffled(spark):
    t = _tables(spark)
    once, again = common.once_and_again(t, common.note_visits(t).localCheckpoint())
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = note_texts(common.with_documents_of(t, again))
        plan = texts._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert _ids(texts) == [3, 3, 8, 9] and not {3, 8, 9} & set(_ids(once))
