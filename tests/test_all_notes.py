"""Jobs without a corpus selection read every note, not the evaluation corpus alone."""

import pytest

import __spark_entry__ as E
from cohortflow.operators import cohort
from cohortflow.plans import common
from cohortflow.plans.registry import tables

SF = "/root/testdata/sf0.001"
PER_NOTE = ["token_attributes", "sentences"]
PER_ENTITY = ["entity_contexts", "entity_token_contexts", "snippet_entities", "snippet_texts", "gold_token_aligned"]


def _notes(df):
    return {r["note_id"] for r in df.select("note_id").distinct().collect()}


@pytest.mark.parametrize("name", PER_NOTE)
def test_every_note(spark, name):
    want = _notes(cohort.notes(tables(spark, SF)).filter("note_text <> ''"))
    assert want <= _notes(E.queries()[f"{name}_all_notes"](spark, SF))


@pytest.mark.parametrize("name", PER_ENTITY)
def test_notes_outside_the_corpus(spark, name):
    t = tables(spark, SF)
    corpus = _notes(common.texts(t, with_text=False))
    got = _notes(E.queries()[f"{name}_all_notes"](spark, SF))
    assert got - corpus and _notes(E.queries()[name](spark, SF)) <= got
    if name != "gold_token_aligned":
        assert got == _notes(common.rule_entities(t, common.all_texts(t)))
