"""What is cut from a text is cut where the documents are read; no text is moved by the
snippets, the aligned gold spans and the gold contexts, and notes that repeat still meet all their texts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortflow.operators import cohort, context, entities, snippets
from cohortflow.plans import common, extra_jobs, ml_jobs, snippet_jobs
from cohortflow.plans.eval_jobs import Eval
from cohortflow.sources.tables import Tables, note_texts
from test_text_moves import SF, moves

TEXT = "no thing here. The thing was erble of ünïted\U0001F600 thing, not einau.\n" + 130 * "x " + "license thing thing\n" + 60 * "été " + "erble"


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("job", [snippet_jobs.snippet_entities, snippet_jobs.snippet_texts, snippet_jobs.snippet_variant_mismatches, extra_jobs.gold_token_aligned])
def test_jobs_move_no_text(spark, monkeypatch, job):
    plans = []
    for module in (snippet_jobs, extra_jobs, common):
        monkeypatch.setattr(module, "settled", lambda df: plans.append(df) or df)
    assert [moves(df, spark) for df in [job(spark, SF), *plans]] == [0] * (1 + len(plans)) and plans


def test_gold_contexts_move_no_text(spark):
    assert moves(ml_jobs._gold_contexts(Eval(spark, SF)), spark) == 0


def _again(t):
    """The tables with every id of a note twice, one of the two texts other than before, and some stays twice."""
    d, o = t.raw("documents").filter("doc_id < 40"), t.raw("orders")
    t._cache["documents"] = d.union(d.filter("doc_id % 3 = 0").withColumn("text", F.concat(F.lit(TEXT), "text")))
    t._cache["orders"] = o.union(o.filter("o_orderkey % 5 = 0"))
    return t


@pytest.mark.parametrize("repeat", [False, True])
def test_gold_token_aligned_as_with_the_texts(spark, monkeypatch, repeat):
    t = _again(Tables(spark, SF)) if repeat else Tables(spark, SF)
    monkeypatch.setattr(extra_jobs, "tables", lambda *_: t)
    g = common.perturb_gold(common.all_rule_entities(t))
    n = note_texts(t).select("note_id", F.length("note_text").alias("_n")).join(common.note_visits(t), "note_id")
    g = g.join(n.select("note_id", "_n"), "note_id").filter(F.col("offset_end") <= F.col("_n"))
    want = context.expand_to_tokens(g.select("note_id", "label_name", "offset_begin", "offset_end"), common.all_texts(t))
    got = rows(extra_jobs.gold_token_aligned(spark, SF))
    assert got == rows(want) and got


@pytest.mark.parametrize("repeat", [False, True])
def test_gold_contexts_as_with_the_texts(spark, repeat):
    e = Eval(spark, SF)
    if repeat:
        e.meta = e.meta.union(e.meta.filter("note_id % 4 = 0")).localCheckpoint()
    g = e.ents("gold").join(e.lengths, "note_id").filter(F.col("offset_end") <= F.col("_n")).drop("_n")
    want = context.sentence_context(g, e.texts.select("note_id", "note_text"), 1, 1)
    got = rows(ml_jobs._gold_contexts(e))
    assert got == rows(want) and got


@pytest.mark.parametrize("repeat", [False, True])
def test_snippets_as_with_the_texts(spark, monkeypatch, repeat):
    t = Tables(spark, SF)  # not the shared ones
    if repeat:  # copies only: the places of texts that differ under one id are in no order
        d = t.raw("documents").filter("doc_id < 60")
        t._cache["documents"] = d.union(d.filter("doc_id % 3 = 0"))
    monkeypatch.setattr(snippet_jobs, "tables", lambda *_: t)
    e = common.all_rule_entities(t).select("label_name", "note_id", "offset_begin", "offset_end", "lexical_variant")
    want, texts = snippets.concat_snippets(e, common.all_texts(t), snippet_jobs.SNIPPET_LENGTH)
    cols = ["label_name", "note_id", "offset_begin", "offset_end", "snippet_num"]
    got = snippet_jobs.snippet_entities(spark, SF)
    assert rows(got.select(cols)) == rows(want.select(cols)) and got.filter("variant_ok").count() > 0
    assert rows(snippet_jobs.snippet_texts(spark, SF)) == rows(texts)
    if not repeat:
        assert rows(got.drop("variant_ok")) == rows(want.drop("lexical_variant", "new_lexical_variant"))


@pytest.mark.parametrize("length", [0, 1, 7, 40, 100])
def test_islands_of_windows_are_those_of_texts(spark, length):
    notes = spark.createDataFrame([(1, TEXT), (2, TEXT[20:] * 3), (3, "thing"), (4, "")], "note_id long, note_text string")
    e = entities.extract_entities(notes, context=("character", length / 2))
    cols = ["label_name", "note_id", "offset_begin", "offset_end", "lexical_variant"]
    own, texts = snippets.concat_snippets(e.select(*cols, "context_begin", "context"), None, length)
    want, want_texts = snippets.concat_snippets(e.select(cols), notes, length)
    assert rows(own) == rows(want) and rows(texts) == rows(want_texts) and own.count() > 20
    assert own.filter("new_lexical_variant <> lexical_variant").count() == 0


def test_once_and_again(spark):
    t = _again(Tables(spark, SF))
    once, again = common.once_and_again(t, common.note_visits(t).localCheckpoint())
    ids = {r["note_id"] for r in again.collect()}
    assert ids == {i for i in range(40) if i % 3 == 0 or i // 2 % 5 == 0}
    assert {r["note_id"] for r in once.collect()} == set(range(40)) - ids
    assert cohort.with_texts(t, once).count() == len(set(range(40)) - ids)
