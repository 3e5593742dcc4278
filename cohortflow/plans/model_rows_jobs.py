"""Registered jobs around the model that SQL can check: split (M2), prediction to label (M5), binary metrics (A33), best runs
(T6), plug-in scoring (X9, F3, X12), rule qualification of given spans (X5), span collection (X10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortflow import config
from cohortflow.functions import spans as sp
from cohortflow.functions.exprs import md5_unit
from cohortflow.operators import context, entities, metrics, ml, plugin
from cohortflow.plans import common
from cohortflow.plans.eval_jobs import EVAL_PREFIX, Eval
from cohortflow.plans.extra_jobs import REGEX_PATTERNS
from cohortflow.plans.ml_jobs import ENT
from cohortflow.plans.registry import ORACLES, register, tables

_GOLD = EVAL_PREFIX + f""",
gold AS ({common.method_sql("gold")})"""
_PRED = _GOLD + f""",
pred AS ({common.fixed_predictions_sql("gold")})"""
_unit = common._md5_unit_sql


@register("training_split", sql=_GOLD + f"""
SELECT note_id, count(*) AS n, CASE WHEN {_unit(f"'{config.SEED}|split|' || CAST(note_id AS VARCHAR)")} >= 0.1 THEN 'train' ELSE 'validation' END AS part
FROM gold GROUP BY note_id""")
def training_split(spark, sf_dir):
    """M2: gold entities split by note; no note is on both sides."""
    train, valid = ml.split(Eval(spark, sf_dir).ents("gold"))
    both = train.withColumn("part", F.lit("train")).unionByName(valid.withColumn("part", F.lit("validation")))
    return both.groupBy("note_id", "part").agg(F.count(F.lit(1)).alias("n"))


@register("predicted_labels", sql=_GOLD + f""",
z AS (SELECT DISTINCT note_id, offset_begin, label_name, CASE WHEN note_id % 10 = 0 THEN 0.0
             ELSE 8.0 * {_unit("'z|' || CAST(note_id AS VARCHAR) || '|' || CAST(offset_begin AS VARCHAR)")} - 4.0 END AS logit FROM gold)
SELECT note_id, offset_begin, label_name, logit, CAST(1.0 / (1.0 + exp(-logit)) > 0.5 AS INTEGER) AS by_sigmoid,
       CASE WHEN -logit >= logit AND -logit >= 0.5 THEN 0 WHEN logit >= 0.5 THEN 1 ELSE 2 END AS by_argmax FROM z""")
def predicted_labels(spark, sf_dir):
    """M5: logits to labels by sigmoid and half-even rounding (0 gives 0), and by argmax over (-z, z, 0.5), the first of equals."""
    z = F.when(F.col("note_id") % 10 == 0, F.lit(0.0)).otherwise(8.0 * md5_unit(F.lit("z"), "note_id", "offset_begin") - 4.0)
    g = Eval(spark, sf_dir).ents("gold").select("note_id", "offset_begin", "label_name", z.alias("logit")).distinct()
    three = F.array(-F.col("logit"), F.col("logit"), F.lit(0.5))
    return g.select("*", ml.logits_to_label(F.col("logit")).alias("by_sigmoid"), ml.argmax_label(three).alias("by_argmax"))


_RUNS = _PRED + """,
c AS (SELECT trained_on, cse, count_if(to_keep AND gold_to_keep) AS tp, count_if(to_keep AND NOT gold_to_keep) AS fp,
             count_if(NOT to_keep AND gold_to_keep) AS fn, count_if(NOT to_keep AND NOT gold_to_keep) AS tn FROM pred GROUP BY ALL),
pr AS (SELECT *, tp / (tp + fp + 1e-7) AS precision, tp / (tp + fn + 1e-7) AS recall FROM c),
bm AS (SELECT *, 2 * precision * recall / (precision + recall + 1e-7) AS f1, (tp + tn) / (tp + tn + fp + fn + 1e-7) AS accuracy FROM pr)"""


def _runs(spark, sf_dir):
    return metrics.binary_metric(common.fixed_predictions(Eval(spark, sf_dir).ents("gold")), "to_keep", "gold_to_keep", by=("trained_on", "cse"))


@register("merged_predictions", sql=_PRED + """,
mine AS (SELECT * FROM pred WHERE trained_on = 'Overall'),
one AS (SELECT note_id, label_name, label_value, offset_begin, offset_end, any_value(to_keep) AS to_keep, count(*) AS dup FROM mine GROUP BY ALL)
SELECT g.note_id, g.label_name, g.label_value, g.offset_begin, g.offset_end, g.to_keep AS gold_to_keep, o.to_keep AS ml_to_keep, o.dup
FROM gold g JOIN one o USING (note_id, label_name, label_value, offset_begin, offset_end)""")
def merged_predictions(spark, sf_dir):
    """Fixed predictions merged back on the span key, one per span.  Gold rows that were moved onto one span may
    differ in their flag and so in their fixed prediction: such a span is kept only if all its predictions keep it."""
    gold = Eval(spark, sf_dir).ents("gold")
    mine = common.fixed_predictions(gold).filter(F.col("trained_on") == "Overall").withColumnRenamed("to_keep", "ml_to_keep")
    return gold.select(*ENT, F.col("to_keep").alias("gold_to_keep")).join(ml.one_prediction(mine, ENT, differing="least"), ENT)


@register("binary_metrics", sql=_RUNS + "\nSELECT * FROM bm")
def binary_metrics(spark, sf_dir):
    """A33 + M6: confusion totals, precision, recall, f1 and accuracy of each model (fixed predictions) on each cohort."""
    return _runs(spark, sf_dir)


@register("best_runs", sql=_RUNS + """
SELECT trained_on || ' on ' || cse AS setting, f1 FROM bm ORDER BY f1 DESC, setting LIMIT 3""")
def best_runs(spark, sf_dir):
    """The three best (model, cohort) runs by f1 (the limit is the operator)."""
    return ml.best_settings(_runs(spark, sf_dir).select(F.concat_ws(" on ", "trained_on", "cse").alias("setting"), "f1"), 3)


@register("plugin_scores")
def plugin_scores(spark, sf_dir):
    """X9 + F3 + X12: every entity with its sentences scored by the plug-in ``word_balance``; its fields assigned to columns."""
    ents = entities.extract_entities(common.all_texts(tables(spark, sf_dir)), qualify=False, context=("sentence", 0, 0))
    out = plugin.score(ents, "word_balance", get="context", setter={"logit": "plugin_logit", "n_words": "plugin_words"}, outer=500)
    return out.select(*ENT, "plugin_words", "plugin_logit", (ml.logits_to_label(F.col("plugin_logit")) == 1).alias("to_keep"))


def qualified_spans(spans, notes):
    """X5 (rules): negation, hypothesis and family of given spans: cues between the start of their sentence and them."""
    def make():
        cue = entities._lexicon((), tuple((k, tuple(v)) for k, v in zip(entities.CUE_KINDS, (config.NEGATION_CUES, config.HYPOTHESIS_CUES, config.FAMILY_CUES))), sp.Normaliser())

        def rows(text, begins, ends):
            return cue.flags(text, begins)
        return rows

    return sp.emit_beside(spans, notes, "negation boolean, hypothesis boolean, family boolean", make)


@register("gold_qualified", sql=_GOLD + f""",
gp AS (SELECT g.*, lower(regexp_extract(substr(t.note_text, 1, g.offset_begin), '[^.!?\\n]*\\z')) AS pre FROM gold g JOIN texts t USING (note_id))
SELECT note_id, label_name, label_value, offset_begin, offset_end, {", ".join(
    f"regexp_matches(pre, '{common._cue_re(c)}') AS {k}" for k, c in zip(entities.CUE_KINDS, (config.NEGATION_CUES, config.HYPOTHESIS_CUES, config.FAMILY_CUES)))} FROM gp""")
def gold_qualified(spark, sf_dir):
    """Rule qualifiers applied to the gold spans alone, without extraction."""
    e = Eval(spark, sf_dir)
    return qualified_spans(e.ents("gold").select(*ENT), e.texts)


@register("collected_spans")
def collected_spans(spark, sf_dir):
    """Dictionary entities, gold spans and addresses as span groups; all but the pollution group, each span once."""
    t = tables(spark, sf_dir)
    e = Eval(spark, sf_dir)
    cols = ["note_id", "label_name", "offset_begin", "offset_end"]
    bad = entities.regex_matches(e.texts, REGEX_PATTERNS).withColumnRenamed("label", "label_name")
    groups = [("ents", e.rule), ("gold", e.ents("gold")), ("pollutions", bad)]
    parts = [g.select(*cols, F.lit(n).alias("span_group")) for n, g in groups]
    return context.collect_spans(parts[0].unionByName(parts[1]).unionByName(parts[2])).select(*cols)


ORACLES["collected_spans"] = _GOLD + """
SELECT note_id, label_name, offset_begin, offset_end FROM rb UNION SELECT note_id, label_name, offset_begin, offset_end FROM gold"""


def _plugin_sql():
    from cohortflow.plans.ml_jobs import _SENT
    from cohortflow.plans.sqlmodel import with_model

    return with_model("clinical_note") + ",\n" + common.ALL_TEXTS_SQL + ",\n" + common.ner_sql("texts") + ",\n" + _SENT + """,
pe AS (SELECT r.note_id, r.label_name, r.label_value, r.offset_begin, r.offset_end, substr(t.note_text, min(s.b) + 1, max(s.e) - min(s.b)) AS ctx
       FROM rb r JOIN texts t USING (note_id) JOIN sent s ON s.note_id = r.note_id AND s.e > r.offset_begin AND s.b < r.offset_end
       GROUP BY r.note_id, r.label_name, r.label_value, r.offset_begin, r.offset_end, t.note_text),
pw AS (SELECT *, len(regexp_extract_all(ctx, '\\p{L}+')) AS n FROM pe)
SELECT note_id, label_name, label_value, offset_begin, offset_end, CAST(n AS INTEGER) AS plugin_words, 0.5 * n - 0.0625 * length(ctx) AS plugin_logit,
       0.5 * n - 0.0625 * length(ctx) > 0 AS to_keep FROM pw"""


ORACLES["plugin_scores"] = _plugin_sql()
