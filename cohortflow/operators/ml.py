"""Keep/discard qualifier as distributed MLlib jobs.

The study fine-tunes a transformer on entity contexts; here the same task --
binary keep/discard of an entity from its marked context -- is an MLlib
pipeline (tokenizer, hashing TF, IDF, weighted logistic regression), fitted
with distributed aggregations and applied with ``transform`` (no Python on
the scoring path).  Splits are md5 buckets of the note id (note-disjoint,
reproducible), the hyper-parameter grid follows the study's rule (zip inside
a group, product across groups) and per-cohort models give the
cross-cohort matrix.
"""

from __future__ import annotations

import functools
import itertools
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow import config
from cohortflow.functions.exprs import md5_unit
from cohortflow.operators.metrics import binary_metric
from cohortflow.session import settled

POS_WEIGHT = 0.39


def marked_text(context: str = "context", start: str = "span_start", end: str = "span_end") -> Column:
    """Context with the entity wrapped in markers."""
    c, s, e = F.col(context), F.col(start), F.col(end)
    return F.concat(F.substring(c, 1, s), F.lit(" [E] "), F.substring(c, s + 1, e - s), F.lit(" [/E] "),
                    F.substring(c, e + 1, F.length(c)))


def training_frame(ctx: DataFrame, label_col: str = "to_keep", pos_weight: float = POS_WEIGHT) -> DataFrame:
    """M1 inputs: marked text, double label, class weight (positives x0.39)."""
    return ctx.select("*", marked_text().alias("model_text"),
                      F.col(label_col).cast("double").alias("label"),
                      F.when(F.col(label_col), F.lit(pos_weight)).otherwise(F.lit(1.0)).alias("weight"))


def split(df: DataFrame, key: str = "note_id", valid_share: float = 0.1, seed: int = config.SEED):
    """M2: note-disjoint train / validation split on an md5 bucket."""
    u = md5_unit(F.lit(seed), F.lit("split"), key)
    return df.filter(u >= valid_share), df.filter(u < valid_share)


def pipeline(num_features: int = 1 << 18, reg: float = 0.01, max_iter: int = 50,
             elastic: float = 0.0) -> Pipeline:
    """M1: tokenizer -> hashing TF -> IDF -> weighted logistic regression."""
    tok = RegexTokenizer(inputCol="model_text", outputCol="tokens", pattern=r"[^\p{L}\[\]/]+", toLowercase=True)
    tf = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=num_features)
    idf = IDF(inputCol="tf", outputCol="features")
    lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=reg,
                            elasticNetParam=elastic, maxIter=max_iter)
    return Pipeline(stages=[tok, tf, idf, lr])


def crossed_settings(groups: list[dict]) -> list[dict]:
    """M3: the values of a group go together, the groups are crossed:
    ``[{a:[1,2], b:[x,y]}, {c:[7,8,9]}]`` -> 6 settings."""
    together = [[list(zip(g, values)) for values in zip(*g.values())] for g in groups]
    return [dict(itertools.chain.from_iterable(choice)) for choice in itertools.product(*together)]


def with_features(ctx: DataFrame, num_features: int = 1 << 18, label_cols=("label", "weight", "to_keep")) -> DataFrame:
    """Hashed term frequencies of the marked contexts, written once for all fits that share them; the
    texts are read no more after this.  Every model weighs them by its own IDF (``classifier``)."""
    tok = RegexTokenizer(inputCol="model_text", outputCol="tokens", pattern=r"[^\p{L}\[\]/]+", toLowercase=True)
    tf = HashingTF(inputCol="tokens", outputCol="features", numFeatures=num_features)
    keep = [c for c in ("note_id", "cse", "label_name", "label_value", *label_cols) if c in ctx.columns]
    return tf.transform(tok.transform(ctx)).select(*keep, "features")


def classifier(reg: float = 0.01, max_iter: int = 50, elastic: float = 0.0) -> Pipeline:
    """The part of M1 after the hashed features: IDF and weighted logistic regression."""
    idf = IDF(inputCol="features", outputCol="weighted")
    lr = LogisticRegression(featuresCol="weighted", labelCol="label", weightCol="weight", regParam=reg,
                            elasticNetParam=elastic, maxIter=max_iter)
    return Pipeline(stages=[idf, lr])


def logits_to_label(z: Column) -> Column:
    """M5: sigmoid then round half to even (0.5 -> 0)."""
    return F.rint(F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).cast("int")


def argmax_label(logits: Column) -> Column:
    """M5 (multi-class): 0-based index of the largest logit."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def predict(model: PipelineModel, ctx: DataFrame, out_col: str = "ml_to_keep") -> DataFrame:
    """Score entity contexts; the keep flag comes from the logit (M5)."""
    base = [c for c in ctx.columns if c not in ("model_text", "tokens", "tf", "features", "rawPrediction",
                                                 "probability", "prediction")]
    scored = model.transform(ctx.select(*base, marked_text().alias("model_text")))
    z = vector_to_array("rawPrediction")[1]
    return scored.select(*base, z.alias("logit"), (logits_to_label(z) == 1).alias(out_col))


def one_prediction(pred: DataFrame, key: list[str], col: str = "ml_to_keep", differing: str = "fail") -> DataFrame:
    """One row per span key with its prediction and the number of rows
    (``dup``) it came from; predictions that differ raise an error, or with
    ``differing="least"`` a span is kept only if all its predictions keep it."""
    if differing == "least":
        return pred.groupBy(*key).agg(F.min(col).alias(col), F.count(F.lit(1)).alias("dup"))
    agree = F.min(col).eqNullSafe(F.max(col)) & ((F.count(col) == 0) | (F.count(col) == F.count(F.lit(1))))
    conflict = F.raise_error(F.concat_ws(" ", F.lit("predictions differ for span"), *[F.col(k).cast("string") for k in key]))
    return pred.groupBy(*key).agg(F.when(agree, F.min(col)).otherwise(conflict.cast("boolean")).alias(col),
                                  F.count(F.lit(1)).alias("dup"))


def in_few_parts(df: DataFrame) -> DataFrame:
    """A settled table in no more partitions than the cluster has cores.  Each step of a fit sends one gradient as long as
    the features per partition; in this form what a fit shuffles does not grow with its rows."""
    return df.coalesce(df.sparkSession.sparkContext.defaultParallelism)


def fit(train: DataFrame, **params) -> PipelineModel:
    """Fit the pipeline; the (small) training frame, cut from a settled table, is persisted
    for the optimizer's passes and released afterwards."""
    cols = ["model_text", "label", "weight"]
    data = in_few_parts(train.select(*cols)).persist()
    try:
        return pipeline(**params).fit(data)
    finally:
        data.unpersist()


def validate(model: PipelineModel, valid: DataFrame, label_col: str = "to_keep", by=()) -> DataFrame:
    """M6: binary metrics of a fitted model on a labelled set."""
    return binary_metric(predict(model, valid), "ml_to_keep", label_col, by=by)


def best_settings(table: DataFrame, n: int) -> DataFrame:
    """The n settings of highest F1, ties by setting number."""
    return table.orderBy(F.col("f1").desc(), "setting").limit(n)


def grid_search(train: DataFrame, valid: DataFrame, groups: list[dict], keep_best: int | None = None):
    """M3 + T6: fit every setting, score on the validation split; returns
    (settings table with f1/precision/recall, best model).  The hashed features are
    written once, the fits run side by side on them; the grid is a small fixed list."""
    train, valid = in_few_parts(settled(with_features(train))), settled(with_features(valid))
    settings = crossed_settings(groups)

    def one(p):
        model = classifier(**p).fit(train)
        z = vector_to_array("rawPrediction")[1]
        scored = model.transform(valid).withColumn("ml_to_keep", logits_to_label(z) == 1)
        return model, binary_metric(scored, "ml_to_keep", "to_keep").first()

    with ThreadPoolExecutor(min(4, len(settings))) as pool:
        done = list(pool.map(one, settings))
    rows = [(i, str(sorted(p.items())), float(r["f1"]), float(r["precision"]), float(r["recall"])) for i, (p, (_, r)) in enumerate(zip(settings, done))]
    table = train.sparkSession.createDataFrame(rows, "setting int, params string, f1 double, precision double, recall double")
    best = max(range(len(rows)), key=lambda i: (rows[i][2], -i))
    return (table if keep_best is None else best_settings(table, keep_best)), done[best][0]


def predictions_by_cohort(ctx: DataFrame, cohorts: list[str], overall: str, cohort_col: str = "cse", **params) -> DataFrame:
    """M4 + M7: one model per training cohort (``overall``: all of them), each scored on every validation
    note; one table with the training cohort as ``trained_on``, the labels as ``gold_to_keep`` and the
    predictions as ``to_keep``.  The fits share features written once (``with_features``) and run side by side."""
    train, valid = split(settled(with_features(ctx)))
    train = in_few_parts(train)

    def one(c):
        model = classifier(**params).fit(train if c == overall else train.filter(F.col(cohort_col) == c))
        z = vector_to_array("rawPrediction")[1]
        scored = model.transform(valid).withColumn("_keep", logits_to_label(z) == 1)
        return scored.withColumnRenamed("to_keep", "gold_to_keep").select(
            F.lit(c).alias("trained_on"), *[x for x in valid.columns if x not in ("to_keep", "features")], "gold_to_keep", F.col("_keep").alias("to_keep"))

    with ThreadPoolExecutor(len(cohorts)) as pool:
        parts = list(pool.map(one, cohorts))
    return functools.reduce(DataFrame.unionByName, parts)


def cross_cohort(ctx: DataFrame, cohorts: list[str], cohort_col: str = "cse", **params) -> DataFrame:
    """M4 + M7 + U9: one model per training cohort, each validated on every
    cohort's validation split; matrix validated_on x trained_on of F1."""
    predicted = predictions_by_cohort(ctx, cohorts, "", cohort_col, **params)
    met = binary_metric(predicted, "to_keep", "gold_to_keep", by=("trained_on", cohort_col))
    return met.withColumnRenamed(cohort_col, "validated_on").groupBy("validated_on").pivot("trained_on", cohorts).agg(F.first("f1"))
