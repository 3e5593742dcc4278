"""Registered evaluation jobs (C6, C7, C8, C10 and their parts)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow import config
from cohortflow.operators import cohort, labels, metrics, phenotype
from cohortflow.plans import common
from cohortflow.plans import eval_sql as es
from cohortflow.plans.cohort_jobs import REGEX_MAP_SQL, _visit_pheno_sql
from cohortflow.plans.registry import register, tables
from cohortflow.plans.sqlmodel import with_model
from cohortflow.session import settled
from cohortflow.sources import dims
from cohortflow.sources.tables import note_texts

G4 = ["label_name", "label_value", "cse", "patient_type"]

# ---------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------


class Eval:
    """Lazily built, shared pieces of one evaluation run."""

    def __init__(self, spark, sf_dir, predicted: DataFrame | None = None):
        self.spark = spark
        self.predicted = predicted
        self.t = tables(spark, sf_dir)

    # The corpus ids and the entity table feed every method, label table,
    # denominator and metric of the job: each is computed once, and only if
    # the job uses it, and checkpointed to the cluster's shared checkpoint
    # folder (reliable, lineage cut).  Both are narrow (no text).
    @cached_property
    def meta(self):
        return settled(common.texts(self.t, with_text=False))

    @cached_property
    def texts(self):
        """The corpus with its texts, from the ids chosen once."""
        return cohort.with_texts(self.t, self.meta)

    @cached_property
    def lengths(self):
        """note_id and length of the corpus texts, counted where the documents are read."""
        n = note_texts(self.t).select("note_id", F.length("note_text").alias("_n"))
        return self.meta.select("note_id").join(n, "note_id")

    @cached_property
    def rule(self):
        return settled(common.rule_entities_of(self.t, self.meta.select("note_id", "visit_occurrence_id", "cse", "patient_type")))

    def ents(self, method):
        """Entities with the method's keep flag; ``ml`` from the predictions given, else from the fixed ones."""
        if method == "ml" and self.predicted is not None:
            return self.predicted
        return common.method_entities(self.t, method, base=self.rule)

    def note_labels(self, method, group=("label_name", "cse", "patient_type")):
        return labels.note_labels(self.ents(method), method, group)

    def claim_labels(self):
        codes = dims.icd10_codes(self.spark)
        vsev = phenotype.visit_severity(cohort.conditions(self.t), codes, via_regex=True)
        inp = self.meta.filter(F.col("patient_type") == "inpatient")
        return labels.claim_labels(vsev, inp)

    def denominators(self, keys=("cse", "patient_type"), inpatient_only=False):
        tx = self.meta.filter(F.col("patient_type") == "inpatient") if inpatient_only else self.meta
        return metrics.note_denominators(tx, keys)

    def side_by_side(self, group=("label_name", "cse")):
        gl = self.note_labels("gold")
        return labels.side_by_side(self.note_labels("ml"), gl, self.claim_labels(),
                                   self.note_labels("rule_based"), label_type="ml", group_columns=group)


@register("note_labels_rule_based")
def note_labels_rule_based(spark, sf_dir):
    """A6 + A20 + A19: note-level labels of the rule-based method."""
    return Eval(spark, sf_dir).note_labels("rule_based").select(
        "label_name", "cse", "patient_type", "note_id", "label_value", "source")


@register("claim_note_labels")
def claim_note_labels(spark, sf_dir):
    """Claim labels per inpatient note."""
    return Eval(spark, sf_dir).claim_labels().select("note_id", "cse", "label_name", "label_value", "source")


@register("note_metrics_rule_based")
def note_metrics_rule_based(spark, sf_dir):
    """C7 note part: rule-based vs gold at note level with specificity and
    micro/macro/weighted averages."""
    e = Eval(spark, sf_dir)
    return metrics.note_metrics(e.note_labels("rule_based"), e.note_labels("gold"), "rule_based",
                                e.denominators(), G4)


@register("note_metrics_claim")
def note_metrics_claim(spark, sf_dir):
    """C6 claim part: ICD-10 labels vs gold (inpatient notes)."""
    e = Eval(spark, sf_dir)
    return metrics.note_metrics(e.claim_labels(), e.note_labels("gold"), "icd10",
                                e.denominators(("cse",), inpatient_only=True), ["label_name", "label_value", "cse"])


@register("entity_metrics_rule_based")
def entity_metrics_rule_based(spark, sf_dir):
    """C7 entity part (A9/J10/J15 + averages), matching on the keep flag."""
    e = Eval(spark, sf_dir)
    return metrics.entity_metrics(e.ents("rule_based"), e.ents("gold"), G4, match_on_qualifier=True)


@register("entity_metrics_no_qual_kept")
def entity_metrics_no_qual_kept(spark, sf_dir):
    """A9 with ``match_on_qualifier=False`` (only kept entities compared),
    per cohort over both patient types."""
    e = Eval(spark, sf_dir)
    return metrics.entity_metrics(e.ents("no_qual"), e.ents("gold"), ["label_name", "label_value", "cse"],
                                  match_on_qualifier=False)


@register("side_by_side")
def side_by_side(spark, sf_dir):
    """Per (label, cse, note) flags of gold / nlp / rule_based / claim."""
    return Eval(spark, sf_dir).side_by_side()


@register("claim_vs_nlp")
def claim_vs_nlp(spark, sf_dir):
    """Among gold-positive notes, % found by NLP only / claims only."""
    return metrics.claim_vs_nlp(Eval(spark, sf_dir).side_by_side(), ["label_name", "cse"])


def prevalence_df(side: DataFrame, texts: DataFrame) -> DataFrame:
    """Per (cse, label, method) the share of inpatient notes
    flagged.  Counted per (cse, label) over the side-by-side flags, then
    spread over every cohort with a fixed-value pivot -- equivalent to the
    notes x labels grid of the study without building it."""
    inp = texts.filter(F.col("patient_type") == "inpatient").select("note_id", "cse")
    inp = labels.add_overall(inp)
    totals = inp.groupBy("cse").agg(F.count(F.lit(1)).alias("total"))
    s = side.join(inp, ["note_id", "cse"], "left_semi")
    cses = config.CSE_PROJECTS + [labels.OVERALL]
    wide = s.groupBy("label_name").pivot("cse", cses).agg(
        F.count_if("gold").alias("Gold"), F.count_if("nlp").alias("NLP"), F.count_if("claim").alias("Claim"))
    stack = F.explode(F.array(*[
        F.struct(F.lit(c).alias("cse"), F.lit(m).alias("method"), F.coalesce(F.col(f"{c}_{m}"), F.lit(0)).alias("N"))
        for c in cses for m in ("Gold", "NLP", "Claim")]))
    long = wide.select("label_name", stack.alias("x")).select("label_name", "x.*")
    return long.join(totals, "cse").select(
        "cse", "label_name", "method", "N", "total",
        (F.lit(100.0) * (F.col("N").cast("double") / F.col("total").cast("double"))).alias("prevalence"))


@register("prevalence")
def prevalence(spark, sf_dir):
    e = Eval(spark, sf_dir)
    return prevalence_df(e.side_by_side(), e.meta)


@register("qualifier_metrics_on_gold")
def qualifier_metrics_on_gold(spark, sf_dir):
    """Keep decisions of rule_based / no_qual on the gold spans."""
    e = Eval(spark, sf_dir)
    g = e.ents("gold").withColumnRenamed("to_keep", "gold_to_keep")
    # the methods' decisions on the same spans: matched on (note, label, begin)
    r = e.ents("rule_based").select("note_id", "label_name", "label_value", "offset_begin",
                                    F.col("to_keep").alias("rule_based_to_keep"))
    d = (g.join(r, ["note_id", "label_name", "label_value", "offset_begin"], "inner")
         .withColumn("no_qual_to_keep", F.lit(True)))
    return metrics.qualifier_metrics_on_gold(d, ["rule_based", "no_qual"])


@register("zero_safe_metrics")
def zero_safe_metrics(spark, sf_dir):
    """A30 + A31 (zero-safe micro / macro / weighted, long form) on the
    note-level confusion counts of the rule-based method."""
    e = Eval(spark, sf_dir)
    c = metrics.note_confusion(e.note_labels("rule_based", ("label_name", "cse")),
                               e.note_labels("gold", ("label_name", "cse")), "rule_based", ["label_name", "cse"])
    from cohortflow.operators import resample
    return resample.all_metrics(c, ["cse"])


# ---------------------------------------------------------------------------
# SQL side
# ---------------------------------------------------------------------------

EVAL_PREFIX = with_model("person", "strata", "visit_occurrence", "condition_occurrence", "clinical_note") + ",\n" \
    + common.TEXTS_SQL + ",\n" + common.ner_sql("texts")


def _nl_sql(method, group=("label_name", "cse", "patient_type")):
    g = ", ".join(group)
    return f""",
{method}_e AS ({common.method_sql(method)}),
nl_{method}_0 AS (SELECT {g}, note_id, max(label_value) AS label_value FROM {method}_e WHERE to_keep
                  GROUP BY {g}, note_id),
nl_{method}_1 AS ({es.aggregated(f"nl_{method}_0")}),
nl_{method}_2 AS ({es.overall(f"nl_{method}_1")}),
nl_{method} AS (SELECT *, '{method}' AS source FROM nl_{method}_2)"""


def _claim_sql():
    from cohortflow.plans.sqlmodel import MODEL
    return f""",
vp AS ({_visit_pheno_sql(REGEX_MAP_SQL)}),
cfg AS ({MODEL["comorb_cfg"]}),
cl_0 AS (SELECT DISTINCT t.note_id, t.cse, cfg.label_name, substr(vp.status, 1, 1) AS label_value
         FROM texts t JOIN vp ON vp.visit_occurrence_id = t.visit_occurrence_id
         JOIN cfg ON cfg.pipe_name = vp.comorb
         WHERE t.patient_type = 'inpatient' AND substr(vp.status, 1, 1) <> '0'),
cl_1 AS ({es.aggregated("cl_0")}),
cl_2 AS (SELECT *, 'icd10' AS source FROM cl_1),
nl_icd10 AS ({es.overall("cl_2")})"""


def _note_metrics_sql(algo_cte, label_type, group, inpatient_only=False, p="", final_select=True):
    """A8 + A11/A12 + averages as SQL; CTE names get the prefix ``p`` so the
    block can appear several times in one statement (final CTE ``{p}fin``)."""
    g = ", ".join(group)
    keys = [c for c in ("cse", "patient_type") if c in group]
    kj = " AND ".join(f"c.{k} = d.{k}" for k in keys)
    gold_filter = "WHERE patient_type = 'inpatient'" if label_type == "icd10" else ""
    tx_filter = "WHERE patient_type = 'inpatient'" if inpatient_only else ""
    num = ["Support", "PPV", "Sensitivity", "Specificity", "F1", "TP", "FP", "FN", "TN"]
    body = f""",
{p}u AS (SELECT {g}, note_id, source FROM {algo_cte} UNION ALL SELECT {g}, note_id, source FROM nl_gold {gold_filter}),
{p}pn AS (SELECT {g}, note_id, bool_or(source = '{label_type}') AS a, bool_or(source = 'gold') AS g
       FROM {p}u GROUP BY {g}, note_id),
{p}cnt AS (SELECT {g}, count_if(a AND g) AS TP, count_if(a AND NOT g) AS FP, count_if(NOT a AND g) AS FN
        FROM {p}pn GROUP BY {g}),
{p}tx0 AS (SELECT note_id, {", ".join(keys)} FROM texts {tx_filter}),
{p}tx1 AS ({es.overall(f"{p}tx0")}),
{p}den AS (SELECT {", ".join(keys)}, count(DISTINCT note_id) AS N FROM {p}tx1 GROUP BY {", ".join(keys)}),
{p}cn AS (SELECT c.*, d.N FROM {p}cnt c LEFT JOIN {p}den d ON {kj}),
{p}m AS (SELECT * EXCLUDE (N) FROM ({es.with_metrics(f"{p}cn", True, "N - (TP + FP + FN)")})),
{p}fin AS ({es.avg_metrics(f"{p}m", keys, num, with_specificity=True)})"""
    if final_select:
        body += f"\nSELECT {g}, {', '.join(num)} FROM {p}fin"
    return body


def _entity_metrics_sql(algo_cte, group, match_on_qualifier=True):
    g = ", ".join(group)
    kq = ["to_keep"] if match_on_qualifier else []
    ek = list(group) + ["note_id", "offset_begin", "offset_end"] + kq
    filt = "WHERE to_keep" if not match_on_qualifier else ""
    on = " AND ".join([f"y.{c} = x.{c}" for c in list(group) + ["note_id"] + kq]
                      + ["x.offset_begin <= y.offset_end", "y.offset_begin <= x.offset_end"])

    def keyed(name, src):
        return f"{name}_k AS (SELECT {', '.join(ek)}, count(*) AS n FROM {src} {filt} GROUP BY ALL)"

    def side(name, other):
        return f"{name}_h AS (SELECT x.*, EXISTS (SELECT 1 FROM {other}_k y WHERE {on}) AS hit FROM {name}_k x)"

    keys = [c for c in ("cse", "patient_type") if c in group]
    fj = " AND ".join(f"p.{c} = r.{c}" for c in group)
    num = ["PPV", "TP", "FP", "Sensitivity", "Support", "FN", "F1"]
    return f""",
aa AS ({es.aggregated(algo_cte)}),
ga AS ({es.aggregated("gold_e")}),
{keyed("a", "aa")},
{keyed("g", "ga")},
{side("a", "g")},
{side("g", "a")},
p0 AS (SELECT {g}, CAST(sum(CASE WHEN hit THEN n ELSE 0 END) AS BIGINT) AS TP, CAST(sum(n) AS BIGINT) AS TPFP
       FROM a_h GROUP BY {g}),
p1 AS ({es.overall("p0")}),
p AS (SELECT {g}, {es.pct("sum(TP)", "sum(TPFP)")} AS PPV, CAST(sum(TP) AS BIGINT) AS TP,
             CAST(sum(TPFP) - sum(TP) AS BIGINT) AS FP FROM p1 GROUP BY {g}),
r0 AS (SELECT {g}, CAST(sum(CASE WHEN hit THEN n ELSE 0 END) AS BIGINT) AS tp, CAST(sum(n) AS BIGINT) AS S
       FROM g_h GROUP BY {g}),
r1 AS ({es.overall("r0")}),
r AS (SELECT {g}, {es.pct("sum(tp)", "sum(S)")} AS Sensitivity, CAST(sum(S) AS BIGINT) AS Support
      FROM r1 GROUP BY {g}),
st AS (SELECT {", ".join(f"coalesce(p.{c}, r.{c}) AS {c}" for c in group)}, p.PPV, p.TP, p.FP, r.Sensitivity,
              coalesce(r.Support, 0) AS Support FROM p FULL JOIN r ON {fj}),
st2 AS (SELECT *, Support - TP AS FN, {es.f1("PPV", "Sensitivity")} AS F1 FROM st),
fin AS ({es.avg_metrics("st2", keys, num)})
SELECT {g}, {", ".join(num)} FROM fin"""


def _side_sql(group=("label_name", "cse")):
    g = ", ".join(group)
    return (_nl_sql("gold") + _nl_sql("ml") + _nl_sql("rule_based") + _claim_sql() + f""",
su AS (SELECT {g}, note_id, source FROM nl_ml WHERE patient_type = 'inpatient'
       UNION ALL SELECT {g}, note_id, source FROM nl_gold WHERE patient_type = 'inpatient'
       UNION ALL SELECT {g}, note_id, source FROM nl_rule_based WHERE patient_type = 'inpatient'
       UNION ALL SELECT {g}, note_id, source FROM nl_icd10),
side AS (SELECT {g}, note_id, bool_or(source = 'gold') AS gold, bool_or(source = 'ml') AS nlp,
                bool_or(source = 'rule_based') AS rule_based, bool_or(source = 'icd10') AS claim
         FROM su GROUP BY {g}, note_id)""")


def _prevalence_sql():
    return _side_sql() + """,
inp0 AS (SELECT note_id, cse FROM texts WHERE patient_type = 'inpatient'),
inp AS (""" + es.overall("inp0") + """),
tot AS (SELECT cse, count(*) AS total FROM inp GROUP BY cse),
labs AS (SELECT DISTINCT label_name FROM side),
grid AS (SELECT i.note_id, i.cse, l.label_name FROM inp i, labs l),
j AS (SELECT g.cse, g.label_name, coalesce(s.gold, FALSE) AS gold, coalesce(s.nlp, FALSE) AS nlp,
             coalesce(s.claim, FALSE) AS claim
      FROM grid g LEFT JOIN side s ON s.note_id = g.note_id AND s.cse = g.cse AND s.label_name = g.label_name),
agg AS (SELECT cse, label_name, count_if(gold) AS Gold, count_if(nlp) AS NLP, count_if(claim) AS Claim,
               count(*) AS total FROM j GROUP BY cse, label_name)
SELECT cse, label_name, method, N, total, 100.0 * (CAST(N AS DOUBLE) / CAST(total AS DOUBLE)) AS prevalence
FROM (SELECT * FROM agg UNPIVOT INCLUDE NULLS (N FOR method IN (Gold, NLP, Claim)))"""


def _qual_sql():
    from cohortflow.plans.eval_sql import avg_metrics, overall, with_metrics
    rows = []
    for m in ("rule_based", "no_qual"):
        rows.append(f"""q_{m}_c AS (SELECT label_name, label_value, cse,
            count_if({m}_to_keep AND gold_to_keep) AS TP, count_if(NOT {m}_to_keep AND gold_to_keep) AS FN,
            count_if({m}_to_keep AND NOT gold_to_keep) AS FP FROM qd2 GROUP BY label_name, label_value, cse),
q_{m}_m AS ({with_metrics(f"q_{m}_c")}),
q_{m} AS (SELECT *, '{m}' AS method FROM ({avg_metrics(f"q_{m}_m", ["cse"],
                                                        ["TP", "FN", "FP", "Support", "PPV", "Sensitivity", "F1"])}))""")
    return f""",
gold_e AS ({common.method_sql("gold")}),
rb_e AS ({common.method_sql("rule_based")}),
qd AS (SELECT g.*, g.to_keep AS gold_to_keep, r.to_keep AS rule_based_to_keep, TRUE AS no_qual_to_keep
       FROM gold_e g JOIN rb_e r USING (note_id, label_name, label_value, offset_begin)),
qd0 AS (SELECT label_name, label_value, cse, gold_to_keep, rule_based_to_keep, no_qual_to_keep FROM qd),
qd1 AS ({es.aggregated("qd0")}),
qd2 AS ({overall("qd1")}),
{", ".join(rows)}
SELECT label_name, label_value, cse, TP, FN, FP, Support, PPV, Sensitivity, F1, method FROM q_rule_based
UNION ALL SELECT label_name, label_value, cse, TP, FN, FP, Support, PPV, Sensitivity, F1, method FROM q_no_qual"""


def _zero_safe_sql():
    rare = "(" + ", ".join(f"'{x}'" for x in ["Total"] + config.RARE_COMORBS) + ")"

    def zs(src, lab="label_name, "):
        return f"""SELECT *, CASE WHEN TP + FP > 0 THEN 100.0 * (TP / (TP + FP)) ELSE 0.0 END AS PPV,
              CASE WHEN TP + FN > 0 THEN 100.0 * (TP / (TP + FN)) ELSE 0.0 END AS Sensitivity,
              CASE WHEN TP + FP > 0 AND TP + FN > 0 THEN 100.0 * ((2.0 * TP) / (2.0 * TP + FP + FN)) ELSE 0.0 END AS F1,
              TP + FN AS Support FROM {src}"""
    ms = ["PPV", "Sensitivity", "F1", "Support"]
    return (_nl_sql("rule_based", ("label_name", "cse")) + _nl_sql("gold", ("label_name", "cse")) + f""",
u AS (SELECT label_name, cse, note_id, source FROM nl_rule_based UNION ALL
      SELECT label_name, cse, note_id, source FROM nl_gold),
pn AS (SELECT label_name, cse, note_id, bool_or(source = 'rule_based') AS a, bool_or(source = 'gold') AS g
       FROM u GROUP BY ALL),
cnt AS (SELECT label_name, cse, count_if(a AND g) AS TP, count_if(a AND NOT g) AS FP, count_if(NOT a AND g) AS FN
        FROM pn GROUP BY ALL),
per0 AS (SELECT cse, label_name, CAST(sum(TP) AS DOUBLE) AS TP, CAST(sum(FP) AS DOUBLE) AS FP,
                CAST(sum(FN) AS DOUBLE) AS FN FROM cnt GROUP BY ALL),
per AS ({zs("per0")}),
tot AS (SELECT cse, sum(TP) AS TP, sum(FP) AS FP, sum(FN) AS FN FROM per GROUP BY cse),
mic AS (SELECT cse, 'micro' AS method, {", ".join(ms)} FROM ({zs("tot")})),
nr AS (SELECT * FROM per WHERE label_name NOT IN {rare}),
mac AS (SELECT cse, 'macro' AS method,
               {", ".join(f"sum({m}) / NULLIF(CAST(count_if(Support > 0) AS DOUBLE), 0) AS {m}" for m in ms)}
        FROM nr GROUP BY cse),
wei AS (SELECT cse, 'weighted' AS method,
               {", ".join(f"sum({m} * Support) / NULLIF(sum(Support), 0) AS {m}" for m in ms)}
        FROM nr GROUP BY cse),
w AS (SELECT * FROM mic UNION ALL SELECT * FROM mac UNION ALL SELECT * FROM wei)
SELECT * FROM w UNPIVOT INCLUDE NULLS (value FOR metric IN ({", ".join(ms)}))""")


def _install_sql():
    from cohortflow.plans.registry import ORACLES
    P = EVAL_PREFIX
    ORACLES["note_labels_rule_based"] = P + _nl_sql("rule_based") + """
SELECT label_name, cse, patient_type, note_id, label_value, source FROM nl_rule_based"""
    ORACLES["claim_note_labels"] = P + _claim_sql() + """
SELECT note_id, cse, label_name, label_value, source FROM nl_icd10"""
    ORACLES["note_metrics_rule_based"] = P + _nl_sql("gold") + _nl_sql("rule_based") + _note_metrics_sql(
        "nl_rule_based", "rule_based", G4)
    ORACLES["note_metrics_claim"] = P + _nl_sql("gold") + _claim_sql() + _note_metrics_sql(
        "nl_icd10", "icd10", ["label_name", "label_value", "cse"], inpatient_only=True)
    ORACLES["entity_metrics_rule_based"] = P + f""",
gold_e AS ({common.method_sql("gold")}),
rb_e AS ({common.method_sql("rule_based")})""" + _entity_metrics_sql("rb_e", G4, True)
    ORACLES["entity_metrics_no_qual_kept"] = P + f""",
gold_e AS ({common.method_sql("gold")}),
nq_e AS ({common.method_sql("no_qual")})""" + _entity_metrics_sql("nq_e", ["label_name", "label_value", "cse"], False)
    ORACLES["side_by_side"] = P + _side_sql() + "\nSELECT * FROM side"
    ORACLES["claim_vs_nlp"] = P + _side_sql() + f"""
SELECT label_name, cse,
       {es.pct("count_if(nlp AND NOT claim)", "count(*)")} AS pct_nlp_only,
       {es.pct("count_if(claim AND NOT nlp)", "count(*)")} AS pct_claim_only,
       count(*) AS Support
FROM side WHERE gold GROUP BY label_name, cse"""
    ORACLES["prevalence"] = P + _prevalence_sql()
    ORACLES["qualifier_metrics_on_gold"] = P + _qual_sql()
    ORACLES["zero_safe_metrics"] = P + _zero_safe_sql()


_install_sql()
