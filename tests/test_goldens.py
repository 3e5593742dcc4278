"""Hand-computed goldens (FIXTURES.md section 2) on small local frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortflow.operators import labels, metrics, ml, phenotype, reports, resample, scores, snippets
from cohortflow.operators import context, entities
from cohortflow.functions.exprs import age_years, strip_prefix


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_g1_exact_status_min_then_visit_max(spark):
    codes = spark.createDataFrame(
        [("E100", "x", "1:a", "diabetes", "Fille"), ("E102", "x", "2:b", "diabetes", "Fille"),
         ("E100", "x", "2:b", "diabetes", "Fille")], "code string, libelle string, status string, comorb string, hierarchie string")
    cond = spark.createDataFrame([(1, "E100"), (1, "E102"), (2, "Z00")], "visit_occurrence_id long, condition_source_value string")
    out = phenotype.visit_phenotypes(cond, codes)
    assert rows(out, "visit_occurrence_id", "status") == [(1, "2:b")]
    cmap = phenotype.exact_code_map(codes)
    assert rows(cmap, "code", "status") == [("E100", "1:a"), ("E102", "2:b")]
    wide = phenotype.to_wide(spark.createDataFrame([(1,), (2,)], "visit_occurrence_id long"), out)
    assert {r["visit_occurrence_id"]: r["cim10_diabetes"] for r in wide.collect()} == {1: "2:b", 2: "0:Absence"}


def test_regex_map_is_unanchored_substring(spark):
    codes = spark.createDataFrame([("I21", "x", "1:a", "myocardial_infarction", "Principal")],
                                  "code string, libelle string, status string, comorb string, hierarchie string")
    cond = spark.createDataFrame([(1, "I210"), (2, "XI21"), (3, "I2")], "visit_occurrence_id long, condition_source_value string")
    assert rows(phenotype.regex_code_map(codes, cond), "code") == [("I210",), ("XI21",)]
    assert rows(phenotype.regex_code_map(codes, cond, anchored=True), "code") == [("I210",)]


@pytest.mark.parametrize("method", ["first_reached", "window"])
def test_g2_history_equal_starts_see_each_other(spark, method):
    v = spark.createDataFrame([(1, 10, dt.datetime(2020, 1, 1)), (2, 10, dt.datetime(2020, 2, 1)),
                               (3, 10, dt.datetime(2020, 2, 1))],
                              "visit_occurrence_id long, person_id long, visit_start_datetime timestamp")
    vs = spark.createDataFrame([(1, "c", 1), (2, "c", 0), (3, "c", 2)], "visit_occurrence_id long, comorb string, severity int")
    out = phenotype.history_phenotypes(v, v, vs, method=method, comorbs=["c"])
    assert rows(out, "visit_occurrence_id", "severity") == [(1, 1), (2, 2), (3, 2)]


def test_g3_strip_prefix(spark):
    df = spark.createDataFrame([("CIM10:I21",)], "c string")
    assert df.select(strip_prefix("c").alias("x")).first()["x"] == "I21"


def _ents(spark, data):
    return spark.createDataFrame(
        [("Diabète", "1", "c1", "inpatient", n, b, e, True) for n, b, e in data],
        "label_name string, label_value string, cse string, patient_type string, note_id long, "
        "offset_begin int, offset_end int, to_keep boolean")


def test_g4_entity_overlap_metrics(spark):
    gold = _ents(spark, [(1, 0, 5), (1, 10, 15)])
    algo = _ents(spark, [(1, 5, 9), (1, 30, 35), (2, 1, 2)])
    out = metrics.entity_metrics(algo, gold, bin_width=4)
    r = [x for x in out.collect() if x["cse"] == "c1" and x["label_value"] == "1" and x["label_name"] == "Diabète"][0]
    assert (r["TP"], r["FP"], r["Support"], r["FN"]) == (1, 2, 2, 1)
    assert r["PPV"] == pytest.approx(100 / 3) and r["Sensitivity"] == pytest.approx(50) and r["F1"] == pytest.approx(40)


def test_g5_entity_quirk_fn_negative(spark):
    gold = _ents(spark, [(1, 0, 10)])
    algo = _ents(spark, [(1, 0, 3), (1, 5, 8)])
    r = [x for x in metrics.entity_metrics(algo, gold).collect()
         if x["cse"] == "c1" and x["label_name"] == "Diabète" and x["label_value"] == "1"][0]
    assert (r["TP"], r["Support"], r["FN"]) == (2, 1, -1)
    assert r["PPV"] == pytest.approx(100) and r["Sensitivity"] == pytest.approx(100)


def test_g6_note_metrics_with_specificity(spark):
    mk = lambda src, notes: spark.createDataFrame(
        [("L", "1", "c", "inpatient", n, src) for n in notes],
        "label_name string, label_value string, cse string, patient_type string, note_id long, source string")
    den = spark.createDataFrame([("c", "inpatient", 50)], "cse string, patient_type string, N long")
    out = metrics.note_metrics(mk("ml", [1, 2]), mk("gold", [1, 3]), "ml", den)
    r = [x for x in out.collect() if x["label_name"] == "L"][0]
    assert (r["TP"], r["FP"], r["FN"], r["TN"]) == (1, 1, 1, 47)
    assert r["PPV"] == pytest.approx(50) and r["F1"] == pytest.approx(50)
    assert r["Specificity"] == pytest.approx(97.9166666, rel=1e-6)


def test_g7_micro_macro_weighted(spark):
    st = spark.createDataFrame([("A", "1", "c", 1, 1, 1), ("B", "1", "c", 3, 0, 1)],
                               "label_name string, label_value string, cse string, TP long, FP long, FN long")
    out = metrics.add_avg_metrics(metrics.classification_metrics(st), group_cols=["cse"])
    got = {r["label_value"]: r for r in out.collect() if r["label_name"] == "Total"}
    assert got["Micro average"]["PPV"] == pytest.approx(80)
    assert got["Micro average"]["Sensitivity"] == pytest.approx(200 / 3)
    assert got["Micro average"]["F1"] == pytest.approx(72.7272727)
    assert got["Macro average"]["PPV"] == pytest.approx(75)
    assert got["Macro average"]["Sensitivity"] == pytest.approx(62.5)
    assert got["Macro average"]["F1"] == pytest.approx(67.8571428)
    assert got["Weighted average"]["PPV"] == pytest.approx(83.3333333)
    assert got["Weighted average"]["Sensitivity"] == pytest.approx(200 / 3)
    assert got["Weighted average"]["F1"] == pytest.approx(73.8095238)


def test_g8_zero_safe(spark):
    st = spark.createDataFrame([(0, 0, 3)], "TP long, FP long, FN long")
    r = metrics.zero_safe_metrics(st).first()
    assert (r["PPV"], r["Sensitivity"], r["F1"], r["Support"]) == (0.0, 0.0, 0.0, 3)


def test_g9_g10_concat_snippets(spark):
    e = spark.createDataFrame([("L", 1, 10, 14), ("L", 1, 20, 25), ("L", 1, 100, 105), ("L", 2, 3, 6)],
                              "label_name string, note_id long, offset_begin int, offset_end int")
    n = spark.createDataFrame([(1, "a" * 200), (2, "b" * 10)], "note_id long, note_text string")
    out, txt = snippets.concat_snippets(e, n, 20)
    got = rows(out, "note_id", "offset_begin", "snippet_num", "new_offset_begin", "new_offset_end")
    assert got == [(1, 10, 1, 10, 14), (1, 20, 1, 20, 25), (1, 100, 2, 79, 84), (2, 3, 1, 3, 6)]
    lens = {r["note_id"]: len(r["snippet_note_text"]) for r in txt.collect()}
    assert lens == {1: 128, 2: 44}


def test_g11_note_infos(spark):
    d = spark.createDataFrame([(1, 100, 110)], "note_id long, offset_begin int, offset_end int")
    n = spark.createDataFrame([(1, "".join(chr(65 + i % 26) for i in range(500)))], "note_id long, note_text string")
    r = snippets.add_note_infos(d, n).first()
    text = "".join(chr(65 + i % 26) for i in range(500))
    assert r["snippet"] == text[0:310] and r["lexical_variant"] == text[100:110]


def test_g12_status_fallback(spark):
    df = spark.createDataFrame([("Maladies du Rein", 2), ("Diabète", 2)], "l string, s int")
    got = [r["x"] for r in df.select(entities.status_label(F.col("l"), F.col("s")).alias("x")).collect()]
    assert got == ["True", "2:Avec atteintes d'organes"]


def test_g13_overall_and_aggregated(spark):
    df = spark.createDataFrame([("c1", "A", "1"), ("c2", "B", "1")], "cse string, label_name string, label_value string")
    assert labels.add_overall(df).count() == 4
    d2 = spark.createDataFrame([("Diabète", "1")], "label_name string, label_value string")
    assert rows(labels.add_aggregated_label(d2), "label_value") == [("1",), ("3",)]


def test_g14_g15_charlson(spark):
    lab = spark.createDataFrame([("c", 1, "ml", "Cancer", "2"), ("c", 1, "ml", "Leucemie", "1"),
                                 ("c", 1, "ml", "Diabète", "1"), ("c", 1, "ml", "Démence", "1")],
                                "cse string, note_id long, source string, label_name string, label_value string")
    assert scores.charlson_scores(lab, spark).first()["score"] == 8
    from cohortflow.sources import dims
    w = dims.charlson_weights(spark, "quan").filter("label_name = 'Diabète'")
    assert rows(w, "label_value", "weight") == [("1", 0), ("2", 1)]


def test_g16_ci_quantiles(spark):
    reps = spark.createDataFrame([("k", float(v)) for v in (1, 2, 3, 4)], "k string, F1 double")
    r = resample.confidence_intervals(reps, ["k"], ["F1"]).first()
    assert r["F1_lo"] == pytest.approx(1.075) and r["F1_hi"] == pytest.approx(3.925)
    assert r["F1_ci"] == "(1.1 - 3.9)"


def test_g17_age(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 2, 29), dt.datetime(1950, 3, 1))], "s timestamp, b timestamp")
    assert df.select(age_years("s", "b").alias("a")).first()["a"] == 70


def test_g18_clean_upsampled(spark):
    df = spark.createDataFrame([("SIDA-inpatient-7", "SIDA"), ("SIDA-inpatient-7", "Cancer")], "note_id string, label_name string")
    assert rows(entities.clean_upsampled(df), "label_name") == [("SIDA",)]


def test_g19_parse_ci(spark):
    df = spark.createDataFrame([("91.2 (88.0 - 95.0)",)], "m string")
    r = df.select(*reports.parse_ci("m")).first()
    assert r["value"] == pytest.approx(91.2) and r["ci"] == "(88.0 - 95.0)"


def test_g20_logits(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (-3.0,)], "z double")
    assert [r["y"] for r in df.select(ml.logits_to_label(F.col("z")).alias("y")).collect()] == [0, 1, 0]


def test_g21_sentence_neighbourhood(spark):
    text = "First one here. Second thing. Third."
    e = spark.createDataFrame([(1, 6, 9)], "note_id long, offset_begin int, offset_end int")
    n = spark.createDataFrame([(1, text)], "note_id long, note_text string")
    r = context.sentence_context(e, n, 1, 1).first()
    assert r["context"] == "First one here. Second thing."
    assert r["context"][r["span_start"]:r["span_end"]] == "one"


def test_g22_param_grid():
    got = ml.crossed_settings([{"a": [1, 2], "b": ["x", "y"]}, {"c": [7, 8, 9]}])
    assert len(got) == 6 and {"a": 1, "b": "x", "c": 7} in got and {"a": 2, "b": "y", "c": 9} in got
