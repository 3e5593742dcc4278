"""Plug-in scorers, code sheets and the artifact store on small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortflow.operators import metrics, ml, plugin, reports
from cohortflow.sources import artifacts, sheets

SPANS = "note_id long, context string, span_start int, span_end int"


def test_plugin_scorer(spark):
    @plugin.scorer("length_or_nothing", "size int, batch int")
    def load():
        return lambda inputs: [(None if x is None else len(x), len(inputs)) for x in inputs]

    plugin.getter("as_it_is")(lambda: F.col("context"))
    rows = [(i, None if i == 3 else "x" * (i % 7), 0, 1) for i in range(50)]
    df = spark.createDataFrame(rows, SPANS).repartition(1)
    got = plugin.score(df, "length_or_nothing", "as_it_is", outer=20, inner=8).collect()
    assert sorted((r.note_id, r.size) for r in got) == [(i, None if i == 3 else i % 7) for i in range(50)]
    assert {r.batch for r in got} == {8, 4, 2}  # two outer batches of 20 and one of 10
    named = plugin.score(df, "length_or_nothing", "as_it_is", setter={"size": "n"})
    assert named.columns == ["note_id", "context", "span_start", "span_end", "n"]
    assert plugin.score(df.limit(0), "length_or_nothing", "as_it_is").count() == 0
    marked = plugin.score(spark.createDataFrame([(1, "a bc d", 2, 4)], SPANS), "word_balance").first()
    assert marked.n_words == 5  # a, E, bc, E, d

    @plugin.scorer("too_few", "size int")
    def short():
        return lambda inputs: [(1,)]

    with pytest.raises(Exception, match="predictions for"):
        plugin.score(df, "too_few", "as_it_is").collect()


def test_code_sheets(spark, tmp_path):
    rows = [("a", "C1", "x, \"y\"", "1", "Principal"), ("a", None, "no code", "1", "Fille"), ("b", "C2", None, "2", "Fille"), ("c", "C3", "z", "1", "Fille")]
    root = str(tmp_path / "sheets")
    sheets.write_sheets(spark.createDataFrame(rows, "sheet string, code string, libelle string, status string, hierarchie string"), root)
    got = sheets.read_sheets(spark, root, {"one": ["a", "b"], "two": ["missing"]}).collect()
    assert sorted((r.code, r.comorb) for r in got) == [("C1", "one"), ("C2", "one")]
    with pytest.raises(Exception, match="several owners"):
        sheets.read_sheets(spark, root, {"one": ["a"], "two": ["a"]}).collect()


def test_texts_survive_the_export(spark, tmp_path):
    texts = [(1, "c1", 'line\none, "two"\n\n; three '), (2, "c1", ""), (3, "c2", "a\\b\tc")]
    t = spark.createDataFrame(texts, "note_id long, cse string, note_text string")
    out = str(tmp_path / "csv")
    artifacts.export_per_cohort(t.select("note_id", "cse"), t, out)
    assert sorted((int(r.note_id), r.cse, r.note_text or "") for r in artifacts.read_csv(spark, out).collect()) == texts


def test_best_settings_and_metrics(spark):
    runs = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.9), ("d", 0.1)], "setting string, f1 double")
    assert [r.setting for r in ml.best_settings(runs, 3).collect()] == ["c", "a", "b"]
    flags = spark.createDataFrame([(True, True), (True, False), (False, False)], "p boolean, y boolean")
    r = metrics.binary_metric(flags, "p", "y").first()
    assert (r.tp, r.fp, r.fn, r.tn) == (1, 1, 0, 1) and r.precision == pytest.approx(0.5, abs=1e-6) and r.accuracy == pytest.approx(2 / 3, abs=1e-6)


def test_report_tables(spark):
    per = spark.createDataFrame([("cse200093", "inpatient", "IDM", 3, 1.25), ("Overall", "outpatient", "Cancer", 0, None)],
                                "cse string, patient_type string, label_name string, n_docs_normal long, mean_entity_per_doc double")
    got = {r.label_name: r for r in reports.condition_table(per).collect()}
    assert got["IDM"].cse200093_inpatient == "3 (1.3)" and got["IDM"].Overall_outpatient == "0" and got["Cancer"].Overall_outpatient == "0"
    cols = reports.condition_table(per).columns
    assert cols.index("cse180032_inpatient") < cols.index("cse200055_inpatient") < cols.index("cse200093_outpatient") < cols.index("Overall_inpatient")
    m = spark.createDataFrame([("IDM", "1", "cse180032", 50.04, None)], "label_name string, label_value string, cse string, PPV double, F1 double")
    r = reports.cell_table(m, ["PPV", "F1"]).first()
    assert (r.cse180032_PPV, r.cse180032_F1, r.cse200093_PPV) == ("50.0", "-", "-")
