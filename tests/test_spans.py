"""The one-pass text helpers against brute force, and joins that hold their promise."""

from __future__ import annotations

import random
import time

import pytest
import regex
from pyspark.sql import functions as F

from cohortflow.functions import spans as sp
from cohortflow.operators import context, entities, snippets
from cohortflow.operators.joins import checked_join, one_per_key

RNG = random.Random(3)
TERMS = ["heart", "heart failure", "failure", "renal  failure", "mi", "été", "b-cell", "no"]
CUES = {"negation": ["no", "without any"], "hypothesis": ["if"]}


def brute(text):
    """Leftmost-longest alternation, and cues searched again in each sentence prefix."""
    flex = lambda t: " +".join(map(regex.escape, t.split()))
    words = lambda ts: regex.compile(r"(?i)(?<!\p{L})(?:" + "|".join(flex(t) for t in sorted(ts, key=lambda t: (-len(" ".join(t.split())), t))) + r")(?!\p{L})")
    out = []
    for m in words(TERMS).finditer(text):
        pre = text[: m.start()]
        pre = pre[max(map(pre.rfind, sp.TERMINATORS)) + 1 :]
        out.append((*m.span(), [words(c).search(pre) is not None for c in CUES.values()]))
    return out


def test_lexicon_equals_alternation():
    lex = sp.Lexicon(TERMS, CUES, sp.Normaliser())
    bits = ["Heart", "heart", "failure", "FAILURE", " ", "  ", ". ", "\n", "renal", "mi", "mice", "Été", "b-cell", "no", "without", "any", "if", "x", ",", "!", "İ", "½"]
    for _ in range(400):
        text = "".join(RNG.choice(bits) + RNG.choice(["", " ", " "]) for _ in range(RNG.randrange(40)))
        assert [(b, e, f) for b, e, _, f in lex.find(text)] == brute(text), text
    assert lex.find("") == [] and lex.find("no terms here")[0][2] == [7]


def test_normalised_offsets_lead_to_the_original():
    n = sp.Normaliser(accents=True, blanks=True, pollution=(r"==+", r"#\w+"))
    text = "ﬁn  Été été ½ === Œuf #tag naïvé"
    a = n(text)
    assert len(n.mask(text)) == len(text) and "=" not in a.text and "tag" not in a.text
    for want, word in (("ﬁn", "fin"), ("Été", "ete"), ("été", "ete"), ("naïvé", "naive")):
        at = a.text.find(word) if want != "été" else a.text.rfind("ete")
        b, e = a.original(at, at + len(word))
        assert text[b:e] == want
    lex = sp.Lexicon(["été", "fin été"], {}, sp.Normaliser(accents=True))
    assert [text[b:e] for b, e, *_ in lex.find(text)] == ["ﬁn  Été", "été"]
    masked = sp.Lexicon(["heart failure"], {}, sp.Normaliser(pollution=(r"=+",)))
    assert [(b, e) for b, e, *_ in masked.find("heart ====\tx heart == failure")] == [(13, 29)]
    got = sp.pattern_spans({"w": regex.compile("e?te")}, sp.Normaliser(accents=True), "Œ Été")
    assert got == [("w", 2, 5)]


def test_cost_does_not_grow_with_terms_or_squares():
    text = " ".join(RNG.choice(["alpha", "beta", "heart", "gamma"]) for _ in range(40_000))

    def seconds(terms, t):
        lex, best = sp.Lexicon(terms, CUES, sp.Normaliser()), 9e9
        for _ in range(3):
            start = time.process_time()
            lex.find(t)
            best = min(best, time.process_time() - start)
        return best

    few = ["heart", *(f"t{i}" for i in range(20))]
    assert seconds([*few, *(f"u{i}" for i in range(2000))], text) < 2 * seconds(few, text) + 0.02
    assert seconds(few, text * 4) < 8 * seconds(few, text) + 0.02  # every fourth word is a match


def test_sentences_and_tokens():
    text = "One. Two!? three\nfour"
    starts, ends = sp.sentence_bounds(text)
    assert [text[a:z] for a, z in zip(starts, ends)] == ["One.", " Two!?", " three\n", "four"]
    assert sp.sentence_bounds("") == ([], [])
    b = text.index("three")
    assert sp.sentence_window((starts, ends), b, b + 5, 1, 0) == (4, 17)
    assert sp.token_window(sp.token_bounds(text), b, b + 5, 2) == (text.index("!"), len(text))
    ranks = sp.TokenRanks("a1 , b2 ; heart . c3 , d4", lambda t: t in ",;.")
    at = "a1 , b2 ; heart . c3 , d4".index("heart")
    assert ranks.around(at, at + 5, 2) == ("b2 ", "c3 ")
    assert ranks.around(at, at + 5, 2, count_excluded=True) == ("2 ", "c")


def test_contexts_of_given_spans(spark):
    notes = spark.createDataFrame([(1, "no Heart failure. If été,\nheart", 9), (2, None, 9), (3, "", 9)], "note_id long, note_text string, visit_occurrence_id long")
    found = entities.extract_entities(notes, lexicon=[("heart failure", "IDM", "1"), ("heart", "Cancer", "7"), ("heart", "Diabète", "2")], context=("sentence", 1, 0))
    got = sorted((r.offset_begin, r.label_name, r.status, r.negation, r.context, r.context[r.span_start : r.span_end]) for r in found.collect())
    assert got == [
        (3, "IDM", "True", True, "no Heart failure.", "Heart failure"),
        (26, "Cancer", "1:Solide", False, " If été,\nheart", "heart"),
        (26, "Diabète", "2:Avec atteintes d'organes", False, " If été,\nheart", "heart"),
    ]
    spans = spark.createDataFrame([(1, 4, 8, "x"), (1, 4, 8, "y"), (1, 20, 22, "z")], "note_id long, offset_begin int, offset_end int, tag string")
    grown = sorted((r.tag, r.token_begin, r.token_end) for r in context.expand_to_tokens(spans, notes).collect())
    assert grown == [("x", 3, 8), ("y", 3, 8), ("z", 20, 24)]
    t = context.token_arrays(notes).select("note_id", context.reassembled().alias("t"), F.size("tokens").alias("n")).collect()
    assert sorted((r.note_id, r.t) for r in t) == [(1, "no Heart failure. If été,\nheart"), (3, "")]
    empty = entities.extract_entities(notes.limit(0))
    assert empty.count() == 0 and context.sentence_context(spans.limit(0), notes).count() == 0


def test_recut_variants(spark):
    rows = spark.createDataFrame([("ﬁn", "fin"), ("éte", "été"), ("a", "b"), (None, "x")], "new_lexical_variant string, lexical_variant string")
    assert sorted(r.lexical_variant for r in snippets.variant_mismatches(rows).collect()) == ["b", "x"]
    ids = spark.createDataFrame([("Insuff.-Card-inpatient-12",)], "note_id string")
    assert snippets.note_id_parts(ids).first()[1:] == ("Insuff.-Card", "inpatient", 12)


def test_promised_joins(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (3, "d")], "k long, x string")
    right = spark.createDataFrame([(1, "p"), (2, "q"), (None, "r"), (None, "s")], "k long, y string")
    assert sorted(map(tuple, checked_join(left, right, ["k"], "left").collect()), key=str) == sorted([(1, "a", "p"), (1, "b", "p"), (None, "c", None), (3, "d", None)], key=str)
    for how in ("inner", "left"):
        with pytest.raises(Exception, match="several plans share the key 1"):
            checked_join(right, left, ["k"], how, what="plans").collect()
    with pytest.raises(Exception, match="several rows"):
        checked_join(left, right, ["k"], "inner", "1:1").collect()
    assert checked_join(left.filter("x > 'b'"), right, ["k"], "left", "1:1").count() == 2
    assert one_per_key(left.limit(0), ["k"]).count() == 0
    names = spark.createDataFrame([("IDM", {1: "a"}), ("IDM", {1: "b"})], "label_name string, statuses map<int,string>")
    ents = spark.createDataFrame([("IDM", 1)], "label_name string, status_int int")
    with pytest.raises(Exception, match="configuration rows"):
        entities.with_status(ents, names).collect()


def test_token_attributes_across_parts(spark, monkeypatch):
    """Attributes and begins of each token, also where a part ends inside a batch and texts hold no token."""
    monkeypatch.setattr(sp, "TEXTS", 2)
    texts = {1: " \tÉCOLE  Abcdefgh 123456!", 2: "", 3: " \n", 4: "x²Ⅷ été", 5: "ABCDEF"}
    notes = spark.createDataFrame([*texts.items(), (6, None)], "note_id long, note_text string").coalesce(1)
    got = {r["note_id"]: r for r in context.token_arrays(notes).collect()}
    assert set(got) == set(texts)
    for k, text in texts.items():
        assert got[k]["head"] + "".join(t["text"] + t["blank"] for t in got[k]["tokens"]) == text
        assert all(text[t["begin"] : t["begin"] + len(t["text"])] == t["text"] for t in got[k]["tokens"])
    assert [(t["lower"], t["norm"], t["shape"]) for t in got[1]["tokens"]] == [
        ("école", "ecole", "XXXX"), ("abcdefgh", "abcdefgh", "Xxxxx"), ("123456", "123456", "dddd"), ("!", "!", "!")]


def test_emit_hands_rows_on_in_parts(spark, monkeypatch):
    """Rows of a text that are handed on in several batches are all there, each with its own source."""
    monkeypatch.setattr(sp, "HELD", 1000)
    df = spark.createDataFrame([(1, "ab" * 50), (2, "cd")], "note_id long, note_text string").coalesce(1)

    def rows(text):
        for i in range(len(text)):
            yield i, text * 5

    out = sp.emit(df, ["note_id"], ["note_text"], "i int, wide string", lambda: rows)
    assert out.count() == 102 and {(r["note_id"], r["i"]) for r in out.collect()} == {(1, i) for i in range(100)} | {(2, 0), (2, 1)}


def test_sliced_cuts_by_bytes(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(sp, "HELD", 10)
    b = pa.RecordBatch.from_pydict({"t": ["a" * 30, None, "b", "c" * 11, "d"]})
    assert [x.num_rows for x in sp.sliced([b], "t")] == [1, 3, 1]
