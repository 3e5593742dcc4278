"""Dictionary entity extraction and rule qualification (X1-X4, X11, X19,
P16-P18, P21).

One pass over the notes: in the task that reads them, every text yields its
matches (with code-point offsets) and what stands around them, and only those
rows leave the task.  No shuffle and no per-token rows; the cost does not
depend on the size of the lexicon (``functions.spans``).
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow import config
from cohortflow.functions import spans as sp
from cohortflow.functions.exprs import normalize_label_value
from cohortflow.operators.joins import checked_join

ENTITY_COLS = ["note_id", "label_name", "label_value", "offset_begin", "offset_end",
               "lexical_variant", "negation", "hypothesis", "family"]


#: Kinds of cue words, in the order of the flags.
CUE_KINDS = ("negation", "hypothesis", "family")


def status_names(spark) -> DataFrame:
    """label_name and its status labels by number (one row a comorbidity)."""
    rows = [(label, {int(k): str(v) for k, v in smap.items()}) for _pipe, label, _sel, smap, *_ in config.COMORBIDITIES]
    return spark.createDataFrame(rows, "label_name string, statuses map<int,string>")


def with_status(ents: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """J11 + P16: entities (label_name, status_int) with the label of their status; unknown
    statuses fall back to the status-1 label.  One configuration row a label, or the job fails."""
    names = status_names(ents.sparkSession) if names is None else names
    st = F.coalesce(F.col("statuses")[F.col("status_int")], F.col("statuses")[F.lit(1)])
    out = checked_join(ents, names, ["label_name"], "left", "m:1", small=True, what="configuration rows")
    return out.withColumn("status", st).drop("statuses")


def status_label(label_name: Column, status: Column) -> Column:
    """P16 as an expression over the fixed comorbidity list."""
    kv = []
    for _pipe, label, _sel, smap, *_ in config.COMORBIDITIES:
        for k, v in smap.items():
            kv += [F.lit(f"{label}|{k}"), F.lit(str(v))]
    m = F.create_map(*kv)
    return F.coalesce(m[F.concat_ws("|", label_name, status.cast("string"))],
                      m[F.concat_ws("|", label_name, F.lit("1"))])


@functools.lru_cache(maxsize=4)
def _lexicon(terms: tuple, cues: tuple, normaliser: sp.Normaliser) -> sp.Lexicon:
    """One automaton a worker, not a task."""
    return sp.Lexicon(terms, dict(cues), normaliser)


FOUND_FIELDS = ("label_name string, status_int int, offset_begin int, offset_end int, lexical_variant string, "
                "negation boolean, hypothesis boolean, family boolean")
CONTEXT_FIELDS = "context_begin int, context_end int, context string, span_start int, span_end int"


def window_of(kind: str, *sizes: int):
    """``text -> (begin, end) -> bounds`` of a neighbourhood: ("sentence", before, after), ("token", n) or
    ("character", n): n of them on each side, truncated toward zero and clipped to the text."""
    def of(text: str):
        if kind == "character":
            return lambda b, e: (max(0, int(b - sizes[0])), min(int(e + sizes[0]), len(text)))
        if kind == "sentence":
            bounds = sp.sentence_bounds(text)
            return lambda b, e: sp.sentence_window(bounds, b, e, *sizes)
        bounds = sp.token_bounds(text)
        return lambda b, e: sp.token_window(bounds, b, e, *sizes)
    if kind not in ("sentence", "token", "character"):
        raise ValueError(kind)
    return of


def extract_entities(notes: DataFrame, lexicon=None, qualify: bool = True, normaliser: sp.Normaliser = sp.Normaliser(),
                     keep: tuple[str, ...] = ("visit_occurrence_id",),
                     negation_cues=None, hypothesis_cues=None, family_cues=None, context: tuple | None = None) -> DataFrame:
    """X1 (+X2, X3, P16, P17): one row per dictionary match.

    notes: (note_id, note_text, *keep); lexicon: (term, label_name, status) rows
    Output: note_id, *keep, label_name, label_value ("0"/"1"/"2"), status
    (label of the status), offset_begin, offset_end (code points, end
    exclusive), lexical_variant, negation, hypothesis, family; with
    ``context`` (as in ``window_of``) also the match's neighbourhood.  A
    term of several lexicon rows yields a row for each.
    """
    make = _finder(lexicon, qualify, normaliser, negation_cues, hypothesis_cues, family_cues, context)
    keep = [k for k in keep if k in notes.columns]
    found = sp.emit(notes.filter(F.col("note_text").isNotNull()), ["note_id", *keep], ["note_text"],
                    FOUND_FIELDS + (", " + CONTEXT_FIELDS if context else ""), make)
    out = with_status(found)
    more = [f.split()[0] for f in CONTEXT_FIELDS.split(", ")] if context else []
    return out.select(
        "note_id", *keep, "label_name", normalize_label_value(F.col("status")).alias("label_value"), "status",
        "offset_begin", "offset_end", "lexical_variant", *CUE_KINDS, *more)


def entity_lists(notes: DataFrame) -> DataFrame:
    """note_id, note_text and ``_spans``, the text's matches as one array of FOUND_FIELDS (texts without one give
    no row).  The text stays where it is read, so that what derives from the matches can be cut from it there."""
    make = _finder(None, True, sp.Normaliser(), None, None, None, None)

    def lists():
        rows = make()
        return lambda text: [(found,)] if (found := list(rows(text))) else []

    fields = FOUND_FIELDS.replace(" ", ":").replace(",:", ",")
    return sp.emit(notes.filter(F.col("note_text").isNotNull()), ["note_id", "note_text"], ["note_text"],
                   f"_spans array<struct<{fields}>>", lists)


def _finder(lexicon, qualify, normaliser, negation_cues, hypothesis_cues, family_cues, context):
    """``make`` of ``sp.emit``: the FOUND_FIELDS of each match of a text, and its neighbourhood if one is asked for."""
    lexicon = [tuple(r) for r in (lexicon or config.LEXICON)]
    cues = {"negation": negation_cues or config.NEGATION_CUES, "hypothesis": hypothesis_cues or config.HYPOTHESIS_CUES,
            "family": family_cues or config.FAMILY_CUES}
    terms, cue_rows = tuple(t for t, _, _ in lexicon), tuple((k, tuple(v)) for k, v in cues.items())

    def make():
        lex = _lexicon(terms, cue_rows, normaliser)
        around = window_of(*context) if context else None

        def rows(text):
            found = lex.find(text)
            window = around(text) if around and found else None
            for begin, end, own, flags in found:
                more = ()
                if window:
                    b, e = window(begin, end)
                    more = (b, e, text[b:e], begin - b, end - b)
                for n in own:
                    yield (lexicon[n][1], int(lexicon[n][2]), begin, end, text[begin:end], *(flags if qualify else (None,) * 3), *more)
        return rows

    return make


def to_keep(method: str = "rule_based", model_col: str | None = None) -> Column:
    """rule_based = not(negation or family or hypothesis); no_qual =
    true; ml = the model's flag (the study's extra negation test is a no-op)."""
    if method == "rule_based":
        return ~(F.coalesce(F.col("negation"), F.lit(False)) | F.coalesce(F.col("family"), F.lit(False))
                 | F.coalesce(F.col("hypothesis"), F.lit(False)))
    if method == "no_qual":
        return F.lit(True)
    if method == "ml":
        return F.col(model_col or "to_keep")
    raise ValueError(method)


def clean_upsampled(df: DataFrame, rare=None) -> DataFrame:
    """On up-sampled snippets (note id naming a rare label) keep only
    entities of that label."""
    cond = F.lit(True)
    for r in (rare or config.RARE_COMORBS):
        cond = cond & ~(F.col("note_id").cast("string").contains(r) & (F.col("label_name") != r))
    return df.filter(cond)


def sentences(notes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """X11: one row per sentence (note_id, sent_idx, sent_begin, sent_end, sentence)."""
    keep = [k for k in keep if k in notes.columns]

    def rows(text):
        for i, (b, e) in enumerate(zip(*sp.sentence_bounds(text))):
            yield i, b, e, text[b:e]

    return sp.emit(notes.filter(F.col("note_text").isNotNull()), ["note_id", *keep], ["note_text"],
                   "sent_idx int, sent_begin int, sent_end int, sentence string", lambda: rows)


def regex_matches(notes: DataFrame, patterns: dict[str, list[str]], keep: tuple[str, ...] = (),
                  normaliser: sp.Normaliser = sp.Normaliser(lower=False)) -> DataFrame:
    """Labelled regex matcher (``{label: [patterns]}``) over the normalised text (X2), one row
    per match with offsets and wording of the original; every label is found in the same pass."""
    keep = [k for k in keep if k in notes.columns]
    joined = {label: "|".join(f"(?:{p})" for p in pats) for label, pats in patterns.items()}

    def make():
        compiled = {label: re.compile(p) for label, p in joined.items()}

        def rows(text):
            for label, b, e in sp.pattern_spans(compiled, normaliser, text):
                yield label, b, e, text[b:e]
        return rows

    return sp.emit(notes.filter(F.col("note_text").isNotNull()), ["note_id", *keep], ["note_text"],
                   "label string, offset_begin int, offset_end int, lexical_variant string", make)
