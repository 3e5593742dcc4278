"""Span-with-context extraction.

Spans that come from elsewhere (gold) travel to their note as one array a
note: the text is shuffled once, read once and never copied per span.  Spans
that extraction finds get their context in the same pass
(``extract_entities(context=...)``).
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortflow.functions import spans as sp
from cohortflow.functions import text as tx
from cohortflow.operators.entities import CONTEXT_FIELDS, window_of


def windows(kind: str, *sizes: int):
    """The row maker of the contexts: CONTEXT_FIELDS of each span."""
    of = window_of(kind, *sizes)

    def rows(text, begins, ends):
        window = of(text)
        for begin, end in zip(begins, ends):
            b, e = window(begin, end)
            yield b, e, text[b:e], begin - b, end - b
    return lambda: rows


def sentence_context(ents: DataFrame, notes: DataFrame, n_before: int = 1, n_after: int = 1) -> DataFrame:
    """W6 / X8 (sentence mode): the entity's sentence plus ``n_before`` /
    ``n_after`` neighbouring sentences (clipped at the document ends) and the
    span offsets inside that context."""
    return sp.emit_beside(ents, notes, CONTEXT_FIELDS, windows("sentence", n_before, n_after))


def token_context(ents: DataFrame, notes: DataFrame, n: int = 5) -> DataFrame:
    """W7 / X8 (token mode): ``n`` tokens before and after the entity
    (tokens = letter runs, digit runs or single symbols), original
    whitespace kept; span offsets inside the context."""
    return sp.emit_beside(ents, notes, CONTEXT_FIELDS, windows("token", n))


def included_token_context(ents: DataFrame, notes: DataFrame, excluded: str, n: int = 5, count_excluded: bool = False) -> DataFrame:
    """W7 with excluded tokens: tokens that match ``excluded`` as a whole are left out of the
    context; they use up places among the ``n`` only with ``count_excluded``.  The context is the
    included tokens with the blanks that follow each, the entity's own text between them."""
    def make():
        out = re.compile(excluded)

        def rows(text, begins, ends):
            ranks = sp.TokenRanks(text, lambda t: out.fullmatch(t) is not None)
            stops = [*ranks.starts, len(text)]
            for b, e in zip(begins, ends):
                before, after = ranks.around(b, e, n, count_excluded)
                own = text[b : stops[bisect_left(ranks.starts, e)]]  # with the blanks that follow it
                yield before + own + after, len(before), len(before) + e - b
        return rows

    return sp.emit_beside(ents, notes, "context string, span_start int, span_end int", make)


def collect_spans(spans: DataFrame, exclude_groups=("pollutions",), group_col: str = "span_group") -> DataFrame:
    """Spans of every group but the excluded ones, de-duplicated,
    ordered by (begin, end) inside each note."""
    s = spans
    if group_col in spans.columns:
        s = s.filter(~F.col(group_col).isin(list(exclude_groups)))
    return (s.dropDuplicates(["note_id", "offset_begin", "offset_end", "label_name"])
            .repartition("note_id").sortWithinPartitions("note_id", "offset_begin", "offset_end"))


def assign_predictions(df: DataFrame, pred_col: str = "prediction", mapping: dict | None = None) -> DataFrame:
    """Spread a struct of predictions into columns -- all fields, or the
    ``{field: column}`` mapping."""
    fields = df.schema[pred_col].dataType.fieldNames()
    mapping = mapping or {f: f for f in fields}
    return df.select(*[c for c in df.columns if c != pred_col],
                     *[F.col(f"{pred_col}.{k}").alias(v) for k, v in mapping.items()])


def token_arrays(notes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """note_id, ``head`` (blanks before the first token) and ``tokens``: an array of
    (text, lower, norm, shape, blank, begin) of the note's tokens; ``blank`` is what follows the token."""
    keep = [k for k in keep if k in notes.columns]
    src = notes.filter(F.col("note_text").isNotNull()).select("note_id", *keep, "note_text")
    own = T.StructType.fromDDL("head string, tokens array<struct<text:string,lower:string,norm:string,shape:string,blank:string,begin:int>>")
    schema = T.StructType([src.schema[c] for c in ("note_id", *keep)] + own.fields)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(own["tokens"].dataType).value_type
        fold = str.maketrans(tx.ACCENTS_FROM, tx.ACCENTS_TO)
        for part in sp.sliced(batches, "note_text"):
            heads, words, blanks, sizes = [], [], [], [0]
            for text in part.column("note_text").to_pylist():
                head, found = sp.token_attributes(text)
                heads.append(head)
                words += [w for w, _ in found]
                blanks += [x for _, x in found]
                sizes.append(len(found))
            # attributes are worked out once for each different token of the part
            words, blanks = pa.array(words, pa.string()).dictionary_encode(), pa.array(blanks, pa.string())
            seen, at = words.dictionary.to_pylist(), words.indices
            lower = [w.lower() for w in seen]
            each = [words.dictionary.take(at)] + [pa.array(x, pa.string()).take(at) for x in (lower, [w.translate(fold) for w in lower], [sp.shape(w) for w in seen])]
            stops = np.cumsum(sizes)
            steps = np.add(pc.utf8_length(each[0]).to_numpy(), pc.utf8_length(blanks).to_numpy(), dtype=np.int64)
            before = np.concatenate(([0], np.cumsum(steps)))  # characters of the part's tokens before each of them
            begins = before[:-1] + np.repeat(np.array([len(h) for h in heads], np.int64) - before[stops[:-1]], sizes[1:])
            tokens = pa.StructArray.from_arrays([*each, blanks, pa.array(begins.astype(np.int32))], fields=list(kind))
            lists = pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), tokens)
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("note_id", *keep)], pa.array(heads, pa.string()), lists], schema.fieldNames())

    return src.mapInArrow(run, schema)


def reassembled(attribute: str = "text") -> Column:
    """The text of ``token_arrays`` built again from an attribute of its tokens."""
    return F.concat("head", F.array_join(F.transform("tokens", lambda t: F.concat(t[attribute], t["blank"])), ""))


def token_attributes(notes: DataFrame) -> DataFrame:
    """X18 digests: per note the token count and digests of the LOWER and SHAPE texts put together
    again with the original blanks (the lower-cased one equals lower(text))."""
    t = token_arrays(notes.withColumn("_lower", F.md5(F.lower("note_text"))), keep=("_lower",))
    lower = F.md5(reassembled("lower"))
    return t.select("note_id", F.size("tokens").alias("n_tokens"), lower.alias("lower_md5"),
                    (lower == F.col("_lower")).alias("lower_roundtrip"), F.md5(reassembled("shape")).alias("shape_md5"))


def expand_to_tokens(spans: DataFrame, notes: DataFrame) -> DataFrame:
    """Spans expanded to token boundaries (a span starting or ending
    inside a letter or digit run grows to the whole run), as a character
    span aligned with alignment mode "expand"."""
    return sp.emit_beside(spans, notes, TOKEN_FIELDS, grown_to_tokens)


TOKEN_FIELDS = "token_begin int, token_end int"


def grown_to_tokens():
    """The row maker of ``expand_to_tokens``."""
    def rows(text, begins, ends):
        starts, stops = sp.token_bounds(text)
        for b, e in zip(begins, ends):
            first = bisect_right(starts, b) - 1   # the token that the first character lies in, if any
            last = bisect_left(stops, e)          # the token that the last character lies in, if any
            grown = starts[first] if first >= 0 and stops[first] > b else b
            yield grown, stops[last] if last < len(stops) and starts[last] < e else e

    return rows
