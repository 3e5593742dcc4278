"""Spans of a text found in one pass over it, inside the task that reads it.

These are the helpers that ``emit`` runs on each text of an Arrow batch: a
normalised copy aligned with the original, the occurrences of a lexicon,
sentence and token bounds.  Only the spans found leave the task.  Offsets are
code points of the original text, ends exclusive.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sentences end after a run of these; tokens are letter runs, digit runs or one other non-blank character.
TERMINATORS = ".!?\n"
#: Texts read at a time; rows, and characters or items of them, that are handed on at a time at most (and one row more).
TEXTS, FOUND, HELD = 256, 10_000, 4_000_000


def sliced(batches, text: str):
    """Arrow batches in slices of at most TEXTS rows, cut after HELD bytes of the column ``text`` (and one row more)."""
    import pyarrow.compute as pc

    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_pylist()
        lo, held = 0, 0
        for i, n in enumerate(sizes):
            held += n
            if held > HELD or i + 1 - lo >= TEXTS or i + 1 == b.num_rows:
                yield b.slice(lo, i + 1 - lo)
                lo, held = i + 1, 0


def emit(df: DataFrame, keep: list[str], args: list[str], fields: str, make: Callable[[], Callable[..., Iterable[tuple]]]) -> DataFrame:
    """One row for each tuple that ``make()(*args)`` yields for a row of ``df``: its ``keep`` columns
    (passed through as Arrow values, of any type) and ``fields``.  ``make`` runs once a task."""
    own = T.StructType.fromDDL(fields)
    schema = T.StructType([df.schema[c] for c in keep] + own.fields)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        rows, kinds = make(), [to_arrow_type(f.dataType) for f in own.fields]

        def batch(part, source, found):
            at = pa.array(source, pa.int64())
            kept = [part.column(c).take(at) for c in keep]
            new = [pa.array(list(c), k) for c, k in zip(zip(*found), kinds)] if found else [pa.array([], k) for k in kinds]
            return pa.RecordBatch.from_arrays(kept + new, schema.fieldNames())

        for b in batches:
            for lo in range(0, b.num_rows, TEXTS):  # a part of the batch at a time: what is held does not grow with it
                part, source, found, held = b.slice(lo, TEXTS), [], [], 0
                for i, values in enumerate(zip(*[part.column(a).to_pylist() for a in args])):
                    for r in rows(*values):
                        source.append(i)
                        found.append(r)
                        held += sum(len(x) for x in r if isinstance(x, (str, list)))
                        if held > HELD or len(found) >= FOUND:
                            yield batch(part, source, found)
                            source, found, held = [], [], 0
                yield batch(part, source, found)

    return df.select(*dict.fromkeys([*keep, *args])).mapInArrow(run, schema)


def emit_beside(spans: DataFrame, notes: DataFrame, fields: str, make: Callable[[], Callable[..., Iterable[tuple]]],
                keys: tuple[str, ...] = ("note_id",)) -> DataFrame:
    """spans (``keys``, offset_begin, offset_end, ...) with ``fields`` from the text of their note:
    ``make()(text, begins, ends)`` yields one tuple a span.  The spans of a note reach its text as one
    array, whose other columns pass through as Arrow values; the text is shuffled once and not copied."""
    cols = [c for c in spans.columns if c not in (*keys, "note_text")]
    lists = spans.groupBy(*keys).agg(F.collect_list(F.struct(*cols)).alias("_spans"))
    return emit_of_lists(lists.join(notes.select(*keys, "note_text"), list(keys)), fields, make, keys)


def emit_of_lists(lists: DataFrame, fields: str, make: Callable[[], Callable[..., Iterable[tuple]]],
                  keys: tuple[str, ...] = ("note_id",)) -> DataFrame:
    """One row for each of ``_spans`` (an array beside its ``note_text``), as ``emit_beside`` gives; nothing is moved."""
    own, cols = T.StructType.fromDDL(fields), lists.schema["_spans"].dataType.elementType
    schema = T.StructType([lists.schema[c] for c in keys] + cols.fields + own.fields)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        rows, kinds = make(), [to_arrow_type(f.dataType) for f in own.fields]
        for b in batches:
            sizes = b.column("_spans").value_lengths().to_numpy(zero_copy_only=False)
            flat = b.column("_spans").flatten()
            begins, ends = flat.field("offset_begin").to_pylist(), flat.field("offset_end").to_pylist()
            found, at = [], 0
            for text, n in zip(b.column("note_text").to_pylist(), sizes.tolist()):
                found += rows(text or "", begins[at : at + n], ends[at : at + n])
                at += n
            at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            kept = [*[b.column(k).take(at) for k in keys], *[flat.field(c) for c in cols.fieldNames()]]
            new = [pa.array(list(c), k) for c, k in zip(zip(*found), kinds)] if found else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(kept + new, schema.fieldNames())

    return lists.select(*keys, "_spans", "note_text").mapInArrow(run, schema)


# ---------------------------------------------------------------------------
# Normalisation with an alignment
# ---------------------------------------------------------------------------


class Aligned(NamedTuple):
    """A normalised text; character i stands for original[start[i]:stop[i]] (None: i:i+1)."""

    text: str
    start: list[int] | None = None
    stop: list[int] | None = None

    def original(self, begin: int, end: int) -> tuple[int, int]:
        if self.start is None:
            return begin, end
        if begin == end:
            at = self.start[begin] if begin < len(self.start) else (self.stop[-1] if self.stop else 0)
            return at, at
        return self.start[begin], self.stop[end - 1]


def _lower(c: str) -> str:
    low = c.lower()
    return low if len(low) == 1 else c


def lowered(text: str) -> str:
    """Lower case, character by character: the length stays."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(map(_lower, text))


def unaccented(text: str) -> str:
    """Compatibility decomposition without combining marks; the length may change."""
    return "".join(d for d in unicodedata.normalize("NFKD", text) if not unicodedata.combining(d))


class Normaliser(NamedTuple):
    """X2 switches.  ``pollution``: patterns whose matches are blanked, so that the length stays;
    ``accents``: NFKD without combining marks, which may lengthen or shorten the text;
    ``blanks``: a run of spaces becomes one."""

    lower: bool = True
    accents: bool = False
    blanks: bool = False
    pollution: tuple[str, ...] = ()

    def mask(self, text: str) -> str:
        for p in self.pollution:
            text = re.sub(p, lambda m: " " * len(m.group()), text)
        return text

    def __call__(self, text: str) -> Aligned:
        text = self.mask(text)
        if self.lower:
            text = lowered(text)
        fold = self.accents and not text.isascii()
        if not fold and not (self.blanks and "  " in text):
            return Aligned(text)
        out: list[str] = []
        start: list[int] = []
        stop: list[int] = []
        for i, c in enumerate(text):
            if self.blanks and c == " " and out and out[-1] == " " and stop[-1] == i:
                stop[-1] = i + 1
                continue
            new = c if c.isascii() or not fold else unaccented(c)
            if not new and stop:  # a mark of its own belongs to the character before it
                stop[-1] = i + 1
            for d in new:
                out.append(d)
                start.append(i)
                stop.append(i + 1)
        return Aligned("".join(out), start, stop)


# ---------------------------------------------------------------------------
# Lexicon (X1, X3)
# ---------------------------------------------------------------------------


class Lexicon:
    """Whole-word occurrences of the terms, leftmost and then longest, without overlaps, each with
    the cue kinds that stand between the start of its sentence and it.  Terms, cues and sentence ends
    are found in one pass whose cost does not depend on the number of terms."""

    def __init__(self, terms: Iterable[str], cues: dict[str, Iterable[str]], normaliser: Normaliser):
        import ahocorasick

        self.normaliser = normaliser._replace(blanks=True)
        self.kinds = list(cues)
        roles: dict[str, tuple[list[int], list[int]]] = {}
        for n, t in enumerate(terms):
            roles.setdefault(self.key(t), ([], []))[0].append(n)
        for k, words in enumerate(cues.values()):
            for w in words:
                roles.setdefault(self.key(w), ([], []))[1].append(k)
        self.automaton = ahocorasick.Automaton()
        for key, (own, kinds) in roles.items():
            if key:
                self.automaton.add_word(key, (len(key), own, kinds))
        for c in TERMINATORS:
            if c not in roles:
                self.automaton.add_word(c, (0, [], []))
        self.automaton.make_automaton()

    def key(self, term: str) -> str:
        return self.normaliser._replace(pollution=())(" ".join(term.split())).text

    def _occurrences(self, s: str) -> tuple[list, list, list]:
        """Terms (start, -size, numbers), cues (end, start, kind) and sentence ends of a normalised text, whole words only."""
        n, terms, cues, ends = len(s), [], [], [-1]
        for last, (size, own, kinds) in self.automaton.iter(s):
            if not size or s[last] in TERMINATORS:
                ends.append(last)
            first = last + 1 - size
            if not size or (first and s[first - 1].isalpha()) or (last + 1 < n and s[last + 1].isalpha()):
                continue
            if own:
                terms.append((first, -size, own))
            for k in kinds:
                cues.append((last + 1, first, k))
        return sorted(terms), sorted(cues), ends

    def _flagged(self, places: Iterable[int], cues: list, ends: list):
        """For each place, in order, whether a cue of each kind ends before it in its sentence."""
        c, latest = 0, [-1] * len(self.kinds)  # of each kind, the latest start of a cue that ends before the place
        for at in places:
            while c < len(cues) and cues[c][0] <= at:
                latest[cues[c][2]] = max(latest[cues[c][2]], cues[c][1])
                c += 1
            sentence = ends[bisect_left(ends, at) - 1] + 1
            yield [x >= sentence for x in latest]

    def find(self, text: str) -> list[tuple]:
        """(begin, end, term numbers, one flag for each kind of cue)."""
        norm = self.normaliser(text)
        terms, cues, ends = self._occurrences(norm.text)
        chosen, free = [], 0
        for first, size, own in terms:
            if first >= free:
                free = first - size
                chosen.append((first, free, own))
        flags = self._flagged((b for b, _, _ in chosen), cues, ends)
        return [(*norm.original(b, e), own, f) for (b, e, own), f in zip(chosen, flags)]

    def flags(self, text: str, begins: list[int]) -> list[list[bool]]:
        """The flags of given places of the text (in any order), as those of a term found there."""
        norm = self.normaliser(text)
        _, cues, ends = self._occurrences(norm.text)
        order = sorted(range(len(begins)), key=begins.__getitem__)
        places = [begins[i] if norm.start is None else bisect_left(norm.start, begins[i]) for i in order]
        out: list = [None] * len(begins)
        for i, f in zip(order, self._flagged(places, cues, ends)):
            out[i] = f
        return out


# ---------------------------------------------------------------------------
# Patterns (X19), sentences (X11, W6), tokens
# ---------------------------------------------------------------------------


def pattern_spans(patterns: dict[str, "re.Pattern"], normaliser: Normaliser, text: str) -> list[tuple]:
    """(label, begin, end) of the non-overlapping matches of each label's pattern in the normalised text."""
    norm = normaliser(text)
    return [(label, *norm.original(*m.span())) for label, p in patterns.items() for m in p.finditer(norm.text)]


def sentence_bounds(text: str) -> tuple[list[int], list[int]]:
    """Starts and ends of the sentences; they tile the text."""
    ends = [m.end() for m in re.finditer(r"[.!?\n]+", text)]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return [0, *ends[:-1]] if ends else [], ends


TOKEN, BLANKS = r"\p{L}+|\p{N}+|[^ \t\n\x0b\f\r\p{L}\p{N}]", r"[ \t\n\x0b\f\r]*"


@functools.lru_cache(maxsize=None)
def _compiled(pattern: str):
    import regex

    return regex.compile(pattern)


def token_bounds(text: str) -> tuple[list[int], list[int]]:
    """Starts and ends of the tokens."""
    found = [m.span() for m in _compiled(TOKEN).finditer(text)]
    return [b for b, _ in found], [e for _, e in found]


def sentence_window(bounds: tuple[list[int], list[int]], begin: int, end: int, before: int, after: int) -> tuple[int, int]:
    """The sentences of a span and ``before`` / ``after`` neighbours, clipped at the text's ends."""
    starts, ends = bounds
    if not ends:
        return begin, end
    last = len(ends) - 1
    first = min(bisect_right(ends, begin), last)
    to = min(bisect_right(ends, max(end - 1, begin)), last)
    return starts[max(0, first - before)], ends[min(last, to + after)]


def token_window(bounds: tuple[list[int], list[int]], begin: int, end: int, n: int) -> tuple[int, int]:
    """From the n-th token before a span to the n-th after it."""
    starts, ends = bounds
    left, right = bisect_right(ends, begin), bisect_left(starts, end)
    first = starts[max(0, left - n)] if n and left else begin
    last = ends[min(len(ends), right + n) - 1] if n and right < len(ends) else end
    return first, last


class TokenRanks:
    """W7 with excluded tokens: ranks over the included ones (their numbers, in order)."""

    def __init__(self, text: str, excluded: Callable[[str], bool]):
        self.text = text
        self.starts, self.ends = token_bounds(text)
        self.included = [i for i, (b, e) in enumerate(zip(self.starts, self.ends)) if not excluded(text[b:e])]

    def _words(self, numbers: Iterable[int]) -> str:
        """The tokens with the blanks that follow them."""
        stops = [*self.starts[1:], len(self.text)]
        return "".join(self.text[self.starts[i] : stops[i]] for i in numbers)

    def around(self, begin: int, end: int, n: int, count_excluded: bool = False) -> tuple[str, str]:
        """The included tokens among the n nearest on each side; excluded ones use up places only if counted."""
        left, right = bisect_right(self.ends, begin), bisect_left(self.starts, end)
        a, z = bisect_left(self.included, left), bisect_left(self.included, right)
        if count_excluded:
            low = bisect_left(self.included, left - n)
            high = bisect_left(self.included, right + n)
        else:
            low, high = max(0, a - n), z + n
        return self._words(self.included[low:a]), self._words(self.included[z:high])


def token_attributes(text: str) -> tuple[str, list[tuple[str, str]]]:
    """The blanks before the first token, and (text, blanks after it) of each token; together they are the text."""
    head = _compiled(BLANKS).match(text).group()
    return head, _compiled(f"({TOKEN})({BLANKS})").findall(text, len(head))


_SHAPES = {"Lu": "X", "Ll": "x", "Nd": "d"}


def shape(token: str) -> str:
    """Upper, lower and digit characters as X, x and d, runs of five or more as four."""
    s = "".join(_SHAPES.get(unicodedata.category(c), c) for c in token)
    return re.sub(r"X{5,}|x{5,}|d{5,}", lambda m: m.group()[:4], s) if len(s) > 4 else s
