"""Operator 3, PII: a semi-Markov conditional random field.

Base spans come from four patterns with checks (e-mail, IP address, card,
phone).  The field adds spans that the patterns miss: regions with an ``@`` or
at least seven digits are cut into tokens, every run of at most ``MOST_TOKENS``
tokens is a candidate segment, and features of the whole span (its shape, digit
count, checksum, what stands around it) score it for each kind.  Dynamic
programming over segments of bounded length picks boundaries and kinds
together.  Weights are learnt in numpy, by the gradient of the conditional
likelihood, from the regions of a bounded sample of documents
(``TRAIN_ROWS``) whose base spans are the labels.  A segment that overlaps a
base span is not added; base spans always stay.

Nulls and edge cases: a null or empty text has no spans.  Rows that repeat a
doc_id are searched each for itself.  Without a base span in the sample the
field adds nothing.  An empty table gives an empty result.  Columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm.common import query, sample_by_id, table, texts_of

KINDS = ("email", "ip", "card", "phone")
#: Documents that train the field, at most (about), and regions among them.
TRAIN_ROWS, TRAIN_REGIONS = 8000, 1500
MOST_TOKENS = 24
WEIGHTS = 1 << 14
EPOCHS, RATE, DECAY = 6, 0.3, 1e-4

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
CHUNK = re.compile(r"\S+")
MARK = re.compile(r"[0-9@+]")
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S| ")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Linear: the run of local characters before each @ is read once."""
    done, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > done and text[s - 1] in LOCAL:
            s -= 1
        m = DOMAIN.match(text, at + 1) if s < at else None
        if m:
            yield s, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers joined by dots; of a longer chain the first four, the next four, ..."""
    for m in NUMBERS.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' valid matches, by start, then kind."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in emails(text)]
    out += [(s, 1, e) for s, e in addresses(text)]
    for m in CARD.finditer(text):
        d = digits_of(m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return sorted(out)


def runs(text: str) -> Iterator[tuple[int, int]]:
    """Chunks without blanks that hold a digit, @ or +, joined with neighbours
    of the kind one blank away.  Linear: every chunk is read once."""
    begin = end = -1
    for m in CHUNK.finditer(text):
        if not MARK.search(text, *m.span()):
            continue
        if begin >= 0 and m.start() == end + 1 and text[end] == " ":
            end = m.end()
            continue
        if begin >= 0:
            yield begin, end
        begin, end = m.span()
    if begin >= 0:
        yield begin, end


def regions(text: str) -> Iterator[tuple[int, str]]:
    for begin, end in runs(text):
        s = text[begin:end]
        if "@" in s or len(digits_of(s)) >= 7:
            yield begin, s


def tokens(region: str) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(region)]


def _shape(s: str) -> str:
    """Runs of digits as their length, letters as a, blanks as they are."""
    s = re.sub(r"[^\W\d_]+", "a", s)
    return re.sub(r"[0-9]+", lambda m: str(min(len(m.group()), 20)), s)[:40]


def features(region: str, s: int, e: int) -> list[int]:
    """Buckets of a span's features; none for a span that no kind can be."""
    span = region[s:e]
    digits = digits_of(span)
    if not ("@" in span or len(digits) >= 4) or span[0] == " " or span[-1] == " ":
        return []
    before, after = region[s - 1 : s] or "^", region[e : e + 1] or "$"
    kind = lambda c: "9" if c.isdigit() else "a" if c.isalpha() else c
    numbers = span.split(".")
    # isdecimal: isdigit also holds for ² or ①, which int() does not read
    four = len(numbers) == 4 and all(x.isdecimal() and len(x) <= 3 and int(x) <= 255 for x in numbers)
    domain = span.partition("@")[2]
    names = (
        "bias",
        f"digits {min(len(digits), 24)}",
        f"shape {_shape(span)}",
        f"marks {''.join(sorted(set(re.sub(r'[^\W_]', '', span))))}",
        f"luhn {luhn(digits)} {12 <= len(digits) <= 19}",
        f"four {four}",
        f"at {span.count('@')} dot {'.' in domain.strip('.')} blank {' ' in span}",
        f"plus {span[0] == '+'} {9 <= len(digits) <= 15}",
        f"first {kind(span[0])} before {kind(before)}",
        f"last {kind(span[-1])} after {kind(after)}",
        f"letters {any(c.isalpha() for c in span)}",
    )
    return [zlib.crc32(x.encode()) % WEIGHTS for x in names]


def lattice(region: str) -> tuple[list[tuple[int, int]], list[list[tuple[int, list[int]]]]]:
    """Tokens, and for each end place the candidate segments (start place, features)."""
    toks = tokens(region)
    ends: list[list[tuple[int, list[int]]]] = [[] for _ in range(len(toks) + 1)]
    for i in range(len(toks)):
        for j in range(i + 1, min(len(toks), i + MOST_TOKENS) + 1):
            f = features(region, toks[i][0], toks[j - 1][1])
            if f:
                ends[j].append((i, f))
    return toks, ends


def decode(region: str, w: np.ndarray) -> list[tuple[int, int, int]]:
    """Best segmentation: (start, kind, end) of its segments that are of a kind."""
    toks, ends = lattice(region)
    best, back = [0.0], [None]
    for j in range(1, len(toks) + 1):
        b, at = best[j - 1], None  # a token of no kind scores 0
        for i, f in ends[j]:
            s = w[:, f].sum(axis=1)
            k = int(s.argmax())
            if best[i] + s[k] > b:
                b, at = best[i] + float(s[k]), (i, k)
        best.append(b)
        back.append(at)
    out, j = [], len(toks)
    while j:
        if back[j] is None:
            j -= 1
        else:
            i, k = back[j]
            out.append((toks[i][0], k, toks[j - 1][1]))
            j = i
    return out[::-1]


def fit(samples: list[str]) -> np.ndarray:
    """Weights that raise the conditional likelihood of the base spans (which
    of overlapping ones counts: the longer, then the earlier kind)."""
    w = np.zeros((len(KINDS), WEIGHTS))
    acc = np.full_like(w, 1e-2)
    data = []
    for region in samples:
        gold: list[tuple[int, int, int]] = []
        for s, k, e in sorted(base_spans(region), key=lambda x: (x[0] - x[2], x[1])):
            if all(e <= a or s >= z for a, _, z in gold):
                gold.append((s, k, e))
        toks, ends = lattice(region)
        place = {t[0]: i for i, t in enumerate(toks)}
        stop = {t[1]: i + 1 for i, t in enumerate(toks)}
        marked = {(place[s], stop[e]): k for s, k, e in gold if s in place and e in stop}
        data.append((len(toks), ends, marked))
    rng = np.random.default_rng(3)
    for _ in range(EPOCHS):
        for d in rng.permutation(len(data)):
            n, ends, marked = data[d]
            scores = [[(i, f, w[:, f].sum(axis=1)) for i, f in at] for at in ends]
            alpha = np.zeros(n + 1)
            for j in range(1, n + 1):
                terms = [alpha[j - 1]] + [alpha[i] + x for i, _, s in scores[j] for x in s]
                alpha[j] = np.logaddexp.reduce(terms)
            beta = np.full(n + 1, -np.inf)
            beta[n] = 0
            for j in range(n, 0, -1):
                beta[j - 1] = np.logaddexp(beta[j - 1], beta[j])
                for i, _, s in scores[j]:
                    beta[i] = np.logaddexp(beta[i], beta[j] + np.logaddexp.reduce(s))
            for j in range(1, n + 1):
                for i, f, s in scores[j]:
                    g = -np.exp(np.minimum(0, alpha[i] + s + beta[j] - alpha[n]))
                    k = marked.get((i, j))
                    if k is not None:
                        g[k] += 1
                    if np.abs(g).max() > 1e-3:
                        grad = g[:, None] - DECAY * w[:, f]
                        acc[:, f] += grad * grad
                        w[:, f] += RATE * grad / np.sqrt(acc[:, f])
    return w


def fit_on(docs: DataFrame, rows: int = TRAIN_ROWS, most: int = TRAIN_REGIONS) -> np.ndarray:
    """Fit on regions of about ``rows`` documents chosen by a hash of the id."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [r for t in texts_of(b["text"]) for _, r in regions(t) if len(r) <= 400]
            yield pd.DataFrame({"region": found}, dtype=object)

    sample = sample_by_id(docs.select("doc_id", "text"), rows, 3).mapInPandas(cut, "region string").distinct()
    picked = sample.orderBy(F.xxhash64("region"), "region").limit(most).collect()  # a bounded training sample
    return fit([r["region"] for r in picked])


def spans_of(text: str, w: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and added spans of a text."""
    base = base_spans(text)
    added = []
    for at, region in regions(text):
        if w.any():
            for s, k, e in decode(region, w):
                s, e = s + at, e + at
                if all(e <= a or s >= z for a, _, z in base_near(base, s, e)):
                    added.append((s, k, e))
    return base, added


def base_near(base: list[tuple[int, int, int]], s: int, e: int) -> list[tuple[int, int, int]]:
    """Base spans that could overlap (s, e): a text's spans of a kind are in order and disjoint."""
    return [x for x in base if x[0] < e and x[2] > s]


def find(docs: DataFrame, w: np.ndarray) -> DataFrame:
    """doc_id, base and added: arrays of (start, kind, end), kind as its place in KINDS."""
    shared = docs.sparkSession.sparkContext.broadcast(w)
    span = "array<struct<start:int,kind:int,end:int>>"

    @F.pandas_udf(f"base {span}, added {span}")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ("start", "kind", "end")
        for b in batches:
            both = [spans_of(t, shared.value) for t in texts_of(b)]
            yield pd.DataFrame({c: [[dict(zip(names, x)) for x in r[i]] for r in both] for i, c in enumerate(("base", "added"))})

    return docs.select("doc_id", spans(F.col("text")).alias("found")).select("doc_id", "found.base", "found.added")


def _written(col: str):
    """kind:start:end of the spans by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(col), lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["end"])), ",")


def count_of(col: str, kind: int):
    """Spans of a kind in an array.  (The lambda has one parameter: a second one would get the place in the array.)"""
    return F.size(F.filter(col, lambda x: x["kind"] == kind)).cast("long")


@query()
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find(docs, fit_on(docs)).withColumn("every", F.concat("base", "added"))
    counts = [count_of("base", k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_written("base"), 256).alias("base_sha256"), _written("every").alias("spans"), F.size("added").cast("long").alias("n_added"))
