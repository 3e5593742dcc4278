"""WARC index, bit-sliced search and hard negatives against brute force, on awkward and empty tables."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.llm import bitsliced, exact_dedup, hard_negatives, langid, packing, suffix_dedup, toxicity, warc

RNG = random.Random(11)


def rows(df):
    return [r.asDict() for r in df.collect()]


def key(t):
    return tuple((x is None, x if x is not None else 0) for x in t)


# ---- op 11

FORGED = "<p>\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
PAGES = [
    (1, "http://B.example.com:80/x?q=1#top", "same"), (2, "http://a.example.com/", "same"), (3, None, None), (4, "", ""), (5, "no scheme", "é漢☃"),
    (6, "http://a.example.com/\r\nWARC-Type: evil", FORGED), (7, "https://a.example.com/", FORGED), (8, "http://a.example.com/", "x" * 300_000),
    (9, "http://a.example.com/", "same"), (9, "http://a.example.com/", "same"), (9, "http://a.example.com/", "other"), (None, "http://u@c.org/", "same"),
    (None, None, "only null"), (None, None, "only null"), (-5, "http://z.org", "z"), (2**62, "http://z.org", "z"),
]
PAGE_SCHEMA = "page_id long, url string, html string, size long, row string, first string, archive int"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, 1, "r", "f", 2) for p in PAGES], PAGE_SCHEMA)


def expected_pages(table, least=0):
    groups: dict[bytes, list] = {}
    for at, (i, _, html) in enumerate(table):
        raw = (html or "").encode()
        if len(raw) >= least:
            groups.setdefault(raw, []).append((i is None, i or 0, at))
    out = []
    for at, (i, _, html) in enumerate(table):
        raw = (html or "").encode()
        first = min(groups[raw]) if raw in groups else None
        kind = "revisit" if first and first[2] != at else "response"
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind, first[1] if kind == "revisit" and not first[0] else None))
    return out


FIELDS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@pytest.mark.parametrize("least, hot", [(0, False), (5, False), (0, True)])
def test_warc(spark, pages, least, hot, tmp_path, monkeypatch):
    if hot:  # shared digests too many for a broadcast, some of them hot
        monkeypatch.setattr(warc, "sized", lambda df: df)
        monkeypatch.setattr(warc, "HOT_SHARE", 4)
    at = str(tmp_path / "archives")
    index = warc.capture_index(pages, at, least_bytes=least, archive_bytes=100_000, range_rows=4)
    got = rows(index)
    want = expected_pages(PAGES, least)
    assert sorted((tuple(r[f] for f in FIELDS) for r in got), key=key) == sorted(want, key=key)
    order = [(r["url_key"], r["second"], math.inf if r["page_id"] is None else r["page_id"]) for r in sorted(got, key=lambda r: (r["range"], r["place"]))]
    assert order == sorted(order) and len({r["range"] for r in got}) > 1
    for r in got:  # a line of the index leads to its record
        with open(r["archive"].removeprefix("file:"), "rb") as f:
            f.seek(r["offset"])
            ((_, length, fields, block),) = warc.records(f.read(r["length"]) + b"\r\n\r\n")
        assert length == r["length"] and fields[b"WARC-Type"].decode() == r["record_type"]
        assert (block.partition(b"\r\n\r\n")[2] == b"") == (r["record_type"] == "revisit" or r["payload_bytes"] == 0)
    targets = {r["url"] for r in got}
    assert "http://a.example.com/%0D%0AWARC-Type: evil" in targets and None in targets and "" in targets
    if not least and not hot:
        past = {r["url_key"]: r for r in rows(warc.histories(index))}
        assert past["com,example,a)/"]["captures"] == 6 and past["com,example,b:80)/x?q=1"]["captures"] == 1


def test_warc_edges(spark, pages):
    assert warc.capture_index(pages.limit(0)).count() == 0
    plain = [(i, f"http://h{i % 3}.org/", f"p{i % 7}") for i in range(100)]  # ids tell rows: nothing is numbered
    got = rows(warc.capture_index(spark.createDataFrame(plain, "page_id long, url string, html string")))
    assert sorted(tuple(r[f] for f in FIELDS) for r in got if r["refers_to"] is not None) == sorted(w for w in expected_pages(plain) if w[4] is not None)
    with pytest.raises(ValueError):
        list(warc.records(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nshort\r\n\r\n"))
    assert warc.url_key("HTTP://U@Www.Example.ORG:8080?a#b") == "org,example,www:8080)?a"


def test_loser_tree():
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(RNG.choices(range(30), k=RNG.randrange(0, 40))) for _ in range(k)]
        got = list(warc.loser_tree(runs))
        assert [runs[r][i] for r, i in got] == sorted(x for r in runs for x in r)
        assert [(runs[r][i], r, i) for r, i in got] == sorted((x, n, i) for n, r in enumerate(runs) for i, x in enumerate(r))


# ---- op 12

WORDS = [f"w{i}" for i in range(60)]


def documents():
    base = " ".join(RNG.choice(WORDS) for _ in range(60))
    out = [(i, " ".join(RNG.choices(WORDS, weights=[1 / (k + 1) for k in range(60)], k=RNG.randrange(1, 90)))) for i in range(1, 150)]
    out += [(200 + i, base) for i in range(30)]  # copies: equal scores
    out += [(300, None), (301, ""), (302, " \t--"), (303, "W1 É漢 É漢"), (304, "w1 " * 40_000), (305, " ".join(f"z{i}" for i in range(30_000))), (306, "w1"), (306, "w2 w1"), (None, "w3 w4"), (None, "w3 w4")]
    return out, base


def terms(t):
    low = (t or "").translate({c: c + 32 for c in range(65, 91)})
    return Counter(x for x in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low) if x)


def ranked(docs, items, top):
    tfs = [terms(t) for _, t in docs]
    n_docs = sum(bool(t) for t in tfs)
    total = sum(sum(t.values()) for t in tfs)
    df = Counter(w for t in tfs for w in t)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in asked.items():
        scored = []
        for (d, _), tf in zip(docs, tfs):
            m = 10 + (90 * sum(tf.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 8 * m)) for w in words if tf[w])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, k, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=key)


@pytest.mark.parametrize("block_docs, block_terms", [(4096, 20_000), (16, 10)])
def test_bitsliced(spark, monkeypatch, block_docs, block_terms):
    docs, base = documents()
    items = [(1, base[:100]), (2, "w1 w2 w59 nowhere"), (3, None), (4, ""), (5, "nowhere"), (6, "É漢"), (7, "w1"), (7, "w5 w1"), (None, "w3"), (8, "z17 z29999 w40")]
    monkeypatch.setattr(bitsliced, "BLOCK_DOCS", block_docs)
    table = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], "doc_id long, text string, term string, block long, rank int")
    got = rows(bitsliced.search(table, spark.createDataFrame([(*i, "x", 1.5) for i in items], "item_id long, text string, none string, w double"), item_block_terms=block_terms))
    assert sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in got), key=key) == ranked(docs, items, 10)


def test_bitsliced_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert bitsliced.search(docs.limit(0), items).count() == 0 and bitsliced.search(docs, items.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "--")], "doc_id long, text string")
    assert bitsliced.search(blank, items).count() == 0


def test_bounds_hold():
    """No bound is below the exact score, and most documents are excluded."""
    docs, base = documents()
    tfs = [bitsliced.terms_of((t or "").encode()) for _, t in docs]
    own = [(i, t, c) for i, ((_, t), c) in enumerate(zip(docs, tfs)) if c and len(c) < 100]
    block = bitsliced.Block(9)
    for i, t, c in own:
        block.add(i, t.encode(), bitsliced.term_hash(list(c)), np.fromiter(c.values(), np.int64, len(c)))
    n, _, bits, _, counts, slices, *_ = block.row()
    import zstandard

    class Total:
        documents, terms = n, sum(block.counts)

    items = bitsliced.Items([((False, 1), w, 1 + k) for k, w in enumerate(sorted(terms(base)))], Total)
    counts = np.frombuffer(counts, "<i8")
    bounds = items.bounds(counts, np.frombuffer(zstandard.ZstdDecompressor().decompress(slices), np.uint8).reshape(bits, -1))[0]
    exact = np.array([items.scores(t.encode(), np.array([0]))[0] for _, t, _ in own])
    assert (bounds >= exact).all()
    assert (bounds >= np.sort(exact)[-10]).mean() < 0.7


# ---- op 13


def vectors():
    out = [(i, [RNG.gauss(0, 0.2) + (0.3 if k == i % 4 else 0.0) for k in range(6)], i % 5) for i in range(420)]
    out += [(1000 + i, out[100][1], i % 3) for i in range(40)]  # copies of an anchor
    out += [(500, None, 1), (600, [0.1, None, 0.0, 0.0, 0.0, 0.0], 1), (700, [float("nan")] * 6, 1), (800, [float("inf")] + [0.0] * 5, 2), (900, [0.5] * 6, None)]
    out += [(None, [0.4] * 6, 2), (None, [0.4] * 6, 3), (200, [0.5] * 6, 2), (2000, [], 1), (2100, [0.9], 1), (2200, [-0.5] * 6, 8), (2201, [-0.4] * 6, 8), (1401, [0.3] * 6, 8)]
    return out


def mined(table):
    use = []
    for v, vec, label in table:
        if label is not None and vec is not None and all(x is not None and math.isfinite(x) for x in vec):
            use.append((v, (label + 1) % 10 if v is not None and v % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in vec]))
    order = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out = []
    for a, (v, label, vec) in enumerate(use):
        if v is None or v % 100:
            continue
        other = [(sum(x * y for x, y in zip(vec, w)), u, m) for b, (u, m, w) in enumerate(use) if b != a]
        for ps, p, _ in sorted((t for t in other if t[2] == label), key=order)[:5]:
            fit = sorted((t for t in other if t[2] != label and 80 * ps <= 100 * t[0] <= 100 * ps), key=order)[:5]
            out += [(v, p, k, n, ps, ns) for k, (ns, n, _) in enumerate(fit, 1)]
    return sorted(out, key=key)


MINED = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("anchor_bytes", [1 << 24, 400])
def test_hard_negatives(spark, anchor_bytes):
    table = vectors()
    df = spark.createDataFrame([(*t, 7, "x") for t in table], "vec_id long, embedding array<float>, label int, row long, vec string")
    got = rows(hard_negatives.mine(df, anchor_bytes=anchor_bytes))
    assert sorted((tuple(r[c] for c in MINED) for r in got), key=key) == mined(table)
    assert hard_negatives.mine(df.limit(0)).count() == 0


def test_products_are_exact():
    a = np.array([[2.0**40, 3.0], [1.0, -5.0]])
    b = np.array([[2.0**20, 1.0], [2.0, 7.0]])
    assert hard_negatives.products(a, b).tolist() == [[2**60 + 3, 2**41 + 21], [2**20 - 5, -33]]
    with pytest.raises(OverflowError):
        hard_negatives.products(np.array([[2.0**40]]), np.array([[2.0**30]]))


# ---- earlier operators: groups of equal rows, long strings


def test_equal_rows_are_packed_in_groups(spark):
    rows_ = spark.createDataFrame([(None, "")] * 3000, "doc_id long, text string")
    placed = packing.places(packing.pieces_of(rows_), group=500).selectExpr("sequence_id >> 32 AS g").groupBy("g").count().collect()
    assert len(placed) == 6 and max(r["count"] for r in placed) < 700


@pytest.mark.parametrize("length", [271, 272, 416])
def test_long_repeats(spark, length):
    copy = "".join(RNG.choice("abcdefgh") for _ in range(800))
    texts = [(1, "x" + copy + "y"), (2, "zz" + copy), (3, copy[: length - 1])]
    got = {r["doc_id"]: r["n_removed"] for r in rows(suffix_dedup.repeats(spark.createDataFrame(texts, "doc_id long, text string"), length))}
    assert got == {1: 0, 2: 800, 3: 0}


def test_long_words_are_scored_whole(spark):
    """The rolling sum equals the lattice where both apply, and the exact sum over all segmentations beyond."""
    from fractions import Fraction

    pieces = {p: i for i, p in enumerate(["a", "b", "ab", "ba", "aab", langid.MARK + "a"])}
    prob = np.array([[0.2, 0.1], [0.1, 0.3], [0.3, 0.05], [0.05, 0.2], [0.1, 0.1], [0.2, 0.2], [1e-7, 1e-7]])
    model = langid.Model(pieces, ["x", "y"], prob)

    def exact(word):
        out = []
        for k in range(2):
            ways = [Fraction(1)]
            for e in range(1, len(word) + 1):
                total = Fraction(0)
                for s in range(max(0, e - 3), e):
                    p = pieces.get(word[s:e], len(pieces) if e == s + 1 else None)
                    total += ways[s] * Fraction(prob[p][k]) if p is not None else 0
                ways.append(total)
            top = ways[-1]
            out.append(math.log(top.numerator) - math.log(top.denominator))
        return out

    for n in (1, 5, 31, 33, 200):
        word = langid.MARK + "".join(RNG.choice("abc") for _ in range(n))
        assert np.allclose(model.log_long(word), exact(word), rtol=1e-12)
        if n < 32:
            assert np.allclose(model.log_words([word])[0], exact(word), rtol=1e-12)
    texts = ["ab " * 3 + "a" * 40_000, "b" * 33, "ab", "", "12", "É" * 64]
    got = list(langid.predict_texts(model, texts, {}, [np.zeros((1 << 14, 2), np.float32)]))
    assert [g[0] for g in got[3:5]] == ["und", "und"] and got[0][0] == "x" and got[1][0] == "y"
    tie = langid.Model(pieces, ["x", "y"], np.repeat(prob[:, :1], 2, axis=1))
    assert list(langid.predict_texts(tie, ["ab", "a" * 50], {}, [np.zeros((1 << 14, 2), np.float32)])) == [("x", 0.5), ("x", 0.5)]


def test_one_state_for_several_calls(spark, tmp_path):
    first = [(1, "a b"), (2, "c"), (None, ""), (9, "long"), (9, "long")]
    second = [(0, "ab"), (3, "a\tb"), (4, "new"), (5, "c  "), (None, None)]

    def run(rows_, state, **how):
        got = rows(exact_dedup.dedup(spark.createDataFrame([(*x, "extra") for x in rows_], "doc_id long, text string, norm string").repartition(1), state_dir=state, **how))
        return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got), key=key)

    want_first = [(1, 1, 1, True), (2, 2, 1, True), (9, 9, 2, False), (9, 9, 2, True), (None, None, 1, True)]
    # "a\tb" and "a b" have three code points, "ab" two: 1 stays; "c  " has more than "c"; counters start again in each call
    want_second = [(0, 1, 3, False), (3, 1, 3, False), (4, 4, 1, True), (5, 5, 2, True), (None, None, 2, False)]
    for name, how in (("plain", {}), ("clash", {"digest": lambda c: F.lit(b"one digest for all")})):
        state = str(tmp_path / name)
        assert run(first, state, **how) == want_first
        got = run(second, state, **how)
        assert [g[:3] for g in got] == [w[:3] for w in want_second] and [g[3] for g in got[:-1]] == [w[3] for w in want_second[:-1]]
        assert run([], state, **how) == []
        assert run([(7, "c   ")], state, **how) == [(7, 7, 3, True)]


def test_a_score_is_the_texts_own():
    """Convolution and pooling against a plain loop, in any company and over block borders."""
    rng = np.random.default_rng(2)
    rows_ = np.zeros(toxicity.BUCKETS, np.int32)
    texts = ["bad word here", "fine", "", "word " * 60_000, "word bad", "bad " * 3, "unknown words only", "here bad word"]
    ids = toxicity.buckets(texts)
    for k, b in enumerate(np.unique(np.concatenate(toxicity.buckets(["bad word here fine"]))), 1):
        rows_[b] = k
    m = toxicity.Model(rows_, rng.normal(0, 1, (5, toxicity.DIM)).astype(np.float32), rng)
    m.embed[0] = 0
    m.bias = [rng.normal(0, 1, toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS]

    def plain(x):
        e = [m.embed[rows_[i]] for i in x] + [np.zeros(toxicity.DIM)] * toxicity.GAP
        out = []
        for w, b in zip(m.conv, m.bias):
            z = [sum(e[i + j] @ w[j] for j in range(len(w))) + b for i in range(min(len(x), 50))]
            out.append(np.maximum(np.max(z, axis=0), 0) if z else np.zeros(toxicity.FILTERS))
        return np.concatenate(out)

    got = m.pooled(ids)
    keep = [i for i in range(len(ids)) if i != 3]
    assert np.allclose(got[keep], [plain(ids[i]) for i in keep], atol=1e-5)
    for _ in range(5):
        order = rng.permutation(len(ids))
        assert np.allclose(m.pooled([ids[i] for i in order]), got[order], atol=1e-5)
    assert np.allclose(m.pooled([ids[3]]), got[3:4], atol=1e-5)


def test_thresholds_are_of_each_language():
    rng = np.random.default_rng(3)
    m = toxicity.Model(np.zeros(toxicity.BUCKETS, np.int32), np.zeros((1, toxicity.DIM), np.float32), rng)
    m.languages = ["a", "b", "rare"]
    lang = np.repeat([0, 1, 2], [400, 400, 40])
    y = (np.arange(840) % 5 == 0).astype(int)
    p = np.where(y == 1, 0.6, 0.2) * np.where(lang == 1, 0.1, 1.0)  # b's scores lie ten times lower
    m.calibrate(p, y, lang)
    assert 0.2 < m.thresholds[0] < 0.6 and 0.02 < m.thresholds[1] < 0.06 and m.thresholds[2] == m.common
