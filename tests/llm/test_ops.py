"""The operators on one awkward table (nulls, empty and long texts, ties,
repeated rows, clashing extra columns), on empty tables, and against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortflow.llm import decontam, exact_dedup, langid, near_dup, packing, pii, suffix_dedup, token_counts, toxicity, url_rules
from cohortflow.llm.common import staged, tokenizer_path
from cohortflow.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, query boolean, rep long, block long, norm string, kept string, score string"
RNG = random.Random(5)
WORDS = [f"w{i}" for i in range(400)]


def prose(n: int) -> str:
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def awkward() -> list[tuple]:
    base = prose(120)
    near = base.split()
    near[5] = "changed"
    texts = [
        (1, base), (2, base), (3, base.replace(" ", "\n")), (4, " ".join(near)), (5, None), (6, ""), (7, " \t "), (8, "one"),
        (9, "ONE"), (10, prose(6000)), (11, "x" * 30000), (12, "x" * 30000), (13, "idiot " * 5 + prose(20)), (14, prose(15) + " " + base[100:400]),
        (15, "pa.90@mail2.example.com +1 (017) 555-7713 97.51.17.173 4417744280351547 1.2.3.4.5.6.7.8"), (16, "ÉÀ ß 漢字 ☃"), (17, prose(30)),
        (17, prose(30)), (18, base), (18, base), (None, base), (None, None),
    ]
    return [(i, t, "en" if i is None or i % 2 else "fr", None, None, True, i, 3, "norm", "yes", "s") for i, t in texts]


TABLE = awkward()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TABLE, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, int(i == 13)) for i in range(1, 19)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, TABLE[0][1][100:300]), (2, None), (3, ""), (None, "one"), (4, "one"), (4, "one")], "item_id long, text string")


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_exact_dedup(docs, empty):
    got = rows(exact_dedup.dedup(docs))
    want: dict[str, list] = {}
    for k, r in enumerate(TABLE):
        want.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append((-len(r[1] or ""), r[0] is None, r[0] or 0, k))
    assert len(got) == len(TABLE) and sum(g["kept"] for g in got) == len(want)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): sorted(v) for t, v in want.items()}
    for g in got:
        group = by_digest[g["digest"]]
        assert g["group_size"] == len(group) and g["keep_id"] == (None if group[0][1] else group[0][2])
    # one digest for different texts: full bytes decide
    weak = rows(exact_dedup.dedup(docs, digest=lambda c: F.substring(exact_dedup.sha256(c), 1, 1)))
    assert sorted((str(g["doc_id"]), str(g["keep_id"]), g["group_size"]) for g in weak) == sorted((str(g["doc_id"]), str(g["keep_id"]), g["group_size"]) for g in got)
    assert exact_dedup.dedup(empty).count() == 0
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and {1, 10, 11} <= {r["doc_id"] for r in rows(kept)} and 2 not in {r["doc_id"] for r in rows(kept)}


def test_state_goes_on(spark, docs, tmp_path):
    first = exact_dedup.digest_rows(docs.filter("doc_id < 10"))
    state = str(tmp_path / "state")
    a = exact_dedup.run_state(spark, first._staged_at, first.schema, state)
    assert a.count() == first.select("digest").distinct().count()
    exact_dedup.digest_rows(docs.filter("doc_id >= 10")).write.mode("append").parquet(first._staged_at)
    b = exact_dedup.run_state(spark, first._staged_at, first.schema, state)
    assert b.agg(F.sum("group_size")).first()[0] == docs.filter("doc_id is not null").count()


def shingle_sets(texts, k):
    out = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if x]
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, docs, empty, k):
    plain = [(r[0], r[1]) for r in TABLE if r[0] not in (None, 17, 18)]
    group = prose(200).split()
    for i in range(60):  # a group of near copies, some too far for a link
        w = list(group)
        for _ in range(i % 14):
            w[RNG.randrange(200)] = RNG.choice(WORDS)
        plain.append((100 + i, " ".join(w)))
    got = {r["doc_id"]: r for r in rows(near_dup.near_duplicates(spark.createDataFrame(plain, "doc_id long, text string"), k))}
    sets = shingle_sets([t for _, t in plain], k)
    root = list(range(len(plain)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(plain)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)), key=lambda x: plain[x][0])
                root[b] = a
    for i, (d, _) in enumerate(plain):
        assert got[d]["n_shingles"] == len(sets[i])
        assert got[d]["component_id"] == plain[find(i)][0] and got[d]["kept"] == (find(i) == i)
    all_ = rows(near_dup.near_duplicates(docs, k))
    assert len(all_) == len(TABLE) and all(r["kept"] and r["component_id"] is None for r in all_ if r["doc_id"] is None)
    assert near_dup.near_duplicates(empty, k).count() == 0


def test_bayes_bound():
    need = near_dup.least_matches(160, 32, 0.8, 1e-9)
    assert list(need) == sorted(need) and need[-1] < 0.8 * 160
    assert (near_dup.least_matches(160, 32, 0.8, 1e-3) >= need).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (300, 301)] + [(500, 500 + i) for i in range(1, 30)]
    got = {r["node"]: r["root"] for r in rows(components(spark.createDataFrame(edges, "a long, b long")))}
    assert set(got.values()) == {0, 100, 300, 500} and got[40] == 0 and got[200] == 100 and got[529] == 500
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination(spark, docs, empty, bench):
    got = rows(decontam.contamination(docs, bench))
    words = lambda t: [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if x]
    items = [(r["item_id"], words(r["text"])) for r in bench.collect() if r["item_id"] is not None]
    want = []
    for d, t, *_ in TABLE:
        w, hit, found = words(t), set(), set()
        for item, b in items:
            n = min(10, len(b))
            for i in range(len(b) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == b[i : i + n]:
                        hit |= set(range(j, j + n))
                        found.add(item)
        want.append((str(d), len(w), len(hit), sorted(found), bool(hit)))
    key = lambda r: str(r)
    assert sorted(((str(r["doc_id"]), r["n_words"], r["n_hit"], sorted(r["items"]), r["contaminated"]) for r in got), key=key) == sorted(want, key=key)
    split = rows(decontam.contamination(docs, bench, block_chars=50))  # several blocks of the benchmark
    assert sorted((str(r["doc_id"]), r["n_hit"], r["n_items"]) for r in split) == sorted((str(r["doc_id"]), r["n_hit"], r["n_items"]) for r in got)
    assert decontam.contamination(empty, bench).count() == 0
    assert not any(r["contaminated"] for r in rows(decontam.contamination(docs, bench.limit(0))))
    assert decontam.drop_contaminated(docs, bench).columns == docs.columns


def test_suffix_dedup(spark, docs, empty):
    for length, q in ((50, 16), (24, 8)):
        table = [(r[0], r[1]) for r in TABLE if r[1] is None or len(r[1]) < 3000]
        got = rows(suffix_dedup.repeats(spark.createDataFrame(table, "doc_id long, text string"), length, q))
        first: dict[bytes, int] = {}
        key = lambda d: 2**63 - 1 if d is None else d
        raws = [(key(d), (t or "").encode()) for d, t in table]
        for d, raw in raws:
            for i in range(len(raw) - length + 1):
                s = raw[i : i + length]
                first[s] = min(first.get(s, d), d)
        want = []
        for d, raw in raws:
            gone = np.zeros(len(raw) + 1, bool)
            for i in range(len(raw) - length + 1):
                if first[raw[i : i + length]] < d:
                    gone[i : i + length] = True
            kept = bytes(b for b, g in zip(raw, gone) if not g)
            want.append((d, len(raw), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
        assert sorted((key(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == sorted(want)
    long = {r["doc_id"]: r for r in rows(suffix_dedup.repeats(docs.filter("doc_id in (11, 12)")))}
    assert long[12]["n_removed"] == 30000 and long[11]["n_removed"] == 0
    assert suffix_dedup.repeats(empty).count() == 0


def test_encoder_equals_tokenizer():
    """Whole texts with other scripts, marks, odd white space and special
    strings, and the property that the word ranks rest on."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tok, enc = Tokenizer.from_file(path), packing.Encoder(path)
    want = lambda t: tok.encode(t, add_special_tokens=False).ids
    vocab = tok.get_vocab()
    latin = [t[:-4] for t in vocab if t.endswith("</w>") and re.fullmatch("[a-z]+", t[:-4])]
    assert all(want(t) == [vocab[t + "</w>"]] for t in latin)
    pick = RNG.choice
    odd = ["İstanbul", "ŉ", "ſo", "Straße", "ẞ", "don't", "'tis", "x'##", "e\u0301", "Å", "\u212b", "K\u212a", "ﬁn", "東京", "नमस्ते", "a\tb", "\u00a0", "\x01", "a\x01b",
           "<|endoftext|>", "a<|endoftext|>b", "<|", "12", "a1b", "ab_c", "--", "é" * 60, "ab" * 400, "🙂x", "\r\n", ""]
    word = lambda: pick(odd) if RNG.random() < 0.2 else "".join(pick(latin) for _ in range(RNG.randint(1, 4))) + pick(["", ",", "...", "'", "&#"])
    texts = [pick([" ", "\n", "  "]).join(pick([str, str.upper, str.title])(word()) for _ in range(RNG.randint(0, 60))) for _ in range(400)] + [None, ""]
    texts.append(" ".join(word() for _ in range(20_000)))
    for size in (packing.SLICE, 2_000):
        packing.SLICE, kept = size, packing.SLICE
        got = [x.tolist() for x in enc.encode(pa.array(texts))]
        packing.SLICE = kept
        assert got == [want(t or "") for t in texts]
    assert list(enc.encode(pa.array([], pa.string()))) == []


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    got = pd.DataFrame(rows(packing.pack(docs, length=256)))
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s["offset"].values == (s["length"].cumsum() - s["length"]).values).all() and s["length"].sum() <= 256
    want = []
    for d, t, *_ in TABLE:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want += [(str(d), s, min(256, len(ids) - s), zlib.crc32(ids[s : s + 256].tobytes()), len(ids)) for s in range(0, len(ids), 256)]
    have = [(str(None if pd.isna(r.doc_id) else int(r.doc_id)), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got.itertuples()]
    assert sorted(have) == sorted(want)
    assert packing.pack(empty).count() == 0


def test_first_fit_decreasing():
    for _ in range(20):
        sizes = sorted((RNG.randint(1, 100) for _ in range(RNG.randint(0, 80))), reverse=True)
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        room: list[int] = []
        for s, b, o in zip(sizes, bins, offsets):
            k = next((i for i, r in enumerate(room) if r >= s), len(room))
            if k == len(room):
                room.append(100)
            assert (b, o) == (k, 100 - room[k])
            room[k] -= s


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab = token_counts.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    tok = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=False))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    texts = [t or "" for _, t, *_ in TABLE] + ["  a  b ", "▁x ▁", "\n\n x"] + ["".join(RNG.choice("aab é☃▁\n.x") for _ in range(30)) for _ in range(200)]
    count = token_counts.Counter(vocab)
    assert [count.text(t) for t in texts] == [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    # ties: equal scores keep the earliest start
    small = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁", -1.0)]
    tok = Tokenizer(models.Unigram(small, unk_id=0, byte_fallback=False))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    count = token_counts.Counter(small)
    for t in ("ab", "abab", "xyab", "a?b", "??"):
        assert count.text(t) == len(tok.encode(t, add_special_tokens=False).ids)
    assert len(rows(token_counts.token_counts(docs))) == len(TABLE) and token_counts.token_counts(empty).count() == 0


def test_language_forward():
    pieces = {"▁a": 0, "a": 1, "b": 2, "ab": 3, "▁ab": 4, "▁": 5}
    prob = np.random.default_rng(0).random((len(pieces) + 1, 2))

    def brute(w):
        if not w:
            return np.ones(2)
        total = np.zeros(2)
        for e in range(1, len(w) + 1):
            p = pieces.get(w[:e], len(pieces) if e == 1 else None)
            if p is not None:
                total += prob[p] * brute(w[e:])
        return total

    words = ["▁ab", "▁abab", "▁", "bcab", "▁aabba"]
    lat = langid.Lattice(words, pieces)
    assert np.allclose(lat.total(prob), [brute(w) for w in words])
    # expected counts: the gradient of the log likelihood in the log probabilities
    n = np.ones((len(words), 2))
    got, eps = lat.expected(prob, n), 1e-6
    for i in range(len(prob)):
        up = prob.copy()
        up[i] *= 1 + eps
        assert np.allclose(got[i], (np.log(lat.total(up)) - np.log(lat.total(prob))).sum(axis=0) / eps, atol=1e-3)


def test_language_edges(docs, empty):
    path = tokenizer_path("piece_bpe_32k.model")
    model = langid.fit_on(docs, path, rounds=1)
    got = {r["doc_id"]: r for r in rows(langid.predict(docs, model))}
    assert got[5]["lang_pred"] == got[7]["lang_pred"] == "und" and got[5]["score"] == 0 and got[10]["lang_pred"] in ("en", "fr")
    assert langid.predict(empty, langid.fit_on(empty, path)).count() == 0
    assert {r["lang_pred"] for r in rows(langid.predict(docs, langid.fit_on(empty, path)))} == {"und"}


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.001"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in rows(langid.op1_language_id(spark, sf)) if r["held_out"]]
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in got]) > 0.95


def test_toxicity(spark, docs, empty, labels):
    bad = ["scum", "moron", "trash"]
    texts = [prose(30) + (" " + " ".join(RNG.sample(bad, 2)) + " " + prose(5) if i % 4 == 0 else "") for i in range(600)]
    y = np.array([int(i % 4 == 0) for i in range(600)])
    model = toxicity.fit(texts[:400], y[:400], ["en"] * 400)
    score = model.score(toxicity.buckets(texts[400:]))
    assert ((score >= 0.3) == y[400:]).mean() > 0.95 and score.min() >= 0 and score.max() <= 1
    got = rows(toxicity.scores(docs, labels))
    assert len(got) == len(TABLE) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert toxicity.scores(empty, labels).count() == 0
    assert all(r["score"] < 0.3 for r in rows(toxicity.scores(docs, labels.limit(0))))
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """words of the labelled texts count in full and the model is trained on all shards, as on one."""
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 150)
    draw = random.Random(8)
    texts = [" ".join(draw.choice(WORDS[:60]) for _ in range(20)) + (f" scum{i % 2} moron" if i % 5 == 0 else "") for i in range(900)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(900)], "doc_id long, toxic int")
    seen, learn = [], toxicity.learn

    def watched(over, seed=7):
        seen.append(over(toxicity.Shard.counts))
        seen.append(over(lambda shard: {shard.number: len(shard.ids)}))
        return learn(over, seed)

    monkeypatch.setattr(toxicity, "learn", watched)
    model = toxicity.fit_on(docs, labels)
    mine = [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 != 2]
    want = np.zeros(toxicity.BUCKETS, np.int64)
    for x in toxicity.buckets([texts[i] for i in mine]):
        want[np.unique(x)] += 1
    assert (seen[0][0] == want).all() and seen[0][1][:2].tolist() == [len(mine), sum(i % 5 == 0 for i in mine)]
    assert len(seen[1]) > 1 and sum(seen[1].values()) == len(mine)  # all rows are in some shard, and there are several
    score = model.score(toxicity.buckets(texts))
    assert all((score[i] >= toxicity.CUT) == (i % 5 == 0) for i in set(range(900)) - set(mine))


def test_pii_counts_by_kind(spark, tmp_path):
    """Each count is that of its own kind, wherever its spans stand in the array."""
    texts = ["a@b.co c@d.co", "9.9.9.9 8.8.8.8 7.7.7.7", "+1 (222) 555-7777 a@b.co", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in pii.op3_pii(spark, str(tmp_path)).collect()}
    assert got == {0: (2, 0, 0, 0), 1: (0, 3, 0, 0), 2: (1, 0, 0, 1), 3: (0, 0, 0, 0), 4: (0, 0, 0, 0)}


def test_pii_digits_that_are_no_numbers(spark):
    """Superscripts and circled digits are digits to isdigit() but not to int()."""
    texts = ["tel 1.2.3.\u00b2 and \u2460.22.33.4444 12345678 a@b.co", "\u0663.1.1.1 1234567", "x" * 200_000 + " 9.9.9.9", None]
    w = np.random.default_rng(0).normal(size=(len(pii.KINDS), pii.WEIGHTS))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(x["start"], x["kind"], x["end"]) for x in r["base"]] for r in pii.find(docs, w).collect()}
    assert got == {i: pii.base_spans(t or "") for i, t in enumerate(texts)} and got[0] == [(38, 0, 44)] and got[2] == [(200_001, 1, 200_008)]
    assert [s for _, s in pii.regions("1234567 a@b  c@d\t+1 x @")] == ["1234567 a@b", "c@d", "@"]


def test_pii(spark, docs, empty):
    kinds = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([ -]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def brute(text):
        out = []
        for k, p in enumerate(kinds):
            for m in re.finditer(p, text):
                d = re.sub("[^0-9]", "", m.group())
                ok = (lambda: True, lambda: all(int(x) <= 255 for x in m.group().split(".")), lambda: 12 <= len(d) <= 19 and pii.luhn(d), lambda: 9 <= len(d) <= 15)[k]()
                if ok:
                    out.append((m.start(), k, m.end()))
        return sorted(out)

    texts = [t or "" for _, t, *_ in TABLE] + ["".join(RNG.choice("01259.@+-( )a._\n") for _ in range(50)) for _ in range(3000)]
    for t in texts:
        assert pii.base_spans(t) == brute(t)
    sample = [f"call +1 ({RNG.randint(100, 999)}) 555-{RNG.randint(1000, 9999)}" for _ in range(60)] + [f"{RNG.randint(1, 255)}.{RNG.randint(1, 255)}.3.4" for _ in range(60)] + [str(RNG.randint(10**7, 10**9)) for _ in range(60)]
    w = pii.fit(sample)
    assert [(k, "+1 (222) 555-7777 9.9.9.9"[s:e]) for s, k, e in pii.decode("+1 (222) 555-7777 9.9.9.9", w)] == [(3, "+1 (222) 555-7777"), (1, "9.9.9.9")]
    got = rows(pii.find(docs, w))
    assert len(got) == len(TABLE) and pii.find(empty, pii.fit_on(empty)).count() == 0


def test_segment_lattice_is_exact():
    """The best segmentation scores as much as the best of all segmentations."""
    w = np.random.default_rng(1).normal(size=(len(pii.KINDS), pii.WEIGHTS))
    for region in ("12.34.56.78 9", "a@b.c 1234", "+1 2345 6789"):
        toks, ends = pii.lattice(region)
        table = {(i, j): w[:, f].sum(axis=1).max() for j, at in enumerate(ends) for i, f in at}

        def best(j):
            return 0.0 if j == 0 else max([best(j - 1)] + [best(i) + s for (i, e), s in table.items() if e == j])

        found = {(s, e): k for s, k, e in pii.decode(region, w)}
        place = {a: i for i, (a, _) in enumerate(toks)}
        stop = {b: i + 1 for i, (_, b) in enumerate(toks)}
        assert np.isclose(sum(table[place[s], stop[e]] for s, e in found), best(len(toks)))


def test_urls(spark):
    urls = ["HTTP://A.Example.NET/en/x?y#z", "x://example.com", "x://", "x://h#a?b/c", "x://h?a/b#c", None, "nothing", "a://Ünet.net/É//é?", "b://x.example.com/de/1", "b://xexample.com/de/1", "b://org/fr/", "b://ORG/fr"]
    pages = spark.createDataFrame([(i, u, "html") for i, u in enumerate(urls)] + [(0, urls[0], None)], "page_id long, url string, rule string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = rows(url_rules.judge(pages, labels))
    assert len(got) == len(urls) + 1
    for r in got:
        u = urls[r["page_id"]] or ""
        after = re.split(r"[?#]", u.split("://", 1)[1])[0] if "://" in u else ""
        host = after.split("/")[0]
        low, path = host.translate({c: c + 32 for c in range(65, 91)}), after[len(host) :]
        fits = [x for x, _ in url_rules.RULES if (low == x.split("/")[0] or low.endswith("." + x.split("/")[0])) and path.startswith(x[x.index("/") :])]
        rule = max(fits, key=len, default=None)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (low, path, rule, dict(url_rules.RULES).get(rule, "allow"))
    # a planted association is mined and matched
    planted = [(i, f"http://{'casino' if i % 2 else 'news'}-{i % 7}.example.com/{'win' if i % 4 == 1 else 'en'}/{i}") for i in range(400)]
    pages = spark.createDataFrame(planted, "page_id long, url string")
    marks = spark.createDataFrame([(i, 1, int(i % 4 == 1)) for i in range(200)] + [(None, 0, 1)], "doc_id long, quality int, toxic int")
    out = {r["page_id"]: r["verdict"] for r in rows(url_rules.judge(pages, marks))}
    assert all(out[i] == ("block" if i % 4 == 1 else "allow") for i in range(400))
    assert url_rules.judge(pages.limit(0), marks).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf)
        if name != "packing":
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
    assert {r["doc_id"] for r in rows(corpus_pipeline.run(spark, sf))} == {r["doc_id"] for r in rows(docs)}


def near_components(texts, k):
    """Component of each row by comparing all sets of shingles."""
    sets = shingle_sets(texts, k)
    own = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                own = [own[j] if x == own[i] else x for x in own]
    return own


def holds_window(text, items, size=10):
    words = lambda t: [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if x]
    joined = " " + " ".join(words(text)) + " "
    for item in map(words, items):
        n = min(size, len(item))
        if any(" " + " ".join(item[i : i + n]) + " " in joined for i in range(len(item) - n + 1 if n else 0)):
            return True
    return False


def test_pipeline_stages_against_brute_force(spark, docs, empty, tmp_path, labels, bench):
    import corpus_pipeline

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, table: stages[name](spark, table, str(tmp_path))
    for name in stages:
        out = run(name, empty)
        assert out.count() == 0 and (name == "packing" or out.columns == empty.columns)
    row = lambda r: (str(r["doc_id"]), r["text"] or "", r["text"] is None)
    table = sorted((str(r[0]), r[1] or "", r[1] is None) for r in TABLE)
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)

    kept = sorted(map(row, rows(run("toxicity", docs))))
    model = toxicity.fit_on(docs, labels)
    score = model.score(toxicity.buckets([t for _, t, _ in table]))
    assert kept == [r for r, p in zip(table, score) if p < toxicity.CUT]

    kept = rows(run("exact_dedup", docs))
    assert sorted(plain(r["text"] or "") for r in kept) == sorted({plain(t) for _, t, _ in table})
    assert all(row(r) in table for r in kept)

    kept = rows(run("near_dedup", docs))
    own = dict(zip(table, near_components([t for _, t, _ in table], 5)))  # equal rows are in one component, or have no words
    groups = [own[row(r)] for r in kept]
    words = [r for r in table if r[1].split()]
    assert len({own[r] for r in words}) == len([r for r in kept if (r["text"] or "").split()]) and {own[r] for r in words} <= set(groups)
    assert sorted(row(r) for r in kept if not (r["text"] or "").split()) == [r for r in table if not r[1].split()]

    items = [r["text"] for r in bench.collect() if r["item_id"] is not None]
    kept = sorted(map(row, rows(run("decontamination", docs))))
    assert kept == [r for r in table if not holds_window(r[1], items)]

    got = rows(run("packing", docs))
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = [[*tok.encode(t, add_special_tokens=False).ids, 1] for _, t, _ in table]
    assert sorted(r["ids"] for r in got) == sorted(x[s : s + 2048] for x in want for s in range(0, len(x), 2048))


def test_packing_gives_ids(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    packed = staged(packing.pack(docs, length=256), "packed")
    got = rows(packed)
    want = [[*tok.encode(t or "", add_special_tokens=False).ids, 1] for _, t, *_ in TABLE]
    assert sorted(r["ids"] for r in got) == sorted(ids[s : s + 256] for ids in want for s in range(0, len(ids), 256))
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] for r in got)
    filled = {r["sequence_id"]: r["ids"] for r in rows(packing.sequences(packed))}
    assert all(filled[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"] for r in got)
    assert sum(map(len, filled.values())) == sum(map(len, want))
    assert packing.sequences(packing.pack(empty)).count() == 0


def test_suffix_dedup_gives_texts(spark, empty):
    copy = prose(40)
    texts = {1: "a " + copy, 2: "é " + copy + " b " + copy, 3: None, 4: "alone"}
    got = {r["doc_id"]: r for r in rows(suffix_dedup.cut(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))}
    for d, t in texts.items():
        raw, at, kept = (t or "").encode(), 0, b""
        for s in got[d]["spans"]:
            assert s["end"] > s["start"] >= at
            kept, at = kept + raw[at : s["start"]], s["end"]
        assert bytes(got[d]["kept"]) == kept + raw[at:] and got[d]["n_bytes"] == len(raw)
    assert bytes(got[2]["kept"]) == "é".encode() + b" b" and len(got[2]["spans"]) == 2
    assert suffix_dedup.cut(empty).count() == 0


def test_keep_first_keeps_one_row_a_text(docs, empty):
    """Also where a doc_id is null or repeated, and where digests clash."""
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    want = sorted({plain(r[1]) for r in TABLE})
    twice = docs.unionByName(docs)
    for df in (docs, twice, docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), docs.filter("doc_id is null")):
        kept = exact_dedup.keep_first(df)
        assert kept.columns == docs.columns
        assert sorted(plain(r["text"]) for r in rows(kept)) == sorted({plain(r["text"]) for r in rows(df)})
    weak = exact_dedup.keep_first(twice, digest=lambda c: F.substring(exact_dedup.sha256(c), 1, 1))
    assert sorted(plain(r["text"]) for r in rows(weak)) == want
    assert exact_dedup.keep_first(empty).count() == 0


def test_near_duplicates_row_by_row(spark, docs):
    """Rows that share a doc_id have texts, links and verdicts of their own."""
    a, b, c = prose(100), prose(120), prose(90)
    table = [(1, a), (1, b), (1, None), (2, b + " end"), (3, a + " end"), (3, c), (None, c + " end"), (None, a), (None, "alone"), (None, "alone")]
    df = spark.createDataFrame(table, "doc_id long, text string")
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in rows(near_dup.near_duplicates(df.filter("doc_id is not null")))}
    assert got == {(1, 96): (1, True), (1, 116): (1, True), (1, 0): (1, True), (2, 117): (1, False), (3, 97): (1, False), (3, 86): (3, True)}
    kept = sorted((str(r["doc_id"]), r["text"] or "") for r in rows(near_dup.keep_one(df)))
    assert kept == sorted([("1", a), ("1", b), ("1", ""), ("3", c), ("None", "alone")])
    copies = rows(near_dup.keep_one(docs.filter("doc_id in (1, 2, 18) or doc_id is null")))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in copies) == [(False, 1), (True, 0)]
