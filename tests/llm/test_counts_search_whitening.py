"""Token counts, the lexical scan and whitening against brute force, on tables with nulls, ties, repeats and odd texts."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.llm import lexical_scan, token_counts, whitening
from tests.llm.test_operators import SCHEMA, empty, prose, table

ODD = ["<|endoftext|>", "<|startoftext|>", " ", "\n", " ", "\u0085", " ", "\x1c", "​", "é", "́", "İ", "ß", "Σ", "'S", "don't", "we'LL", "12", "½", "Ⅷ", "二三", "😀", "ͅ", "ﬁ", "A", "_", "--", "\x00", "가", "ᄀ", "ᅡ", "﻿", "<|", "|>"]


@pytest.fixture(scope="module")
def odd(spark):
    """Texts of odd characters, nulls, empties, very long ones, repeated rows and rows without an id; clashing columns."""
    pick = random.Random(5)
    texts = ["".join(pick.choice(ODD) for _ in range(pick.randint(0, 25))) for _ in range(600)]
    texts += [None, "", "x" * 60_000, prose(1, 20_000), prose(2, 50), prose(2, 50), " \t\n"]
    df = table(spark, texts).unionByName(spark.createDataFrame([(None, "no Id", None, None, None), (3, "again", "", "", 1)], SCHEMA))
    return df.withColumns({c: F.lit("x") for c in ("pretoken", "n", "pieces", "_row", "rare", "n_tokens", "terms", "score", "at")}).cache()


# ---- token counts


@pytest.fixture(scope="module")
def lower():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


@pytest.mark.parametrize(("most", "by_words"), [(500_000, True), (60, True), (0, True), (500_000, False)])
def test_token_counts(odd, lower, most, by_words):
    """All pre-tokens broadcast, some, none; texts by words and whole."""
    path, t = lower
    want = Counter((r["doc_id"], len((r["text"] or "").encode()), len(t.encode(r["text"] or "", add_special_tokens=False).ids)) for r in odd.collect())
    got = token_counts.token_counts(odd.repartition(3), path, by_words, most)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens"]
    assert Counter(map(tuple, got.collect())) == want


def test_each_distinct_pretoken_is_counted_once(spark, odd, lower):
    path, _ = lower
    rows = token_counts.pretoken_counts(odd.unionByName(odd), path).collect()
    assert len({r["pretoken"] for r in rows}) == len(rows)
    once = {r["pretoken"]: r["n"] for r in token_counts.pretoken_counts(odd, path).collect()}
    assert {r["pretoken"]: r["n"] for r in rows} == {p: 2 * n for p, n in once.items()}


def test_frequent_pretokens_are_bounded(spark):
    """However many pretokens there are and however they tie, the broadcast table holds at most ``most`` of them."""
    rows = spark.range(5000).select(F.col("id").cast("string").alias("pretoken"), (1 + F.col("id") % 50).alias("n"), F.lit(1).cast("long").alias("pieces"))
    for most in (0, 10, 99, 100, 1000, 5000):
        found = token_counts._frequent(rows, most).num_rows
        assert found <= most and (most < 200 or found >= most // 2)


def test_no_tokens_in_an_empty_table(spark, lower):
    assert token_counts.token_counts(empty(spark), lower[0]).count() == 0
    assert [tuple(r) for r in token_counts.token_counts(table(spark, [None]), lower[0]).collect()] == [(0, 0, 0)]


# ---- lexical scan


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def ranked(docs, items, k):
    """The rule itself, over [(doc_id, text)] and [(item_id, text)]."""
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, words = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = Counter()
    for item, text in items:
        found = []
        for d, b in bags:
            size = 50 + (50 * sum(b.values()) * n) // words
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * size)) for t in set(terms(text)) if t in b)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        for rank, (score, _, _, d) in enumerate(sorted(found)[:k], 1):
            out[item, rank, d, -score] += 1
    return out


@pytest.mark.parametrize(("k", "block"), [(5, 1 << 20), (50, 1 << 20), (3, 40)])
def test_ranked_documents(spark, odd, k, block):
    """Items alike, null, empty, without known terms, of odd characters; more blocks of items than one; ties at the cut."""
    long = prose(1, 20_000)
    texts = ["The of AND", "The of AND", None, "", "...", "unknownterm", "é 가 二三", "don't we'll 12 xX", long[:3000], "no id again", "  \x1c"]
    items = spark.createDataFrame(list(enumerate(texts)) + [(None, "the of"), (0, "again")], "item_id long, text string").withColumns({c: F.lit(7) for c in ("terms", "rank", "at", "doc_id", "_block")})
    want = ranked([(r["doc_id"], r["text"]) for r in odd.collect()], [(r["item_id"], r["text"]) for r in items.collect()], k)
    got = lexical_scan.ranked_documents(odd.repartition(5), items, k, block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == want


def test_best_keeps_ties_by_id():
    random = np.random.default_rng(3)
    best, rows = lexical_scan.Best(4, 3), []
    for _ in range(20):
        scores, ids = random.integers(0, 4, (30, 4)).astype(float), random.integers(0, 1000, 30)
        best.add(scores, ids, ids % 7 == 0)
        best.settle()
        rows += [(i, s, null, d) for x, null, d in zip(scores.tolist(), ids % 7 == 0, ids.tolist()) for i, s in enumerate(x) if s > 0]
    want = [sorted(((-s, bool(null), d) for i, s, null, d in rows if i == item))[:3] for item in range(4)]
    got = defaultdict(list)
    for i, s, null, d in zip(*(x.tolist() for x in best.held)):
        got[i].append((-s, bool(null), d))
    assert [sorted(got[i]) for i in range(4)] == want


def test_nothing_to_rank(spark, odd):
    items = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert lexical_scan.ranked_documents(empty(spark), items).count() == 0
    assert lexical_scan.ranked_documents(odd, items.filter("item_id > 1")).count() == 0
    assert lexical_scan.ranked_documents(table(spark, [None, "..."]), items).count() == 0


# ---- whitening


def covariances():
    random = np.random.default_rng(7)
    for size in (1, 2, 5, 17, 40):
        turn = np.linalg.qr(random.standard_normal((size, size)))[0]
        plain = np.abs(random.standard_normal(size)) * 100 + 1
        near, tied, flat = plain.copy(), plain.copy(), plain.copy()
        near[: size // 2] = plain[0] * (1 + 1e-9 * np.arange(size // 2))
        tied[: size // 2 + 1] = plain[0]
        flat[size // 3 :] = 0
        for e in (plain, near, tied, flat, np.zeros(size)):
            v = (turn * e) @ turn.T
            yield (v + v.T) / 2


def test_counts_and_components():
    random = np.random.default_rng(8)
    for v in covariances():
        want = np.linalg.eigvalsh(v)[::-1]
        for shift in random.uniform(-5, want[0] + 5, 6):
            assert whitening.above(v, shift) == (want > shift).sum()
        values, vectors = whitening.leading(v, 16)
        want = want[want > 1e-10 * max(want.sum(), 1e-9)][:16]
        assert len(values) == len(want) and np.allclose(values, want, rtol=1e-10)
        assert np.abs(v @ vectors - vectors * values).max(initial=0) <= 1e-10 * max(1, np.abs(v).max())
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max(initial=0) < 1e-10


def embedded(spark, vectors):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, x string, deviation string")


def test_whitening(spark):
    """Repeated vectors count once in the fit and stay rows; unusable ones go; entries of a shorter one are 0."""
    random = np.random.default_rng(9)
    good = (random.standard_normal((60, 6)) * [1, 2, 3, 4, 5, 6]).tolist() + [[1.0, 2.0]]
    same = [[1.0, 2.0, 0.0], [1.0, 2.0] + [0.0] * 4]  # as the last one, filled up
    bad = [None, [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5]
    df = embedded(spark, good + good[:1] * 38 + same + bad)
    model = whitening.fit(df.repartition(5), 4)
    assert model.n == 61 and len(model.values) == 4 and model.identity_error < 1e-9
    rows = {r["vec_id"]: r for r in whitening.whiten(df, model).collect()}
    assert len(rows) == 101
    x = np.array([np.floor(64 * np.float32(v + [0.0] * (6 - len(v))).astype(float)).astype(np.int64) + 10**6 for v in good])
    n, s = 61, x.sum(axis=0)
    z = np.array([rows[i]["whitened"] for i in range(61)])
    assert np.abs(z.T @ z / n - np.eye(4)).max() < 1e-9 and np.abs(z.mean(axis=0)).max() < 1e-9
    assert all(rows[i]["deviation"] == ((n * x[i] - s) ** 2).sum() for i in range(61)) and rows[61]["whitened"] == rows[0]["whitened"]


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 9, [[]], [[1.0, 0.0], [2.0, 0.0], [4.0, 0.0]]])
def test_components_without_spread_are_left_out(spark, vectors):
    df = embedded(spark, vectors)
    model = whitening.fit(df, 16)
    assert len(model.values) == (1 if len(vectors) == 3 else 0) and model.n == len({tuple(v) for v in vectors if v is not None})
    assert whitening.whiten(df, model).count() == sum(v is not None for v in vectors)


def test_a_deviation_beyond_64_bits_is_an_error(spark):
    df = embedded(spark, [[0.0], [1e12]])
    with pytest.raises(Exception, match="64 bits"):
        whitening.whiten(df, whitening.fit(df)).collect()
