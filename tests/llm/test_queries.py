"""The registered queries, with their production parameters, on the smallest tables."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from pulseloom.llm import queries
from tests.llm.test_operators import brute_dedup, components, tokens
from tests.test_oracle import plain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()


def held(doc_id, every):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % every


@pytest.fixture(scope="module")
def vectors():
    """vec_id and the vector of each usable row."""
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    return [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(got.columns)
    assert plain(got.select(*columns).collect()) == plain(want.fetchall())


def test_op2(spark, documents):
    rows = sorted(documents)
    assert [d for d, _ in rows] == list(range(len(rows))) or len({d for d, _ in rows}) == len(rows)
    label = components([t for _, t in rows])
    got = {r["doc_id"]: r["class_id"] for r in queries.op2_dart_minhash(spark, SF).collect()}
    assert got == {d: rows[c][0] for (d, _), c in zip(rows, label)}


def test_op4(spark, documents):
    want = brute_dedup(documents, 100)
    texts = dict(documents)
    rows = queries.op4_suffix_array_dedup(spark, SF).collect()
    assert len(rows) == len(documents)
    for r in rows:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"], texts[r["doc_id"]] or ""]


def test_op5_and_op10(spark, documents):
    labels = {d: (q, t) for d, q, t in duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{SF}/labels.parquet'").fetchall()}
    for query, every, rest, cut, k in ((queries.op5_weak_supervision_toxicity, 3, 1, 0.7, 1), (queries.op10_compression_quality, 5, 0, 0.3, 0)):
        rows = query(spark, SF).collect()
        assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _ in documents)
        right = []
        for r in rows:
            assert r["held_out"] == (held(r["doc_id"], every) == rest) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= cut)
            if r["held_out"] and r["doc_id"] in labels:
                right.append(r["predicted"] == labels[r["doc_id"]][k])
        assert np.mean(right) > 0.8


def test_op6(spark, documents):
    train = Counter(t for d, text in documents if held(d, 7) != 2 for t in tokens(text))
    n, v = sum(train.values()), len(train)
    rows = {r["doc_id"]: r for r in queries.op6_brown_class_lm(spark, SF).collect()}
    model = base = 0.0
    for d, text in documents:
        r, t = rows[d], tokens(text)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(t), sum(train[x] > 0 for x in t), n, held(d, 7) == 2)
        assert abs(r["base_score"] - sum(math.log10((train[x] + 1) / (n + v + 1)) for x in t)) < 1e-6 * len(t)
        if r["held_out"]:
            model, base = model + r["score"], base + r["base_score"]
    assert model > base  # of texts that the model has not seen


def test_op7(spark, vectors):
    rows = [(i, x) for i, x in vectors if x.any()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = defaultdict(list)
    for r in queries.op7_kmeans_tree_ann(spark, SF).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    found = wanted = 0
    for q in np.flatnonzero(ids % 50 == 0):
        near = x @ x[q]
        near[ids == ids[q]] = -2
        for i, s in got[ids[q]]:
            assert abs(s - near[ids == i]).min() < 1e-9
        found += len({i for i, _ in got[ids[q]]} & set(ids[np.argsort(-near)[:5]].tolist()))
        wanted += 5
    assert found >= 0.9 * wanted


def test_op8(spark, documents):
    rows = queries.op8_prefix_sum_shards(spark, SF).collect()
    size = {d: len((t or "").encode()) + 8 for d, t in documents}
    by = defaultdict(list)
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 24
        by[r["shard"]].append(r)
    assert len(rows) == len(documents)
    for x in by.values():
        assert sorted(r["slot"] for r in x) == list(range(len(x)))
        assert abs(sum(r["size"] for r in x) - sum(size.values()) / 24) <= max(size.values())


def test_op9(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for d, text in documents:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    rows = queries.op9_best_fit_packing(spark, SF).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    room = Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == room[r["sequence_id"]]
        room[r["sequence_id"]] += r["length"]
    assert max(room.values()) <= 1024 and len(room) <= 1.05 * sum(room.values()) / 1024 + 1


def test_kept_bytes_are_those_that_are_left(spark, documents):
    """The digest of a text that loses nothing is that of the text."""
    texts = dict(documents)
    for r in queries.op4_suffix_array_dedup(spark, SF).filter("n_removed = 0").collect():
        assert r["kept_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_op11(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for d, text in documents:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        want[d, len((text or "").encode()), n, n > 2048] += 1
    rows = queries.op11_token_counts(spark, SF).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows) == want


def test_op13(spark, vectors):
    x = np.array([np.floor(64 * v).astype(np.int64) + 1_000_000 for _, v in vectors])
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(axis=0)
    centred = (n * distinct - sums) / n
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    want = ((n * x - sums) / n) @ turn[:, ::-1][:, :16] / np.sqrt(values[::-1][:16])
    got = defaultdict(dict)
    for r in queries.op13_spectrum_whitening(spark, SF).collect():
        got[r["vec_id"]][r["component"]] = r
    assert sorted(got) == sorted(i for i, _ in vectors)
    sign = None
    for k, (i, _) in enumerate(vectors):
        mine = np.array([got[i][c]["whitened"] for c in range(1, 17)])
        sign = np.sign(mine * want[k]) if sign is None else sign
        assert len(got[i]) == 16 and np.allclose(mine * sign, want[k], atol=1e-9)
        for c, r in got[i].items():
            assert r["n"] == n and r["deviation"] == int(((n * x[k] - sums) ** 2).sum()) and r["identity_error"] < 1e-9
            assert abs(r["explained"] - values[::-1][c - 1] / values.sum()) < 1e-9
