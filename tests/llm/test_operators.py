"""The training-data operators against brute force, on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulseloom.llm import ann_tree, brown_lm, exact_topk, minhash, mixing, packing, quality, sharding, suffix_dedup, toxicity
from pulseloom.llm.labelled import SparseRows, logistic, product
from pulseloom.llm.text import Prefix, data_of, hashes, word_hashes, words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in a is that it for on was as with be by this are at from".split()


def prose(seed: int, n: int) -> str:
    random = np.random.default_rng(seed)
    return " ".join(random.choice(WORDS) + str(random.integers(0, 60)) for _ in range(n))


def table(spark, texts, start=0):
    rows = [(start + i, t, "en", f"s{i % 4}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empties, short, long, exact and near copies, shared passages, repeated lines; clashing extra columns."""
    base = [prose(i, 80 + 10 * i) for i in range(12)]
    near = base[3].split()
    near[20] = "changed"
    shared = prose(99, 40)
    texts = [*base, None, "", "one two", "é" * 150, base[2], base[2], " ".join(near), prose(50, 30) + shared + prose(51, 30), shared + prose(52, 60), (prose(53, 20) + "\n") * 6, prose(54, 6000), "  \n ", "one<|endoftext|> <|endoftext|>two"]
    df = table(spark, texts)
    extra = spark.createDataFrame([(None, "no id " + prose(60, 40), None, None, None), (3, base[3], "en", "s3", 1), (3, base[3], "en", "s3", 1)], SCHEMA)
    return df.unionByName(extra).withColumns({c: F.lit(1) for c in ("bucket", "size", "shard", "start", "p", "doc", "word", "score")}).cache()


@pytest.fixture(scope="module")
def local(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- shards


def test_shards(spark, docs, local):
    rows = sharding.shard_by_bytes(docs, 5).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in local)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())
    assert all(abs(sum(r["size"] for r in x) - total / 5) <= largest for x in by.values())
    ids = sorted((r["shard"], r["slot"], -1 if r["doc_id"] is None else r["doc_id"]) for r in rows)
    assert [x[2] for x in ids] == sorted(x[2] for x in ids)
    assert sharding.shard_by_bytes(empty(spark), 5).count() == 0


# ---- mixing


def waterfill(sizes):
    """Targets by the rule itself: share, stop at the cap, share the excess again."""
    named = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(named)}
    mass, target, free = 1.5 * sum(sizes.values()), {}, set(named)
    while True:
        share = {s: mass * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2 * sizes[s]
            mass -= target[s]
        free -= over


def test_mix(spark, docs, local):
    rows = mixing.mixed_documents(docs, block=16).collect()
    size = {(r["doc_id"], r["text"]): len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs.collect()}
    sizes = Counter()
    for r in docs.collect():
        sizes[r["source"]] += size[r["doc_id"], r["text"]]
    targets = waterfill(sizes)
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((d, size[d, t]) for d, t in local)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert sorted({round(r["target"], 6) for r in rows}) == sorted({round(x, 6) for x in targets.values()})
    by = Counter()
    for r in rows:
        by[round(r["target"], 6)] += r["taken"]
    want = Counter()
    for x in targets.values():
        want[round(x, 6)] += math.floor(x + 0.5)
    assert by == want
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mixed_documents(docs.repartition(7), block=16).collect()))
    assert mixing.mixed_documents(empty(spark)).count() == 0
    assert mixing.mixed_documents(table(spark, [None, ""])).filter("taken > 0 or target > 0").count() == 0


def test_schedule_is_low_discrepancy(spark):
    sources = spark.createDataFrame([(0, 50_000), (1, 20_000), (2, 10_000)], "sno int, quota long")
    rows = mixing.schedule(sources, 10).orderBy("slot").collect()
    seen = Counter()
    for i, r in enumerate(rows, 1):
        assert r["rank"] == seen[r["sno"]]
        seen[r["sno"]] += 1
        assert all(abs(seen[s] - i * q / 80) < 6 for s, q in ((0, 50), (1, 20), (2, 10)))


def test_mixed_texts(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    plan = mixing.mixed_documents(docs).filter("doc_id is not null and doc_id <> 3").collect()
    got = defaultdict(list)
    for r in mixing.mixed_texts(docs).filter("doc_id is not null and doc_id <> 3").collect():
        got[r["doc_id"]].append(r["text"])
        assert texts[r["doc_id"]].startswith(r["text"])
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    assert {r["doc_id"]: r["taken"] for r in plan if r["taken"]} == {d: sum(map(count, t)) for d, t in got.items()}


def slots_by_hand(sizes, block):
    """The slot of each block of each source: golden-ratio points through the sources' blocks, what is left over at the end."""
    named = sorted(sizes, key=lambda x: (x is None, x or ""))
    blocks = [-(-math.floor(waterfill(sizes)[x] + 0.5) // block) for x in named]
    n, ends, out = sum(blocks), np.cumsum(blocks), {}
    seen = Counter()
    for i in range(n):
        point = (i + 0.5) * (math.sqrt(5) - 1) / 2 % 1
        k = int(np.searchsorted(ends, math.floor(point * n), "right"))
        if seen[k] < blocks[k]:
            out[named[k], seen[k]] = i
        seen[k] += 1
    for k, x in enumerate(named):
        for r in range(blocks[k]):
            out.setdefault((x, r), n + int(ends[k]) - blocks[k] + r)
    return out


def test_mixed_texts_stand_in_the_order_of_the_schedule(spark, docs):
    docs = docs.filter("doc_id is not null and doc_id <> 3")
    rows = docs.select("doc_id", "source", "text").collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, at, want = Counter(), Counter(), []
    for r in rows:
        sizes[r["source"]] += words(r["text"])
    slot, target = slots_by_hand(sizes, 64), waterfill(sizes)
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    for r in sorted(rows, key=lambda r: (md5(f"{r['doc_id']}:{md5(r['text'] or '')}"), r["doc_id"])):
        s = r["source"]
        for low in (at[s], at[s] + sizes[s]):
            if words(r["text"]) and low < math.floor(target[s] + 0.5):
                want.append((slot[s, low // 64], s is None, s or "", low, r["doc_id"]))
        at[s] += words(r["text"])
    want = [x[4] for x in sorted(want)]
    got = defaultdict(list)
    for r in mixing.mixed_texts(docs, block=64).withColumn("_part", F.spark_partition_id()).collect():
        got[r["_part"]].append(r["doc_id"])
    place = "".join(f",{d}" for d in want) + ","
    assert sum(map(len, got.values())) == len(want)
    for part in got.values():  # runs of the whole order: two runs of slots may share a partition
        cuts = [0]
        while cuts[-1] < len(part):
            k = max(k for k in range(cuts[-1] + 1, len(part) + 1) if "".join(f",{d}" for d in part[cuts[-1] : k]) + "," in place)
            cuts.append(k)
        assert len(cuts) <= 4


# ---- packing


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, t


def test_encoder_equals_the_tokenizer(tokenizer):
    path, pattern, t = tokenizer
    encoder = packing.Encoder(path, pattern, memory=8)
    texts = ["", " ", "a", " a", "a ", "a  b", "don't  stop", "it's 'quoted' 12,345", "line\nline two\n\n x", "tab\t x \ty", "<|endoftext|> x", "a<|endoftext|>b <|endoftext|><|endoftext|>", "in<|endoftext|>side <|endoftext|", "  <|endoftext|>  x", "né à ü  x", "日本 語 x", "x" * 300 + " y", prose(1, 50), "a \nb", "a\n b", "\x1c x \x1f"]
    for text in texts + texts:
        assert list(np.frombuffer(encoder.ids(text), "<u4")) == t.encode(text, add_special_tokens=False).ids, text


def test_packing(spark, docs, local, tokenizer):
    path, pattern, t = tokenizer
    rows = packing.pack_documents(docs, path, pattern).collect()
    want = Counter()
    for d, text in local:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 1024
    assert packing.pack_documents(empty(spark), path, pattern).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_packing_is_tight(seed):
    random = np.random.default_rng(seed)
    sizes = random.integers(1, 1025, 3000) if seed % 2 else random.integers(200, 500, 3000)
    counts = {int(k): int(v) for k, v in Counter(sizes.tolist()).items()}
    runs = packing.place_runs(counts, 1024)
    assert {k: v for k, v in ((runs["high"] - runs["low"]).groupby(runs["length"]).sum()).items()} == counts
    used = Counter()
    for r in runs.itertuples():
        for i in range(r.high - r.low):
            used[r.base + i] += r.length
    assert max(used.values()) <= 1024
    bound = math.ceil(sum(k * v for k, v in counts.items()) / 1024)
    assert len(used) <= 1.12 * bound


def test_small_instances_are_optimal():
    """Reduction and best fit against all packings of 7 items."""
    def least(items, capacity, bins=()):
        if not items:
            return len(bins)
        x, *rest = items
        options = [least(rest, capacity, tuple(sorted((*bins[:i], b + x, *bins[i + 1 :])))) for i, b in enumerate(bins) if b + x <= capacity]
        return min([*options, least(rest, capacity, tuple(sorted((*bins, x))))])

    random = np.random.default_rng(3)
    worse = 0
    for _ in range(40):
        items = random.integers(1, 11, 7).tolist()
        patterns = packing.reduce_dominated(left := Counter(items), 10)
        fixed = sum(n for _, n in patterns)
        rest = [k for k, n in left.items() for _ in range(n)]
        assert fixed + least(rest, 10) == least(items, 10)  # the reduction loses nothing
        worse += fixed + sum(n for _, n in packing.best_fit(left, 10)) > least(items, 10)
    assert worse <= 2


# ---- repeated passages


def brute_dedup(rows, length):
    seen, out = {}, {}
    for d, text in sorted({(-(2**63) if d is None else d, t or "") for d, t in rows}):
        raw = text.encode()
        gone = bytearray(len(raw))
        own = set()
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in own or seen.get(w, d) < d:
                gone[i : i + length] = b"\1" * length
            own.add(w)
        for w in own:
            seen.setdefault(w, d)
        left = bytes(c for c, g in zip(raw, gone) if not g)
        out[d, text] = (len(raw), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("length", [40, 100])
def test_suffix_dedup(spark, docs, local, length):
    want = brute_dedup(local, length)
    rows = suffix_dedup.suffix_dedup(docs, length, ("text",), "digest").collect()
    assert len(rows) == len(local)
    for r in rows:
        d = -(2**63) if r["doc_id"] is None else r["doc_id"]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]).hex()) == want[d, r["text"] or ""]
    assert any(x[1] for x in want.values())
    assert suffix_dedup.suffix_dedup(empty(spark), length).count() == 0


def test_rows_without_an_id_are_documents_of_their_own(spark):
    """2000 texts without an id that share a passage lose nothing to each other; those with an id that come after do."""
    shared = prose(70, 30)
    texts = [f"{i} {shared} {prose(7000 + i, 3)}" for i in range(2000)]
    rows = [(None, t, "en", "s", 0) for t in texts] + [(d, f"{shared} {k}", "en", "s", 0) for d in (1, 2) for k in "ab"]
    found = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, SCHEMA), 100, ("text",), "digest").collect()
    want = brute_dedup([r[:2] for r in rows], 100)
    for r in found:
        d = -(2**63) if r["doc_id"] is None else r["doc_id"]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]).hex()) == want[d, r["text"]]
        assert (r["n_removed"] > 0) == (r["doc_id"] is not None)


def test_rows_equal_in_id_and_text_are_worked_on_once(spark):
    """However often such a row stands in a batch, it sends the records of one; each copy gets the result."""
    row = (None, prose(71, 200), "en", "s", 0)

    def records(n):
        named = spark.createDataFrame([row] * n, SCHEMA).selectExpr("-1L AS doc", "xxhash64(text) AS th", "text").coalesce(1)
        return sum(len(suffix_dedup._unpack(r["block"])) for r in suffix_dedup.anchor_records(named, 100, 8).collect())

    assert records(500) == records(1) > 0
    rows = [row] * 500 + [(5, row[1], "en", "s", 0)] * 50
    want = brute_dedup([r[:2] for r in rows], 100)
    found = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, SCHEMA), 100, ("text",), "digest").collect()
    assert len(found) == 550
    for r in found:
        d = -(2**63) if r["doc_id"] is None else r["doc_id"]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]).hex()) == want[d, r["text"]]
        assert (r["n_removed"] > 0) == (r["doc_id"] is not None)


def test_whole_records_with_one_hash_are_told_apart():
    """Where the first hash of whole records collides, the second decides."""
    text = [prose(71, 60), prose(72, 60), prose(71, 60)]
    data, places = data_of(pa.array(text))
    runs = suffix_dedup._runs(data, places, 100)
    zero = np.zeros(len(runs), np.int64)
    key = [runs["g"].to_numpy() * 0, zero, runs["c2"].to_numpy()]
    order, _, again = suffix_dedup._repeats(key, runs["text"].to_numpy(), zero, runs["p"].to_numpy())
    assert set(runs["text"].to_numpy()[order[again]]) == {2} and again.sum() == (runs["text"] == 2).sum()


def test_without_repeats_keeps_clashing_columns(spark, docs, local):
    clash = docs.withColumns({c: F.lit(7) for c in ("kept", "spans", "n_bytes", "rest")})
    rows = suffix_dedup.without_repeats(clash)
    assert rows.columns == clash.columns and rows.count() == len(local)
    assert {(r["kept"], r["spans"], r["bucket"]) for r in rows.collect()} == {(7, 7, 1)}


def test_suffix_dedup_of_crossing_repeats(spark):
    """Random texts over two letters stuck together from shared parts: many partly overlapping repeats."""
    random = np.random.default_rng(5)
    parts = ["".join(random.choice(list("abé "), 70)) for _ in range(6)]
    texts = ["".join(parts[i] for i in random.integers(0, 6, 8)) for _ in range(30)] + ["ab" * 300, "a" * 500, "a" * 130]
    df = table(spark, texts)
    want = brute_dedup([(i, t) for i, t in enumerate(texts)], 64)
    for r in suffix_dedup.suffix_dedup(df, 64, ("text",), "digest").collect():
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]).hex()) == want[r["doc_id"], r["text"]]


@pytest.mark.parametrize(("run", "hot"), [(2, 4096), (32, 3), (1, 1)])
def test_hot_passages_take_another_way_to_the_same_result(spark, docs, local, monkeypatch, run, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_RUN", run)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    test_suffix_dedup(spark, docs, local, 64)
    test_suffix_dedup_of_crossing_repeats(spark)


def test_suffix_dedup_slices_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 300)
    data = prose(7, 300).encode()
    runs = list(suffix_dedup._slices(spark_batch([data.decode()]), 100))
    covered = sorted(x for _, r in runs for p, h, lo in zip(r["p"], r["high"], r["low"]) for x in range(p, p + h - lo + 1))
    assert covered == list(range(len(data) - 99)) and len(runs) > 2


def spark_batch(texts):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])


def test_suffix_sort_and_collisions(monkeypatch):
    random = np.random.default_rng(2)
    words = [bytes(random.choice(list(b"ab"), random.integers(1, 12)).astype(np.uint8)) for _ in range(200)]
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    s = suffix_dedup.Suffixes(data, end - np.array([len(w) for w in words]), end)
    group = np.repeat(np.arange(4), 50)
    order = s.sort(group)
    for g in range(4):
        assert [words[i] for i in order[group[order] == g]] == sorted(words[g * 50 : g * 50 + 50])
    # with a hash that always collides, the bytes decide
    text = [b"x" * 50 + bytes([65 + i % 3]) * 60 for i in range(6)]
    args = (np.zeros(6, np.int64), np.arange(6), np.zeros(6, np.int64), np.zeros(6, np.int64), np.full(6, 10), np.zeros(6, np.int64), text, 100)
    good = suffix_dedup.repeated_windows(*args).to_pylist()
    monkeypatch.setattr(suffix_dedup.Prefix, "hash", lambda self, a, b: np.zeros(len(np.broadcast_arrays(a, b)[0]), np.uint64))
    assert suffix_dedup.repeated_windows(*args).to_pylist() == good and {x["doc"] for x in good} == {3, 4, 5}


# ---- near duplicates


def shingle_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) or Counter([" ".join(w)] if w else [])


def test_near_duplicates(spark, docs, local):
    rows = minhash.near_duplicates(docs).collect()
    number = {}
    for r in rows:
        number.setdefault(r["doc_id"], r["class_id"])
    texts = {d: t for d, t in local}
    ids = sorted(d for d in texts if d is not None)
    label = {d: d for d in ids}
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = shingle_counts(texts[a]), shingle_counts(texts[b])
            low = sum((x & y).values())
            both = sum(x.values()) + sum(y.values()) - low
            if (low >= 0.8 * both if both else True):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {d: new if v == old else v for d, v in label.items()}
    assert {d: number[d] for d in ids} == label
    assert label[18] == 3 and label[16] == label[17] == 2
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({d for d in ids if label[d] == d} | {None})
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_dart_signatures_estimate_similarity():
    random = np.random.default_rng(4)
    value = random.integers(1, 2**50, 300).astype(np.uint64)
    weight = random.integers(1, 4, 300).astype(float)
    other = weight.copy()
    other[:60] += 1
    doc = np.repeat([0, 1], 300)
    s = minhash.dart_signatures(doc, np.tile(value, 2), np.concatenate([weight, other]), 3)
    true = weight.sum() / other.sum()
    assert abs((s[0] == s[1]).mean() - true) < 4 * math.sqrt(true * (1 - true) / minhash.K)
    assert (s[2] == 2**minhash.RANK_BITS - 1).all()


def test_large_group_of_near_copies(spark):
    base = prose(70, 150).split()
    texts = []
    for i in range(300):
        w = list(base)
        w[i % 150] = f"edit{i}"
        texts.append(" ".join(w))
    rows = minhash.near_duplicates(table(spark, texts)).collect()
    assert {r["class_id"] for r in rows} == {0}


def test_near_duplicates_in_buckets_of_many_classes(spark):
    """Forms filled in from common parts, and copies of those whose every band is shared by many others."""
    random = np.random.default_rng(3)
    parts = [[" ".join(f"p{i}v{v}w{j}" for j in range(8)) for v in range(2)] for i in range(40)]
    texts = [" ".join(parts[i][v] for i, v in enumerate(p)) for p in (random.random((600, 40)) < 0.05).astype(int)]
    doc, value, count = minhash.weighted(*minhash.shingles(*data_of(pa.array(texts)))[:2])
    keys = minhash.band_keys(minhash.dart_signatures(doc, value, count.astype(float), 600))
    size, many = Counter(keys.ravel().tolist()), Counter(texts)
    hidden = [i for i in np.argsort([-min(size[k] for k in row) for row in keys.tolist()]) if many[texts[i]] == 1][:2]
    rows = minhash.near_duplicates(table(spark, texts + [texts[i] + " end" for i in hidden]), threshold=0.97).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows} == dict(enumerate([texts.index(t) for t in texts] + hidden))


def test_possible_pairs_leave_out_none():
    random = np.random.default_rng(4)
    bins = random.integers(0, 3, (40, minhash.BINS)) + 300 * (random.random((40, minhash.BINS)) < 0.01)
    bins[20:] = np.maximum(0, bins[:20] + (random.random((20, minhash.BINS)) < 0.1))
    total, label = bins.sum(axis=1), np.arange(40) % 39
    kept = np.minimum(bins, 255)
    cut = (label, total, total, (bins - kept).sum(axis=1), kept.astype(np.uint8))
    i, j, some = minhash.possible(cut, None, 0.8, 1000)
    got = set(zip(i.tolist(), j.tolist()))
    for i in range(40):
        for j in range(i + 1, 40):
            low = np.minimum(bins[i], bins[j]).sum()
            if label[i] != label[j] and low >= 0.8 * (total[i] + total[j] - low):
                assert (i, j) in got
    assert 20 <= len(got) < 200 and not some
    i, j, some = minhash.possible(cut, None, 0.1, 2)
    assert max(Counter(i.tolist()).values()) == 2 and some


def components(texts, threshold=0.8):
    """Least id of each text's class by comparing all pairs."""
    sets = [shingle_counts(t) for t in texts]
    size = [sum(x.values()) for x in sets]
    label = list(range(len(texts)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if min(size[i], size[j]) >= threshold * max(size[i], size[j]):
                low = sum((sets[i] & sets[j]).values())
                if low >= threshold * (size[i] + size[j] - low):
                    a, b = top(i), top(j)
                    label[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(texts))]


def family(n, seed, rate):
    """n texts that each change some words of one."""
    random = np.random.default_rng(seed)
    base = prose(seed, 160).split()
    return [" ".join(f"x{random.integers(10**6)}" if random.random() < rate else w for w in base) for _ in range(n)]


@pytest.mark.parametrize(("block", "first"), [(1024, 4), (16, 1)])
def test_near_duplicates_at_the_threshold(spark, monkeypatch, block, first):
    """Families whose texts are linked to some of each other only, so that a leader tells little; small blocks and few proposals."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "FIRST", first)
    texts = family(70, 81, 0.02) + family(60, 82, 0.012) + family(40, 83, 0.03)
    rows = minhash.near_duplicates(table(spark, texts)).collect()
    want = components(texts)
    assert [c for _, c in sorted((r["doc_id"], r["class_id"]) for r in rows)] == want and 3 < len(set(want)) < 150


def test_pairs_grow_in_proportion(spark, monkeypatch):
    """A family of near copies and outsiders in its buckets: each text is compared a few times, whatever their number."""
    seen = []
    whole = minhash.similarities
    monkeypatch.setattr(minhash, "similarities", lambda pairs, *rest: seen.append(pairs.count()) or whole(pairs, *rest))
    many = []
    for n in (150, 1500):
        seen.clear()
        minhash.near_duplicates(table(spark, family(n, 84, 0.004) + family(n // 50, 84, 0.035))).count()
        many.append(sum(seen))
    assert many[0] < 5 * 153 and many[1] < 5 * 1530


def test_one_id_with_several_texts(spark):
    near = prose(91, 60).rsplit(" ", 1)[0] + " other"
    texts = [(1, prose(91, 60)), (1, prose(92, 60)), (2, prose(92, 60)), (3, prose(93, 60)), (4, near), (5, prose(93, 60)), (5, prose(94, 60)), (6, prose(94, 60))]
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in texts], SCHEMA).withColumns({"_number": F.lit(5), "_nth": F.lit(6)})
    rows = minhash.near_duplicates(df).collect()
    assert {(r["doc_id"], r["class_id"]) for r in rows} == {(1, 1), (2, 1), (3, 3), (4, 1), (5, 3), (6, 3)}
    kept = minhash.one_of_each(df)
    assert kept.columns == df.columns and sorted((r["doc_id"], r["_number"], r["_nth"]) for r in kept.collect()) == [(1, 5, 6), (3, 5, 6)]


# ---- language model


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [None]


def test_language_model(spark, docs, local):
    train = docs.filter("coalesce(doc_id, 0) % 3 <> 1")
    counts = Counter(t for r in train.collect() for t in tokens(r["text"]))
    n, v = sum(counts.values()), len(counts)
    for most, known in ((10, 10), (100, 10**6), (10**6, 10**6)):
        model = brown_lm.fit(train, most=most, known=known)
        assert model.table.words - 1 <= most
        rows = brown_lm.score_documents(docs, model).collect()
        got = Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows)
        assert got == Counter((d, len(t), sum(counts[x] > 0 for x in t), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t), 6)) for d, text in local for t in [tokens(text)])
    assert brown_lm.score_documents(empty(spark), model).count() == 0
    nothing = brown_lm.score_documents(docs, brown_lm.fit(empty(spark))).first()
    assert nothing["train_tokens"] == 0 and nothing["base_score"] == 0 and math.isfinite(nothing["score"])


def test_language_model_is_a_distribution(spark, docs):
    """After any class, the probabilities of all training words and one unknown word of each group sum to 1."""
    model = brown_lm.fit(docs)
    table_ = model.table
    words = np.asarray(model.counts.select("word").toArrow()["word"])
    n = np.asarray(model.counts.select("n").toArrow()["n"])
    item, _ = table_.look(words)
    group = item >= table_.words
    total = np.zeros(len(model.step))
    of, emit = model.of, model.emit
    logs = emit[item] + np.where(group, np.log10(n + 1), 0)
    for before in range(len(model.step)):
        total[before] = (10 ** (model.step[before, of[item]] + logs)).sum()
        unknown = np.arange(table_.words, table_.words + brown_lm.ENDINGS)
        total[before] += (10 ** (model.step[before, of[unknown]] + emit[unknown])).sum()
    assert np.allclose(total, 1, atol=1e-9)


def test_all_common_words_are_clustered_by_context(spark):
    """Two kinds of words that alternate; far more than are exchanged first, and the endings do not tell the kinds."""
    random = np.random.default_rng(6)
    texts = [" ".join(f"w{2 * x + k}" for pair in random.integers(0, 400, (100, 2)) for k, x in enumerate(pair)) for _ in range(240)]
    model = brown_lm.fit(table(spark, texts))
    counts = Counter(w for t in texts for w in t.split())
    assert model.table.words - 1 == sum(n >= brown_lm.LEAST for n in counts.values()) > 780
    batch = pa.RecordBatch.from_pydict({"text": [" ".join(f"w{i}" for i in range(800))]})
    item, _ = model.table.look(next(brown_lm.tokens(batch))[2][:-1])
    kinds = defaultdict(Counter)
    for i, c in enumerate(model.of[item]):
        kinds[c][i % 2] += 1
    assert sum(max(x.values()) for x in kinds.values()) > 0.95 * 800


def test_exchange_finds_two_kinds():
    c = np.zeros((9, 9), int)
    for i in range(1, 9):
        for j in range(1, 9):
            c[i, j] = 20 if (i % 2) == (j % 2) else 1
    of = brown_lm.exchange_clusters(c, 3)
    assert len({of[i] for i in (1, 3, 5, 7)}) == 1 and len({of[i] for i in (2, 4, 6, 8)}) == 1 and of[1] != of[2]


# ---- vectors


@pytest.fixture(scope="module")
def vectors(spark):
    random = np.random.default_rng(8)
    rows = [(i, (random.integers(-2, 3, 12) + 4 * np.eye(12)[i % 5]).tolist(), 1) for i in range(400)]
    rows += [(i, rows[7][1], 1) for i in range(400, 520)]  # one very common vector
    rows += [(600, None, 1), (700, [1.0, None] * 6, 1), (800, [float("nan")] * 12, 1), (900, [0.0] * 12, 1), (950, [1.0] * 5, 1), (None, [1.0] * 12, 1), (100, rows[100][1], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")


def usable(vectors, zero):
    out = []
    for r in vectors.collect():
        v = r["embedding"]
        if r["vec_id"] is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v)):
            out.append((r["vec_id"], np.array(v + [0.0] * (12 - len(v)))))
    return out


def test_exact_topk(spark, vectors):
    rows = usable(vectors, True)
    got = defaultdict(list)
    for r in exact_topk.exact_topk(vectors, F.col("vec_id") % 50 == 0, 10, pivots=9).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    queries = {i: v for i, v in rows if i % 50 == 0}
    assert set(got) == set(queries)
    for q, v in queries.items():
        assert got[q] == [(i, s) for s, i in sorted(((-float(v @ x), i) for i, x in rows if i != q))[:10] for s in [-s]]
    assert exact_topk.exact_topk(vectors.limit(0), F.col("vec_id") % 50 == 0, 10).count() == 0
    few = exact_topk.exact_topk(vectors.filter("vec_id in (0, 3, 5)"), F.col("vec_id") == 0, 10)
    assert few.count() == 2


def test_approximate_topk(spark, vectors):
    rows = usable(vectors, False)
    found = ann_tree.approximate_topk(vectors, F.col("vec_id") % 20 == 0, 5, sample=200, probes=40)
    got = defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = wanted = 0
    cos = lambda a, b: float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b))
    for q, v in {i: v for i, v in rows if i % 20 == 0}.items():
        best = sorted(((-cos(v, x), i) for i, x in rows if i != q))
        assert len(got[q]) == 5
        for i, s in got[q]:
            assert any(abs(s - cos(v, x)) < 1e-9 for j, x in rows if j == i)
        least = -best[4][0]
        hits += sum(s >= least - 1e-9 for _, s in got[q])
        wanted += 5
    assert hits / wanted >= 0.9
    assert ann_tree.approximate_topk(vectors.limit(0), F.col("vec_id") == 0).count() == 0
    assert ann_tree.approximate_topk(vectors.filter("vec_id in (0, 3)"), F.col("vec_id") == 0).count() == 1


def test_rows_are_copied_to_the_lots_that_ask(spark, monkeypatch):
    """Far clusters: a block goes to the lots of its own cluster, not to all."""
    random = np.random.default_rng(12)
    rows = [(i, (random.normal(size=8) + 60 * np.eye(8)[i % 8]).tolist()) for i in range(1600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    copies = []
    for module, search in ((exact_topk, exact_topk.exact_topk), (ann_tree, ann_tree.approximate_topk)):
        whole = module.search_blocks

        def counted(queries, data, *how, **more):
            asked = queries.select(F.explode("blocks").alias("block"), "lot").distinct()
            assert queries.groupBy("lot").count().agg(F.max("count")).first()[0] <= 4 * 8
            copies.append((queries.select("lot").distinct().count(), data.join(asked, "block").count()))
            return whole(queries, data, *how, **more)

        monkeypatch.setattr(module, "search_blocks", counted)
        found = search(df, F.col("vec_id") % 5 == 0, 3, lot=8)
        assert found.count() == 320 * 3
    for lots, rows_copied in copies:
        assert lots > 20 and rows_copied < lots * 1600 / 3


def test_own_rows_do_not_raise_the_bound(spark):
    """A query far from all else with 12 rows of its own id."""
    random = np.random.default_rng(13)
    rows = [(i, random.normal(size=4).tolist()) for i in range(1, 300)] + [(1000, [50.0, 0.0, 0.0, 0.0])] * 12
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = exact_topk.exact_topk(df, F.col("vec_id") == 1000, 10, pivots=200).orderBy("rank").collect()
    want = sorted(rows[:299], key=lambda r: (-50 * r[1][0], r[0]))[:10]
    assert [r["vec_id"] for r in got] == [r[0] for r in want]
    assert ann_tree.approximate_topk(df, F.col("vec_id") == 1000, 5).count() == 5


# ---- classifiers


def labelled(spark, bad, label, n=400):
    random = np.random.default_rng(11)
    rows, marks = [], []
    for i in range(n):
        y = int(random.random() < 0.3)
        words = prose(1000 + i, 60).split()
        if y:
            words = bad(words, random)
        rows.append((i, " ".join(words), "en", "s", 0))
        marks.append((i, y if label == "toxic" else 1 - y))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, f"doc_id long, {label} int"), dict(marks)


def accuracy(scored, truth, held):
    rows = [r for r in scored.collect() if held(zlib.crc32(str(r["doc_id"]).encode()))]
    return sum(r["predicted"] == truth[r["doc_id"]] for r in rows) / len(rows)


def test_toxicity(spark):
    def insult(words, random):
        for k in random.integers(0, len(words), 3):
            words[k] = ["idiot", "zorkelnik", "zorkelmux"][random.integers(0, 3)]
        return words

    docs, labels, truth = labelled(spark, insult, "toxic")
    model = toxicity.fit(docs, labels)
    scored = toxicity.score_documents(docs, model)
    assert accuracy(scored, truth, lambda c: c % 3 == 1) >= 0.97
    odd = toxicity.score_documents(table(spark, [None, "", "idiot " * 5, "x " * 50_000]), model).collect()
    assert all(0 <= r["score"] <= 1 for r in odd) and odd[2]["score"] > odd[0]["score"]
    assert toxicity.score_documents(empty(spark), model).count() == 0
    bare = toxicity.fit(docs, labels.limit(0))
    a, b = toxicity.score_documents(table(spark, ["idiot idiot", "fine words"]), bare).collect()
    assert a["score"] > b["score"]
    stay = toxicity.without_toxic(docs, model)
    assert stay.columns == docs.columns and 0 < stay.count() < docs.count()


def test_the_classifier_is_fitted_without_a_matrix_of_all_rows():
    """Rows of a sparse matrix are made dense a few at once; the weights are those of the dense matrix."""
    random, columns = np.random.default_rng(3), 800
    many = random.integers(0, 60, 20_000)
    column = np.concatenate([random.choice(columns, n, replace=False) for n in many])
    x = SparseRows(many, column.astype(np.int32), np.ones(len(column), np.float32), np.hstack([random.random((len(many), 3)), np.ones((len(many), 1))]).astype(np.float32), columns)
    y = (random.random(len(many)) < 0.3).astype(float)
    tracemalloc.start()
    try:
        logistic(x, y, steps=1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 4 * len(many) * columns / 2
    small = SparseRows(x.ends[1:3001] - x.ends[:3000], x.column, x.value, x.rest[:3000], columns)
    dense = np.zeros((3000, columns + 4), np.float32)
    for i in range(3000):
        dense[i, column[x.ends[i] : x.ends[i + 1]]] = 1
    dense[:, columns:] = x.rest[:3000]
    assert (small[:] == dense).all() and (small[1000:2100] == dense[1000:2100]).all()
    assert np.allclose(logistic(small, y[:3000]), logistic(dense, y[:3000]), atol=1e-4)
    assert np.allclose(product(small, np.arange(columns + 4.0)), dense @ np.arange(columns + 4.0), rtol=1e-4)


def test_label_model_discounts_copies_of_one_voter():
    random = np.random.default_rng(0)
    y = random.random(4000) < 0.3
    vote = lambda right: np.where(random.random(4000) < right, np.where(y, 1, -1), np.where(y, -1, 1))
    weak = vote(0.65)
    good = [vote(0.85), vote(0.8), vote(0.8)]
    votes = np.stack([weak] * 6 + good, axis=1).astype(np.int8)
    q, accuracy_, correlation = toxicity.label_model(votes, 0.3)
    assert ((q > 0.5) == y).mean() > 0.84
    assert correlation[0, 1] > 0.5 and abs(correlation[0, 7]) < 0.3
    assert accuracy_[6] > accuracy_[0]


def test_quality(spark):
    def junk(words, random):
        return [w + random.choice(["%%%", "&&&", "###"]) for w in words]

    docs, labels, truth = labelled(spark, junk, "quality")
    model = quality.fit(docs, labels)
    assert accuracy(quality.score_documents(docs, model), truth, lambda c: c % 5 == 0) >= 0.97
    odd = quality.score_documents(table(spark, [None, "", "x" * 200_000]), model).collect()
    assert all(0 <= r["score"] <= 1 for r in odd) and odd[0]["score"] == odd[1]["score"]
    assert quality.score_documents(empty(spark), model).count() == 0
    assert quality.score_documents(docs, quality.fit(docs, labels.limit(0))).first()["score"] == 0.5


def test_quality_scores_are_the_compressed_sizes(spark):
    """Each score by hand from the two dictionaries and the curve."""
    import zstandard

    def junk(words, random):
        return [w + "%%%" for w in words]

    docs, labels, _ = labelled(spark, junk, "quality")
    model = quality.fit(docs, labels)
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    for r in quality.score_documents(docs, model).limit(50).collect():
        t = texts[r["doc_id"]]
        size = [len(zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False).compress(t)) for d in (model.bad, model.good)]
        x = [10 * (size[0] - size[1]) / (len(t) + 20), 10 * (size[0] - size[1]) / (len(t) + 300), min(size) / (len(t) + 20), math.log1p(len(t)) / 10, 1.0]
        assert abs(r["score"] - 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights))))) < 1e-9


def test_posterior_by_hand():
    """Three voters that err apart: the posterior is Bayes' rule with the rates that it implies itself."""
    random = np.random.default_rng(5)
    y = random.random(3000) < 0.4
    votes = np.stack([np.where(random.random(3000) < p, np.where(y, 1, -1), np.where(y, -1, 1)) for p in (0.9, 0.8, 0.7)], axis=1).astype(np.int8)
    q, accuracy_, correlation = toxicity.label_model(votes, 0.4, rounds=400)
    weight = np.where(correlation > 0.1, correlation, 0).sum(axis=1)
    odds = np.full(len(y), math.log(0.4 / 0.6))
    for k in range(3):
        for v in (-1, 1):
            own = votes[:, k] == v
            rate = [(w[own].sum() + 0.1) / (w.sum() + 0.3) for w in (1 - q, q)]
            odds[own] += (math.log(rate[1]) - math.log(rate[0])) / weight[k]
    assert np.abs(1 / (1 + np.exp(-odds)) - q).max() < 0.01
    assert abs(accuracy_[0] - 0.9) < 0.05 and ((q > 0.5) == y).mean() > 0.88


def test_no_text_is_read_beyond_its_rows(spark, docs, local):
    """Every query gives one row per document."""
    model = toxicity.fit(docs, spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int"))
    assert toxicity.score_documents(docs, model).count() == len(local)


# ---- hashes and hot keys


def twins() -> tuple[str, str]:
    """Two words of 1024 letters (the Thue-Morse word and its complement) with one value under every polynomial modulo 2^64."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_of_one_polynomial_value_are_two_classes(spark):
    a, b = twins()
    data, places = data_of(pa.array([a, b]))
    start, end, _ = words_of(data, places)
    assert len(set(Prefix(data).hash(start, end).tolist())) == 1  # the pair is one
    assert len(set(word_hashes(data, start, end).tolist())) == 2 == len(set(hashes(data, start, end).tolist()))
    rows = table(spark, [a, b, f"{a} one two three four five", f"{b} one two three four five", a])
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(rows).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0}
    assert sorted(r["doc_id"] for r in minhash.one_of_each(rows).collect()) == [0, 1, 2, 3]
    texts = [a + prose(70, 30), b + prose(71, 30)]
    local = list(enumerate(texts))
    want = brute_dedup(local, 100)
    for r in suffix_dedup.suffix_dedup(table(spark, texts), 100, form="digest").collect():
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == want[r["doc_id"], texts[r["doc_id"]]][:3]


def test_word_hashes_tell_words_apart():
    random = np.random.default_rng(12)
    words = {bytes(random.integers(97, 99, n).astype(np.uint8)).decode() for n in [*range(1, 90)] * 40}
    data, places = data_of(pa.array([" ".join(sorted(words))]))
    start, end, _ = words_of(data, places)
    own = word_hashes(data, start, end)
    assert len(own) == len(words) == len(set(own.tolist()))
    data, places = data_of(pa.array(["\n".join(["pad", *sorted(words)])]))  # at other places, with other neighbours
    start, end, _ = words_of(data, places)
    assert (word_hashes(data, start, end)[1:] == own).all()


def test_contents_are_those_of_the_words():
    texts = ["a b", "a  b\n", "ab", "a", "", None, "b a", "a b c", " a b"]
    found = [tuple(x) for x in minhash.contents(*data_of(pa.array(texts))).tolist()]
    same = {}
    for t, c in zip(texts, found):
        same.setdefault(tuple((t or "").split()), set()).add(c)
    assert all(len(x) == 1 for x in same.values()) and len({c for x in same.values() for c in x}) == len(same)


@pytest.mark.parametrize("alike", [True, False])
def test_rows_without_an_id_are_many_buckets_of_the_mix(spark, monkeypatch, alike):
    """A third of the rows without an id, of one text or of many: no window holds more than a small part of them."""
    seen = []
    whole = mixing.running_total
    monkeypatch.setattr(mixing, "running_total", lambda df, v, bucket, order, groups=(): seen.append(df.groupBy(*groups, bucket).count().agg(F.max("count")).first()[0]) or whole(df, v, bucket, order, groups))
    text = F.lit("one two three") if alike else F.concat(F.lit("word "), F.col("id").cast("string"))
    rows = spark.range(0, 6000, 1, 20).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("one two")).otherwise(text).alias("text"), F.lit("s").alias("source"))
    got = mixing.mixed_documents(rows, block=64)
    taken = got.agg(F.sum("taken").alias("t"), F.count("*").alias("n"), F.max(F.col("taken") - 2 * F.col("size")).alias("over"), F.max("target").alias("target")).first()
    assert taken["n"] == 6000 and taken["over"] <= 0 and taken["t"] == math.floor(taken["target"] + 0.5)
    assert seen[0] < 400
    if alike:
        kinds = mixing.sized_documents(rows).withColumn("run", F.shiftright("row", 33)).groupBy("digest", "run").count()
        assert kinds.agg(F.max("count")).first()[0] <= 6000 / 20  # one row to number for each run, and a run's rows in a window


# ---- the language model by hand


def test_scores_are_those_of_the_counts_and_classes(spark, docs, local):
    """The classes are the model's; all counts and probabilities are made again from the words."""
    model = brown_lm.fit(docs, most=40)
    words = sorted({t for _, text in local for t in tokens(text)[:-1]})
    batch = pa.RecordBatch.from_pydict({"text": [" ".join(words)]})
    item, _ = model.table.look(next(brown_lm.tokens(batch))[2][:-1])
    item = dict(zip(words, item.tolist())) | {None: 0}
    count, moves, seen = Counter(), Counter(), Counter()
    for _, text in local:
        before = None
        for t in tokens(text):
            count[t] += 1
            seen[item[t]] += 1
            moves[int(model.of[item[before]]), int(model.of[item[t]])] += 1
            before = t
    classes = range(len(model.step))
    into, out = Counter(), Counter()
    for (g, h), n in moves.items():
        into[h] += n
        out[g] += n
    often = {h: into[h] + 1 for h in classes}
    step = {(g, h): math.log10((moves[g, h] + brown_lm.BACK * often[h] / sum(often.values())) / (out[g] + brown_lm.BACK)) for g in classes for h in classes}
    groups = range(model.table.words, model.table.words + brown_lm.ENDINGS)
    mass = Counter()
    for i in [*range(model.table.words), *groups]:
        mass[int(model.of[i])] += seen[i] + 0.5
    kinds = Counter(item[w] for w in words)

    def score(text):
        total, before = 0.0, None
        for t in tokens(text):
            i = item[t]
            total += step[int(model.of[item[before]]), int(model.of[i])] + math.log10((seen[i] + 0.5) / mass[int(model.of[i])])
            if i >= model.table.words:
                total += math.log10((count[t] + 1) / (seen[i] + kinds[i] + 1))
            before = t
        return total

    got = Counter((r["doc_id"], round(r["score"], 6)) for r in brown_lm.score_documents(docs, model).collect())
    assert got == Counter((d, round(score(text), 6)) for d, text in local)
    f = lambda x: sum(n * math.log(n) for n in x.values())
    assert model.likelihoods[-1] == pytest.approx(f(moves) - f(into) - f(out)) or model.likelihoods[-1] <= model.likelihoods[-2]
    assert all(a < b for a, b in zip(model.likelihoods[:-1], model.likelihoods[1:-1]))


@pytest.mark.parametrize("held", [0, 12])
def test_clustered_words_beyond_the_broadcast_table(spark, docs, local, held):
    """Every word of LEAST occurrences has a class of its own, in the table or by joins; all scores are made again from the words."""
    model = brown_lm.fit(docs, known=held, held=held, classes=9)
    words = sorted({t for _, text in local for t in tokens(text)[:-1]})
    batch = pa.RecordBatch.from_pydict({"text": [" ".join(words)]})
    names = next(brown_lm.tokens(batch))[2][:-1]
    item, _ = model.table.look(names)
    common = {r["word"]: r["class"] for r in model.common.collect()}
    class_of = {None: 0} | {w: common.get(x, int(model.of[i])) for w, x, i in zip(words, names.tolist(), item.tolist())}
    group = {w: int(x) & (brown_lm.ENDINGS - 1) for w, x, i in zip(words, names.tolist(), item.tolist()) if x not in common and i >= model.table.words}
    count, moves = Counter(), Counter()
    for _, text in local:
        for before, t in zip([None, *tokens(text)], tokens(text)):
            count[t] += 1
            moves[class_of[before], class_of[t]] += 1
    often_enough = sum(n >= brown_lm.LEAST for t, n in count.items() if t is not None)
    assert model.table.words - 1 <= held and model.table.words - 1 + len(common) == often_enough > 50
    assert {w for w in words if w not in group} == {w for w in words if count[w] >= brown_lm.LEAST}
    into, out = Counter(), Counter()
    for (g, h), n in moves.items():
        into[h] += n
        out[g] += n
    size = len(model.step)
    total = sum(into[h] + 1 for h in range(size))
    mass, inside, kinds = Counter(), Counter(), Counter(group.values())
    for w, g in group.items():
        inside[g] += count[w]
    for w in class_of:
        if w not in group:
            mass[class_of[w]] += count[w] + 0.5
    for g in range(brown_lm.ENDINGS):
        mass[int(model.of[model.table.words + g])] += inside[g] + 0.5

    def score(text):
        found = 0.0
        for before, t in zip([None, *tokens(text)], tokens(text)):
            g, h = class_of[before], class_of[t]
            found += math.log10((moves[g, h] + brown_lm.BACK * (into[h] + 1) / total) / (out[g] + brown_lm.BACK))
            if t in group:
                found += math.log10((inside[group[t]] + 0.5) / mass[h]) + math.log10((count[t] + 1) / (inside[group[t]] + kinds[group[t]] + 1))
            else:
                found += math.log10((count[t] + 0.5) / mass[h])
        return found

    rows = brown_lm.score_documents(docs, model).collect()
    assert Counter((r["doc_id"], round(r["score"], 6), r["n_tokens"], r["n_known"]) for r in rows) == Counter((d, round(score(x), 6), len(tokens(x)), len(tokens(x))) for d, x in local)
    f = lambda x: sum(n * math.log(n) for n in x.values())
    now = f(moves) - f(into) - f(out)
    assert now > model.likelihoods[0] and (now == pytest.approx(model.likelihoods[-1]) or now == pytest.approx(model.likelihoods[-2]))


def test_clustered_words_beyond_the_broadcast_table_by_context(spark):
    """Two kinds of words that alternate, nearly all outside the table; the endings do not tell the kinds."""
    random = np.random.default_rng(6)
    texts = [" ".join(f"w{2 * x + k}" for pair in random.integers(0, 400, (100, 2)) for k, x in enumerate(pair)) for _ in range(240)]
    model = brown_lm.fit(table(spark, texts), held=100, known=100)
    batch = pa.RecordBatch.from_pydict({"text": [" ".join(f"w{i}" for i in range(800))]})
    names = next(brown_lm.tokens(batch))[2][:-1].tolist()
    classes = {r["word"]: r["class"] for r in model.common.collect()}
    assert model.table.words <= 101 and len(classes) > 680
    kinds = defaultdict(Counter)
    for i, w in enumerate(names):
        if w in classes:
            kinds[classes[w]][i % 2] += 1
    assert sum(max(x.values()) for x in kinds.values()) > 0.95 * len(classes)
    assert model.likelihoods == sorted(model.likelihoods) or model.likelihoods[:-1] == sorted(model.likelihoods[:-1])


def test_packed_columns_come_back():
    random = np.random.default_rng(2)
    word = np.sort(random.integers(0, 2**32, 5000))
    for columns in ([word], [word, random.integers(0, 200, 5000), random.zipf(2, 5000) % 2**32], [np.array([0, 7, 2**32 - 1]), np.array([2**31, 0, 1])], [word[:0]] * 2):
        assert (brown_lm._unpack(brown_lm._pack(*columns), len(columns)) == np.stack(columns)).all()


def test_a_round_takes_every_word_out_and_puts_it_back_exactly(spark):
    """With one task a round of exchange is the one-by-one exchange of the words in order of their counts."""
    texts = [prose(200 + i, 150) for i in range(30)]
    model = brown_lm.fit(table(spark, texts), classes=6, rounds=0)
    items = brown_lm.items_of(table(spark, texts), model.table)
    size = model.table.words + brown_lm.ENDINGS
    c = brown_lm.bigrams_of(items, np.arange(size)).astype(float)
    of = model.of.copy()
    of[1 : model.table.words] = 1 + np.arange(model.table.words - 1) % 5  # not where the first exchange left them
    hot = np.eye(6)[of]
    start = hot.T @ c @ hot
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = brown_lm.exchanged(items, model.table.words, of, start.astype(np.int64))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    m, want = start.copy(), of.copy()
    weight = (c.sum(axis=0) + c.sum(axis=1) + np.diag(c))[: model.table.words]
    for w in [w for w in np.argsort(-weight, kind="stable") if w and weight[w]]:
        want[w] = brown_lm.exchange(m, c[w] @ hot, c[:, w] @ hot, c[w, w], want[w])  # neighbours' classes as the round began
    assert (got == want).all() and (got != of).any()
    new = np.eye(6)[got]
    assert brown_lm.likelihood(new.T @ c @ new) > brown_lm.likelihood(start)


# ---- the toxicity score by hand


def test_toxicity_scores_are_those_of_the_features_and_weights(spark):
    """The weights are the model's; every feature of a text is counted again, one by one, in another way."""
    def insult(words, random):
        for k in random.integers(0, len(words), 3):
            words[k] = ["idiot", "zorkelnik", "zorkelmux!!!", "d@@mn"][random.integers(0, 4)]
        return words

    df, labels, _ = labelled(spark, insult, "toxic")
    odd = table(spark, [None, "", "ZORKELNIK!!! you are an IDIOT", "idiot " * 30, "sh*t s**t SHOUT!! zorkelzzz", "Straße 12 éé zorkel_nik", prose(5, 3000)], 9000)
    model = toxicity.fit(df, labels)
    names, w = list(model.index), model.weights
    rows = df.unionByName(odd).collect()

    def score(text):
        words = re.findall(r"[^\W\d_]+", text.lower())
        counts = {f: sum(x == f if not f.endswith("*") else x.startswith(f[:-1]) and len(x) > len(f) - 1 for x in words) for f in names}
        counts = {f: n if f.endswith("*") or len(f) <= 16 else 0 for f, n in counts.items()}
        hits = sum(any(x == f if not f.endswith("*") else x.startswith(f[:-1]) and len(x) > len(f) - 1 for f in names) for x in words)
        insults = sum(x in toxicity.INSULTS for x in words)
        total = w[-1]
        for i, f in enumerate(names):
            if counts[f]:
                total += w[i] + w[len(names) + i] * min(3.0, 100 * counts[f] / max(len(words), 50))
        patterns = [float(insults > 0 and toxicity.PATTERNS[0].search(text) is not None), *(min(2, len(p.findall(text))) for p in toxicity.PATTERNS[1:])]
        more = [min(hits, 8), min(100 * hits / max(len(words), 20), 8), min(insults, 4), *patterns, math.log(1 + len(words)) / 5]
        total += sum(a * b for a, b in zip(w[2 * len(names) : -1], more, strict=True))
        return 1 / (1 + math.exp(-(model.scale[0] * total + model.scale[1])))

    assert len(names) > 3
    got = {r["doc_id"]: r for r in toxicity.score_documents(df.unionByName(odd), model).collect()}
    for r in rows:
        want = score(r["text"] or "")
        assert abs(got[r["doc_id"]]["score"] - want) < 1e-9 and got[r["doc_id"]]["predicted"] == (want >= 0.7)
