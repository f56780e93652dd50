"""Each stage of the pipeline against brute force on its own input."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pulseloom.functions.shared import keep
from tests.llm.test_operators import prose, shingle_counts, waterfill

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Documents with toxic ones, exact and near copies, shared passages, nulls, an empty and a long one; all stages' results."""
    random = np.random.default_rng(21)
    shared = prose(900, 50)
    rows, labels = [], []
    for i in range(150):
        words = prose(2000 + i, 60 + i % 50).split()
        toxic = i % 4 == 0
        if toxic:
            for k in random.integers(0, len(words), 6):
                words[k] = ["idiot", "moron", "zorkelnik"][random.integers(0, 3)]
        text = " ".join(words)
        if not toxic and i % 10 == 3:
            text = f"{text} {shared} {prose(3000 + i, 5)}"
        rows.append((i, text, "en", f"s{i % 3}" if i % 7 else None, len(text)))
        labels.append((i, 1, int(toxic)))
    clean = [r for r in rows if r[0] % 4]
    near = clean[5][1].split()
    near[30] = "edited"
    for i, text in enumerate([clean[2][1], clean[2][1], " ".join(near), None, "", "é" * 300, prose(5000, 3000)], 200):
        rows.append((i, text, "en", "s1", len(text or "")))
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(keep(stage(spark, out[-1], folder)))
    whole = corpus_pipeline.run(spark, folder)
    assert whole.columns == out[-1].columns and whole.count() == out[-1].count()
    return [(x.columns, [tuple(r) for r in x.collect()]) for x in out]


def test_columns(stages):
    assert [c for c, _ in stages[:-1]] == [COLUMNS] * 5
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "suffix_dedup", "mix", "pack"]


def test_toxic_documents_go_and_clean_ones_stay(stages):
    before, after = ({r[0]: r for r in rows} for _, rows in stages[:2])
    toxic = {i for i in range(150) if i % 4 == 0}
    assert not toxic & set(after) and set(after) == set(before) - toxic
    assert all(after[i] == before[i] for i in after)


def test_one_of_each_class_stays(stages):
    before, after = stages[1][1], stages[2][1]
    label = {r[0]: r[0] for r in before}
    text = {r[0]: r[1] for r in before}
    for a in label:
        for b in label:
            x, y = shingle_counts(text[a]), shingle_counts(text[b])
            low = sum((x & y).values())
            both = sum(x.values()) + sum(y.values()) - low
            if a > b and (low >= 0.8 * both if both else True):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    assert sorted(r[0] for r in after) == sorted({k for k, v in label.items() if k == v})
    assert {200, 201, 202, 204} & {r[0] for r in after} == set()


def test_repeated_passages_go(stages):
    seen = set()
    want = {}
    for d, text, *_ in sorted(stages[2][1], key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(raw[i : i + 100])
        want[d] = bytes(c for c, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
    got = {r[0]: r for r in stages[3][1]}
    assert {d: r[1] for d, r in got.items()} == want
    assert all(r[4] == len(r[1]) for r in got.values()) and any(len(want[r[0]]) < len(r[1] or "") for r in stages[2][1])


def test_mix_takes_the_targets(stages):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    text = {r[0]: r[1] for r in stages[3][1]}
    sizes, taken = Counter(), Counter()
    for r in stages[3][1]:
        sizes[r[3]] += words(r[1])
    reads = defaultdict(list)
    for r in stages[4][1]:
        taken[r[3]] += words(r[1])
        reads[r[0]].append(r[1])
        assert text[r[0]].startswith(r[1]) and r[4] == len(r[1])
    assert all(len(x) <= 2 for x in reads.values())
    assert taken == Counter({s: int(t + 0.5) for s, t in waterfill(sizes).items()})


def test_pieces_are_the_documents_tokens(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for d, text, *_ in stages[4][1]:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    rows = stages[5][1]
    assert Counter(r[:5] for r in rows) == want
    room = Counter()
    for r in rows:
        room[r[5]] += r[3]
    assert max(room.values()) <= 1024 and len(room) <= 1.1 * sum(room.values()) / 1024 + 1


def write(spark, folder, rows, labels, extra=()):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumns({c: F.lit(i) for i, c in enumerate(extra)}).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_empty_tables_pass_through(spark, tmp_path):
    docs = write(spark, str(tmp_path), [], [])
    for name, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, str(tmp_path)))
        assert docs.count() == 0 and (name == "pack" or docs.columns == COLUMNS)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_null_and_repeated_ids_in_every_stage(spark, tmp_path):
    """A third of the rows without an id, ids with several texts, rows that repeat, columns with the operators' own names."""
    extra = ("row", "rest", "digest", "size", "doc", "word", "score", "bucket", "spans", "_text", "sno", "start", "rank", "_run")
    rows = [(None if i % 3 == 0 else i // 2, prose(7000 + i, 40), "en", f"s{i % 2}" if i % 5 else None, 1) for i in range(60)]
    rows += [rows[4], rows[4], rows[0], (None, rows[1][1], "en", None, None), (7, None, None, None, None), (None, None, None, None, None)]
    docs = write(spark, str(tmp_path), rows, [(i, 1, 0) for i in range(20)], extra)
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = keep(stage(spark, docs, str(tmp_path)))
        counts.append(out.count())
        if name == "pack":
            assert out.columns[:5] == ["doc_id", "piece", "start", "length", "ids_crc32"]
            break
        assert sorted(out.columns) == sorted([*COLUMNS, *extra])
        assert all(out.filter(F.col(c) != i).isEmpty() for i, c in enumerate(extra))
        docs = out
    # nothing is toxic; of the 66 rows the near copies of a text and of an id go; no passage repeats; the mix leaves out what has no words
    assert counts[0] == counts[1] == 66 and counts[2] == counts[3]
    kept = {r["text"] for r in docs.collect()}
    assert len(kept) > 20 and None not in kept
    assert counts[5] >= counts[4]


def test_words_of_one_polynomial_value_both_stay(spark):
    a, b = ("".join("ab"[(bin(i).count("1") + k) % 2] for i in range(1024)) for k in (0, 1))
    docs = spark.createDataFrame([(1, a), (2, b), (3, b)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [1, 2]
