"""Codes, labels, folds, tables and joins on hand-made rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.functions import scalars as s
from pulseloom.operators import folds, joins, labels
from pulseloom.operators.results import age_group_counts, age_profile, best_epoch
from pulseloom.sources import arrays, tables


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_code_lists(spark):
    text = ["007, x1,,12", None, "", "99999999999999999999999, -0, +5", "Null"]
    df = spark.createDataFrame([(t,) for t in text], "t string")
    paper = [r[0] for r in df.select(s.parse_code_list(F.col("t"), "paper")).collect()]
    assert paper == [["7", "12"], [], [], ["99999999999999999999999", "0", "5"], []]
    bench = [r[0] for r in df.select(s.parse_code_list(F.col("t"), "bench")).collect()]
    assert bench[0] == ["007", "x1", "12"] and bench[1] == []
    zzu = spark.createDataFrame([(" 'A1'; ;B ",), ("Null",), (None,)], "t string").select(s.parse_code_list(F.col("t"), "zzu"))
    assert [r[0] for r in zzu.collect()] == [["A1", "B"], [], []]


def test_code_map_takes_the_last_of_a_repeated_key(spark):
    df = spark.createDataFrame([("{'NORM': 100.0, 'SR': nan, 'NORM': 50.0}",), ("{}",), (None,)], "t string")
    got = [r[0] for r in df.select(s.parse_code_map(F.col("t"))).collect()]
    assert got[0]["NORM"] == 50.0 and got[0]["SR"] != got[0]["SR"] and got[1] == {} and got[2] == {}


def test_label_names(spark):
    df = spark.createDataFrame([("2:1 AV-block (a/b), 'x'",)], "t string")
    got = df.select(*[s.sanitize_label(F.col("t"), r) for r in ("bench", "paper", "zzu")]).first()
    assert tuple(got) == ("2:1_AV_block_a/b_x", "2:1_AV_block_a_b_x", "2_1_AV_block_a_b_x")


def test_age_bins(spark):
    df = spark.createDataFrame([(-0.1,), (0.0,), (0.2,), (0.799,), (0.8,), (1.5,), (None,)], "age double")
    binned = s.age_bins(df, "age")
    assert [r["age_bin"] for r in binned.collect()] == ["<20", "<20", "20-40", "60-80", "80+", "80+", None]
    assert dict(rows(age_group_counts(binned, ["<20", "none"]))) == {"<20": 2, "none": 0}


def test_map_codes_keeps_order_and_repeats(spark):
    df = spark.createDataFrame([(1, ["b", "a", "x", "b"]), (2, []), (3, None)], "record_id long, codes array<string>")
    mapping = spark.createDataFrame([("a", "A", 1), (" b", "B1", 1), ("b", "B2", 2), (None, "N", 3)], "code string, name string, pos int")
    for dup, b in (("first", "B1"), ("last", "B2")):
        got = {r["record_id"]: r["names"] for r in labels.map_codes(df, mapping, dup).collect()}
        assert got == {1: [b, "A", b], 2: [], 3: []}


def test_vocab_orders(spark):
    """The golden counts of 74 records: 49, 23, 16, 15, 11, 11, 10; ties by first seen."""
    counts = {"pvc": 49, "couplet": 23, "cad": 16, "vt": 15, "tachy": 11, "brady": 11, "lvh": 10, "rare": 9}
    data = [(i, [k for k, n in counts.items() if i < n]) for i in range(74)]
    df = spark.createDataFrame(data, "record_id long, names array<string>")
    bench = labels.label_vocab(labels.first_seen(df), 10, "count").orderBy("label_idx").collect()
    assert [r["label"] for r in bench] == ["pvc", "couplet", "cad", "vt", "tachy", "brady", "lvh"]
    paper = labels.label_vocab(labels.label_counts(df), 10).orderBy("label_idx").collect()
    assert [r["label"] for r in paper] == sorted(set(counts) - {"rare"})
    out = labels.filter_encode_labels(df, labels.label_vocab(labels.label_counts(df), 10)).filter("record_id = 8").first()
    assert "rare" not in out["filtered"] and len(out["encoded"]) == 7


def test_counts_are_occurrences(spark):
    df = spark.createDataFrame([(1, ["a", "a"])], "record_id long, names array<string>")
    assert rows(labels.label_counts(df)) == [("a", 2)]


def test_superclass(spark):
    df = spark.createDataFrame([(1, True, False), (2, True, True), (3, False, False)], "record_id long, n boolean, mi boolean")
    got = labels.superclass_any(df, {"NORM": ["n"], "MI": ["mi", "absent"]}, "NORM")
    assert rows(got) == [(1, True, False), (2, False, True), (3, False, False)]


def test_label_clash_keeps_the_record_column(spark):
    a = spark.createDataFrame([("p", 1)], "filepath string, age int")
    b = spark.createDataFrame([("p", 7, True)], "filepath string, age int, mi boolean")
    assert joins.join_labels(a, b, "filepath").first().asDict() == {"filepath": "p", "age": 1, "age_label": 7, "mi": True}


def test_folds_are_even(spark):
    df = spark.createDataFrame([(i, i % 37, [i % 3] if i % 5 else []) for i in range(203)], "record_id long, pid long, encoded array<int>")
    got = folds.stratify_records(df, 10).groupBy("fold").count().collect()
    assert len(got) == 10 and max(r["count"] for r in got) - min(r["count"] for r in got) <= 1
    assert folds.stratify_patients(df, 5).count() == 37


def test_splits_and_unassigned(spark):
    df = spark.createDataFrame([(f,) for f in (-1, 0, 1, 2, 3)], "fold int")
    assert [r["split"] for r in folds.auto_split(df).orderBy("fold").collect()] == [None, "train", "train", "val", "test"]
    summary = folds.fold_summary(df).first()
    assert (summary["train_size"], summary["val_size"], summary["test_size"]) == (3, 1, 1)


def test_original_folds_shift_and_fallback(spark):
    records = spark.createDataFrame([(i, [0]) for i in range(4)], "record_id long, encoded array<int>")
    names = spark.createDataFrame([(i, f"n{i}") for i in range(4)], "record_id long, name string")
    given = spark.createDataFrame([(f"n{i}", i + 1) for i in range(4)], "name string, fold int")
    assert rows(folds.original_folds(records, names, given)) == [(i, i) for i in range(4)]
    assert {r[1] for r in rows(folds.original_folds(records, names, given.filter("fold < 4")))} == {-1, 1, 2, 3}
    assert {r[1] for r in rows(folds.original_folds(records, names, given.filter("fold = 1"), 2))} == {0, 1}


def test_balanced_sample(spark):
    df = spark.createDataFrame([(str(i), i % 3 == 0, i % 3 == 1) for i in range(30)], "filepath string, a boolean, b boolean")
    got = folds.balanced_sample(df, "a", "b", 4, 1)
    assert sorted(r["flag"] for r in got.collect()) == [0] * 4 + [1] * 4


def test_metric_lines(spark, tmp_path):
    m = spark.createDataFrame([("b", 0.5), ("a", None)], "metric string, value double")
    tables.write_metrics(m, str(tmp_path / "m"))
    back = {r["metric"]: r["value"] for r in tables.read_metrics(spark, str(tmp_path / "m")).collect()}
    assert back["b"] == 0.5 and back["a"] != back["a"]


def test_best_epoch(spark):
    df = spark.createDataFrame([("x", 1, 0.5), ("x", 2, 0.7), ("x", 3, 0.7), ("x", 4, float("nan")), ("y", 1, None)], "experiment string, epoch int, val_auroc_macro double")
    assert rows(best_epoch(df)) == [("x", 2, 0.7)]


def spread_of(df, dealt, key):
    """The largest difference of any label's counts between two folds, and the folds' sizes."""
    found = df.join(dealt, key)
    n = dealt.agg(F.max("fold")).first()[0] + 1
    tally = {}
    for r in found.select("fold", F.explode(F.array_distinct("encoded")).alias("l")).groupBy("fold", "l").count().collect():
        tally.setdefault(r["l"], [0] * n)[r["fold"]] = r["count"]
    sizes = [r["count"] for r in found.groupBy("fold").count().collect()]
    return max(max(x) - min(x) for x in tally.values()), sizes


def labelled(spark, n, per_patient=1):
    """Records with none to five of forty labels, some of them rare, that often go together."""
    pick = random.Random(3)
    rows = []
    for i in range(n):
        first = min(int(pick.expovariate(0.15)), 39)
        rows.append((i, i // per_patient, [(first + k * pick.randint(0, 3)) % 40 for k in range(pick.randint(0, 5))]))
    return spark.createDataFrame(rows, "record_id long, pid long, encoded array<int>").cache()


@pytest.mark.parametrize("block", [100_000, 700])
def test_every_label_is_spread_evenly(spark, block):
    """In one block and in several; sizes differ by one at most; the same folds on any partitioning."""
    df = labelled(spark, 4003)
    dealt = folds.stratify_records(df, 10, block=block)
    uneven, sizes = spread_of(df, dealt, "record_id")
    assert uneven <= 3 and len(sizes) == 10 and max(sizes) - min(sizes) <= 1 and sum(sizes) == 4003
    if block == 700:
        assert rows(folds.stratify_records(df.repartition(7), 10, block=block)) == rows(dealt)
        assert rows(folds.stratify_records(df, 10, seed=1, block=block)) != rows(dealt)


def test_patients_fill_folds_by_their_records(spark):
    df = labelled(spark, 3000).withColumn("pid", F.floor(F.sqrt(F.col("record_id"))))  # up to 109 records
    dealt = folds.stratify_patients(df, 5)
    assert dealt.count() == df.select("pid").distinct().count()
    uneven, sizes = spread_of(df, dealt, "pid")
    assert sum(sizes) == 3000 and max(sizes) - min(sizes) <= 109 and uneven <= 60


def test_units_of_one_kind_are_many_blocks(spark):
    """However many records look alike, a task deals out no more than a block of them."""
    df = spark.range(20_000).select(F.col("id").alias("pid"), F.array(F.lit(3)).alias("encoded"))
    sizes = [r["count"] for r in folds.stratify_patients(df, 10, block=1000).groupBy("fold").count().collect()]
    assert len(sizes) == 10 and max(sizes) - min(sizes) <= 1
    odd = spark.createDataFrame([(None, None), (None, []), (1, [None, 2]), (1, [2])], "record_id long, encoded array<int>")
    assert sorted(r["fold"] for r in folds.stratify_records(odd, 4).collect()) == [0, 1, 2, 3]
    assert folds.stratify_records(odd.limit(0), 4).count() == 0


@pytest.mark.parametrize("take", [1, 37, 400, 10_000])
def test_sample_is_a_filter(spark, take):
    """The rows of least md5, as a ranking gives them, and no top-n or window in the plan."""
    df = spark.range(3000).select(F.when(F.col("id") % 50 > 0, F.col("id") % 700).cast("string").alias("filepath"), (F.col("id") % 3 == 0).alias("a"), (F.col("id") % 3 == 1).alias("b"))
    got = folds.balanced_sample(df, "a", "b", take, 5)
    flagged = [(r["filepath"], 1 if r["a"] else 0) for r in df.filter("(a or b) and filepath is not null").collect()]
    both = {f: sorted((hashlib.md5(f"5:{k}".encode()).hexdigest(), k, f) for k, x in flagged if x == f) for f in (0, 1)}
    n = min(take, *map(len, both.values()))
    assert sorted(map(tuple, got.collect())) == sorted((k, f) for x in both.values() for _, k, f in x[:n])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Window" not in plan and "Sort" not in plan
    assert folds.balanced_sample(df.filter("a"), "a", "b", 5, 5).count() == 0


def test_quantiles_are_exact(spark, monkeypatch):
    """Against numpy, on skewed values with ties, and where the sketch misses; no exact percentile is aggregated."""
    from pulseloom.functions import quantiles

    monkeypatch.setattr(F, "percentile", None)
    pick = np.random.default_rng(2)
    for x in (pick.standard_normal(30_001) ** 9, np.round(pick.random(5000), 2), np.full(100, 3.5), np.array([1.0]), np.array([5.0, -7.0]), np.append(np.full(9000, 2.0), pick.random(1000))):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "age double")
        want = [float(np.quantile(x, p)) for p in (0.5, 0.25, 0.75, 0, 1, 0.999)]
        assert np.allclose(quantiles.exact_quantiles(df, "age", [0.5, 0.25, 0.75, 0, 1, 0.999]), want, rtol=1e-12)
    monkeypatch.setattr(F, "percentile_approx", lambda c, ends, n: F.array(*[F.lit(1e9) for _ in ends]))
    assert quantiles.exact_quantiles(df, "age", [0.25, 0.9]) == pytest.approx([float(np.quantile(x, p)) for p in (0.25, 0.9)])
    assert age_profile(df).first().asDict()["available"] == 10_000
    assert tuple(age_profile(df.limit(0)).first()) == (0, 0, None, None, None)


def test_a_repeated_job_leaves_its_results_once(spark, tmp_path):
    path = str(tmp_path / "results")
    one = spark.createDataFrame([("t1", "m", "a", "probe", "/x", 0.5), ("t1", "m", None, "probe", "/y", 0.6)], "timestamp string, model string, task string, eval_mode string, save_dir string, test_auroc_macro double")
    two = one.limit(1).withColumn("timestamp", F.lit("t2"))
    for job in (one, two, one, two):
        tables.append_results(job, path)
    back = tables.read_results(spark, path)
    assert back.schema == tables.RESULTS and back.count() == 3
    assert {(r["timestamp"], r["task"], r["best_epoch"]) for r in back.collect()} == {("t1", "a", -1), ("t1", None, -1), ("t2", "a", -1)}
    tables.append_results(one.withColumn("test_auroc_macro", F.lit(0.9)), path)
    assert sorted(r["test_auroc_macro"] for r in tables.read_results(spark, path).collect()) == [0.5, 0.9, 0.9]


@pytest.mark.parametrize(("layout", "shape"), [("samples", (50, 1, 7, 3)), ("samples", (50, 7, 3)), ("leads", (50, 3, 7)), ("leads", (50, 1, 3, 7))])
def test_arrays_are_read_by_ranges_of_rows(spark, tmp_path, layout, shape):
    x = np.random.default_rng(1).standard_normal(shape)
    np.save(tmp_path / "a.npy", x)
    np.save(tmp_path / "b.npy", x[:0])
    want = x.reshape(50, *shape[-2:]).astype(np.float32)
    want = want.transpose(0, 2, 1) if layout == "samples" else want
    spark.dataSource.register(arrays.WaveArrays)
    read = spark.read.format("waves").option("layout", layout).option("bytes", 1000).option("at_once", 400)
    got = read.load(str(tmp_path)).withColumn("part", F.spark_partition_id()).collect()
    assert len(got) == 50 and len({r["part"] for r in got}) > 5
    assert all(np.array_equal(np.array(r["signal"], np.float32), want[r["record_id"]]) and r["fs"] is None for r in got)
    some = tables.read_waveforms(spark, str(tmp_path / "a.npy"), layout, 250, (2, 0))
    assert all(np.array_equal(np.array(r["signal"], np.float32), want[r["record_id"]][[2, 0]]) and r["fs"] == 250 for r in some.collect())
    folder = arrays.write_arrays(some, str(tmp_path / "again"), layout)
    assert tables.read_waveforms(spark, folder, layout).count() == 50
    np.save(tmp_path / "c.npy", np.zeros((3, 2, 2, 2)))
    with pytest.raises(Exception, match="3 axes"):
        tables.read_waveforms(spark, str(tmp_path / "c.npy"), layout).count()


def test_small_scores_are_many_buckets_and_nan_is_undefined(spark, monkeypatch):
    from pulseloom.operators import metrics

    seen = []
    whole = metrics.running_total
    monkeypatch.setattr(metrics, "running_total", lambda df, *rest: seen.append(df.groupBy("_step").count().agg(F.max("count")).first()[0]) or whole(df, *rest))
    score = F.pow(F.lit(10.0), -2 - 4 * (F.col("id") / 20_000))
    df = spark.range(20_000).select(F.col("id").alias("ecg_id"), F.lit(0).alias("class_idx"), (F.col("id") % 50 == 0).cast("int").alias("target"), score.alias("score"))
    assert 0.4 < metrics.auroc_macro(df).first()[0] < 0.6 and seen[0] < 200
    odd = df.unionByName(spark.createDataFrame([(1, 1, 1, 0.5), (2, 1, 0, float("nan")), (3, 2, 1, 1.5), (4, 2, 0, -3.0)], "ecg_id long, class_idx int, target int, score double"))
    per = {r["class_idx"]: r["auroc"] for r in metrics.auroc_per_class(odd).collect()}
    assert per[1] is None and per[2] == 1.0 and metrics.auroc_macro(odd).first()[0] is None
    assert metrics.auroc_micro(odd).first()[0] is None and metrics.auprc_macro(odd).first()[0] is None and metrics.f1_macro(odd).first()[0] is not None


def test_folds_replace_a_column_of_their_name(spark):
    records = spark.createDataFrame([(1, 10, 7), (2, 11, 7)], "record_id int, pid int, fold int")
    found = joins.attach_folds(records, spark.createDataFrame([(10, 3)], "pid int, fold int"), "pid")
    assert {(r["record_id"], r["fold"]) for r in found.collect()} == {(1, 3), (2, -1)}


def test_header_codes_are_lists(spark, tmp_path):
    for name, text in (("a", "x 12\n#Age: 3\n#dx: 007, 12,none,, 5\n#Dx: 1\n"), ("b", "x\n"), ("c", "#Dx:\n")):
        (tmp_path / f"{name}.hea").write_text(text)
    found = {r["record_name"]: r["codes"] for r in tables.read_header_codes(spark, str(tmp_path)).collect()}
    assert found == {"a": ["7", "12", "5"], "b": [], "c": []}


def coded(spark):
    """Records that share a key, lack one, repeat as a whole, have no list, an empty one, null entries."""
    data = [(7, ["1"]), (7, ["2", "1"]), (None, ["2", "x", "2"]), (None, ["1"]), (8, ["1", None, "2"]), (8, ["1", None, "2"]), (9, None), (10, [])]
    return spark.createDataFrame(data, "record_id long, codes array<string>").withColumn("names", F.lit("own"))


@pytest.mark.parametrize("most", [labels.LOOKUP_ROWS, 1])
def test_lists_are_mapped_row_by_row(spark, most):
    """In the row and by the join for a large mapping: the same rows, whatever the keys."""
    mapping = spark.createDataFrame([("1", "a", 1), ("2", "b", 2), ("3", "c", 3)], "code string, name string, pos int")
    got = labels.map_codes(coded(spark), mapping, "first", most=most)
    assert got.columns == ["record_id", "codes", "names"]
    want = [(7, ["a"]), (7, ["b", "a"]), (None, ["b", "b"]), (None, ["a"]), (8, ["a", "b"]), (8, ["a", "b"]), (9, []), (10, [])]
    assert rows(got.select("record_id", "names")) == sorted(want, key=repr)
    flagged = spark.createDataFrame([("1", 1.0, "x"), ("1", 1.0, "w"), ("2", 0.0, None), ("3", None, "z")], "code string, form double, level string")
    kept = [(7, ["1"]), (7, ["1"]), (None, []), (None, ["1"]), (8, ["1"]), (8, ["1"]), (9, []), (10, [])]
    assert rows(labels.code_subsets(coded(spark), flagged, "form", most=most).select("record_id", "codes")) == sorted(kept, key=repr)
    assert rows(labels.class_rollup(coded(spark), flagged, "level", most=most).filter("record_id = 7").select("names")) == [(["w"],)] * 2
    vocab = spark.createDataFrame([("2", 0, 5), ("1", 1, 9)], "label string, label_idx int, n long")
    encoded = labels.filter_encode_labels(coded(spark), vocab, "codes", most=most)
    assert rows(encoded.filter("record_id = 8").select("filtered", "encoded")) == [(["1", "2"], [1, 0])] * 2
    assert labels.map_codes(coded(spark).limit(0), mapping, "last", most=most).count() == 0


def test_a_small_mapping_moves_no_rows(spark):
    """The plan has no exchange, explode or join."""
    mapping = spark.createDataFrame([("1", "a", 1)], "code string, name string, pos int")
    plan = labels.map_codes(coded(spark), mapping, "first")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Generate", "Join")) and "ArrowEvalPython" in plan
    plan = labels.map_codes(coded(spark), mapping.unionByName(mapping.withColumn("code", F.lit("2"))), "first", most=1)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Generate" in plan
