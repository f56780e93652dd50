"""Waveforms, metrics and features on hand-made rows."""

import math

import numpy as np
import pytest

from pulseloom.operators import features, metrics, signals
from pulseloom.operators.waves import Signals, fourier, linear


@pytest.mark.parametrize(("n", "m"), [(4096, 5120), (2000, 5000), (10000, 5000), (257, 500), (500, 257)])
def test_fourier_keeps_sines(n, m):
    wave = lambda k: np.sin(2 * math.pi * 5 * np.arange(k) / k + 0.3)
    assert np.allclose(fourier(wave(n)[None], m)[0], wave(m), atol=1e-9)


def test_linear_ends():
    assert np.allclose(linear(np.array([[0.0, 1.0]]), 4), [[0, 0.25, 0.75, 1]])


def waves(spark, *leads):
    return spark.createDataFrame([(1, 0, 10, [list(map(float, x)) for x in leads])], "record_id long, seg_idx int, fs int, signal array<array<double>>")


def test_lengths_and_windows(spark):
    df = waves(spark, range(7))
    assert signals.adjust_length(df, 9).first()["signal"] == [[0, 1, 2, 3, 4, 5, 6, 0, 0]]
    assert signals.adjust_length(df, 3).first()["signal"] == [[0, 1, 2]]
    cut = signals.fixed_windows(df, 7, 3).orderBy("chunk_idx").collect()
    assert [r["signal"] for r in cut] == [[[0, 1, 2]], [[3, 4, 5]]]
    assert signals.fixed_windows(df, 7, 7).count() == 1


def test_nan_and_padding_before_scaling(spark):
    df = waves(spark, [1, float("nan")])
    assert signals.fill_nan(df).first()["signal"] == [[1, 0]]
    out = signals.zscore(signals.adjust_length(signals.fill_nan(df), 3), [1.0], [2.0]).first()["signal"][0]
    assert np.allclose(out, [0, -0.5, -0.5])


def test_prepare_windows(spark):
    labels = spark.createDataFrame([(1, [1.0])], "record_id long, labels array<double>")
    records = spark.createDataFrame([(1, 0)], "record_id long, fold int")
    out = signals.prepare_windows(records, waves(spark, range(10), range(10)), labels, target_fs=20, length=20, chunk=5, fold_col="fold", folds=[0])
    assert out.count() == 4 and len(out.first()["signal"][0]) == 5


def prepared(x, fs, target, length, chunk, mean, std):
    """The chain on one record by hand: rate, length, window, scale, and what is not a number to 0 at the end."""
    x = np.array([[np.nan if v is None else v for v in lead] for lead in x], float)
    if fs != target:
        x = fourier(x, round(x.shape[1] * target / fs))
    x = np.pad(x[:, :length], ((0, 0), (0, max(0, length - x.shape[1]))))
    cuts = [x[:, i * chunk : (i + 1) * chunk] for i in range(length // chunk)] if chunk else [x]
    return [np.nan_to_num((c - np.array(mean)[:, None]) / (np.array(std)[:, None] + 1e-8)) for c in cuts]


@pytest.mark.parametrize(("target", "chunk"), [(10, None), (10, 4), (5, 2), (20, 5)])
def test_not_a_number_is_zero_after_scaling_and_unlabelled_records_have_zeros(spark, target, chunk):
    nan = float("nan")
    data = [(1, 0, 10, [[nan, 1.0, 2.0, 3.0], [1.0, 2.0, 3.0, 4.0]]), (2, 0, 10, [[1.0, None, 5.0] * 7, [2.0] * 21]), (3, 0, None, [[1.0] * 400, [nan] * 400]), (2, 1, 5, [[3.0, 4.0], [5.0, 6.0]])]
    df = spark.createDataFrame(data, "record_id long, seg_idx int, fs int, signal array<array<float>>")
    labels = spark.createDataFrame([(1, [1.0, 0.0]), (9, [1.0, 1.0])], "record_id long, labels array<double>")
    records = spark.createDataFrame([(1,), (2,), (3,)], "record_id long")
    out = signals.prepare_windows(records, df, labels, target_fs=target, length=8, chunk=chunk, mean=[1.0, 2.0], std=[1.0, 0.5])
    got = {(r["record_id"], r["seg_idx"], r["chunk_idx"]): r for r in out.collect()}
    n = 8 // chunk if chunk else 1
    assert len(got) == 4 * n
    for record, seg, fs, x in data:
        for k, want in enumerate(prepared(x, fs or 500, target, 8, chunk, [1, 2], [1, 0.5])):
            r = got[record, seg, k]
            assert np.allclose(r["signal"], want, atol=1e-6) and r["labels"] == ([1.0, 0.0] if record == 1 else [0.0, 0.0])
    if target == 10:
        assert got[1, 0, 0]["signal"][0][0] == 0.0  # not (0 - mean) / std


def test_the_chain_is_one_python_stage(spark):
    labels = spark.createDataFrame([(1, [1.0])], "record_id long, labels array<double>")
    records = spark.createDataFrame([(1, 0)], "record_id long, fold int")
    out = signals.prepare_windows(records, waves(spark, range(10)), labels, target_fs=20, length=20, chunk=5, mean=[0.0], std=[1.0], n_labels=1)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "lambda" not in plan and "Generate" not in plan


def test_signals_round_trip(spark):
    import pyarrow as pa

    kind = pa.list_(pa.list_(pa.float64()))
    data = pa.array([[[1.0, 2.0], [3.0]], None, [], [None, [4.0]], [[], [5.0, 6.0, 7.0]]], kind)
    for column, want in ((data, data.to_pylist()), (data[2:], data[2:].to_pylist()), (data[:0], [])):
        assert Signals.of(column).arrow().to_pylist() == want
    s = Signals.of(data)
    assert s.take(np.array([4, 0, 4])).arrow().to_pylist() == [data.to_pylist()[i] for i in (4, 0, 4)]
    windows, source = s.windows(2, 2)
    assert source.tolist() == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4] and windows.arrow().to_pylist()[8:] == [[[], [5.0, 6.0]], [[], [7.0]]]
    assert s.fitted(2).arrow().to_pylist() == [[[1.0, 2.0], [3.0, 0.0]], None, [], [None, [4.0, 0.0]], [[0.0, 0.0], [5.0, 6.0]]]
    assert s.cut(np.array([1, 0, 0, 0, 2]), 2).arrow().to_pylist() == [[[2.0], []], None, [], [None, [4.0]], [[], [7.0]]]


def preds(spark, rows):
    return spark.createDataFrame(rows, "ecg_id long, class_idx int, target int, score double")


def brute_auroc(y, s):
    pos, neg = [b for a, b in zip(y, s) if a], [b for a, b in zip(y, s) if not a]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)


def test_ranking_metrics(spark):
    random = np.random.default_rng(1)
    y, s = random.integers(0, 2, 200).tolist(), (random.integers(0, 20, 200) / 19).tolist()
    df = preds(spark, [(i, 0, a, b) for i, (a, b) in enumerate(zip(y, s))] + [(i, 1, 0, b) for i, b in enumerate(s)])
    got = {r["class_idx"]: r["auroc"] for r in metrics.auroc_per_class(df).collect()}
    assert got[0] == pytest.approx(brute_auroc(y, s)) and got[1] is None
    assert metrics.auroc_macro(df).first()[0] == pytest.approx(got[0]) == pytest.approx(metrics.auroc_micro(df).first()[0])
    ap = {r["class_idx"]: r["auprc"] for r in metrics.auprc_per_class(df).collect()}
    want = sum((sum(a for a, b in zip(y, s) if b == t)) * sum(a for a, b in zip(y, s) if b >= t) / sum(b >= t for b in s) for t in set(s)) / sum(y)
    assert ap[0] == pytest.approx(want) and ap[1] is None
    assert metrics.auprc_macro(df).first()[0] == pytest.approx(want / 2)
    flipped = preds(spark, [(i, 0, a, 1 - b) for i, (a, b) in enumerate(zip(y, s))])
    assert metrics.auroc_macro(flipped).first()[0] == pytest.approx(1 - got[0])


def test_threshold_is_inclusive(spark):
    df = preds(spark, [(1, 0, 1, 0.5), (2, 0, 0, 0.4), (1, 1, 0, 0.1)])
    assert metrics.f1_macro(df).first()[0] == pytest.approx(0.5)


def test_predictions_average_once(spark):
    rows = [(1, 0, 0, 1, 0.2), (1, 0, 1, 0, 0.6), (1, 0, 1, 0, 0.6)]
    df = spark.createDataFrame(rows, "ecg_id long, class_idx int, window int, target int, score double")
    out = metrics.aggregate_predictions(df).first()
    assert out["target"] == 1 and out["score"] == pytest.approx(0.4)
    plan = metrics.aggregate_predictions(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_encoder_shapes(spark):
    df = waves(spark, [1, 2, 3], [4, 5, 6]).withColumnRenamed("seg_idx", "chunk_idx")
    shapes = {
        "pair": lambda b: [(x.T, x.mean(axis=1)) for x in b],
        "turned": lambda b: [(x, x.mean(axis=1)) for x in b],
        "dict": lambda b: [{"pooled": x.mean(axis=1)} for x in b],
        "pooled": lambda b: [x.mean(axis=1) for x in b],
        "sequence": lambda b: [x.T for x in b],
    }
    for name, fn in shapes.items():
        got = features.encode_windows(df, lambda fn=fn: fn, 2).first()
        assert got["pooled"] == [2.0, 5.0] and got["seq"] == (None if name in ("dict", "pooled") else [[1.0, 4.0], [2.0, 5.0], [3.0, 6.0]])


def test_an_encoder_is_made_once_in_a_worker_and_gets_tensors(spark, tmp_path):
    folder = str(tmp_path)

    def make():
        import os
        import uuid

        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def encode(x):
            assert isinstance(x, np.ndarray) and x.ndim == 3 and len(x) <= 7
            return x.mean(axis=2)

        return encode

    df = spark.createDataFrame([(i, 0, [[float(i)] * 4, [1.0] * 4]) for i in range(100)], "record_id int, chunk_idx int, signal array<array<float>>").repartition(9)
    for _ in range(2):
        got = {r["record_id"]: r["pooled"] for r in features.encode_windows(df, make, 2, at_once=7).collect()}
        assert got == {i: [float(i), 1.0] for i in range(100)}
    workers = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert len(workers) <= 2 * len(set(workers)) and len(workers) < 2 * 9  # twice: two broadcasts


def test_stable_loss(spark):
    df = spark.createDataFrame([([800.0, -800.0], [1, 0])], "logits array<double>, targets array<int>")
    assert features.bce_loss(df).first()[0] == pytest.approx(0)


def test_linear_score_is_the_product(spark):
    random = np.random.default_rng(6)
    x, w, b = random.standard_normal((50, 9)), random.standard_normal((4, 9)) * 3, random.standard_normal(4)
    odd = [None, [1.0] * 8, [], [float("nan")] + [1.0] * 8, [None] + [1.0] * 8]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*x.tolist(), *odd])], "logit long, pooled array<double>")
    out = features.linear_score(df, w.tolist(), b.tolist())
    assert out.columns == ["logit", "pooled", "logits", "scores"]
    got = {r["logit"]: r for r in out.collect()}
    want = x @ w.T + b
    assert all(np.allclose(got[i]["logits"], want[i]) and np.allclose(got[i]["scores"], 1 / (1 + np.exp(-want[i]))) for i in range(50))
    assert all(got[50 + i]["logits"] == [0.0] * 4 and got[50 + i]["scores"] == [0.5] * 4 for i in range(len(odd)))
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_probe_separates(spark):
    rows = [(i, [float(i % 2), float(i % 3)], [i % 2, 0]) for i in range(60)]
    df = spark.createDataFrame(rows, "ecg_id long, pooled array<double>, targets array<int>")
    weights, bias, scores = features.linear_probe_fit(df, df, 2, ((0.01, 20),))
    assert scores.first()["auroc_macro"] == pytest.approx(1.0) and bias[1] == -20.0


def test_probe_is_at_the_optimum(spark, monkeypatch):
    """The slope is 0 there, a Newton fit by hand gives the same, and jobs don't grow with labels or candidates."""
    random = np.random.default_rng(11)
    x = random.standard_normal((400, 5)) * [1, 10, 0.1, 3, 1] + [0, 5, 0, 0, 0]
    y = (random.random((400, 3)) < 1 / (1 + np.exp(-(x @ random.standard_normal((5, 3)) * 0.4 - [0, 2, 4])))).astype(int)
    y[0] = [1, 1, 1]
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "ecg_id long, pooled array<double>, targets array<int>")
    passes = []
    whole = features.probe_pass
    monkeypatch.setattr(features, "probe_pass", lambda *a: passes.append(len(a[1])) or whole(*a))
    for grid in (((0.0, 200),), ((0.05, 200),), ((0.0, 200), (0.05, 200), (3.0, 200))):
        passes.clear()
        weights, bias, scores = features.linear_probe_fit(df, df, 3, grid, tolerance=1e-9)
        values = [r["auroc_macro"] for r in scores.orderBy("candidate").collect()]
        reg = grid[int(np.argmax(values))][0]
        assert passes[0] == 3 * len(grid) and len(passes) < 40
        for c in range(3):
            w, one = np.append(weights[c], bias[c]), np.column_stack([x, np.ones(400)])
            ridge = np.append(np.full(5, reg), 0)
            p = 1 / (1 + np.exp(-one @ w))
            assert np.abs(one.T @ (p - y[:, c]) / 400 + ridge * w).max() < 1e-8
            v = np.zeros(6)
            for _ in range(50):
                p = 1 / (1 + np.exp(-one @ v))
                v -= np.linalg.solve((one * (p * (1 - p))[:, None]).T @ one / 400 + np.diag(ridge) + 1e-12 * np.eye(6), one.T @ (p - y[:, c]) / 400 + ridge * v)
            assert np.allclose(v, w, atol=1e-5)


def test_odd_signals(spark):
    """Leads of unequal length, null leads and samples, no rate, no samples left, one more axis."""
    kinds = "record_id int, seg_idx int, fs int, signal array<array<double>>"
    up, down = [float(i % 7) for i in range(20)], [float(i % 5) for i in range(40)]
    rows = [(1, 0, 20, [up, down, []]), (2, 0, None, [up]), (3, 0, 20, None), (4, 0, 40, [None, down]), (5, 0, 20, []), (6, 0, 20, [[1.0]])]
    df = spark.createDataFrame(rows, kinds)
    got = {r["record_id"]: r["signal"] for r in signals.fourier_resample(df, 10).collect()}
    assert [len(x) for x in got[1]] == [10, 20, 0] and got[3] is None and got[5] == [] and got[6] == [[]]
    assert got[2] == [[]] and got[4][0] is None and len(got[4][1]) == 10  # 20 samples at 500 Hz are none at 10 Hz
    assert np.allclose(got[1][0], fourier(np.array([up]), 10)[0])
    line = {r["record_id"]: r["signal"] for r in signals.linear_resample(df, 8).collect()}
    assert np.allclose(line[1][1], linear(np.array([down]), 8)[0]) and line[1][2] == []
    deep = spark.createDataFrame([(1, [[[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]])], "record_id int, signal array<array<array<double>>>")
    assert signals.to_lead_major(deep, "samples").first()["signal"] == [[1.0, 3.0, 5.0], [2.0, 4.0, 6.0]]
    assert signals.to_lead_major(deep, "leads").first()["signal"] == [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]


def test_lead_stats_takes_the_first_rows(spark):
    df = spark.createDataFrame([(i, [[float(i), float(i + 1)]]) for i in range(50)], "record_id int, signal array<array<double>>")
    r = signals.lead_stats(df, limit=10).first()
    x = np.array([[i, i + 1] for i in range(10)], float)
    assert abs(r["mean"] - x.mean()) < 1e-9 and abs(r["std"] - np.sqrt((x**2).mean() - x.mean() ** 2)) < 1e-9


def test_lead_stats_reads_keys_first_and_counts_ties_by_share(spark, tmp_path):
    random = np.random.default_rng(4)
    x = random.standard_normal((60, 2, 5))
    data = [(None if i < 3 else i // 10, x[i].tolist()) for i in range(60)] + [(5, x[59].tolist())] * 20
    spark.createDataFrame(data, "record_id int, signal array<array<double>>").write.parquet(str(tmp_path / "w"))
    df = spark.read.parquet(str(tmp_path / "w"))
    scan = signals.first_keys(df, 10, ("record_id",))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<record_id:int>" in scan and "signal" not in scan
    for limit, rows in ((3, x[:3]), (10, x[:10]), (60 + 20, [*x, *[x[59]] * 20]), (1000, [*x, *[x[59]] * 20])):
        got = {r["lead"]: r for r in signals.lead_stats(df, limit).collect()}
        for lead in (0, 1):
            own = np.array([r[lead] for r in rows])
            assert abs(got[lead]["mean"] - own.mean()) < 1e-9 and abs(got[lead]["std"] - np.sqrt((own**2).mean() - own.mean() ** 2)) < 1e-9
    same = spark.createDataFrame([(1, x[0].tolist())] * 30 + [(1, x[1].tolist())] * 30, "record_id int, signal array<array<double>>")
    for limit in (1, 31, 45):
        hashes = sorted((r[0], np.array(r[1])) for r in same.selectExpr("xxhash64(signal)", "signal").collect()[::30])
        own = np.array([hashes[0][1][0]] * min(30, limit) + [hashes[1][1][0]] * max(0, limit - 30))
        assert abs(signals.lead_stats(same, limit).filter("lead = 0").first()["mean"] - own.mean()) < 1e-9
    assert signals.lead_stats(df.limit(0)).count() == 0
