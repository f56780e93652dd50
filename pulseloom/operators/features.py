"""Features of windows, linear scores, loss and a linear probe."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.matrix import lists_of, matrix_sum, rows_of
from ..functions.shared import keep
from .metrics import auroc_per_class
from .waves import Signals


def _pair(out, dim: int) -> tuple[np.ndarray | None, np.ndarray]:
    """One output in any of four shapes as (sequence T x D or none, pooled D)."""
    if isinstance(out, dict):
        out = (out.get("sequence"), out.get("pooled"))
    if isinstance(out, tuple):
        sequence, pooled = out
        if sequence is not None and (sequence := np.asarray(sequence, float)).shape[-1] != dim:
            sequence = sequence.T
        return sequence, np.asarray(pooled, float) if pooled is not None else sequence.mean(axis=0)
    out = np.asarray(out, float)
    return (None, out) if out.ndim == 1 else (out, out.mean(axis=0))


#: The encoder of a Python worker, by the name of its broadcast factory.
_encoders: dict[str, Callable] = {}


def _encoder(name: str, sent) -> Callable:
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = pickle.loads(sent.value)()
    return _encoders[name]


def encode_windows(df: DataFrame, make: Callable[[], Callable], feature_dim: int, keys: tuple[str, ...] = ("record_id", "chunk_idx"), at_once: int = 64) -> DataFrame:
    """keys, seq (T x D or null), pooled (D): the user's encoder over the windows, ``at_once`` at a time.

    ``make`` is broadcast and called once in each Python worker; it loads the weights and gives the encoder. That takes one tensor
    (windows x leads x samples) where all have one shape, else a list of matrices, and returns one output each: (sequence, pooled), a
    dictionary of the two, a pooled vector or a sequence. A sequence whose last size isn't the feature size is turned.
    Samples and features stay in arrays both ways; nothing larger than ``at_once`` windows is built.
    """
    sent = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(make))
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, sent)
        for batch in batches:
            for a in range(0, batch.num_rows, at_once):
                b = batch.slice(a, at_once)
                x = Signals.of(b["signal"]).matrices()
                alike = all(isinstance(m, np.ndarray) and m.shape == x[0].shape for m in x)
                found = [_pair(o, feature_dim) for o in encoder(np.stack(x) if alike else x)]
                many = np.array([0 if s is None else len(s) for s, _ in found], np.int64)
                steps = lists_of(np.concatenate([np.zeros((0, feature_dim)), *(s for s, _ in found if s is not None)]))
                ends = pa.array(np.append(0, np.cumsum(many)).astype(np.int32))
                seq = pa.ListArray.from_arrays(ends, steps, mask=pa.array([s is None for s, _ in found], pa.bool_()))
                size = np.array([len(p) for _, p in found], np.int64)
                pooled = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(np.concatenate([np.zeros(0), *(p for _, p in found)])))
                yield pa.RecordBatch.from_arrays([*(b[k] for k in keys), seq, pooled], names=[*keys, "seq", "pooled"])

    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "seq array<array<double>>", "pooled array<double>"])
    return df.select(*keys, "signal").mapInArrow(run, schema)


def mean_pool(df: DataFrame, col: str = "seq", out: str = "pooled") -> DataFrame:
    """T x D features to D by the mean over T."""
    zero = F.array_repeat(F.lit(0.0), F.size(F.col(col)[0]))
    total = F.aggregate(col, zero, lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    return df.withColumn(out, F.transform(total, lambda x: x / F.size(col)))


def linear_score(df: DataFrame, weights: list[list[float]], bias: list[float], col: str = "pooled") -> DataFrame:
    """Add logits and scores: W x + b per class, and its logistic function, as one matrix product per Arrow batch.

    A logit that is not a number, such as that of a null, incomplete or ill-sized feature vector, is 0. The weights are broadcast.
    """
    w, b = np.array(weights, float).reshape(len(bias), -1), np.array(bias, float)
    sent = df.sparkSession.sparkContext.broadcast((np.ascontiguousarray(w.T), b))

    def score(features: pa.Array) -> pa.Array:
        turned, own = sent.value
        x, good = rows_of(features, len(turned))
        logits = np.where(good[:, None], x @ turned + own, 0.0)
        logits[np.isnan(logits)] = 0.0
        with np.errstate(over="ignore"):
            return pa.StructArray.from_arrays([lists_of(logits), lists_of(1 / (1 + np.exp(-logits)))], names=["logits", "scores"])

    found = F.arrow_udf(score, "logits array<double>, scores array<double>")
    return df.withColumn("_scored", found(F.col(col))).select("*", "_scored.*").drop("_scored")


def bce_loss(df: DataFrame) -> DataFrame:
    """loss: mean binary cross-entropy of (logits, targets) arrays over all rows and classes, in the stable form."""
    rows = df.select(F.explode(F.arrays_zip("logits", "targets")).alias("r")).select(F.col("r.logits").alias("x"), F.col("r.targets").cast("double").alias("y"))
    return rows.agg(F.avg(F.greatest("x", F.lit(0.0)) - F.col("x") * F.col("y") + F.log1p(F.exp(-F.abs("x")))).alias("loss"))


@dataclass
class _Fits:
    """Many logistic regressions on the same rows, side by side: column k fits label ``label[k]`` with the penalty ``reg[k]``.

    Limited-memory quasi-Newton steps (``memory`` pairs each). The first metric is the exact Hessian where every fit starts, at
    zero weights and the label's log odds: p (1 - p) times the features' second moments, plus the penalty. Each fit has its own step:
    one whose loss does not fall tries a shorter one in the next pass, while the others go on.
    """

    moments: np.ndarray
    label: np.ndarray
    reg: np.ndarray
    start: np.ndarray
    most: np.ndarray
    tolerance: float
    memory: int = 12
    w: np.ndarray = field(init=False)

    def __post_init__(self):
        k, d = len(self.label), len(self.moments)
        self.w = np.zeros((k, d))
        self.w[:, -1] = np.log(self.start / (1 - self.start))
        self.penalty = np.append(np.ones(d - 1), 0.0) * self.reg[:, None]
        self.loss, self.slope = np.full(k, np.inf), np.zeros((k, d))
        self.way, self.step, self.taken, self.tried = np.zeros((k, d)), np.zeros(k), np.zeros(k, int), np.zeros(k, int)
        self.pairs: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(k)]
        self.open = np.ones(k, bool)
        values, vectors = np.linalg.eigh(self.moments)  # shared: a penalty and a factor p (1 - p) only move the eigenvalues
        self.values, self.vectors = np.maximum(values, 1e-12 * max(values.max(), 1e-300)), vectors

    def metric(self, k: int, g: np.ndarray) -> np.ndarray:
        p = self.start[k]
        return self.vectors @ ((self.vectors.T @ g) / (p * (1 - p) * self.values + self.reg[k]))

    def direction(self, k: int) -> np.ndarray:
        q, kept = self.slope[k].copy(), []
        for s, y in reversed(self.pairs[k]):
            a = (s @ q) / (s @ y)
            q -= a * y
            kept.append(a)
        q = self.metric(k, q)
        for (s, y), a in zip(self.pairs[k], reversed(kept)):
            q += (a - (y @ q) / (s @ y)) * s
        return -q

    def trial(self) -> np.ndarray:
        return self.w + self.step[:, None] * self.way

    def take(self, loss: np.ndarray, slope: np.ndarray) -> None:
        """Loss and slope at the trial, of the open fits."""
        at = self.trial()
        for k in np.flatnonzero(self.open):
            own = loss[k] + 0.5 * (self.penalty[k] * at[k] ** 2).sum()
            g = slope[k] + self.penalty[k] * at[k]
            falls = own <= self.loss[k] + 1e-4 * self.step[k] * (self.way[k] @ self.slope[k]) + 1e-13 * abs(own)
            if not falls and self.tried[k] < 25:
                self.step[k] *= 0.4
                self.tried[k] += 1
                continue
            if falls:
                s, y = at[k] - self.w[k], g - self.slope[k]
                if s @ y > 1e-12 * np.sqrt((s @ s) * (y @ y)) and self.taken[k]:
                    self.pairs[k] = [*self.pairs[k][-self.memory + 1 :], (s, y)]
                self.w[k], self.loss[k], self.slope[k] = at[k], own, g
                self.taken[k] += 1
            self.open[k] = falls and np.abs(self.slope[k]).max() > self.tolerance and self.taken[k] <= self.most[k]
            self.way[k], self.step[k], self.tried[k] = self.direction(k), 1.0, 0


def probe_pass(rows: DataFrame, weights: np.ndarray, label: np.ndarray, n_classes: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean log loss of each fit, and its slope by the weights (the bias last), in one pass over (x, y) for all fits."""
    size = weights.shape[1]
    sent = rows.sparkSession.sparkContext.broadcast((weights, label))

    def part(b: pa.RecordBatch) -> np.ndarray:
        w, own = sent.value
        total = np.zeros((len(w), size + 1))
        for a in range(0, b.num_rows, 4096):
            x = np.column_stack([rows_of(b["x"].slice(a, 4096), size - 1)[0], np.ones(min(4096, b.num_rows - a))])
            y = rows_of(b["y"].slice(a, 4096), n_classes)[0][:, own]
            z = x @ w.T
            total[:, 0] += (np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))).sum(axis=0)
            total[:, 1:] += (1 / (1 + np.exp(-np.clip(z, -700, 700))) - y).T @ x
        return total

    total = matrix_sum(rows, part, (len(weights), size + 1)) / n
    sent.unpersist()
    return total[:, 0], total[:, 1:]


def linear_probe_fit(
    train: DataFrame, val: DataFrame, n_classes: int, grid: tuple[tuple[float, int], ...] = ((0.0, 50), (0.01, 50), (0.1, 50)), tolerance: float = 1e-7
) -> tuple[list[list[float]], list[float], DataFrame]:
    """Weights, biases and the candidates' validation scores (candidate, auroc_macro) of one linear classifier per label.

    Inputs have ecg_id, pooled and targets (arrays; what is null or not a number counts 0). A candidate is (penalty, steps at most);
    its classifiers minimise the mean log loss plus half the penalty times the squared weights, the bias left out. All
    labels of all candidates are fitted side by side: a step is one job over the features, which sums a gradient matrix, however
    many there are. The candidate with the best macro AUROC on ``val`` is kept, the first on ties. A label with one kind of
    training rows gets a constant.
    """
    spark = train.sparkSession
    clean = lambda c: F.transform(c, lambda v: F.coalesce(F.nanvl(v.cast("double"), F.lit(0.0)), F.lit(0.0)))
    rows = keep(train.select(clean("pooled").alias("x"), clean("targets").alias("y")))
    n, size = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    size = (size or 0) + 1

    def moments(b: pa.RecordBatch) -> np.ndarray:
        x = np.column_stack([rows_of(b["x"], size - 1)[0], np.ones(b.num_rows)])
        y = rows_of(b["y"], n_classes)[0]
        return np.vstack([x.T @ x, np.pad(y.sum(axis=0)[:, None], ((0, 0), (0, size - 1)))])

    total = matrix_sum(rows, moments, (size + n_classes, size)) / max(n, 1)
    share = total[size:, 0]
    fitted = np.flatnonzero((share > 0) & (share < 1))
    label, reg = np.tile(fitted, len(grid)), np.repeat([float(r) for r, _ in grid], len(fitted))
    fits = _Fits(total[:size], label, reg, share[label], np.repeat([int(m) for _, m in grid], len(fitted)), tolerance)
    while fits.open.any():
        some = np.flatnonzero(fits.open)
        loss, slope = np.zeros(len(label)), np.zeros((len(label), size))
        loss[some], slope[some] = probe_pass(rows, fits.trial()[some], label[some], n_classes, n)
        fits.take(loss, slope)
    weights, bias = np.zeros((len(grid), n_classes, size - 1)), np.where(share > 0, 20.0, -20.0)[None, :].repeat(len(grid), axis=0)
    for k, (c, w) in enumerate(zip(label, fits.w)):
        weights[k // max(1, len(fitted)), c], bias[k // max(1, len(fitted)), c] = w[:-1], w[-1]
    # all candidates' scores in one product, and each (candidate, class) is a class of its own
    scored = linear_score(val.select("ecg_id", "pooled", "targets"), weights.reshape(-1, size - 1).tolist(), bias.ravel().tolist())
    each = scored.select("ecg_id", "targets", F.posexplode("scores").alias("class_idx", "score"))
    preds = each.select("ecg_id", "class_idx", F.get("targets", F.col("class_idx") % n_classes).cast("int").alias("target"), "score")
    found = {r["class_idx"]: r["auroc"] for r in auroc_per_class(preds).collect()}
    scores: list[tuple[int, float | None]] = []
    for i in range(len(grid)):
        own = [v for c in range(n_classes) if (v := found.get(i * n_classes + c)) is not None]
        scores.append((i, float(np.mean(own)) if own else None))
    best = max(scores, key=lambda x: (-1.0 if x[1] is None else x[1], -x[0]))[0]
    return weights[best].tolist(), bias[best].tolist(), spark.createDataFrame(scores, "candidate int, auroc_macro double")
