"""Toxicity by weak supervision.

Many voters look at a text: lexicons (a short general one and ones mined from labelled training rows: whole words, and
beginnings of words for compounds and inflections) and patterns. A generative label model estimates, without using
the labels again, how often each voter is right and which voters err together; its posterior labels the training
texts. A linear classifier is fitted to the posterior and calibrated on the training labels.

The fit uses at most ``most`` labelled rows (a documented bound); every text is scored whole.
Nulls: a null text is scored as empty. An empty table of labels gives a model without mined words, whose score is the
prior moved by the general lexicon alone. Repeated rows are scored alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import keep
from .labelled import SparseRows, id_crc, labelled_sample, logistic, product, sigmoid

LETTERS = re.compile(r"[^\W\d_]+")
#: Words that insult in general use.
INSULTS = frozenset("idiot moron stupid scum trash loser pathetic worthless disgusting clown fool dumb imbecile filth vermin".split())
PATTERNS = (
    re.compile(r"\b(?:you|your|he|she|they)\b[^.!?\n]{0,40}\b(?:" + "|".join(sorted(INSULTS)) + r")\b", re.I),
    re.compile(r"\b\w[*@#$]{2,}\w*\b"),
    re.compile(r"[A-Z]{4,}!{2,}"),
    re.compile(r"!{3,}"),
)
#: Stretches of which a text that matches the pattern holds at least one.
NEEDED = ((), ("*", "@", "#", "$"), ("!!",), ("!!!",))
BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: Words whose features a task remembers, none longer than this.
REMEMBERED, LONGEST = 100_000, 40
LEXICONS = 8
#: Columns that follow the mined features: lexicon hits, hits per 100 words, insults, patterns, log of words.
EXTRA = 3 + len(PATTERNS) + 1


def features_of(word: str) -> list[str]:
    """The word itself, if it isn't very long, and its beginnings."""
    return ([word] if len(word) <= 16 else []) + [f"{word[:k]}*" for k in BEGINNINGS if len(word) > k]


@dataclass
class Model:
    index: dict[str, int]
    lexicon: np.ndarray
    heads: frozenset[str] = frozenset()
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: tuple[float, float] = (1.0, 0.0)
    accuracy: np.ndarray = field(default_factory=lambda: np.zeros(0))
    correlation: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    seen: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def known(self, word: str) -> tuple[int, ...]:
        """The mined features of a word, which are remembered."""
        found = tuple(i for f in features_of(word) if (i := self.index.get(f)) is not None) if word[:3] in self.heads else ()
        if len(word) <= LONGEST:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[word] = found
        return found

    def look(self, text: str) -> tuple[dict[int, float], np.ndarray, np.ndarray]:
        """Columns that aren't 0 of the mined features, further columns, and the votes (1 toxic, -1 clean, 0 none) on one text.

        A mined feature has two columns: that it occurs, and how often in 100 words.
        """
        words = Counter(LETTERS.findall(text.lower()))
        n = sum(words.values())
        found: dict[int, int] = {}
        insults, hits = sum(words[w] for w in INSULTS if w in words), 0
        for (w, c), known in zip(words.items(), map(self.seen.get, words)):
            if known is None:
                known = self.known(w)
            if known:
                hits += c
                for i in known:
                    found[i] = found.get(i, 0) + c
        patterns = [bool(insults and PATTERNS[0].search(text))]
        patterns += [len(p.findall(text)) if any(x in text for x in need) else 0 for p, need in zip(PATTERNS[1:], NEEDED[1:])]
        more = np.array([min(hits, 8), min(100 * hits / max(n, 20), 8), min(insults, 4), *(min(x, 2) for x in patterns), np.log1p(n) / 5])
        votes = np.zeros(2 * LEXICONS + 1 + len(PATTERNS) + 2, np.int8)
        votes[self.lexicon[list(found)]] = 1
        votes[2 * LEXICONS] = insults > 0
        votes[2 * LEXICONS + 1 : -2] = np.array(patterns) > 0
        votes[-2] = -1 if n and hits == 0 else 0
        votes[-1] = -1 if n and insults == 0 and 100 * hits < n else 0
        m = len(self.index)
        columns = {i: 1.0 for i in found} | {m + i: min(3.0, 100 * c / max(n, 50)) for i, c in found.items()}
        return columns, more, votes

    def row(self, found: dict[int, float], more: np.ndarray) -> float:
        w = self.weights
        return float(sum(w[i] * x for i, x in found.items()) + w[2 * len(self.index) : -1] @ more + w[-1])

    def score(self, text: str) -> float:
        found, more, _ = self.look(text)
        return float(sigmoid(np.array(self.scale[0] * self.row(found, more) + self.scale[1])))


def mined_features(sample: DataFrame, most: int) -> list[str]:
    """The features that mark toxic training rows best: by likelihood ratio, of those at least 4 times as frequent there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for text, y in zip(b["text"].to_pylist(), b["y"].to_pylist()):
                by[y > 0].update({f for w in set(LETTERS.findall((text or "").lower())) for f in features_of(w)})
        names = list(by[0].keys() | by[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in by)], names=["feature", "clean", "toxic"]
        )

    total = sample.agg(F.coalesce(F.sum(1 - F.col("y")), F.lit(0)).alias("c"), F.coalesce(F.sum("y"), F.lit(0)).alias("t")).first()
    if not total["t"] or not total["c"]:
        return []
    sums = sample.select("text", "y").mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rate = (F.col("toxic") / total["t"], (F.col("clean") + 0.5) / total["c"])
    gain = F.col("toxic") * F.log(rate[0] / rate[1])
    rows = sums.filter((F.col("toxic") >= 4) & (rate[0] > 4 * rate[1])).orderBy(gain.desc(), "feature").limit(most).collect()
    return [r["feature"] for r in rows]


def label_model(votes: np.ndarray, prior: float, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the positive label, each voter's accuracy, and how voters correlate given the label.

    Expectation maximisation over P(vote | label). Voters that agree beyond what the label explains carry less than
    their sum: a voter's evidence is divided by the total of its conditional correlations above 0.1, its own (1) included.
    """
    n, m = votes.shape
    # to begin with, voters that are all but copies of each other share one vote
    spread = votes - votes.mean(axis=0)
    size = np.sqrt((spread**2).mean(axis=0)) + 1e-6
    correlation = spread.T @ spread / n / np.outer(size, size)
    np.fill_diagonal(correlation, 1)
    share = 1 / (correlation > 0.8).sum(axis=1)
    for_, against = (votes > 0) @ share, (votes < 0) @ share
    q = np.where((for_ > 0) & (for_ >= against), 0.9, 0.5 * prior)
    is_vote = np.stack([votes == v for v in (-1, 0, 1)]).astype(float)
    for _ in range(rounds):
        weight = np.stack([1 - q, q])
        rates = np.einsum("yn,vnm->yvm", weight, is_vote) + 0.1
        rates /= rates.sum(axis=1, keepdims=True)
        expected = rates[:, 2] - rates[:, 0]
        rest = votes - np.einsum("yn,ym->nm", weight, expected)
        spread = np.sqrt((rest**2).mean(axis=0)) + 1e-6
        correlation = (rest.T @ rest) / n / np.outer(spread, spread)
        np.fill_diagonal(correlation, 1)
        share = 0.5 * share + 0.5 / np.where(correlation > 0.1, correlation, 0).sum(axis=1)
        evidence = np.einsum("vnm,vm->nm", is_vote, np.log(rates[1]) - np.log(rates[0])) @ share
        new = sigmoid(evidence + np.log(prior / (1 - prior)))
        moved, q = np.abs(new - q).max(), new
        if moved < 1e-5:
            break
    right = np.where(votes > 0, q[:, None], np.where(votes < 0, 1 - q[:, None], 0)).sum(axis=0)
    return q, (right + 0.5) / ((votes != 0).sum(axis=0) + 1), correlation


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000, most_features: int = 400, every: int = 3, held: int = 1) -> Model:
    """Learn from at most ``most`` labelled rows whose crc32(doc_id) mod ``every`` is not ``held``."""
    sample = keep(labelled_sample(docs, labels, "toxic", F.pmod(id_crc(), F.lit(every)) != held, most))
    names = mined_features(sample, most_features)
    # words and beginnings are voters of their own kinds, dealt out by rank; the label model finds those that go together
    place = Counter()
    lexicon = []
    for x in names:
        kind = int(x.endswith("*"))
        lexicon.append(kind * LEXICONS + place[kind] % LEXICONS)
        place[kind] += 1
    model = Model({x: i for i, x in enumerate(names)}, np.array(lexicon, np.int64), frozenset(x[:3] for x in (n.rstrip("*") for n in names)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [model.look(x or "") for x in b["text"].to_pylist()]
            many = np.array([len(r[0]) for r in rows], np.int32)
            column = np.fromiter((i for r in rows for i in r[0]), np.int32, many.sum())
            value = np.fromiter((x for r in rows for x in r[0].values()), np.float32, many.sum())
            more, votes = np.array([r[1] for r in rows], np.float32), np.array([r[2] for r in rows], np.int8)
            packed = [np.asarray(b["y"], np.float32), many, column, value, more, votes]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in packed], names=names_)

    # a row for each batch, packed: as objects the rows would take the driver several times as much
    names_ = ["y", "many", "column", "value", "more", "votes"]
    rows = sample.select("text", "y").mapInArrow(look, ", ".join(f"{x} binary" for x in names_)).toArrow()
    y, many, column, value, more, votes = (np.frombuffer(b"".join(rows[x].to_pylist()), t) for x, t in zip(names_, "<f4 <i4 <i4 <f4 <f4 i1".split()))
    del rows
    y, m = y.astype(float), 2 * len(names)
    model.weights = np.zeros(m + EXTRA + 1)
    if len(set(y.tolist())) < 2:  # nothing to learn from: the general lexicon decides
        model.weights[m + 2], model.weights[-1] = 2.0, -3.0
        return model
    x = SparseRows(many, column, value, np.hstack([more.reshape(len(y), -1), np.ones((len(y), 1), np.float32)]), m)
    posterior, model.accuracy, model.correlation = label_model(votes.reshape(len(y), -1), y.mean())
    model.weights = logistic(x, posterior, 1.0)
    raw = product(x, model.weights)
    a, b = logistic(np.stack([raw / 4, np.ones(len(raw))], axis=1), y, 1e-3)
    model.scale = (max(a / 4, 1e-3), b)
    return model


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = np.array([model.score(x.as_py() or "") for x in b["text"]], float)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The documents, all columns, whose score is under the threshold; a filter on an Arrow UDF, no join."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def score(text):
        return text.map(lambda x: model.score(x or ""))

    return docs.filter(score("text") < threshold)
