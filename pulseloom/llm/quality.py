"""Quality by compression: how much shorter a text gets with a dictionary of good texts than with one of bad texts.

Two zstandard dictionaries are built from labelled training texts, one per label. A text is compressed with either;
(size with bad - size with good) / its bytes, together with its length, goes through a logistic curve that is fitted
on other labelled training rows than those of the dictionaries.

The fit uses at most ``most`` labelled rows, and of them for either dictionary at most ``texts`` texts of at most ``longest``
bytes and ``times`` times the dictionary's size in all (documented bounds); every text is scored whole. Nulls: a null text is scored as empty, that is by the curve at a
difference of 0. Without labels of both kinds the score is the share of label 1 (1/2 without any). Repeated rows are
scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import keep
from .labelled import id_crc, labelled_sample, logistic, sigmoid


@dataclass
class Model:
    bad: bytes = b""
    good: bytes = b""
    level: int = 1
    weights: np.ndarray = field(default_factory=lambda: np.zeros(5))

    def compressors(self) -> list:
        import zstandard

        out = []
        for data in (self.bad, self.good):
            words = zstandard.ZstdCompressionDict(data) if data else None
            if words:
                words.precompute_compress(level=self.level)
            out.append(zstandard.ZstdCompressor(level=self.level, dict_data=words, write_content_size=False) if words else zstandard.ZstdCompressor(level=self.level, write_content_size=False))
        return out


def columns(text: bytes, compressors: list) -> tuple[float, ...]:
    """Difference per byte, short texts shrunk a little and more, the better ratio, log length, 1."""
    n = len(text)
    bad, good = (len(c.compress(text)) for c in compressors)
    return (10 * (bad - good) / (n + 20), 10 * (bad - good) / (n + 300), min(bad, good) / (n + 20), np.log1p(n) / 10, 1.0)


def _dictionary(texts: list[bytes], size: int) -> bytes:
    import zstandard

    texts = [t for t in texts if t]
    try:
        return zstandard.train_dictionary(size, texts, level=3).as_bytes()
    except zstandard.ZstdError:  # too few texts to train on: they are the dictionary
        return b"".join(texts)[-size:]


def fit(docs: DataFrame, labels: DataFrame, most: int = 12_000, longest: int = 65_536, size: int = 112_640, texts: int = 3000, times: int = 100, every: int = 5, held: int = 0) -> Model:
    """Learn from at most ``most`` labelled rows whose crc32(doc_id) mod ``every`` is not ``held``."""
    sample = keep(labelled_sample(docs, labels, "quality", F.pmod(id_crc(), F.lit(every)) != held, most))
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))
    sizes = sample.agg(*[F.coalesce(F.sum((F.col("y") == k).cast("long")), F.lit(0)).alias(f"n{k}") for k in (0, 1)]).first()
    model = Model()
    if not sizes["n0"] or not sizes["n1"]:
        model.weights[-1] = 0.0 if not (sizes["n0"] or sizes["n1"]) else (3.0 if sizes["n1"] else -3.0)
        return model
    # these texts reach the driver
    chosen: list[list[bytes]] = []
    for k in (0, 1):
        fits = sample.filter((half == 0) & (F.col("y") == k) & (F.octet_length("text") <= longest)).orderBy(F.xxhash64("doc_id"), "doc_id")
        own, total = [], 0
        for r in fits.select(F.encode("text", "UTF-8").alias("b")).limit(texts).toLocalIterator():
            own.append(bytes(r["b"]))
            total += len(own[-1])
            if total > times * size:
                break
        chosen.append(own)
    # lines that both classes have tell nothing, and would sit in the dictionary of the smaller class only
    lines = [{line for t in own for line in t.split(b"\n")} for own in chosen]
    both = lines[0] & lines[1]
    model.bad, model.good = (_dictionary([b"\n".join(x for x in t.split(b"\n") if x not in both) for t in own], size) for own in chosen)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = model.compressors()
        for b in batches:
            rows = [columns((x or "").encode(), pair) for x in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["y"], pa.array([list(r) for r in rows], pa.list_(pa.float64()))], names=["y", "x"])

    rows = sample.filter(half == 1).select("text", "y").mapInArrow(look, "y int, x array<double>").collect()
    y = np.array([r["y"] for r in rows], float)
    if len(set(y)) == 2:
        model.weights = logistic(np.array([r["x"] for r in rows]), y, 1e-2)
    else:
        model.weights = np.array([1.0, 0.0, 0.0, 0.0, 1.0])
    return model


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = model.compressors()
        for b in batches:
            x = np.array([columns((t.as_py() or "").encode(), pair) for t in b["text"]], float).reshape(-1, 5)
            score = sigmoid(x @ model.weights)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
