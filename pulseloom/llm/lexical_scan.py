"""Ranked lexical search by scanning texts with an automaton of all items' terms; there is no document index.

An item's terms are distinct, as its score counts each once. A term stands in the automaton between two guard characters, and
in a text every separator becomes the guard, so a match is a whole term; its number leads to the items that hold it. A text is
scanned twice: for the document frequencies of the items' terms (with the number of documents and of terms), and for
the scores. Both need nothing of a document but its text, and a task keeps each item's best documents so far and no others.

Scale: the items are the stated query set. They are dealt into blocks of ``BLOCK`` bytes of terms, and each block has its own
automaton, which is what is broadcast (a longer item is a block of its own). All documents are scanned for each block. A
task returns ``k`` rows an item at most; a window by item, which Spark limits to k rows inside tasks, ranks them.

All numbers but the logarithm are 64-bit integers, and sums of scores stay below 2^53, where doubles are exact.

Nulls: a null text has no terms, nor has a null item. Equal scores go to the smaller id, a null id last; repeated rows, of
documents or items, are each ranked by themselves. Empty tables give no rows. Further columns are left out, whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import running_total
from ..functions.shared import keep
from .text import data_of, parts, words_of

#: What ends a term: every ASCII character but letters and digits.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of terms in an automaton; it takes about a hundred times as much memory.
BLOCK = 1 << 20
#: Scores in memory at once.
CELLS = 4_000_000
_GUARD = 10
_plain = np.full(256, _GUARD, np.uint8)
_plain[128:] = np.arange(128, 256)
_plain[48:58], _plain[97:123], _plain[65:91] = np.arange(48, 58), np.arange(97, 123), np.arange(97, 123)


def terms_of(text: Column | str) -> Column:
    """The terms of a text in order; none for a null."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0)), F.lit([]).cast("array<string>"))


def item_blocks(items: DataFrame, block: int = BLOCK) -> DataFrame:
    """_item (a number for each row), item_id, terms, _block; items without terms are left out. Kept."""
    rows = items.select("item_id", F.array_distinct(terms_of("text")).alias("terms")).filter(F.size("terms") > 0)
    size = F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t) + 1)
    rows = keep(rows.withColumns({"_item": F.monotonically_increasing_id(), "_size": size, "_part": F.spark_partition_id()}))
    placed = running_total(rows, {"_before": "_size"}, "_part", ["_item"])
    return keep(placed.select("_item", "item_id", "terms", F.floor(F.col("_before") / block).alias("_block")))


@dataclass
class Items:
    """A block of items: its distinct terms, and the items that hold each."""

    terms: list[str]
    start: np.ndarray
    items: np.ndarray
    n: int
    common: np.ndarray
    holds: np.ndarray

    @staticmethod
    def of(lists: list[list[str]]) -> Items:
        number: dict[str, int] = {}
        term = np.array([number.setdefault(t, len(number)) for x in lists for t in x], np.int64)
        item = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        item, many = item[np.argsort(term, kind="stable")], np.bincount(term, minlength=len(number))
        common = many * 8 >= len(lists)  # as a matrix; the others term by term
        holds = np.zeros((int(common.sum()), len(lists)))
        holds[(np.cumsum(common) - 1)[np.repeat(np.arange(len(number)), many)[np.repeat(common, many)]], item[np.repeat(common, many)]] = 1
        return Items(list(number), np.append(0, np.cumsum(many)), item, len(lists), common, holds)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, t in enumerate(self.terms):
            found.add_word(f"\n{t.encode().decode('latin-1')}\n", i)
        found.make_automaton()
        return found


def scan(batch: pa.RecordBatch, automaton) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows [a, b): the number of terms of each text, and the text, term and frequency of each pair that occurs.

    Bytes stand for characters: UTF-8 has no byte of a separator inside a longer character.
    """
    for a, b in parts(batch):
        data, places = data_of(batch["text"].slice(a, b - a))
        data = _plain[data]
        n = np.diff(words_of(data, places)[2])
        line = np.insert(data, places, _GUARD).tobytes().decode("latin-1")
        found = np.fromiter(chain.from_iterable(automaton.iter(line)), np.int64).reshape(-1, 2)
        doc = np.searchsorted(places + np.arange(b - a + 1), found[:, 0] - 1, "right") - 1
        kinds = np.int64(len(automaton))
        pair, tf = np.unique(doc * kinds + found[:, 1], return_counts=True)
        yield a, b, n, pair // kinds, pair % kinds, tf


def statistics(docs: DataFrame, sent) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the document frequency of each term of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        automaton, df = block.automaton(), np.zeros(len(block.terms) + 2, np.int64)
        for batch in batches:
            for _, _, n, _, term, _ in scan(batch, automaton):
                df[:-2] += np.bincount(term, minlength=len(block.terms))
                df[-2:] += (int((n > 0).sum()), int(n.sum()))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "n"])

    sums = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(sent.value.terms) + 2, np.int64)
    out[np.asarray(sums["term"], np.int64)] = np.asarray(sums["n"], np.int64)
    return int(out[-2]), int(out[-1]), out[:-2]


class Best:
    """The k best (score, null id, id) of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.held = [np.zeros(0, np.int64) for _ in range(4)]
        self.new: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        doc, item = np.nonzero(scores >= self.least)
        self.new.append((item, scores[doc, item].astype(np.int64), nulls[doc].astype(np.int64), ids[doc]))
        self.waiting += len(doc)
        if self.waiting > max(100_000, 4 * self.k * len(self.least)):
            self.settle()

    def settle(self) -> None:
        item, score, null, doc_id = (np.concatenate(x) for x in zip(self.held, *self.new))
        order = np.lexsort((doc_id, null, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        last = order[rank == self.k - 1]
        order = order[rank < self.k]
        self.held = [x[order] for x in (np.concatenate(x) for x in zip(self.held, *self.new))]
        self.least[self.held[0][np.flatnonzero(rank[rank < self.k] == self.k - 1)]] = score[last]
        self.new, self.waiting = [], 0


def _scored(docs: DataFrame, sent, weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """at (the item's place in the block), doc_id, score: the best of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Items = sent.value
        automaton, best = block.automaton(), Best(block.n, k)
        common, place = block.common, np.cumsum(block.common) - 1
        many = np.diff(block.start)
        for batch in batches:
            for a, b, n, doc, term, tf in scan(batch, automaton):
                size = 50 + (50 * n * n_docs) // max(1, n_terms)
                gain = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * size[doc]))
                ids = batch["doc_id"].slice(a, b - a)
                nulls, numbers = np.asarray(ids.is_null()), np.asarray(ids.cast(pa.int64()).fill_null(0))
                step = max(1, CELLS // max(block.n, len(block.holds)))
                for low in range(0, b - a, step):
                    high = min(low + step, b - a)
                    own = slice(*np.searchsorted(doc, [low, high]))
                    d, t, g = doc[own] - low, term[own], gain[own].astype(float)
                    wide = np.zeros((high - low, len(block.holds)))
                    wide[d[common[t]], place[t[common[t]]]] = g[common[t]]
                    scores = wide @ block.holds
                    d, t, g = d[~common[t]], t[~common[t]], g[~common[t]]
                    each = np.repeat(np.arange(len(t)), many[t])
                    item = block.items[np.arange(len(each)) - np.repeat(np.cumsum(many[t]) - many[t], many[t]) + block.start[t][each]]
                    scores += np.bincount(d[each] * block.n + item, weights=g[each], minlength=scores.size).reshape(scores.shape)
                    best.add(scores, numbers[low:high], nulls[low:high])
        best.settle()
        item, score, null, doc_id = best.held
        columns = [pa.array(item), pa.array(doc_id, mask=null.astype(bool)), pa.array(score)]
        yield pa.RecordBatch.from_arrays(columns, names=["at", "doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "at long, doc_id long, score long")


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 50, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` highest-scoring documents with a score above 0."""
    spark = docs.sparkSession
    queries = item_blocks(items, block)
    out = None
    for b in sorted(r["_block"] for r in queries.select("_block").distinct().collect()):
        rows = queries.filter(F.col("_block") == b).orderBy("_item").toArrow()
        sent = spark.sparkContext.broadcast(Items.of(rows["terms"].to_pylist()))
        n_docs, n_terms, df = statistics(docs, sent)
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        numbers = spark.createDataFrame(pa.table({"at": pa.array(np.arange(rows.num_rows)), "_item": rows["_item"], "item_id": rows["item_id"]}))
        found = _scored(docs, sent, weight, n_docs, n_terms, k).join(F.broadcast(numbers), "at").drop("at")
        out = found if out is None else out.unionByName(found)
    if out is None:
        kind = items.schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    order = Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
