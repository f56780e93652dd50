"""Token counts of documents from the piece counts of distinct pre-tokens; no ids are made for a document.

A tokenizer's normaliser and splitting pattern cut a text into pre-tokens, and its merges work inside one. So a text has as
many tokens as its pre-tokens have pieces. Three passes:

1. The distinct pre-tokens with their occurrences: tasks count ahead, then they are grouped.
2. The tokenizer's model counts the pieces of each distinct pre-token once; that table is written.
3. Every document's pre-token frequencies meet the table. The ``most`` most frequent pre-tokens are broadcast, whatever the
   corpus; the rarer ones of a document leave its task as (pre-token, frequency) and meet the table in a join, in which no
   key has more than one ``most``-th part of all occurrences.

Words: with ``by_words`` (a tokenizer that drops white space, so that no pre-token reaches over it) texts are first cut at
ASCII white space and each distinct word of a batch is normalised and split once. Without it whole texts are split.

Added tokens of the file stand for themselves wherever a text holds them, as the library reads them by default.

Nulls: a null text is empty and has no tokens; a null or repeated id is a row of its own. An empty table gives no rows.
Further columns are left out, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import keep
from .text import data_of, parts, words_of

#: Pre-tokens in the broadcast table at most; about 100 bytes each in a worker.
MOST = 300_000
#: Distinct words and pre-tokens that a task holds before it lets them go.
HELD = 150_000


#: The pattern of tokenizers that drop white space and lower the case, and what it does to words of printable ASCII characters.
LOWER_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ascii_word = re.compile(r"[!-~]+")
_ascii_parts = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


class Splitter:
    """The pre-tokens of words, and the number of pieces of a pre-token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        added = content.get("added_tokens", [])
        if any(x["normalized"] or x["single_word"] for x in added):
            raise ValueError("added tokens that are found in normalised text or as single words aren't supported")
        self.added = {x["content"] for x in added}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if added else None
        steps = (content.get("normalizer") or {}).get("normalizers", [])
        split, *rest = (content.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.lower = [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and split.get("pattern") == {"Regex": LOWER_PATTERN} and [x["type"] for x in rest] == ["ByteLevel"]

    def plain(self, text: str) -> list[str]:
        normal = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)] if normal else []

    def pretokens(self, text: str) -> list[str]:
        if self.cut is None or not (found := list(self.cut.finditer(text))):
            return self.plain(text)
        out, at = [], 0
        for m in found:
            out += [*self.plain(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self.plain(text[at:])

    def of_words(self, words: list[bytes]) -> list[list[str]]:
        """The pre-tokens of each word. Words of a known tokenizer's kind are split many at a time, the others one by one.

        Those joined by spaces must come out of the normaliser with as many spaces as went in; where any brings white space of
        its own, all are split one by one.
        """
        text = [w.decode("utf-8") for w in words]
        if not self.lower:
            return [self.pretokens(t) for t in text]
        out: list[list[str] | None] = [_ascii_parts.findall(t.lower()) if _ascii_word.fullmatch(t) and not (self.cut and self.cut.search(t)) else None for t in text]
        left = [i for i, x in enumerate(out) if x is None]
        joined = [i for i in left if not (self.cut and self.cut.search(text[i])) and len(text[i].split()) == 1]
        normal = self.tokenizer.normalizer.normalize_str(" ".join(text[i] for i in joined))
        space = np.flatnonzero(np.array(list(normal)) == " ")
        if joined and len(space) == len(joined) - 1:
            found = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)
            for i in joined:
                out[i] = []
            for (p, _), k in zip(found, np.searchsorted(space, np.array([a for _, (a, _) in found], np.int64)).tolist()):
                out[joined[k]].append(p)
        return [self.pretokens(t) if x is None else x for t, x in zip(text, out)]

    def pieces(self, pretoken: str) -> int:
        return 1 if pretoken in self.added else len(self.tokenizer.model.tokenize(pretoken))


def _units(batch: pa.RecordBatch, by_words: bool) -> Iterator[tuple[int, int, list[bytes], np.ndarray, np.ndarray]]:
    """For runs of rows [a, b): the distinct words, which of them stands at each place, the text of each place."""
    for a, b in parts(batch, most=8 << 20):
        data, places = data_of(batch["text"].slice(a, b - a))
        if by_words:
            start, end, at = words_of(data, places)
            inside = np.zeros(len(data) + 1, np.int8)
            inside[start] = 1
            inside[end] -= 1
            flat, text = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)], np.repeat(np.arange(b - a), np.diff(at))
            offsets = np.append(0, np.cumsum(end - start))
        else:
            flat, offsets, text = np.ascontiguousarray(data), places, np.arange(b - a)
        words = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat)])
        kinds = words.dictionary_encode()
        raw, edge = data_of(kinds.dictionary)
        raw, edge = raw.tobytes(), edge.tolist()
        yield a, b, [raw[i:j] for i, j in zip(edge, edge[1:])], np.asarray(kinds.indices), text


def pretoken_counts(docs: DataFrame, path: str, by_words: bool = True) -> DataFrame:
    """pretoken, n: occurrences in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, total, words = Splitter(path), Counter(), Counter()

        def settle() -> None:
            for pretokens, n in zip(splitter.of_words(list(words)), words.values()):
                for p in pretokens:
                    total[p] += n
            words.clear()

        def flush() -> pa.RecordBatch:
            settle()
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["pretoken", "n"])
            total.clear()
            return out

        for batch in batches:
            for _, _, kinds, at, _ in _units(batch, by_words):
                for word, n in zip(kinds, np.bincount(at, minlength=len(kinds)).tolist()):
                    words[word] += n
                if len(words) > HELD:
                    settle()
                if len(total) > HELD:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))


def piece_counts(pretokens: DataFrame, path: str) -> DataFrame:
    """pretoken, n, pieces: each distinct pre-token goes through the merges once. Kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(path)
        for b in batches:
            pieces = pa.array([splitter.pieces(p) for p in b["pretoken"].to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b["pretoken"], b["n"], pieces], names=["pretoken", "n", "pieces"])

    return keep(pretokens.mapInArrow(run, "pretoken string, n long, pieces long"))


def _frequent(table: DataFrame, most: int) -> pa.Table:
    """pretoken, pieces of the most frequent ones, ``most`` at most, by fine steps of occurrences."""
    step = F.floor(F.log2("n") * 64)
    total, low = 0, 2**40
    for r in table.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        if (total := total + r["count"]) > most:
            break
        low = r["step"]
    return table.filter(step >= low).select("pretoken", "pieces").toArrow()


def _lookup(splitter: Splitter, known: dict[str, int]) -> Callable[[list[bytes]], list[tuple[int, tuple[str, ...]]]]:
    """Each word's pieces in known pre-tokens, and its other pre-tokens; words are remembered."""
    seen: dict[bytes, tuple[int, tuple[str, ...]]] = {}

    def look(words: list[bytes]) -> list[tuple[int, tuple[str, ...]]]:
        if len(seen) >= HELD:
            seen.clear()
        new = [w for w in words if w not in seen]
        for word, pretokens in zip(new, splitter.of_words(new)):
            seen[word] = sum(known.get(p, 0) for p in pretokens), tuple(p for p in pretokens if p not in known)
        return [seen[w] for w in words]

    return look


def token_counts(docs: DataFrame, path: str, by_words: bool = True, most: int = MOST) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens of every document, by the tokenizer file ``path``."""
    table = piece_counts(pretoken_counts(docs, path, by_words), path)
    sink = pa.BufferOutputStream()
    frequent = _frequent(table, most)
    with pa.ipc.new_stream(sink, frequent.schema) as writer:
        writer.write_table(frequent)
    sent = docs.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_table = pa.ipc.open_stream(sent.value).read_all()
        look = _lookup(Splitter(path), dict(zip(known_table["pretoken"].to_pylist(), known_table["pieces"].to_pylist())))
        for batch in batches:
            for a, b, kinds, at, text in _units(batch, by_words):
                found = look(kinds)
                tokens = np.zeros(b - a, np.int64)
                np.add.at(tokens, text, np.array([n for n, _ in found], np.int64)[at])
                others = np.array([len(x) for _, x in found], np.int64)
                pair, times = np.unique(text[places := np.flatnonzero(others[at])] * len(kinds) + at[places], return_counts=True)
                doc, kind = pair // max(1, len(kinds)), pair % max(1, len(kinds))
                rare = pa.StructArray.from_arrays([pa.array([p for k in kind.tolist() for p in found[k][1]], pa.string()), pa.array(np.repeat(times, others[kind]).astype(np.int64))], names=["pretoken", "times"])
                ends = np.append(0, np.cumsum(np.bincount(doc, weights=others[kind], minlength=b - a).astype(np.int64)))
                size = data_of(batch["text"].slice(a, b - a))[1]
                entries = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), rare)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), pa.array(np.diff(size).astype(np.int64)), pa.array(tokens), entries], names=["doc_id", "n_bytes", "n_known", "rare"])

    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_known long, rare array<struct<pretoken:string,times:long>>")
    rows = keep(rows.withColumn("_row", F.monotonically_increasing_id()))
    asked = rows.filter(F.size("rare") > 0).select("_row", F.inline("rare"))
    sums = asked.join(table.select("pretoken", "pieces"), "pretoken").groupBy("_row").agg(F.sum(F.col("times") * F.col("pieces")).alias("n_rare"))
    return rows.join(sums, "_row", "left").select("doc_id", "n_bytes", (F.col("n_known") + F.coalesce("n_rare", F.lit(0))).alias("n_tokens"))
