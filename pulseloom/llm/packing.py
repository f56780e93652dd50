"""Best-fit packing of token pieces into sequences, after Martello and Toth's dominance reduction.

A piece's length is all that packing looks at, and lengths are at most the capacity. So the instance is a table of
(length, count): however large the corpus, it has no more rows than the capacity. The driver packs that table into
patterns with multiplicities; the pieces are numbered inside their length class and look up their place.

Nulls: a null text is empty and is one piece that holds the end token alone. Repeated rows are pieces of their own.
"""

from __future__ import annotations

import base64
import bisect
import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import running_total
from ..functions.shared import keep

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def byte_ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Token bytes and ids of a byte-level BPE vocabulary file (a ``tokenizers`` JSON file, or lines of base64 and rank), and its added tokens.

    JSON files write byte b as a printable character: itself where it is one, else the next from 256 up.
    """
    if not path.endswith(".json"):
        with open(path, "rb") as lines:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, {}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}
    with open(path, encoding="utf-8") as f:
        content = json.load(f)
    added = {x["content"]: x["id"] for x in content.get("added_tokens", [])}
    return {bytes(back[c] for c in token): i for token, i in content["model"]["vocab"].items() if token not in added}, added


class Encoder:
    """Token ids as little-endian bytes. Remembers the ids of stretches between single spaces, the frequent ones longest.

    A piece of the split pattern never reaches over a space that stands between two other characters, so such
    stretches can be encoded alone. A text with any other space is encoded as a whole, and so is one that holds an added
    token of the file: it is that token wherever it stands, as the ``tokenizers`` library reads it unless told otherwise.
    """

    def __init__(self, path: str, pattern: str, memory: int = 120_000):
        import tiktoken

        ranks, self.added = byte_ranks(path)
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.added)
        self.encode, self.encode_added = encoding.encode_ordinary, encoding.encode
        self.new, self.old, self.memory = {}, {}, memory

    def whole(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes()

    def fetch(self, stretch: str) -> bytes | None:
        if not stretch or stretch[0].isspace() or stretch[-1].isspace():
            return None
        ids = self.old.get(stretch)
        if ids is None:
            ids = self.whole(" " + stretch)
            if len(stretch) > 64:
                return ids
        self.new[stretch] = ids
        if len(self.new) >= self.memory:
            self.old, self.new = self.new, {}
        return ids

    def ids(self, text: str) -> bytes:
        if any(x in text for x in self.added):
            return np.array(self.encode_added(text, allowed_special="all"), "<u4").tobytes()
        first, *rest = text.split(" ")
        if not rest:
            return self.whole(text)
        if not first or first[-1].isspace():
            return self.whole(text)
        out = [self.whole(first)]
        for x in rest:
            if (ids := self.new.get(x)) is None and (ids := self.fetch(x)) is None:
                return self.whole(text)
            out.append(ids)
        return b"".join(out)


def cut_pieces(docs: DataFrame, path: str, pattern: str, capacity: int = 1024, end: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: a longer document is cut from its end, so only its first piece is short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = Encoder(path, pattern), np.array([end], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ids = memoryview(encoder.ids(text.as_py() or "") + last)
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                out += [(doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            columns = list(zip(*out)) or [[]] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def _largest(sizes: list[int], most: int) -> int:
    """The largest of the ascending sizes that is at most ``most``; 0 if none is."""
    i = bisect.bisect_right(sizes, most)
    return sizes[i - 1] if i else 0


def _many_exceed(sizes: list[int], room: int, k: int) -> bool:
    """Whether two or more items of these ascending sizes (each as often as wanted) can total over k and up to room."""
    i, j = 0, len(sizes) - 1
    while i <= j:
        if sizes[i] + sizes[j] > room:
            j -= 1
        elif sizes[i] + sizes[j] > k:
            return True
        else:
            i += 1
    mask = (1 << (room + 1)) - 1
    frontier, many = sum(1 << s for s in sizes if s <= room), 0
    while frontier:
        following = 0
        for s in sizes:
            if s > room:
                break
            following |= frontier << s
        frontier = following & mask & ~many
        many |= frontier
    return many.bit_length() - 1 > k


def reduce_dominated(counts: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix bins that some best packing must contain; takes them out of ``counts``. Returns (lengths, how many bins).

    For an item j, the longest first, with room capacity - j beside it:
    - nothing left fits: {j} is a bin;
    - k fills the room exactly: {j, k} dominates every other set with j, for whatever else would lie beside j fits
      where k was;
    - k is the longest that fits and no two or more items together exceed k: {j, k} dominates likewise.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []
    changed = True
    while changed:
        changed = False
        for j in sorted(counts, reverse=True):
            while n := counts[j]:
                counts[j] -= 1
                sizes = sorted(s for s, c in counts.items() if c > 0)
                counts[j] += 1
                k, room = _largest(sizes, capacity - j), capacity - j
                if not k:
                    many = n
                    fixed.append(((j,), many))
                    counts[j] -= many
                elif k == room or not _many_exceed(sizes, room, k):
                    many = n // 2 if j == k else min(n, counts[k])
                    fixed.append(((j, k), many))
                    counts[j] -= many
                    counts[k] -= many
                else:
                    break
                changed = True
    return fixed


def best_fit(counts: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over length classes: bins that look alike are one entry and are filled together."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # room -> bins
    rooms: list[int] = []
    for length in sorted((s for s, c in counts.items() if c > 0), reverse=True):
        left = counts[length]
        while left:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                each = capacity // length
                many = max(1, left // each)
                inside = min(each, left)
                bins, room = (length,) * inside, capacity - length * inside
                left -= many * inside
            else:
                room = rooms[i]
                bins, have = open_bins[room].pop()
                many = min(left, have)
                if have > many:
                    open_bins[room].append((bins, have - many))
                elif not open_bins[room]:
                    del open_bins[room], rooms[i]
                bins, room, left = (*bins, length), room - length, left - many
            if room not in open_bins:
                bisect.insort(rooms, room)
            open_bins.setdefault(room, []).append((bins, many))
    return [x for found in open_bins.values() for x in found]


def place_runs(counts: dict[int, int], capacity: int) -> pd.DataFrame:
    """For each length, runs of ranks [low, high): rank r lies in sequence base + r - low at offset."""
    left = Counter(counts)
    patterns = reduce_dominated(left, capacity)
    patterns += best_fit(left, capacity)
    runs, used, base = [], Counter(), 0
    for lengths, many in patterns:
        offset = 0
        for length in lengths:
            runs.append((length, used[length], used[length] + many, base, offset))
            used[length] += many
            offset += length
        base += many
    return pd.DataFrame(runs, columns=["length", "low", "high", "base", "offset"]).sort_values(["length", "low"], ignore_index=True)


def pack_pieces(cut: DataFrame, capacity: int = 1024) -> DataFrame:
    """Add sequence_id and offset to pieces of at most ``capacity`` tokens (the columns of ``cut_pieces``).

    The counts by length and the runs are the only things that reach the driver; both are bounded by the capacity. Pieces alike in
    everything (empty texts without an id) are dealt out by ``_run``, a number that ``cut`` has besides: the task that wrote them.
    """
    rows = cut.groupBy("length").count().collect()
    runs = place_runs({r["length"]: r["count"] for r in rows}, capacity)
    spark = cut.sparkSession
    many = F.broadcast(spark.createDataFrame([(r["length"], r["count"]) for r in rows], "length long, _many long"))
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "_run"), F.ceil(F.sqrt("_many")))
    ranked = running_total(
        cut.join(many, "length").withColumn("_bucket", bucket), {"_rank": F.lit(1).cast("long")}, "_bucket", ["doc_id", "piece", "ids_crc32"], ["length"]
    ).drop("_bucket", "_many")
    span = int(runs["high"].max()) + 1 if len(runs) else 1
    key = runs["length"].to_numpy(np.int64) * span + runs["low"].to_numpy(np.int64)
    low, base, offset = (runs[c].to_numpy(np.int64) for c in ("low", "base", "offset"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (np.asarray(b[c], np.int64) for c in ("length", "_rank"))
            i = np.searchsorted(key, length * span + rank, "right") - 1
            where = [pa.array(base[i] + rank - low[i], pa.int64()), pa.array(offset[i], pa.int64())]
            yield pa.RecordBatch.from_arrays([b[c] for c in names] + where, names=[*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*names, "_rank").mapInArrow(look_up, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, pattern: str, capacity: int = 1024, end: int = 2) -> DataFrame:
    """Tokenize each document once, keep the pieces (not the ids), and pack them."""
    return pack_pieces(keep(cut_pieces(docs, path, pattern, capacity, end).withColumn("_run", F.spark_partition_id())), capacity)
