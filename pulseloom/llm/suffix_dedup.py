"""Removal of repeated passages: bytes covered by a string of ``length`` bytes that also starts earlier.

"Earlier" is a smaller doc_id, or the same document and an earlier start; what counts is the input, not what is left.

1. Every window of ``length`` bytes names an anchor: the position in it whose 32-byte hash is least (the leftmost).
   Equal windows name the same anchor at the same offset, so only anchors with equal hashes need to meet: about 3
   positions in 100 instead of all. A run of windows with one anchor is one record with two hashes of all its bytes.
2. Records meet by the anchor's hash. A record equal to an earlier one as a whole, by two hashes of 64 bits of different
   kinds (a polynomial and XXH3), is repeated altogether. Where equal anchors have different surroundings, the first record of each
   kind asks for its bytes.
3. Those records' suffixes from the anchor are sorted by a merge sort whose comparisons take a logarithmic number of
   steps: the common extension of two suffixes is found by binary search over prefix polynomial hashes. At depth d the
   sorted order falls into blocks that share d bytes to the right; with an equal hash of o bytes to the left, d + o =
   ``length``, two windows are equal. Extensions found are verified byte by byte.

Tasks resolve what repeats inside their own run of documents before the shuffle, so the inside of a passage that a third of
all documents hold sends one record per run of about 2 MB. Its edges differ from document to document. An anchor with
very many surroundings (``HOT_RUN`` in one run or ``HOT`` in all) is therefore not gathered: its windows go each to the
place of their own hash, again after each task has resolved its own, and no task gets more than one of a kind per batch.

Nulls: a null text is empty and keeps nothing; a null id comes before all others. Rows with the same id, or without one, are
documents of their own and not earlier than each other; a row is known by its id and 64 bits of its text's hash, so rows
equal in both share one result, and a batch works on one of them. Extra columns are only read if named in ``rest``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import keep
from .text import Prefix, data_of, hashes, mix, parts

ANCHOR = 32
#: Kinds of surroundings of one anchor, in a run of documents and in all, beyond which its windows are hashed one by one.
HOT_RUN = 24
HOT = 4096
#: ``low`` of a record that only says that its anchor is hot.
MARK = 255
SLICE = 2 << 20
_LOW = np.uint64((1 << 24) - 1)
RECORD = np.dtype([("g", "u8"), ("c", "u8"), ("c2", "u8"), ("doc", "i8"), ("th", "i8"), ("p", "i8"), ("high", "u1"), ("low", "u1")])
#: Bytes of these columns that a block carries.
WIDTH = {"g": 6, "p": 4}
#: Columns that are packed as differences.
STEPS = ("doc", "th")


def _runs(data: np.ndarray, places: np.ndarray, length: int) -> pd.DataFrame:
    """The runs of windows that share an anchor in texts end to end: text, start of the first window, offsets, hashes.

    ``high`` and ``low`` are the anchor's offsets in the first and in the last window of the run.
    """
    n = len(data) - length + 1
    names = ["text", "p", "high", "low", "g", "c", "c2"]
    if n <= 0:
        return pd.DataFrame({k: np.zeros(0, np.int64) for k in names})
    prefix = Prefix(data)
    at = np.arange(len(data) - ANCHOR + 1)
    g = mix(prefix.hash(at, at + ANCHOR))
    least = (g & ~_LOW) | at.astype(np.uint64)
    span, width = length - ANCHOR + 1, 1
    while width < span:  # least over a growing stretch
        step = min(width, span - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    anchor = (least[:n] & _LOW).astype(np.int64)
    valid = np.ones(n, bool)  # windows that cross into the next text are none
    for k in places[1:-1]:
        valid[max(0, k - length + 1) : k] = False
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | ~valid[:-1]]) & valid
    first = np.flatnonzero(new)
    stop = np.flatnonzero(np.concatenate([(anchor[1:] != anchor[:-1]) | ~valid[1:], [True]]) & valid)
    a = anchor[first]
    text = np.searchsorted(places, first, "right") - 1
    shape = mix((((a - first) << 8) | (stop - first)).astype(np.uint64))
    whole, second = mix(prefix.hash(first, stop + length) ^ shape), hashes(data, first, stop + length) ^ shape
    return pd.DataFrame({"text": text, "p": first - places[text], "high": a - first, "low": a - stop, "g": g[a], "c": whole, "c2": second})


def _slices(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, pd.DataFrame]]:
    """Rows of the batch and runs of their windows; a very long text comes in slices that overlap by a window."""
    for a, b in parts(batch, most=SLICE):
        data, places = data_of(batch["text"].slice(a, b - a))
        if len(data) <= 2 * SLICE:
            yield np.arange(a, b), _runs(data, places, length)
        else:
            for x in range(0, len(data), SLICE):
                part = data[x : x + SLICE + length - 1]
                runs = _runs(part, np.array([0, len(part)]), length)
                runs["p"] += x
                yield np.arange(a, b), runs


def _repeats(key: list[np.ndarray], doc: np.ndarray, th: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, document and place; where a key begins; and which entries have an equal one earlier."""
    order = np.lexsort((p, th, doc, *reversed(key)))
    same = np.ones(max(0, len(order) - 1), bool)
    for k in key:
        same &= k[order][1:] == k[order][:-1]
    new = np.concatenate([[True], ~same]) if len(order) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(order) else np.zeros(0, np.int64)
    d, t, q = doc[order], th[order], p[order]
    own = np.concatenate([[True], ~same | (d[1:] != d[:-1]) | (t[1:] != t[:-1])]) if len(order) else new
    begin = np.maximum.accumulate(np.where(own, np.arange(len(order)), 0)) if len(order) else first
    return order, new, (d > d[first]) | (q > q[begin])


SPANS = "kind int, doc long, th long, p long, high int, low int"


def _spans(kind: int, doc: np.ndarray, th: np.ndarray, p: np.ndarray, high: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
    ints = [pa.array(np.asarray(x).astype(np.int32)) for x in (high, low)]
    longs = [pa.array(np.asarray(x).astype(np.int64)) for x in (doc, th, p)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, np.int32)), *longs, *ints], names=["kind", "doc", "th", "p", "high", "low"])


def _once(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with one of its rows equal in id and text, which have one result."""
    keys = pd.DataFrame({k: np.asarray(batch[k], np.int64) for k in ("doc", "th")})
    again = keys.duplicated().to_numpy()
    return batch.filter(pa.array(~again)) if again.any() else batch


def anchor_records(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """bucket, block: packed records by anchor hash.

    Odd buckets below 0 hold spans that repeat inside this run of documents, even ones those of anchors that are hot here;
    a hot anchor sends a mark to its bucket instead.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(_once, batches):
            doc, th = np.asarray(batch["doc"], np.int64), np.asarray(batch["th"], np.int64)
            for rows, runs in _slices(batch, length):
                if not len(runs):
                    continue
                r = np.zeros(len(runs), RECORD)
                text = rows[runs["text"].to_numpy()]
                r["doc"], r["th"] = doc[text], th[text]
                for k in ("g", "c", "c2", "p", "high", "low"):
                    r[k] = runs[k]
                order, _, again = _repeats([r["g"], r["c"], r["c2"]], r["doc"], r["th"], r["p"])
                out: list[tuple[int, bytes]] = []
                inside = r[order[again]]
                first = r[np.sort(order[~again])]
                g, at, many = np.unique(first["g"], return_inverse=True, return_counts=True)
                hot = many[at] >= HOT_RUN
                for records, code in ((inside, 1), (first[hot], 2)):
                    if len(records):
                        out.append((-code - 2 * int(mix(records["g"][:1])[0] % np.uint64(buckets)), _pack(records)))
                marks = np.zeros(int((many >= HOT_RUN).sum()), RECORD)
                marks["g"], marks["low"] = g[many >= HOT_RUN], MARK
                first = np.concatenate([first[~hot], marks])
                bucket = (first["g"] >> np.uint64(20)) % np.uint64(buckets)
                by = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[by], np.arange(buckets + 1, dtype=np.uint64))
                out += [(k, _pack(first[by[cuts[k] : cuts[k + 1]]])) for k in range(buckets) if cuts[k] < cuts[k + 1]]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["bucket", "block"])

    return docs.select("doc", "th", "text").mapInArrow(run, "bucket int, block binary")


def _pack(records: np.ndarray) -> bytes:
    """Columns one after another, ids as differences, 48 bits of the anchor's hash, compressed."""
    import zstandard

    out = [len(records).to_bytes(8, "little")]
    for k in RECORD.names:
        column = np.ascontiguousarray(np.diff(records[k], prepend=0) if k in STEPS else records[k])
        out.append(column.view(np.uint8).reshape(len(records), -1)[:, : WIDTH.get(k)].tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _unpack(block: bytes) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(block)
    n, at = int.from_bytes(raw[:8], "little"), 8
    out = np.zeros(n, RECORD)
    for k in RECORD.names:
        wide = WIDTH.get(k, RECORD[k].itemsize)
        column = np.frombuffer(raw, np.uint8, n * wide, at).reshape(n, wide)
        at += n * wide
        whole = np.zeros((n, RECORD[k].itemsize), np.uint8)
        whole[:, :wide] = column
        column = whole.view(RECORD[k]).ravel()
        out[k] = np.cumsum(column) if k in STEPS else column
    return out


def meet(blocks: DataFrame, parts_: int) -> DataFrame:
    """Spans of kind 0 (repeated), kind 1 (the first of its kind, but other records share its anchor) and kind 2 (so, and hot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for bucket, block in zip(batch["bucket"].to_pylist(), batch["block"].to_pylist()):
                r = _unpack(block)
                if bucket >= 0:
                    held.append(r)
                else:
                    yield _spans(0 if bucket % 2 else 2, r["doc"], r["th"], r["p"], r["high"], r["low"])
        if not held:
            return
        r = np.concatenate(held)
        held.clear()
        marked = np.unique(r["g"][r["low"] == MARK])
        g, many = np.unique(r["g"], return_counts=True)
        r = r[(many > 1)[np.searchsorted(g, r["g"])] & (r["low"] != MARK)]
        order, new, again = _repeats([r["g"], r["c"], r["c2"]], r["doc"], r["th"], r["p"])
        r = r[order]
        d = r[again]
        yield _spans(0, d["doc"], d["th"], d["p"], d["high"], d["low"])
        # kinds of surroundings per anchor
        g = r["g"]
        start = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
        group = np.cumsum(start) - 1
        kinds = np.bincount(group, weights=new) if len(g) else np.zeros(0)
        hot = (kinds[group] > HOT) | np.isin(g, marked) if len(g) else np.zeros(0, bool)
        ask = ~again & (hot | (kinds[group] > 1)) if len(g) else np.zeros(0, bool)
        for kind, d in ((1, r[ask & ~hot]), (2, r[ask & hot])):
            yield _spans(kind, d["doc"], d["th"], d["p"], d["high"], d["low"])

    return blocks.repartition(parts_, "bucket").mapInArrow(run, SPANS)


class Suffixes:
    """Suffixes of a byte array, each ending at its own end, compared through prefix hashes."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.data, self.start, self.end, self.prefix = data, start, end, Prefix(data)
        self.wrong = False

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes x and y, by binary search."""
        sx, sy = self.start[x], self.start[y]
        low = np.zeros(len(x), np.int64)
        high = np.minimum(self.end[x] - sx, self.end[y] - sy)
        while (open_ := low < high).any():
            middle = (low + high + 1) >> 1
            equal = self.prefix.hash(sx, sx + middle) == self.prefix.hash(sy, sy + middle)
            low = np.where(open_ & equal, middle, low)
            high = np.where(open_ & ~equal, middle - 1, high)
        return low

    def less(self, x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix x sorts before y; ``ties`` is the answer for equal ones. A prefix sorts first."""
        n = self.common(x, y)
        ex, ey = self.start[x] + n == self.end[x], self.start[y] + n == self.end[y]
        last = len(self.data) - 1
        bx, by = self.data[np.minimum(self.start[x] + n, last)], self.data[np.minimum(self.start[y] + n, last)]
        return np.where(ex & ey, ties, np.where(ex, True, np.where(ey, False, bx < by)))

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Merge sort inside each group (ascending numbers): runs double, and each suffix finds its rank in its sibling run.

        All merges of one level go on at once; groups that are done drop out.
        """
        order = np.arange(len(group))
        first = np.searchsorted(group, group, "left")
        stop = np.searchsorted(group, group, "right")
        width = 1
        while width < (stop - first).max(initial=0):
            place = np.flatnonzero(stop - first > width)
            f, s = first[place], stop[place]
            run = (place - f) // width
            left = run % 2 == 0
            pair = f + (run - run % 2) * width
            low = np.where(left, np.minimum(pair + width, s), pair)
            high = np.where(left, np.minimum(pair + 2 * width, s), np.minimum(pair + width, s))
            own, begin = order[place], low.copy()
            while (open_ := low < high).any():
                i = np.flatnonzero(open_)
                middle = (low[i] + high[i]) >> 1
                # a left suffix counts smaller ones at its right, a right one those at its left that aren't larger
                before = self.less(order[middle], own[i], ~left[i])
                low[i] = np.where(before, middle + 1, low[i])
                high[i] = np.where(before, high[i], middle)
            target = place - np.where(left, 0, width) + (low - begin)
            order[target] = own
            width *= 2
        return order

    def verified(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the first n bytes of suffixes x and y are equal, byte by byte."""
        step = np.arange(max(n.max(initial=0), 1))
        inside = step[None, :] < n[:, None]
        last = len(self.data) - 1
        a = self.data[np.minimum(self.start[x][:, None] + step, last)]
        b = self.data[np.minimum(self.start[y][:, None] + step, last)]
        return ((a == b) | ~inside).all(axis=1)


def repeated_windows(g: np.ndarray, doc: np.ndarray, th: np.ndarray, p: np.ndarray, high: np.ndarray, low: np.ndarray, text: list[bytes], length: int) -> pa.RecordBatch:
    """Spans (kind 0) of the windows of these records (ordered by g) that have an equal window earlier among them."""
    data = np.frombuffer(b"".join(text), np.uint8)
    ends = np.cumsum([len(x) for x in text])
    begins = ends - np.array([len(x) for x in text])
    anchor = begins + high
    suffixes = Suffixes(data, anchor, ends)
    order = suffixes.sort(g)
    common = np.zeros(len(order), np.int64)  # with the suffix before
    common[1:] = np.where(g[order][1:] == g[order][:-1], suffixes.common(order[:-1], order[1:]), 0)
    sound = [suffixes.verified(order[i : i + 4096][:-1], order[i : i + 4096][1:], common[i + 1 : i + 4096]).all() for i in range(0, len(order), 4095)]
    hit = np.zeros((len(order), length - ANCHOR + 1), bool)
    for o in range(hit.shape[1]):
        block = np.cumsum(common < length - o)
        use = np.flatnonzero((low[order] <= o) & (o <= high[order]))
        if len(use) < 2:
            continue
        r = order[use]
        left = suffixes.prefix.hash(anchor[r] - o, anchor[r])
        by, new, again = _repeats([block[use], left], doc[r], th[r], p[r] + high[r] - o)
        if not again.any():
            continue
        one = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))][again]
        other = by[again]
        if o:
            back = np.arange(1, o + 1)
            for i in range(0, len(one), 65_536):
                same = data[anchor[r[one[i : i + 65_536]]][:, None] - back] == data[anchor[r[other[i : i + 65_536]]][:, None] - back]
                sound.append(bool(same.all()))
        hit[r[other], o] = True
    if not all(sound):  # a hash collision: decide by the bytes themselves
        hit[:] = False
        i, o = np.nonzero((low[:, None] <= np.arange(hit.shape[1])) & (np.arange(hit.shape[1]) <= high[:, None]))
        names = {}
        key = np.array([names.setdefault(data[anchor[a] - b : anchor[a] - b + length].tobytes(), len(names)) for a, b in zip(i, o)])
        by, _, again = _repeats([key], doc[i], th[i], p[i] + high[i] - o)
        hit[i[by[again]], o[by[again]]] = True
    # runs of offsets: a larger offset is an earlier window
    edge = np.zeros((len(order), hit.shape[1] + 2), bool)
    edge[:, 1:-1] = hit
    i, upper = np.nonzero(edge[:, 1:-1] & ~edge[:, 2:])
    _, lower = np.nonzero(edge[:, 1:-1] & ~edge[:, :-2])
    return _spans(0, doc[i], th[i], p[i] + high[i] - upper, upper, lower)


CONTEXT = "kind int, key long, other long, doc long, th long, p long, high int, low int, bytes binary"
_NAMES = ["kind", "key", "other", "doc", "th", "p", "high", "low", "bytes"]


def _contexts(kind: int, key: np.ndarray, other: np.ndarray | None, *columns, text: list[bytes] | None = None) -> pa.RecordBatch:
    n = len(key)
    longs = [pa.array(np.asarray(c, np.int64)) for c in columns[:3]]
    ints = [pa.array(np.asarray(c, np.int32)) for c in columns[3:]]
    second = pa.nulls(n, pa.int64()) if other is None else pa.array(other)
    content = pa.nulls(n, pa.binary()) if text is None else pa.array(text, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(key), second, *longs, *ints, content], names=_NAMES)


def contexts(asked: DataFrame, length: int) -> DataFrame:
    """From (doc, th, text, spans): kind 1, the bytes of a record by its anchor's hash; kind 2, a window of a hot anchor by
    two hashes of its own; kind 0, windows that repeat inside this batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(_once, batches):
            out: dict[int, list[tuple]] = {1: [], 2: []}
            for doc, th, text, spans in zip(batch["doc"].to_pylist(), batch["th"].to_pylist(), batch["text"], batch["spans"].to_pylist()):
                raw = text.as_py().encode()
                for s in spans:
                    out[s["kind"]].append((doc, th, s["p"], s["high"], s["low"], raw[s["p"] : s["p"] + s["high"] - s["low"] + length]))
            for kind, found in out.items():
                if not found:
                    continue
                *numbers, text = zip(*found)
                doc, th, p, high, low = (np.array(c, np.int64) for c in numbers)
                begin = np.cumsum([0] + [len(x) for x in text])[:-1]
                data = np.frombuffer(b"".join(text), np.uint8)
                if kind == 1:
                    at = begin + high
                    yield _contexts(1, mix(Prefix(data).hash(at, at + ANCHOR)).view(np.int64), None, doc, th, p, high, low, text=list(text))
                    continue
                many = high - low + 1
                row = np.repeat(np.arange(len(many)), many)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                at = begin[row] + nth
                w1 = mix(Prefix(data).hash(at, at + length)).view(np.int64)
                w2 = hashes(data, at, at + length).view(np.int64)
                doc, th, p = doc[row], th[row], p[row] + nth
                by, _, again = _repeats([w1, w2], doc, th, p)
                i, zero = np.sort(by[~again]), np.zeros(len(row), np.int32)
                yield _contexts(2, w1[i], w2[i], doc[i], th[i], p[i], zero[i], zero[i])
                yield _contexts(0, *_joined(doc[by[again]], th[by[again]], p[by[again]]))

    return asked.mapInArrow(run, CONTEXT)


def _joined(doc: np.ndarray, th: np.ndarray, p: np.ndarray) -> tuple:
    """Neighbouring windows as spans: a key to deal them out by, nothing, doc, th, p, high, low."""
    order = np.lexsort((p, th, doc))
    doc, th, p = doc[order], th[order], p[order]
    new = np.ones(len(p), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (p[1:] > p[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1 if len(first) else first
    key = mix(doc[first].astype(np.uint64) + p[first].astype(np.uint64)).view(np.int64)
    return key, None, doc[first], th[first], p[first], p[last] - p[first], np.zeros(len(first), np.int64)


def compare(rows: DataFrame, parts_: int, length: int) -> DataFrame:
    """Spans of kind 0 from contexts; a partition is worked off in runs of whole groups."""

    def solve(kind: int, t: pa.Table) -> pa.RecordBatch:
        doc, th, p, high, low = (np.asarray(t[k], np.int64) for k in ("doc", "th", "p", "high", "low"))
        if kind == 0:
            return _spans(0, doc, th, p, high, low)
        if kind == 1:
            return repeated_windows(np.asarray(t["key"]), doc, th, p, high, low, t["bytes"].to_pylist(), length)
        by, _, again = _repeats([np.asarray(t["key"]), np.asarray(t["other"])], doc, th, p)
        i = by[again]
        return _spans(0, *_joined(doc[i], th[i], p[i])[2:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = None, None
        for batch in batches:
            kinds = np.asarray(batch["kind"])
            for kind in np.unique(kinds):
                t = pa.Table.from_batches([batch.slice(int(np.searchsorted(kinds, kind)), int((kinds == kind).sum()))])
                if at is not None and kind != at:
                    yield solve(at, held)
                    held = None
                held, at = t if held is None else pa.concat_tables([held, t]), int(kind)
                key = np.asarray(held["key"])
                cut = int(np.searchsorted(key, key[-1]))
                if cut >= 5000:
                    yield solve(at, held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield solve(at, held)

    return rows.repartition(parts_, "key").sortWithinPartitions("kind", "key").mapInArrow(run, SPANS)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by [start, end) spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def suffix_dedup(docs: DataFrame, length: int = 100, rest: tuple[str, ...] = (), form: str = "bytes") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (array of start and end, in bytes of the input), kept, and ``rest``.

    ``kept`` holds the remaining bytes; with the form "digest" their SHA-256, with "text" those that make whole
    characters.
    """
    spark = docs.sparkSession
    parts_ = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    named = docs.select(
        F.coalesce("doc_id", F.lit(-(2**63))).alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"), "doc_id", F.struct(F.lit(0).alias("_"), *rest).alias("rest")
    )
    spans = keep(meet(anchor_records(named, length, 2 * parts_), parts_))
    gather = lambda df, name: df.groupBy("doc", "th").agg(F.collect_set(F.struct("kind", "p", "high", "low")).alias(name))
    # both joins ask for all columns of the texts, so that Spark shuffles these once and reads them twice
    asked = named.join(gather(spans.filter("kind > 0"), "spans"), ["doc", "th"])
    more = compare(contexts(asked, length), parts_, length)
    gone = gather(spans.filter("kind = 0").unionByName(more), "spans")
    whole = named.join(gone, ["doc", "th"], "left")
    output = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:bigint,end:bigint>>, kept binary"

    def finish(text: str, spans: list[dict] | None) -> tuple[int, int, list[dict], bytes]:
        raw = text.encode()
        gone = merged([(s["p"], s["p"] + s["high"] - s["low"] + length) for s in spans or []])
        left, at = [], 0
        for a, b in gone:
            left.append(raw[at:a])
            at = b
        left = b"".join([*left, raw[at:]])
        removed = len(raw) - len(left)
        if form == "digest":
            left = hashlib.sha256(left).digest()
        elif form == "text":
            left = left.decode("utf-8", "ignore").encode()
        return len(raw), removed, [{"start": a, "end": b} for a, b in gone], left

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            size, removed, gone, left = zip(*[finish(t.as_py(), x.as_py()) for t, x in zip(batch["text"], batch["spans"])]) if batch.num_rows else ([],) * 4
            longs = [pa.array(v, pa.int64()) for v in (size, removed, [len(x) for x in gone])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *longs, pa.array(gone, ends), pa.array(left, pa.binary()), batch["rest"]], names=[*names, "rest"])

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"]
    rest_type = named.schema["rest"].dataType.simpleString()
    return whole.mapInArrow(cut, f"{output}, rest {rest_type}").select(*names, *[F.col(f"rest.{c}").alias(c) for c in rest])


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """The documents, all columns, without their repeated bytes; a character that loses a byte goes as a whole."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *others).alias("_others"))
    rows = suffix_dedup(packed, length, ("_others",), "text")
    back = rows.select("doc_id", F.col("kept").cast("string").alias("text"), *[F.col(f"_others.`{c}`").alias(c) for c in others])
    return back.select(*docs.columns)
