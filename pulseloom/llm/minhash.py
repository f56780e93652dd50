"""Near duplicates by DartMinHash signatures, banding, and verified links.

A text is a set of shingles of five words, weighted by how often each occurs. Hashed darts fall on the plane of weight
and rank, about one on each unit cell of each shingle; those under the shingle's weight count. Each dart names one of
``K`` coordinates, and the dart of the least rank is the coordinate's value. Two texts share a coordinate with a
probability of their weighted Jaccard similarity, sum min / sum max. Darts are thrown up to a rank at which about
K (ln K + 3) have fallen on the whole text, whatever its length, and further where a coordinate is still empty.

Texts that share all values of a band are candidates. Texts of equal words, by a cryptographic digest of 128 bits, are collapsed before. Inside a bucket nobody is paired
with everybody: members are compared with the bucket's leaders, the one that meets most other texts and the least id,
which joins nearly all that belongs together. What is left is taken by classes, not by members:

1. A bucket is one row per class. Buckets with one class are done.
2. A class is summed up by its members' shingles in ``BINS`` bins: the most in each bin, the least and the largest
   text. Two classes in a bucket whose bound of the similarity is below the threshold hold no link.
3. The members of the other pairs of classes, each pair once for all its buckets, are bounded two by two in blocks.
4. Of the pairs within the bound each member proposes its best ``FIRST`` in a block, and in each further round 32 times as many; what
   is proposed is compared on whole texts. Links merge classes, so what belongs together is gone after a round or two.

The rounds, three at most, end when every pair of two classes was compared: every link whose texts share a band is found. A
link is kept only if the exact similarity of the whole texts is at least the threshold; classes are the components of
the links.

Nulls: a null text is empty; texts without words are equal to each other. A row without an id goes by a number below
-2^62 made from its text (ids are taken to be above that). Rows with one id are one document if their texts have the same
words; if not, each text counts, and the id is in the class of all of them. Texts of under five words are one shingle.
Repeated rows fall into one class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import keep
from .components import connected
from .text import data_of, mix, parts, word_hashes, words_of

WIDE = 5
K = 128
BANDS = 32
THRESHOLD = 0.8
#: Bits of a text's number inside a batch, of a coordinate, and of a rank (11 of them before the point).
DOC_BITS, COORDINATE_BITS, RANK_BITS = 13, 7, 44
#: Bytes of text worked off at once; a text takes about a hundred times its size in darts and hashes.
AT_ONCE = 1 << 20
#: Bins of a text's summary, members (or classes) that are compared in one block, and pairs each proposes at first.
BINS = 256
BLOCK = 1024
FIRST = 32
#: P(at most n darts on a cell), n = 0, 1, ...; the number of darts is a Poisson variable with mean 1.
_AT_MOST = np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 16)]))
_U = np.uint64


def shingles(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every shingle occurrence."""
    start, end, at = words_of(data, places)
    word = word_hashes(data, start, end)
    many = np.diff(at)
    doc = np.repeat(np.arange(len(many)), many)
    nth = np.arange(len(word)) - np.repeat(at[:-1], many)
    n = max(0, len(word) - WIDE + 1)
    value = np.zeros(n, _U)
    for j in range(WIDE):
        value = mix(value + word[j : j + n])
    inside = nth[:n] + WIDE <= many[doc[:n]]
    short = np.flatnonzero((many > 0) & (many < WIDE))
    brief = np.zeros(len(short), _U)
    for j in range(WIDE - 1):
        more = many[short] > j
        brief[more] = mix(brief[more] + word[at[short[more]] + j] + _U(j + 1))
    return np.concatenate([doc[:n][inside], short]), np.concatenate([value[inside], brief])


def contents(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Two numbers for each text, from a cryptographic digest of its words in order: equal only for equal words."""
    start, end, at = words_of(data, places)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[start] = 1
    inside[end] -= 1
    flat = memoryview(data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)])
    size = np.ascontiguousarray(end - start)
    byte, word, sizes = np.append(0, np.cumsum(size))[at].tolist(), (8 * at).tolist(), memoryview(size.view(np.uint8))
    out = bytearray()
    for i in range(len(places) - 1):
        digest = hashlib.blake2b(flat[byte[i] : byte[i + 1]], digest_size=16)
        digest.update(sizes[word[i] : word[i + 1]])
        out += digest.digest()
    return np.frombuffer(bytes(out), np.int64).reshape(-1, 2)


def weighted(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: text, hash, occurrences."""
    key, count = np.unique((value << _U(DOC_BITS)) | doc.astype(_U), return_counts=True)
    return (key & _U(2**DOC_BITS - 1)).astype(np.int64), key >> _U(DOC_BITS), count


def dart_signatures(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """n texts by K coordinates: the rank of each coordinate's earliest dart (the dart's name); the largest value if none."""
    empty = _U(2**RANK_BITS - 1)
    out = np.full((n, K), empty, _U)
    total = np.bincount(doc, weights=weight, minlength=n)
    reach = np.divide(K * (np.log(K) + 3), total, out=np.zeros(n), where=total > 0)
    todo = total > 0
    while todo.any():
        use = todo[doc]
        layers = np.ceil(weight[use]).astype(np.int64)
        d, v, w = (np.repeat(x[use], layers) for x in (doc, value, weight))
        layer = np.arange(len(d)) - np.repeat(np.cumsum(layers) - layers, layers)
        v = mix(v + layer.astype(_U) * _U(0x8CB92BA72F3D8DD7))
        bands = np.ceil(reach[d]).astype(np.int64)
        cell = np.repeat(np.arange(len(d)), bands)
        rank = np.arange(len(cell)) - np.repeat(np.cumsum(bands) - bands, bands)
        h = mix(v[cell] + mix(rank.astype(_U) + _U(0x5851F42D4C957F2D)))
        darts = np.searchsorted(_AT_MOST, (h >> _U(11)) * 2.0**-53, "right")
        which = np.repeat(np.arange(len(cell)), darts)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(darts) - darts, darts)
        h = mix(h[which] ^ mix(nth.astype(_U) + _U(1)))
        place = (rank[which] << 33) + (h >> _U(31)).astype(np.int64)
        own = d[cell[which]]
        g = mix(h + _U(0x2545F4914F6CDD1D))
        high = layer[cell[which]] + (g & _U(0xFFFFFFFF)) * 2.0**-32 < w[cell[which]]
        good = high & (place < reach[own] * 2.0**33)
        key = (own[good].astype(_U) << _U(COORDINATE_BITS + RANK_BITS)) | ((g[good] >> _U(64 - COORDINATE_BITS)) << _U(RANK_BITS)) | place[good].astype(_U)
        key.sort()
        slot = (key >> _U(RANK_BITS)).astype(np.int64)
        first = np.concatenate([[True], slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, bool)
        out.reshape(-1)[slot[first]] = key[first] & empty
        todo = (out == empty).any(axis=1) & (total > 0) & (reach < 1000)
        reach = np.where(todo, np.minimum(2 * reach, 1000), reach)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    rows = K // BANDS
    key = np.zeros((len(signatures), BANDS), _U) + np.arange(BANDS, dtype=_U)
    for j in range(rows):
        key = mix(key * _U(0x9E3779B97F4A7C15) + signatures[:, j::rows])
    return key.view(np.int64)


def signed_documents(docs: DataFrame) -> DataFrame:
    """doc, c1, c2 (a digest of the words in order), bands (empty without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a0, b0 in parts(batch, most=AT_ONCE):
                for a in range(a0, b0, 2**DOC_BITS):
                    b = min(b0, a + 2**DOC_BITS)
                    data, places = data_of(batch["text"].slice(a, b - a))
                    doc, value = shingles(data, places)
                    content = contents(data, places)
                    doc, value, count = weighted(doc, value)
                    keys = band_keys(dart_signatures(doc, value, count.astype(float), b - a))
                    some = np.bincount(doc, minlength=b - a) > 0
                    offsets = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
                    bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].ravel()))
                    yield pa.RecordBatch.from_arrays(
                        [batch["doc"].slice(a, b - a), pa.array(content[:, 0]), pa.array(content[:, 1]), bands], names=["doc", "c1", "c2", "bands"]
                    )

    return docs.select("doc", "text").mapInArrow(run, "doc long, c1 long, c2 long, bands array<long>")


def similarities(pairs: DataFrame, texts: DataFrame, threshold: float, most: int = 64) -> DataFrame:
    """The pairs (leader, node) whose whole texts have a weighted Jaccard similarity of at least ``threshold``.

    A leader's text goes to as many parts as it has members by ``most``, so a leader of very many is no one task's.
    """
    # written, so that both sides of the next join are plain exchanges, which Spark can split at a hot leader
    sizes = keep(pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / most).alias("parts")))
    members = pairs.join(sizes, "leader").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).drop("parts")
    rows = members.join(texts, "node").select("leader", "part", F.lit(1).alias("role"), "node", "text")
    heads = sizes.join(texts, F.col("leader") == F.col("node"))
    heads = heads.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), "node", "text")
    spark = pairs.sparkSession
    both = heads.unionByName(rows).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "leader", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: list[tuple] = []  # the leader's texts: one, but for an id with several
        now = None
        for batch in batches:
            out: list[tuple] = []
            for a0, b0 in parts(batch, most=AT_ONCE):
                for a in range(a0, b0, 2**DOC_BITS):
                    b = min(b0, a + 2**DOC_BITS)
                    doc, value = shingles(*data_of(batch["text"].slice(a, b - a)))
                    doc, value, count = weighted(doc, value)
                    by = np.argsort(doc, kind="stable")
                    value, count = value[by], count[by]
                    at = np.searchsorted(doc[by], np.arange(b - a + 1))
                    roles, leaders, nodes, places = (batch[k].slice(a, b - a).to_pylist() for k in ("role", "leader", "node", "part"))
                    for i in range(b - a):
                        own = (value[at[i] : at[i + 1]], count[at[i] : at[i + 1]])
                        if now != (now := (leaders[i], places[i])):
                            heads = []
                        if roles[i] == 0:
                            heads.append(own)
                            continue
                        for head in heads:
                            _, x, y = np.intersect1d(head[0], own[0], assume_unique=True, return_indices=True)
                            low = np.minimum(head[1][x], own[1][y]).sum()
                            all_ = head[1].sum() + own[1].sum() - low
                            if low >= threshold * all_:
                                out.append((leaders[i], nodes[i]))
                                break
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return both.sortWithinPartitions("leader", "part", "role").mapInArrow(run, "a long, b long")


def summaries(texts: DataFrame) -> DataFrame:
    """node, low and high (its shingles, twice), bins: how many of them fall in each bin, at most 255, and over: the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a0, b0 in parts(batch, most=AT_ONCE):
                for a in range(a0, b0, 2**DOC_BITS):
                    b = min(b0, a + 2**DOC_BITS)
                    doc, value = shingles(*data_of(batch["text"].slice(a, b - a)))
                    at = doc * BINS + (value & _U(BINS - 1)).astype(np.int64)
                    many = np.bincount(at, minlength=(b - a) * BINS).reshape(-1, BINS)
                    bins = np.minimum(many, 255).astype(np.uint8)
                    total = pa.array(many.sum(axis=1))
                    over = pa.array((many - bins).sum(axis=1))
                    yield pa.RecordBatch.from_arrays([batch["node"].slice(a, b - a), total, total, over, _binary(bins)], names=["node", *SUMMARY])

    return texts.select("node", "text").mapInArrow(run, f"node long, {SUMMARY_TYPES}")


SUMMARY = ["low", "high", "over", "bins"]
SUMMARY_TYPES = "low long, high long, over long, bins binary"


def _binary(bins: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in bins], pa.binary())


def _summary_of(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, ...]:
    bins = np.frombuffer(b"".join(t["bins"].to_pylist()), np.uint8).reshape(-1, BINS)
    return (*(np.asarray(t[c], np.int64) for c in SUMMARY[:3]), bins)


def class_summaries(members: DataFrame) -> DataFrame:
    """label and the summary of all its members (node, label and their summaries); tasks sum up their batches before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            label = np.asarray(batch["label"], np.int64)
            order = np.argsort(label, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], label[order][1:] != label[order][:-1]]))
            low, high, over, bins = (x[order] for x in _summary_of(batch))
            sums = [np.minimum.reduceat(low, first), np.maximum.reduceat(high, first), np.maximum.reduceat(over, first)]
            yield pa.RecordBatch.from_arrays([pa.array(label[order][first]), *map(pa.array, sums), _binary(np.maximum.reduceat(bins, first))], names=["label", *SUMMARY])

    kinds = f"label long, {SUMMARY_TYPES}"
    part = members.select("label", *SUMMARY).mapInArrow(run, kinds)
    wide = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for label, low, high, over, bins in zip(batch["label"].to_pylist(), *_summary_of(batch)):
                if (old := held.get(label)) is None:
                    held[label] = [low, high, over, bins.copy()]
                else:
                    old[:3] = min(old[0], low), max(old[1], high), max(old[2], over)
                    np.maximum(old[3], bins, out=old[3])
            if len(held) > 100_000:  # sorted by label: all but the last are whole
                last = held.popitem()
                yield rows(held)
                held = dict([last])
        yield rows(held)

    def rows(held: dict[int, list]) -> pa.RecordBatch:
        columns = [pa.array([x[i] for x in held.values()], pa.int64()) for i in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), *columns, _binary([x[3] for x in held.values()])], names=["label", *SUMMARY])

    return part.repartition(wide, "label").sortWithinPartitions("label").mapInArrow(merge, kinds)


def possible(x: tuple, y: tuple | None, threshold: float, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places in x and y (in x alone if None) of the pairs of two labels whose similarity may reach the threshold.

    Both are (label, low, high, over, bins). No more can be common than the lesser of each bin, and of what the bins leave
    out. Each in x gets the ``most`` likeliest at most; the last result says whether that left any out.
    """
    (label, low, high, over, bins), (label2, low2, high2, over2, bins2) = x, x if y is None else y
    left, right, share = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    step = max(1, 8192 // len(label2))
    for a in range(0, len(label), step):
        own = np.arange(a, min(a + step, len(label)))[:, None]
        good = (label2[None, :] != label[own]) & (low2[None, :] * threshold <= high[own]) & (low[own] * threshold <= high2[None, :])
        i, j = np.nonzero(good & (np.arange(len(label2)) > own) if y is None else good)
        i = i + a
        common = np.minimum(bins2[j], bins[i]).sum(axis=1, dtype=np.int64) + np.minimum(over2[j], over[i])
        common = np.minimum(common, np.minimum(high2[j], high[i]))
        both = np.maximum(low[i], common) + np.maximum(low2[j], common) - common
        near = common >= threshold * both
        left.append(i[near])
        right.append(j[near])
        share.append(common[near] / np.maximum(both[near], 1))
    i, j, share = map(np.concatenate, (left, right, share))
    order = np.lexsort((j, -share, i))
    i, j = i[order], j[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < most
    return i[first], j[first], not first.all()


def blocks(rows: DataFrame, ask: str, answer: str, threshold: float, most: int) -> DataFrame:
    """a, b: values of ``ask`` and ``answer`` (names of columns) of the pairs in a group that may be linked; null, null: some were left out.

    ``rows`` has g (the group), side (0 asks side 1; 2 asks its own), node, label and summaries, and into how many parts,
    of about ``BLOCK`` rows, the asking and the asked side of the group are cut. Each two parts (or one with itself)
    meet by themselves, so no task has more than that of a hot group.
    """
    part = lambda n: F.pmod(F.xxhash64("node", "label"), F.col(n))
    meets = lambda n, pair: F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), lambda k: F.struct(*[x.alias(c) for x, c in zip(pair(k), ("lo", "hi"))]))
    places = F.when(F.col("side") == 0, meets("asked", lambda k: (part("asking"), k))).when(F.col("side") == 1, meets("asking", lambda k: (k, part("asked"))))
    places = places.otherwise(meets("asking", lambda k: (F.least(k, part("asking")), F.greatest(k, part("asking")))))
    placed = rows.withColumn("part", part("asking")).withColumn("place", F.explode(places))
    # of two parts of one side the lower one asks
    role = F.when(F.col("side") < 2, F.col("side")).when(F.col("place.lo") == F.col("place.hi"), 2).otherwise((F.col("part") > F.col("place.lo")).cast("int"))
    placed = placed.select("g", "place.lo", "place.hi", role.alias("role"), "node", "label", *SUMMARY)
    wide = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartition(wide, "g", "lo", "hi").sortWithinPartitions("g", "lo", "hi", "role", "node", "label")

    def solve(t: pa.Table) -> list[tuple[np.ndarray, np.ndarray, bool]]:
        role = np.asarray(t["role"], np.int64)
        n = int(np.searchsorted(role, 1))
        if len(role) < 2 or role[0] < 2 and n in (0, len(role)):
            return []
        whole = (np.asarray(t["label"], np.int64), *_summary_of(t))
        if role[0] == 2:
            i, j, cut = possible(whole, None, threshold, most)
        else:
            i, j, cut = possible(tuple(x[:n] for x in whole), tuple(x[n:] for x in whole), threshold, most)
            j = j + n
        return [(np.asarray(t[ask], np.int64)[i], np.asarray(t[answer], np.int64)[j], cut)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        cut = False
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            group = np.stack([np.asarray(t[c], np.int64) for c in ("g", "lo", "hi")])
            ends = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1
            found = [x for a, b in zip([0, *ends[:-1]], ends) for x in solve(t.slice(a, b - a))]
            cut |= any(x[2] for x in found)
            yield pairs(found)
            held = t.slice(int(ends[-1]) if len(ends) else 0)
        found = solve(held) if held is not None else []
        yield pairs(found)
        if cut or any(x[2] for x in found):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 2, names=["a", "b"])

    def pairs(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *(x[k] for x in found)])) for k in (0, 1)], names=["a", "b"])

    return placed.mapInArrow(run, "a long, b long").distinct()


def mixed(rows: DataFrame) -> DataFrame:
    """key, label, classes (of the bucket): each class of a bucket once, buckets with one class left out."""
    rows = keep(rows.distinct())
    # written, as in similarities()
    several = keep(rows.groupBy("key").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1"))
    return keep(rows.join(several, "key"))


def proposed(open_: DataFrame, members: DataFrame, threshold: float, most: int) -> tuple[DataFrame, bool]:
    """a, b: pairs of members of two classes of an open bucket that may be linked, and whether any were left out.

    ``open_`` is what ``mixed`` gives; ``members`` node, label and summaries of all in these classes.
    """
    parts_ = lambda n: F.ceil(F.col(n) / BLOCK)
    rows = open_.join(class_summaries(members), "label")
    rows = rows.select(F.col("key").alias("g"), F.lit(2).alias("side"), parts_("classes").alias("asking"), parts_("classes").alias("asked"), F.col("label").alias("node"), "label", *SUMMARY)
    met = keep(blocks(rows, "label", "label", threshold, most))
    # the larger class of a pair answers, the members of all that meet it ask
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    pairs = met.filter("a is not null").join(sizes.withColumnsRenamed({"label": "a", "n": "n_a"}), "a").join(sizes.withColumnsRenamed({"label": "b", "n": "n_b"}), "b")
    pairs = pairs.select(F.array_sort(F.array(*[F.struct((-F.col(f"n_{x}")).alias("n"), F.col(x).alias("label")) for x in "ab"])).alias("p")).distinct()
    pairs = keep(pairs.select(F.col("p")[0]["label"].alias("g"), F.col("p")[0]["n"].alias("n_g"), F.col("p")[1]["label"].alias("label"), F.col("p")[1]["n"].alias("n")))
    groups = keep(pairs.groupBy("g").agg(F.ceil(-F.sum("n") / BLOCK).alias("asking"), F.ceil(-F.max("n_g") / BLOCK).alias("asked")))
    asked = members.join(groups.withColumnRenamed("g", "label"), "label").select(F.col("label").alias("g"), F.lit(1).alias("side"), "asking", "asked", "node", "label", *SUMMARY)
    asking = members.join(pairs.join(groups, "g"), "label").select("g", F.lit(0).alias("side"), "asking", "asked", "node", "label", *SUMMARY)
    found = keep(blocks(asked.unionByName(asking), "node", "node", threshold, most))
    left_out = not met.unionByName(found).filter("a is null").isEmpty()
    return found.filter("a is not null"), left_out


def number(text: Column) -> Column:
    """The id, or a number made from the text where it is null."""
    return F.coalesce("doc_id", F.lit(-(2**62)) - F.xxhash64(text).bitwiseAND(2**62 - 1))


def one_id(signed: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b: links between the texts of an id that has several."""
    several = signed.groupBy("doc").agg(F.min("c1").alias("low"), F.max("c1").alias("high")).filter("low < high").select("doc")
    own = signed.select("doc", "c1", "c2").join(several, "doc", "left_semi").join(nodes.select("c1", "c2", "node"), ["c1", "c2"]).select("doc", "node")
    return own.join(own.groupBy("doc").agg(F.min("node").alias("a")), "doc").filter("a <> node").select("a", F.col("node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the least number of the class) of every row."""
    text = F.coalesce("text", F.lit(""))
    named = docs.select("doc_id", number(text).alias("doc"), text.alias("text"))
    signed = keep(signed_documents(named))
    nodes = keep(signed.groupBy("c1", "c2").agg(F.min("doc").alias("node"), F.max("bands").alias("bands")))
    rows = nodes.select("node", F.explode("bands").alias("key"))
    shared = keep(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    members = keep(rows.join(shared, "key"))
    degree = members.groupBy("node").agg(F.sum("n").alias("degree"))
    members = keep(members.drop("n").join(degree, "node"))
    texts = named.join(degree.select("node"), F.col("doc") == F.col("node"), "left_semi").select(F.col("doc").alias("node"), "text").distinct()
    texts = keep(texts)

    least = members.groupBy("key").agg(F.min("node").alias("leader"))
    central = members.groupBy("key").agg(F.min(F.struct(-F.col("degree"), "node"))["node"].alias("leader"))
    pairs = members.select("key", "node").join(least.unionByName(central).distinct(), "key").filter("leader <> node").select("leader", "node").distinct()
    done = pairs = keep(pairs)
    links = keep(similarities(pairs, texts, threshold).unionByName(one_id(signed, nodes)))
    labels = connected(links)
    placed = members.select("key", "node").join(labels, "node", "left").select("key", F.coalesce("label", "node").alias("label"))
    open_, own, most = mixed(placed), degree.select("node").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label")), FIRST
    classes = nodes.select("c1", "c2", "node").join(labels, "node", "left").select("c1", "c2", F.coalesce("label", "node").alias("class_id"))
    summed: DataFrame | None = None
    while not open_.isEmpty():
        own = keep(own.join(keep(open_.select("label").distinct()), "label"))
        if summed is None:
            summed = keep(summaries(texts.join(own, "node", "left_semi")))
        found, left_out = proposed(open_, keep(own.join(summed, "node")), threshold, most)
        found = found.select(F.col("a").alias("leader"), F.col("b").alias("node"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        met = done.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b"))
        pairs = keep(found.join(met, ["a", "b"], "left_anti").select("leader", "node"))
        new = keep(similarities(pairs, texts, threshold))
        if not new.isEmpty():
            by = own.select(F.col("node").alias("a"), F.col("label").alias("x")), own.select(F.col("node").alias("b"), F.col("label").alias("y"))
            moved = connected(new.join(by[0], "a").join(by[1], "b").select(F.col("x").alias("a"), F.col("y").alias("b")))
            moved = moved.select(F.col("node").alias("old"), F.col("label").alias("new"))
            follow = lambda df, c: df.join(moved, F.col(c) == F.col("old"), "left").withColumn(c, F.coalesce("new", c)).drop("old", "new")  # noqa: B023, E731
            classes = follow(classes, "class_id")
        if not left_out:  # all pairs of two classes have been compared
            break
        if not new.isEmpty():
            own, open_ = follow(own, "label"), mixed(follow(open_.select("key", "label"), "label"))
        done = done.unionByName(pairs)
        most *= 32
    out = signed.select("doc", "c1", "c2").join(classes, ["c1", "c2"])
    return out.select(F.when(F.col("doc") >= -(2**62), F.col("doc")).alias("doc_id"), "class_id", "doc")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The documents, all columns, without those whose class has one of a smaller number; of rows with one id one stays."""
    classes = near_duplicates(docs, **how)
    stay = classes.filter("doc = class_id").select(F.col("doc").alias("_number")).distinct()
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(number(text).alias("_number"), F.col("text").alias("_text"), F.struct("*").alias("_row")).join(stay, "_number", "left_semi")
    order = Window.partitionBy("_number").orderBy(F.xxhash64("_text"), "_text")
    return rows.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").select("_row.*")
