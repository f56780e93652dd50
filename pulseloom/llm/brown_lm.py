"""Class-based bigram language model with classes from exchange clustering (Brown et al.), and document scores.

P(text) is the product over tokens of P(class | class before) P(item | class) and, for words too rare to cluster,
P(word | item). An item is a clustered word, the end of text, or one of ``ENDINGS`` groups of the rarer words by their last
three bytes; a group is clustered as if it were a word. Every word that occurs ``LEAST`` times is clustered, however many there are.

The most frequent words and the groups are exchanged one by one until none moves; every other word begins in the class of
its group. Then all words are exchanged in rounds: in each, a task takes one word after another out of its class and puts it,
by all its neighbours, into the class that makes the class bigrams likeliest, with the exact gain of that move. Tasks work side by side on the
class bigrams of the round's start; these are counted anew after it, and rounds go on while the likelihood rises. Inside a group a word with count c has
(c + 1) / (N + V + 1), N and V being the group's tokens and words, which leaves room for an unknown word; transitions
back off to the class frequencies. So the probabilities of all words after any word sum to 1.

The ``held`` most frequent of the clustered words are in a broadcast table. If there are more, the others (common words) follow:
they begin in the class of their group, and rounds as above move each by all its neighbours, with exact gains, until the likelihood
stops rising. Their classes are a distributed table, and the bigrams with them meet it in joins on the hash, when they are counted and when
texts are scored; nothing of them but sums by class goes to the driver.

Scale: the texts are split into words three times: to count, to number and to score; every other pass reads the numbers.
Words are 64-bit hashes of their bytes (9 bits of which name the group). Counts are a grouped table. The ``held``
words, and rarer ones up to ``known`` words, are broadcast, 24 bytes each; the other tokens meet their counts in a join
on the hash. Common words beyond them cost one more pass over the texts, and a shuffle of their distinct bigrams a round. Classes grow with the cube root of the clustered words. Bigrams of the first items (four for each class) and of
classes are a matrix per task; its parts are added up by row.

Nulls: a null text is empty, that is one end token; a null id hashes as empty text. Repeated rows are scored alike and
count as often as they stand there. Without training texts N and V are 0 and every base probability is 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import keep
from .text import data_of, mix, parts, word_hashes, words_of

ENDINGS = 512
FREQUENT = 256
CLASSES = 32
#: A word of fewer occurrences is not clustered by itself.
LEAST = 10
#: Clustered words of the broadcast table; further ones meet their classes in joins.
HELD = 2_000_000
#: Words of the broadcast table, beyond which only clustered ones are in it.
KNOWN = 500_000
#: Weight of the class frequencies in a transition.
BACK = 8
#: Rounds of exchange of all words at most, and the part by which the likelihood must rise for another one.
ROUNDS, ENOUGH = 8, 2e-4
#: The end token's name: no word can have it, for groups of words are below ENDINGS only after hashing real bytes.
END = np.int64(-(2**63))
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def tokens(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows [a, b): the tokens' hashes, an end token after each text, and the place after each text's end."""
    for a, b in parts(batch):
        data, places = data_of(batch["text"].slice(a, b - a))
        data = _lower[data]
        start, end, at = words_of(data, places)
        last = data[end - 1].astype(np.uint64)
        for k in (2, 3):
            last = (last << np.uint64(8)) | data[np.maximum(end - k, start)]
        group = mix(last) & np.uint64(ENDINGS - 1)
        names = ((word_hashes(data, start, end) & ~np.uint64(ENDINGS - 1)) | group).view(np.int64)
        yield a, b, np.insert(names, at[1:], END), at[1:] + np.arange(1, b - a + 1)


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash), n: how often each token stands in the documents. Tasks count ahead in runs of 3 million tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            word, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(word), pa.array(n.astype(np.int64))], names=["word", "n"])

        for batch in batches:
            for _, _, names, _ in tokens(batch):
                held.append(names)
                if sum(map(len, held)) > 3_000_000:
                    yield flush()
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Table:
    """The frequent words, ascending: hash, count, item. Item 0 is the end, then words, then groups by ending."""

    word: np.ndarray
    n: np.ndarray
    item: np.ndarray
    words: int

    def look(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Item of each token, and its count, -1 where the table hasn't got it. Each kind of token is looked up once."""
        kinds = pa.array(names).dictionary_encode()
        kind, at = np.asarray(kinds.dictionary, np.int64), np.asarray(kinds.indices)
        i = np.minimum(np.searchsorted(self.word, kind), len(self.word) - 1)
        hit = self.word[i] == kind
        return np.where(hit, self.item[i], self.words + (kind & (ENDINGS - 1)))[at], np.where(hit, self.n[i], -1)[at]


def frequent_words(counts: DataFrame, least: int, held: int, known: int) -> tuple[Table, DataFrame | None, int]:
    """The table of the first words, by fine steps of counts: at most ``held`` of those to cluster, and the rarer ones while all are at most ``known``.

    And the other words to cluster (word, n), None if there are none, and how many.
    """
    step, often = F.floor(F.log2("n") * 64), F.col("n") >= least
    steps = counts.filter(F.col("word") != int(END)).groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("all"), F.count_if(often).alias("often")).orderBy(F.desc("step")).collect()
    low = [2**40, 2**40]
    for k, (column, most) in enumerate((("all", known), ("often", held))):
        total = 0
        for r in steps:
            if (total := total + r[column]) > most:
                break
            low[k] = r["step"]
    beyond = sum(r["often"] for r in steps if r["step"] < min(low))
    common = counts.filter((F.col("word") != int(END)) & often & (step < min(low))) if beyond else None
    rows = counts.filter((F.col("word") == int(END)) | often & (step >= low[1]) | (step >= low[0])).toArrow()
    word, n = np.asarray(rows["word"], np.int64), np.asarray(rows["n"], np.int64)
    if END not in word:
        word, n = np.append(word, END), np.append(n, 0)
    order = np.argsort(word)
    word, n = word[order], n[order]
    item = np.full(len(word), -1, np.int64)
    first = np.lexsort((word, -n))
    first = first[(word[first] != END) & (n[first] >= least)]
    item[first] = np.arange(1, len(first) + 1)
    item[word == END] = 0
    words = len(first) + 1
    return Table(word, n, np.where(item < 0, words + (word & (ENDINGS - 1)), item), words), common, beyond


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of unsigned numbers, of four bytes each, compressed. Of several the first, which ascends, is kept by its steps, and the bytes of all by their places."""
    import zstandard

    if len(columns) == 1:
        data = columns[0].astype("<u4").tobytes()
    else:
        flat = np.concatenate([np.diff(columns[0].astype("<u4"), prepend=np.uint32(0)), *(c.astype("<u4") for c in columns[1:])])
        data = np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 4).T).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unpack(block: bytes, columns: int) -> np.ndarray:
    import zstandard

    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8)
    if columns == 1:
        return data.view("<u4").reshape(1, -1).astype(np.int64)
    out = np.ascontiguousarray(data.reshape(4, -1).T).view("<u4").reshape(columns, -1).astype(np.int64)
    np.cumsum(out[0], out=out[0])
    out[0] &= 2**32 - 1
    return out


def _blocks(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], names=["bucket", "block"])


def _buckets(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def items_of(docs: DataFrame, table: Table) -> DataFrame:
    """The training texts as items, a packed row for each run of texts, kept: later passes needn't split and look up words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, names, _ in tokens(batch):
                yield pa.RecordBatch.from_arrays([pa.array([_pack(table.look(names)[0])], pa.binary())], names=["items"])

    return keep(docs.select("text").mapInArrow(run, "items binary"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The items of each run of texts; a run ends with an end token."""
    for batch in batches:
        for block in batch["items"]:
            yield _unpack(block.as_py(), 1)[0]


def bigrams_of(items: DataFrame, of: np.ndarray) -> np.ndarray:
    """How often each number ``of[item]`` follows each: a matrix, summed inside tasks and then by rows."""
    size = int(of.max()) + 1
    buckets = min(_buckets(items), size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for run in _runs(batches):
            at = of[run]
            total += np.bincount(np.concatenate([[of[0]], at[:-1]]) * size + at, minlength=size * size)
        total = total.reshape(size, size)
        for k in range(buckets):
            own = total[k::buckets].ravel()
            # parts of 2^31 at most, as four bytes hold
            while (some := np.flatnonzero(own)).size:
                n = np.minimum(own[some], 2**31)
                own[some] -= n
                yield _blocks([(k, _pack(some, n))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, block in zip(batch["bucket"].to_pylist(), batch["block"].to_pylist()):
                at, n = _unpack(block, 2)
                if k not in sums:
                    sums[k] = np.zeros(len(range(k, size, buckets)) * size, np.int64)
                sums[k][at] += n
        yield _blocks([(k, x.tobytes()) for k, x in sums.items()])

    blocks = items.mapInArrow(count, "bucket long, block binary").repartition(buckets, "bucket")
    out = np.zeros((size, size), np.int64)
    for r in blocks.mapInArrow(add, "bucket long, block binary").collect():
        out[r["bucket"] :: buckets] = np.frombuffer(r["block"], np.int64).reshape(-1, size)
    return out


def exchanged(items: DataFrame, words: int, of: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The classes after one round of exchange of all words (items 1 to ``words``), each by its counts of classes before and after it.

    A task counts (word, side, class) in runs of tokens and sends them by word. Where a word's counts arrive, it is taken out
    of its class and put into the one that makes the class bigrams ``moves`` likeliest, exactly as in ``exchange_clusters``: the words
    of a task move one after another, the most frequent first, and see each other's moves; those of other tasks do not.
    """
    classes, buckets = len(moves), _buckets(items)
    wide = 2 * classes + 1  # classes after a word, classes before it, the word itself

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            item, at = np.divmod(key, wide)
            by = np.argsort(item % buckets, kind="stable")
            cuts = np.searchsorted((item % buckets)[by], np.arange(buckets + 1))
            own = [(k, by[cuts[k] : cuts[k + 1]]) for k in range(buckets) if cuts[k] < cuts[k + 1]]
            return _blocks([(k, _pack(item[i] // buckets, at[i], n[i])) for k, i in own])

        many = 0
        for item in _runs(batches):
            before = np.concatenate([[0], item[:-1]])
            word = (item > 0) & (item < words)
            held.append(item[word] * wide + classes + of[before[word]])
            word = (before > 0) & (before < words)
            held.append(before[word] * wide + of[item[word]])
            held.append(before[word & (before == item)] * wide + 2 * classes)
            many += sum(map(len, held[-3:]))
            if many > 2_000_000:
                yield flush()
                many = 0
        if held:
            yield flush()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts_: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for k, block in zip(batch["bucket"].to_pylist(), batch["block"].to_pylist()):
                word, at, n = _unpack(block, 3)
                parts_.setdefault(k, []).append(np.stack([(word * buckets + k) * wide + at, n]))
        if not parts_:
            return
        key, n = np.concatenate([x for own in parts_.values() for x in own], axis=1)
        parts_.clear()
        kinds, at = np.unique(key, return_inverse=True)
        n = np.bincount(at, weights=n)
        item, at = np.divmod(kinds, wide)
        first = np.flatnonzero(np.diff(item, prepend=-1))
        last = np.append(first[1:], len(item))
        m, out = moves.astype(float), np.zeros(len(first), np.int64)
        for w in np.argsort(-np.add.reduceat(n, first), kind="stable").tolist():
            own = np.zeros(wide)
            own[at[first[w] : last[w]]] = n[first[w] : last[w]]
            out[w] = exchange(m, own[:classes], own[classes:-1], own[-1], of[item[first[w]]])
        yield pa.RecordBatch.from_arrays([pa.array(item[first]), pa.array(out)], names=["item", "class"])

    blocks = items.mapInArrow(count, "bucket long, block binary").repartition(buckets, "bucket")
    found = blocks.mapInArrow(place, "item long, class long").toArrow()
    out = of.copy()
    out[np.asarray(found["item"], np.int64)] = np.asarray(found["class"], np.int64)
    return out


def likelihood(moves: np.ndarray) -> float:
    """Log likelihood of class bigrams, but for what the words inside their classes give, which no class changes."""
    f = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    m = moves.astype(float)
    return f(m) - f(m.sum(axis=0)) - f(m.sum(axis=1))


def _smooth(moves: np.ndarray) -> np.ndarray:
    """P(column | row) from counts, backed off to the columns' frequencies."""
    often = moves.sum(axis=0) + 1
    return (moves + BACK * often / often.sum()) / (moves.sum(axis=1, keepdims=True) + BACK)


def exchange(m: np.ndarray, to: np.ndarray, frm: np.ndarray, own: float, old: int) -> int:
    """The best class of an item of class ``old``; the item is taken out of the class bigrams ``m`` and put into that class.

    ``to`` and ``frm`` are its bigrams with the classes after and before it (changed here), ``own`` with itself.
    """

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1))

    to[old] -= own
    frm[old] -= own
    m[old] -= to
    m[:, old] -= frm
    m[old, old] -= own
    left, right, around = m.sum(axis=1), m.sum(axis=0), np.diag(m)
    after, before = np.flatnonzero(to), np.flatnonzero(frm)
    gain = (f(m[:, after] + to[after]) - f(m[:, after])).sum(axis=1) + (f(m[before] + frm[before, None]) - f(m[before])).sum(axis=0)
    gain -= f(around + to) - f(around) + f(around + frm) - f(around)
    gain += f(around + to + frm + own) - f(around)
    gain -= f(left + to.sum() + own) - f(left) + f(right + frm.sum() + own) - f(right)
    gain[0] = -np.inf
    new = int(np.argmax(gain)) if gain[int(np.argmax(gain))] > gain[old] + 1e-9 else old
    m[new] += to
    m[:, new] += frm
    m[new, new] += own
    return new


def exchange_clusters(bigrams: np.ndarray, classes: int, rounds: int = 8) -> np.ndarray:
    """Each item's class: items move one at a time to the class that makes the class bigrams likeliest, until none moves.

    The likelihood is sum n(g, h) log n(g, h) - sum n(g) log n(g) - sum n(h) log n(h); a move changes one row and one
    column of the class matrix. The end of text has class 0 to itself.
    """
    c = bigrams.astype(float)
    n = len(c)
    classes = min(classes, max(2, n))
    order = 1 + np.argsort(-(c.sum(axis=0) + c.sum(axis=1))[1:], kind="stable")
    of = np.zeros(n, np.int64)
    of[order] = 1 + np.arange(n - 1) % (classes - 1)
    hot = np.eye(classes)[of]
    m = hot.T @ c @ hot

    for _ in range(rounds):
        moved = 0
        for w in order:
            to, frm, own = c[w] @ hot, c[:, w] @ hot, c[w, w]
            if to.sum() + frm.sum() == 0:
                continue
            old = of[w]
            new = exchange(m, to, frm, own, old)
            if new != old:
                hot[w] = 0
                hot[w, new] = 1
                of[w] = new
                moved += 1
        if not moved:
            break
    return of


def _outside(names: np.ndarray, item: np.ndarray, n: np.ndarray, of: np.ndarray, **more: np.ndarray) -> pa.Table:
    """The bigrams with a word outside the table, and how often each stands there: a, b (hashes, null inside the table), x, y (classes by the table), many."""
    out = n < 0
    before = np.concatenate([[False], out[:-1]])
    at = np.flatnonzero(out | before)
    a = pa.array(names[at - 1], mask=~before[at])
    columns = {"a": a, "x": pa.array(of[np.where(at > 0, item[at - 1], 0)]), "b": pa.array(names[at], mask=~out[at]), "y": pa.array(of[item[at]])}
    columns |= {k: pa.array(v[at]) for k, v in more.items()}
    return pa.table(columns).group_by(list(columns)).aggregate([([], "count_all")]).rename_columns([*columns, "many"])


def _met(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs with the classes g, h of a and b, and n_a, n_b, their counts: null for what is no common word, which has class x or y."""
    for c, own, new in (("a", "x", "g"), ("b", "y", "h")):
        found = classes.select(F.col("word").alias(c), F.col("n").alias(f"n_{c}"), F.col("class").alias(new))
        # no null meets another task's rows: nulls would be one hot key
        inside = pairs.filter(F.col(c).isNull()).withColumns({f"n_{c}": F.lit(None).cast("long"), new: F.col(own)})
        pairs = pairs.filter(F.col(c).isNotNull()).join(found, c, "left").withColumn(new, F.coalesce(new, own)).unionByName(inside)
    return pairs


def common_pairs(docs: DataFrame, table: Table, of: np.ndarray, classes: DataFrame) -> DataFrame:
    """a, x, b, y, many: the training texts' bigrams with a common word, kept; a, b are null for what is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, names, _ in tokens(batch):
                yield from _outside(names, *table.look(names), of).to_batches()

    def summed(df: DataFrame) -> DataFrame:
        return df.groupBy("a", "x", "b", "y").agg(F.sum("many").alias("many"))

    met = _met(summed(docs.select("text").mapInArrow(run, "a long, x long, b long, y long, many long")), classes)
    met = met.filter(F.col("n_a").isNotNull() | F.col("n_b").isNotNull())
    return keep(summed(met.withColumns({c: F.when(F.col(f"n_{c}").isNotNull(), F.col(c)) for c in "ab"})))


def _matrix(pairs: DataFrame, row: str, column: str, size: int) -> np.ndarray:
    sums = pairs.groupBy(row, column).agg(F.sum("many").alias("many")).toArrow()
    out = np.zeros((size, size), np.int64)
    out[np.asarray(sums[row], np.int64), np.asarray(sums[column], np.int64)] = np.asarray(sums["many"], np.int64)
    return out


def exchanged_common(placed: DataFrame, classes: DataFrame, moves: np.ndarray) -> DataFrame:
    """word, n, class after one round of exchange of all common words, as in ``exchanged``; ``placed`` are their bigrams with classes g, h."""
    size = len(moves)
    wide = 2 * size + 1
    sides = placed.filter("a is not null").select(F.col("a").alias("word"), F.col("h").alias("at"), "many")
    sides = sides.unionByName(placed.filter("b is not null").select(F.col("b").alias("word"), (F.col("g") + size).alias("at"), "many"))
    sides = sides.unionByName(placed.filter("a = b").select(F.col("a").alias("word"), F.lit(2 * size).cast("long").alias("at"), "many"))
    near = sides.groupBy("word", "at").agg(F.sum("many").alias("many")).join(classes, "word")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, held = moves.astype(float), None

        def solve(t: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
            word, n, old, at, many = (np.asarray(t[c], np.int64) for c in ("word", "n", "class", "at", "many"))
            first, out = np.append(0, ends[:-1])[: len(ends)], []
            for a, b in zip(first.tolist(), ends.tolist()):
                own = np.zeros(wide)
                own[at[a:b]] = many[a:b]
                out.append(exchange(m, own[:size], own[size:-1], own[-1], int(old[a])))
            return pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(n[first]), pa.array(out, pa.int64())], names=["word", "n", "class"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            ends = np.flatnonzero(np.diff(np.asarray(t["word"], np.int64))) + 1
            yield solve(t, ends)
            held = t.slice(int(ends[-1]) if len(ends) else 0)
        if held is not None and held.num_rows:
            yield solve(held, np.array([held.num_rows]))

    near = near.repartition(_buckets(near), "word").sortWithinPartitions("word")
    return keep(near.select("word", "n", "class", "at", "many").mapInArrow(place, "word long, n long, class long"))


@dataclass
class Model:
    table: Table
    step: np.ndarray  # log10 P(class | class before)
    emit: np.ndarray  # log10 P(item | class of the item), for a group less log10 (N + V + 1)
    of: np.ndarray
    train_tokens: int
    words: int
    counts: DataFrame
    likelihoods: list[float]  # before and after each round of exchange of all words
    mass: np.ndarray  # log10 of each class's tokens, smoothed
    common: DataFrame | None = None  # word, n, class of the clustered words that are not in the table


def fit(docs: DataFrame, most: int | None = None, known: int = KNOWN, classes: int | None = None, rounds: int = ROUNDS, held: int = HELD) -> Model:
    """Learn from all the documents given. ``most``: cluster only words that make up one of so many parts of the tokens; by default no word is left out for that."""
    counts = keep(word_counts(docs))
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    table, common, beyond = frequent_words(counts, max(LEAST, -(-int(sums["n"]) // most)) if most else LEAST, held, known)
    size = table.words + ENDINGS
    classes = classes or max(CLASSES, round(2 * (table.words + beyond) ** (1 / 3)))
    # the first words, and all others by their endings
    first = min(table.words, 1 + max(FREQUENT, 4 * classes))
    seed = np.concatenate([np.arange(table.words), first + np.arange(ENDINGS)])
    seed[table.item] = np.where(table.item < first, table.item, first + (table.word & (ENDINGS - 1)))
    items = items_of(docs, table)
    bigrams = bigrams_of(items, seed)
    at = exchange_clusters(bigrams, classes)
    hot = np.eye(at.max() + 1)[at]
    of, moves = at[seed], hot.T @ bigrams @ hot
    found = [likelihood(moves)]
    for _ in range(rounds if table.words > 1 else 0):
        new = exchanged(items, table.words, of, moves)
        then = bigrams_of(items, new)
        found.append(likelihood(then))
        if found[-1] <= found[-2]:  # words of different tasks got into each other's way
            break
        of, moves = new, then
        if found[-1] - found[-2] < ENOUGH * abs(found[-2]):
            break
    if common is not None:
        by_ending = F.get(F.lit(of[table.words :].tolist()), F.col("word").bitwiseAND(ENDINGS - 1).cast("int")).cast("long")
        common = keep(common.select("word", "n", by_ending.alias("class")))
        pairs = common_pairs(docs, table, of, common)
        rest = moves - _matrix(pairs, "x", "y", len(moves))
        placed = keep(_met(pairs, common))
        for _ in range(rounds):
            new = exchanged_common(placed, common, moves)
            placed = keep(_met(pairs, new))
            then = rest + _matrix(placed, "g", "h", len(moves))
            before, now = likelihood(moves), likelihood(then)
            found.append(now)
            if now <= before:
                break
            common, moves = new, then
            if now - before < ENOUGH * abs(before):
                break
    step = _smooth(moves)
    seen = np.zeros(size)
    own = (table.item > 0) & (table.item < table.words)
    seen[table.item[own]] = table.n[own]
    seen[0] = table.n[table.word == END][0]
    tokens_in, words_in = np.zeros(ENDINGS), np.zeros(ENDINGS)
    groups = counts.filter(F.col("word") != int(END)).groupBy(F.col("word").bitwiseAND(ENDINGS - 1).alias("g"))
    for r in groups.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        tokens_in[r["g"]], words_in[r["g"]] = r["n"], r["v"]
    np.subtract.at(tokens_in, table.word[own] & (ENDINGS - 1), table.n[own])
    np.subtract.at(words_in, table.word[own] & (ENDINGS - 1), 1)
    by_class = np.zeros(len(moves))
    if common is not None:
        for r in common.groupBy(F.col("word").bitwiseAND(ENDINGS - 1).alias("g"), "class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
            tokens_in[r["g"]] -= r["n"]
            words_in[r["g"]] -= r["v"]
            by_class[r["class"]] += r["n"] + 0.5 * r["v"]
    seen[table.words :] = tokens_in
    seen += 0.5
    mass = np.bincount(of, weights=seen, minlength=len(moves)) + by_class
    emit = np.log10(seen / mass[of])
    emit[table.words : size] -= np.log10(tokens_in + words_in + 1)
    return Model(table, np.log10(step), emit, of, int(sums["n"]), int(sums["v"]), counts, found, np.log10(np.maximum(mass, 0.5)), common)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row.

    A task finishes all tokens of the broadcast table. The others become one row per text and word, which the join
    brings to its count; log10(count + 1) enters both scores alike. A text's own row rides along under a hash of its number.
    Where there are common words, bigrams with a word outside the table become rows too; a join brings the classes, and what these change is added.
    """
    table, step, emit, of, mass = model.table, model.step, model.emit, model.of, model.mass
    wide = model.common is not None
    floor_ = np.log10(model.train_tokens + model.words + 1)
    group_item = table.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, names, ends in tokens(batch):
                item, n = table.look(names)
                c = of[item]
                known = n >= 0
                logs = np.where(known, np.log10(np.maximum(n, 0) + 1), 0)
                model_part = step[np.concatenate([[of[0]], c[:-1]]), c] + emit[item] + np.where(item >= group_item, logs, 0)
                total = lambda x: np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(x)])[ends]]))  # noqa: B023, E731
                length = total(np.ones(len(names), np.int64))
                row = np.asarray(batch["row"], np.int64)[a:b]
                doc = np.repeat(np.arange(b - a), length)
                first = np.concatenate([[0], ends[:-1]])
                base = np.add.reduceat(logs - floor_, first)
                score = np.add.reduceat(model_part, first)
                yield filled(
                    [pa.array(mix(row.astype(np.uint64)).view(np.int64)), pa.array(row), pa.array(np.zeros(b - a, np.int32)), batch["doc_id"].slice(a, b - a),
                     pa.array(length), pa.array(total((n > 0).astype(np.int64))), pa.array(base), pa.array(score)]
                )
                rare = np.flatnonzero(~known)
                if len(rare):
                    order = rare[np.lexsort((names[rare], doc[rare]))]
                    w, d = names[order], doc[order]
                    new = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (d[1:] != d[:-1])]))
                    many = np.diff(np.append(new, len(w))).astype(np.int32)
                    nothing = pa.nulls(len(new), pa.int64())
                    zero = pa.nulls(len(new), pa.float64())
                    yield filled([pa.array(w[new]), pa.array(row[d[new]]), pa.array(many), nothing, nothing, nothing, zero, zero])
                if wide and len(rare):
                    t = _outside(names, item, n, of, row=row[doc]).combine_chunks()
                    t = t.set_column(t.schema.get_field_index("many"), "many", t["many"].cast(pa.int32()))
                    yield from pa.table([t[f] if f in t.column_names else pa.nulls(len(t), kinds[f]) for f in fields], names=fields).to_batches()

    def filled(columns: list[pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(columns[0]), pa.int64()) for _ in fields[len(columns) :])], names=fields)

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, g, h, many = (np.asarray(batch[c], np.int64) for c in ("x", "y", "g", "h", "many"))
            n, b = (np.asarray(batch[c].fill_null(0), np.int64) for c in ("n_b", "b"))
            group = emit[group_item + (b & (ENDINGS - 1))] + np.log10(n + 1)
            more = step[g, h] - step[x, y] + np.where(n > 0, np.log10(n + 0.5) - mass[h] - group, 0)
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(many * more)], names=["row", "change"])

    fields = ["word", "row", "many", "doc_id", "n_tokens", "n_known", "base", "score"]
    schema = "word long, row long, many int, doc_id long, n_tokens long, n_known long, base double, score double"
    if wide:
        fields, schema = [*fields, "a", "x", "b", "y"], f"{schema}, a long, x long, b long, y long"
    kinds = dict.fromkeys(fields, pa.int64()) | {"many": pa.int32(), "base": pa.float64(), "score": pa.float64()}
    found = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).mapInArrow(run, schema)
    if wide:
        found = keep(found)  # a row's number is the same in both uses
        met = _met(found.filter("x is not null").select("row", "many", "a", "x", "b", "y"), model.common)
        met = met.filter(F.col("n_a").isNotNull() | F.col("n_b").isNotNull()).select("row", "many", "b", "x", "y", "g", "h", "n_b")
        changes = met.mapInArrow(change, "row long, change double").groupBy("row").agg(F.sum("change").alias("change"))
        found = found.filter("x is null").drop("a", "x", "b", "y")
    met = found.join(model.counts, "word", "left")
    more = F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("many") * F.log10(F.col("n") + 1))), F.lit(0.0))
    rows = met.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("many").cast("long"))), F.lit(0).cast("long"))).alias("n_known"),
        (F.sum("base") + more).alias("base_score"),
        (F.sum("score") + more).alias("score"),
    )
    if wide:
        rows = rows.join(changes, "row", "left").withColumn("score", F.col("score") + F.coalesce("change", F.lit(0.0)))
    return rows.select("doc_id", "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
