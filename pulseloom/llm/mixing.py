"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

The mix is a row of slots, each of which holds one block of ``block`` words of one source. Slot n looks up the
golden-ratio point frac((n + 1/2) / phi) in the cumulative weights of the sources, so after any number of slots every
source has had its share to within a few blocks. A source's documents, in the order of the md5 of their ids and texts, form
a stream of words that may be read ``repeats`` times; the r-th slot of a source takes the r-th block of the stream.

Nulls: a null text has 0 words, a null source is a source of its own and sorts last, a null id hashes as empty text.
Repeated rows are rows, however many: those of one digest are counted per run of rows of the written table, so they are many tasks' work. No words at all, or no rows, give targets of 0 and an empty schedule.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import running_total
from ..functions.shared import keep

WORD = r"[^\x20\x09-\x0D]+"
STEP = (math.sqrt(5) - 1) / 2
FAR_BITS = 20
FAR_STEP = (2**FAR_BITS * STEP) % 1.0


def sized_documents(docs: DataFrame, *rest: str) -> DataFrame:
    """doc_id, source, size (words), md5 of the id and the text's md5, row (a number of our own), and further columns."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")))))
    return docs.select("doc_id", "source", size.alias("size"), digest.alias("digest"), F.monotonically_increasing_id().alias("row"), *rest)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """One row per source: its words, its target and its quota (the target in whole words).

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` times all words. A target
    stops at ``repeats`` times the source's words and the excess is shared again by weight: with the sources in
    order of cap over weight, the level is the first at which no further source is above its cap.
    The windows here run over one row per source.
    """
    named = Window.orderBy(F.col("source").isNull(), "source")
    rows = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    rows = rows.withColumn("sno", F.row_number().over(named) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sno") % len(weights) + 1).cast("int"))
    rows = rows.withColumn("weight", weight).withColumn("cap", (repeats * F.col("source_size")).cast("double"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "sno")
    earlier, everything = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = rows.withColumn("mass", share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)))
    rows = rows.withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))
    level = F.col("mass") / F.col("open")
    fits = F.when(level <= F.col("cap") / F.col("weight"), F.struct(F.row_number().over(by_level).alias("nth"), level.alias("level")))
    rows = rows.withColumn("fits", fits).withColumn("level", F.min("fits").over(everything)["level"])
    target = F.least("cap", F.coalesce(F.col("level"), F.lit(math.inf)) * F.col("weight"))
    return rows.select("sno", "source", "source_size", "source_rows", target.alias("target"), F.floor(target + 0.5).alias("quota"))


def block_stream(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Every document with its source's numbers and ``start``, its place in the source's stream of words.

    The stream is in order of the digest. Rows of one digest are alike, and may be many: they are numbered inside the runs of rows
    (``row`` has the run in its upper bits) in which the sized table was written, and the runs' totals give the places.
    """
    rows = sized.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("run", F.shiftright("row", 33))
    kinds = rows.groupBy("sno", "digest", "run").agg(F.sum("size").alias("words"), F.max("source_rows").alias("source_rows"))
    # about the square root of the source's rows in buckets, each a range of the digest, so that a large source spreads
    buckets = F.ceil(F.sqrt("source_rows"))
    kinds = kinds.withColumn("bucket", F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("double") * buckets / 2**32))
    placed = running_total(kinds, {"first": "words"}, "bucket", ["digest", "run"], ["sno"]).select("sno", "digest", "run", "first")
    nth = F.row_number().over(Window.partitionBy("sno", "digest", "run").orderBy("row")) - 1
    rows = rows.withColumn("nth", nth).join(placed, ["sno", "digest", "run"])
    return rows.withColumn("start", F.col("first") + F.col("nth") * F.col("size")).drop("run", "nth", "first")


def reads(stream: DataFrame, repeats: int) -> DataFrame:
    """One row for each time that a document is read: its place [low, high) in the stream, as far as the quota reaches."""
    low = F.explode(F.array(*[F.col("start") + i * F.col("source_size") for i in range(repeats)]))
    again = stream.filter("size > 0").withColumn("low", low)
    return again.withColumn("high", F.least(F.col("low") + F.col("size"), F.col("quota"))).filter("low < high")


def pieces(stream: DataFrame, block: int, repeats: int) -> DataFrame:
    """The part of each document in each block that its source's quota reaches: sno, start, size, rank, words."""
    cut = reads(stream, repeats).select("*", F.explode(F.sequence(F.expr(f"low div {block}"), F.expr(f"(high - 1) div {block}"))).alias("rank"))
    words = F.least(F.col("high"), (F.col("rank") + 1) * block) - F.greatest(F.col("low"), F.col("rank") * block)
    return cut.select("sno", "start", "size", "rank", words.alias("words"))


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """sno, rank, slot: which slot of the mix takes which block of which source.

    The sources' blocks lie end to end on a line of n blocks; the point of slot n falls into one source's stretch.
    The stretches are cut into cells of equal width, so the lookup is an equality join. Ranks are numbered in two
    levels over chunks of slots. A rank at or beyond the source's number of blocks is an unused slot.
    """
    line = sources.select("sno", F.ceil(F.col("quota") / block).alias("blocks"))
    line = line.withColumn("high", F.sum("blocks").over(Window.orderBy("sno"))).withColumn("low", F.col("high") - F.col("blocks"))
    n = int(line.agg(F.coalesce(F.max("high"), F.lit(0))).first()[0])
    width, chunk = max(1, math.ceil(n / 1024)), max(1, math.isqrt(n))
    stretches = line.filter("blocks > 0").select("*", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"(high - 1) div {width}"))).alias("cell"))
    far, near = F.shiftright("id", FAR_BITS), F.col("id").bitwiseAND(2**FAR_BITS - 1)
    point = far * F.lit(FAR_STEP) - F.floor(far * F.lit(FAR_STEP)) + (near + 0.5) * F.lit(STEP)
    slots = sources.sparkSession.range(n).withColumn("position", F.floor((point - F.floor(point)) * n))
    slots = slots.withColumn("cell", F.expr(f"position div {width}")).withColumn("chunk", F.expr(f"id div {chunk}"))
    hit = slots.join(stretches, "cell").filter("low <= position and position < high").select("sno", "chunk", F.col("id").alias("slot"), "blocks")
    ranked = running_total(hit, {"rank": F.lit(1).cast("long")}, "chunk", ["slot"], ["sno"])
    return ranked.filter("rank < blocks").select("sno", "rank", "slot")


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2, block: int = 1024
) -> tuple[DataFrame, DataFrame]:
    """The documents with their place in their source's stream, and the mix itself.

    The mix has one row per piece: slot, sno, rank, start and size (which name the document in the first result) and
    words. Where the schedule ran out before a source had all its blocks, the missing ones follow at the end of it,
    in slots from the number of slots on, so every source gets its quota to the word.
    """
    sized = keep(sized_documents(docs))  # the regular expression is the dear part
    sources = keep(source_targets(sized, weights, share, repeats))
    stream = block_stream(sized, sources)
    return stream, with_slots(pieces(stream, block, repeats), sources, block).drop("slots")


def with_slots(rows: DataFrame, sources: DataFrame, block: int) -> DataFrame:
    """Add slot, the place in the mix of the block ``rank`` of the source ``sno``, and slots, that of its last one at most."""
    line = sources.select("sno", F.ceil(F.col("quota") / block).alias("blocks"))
    n, before = F.sum("blocks").over(Window.partitionBy()), F.sum("blocks").over(Window.orderBy("sno")) - F.col("blocks")
    line = line.select("sno", (n + before).alias("tail"), (2 * n).alias("slots"))
    found = rows.join(schedule(sources, block), ["sno", "rank"], "left").join(F.broadcast(line), "sno")
    return found.withColumn("slot", F.coalesce("slot", F.col("tail") + F.col("rank"))).drop("tail")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken (words that the mix takes, repeats counted), first_slot (-1: none)."""
    stream, mix = mix_sources(docs, **how)
    taken = mix.groupBy("sno", "start", "size").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    rows = stream.select("sno", "start", "size", "doc_id", "source_size", "target").join(taken, ["sno", "start", "size"], "left")
    return rows.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0).cast("long")).alias("taken"),
        F.coalesce("first_slot", F.lit(-1).cast("long")).alias("first_slot"),
    )


def mixed_texts(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2, block: int = 1024) -> DataFrame:
    """The documents in the order of the mix, all columns: one row for each time a document is read, none if it is not.

    A read stands where the schedule puts the block in which it begins; those that begin in one block follow each other as in the
    source's stream. The read at which a source's quota ends has the text's first words only. Every partition is a run of
    slots, in order. The schedule is made on row numbers (set once and written); texts move twice, to their numbers
    and to their slots.
    """
    columns = docs.columns
    numbered = keep(sized_documents(docs.select("doc_id", "source", "text", F.struct(*columns).alias("rest")), "rest"))
    sized = numbered.drop("rest")
    sources = keep(source_targets(sized, weights, share, repeats))
    read = reads(block_stream(sized, sources), repeats).withColumn("rank", F.expr(f"low div {block}"))
    read = with_slots(read, sources, block).select("row", "slot", "slots", "sno", "low", (F.col("high") - F.col("low")).cast("int").alias("words"), "size")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = numbered.select("row", "rest").join(read.drop("slots"), "row").repartitionByRange(parts, "slot", "sno", "low")
    rows = rows.sortWithinPartitions("slot", "sno", "low")
    stretch = F.regexp_extract_all("rest.text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.when(F.col("words") < F.col("size"), F.array_join(F.slice(stretch, 1, F.col("words")), "")).otherwise(F.col("rest.text"))
    return rows.select(*[(cut if c == "text" else F.col(f"rest.`{c}`")).alias(c) for c in columns])
