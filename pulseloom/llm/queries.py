"""The registered queries of the training-data operators, and SQL where it can express them.

Each reads its whole table and gives one row per document, piece, or query and rank. What the operators do with nulls, ties,
repeated rows and further columns (their modules say it) holds here too; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_tree, brown_lm, exact_topk, lexical_scan, minhash, mixing, packing, quality, sharding, suffix_dedup, token_counts, toxicity, vectors, whitening
from .labelled import id_crc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op3_source_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its source's size and target and the words that the mix takes of it; a null text has none."""
    return mixing.mixed_documents(_read(spark, sf_dir, "documents"))


OP3_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS digest FROM documents),
named AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS sno
  FROM sized GROUP BY source),
weighed AS (SELECT *, [5.0, 2.0, 1.0][sno % 3 + 1]::DOUBLE AS weight, (2 * source_size)::DOUBLE AS cap FROM named),
levels AS (
  SELECT *, row_number() OVER by_level AS nth,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (by_level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (by_level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed WINDOW by_level AS (ORDER BY cap / weight, sno)),
targets AS (
  SELECT sno, source, source_size, least(cap, weight * (SELECT min_by(level, nth) FROM levels WHERE level <= cap / weight)) AS target
  FROM levels),
quotas AS (SELECT *, floor(target + 0.5)::BIGINT AS quota, ceil(floor(target + 0.5) / 1024)::BIGINT AS blocks FROM targets),
line AS (SELECT *, (sum(blocks) OVER (ORDER BY sno))::BIGINT AS high, (sum(blocks) OVER ())::BIGINT AS n FROM quotas),
points AS (
  SELECT i AS slot, (i >> {mixing.FAR_BITS}) * {mixing.FAR_STEP!r}::DOUBLE AS far,
         ((i & {2**mixing.FAR_BITS - 1}) + 0.5::DOUBLE) * {mixing.STEP!r}::DOUBLE AS near
  FROM range((SELECT coalesce(max(n), 0) FROM line)) t(i)),
hits AS (
  SELECT sno, slot, row_number() OVER (PARTITION BY sno ORDER BY slot) - 1 AS rank
  FROM points JOIN line ON floor(((far - floor(far) + near) - floor(far - floor(far) + near)) * n) >= high - blocks
                       AND floor(((far - floor(far) + near) - floor(far - floor(far) + near)) * n) < high),
stream AS (
  SELECT s.*, l.* EXCLUDE (source), coalesce(sum(size) OVER (PARTITION BY sno ORDER BY digest, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN line l ON s.source IS NOT DISTINCT FROM l.source),
reads AS (
  SELECT sno, start, size, start + e * source_size AS low, least(start + e * source_size + size, quota) AS high
  FROM stream, (VALUES (0), (1)) v(e) WHERE size > 0),
pieces AS (
  SELECT sno, start, size, rank, least(high, (rank + 1) * 1024) - greatest(low, rank * 1024) AS words
  FROM (SELECT *, unnest(range(low // 1024, (high - 1) // 1024 + 1)) AS rank FROM reads WHERE low < high)),
mixed AS (
  SELECT p.sno, start, size, sum(words)::BIGINT AS taken, min(coalesce(h.slot, l.n + l.high - l.blocks + p.rank))::BIGINT AS first_slot
  FROM pieces p JOIN line l ON p.sno = l.sno LEFT JOIN hits h ON h.sno = p.sno AND h.rank = p.rank GROUP BY ALL)
SELECT doc_id, s.size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, coalesce(first_slot, -1)::BIGINT AS first_slot
FROM stream s LEFT JOIN mixed m ON s.sno = m.sno AND s.start = m.start AND s.size = m.size
"""


def op8_prefix_sum_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's shard of near equal bytes and its place there; a null text has no bytes."""
    rows = sharding.shard_by_bytes(_read(spark, sf_dir, "documents"), 24)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every row's tokens and its place; a null or empty text is one piece with the end token."""
    path, pattern = tokenizer()
    return packing.pack_documents(_read(spark, sf_dir, "documents"), path, pattern)


def op5_weak_supervision_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's toxicity; a null or empty text gets the score of a text without words."""
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    scored = toxicity.score_documents(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", (F.pmod(id_crc(), F.lit(3)) == 1).alias("held_out"), "score", "predicted")


def op10_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's quality; a null or empty text gets the curve's value at a difference of 0."""
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    scored = quality.score_documents(docs, quality.fit(docs, labels))
    return scored.select("doc_id", (F.pmod(id_crc(), F.lit(5)) == 0).alias("held_out"), "score", "predicted")


def op1_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's 10 largest integer inner products, ties to the smaller vec_id; rows with an unusable vector or no id take no part."""
    rows = _read(spark, sf_dir, "embeddings")
    whole = F.transform("embedding", lambda x: F.floor(1024 * x.cast("double")).cast("double"))
    usable = rows.filter(vectors.usable()).select("vec_id", whole.alias("embedding"))
    found = exact_topk.exact_topk(usable, F.col("vec_id") % 100 == 0, 10)
    return found.withColumn("score", F.col("score").cast("long"))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""


def op7_kmeans_tree_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's 5 nearest rows found by cosine, ties to the smaller vec_id; rows with an unusable vector or no id take no part."""
    return ann_tree.approximate_topk(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op2_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every row: its least doc_id, or a number below -2^62 if none has an id."""
    return minhash.near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with what its text loses to earlier strings of 100 bytes; a null text is empty."""
    rows = suffix_dedup.suffix_dedup(_read(spark, sf_dir, "documents"), 100, form="digest")
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))


def op6_brown_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's log10 probability; a null or empty text is one end token."""
    docs = _read(spark, sf_dir, "documents")
    held_out = F.pmod(id_crc(), F.lit(7)) == 2
    scored = brown_lm.score_documents(docs, brown_lm.fit(docs.filter(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's tokens by the lower-case word tokenizer, and whether they are over 2048; a null or empty text has none."""
    import public_tokenizers

    rows = token_counts.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return rows.withColumn("over_limit", F.col("n_tokens") > 2048)


def op12_lexical_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's 50 highest-scoring documents; an item without terms has none."""
    return lexical_scan.ranked_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), 50)


def op13_spectrum_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable row's whitened entries on up to 16 components."""
    rows = _read(spark, sf_dir, "embeddings")
    model = whitening.fit(rows, 16)
    shares = F.array(*[F.lit(float(x)) for x in model.values / model.trace]) if len(model.values) else F.lit([]).cast("array<double>")
    each = whitening.whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    return each.select(
        "vec_id", (F.col("_at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("_at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )


OP12_SQL = """
WITH upper_to_lower AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
d AS (SELECT doc_id, row, len(terms)::BIGINT AS n, terms FROM upper_to_lower WHERE len(terms) > 0),
total AS (SELECT count(*)::BIGINT AS docs, coalesce(sum(n), 0)::BIGINT AS words FROM d),
i AS (SELECT item_id, row_number() OVER () AS item, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms FROM benchmark),
asked AS (SELECT item_id, item, unnest(terms) AS term FROM i),
tf AS (SELECT row, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT row, doc_id, n, unnest(terms) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY 1),
gains AS (
  SELECT row, doc_id, term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT
    * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))) AS gain
  FROM tf JOIN df USING (term), total),
scores AS (SELECT item, item_id, row, doc_id, sum(gain)::BIGINT AS score FROM asked JOIN gains USING (term) GROUP BY ALL)
SELECT item_id, (row_number() OVER w)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0
WINDOW w AS (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) QUALIFY row_number() OVER w <= 50
"""


QUERIES = {
    "op1_voronoi_topk": op1_voronoi_topk,
    "op2_dart_minhash": op2_dart_minhash,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op6_brown_class_lm": op6_brown_class_lm,
    "op7_kmeans_tree_ann": op7_kmeans_tree_ann,
    "op5_weak_supervision_toxicity": op5_weak_supervision_toxicity,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_compression_quality": op10_compression_quality,
    "op3_source_schedule": op3_source_schedule,
    "op11_token_counts": op11_token_counts,
    "op12_lexical_scan": op12_lexical_scan,
    "op13_spectrum_whitening": op13_spectrum_whitening,
    "op8_prefix_sum_shards": op8_prefix_sum_shards,
}
ORACLE_SQL = {"op1_voronoi_topk": OP1_SQL, "op3_source_schedule": OP3_SQL, "op12_lexical_scan": OP12_SQL}
