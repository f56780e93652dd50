"""Queries of folds, metrics, waveforms, features, results and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import features, folds, joins, labels, metrics, results, signals
from .fixtures import ENTRIES, EVENT_WAVES, PREDICTIONS, WAVES, digest, digest_sql, encoded, event_signals, named, predictions, table, waves

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


# ---- folds and splits

def _evenness(folds_: DataFrame, unit: DataFrame, key: str, most: int) -> DataFrame:
    """What holds of any right dealing: the folds' sizes, from the largest, and that no label's counts differ by more than ``most``.

    ``unit`` has key, labels (a record's distinct ones, or all of a patient's records) and weight (records).
    """
    rows = folds_.join(unit, key)
    sizes = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    sizes = sizes.select(F.lit("size").alias("kind"), (F.row_number().over(Window.orderBy(F.desc("n"), "fold")) - 1).cast("long").alias("id"), "n", F.lit(True).alias("even"))
    per = rows.select("fold", F.explode("labels").alias("id")).groupBy("id").pivot("fold", list(range(10))).agg(F.count(F.lit(1))).fillna(0)
    cells = F.array(*[F.col(str(f)) for f in range(10)])
    total = F.aggregate(cells, F.lit(0).cast("long"), lambda a, x: a + x)
    return sizes.unionByName(per.select(F.lit("label").alias("kind"), F.col("id").cast("long").alias("id"), total.alias("n"), (F.array_max(cells) - F.array_min(cells) <= most).alias("even")))


@query(f"""WITH {ENTRIES}, once AS (SELECT DISTINCT record_id, label FROM entries), n AS (SELECT count(*) AS n FROM orders)
SELECT 'size' AS kind, f::BIGINT AS id, (n // 10 + (CASE WHEN f < n % 10 THEN 1 ELSE 0 END))::BIGINT AS n, true AS even FROM n, range(0, 10) r(f)
UNION ALL SELECT 'label', label::BIGINT, count(*), true FROM once GROUP BY 2""")
def stratify_records(spark: SparkSession, d: str) -> DataFrame:
    rows = encoded(spark, d)
    dealt = folds.stratify_records(rows, 10)
    return _evenness(dealt, rows.select("record_id", F.array_distinct("encoded").alias("labels"), F.lit(1).alias("weight")), "record_id", 3)


@query(f"""WITH {ENTRIES}, once AS (SELECT DISTINCT pid, record_id, label FROM entries), n AS (SELECT count(DISTINCT o_custkey) AS n, count(*) AS w FROM orders)
SELECT 'patients' AS kind, 0::BIGINT AS id, n::BIGINT AS n, true AS even FROM n UNION ALL SELECT 'records', 0, w, true FROM n
UNION ALL SELECT 'label', label::BIGINT, count(*), true FROM once GROUP BY 2""")
def stratify_patients(spark: SparkSession, d: str) -> DataFrame:
    """As above, but sizes are records: neither they nor any label's counts differ between two folds by more than the largest patient has records."""
    rows = encoded(spark, d)
    unit = rows.groupBy("pid").agg(F.flatten(F.collect_list(F.array_distinct("encoded"))).alias("labels"), F.count(F.lit(1)).alias("weight"))
    dealt = folds.stratify_patients(rows, 10).join(unit, "pid")
    sizes = dealt.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"), F.max("weight").alias("most"))
    whole = sizes.agg(F.sum("n").alias("n"), F.sum("w").alias("w"), (F.max("w") - F.min("w") <= F.max("most")).alias("even"))
    row = lambda kind, n, even: whole.select(F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("id"), F.col(n).alias("n"), even.alias("even"))
    per = dealt.select("fold", F.explode("labels").alias("id")).groupBy("id").pivot("fold", list(range(10))).agg(F.count(F.lit(1))).fillna(0)
    cells = F.array(*[F.col(str(f)) for f in range(10)])
    total = F.aggregate(cells, F.lit(0).cast("long"), lambda a, x: a + x)
    per = per.crossJoin(F.broadcast(sizes.agg(F.max("most").alias("most"))))
    even = F.array_max(cells) - F.array_min(cells) <= F.col("most")
    return row("patients", "n", F.lit(True)).unionByName(row("records", "w", F.col("even"))).unionByName(per.select(F.lit("label").alias("kind"), F.col("id").cast("long").alias("id"), total.alias("n"), even.alias("even")))


@query(f"WITH {ENTRIES} SELECT o_custkey AS pid, coalesce((SELECT string_agg(label::VARCHAR, '|' ORDER BY label) FROM entries e WHERE e.pid = o_custkey), '') AS labels, count(*) AS n_records FROM orders GROUP BY 1")
def patient_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = folds.patient_labels(encoded(spark, d))
    return rows.withColumn("labels", F.array_join(F.transform("labels", lambda x: x.cast("string")), "|"))


_FOLDS = "f AS (SELECT o_orderkey AS record_id, CASE WHEN o_custkey % 13 = 0 THEN -1 ELSE o_custkey % 10 END AS fold FROM orders)"


def _folds(spark: SparkSession, d: str) -> DataFrame:
    fold = F.when(F.col("o_custkey") % 13 == 0, -1).otherwise(F.col("o_custkey") % 10)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), fold.alias("fold"))


@query(f"""WITH {_FOLDS}, s AS (SELECT count(*) FILTER (fold < 8) AS train_size, count(*) FILTER (fold = 8) AS val_size, count(*) FILTER (fold = 9) AS test_size FROM f)
SELECT fold, count(*) AS n, train_size, val_size, test_size FROM f, s GROUP BY ALL""")
def fold_summary(spark: SparkSession, d: str) -> DataFrame:
    return folds.fold_summary(_folds(spark, d))


@query(f"WITH {_FOLDS} SELECT record_id, fold, CASE WHEN fold < 0 THEN NULL WHEN fold = 9 THEN 'test' WHEN fold = 8 THEN 'val' ELSE 'train' END AS split FROM f")
def auto_split(spark: SparkSession, d: str) -> DataFrame:
    return folds.auto_split(_folds(spark, d))


@query("""WITH r AS (SELECT doc_id AS filepath, CASE WHEN quality = 1 AND toxic = 0 THEN 1 WHEN toxic = 1 AND quality = 0 THEN 0 END AS flag FROM labels),
  n AS (SELECT least(100, count_if(flag = 1), count_if(flag = 0)) AS n FROM r)
SELECT filepath, flag FROM r, n WHERE flag IS NOT NULL QUALIFY row_number() OVER (PARTITION BY flag ORDER BY md5('3:' || filepath), filepath) <= n""")
def balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").select(F.col("doc_id").alias("filepath"), (F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b"))
    return folds.balanced_sample(rows, "a", "b", 100, 3)


# ---- metrics

_COUNTS = f"""{PREDICTIONS}, c AS (SELECT class_idx, score, sum(target) AS pos, sum(1 - target) AS neg FROM preds GROUP BY 1, 2),
  r AS (SELECT *, coalesce(sum(pos) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pb, coalesce(sum(neg) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb
    FROM c WINDOW w AS (PARTITION BY class_idx ORDER BY score)),
  auc AS (SELECT class_idx, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (nb + neg / 2.0::DOUBLE)) / sum(pos) / sum(neg) END AS auroc FROM r GROUP BY 1),
  t AS (SELECT class_idx, sum(pos) AS p, sum(pos + neg) AS a FROM c GROUP BY 1),
  ap AS (SELECT class_idx, CASE WHEN max(p) > 0 THEN sum(pos * (p - pb)::DOUBLE / (a - pb - nb)) / max(p) END AS auprc FROM r JOIN t USING (class_idx) GROUP BY 1),
  pool AS (SELECT score, sum(pos) AS pos, sum(neg) AS neg FROM c JOIN auc USING (class_idx) WHERE auroc IS NOT NULL GROUP BY 1),
  micro AS (SELECT sum(pos * (nb + neg / 2.0::DOUBLE)) / sum(pos) / sum(neg) AS v FROM (
    SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM pool)),
  f AS (SELECT class_idx, coalesce(2 * sum(pos) FILTER (score >= 0.5) / nullif(2.0::DOUBLE * coalesce(sum(pos) FILTER (score >= 0.5), 0)
    + coalesce(sum(neg) FILTER (score >= 0.5), 0) + coalesce(sum(pos) FILTER (score < 0.5), 0), 0), 0) AS f1 FROM c GROUP BY 1)"""


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query(f"WITH {_COUNTS} SELECT class_idx, round(auroc, 9) AS auroc FROM auc")
def auroc_per_class(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.auroc_per_class(predictions(spark, d)), "auroc")


@query(f"WITH {_COUNTS} SELECT round(avg(auroc), 9) AS auroc_macro FROM auc")
def auroc_macro(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.auroc_macro(predictions(spark, d)), "auroc_macro")


@query(f"WITH {_COUNTS} SELECT round(v, 9) AS auroc_micro FROM micro")
def auroc_micro(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.auroc_micro(predictions(spark, d)), "auroc_micro")


@query(f"WITH {_COUNTS} SELECT class_idx, round(auprc, 9) AS auprc FROM ap")
def auprc_per_class(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.auprc_per_class(predictions(spark, d)), "auprc")


@query(f"WITH {_COUNTS} SELECT round(avg(coalesce(auprc, 0)), 9) AS auprc_macro FROM ap")
def auprc_macro(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.auprc_macro(predictions(spark, d)), "auprc_macro")


@query(f"WITH {_COUNTS} SELECT round(avg(f1), 9) AS f1_macro FROM f")
def f1_macro(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.f1_macro(predictions(spark, d)), "f1_macro")


@query(f"""WITH {_COUNTS} SELECT metric, round(value, 9) AS value FROM (SELECT 'auroc_macro' AS metric, avg(auroc) AS value FROM auc UNION ALL SELECT 'auroc_micro', v FROM micro
UNION ALL SELECT 'auprc_macro', avg(coalesce(auprc, 0)) FROM ap UNION ALL SELECT 'f1_macro', avg(f1) FROM f
UNION ALL SELECT CASE class_idx WHEN 0 THEN 'auroc_quality' ELSE 'auroc_toxic' END, auroc FROM auc)""")
def evaluate_all(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([(0, "quality"), (1, "toxic")], "class_idx int, name string")
    return _rounded(metrics.evaluate_all(predictions(spark, d), names), "value")


@query("""SELECT avg(CASE WHEN list_position(t, list_max(t)) = list_position(s, list_max(s)) THEN 1.0 ELSE 0.0 END)::DOUBLE AS accuracy FROM (
  SELECT [quality, toxic]::DOUBLE[] AS t, [(n_chars % 97) / 97.0::DOUBLE, (n_chars % 89) / 97.0::DOUBLE] AS s FROM labels JOIN documents USING (doc_id))""")
def argmax_accuracy(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    number = lambda c: F.col(c).cast("double")
    return metrics.argmax_accuracy(rows.select(F.array(number("quality"), number("toxic")).alias("targets"), F.array(F.col("n_chars") % 97 / 97, F.col("n_chars") % 89 / 97).alias("scores")))


_WINDOWS = """w AS (SELECT conv_id AS ecg_id, 0 AS class_idx, turn AS "window", (conv_id + turn) % 2 AS target, (len(text) % 101) / 101.0::DOUBLE AS score FROM conversations)"""


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("ecg_id"), F.lit(0).alias("class_idx"), F.col("turn").alias("window"), ((F.col("conv_id") + F.col("turn")) % 2).alias("target"), (F.length("text") % 101 / 101).alias("score")
    )


@query(f'WITH {_WINDOWS} SELECT ecg_id, class_idx, min_by(target, "window") AS target, round(avg(score), 9) AS score FROM w GROUP BY 1, 2')
def aggregate_predictions(spark: SparkSession, d: str) -> DataFrame:
    rows = _windows(spark, d)
    return _rounded(metrics.aggregate_predictions(rows.unionByName(rows.filter("ecg_id % 7 = 0"))), "score")


@query(f'WITH {_WINDOWS} SELECT ecg_id, "window", target FROM w')
def union_predictions(spark: SparkSession, d: str) -> DataFrame:
    rows = _windows(spark, d).select("ecg_id", "window", "target")
    pad = rows.filter("window = 0").withColumn("ecg_id", F.lit(-1).cast("long"))
    return joins.union_predictions(rows.filter("ecg_id % 2 = 0").unionByName(pad), rows.filter("ecg_id % 2 = 1"))


# ---- waveforms


@query("SELECT conv_id AS record_id, unnest(range(0, max(turn) + 1))::INTEGER AS seg_idx FROM conversations GROUP BY 1")
def expand_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("record_id")).agg((F.max("turn") + 1).alias("seg_len"))
    return signals.expand_segments(rows, all_segments=True).select("record_id", "seg_idx")


def _shown(wave: str, signal: str, *keys: str, more: str = "") -> str:
    columns = ", ".join(keys or ("record_id",))
    return f"WITH {wave}, y AS (SELECT {columns}, {signal} AS signal FROM waves {more}) " + digest_sql("y", *(keys or ("record_id",)))


@query(_shown(WAVES, "list_transform(range(1, 5), lambda k: list_transform(range(1, 17), lambda t: signal[k][t]))"))
def to_lead_major(spark: SparkSession, d: str) -> DataFrame:
    rows = waves(spark, d)
    turned = rows.withColumn("signal", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: F.transform("signal", lambda lead: F.get(lead, t))))
    return digest(signals.to_lead_major(turned, "samples"), "record_id")


@query(f"""WITH {WAVES}, grid AS (SELECT i, j, j / 25.0::DOUBLE - i / 16.0::DOUBLE AS t FROM range(0, 16) a(i), range(0, 25) b(j)),
  kernel AS (SELECT i, sum((j + 1) * (1 + 2 * list_sum(list_transform(range(1, 8), lambda k: cos(2 * pi() * k * t))) + cos(16 * pi() * t)) / 16) AS w FROM grid GROUP BY i)
SELECT record_id, (l - 1)::INTEGER AS lead, 25 AS n, round(sum(signal[l][i + 1] * w), 5) AS total FROM waves, range(1, 5) s(l), kernel GROUP BY 1, 2""")
def fourier_resample(spark: SparkSession, d: str) -> DataFrame:
    return digest(signals.fourier_resample(waves(spark, d), 25), "record_id")


@query(f"""WITH {WAVES}, e AS (SELECT record_id, k - 1 AS lead, signal[k] AS x, i, greatest(0, (i + 0.5::DOUBLE) * 16 / 40 - 0.5) AS src
  FROM waves, (SELECT unnest(range(1, 5))::INTEGER AS k), (SELECT unnest(range(0, 40)) AS i)),
  v AS (SELECT *, floor(src)::INTEGER AS j FROM e)
SELECT record_id, lead::INTEGER AS lead, 40 AS n, round(sum((i + 1) * (x[j + 1] * (1 - (src - j)) + x[least(j + 2, 16)] * (src - j))), 5) AS total FROM v GROUP BY 1, 2""")
def linear_resample(spark: SparkSession, d: str) -> DataFrame:
    return digest(signals.linear_resample(waves(spark, d), 40), "record_id")


_EVENT_LEADS = f"{EVENT_WAVES}, numbered AS (SELECT record_id, (row_number() OVER (PARTITION BY record_id ORDER BY lead) - 1)::INTEGER AS lead, x FROM event_waves)"
_WSUM = "round(coalesce(list_sum(list_transform(range(1, len(x) + 1), lambda i: x[i] * i)), 0), 5)"


@query(f"WITH {_EVENT_LEADS}, c AS (SELECT record_id, lead, x[1:12] AS x FROM numbered) SELECT record_id, lead, 12 AS n, {_WSUM} AS total FROM c")
def adjust_length(spark: SparkSession, d: str) -> DataFrame:
    return digest(signals.adjust_length(event_signals(spark, d), 12), "record_id")


@query(f"WITH {WAVES}, y AS (SELECT record_id, c::INTEGER AS chunk_idx, list_transform(signal, lambda x: x[c * 5 + 1 : c * 5 + 5]) AS signal FROM waves, range(0, 3) r(c)) " + digest_sql("y", "record_id", "chunk_idx"))
def fixed_windows(spark: SparkSession, d: str) -> DataFrame:
    return digest(signals.fixed_windows(waves(spark, d), 16, 5), "record_id", "chunk_idx")


@query(f"""WITH {WAVES}, o AS (SELECT *, (('0x' || substr(md5('7:2:' || record_id), 1, 12))::BIGINT % 12)::INTEGER AS "offset" FROM waves),
  y AS (SELECT record_id, "offset", list_transform(signal, lambda x: x["offset" + 1 : "offset" + 5]) AS signal FROM o) """ + digest_sql("y", "record_id", '"offset"'))
def random_window(spark: SparkSession, d: str) -> DataFrame:
    return digest(signals.random_window(waves(spark, d), 16, 5, epoch=2, seed=7), "record_id", "offset")


@query("""SELECT c_name AS model, n_name AS task, CASE WHEN round_even((c_custkey % 21 + 0.5) * (n_nationkey + 1), 0) < 200 THEN round_even((c_custkey % 21 + 0.5) * (n_nationkey + 1), 0)::INTEGER ELSE -1 END AS chunk FROM customer, nation WHERE c_custkey >= 0""")
def chunk_length(spark: SparkSession, d: str) -> DataFrame:
    models = table(spark, d, "customer").select(F.col("c_name").alias("model"), (F.col("c_custkey") % 21 + 0.5).alias("chunk_seconds"))
    tasks = table(spark, d, "nation").select(F.col("n_name").alias("task"), (F.col("n_nationkey") + 1).alias("target_fs"), F.lit(200).alias("target_length"))
    return signals.chunk_length(models, tasks).withColumn("chunk", F.coalesce("chunk", F.lit(-1)))


@query(_shown(WAVES, "list_transform(range(1, 5), lambda k: list_transform(signal[k], lambda x: (x - k * 0.1::DOUBLE) / (k * 0.5::DOUBLE + 1e-8)))"))
def zscore(spark: SparkSession, d: str) -> DataFrame:
    return digest(signals.zscore(waves(spark, d), [k * 0.1 for k in range(1, 5)], [k * 0.5 for k in range(1, 5)]), "record_id")


@query(_shown(WAVES, "list_transform(signal, lambda x: list_transform(x, lambda v: CASE WHEN v < 0 THEN 0 ELSE v END))"))
def fill_nan(spark: SparkSession, d: str) -> DataFrame:
    holes = waves(spark, d).withColumn("signal", F.transform("signal", lambda x: F.transform(x, lambda v: F.when(v < 0, float("nan")).otherwise(v))))
    return digest(signals.fill_nan(holes), "record_id")


@query(_shown(WAVES, "CASE WHEN record_id % 2 = 0 THEN list_transform([1, 2, 7, 8, 9, 10, 11, 12], lambda i: signal[(i - 1) % 4 + 1]) ELSE signal END"))
def select_leads(spark: SparkSession, d: str) -> DataFrame:
    rows = waves(spark, d)
    twelve = rows.withColumn("signal", F.when(F.col("record_id") % 2 == 0, F.concat("signal", "signal", "signal")).otherwise(F.col("signal")))
    return digest(signals.select_leads(twelve), "record_id")


@query(f"""WITH {WAVES}, f AS (SELECT * FROM waves ORDER BY record_id LIMIT 5000),
  l AS (SELECT lead::INTEGER AS lead, signal[lead + 1] AS x FROM (SELECT signal, unnest(range(0, 4)) AS lead FROM f)),
  m AS (SELECT lead, list_sum(x) / len(x) AS m, list_sum(list_transform(x, lambda v: v * v)) / len(x) AS q FROM l)
SELECT lead, round(avg(m), 9) AS mean, round(sqrt(avg(q) - avg(m) * avg(m)), 9) AS std FROM m GROUP BY 1""")
def lead_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(signals.lead_stats(waves(spark, d)), "mean", "std")


@query(f"""WITH {WAVES}, r AS (SELECT record_id, signal, CASE WHEN record_id % 3 <> 0 THEN label ELSE 0 END AS label FROM waves JOIN embeddings ON vec_id = record_id WHERE record_id % 10 IN (1, 2)),
  y AS (SELECT record_id, c::INTEGER AS chunk_idx, label, list_transform(range(1, 5), lambda k: list_transform(list_concat(signal[k], [0.0, 0.0, 0.0, 0.0])[c * 10 + 1 : c * 10 + 10],
    lambda v: CASE WHEN v < -1 THEN 0 ELSE (v - 0.1::DOUBLE) / (0.5::DOUBLE + 1e-8) END)) AS signal FROM r, range(0, 2) t(c)) """ + digest_sql("y", "record_id", "chunk_idx", "label"))
def prepare_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("record_id"), "label", (F.col("vec_id") % 10).alias("fold"))
    target = rows.filter("record_id % 3 <> 0").select("record_id", F.array(F.col("label").cast("double")).alias("labels"))  # a third is unlabelled
    holes = waves(spark, d).withColumn("signal", F.transform("signal", lambda x: F.transform(x, lambda v: F.when(v < -1, float("nan")).otherwise(v))))
    out = signals.prepare_windows(rows.select("record_id", "fold"), holes, target, target_fs=16, length=20, chunk=10, mean=[0.1] * 4, std=[0.5] * 4, fold_col="fold", folds=[1, 2])
    return digest(out.withColumn("label", F.col("labels")[0].cast("int")), "record_id", "chunk_idx", "label")


# ---- features


@query(f"""WITH {WAVES}, s AS (SELECT record_id, list_transform(signal, lambda x: list_sum(x) / 16) AS pooled FROM waves)
SELECT record_id, i::INTEGER AS dim, round(pooled[i + 1], 6) AS value, 4 AS steps FROM s, range(0, 4) r(i)""")
def encode_windows(spark: SparkSession, d: str) -> DataFrame:
    def make():
        return lambda batch: [(x, x.mean(axis=1)) for x in batch]  # sequences (4 x 16), and pooled vectors of 4

    rows = features.encode_windows(waves(spark, d).withColumn("signal", F.transform("signal", lambda x: F.slice(x, 1, 16))), make, 16, ("record_id",))
    return rows.select("record_id", F.size("seq").alias("steps"), F.posexplode("pooled").alias("dim", "value")).withColumn("value", F.round("value", 6))


@query(f"WITH {WAVES} SELECT record_id, t::INTEGER AS dim, round((signal[1][t + 1] + signal[2][t + 1] + signal[3][t + 1] + signal[4][t + 1]) / 4, 9) AS value FROM waves, range(0, 16) r(t)")
def mean_pool(spark: SparkSession, d: str) -> DataFrame:
    rows = features.mean_pool(waves(spark, d), "signal").select("record_id", F.posexplode("pooled").alias("dim", "value"))
    return _rounded(rows, "value")


_WEIGHTS = [[((7 * c + 3 * i) % 11 - 5) / 10 for i in range(64)] for c in range(3)]
_SCORED = "x AS (SELECT vec_id AS ecg_id, label, c::INTEGER AS class_idx, list_sum(list_transform(range(0, 64), lambda i: embedding[i + 1]::DOUBLE * (((7 * c + 3 * i) % 11 - 5) / 10.0::DOUBLE))) + c * 0.1::DOUBLE AS logit FROM embeddings, range(0, 3) r(c))"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return features.linear_score(table(spark, d, "embeddings"), _WEIGHTS, [0.0, 0.1, 0.2], "embedding")


@query(f"WITH {_SCORED} SELECT ecg_id, class_idx, round(1 / (1 + exp(-logit)), 9) AS score FROM x")
def linear_score(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_scored(spark, d).select(F.col("vec_id").alias("ecg_id"), F.posexplode("scores").alias("class_idx", "score")), "score")


@query(f"WITH {_SCORED} SELECT round(avg(greatest(logit, 0) - logit * (CASE WHEN label = class_idx THEN 1 ELSE 0 END) + ln(1 + exp(-abs(logit)))), 9) AS loss FROM x")
def bce_loss(spark: SparkSession, d: str) -> DataFrame:
    targets = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda c: (F.col("label") == c).cast("int"))
    return _rounded(features.bce_loss(_scored(spark, d).withColumn("targets", targets)), "loss")


@query("""WITH x AS (SELECT label, list_concat([1.0::DOUBLE], list_transform(embedding, lambda v: v::DOUBLE)) AS e FROM embeddings WHERE vec_id % 5 <> 0)
SELECT c::INTEGER AS class_idx, d::INTEGER AS dim, round(avg(CASE WHEN label = c THEN e[d + 1] ELSE 0 END), 4) + 0.0 AS moment, true AS best FROM x, range(0, 3) k(c), range(0, 65) r(d) GROUP BY 1, 2""")
def linear_probe_fit(spark: SparkSession, d: str) -> DataFrame:
    """What holds at the optimum and nowhere else: the scores' moments with each feature (dim 0: the bias), plus penalty times weight, are the labels'."""
    targets = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda c: (F.col("label") == c).cast("int"))
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("ecg_id"), F.col("embedding").alias("pooled"), targets.alias("targets"))
    train, grid = rows.filter("ecg_id % 5 <> 0"), ((0.003, 100), (0.03, 100), (0.3, 100))
    weights, bias, scores = features.linear_probe_fit(train, rows.filter("ecg_id % 5 = 0"), 3, grid, tolerance=1e-9)
    order = scores.orderBy(F.desc_nulls_last("auroc_macro"), "candidate").first()
    own = spark.createDataFrame([(c, i, float(w)) for c in range(3) for i, w in enumerate([0.0, *weights[c]])], "class_idx int, dim int, weight double")
    scored = features.linear_score(train, weights, bias).select("ecg_id", "pooled", F.posexplode("scores").alias("class_idx", "score"))
    each = scored.select("class_idx", "score", F.posexplode(F.concat(F.array(F.lit(1.0)), F.transform("pooled", lambda v: v.cast("double")))).alias("dim", "x"))
    sums = each.groupBy("class_idx", "dim").agg(F.avg(F.col("score") * F.col("x")).alias("m"))
    moment = F.round(F.col("m") + grid[order["candidate"]][0] * F.col("weight"), 4) + F.lit(0.0)
    best = scores.agg(F.max("auroc_macro")).first()[0] == order["auroc_macro"]
    return sums.join(own, ["class_idx", "dim"]).select("class_idx", "dim", moment.alias("moment"), F.lit(best).alias("best"))


# ---- results and checks

_RUNS = """runs AS (SELECT c_mktsegment || '/' || n_name AS experiment, o_orderkey AS epoch, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE floor(o_totalprice / 1000) END AS val_auroc_macro
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def _runs(spark: SparkSession, d: str) -> DataFrame:
    customer = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = table(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    value = F.when(F.col("o_orderkey") % 9 == 0, float("nan")).otherwise(F.floor(F.col("o_totalprice") / 1000).cast("double"))
    return rows.select(F.concat_ws("/", "c_mktsegment", "n_name").alias("experiment"), F.col("o_orderkey").alias("epoch"), value.alias("val_auroc_macro"))


@query(f"WITH {_RUNS} SELECT * FROM runs WHERE val_auroc_macro IS NOT NULL QUALIFY row_number() OVER (PARTITION BY experiment ORDER BY val_auroc_macro DESC, epoch) = 1")
def best_epoch(spark: SparkSession, d: str) -> DataFrame:
    return results.best_epoch(_runs(spark, d))


_PARTS = """parts AS (SELECT c_mktsegment AS model, n_name AS task, o_orderstatus AS mode, CASE WHEN o_orderpriority < '2' THEN 'test' ELSE 'val' END AS part,
  CASE WHEN n_nationkey = 3 AND o_orderpriority < '2' THEN NULL ELSE max(o_totalprice) END AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3, 4, n_nationkey, o_orderpriority < '2')"""
_MODELS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query(f"WITH {_PARTS}, b AS (SELECT mode, task, model, CASE WHEN count_if(part = 'test') > 0 THEN max(v) FILTER (part = 'test') ELSE max(v) END AS v FROM parts GROUP BY 1, 2, 3) SELECT mode, task, " + ", ".join(f"max(v) FILTER (model = '{m}') AS \"{m}\"" for m in _MODELS) + " FROM b GROUP BY 1, 2")
def summary_pivot(spark: SparkSession, d: str) -> DataFrame:
    customer = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = table(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(F.col("c_mktsegment").alias("model"), F.col("n_name").alias("task"), F.col("o_orderstatus").alias("mode"), F.when(F.col("o_orderpriority") < "2", "test").otherwise("val").alias("part"), "n_nationkey", "o_totalprice")
    rows = rows.groupBy("model", "task", "mode", "part", "n_nationkey").agg(F.max("o_totalprice").alias("v"))
    value = F.when(~((F.col("n_nationkey") == 3) & (F.col("part") == "test")), F.col("v"))
    return results.summary_pivot(rows.withColumn("auroc_macro", value), list(_MODELS))


@query("SELECT o_orderpriority AS split, count(*) AS n_meta, count_if(o_orderkey % 50 <> 7 OR o_orderpriority > '3')::BIGINT AS n_waves FROM orders GROUP BY 1 HAVING count(*) <> count_if(o_orderkey % 50 <> 7 OR o_orderpriority > '3')")
def check_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("split"), "o_orderkey")
    return joins.check_counts(rows, rows.filter("o_orderkey % 50 <> 7 or split > '3'"))


@query("SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS record_id, count(DISTINCT event_type)::INTEGER AS n_leads FROM events GROUP BY 1 HAVING count(DISTINCT event_type) <> 5")
def check_leads(spark: SparkSession, d: str) -> DataFrame:
    day = F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    rows = table(spark, d, "events").groupBy(day.alias("record_id")).agg(F.collect_set("event_type").alias("signal"))
    return joins.check_leads(rows, 5)


@query("SELECT count(l.doc_id) AS n_a, count(d.doc_id) AS n_b, count(*) FILTER (d.doc_id IS NULL) AS only_a, count(*) FILTER (l.doc_id IS NULL) AS only_b, count(*) FILTER (l.quality <> d.n_chars % 2) AS differ FROM labels l FULL JOIN documents d ON l.doc_id = d.doc_id")
def check_alignment(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("flag"))
    b = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 2).alias("flag"))
    return joins.check_alignment(a, b, "doc_id")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Which labels pass the minimum count, with their index, their occurrences and the records that carry them."""
    rows = named(spark, d)
    vocab = labels.label_vocab(labels.label_counts(rows), 10)
    records = rows.select("record_id", F.explode(F.array_distinct("names")).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n_records"))
    return vocab.join(records, "label")
