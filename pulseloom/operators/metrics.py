"""Ranking metrics over (ecg_id, class_idx, target, score) rows.

Rows are first counted per (class, score), where ties collapse. Ranks are running totals over these counts in two
levels, so neither a class with very many rows nor the pooled order of all classes is one task's work.

A score that is not a number leaves the area under a curve of its class undefined (null), and all averages with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import running_total
from ..functions.shared import keep


def score_counts(preds: DataFrame) -> DataFrame:
    """class_idx, score, pos, neg."""
    pos = F.col("target").cast("long")
    return preds.groupBy("class_idx", "score").agg(F.sum(pos).alias("pos"), F.sum(1 - pos).alias("neg"))


def ranked_counts(counts: DataFrame, groups: list[str]) -> DataFrame:
    """Add what lies below each score: pos_below, neg_below.

    Buckets are steps of the score's log odds, 64 to a factor of e, so that the small probabilities of a rare label spread as
    the others do; beyond [0, 1] they are steps of the logarithm.
    """
    s, most = F.col("score").cast("double"), F.lit(1e12)
    step = F.when(s <= 0, -2600 - F.least(64 * F.log(1 - s), most)).when(s >= 1, 2600 + F.least(64 * F.log(s), most))
    step = F.floor(F.coalesce(F.nanvl(step.otherwise(F.greatest(F.least(64 * F.log(s / (1 - s)), F.lit(2599.0)), F.lit(-2599.0))), most), most))
    return running_total(counts.withColumn("_step", step), {"pos_below": "pos", "neg_below": "neg"}, "_step", ["score"], groups).drop("_step")


def _auroc() -> Column:
    p, n = F.sum("pos"), F.sum("neg")
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    return F.when((p > 0) & (n > 0) & ~_undefined(), wins / p / n)


def _undefined() -> Column:
    """Whether any score of a group is not a number."""
    return F.coalesce(F.bool_or(F.isnan("score")), F.lit(False))


def _spoilt() -> Column:
    """As ``_undefined``, for a class with rows of both kinds."""
    return _undefined() & (F.sum("pos") > 0) & (F.sum("neg") > 0)


def auroc_per_class(preds: DataFrame) -> DataFrame:
    """class_idx, auroc with ties averaged; null unless there are rows of both kinds."""
    return _auroc_per_class(score_counts(preds)).drop("spoilt")


def _auroc_per_class(counts: DataFrame) -> DataFrame:
    return ranked_counts(counts, ["class_idx"]).groupBy("class_idx").agg(_auroc().alias("auroc"), _spoilt().alias("spoilt"))


def auroc_macro(preds: DataFrame) -> DataFrame:
    """auroc_macro: the mean over the classes where it is defined; null if nowhere."""
    return _auroc_per_class(score_counts(preds)).agg(_mean("auroc").alias("auroc_macro"))


def _mean(value: str | Column) -> Column:
    return F.when(~F.coalesce(F.bool_or("spoilt"), F.lit(False)), F.avg(value))


def auroc_micro(preds: DataFrame) -> DataFrame:
    """auroc_micro: over the rows of all classes that have rows of both kinds, pooled."""
    return _auroc_micro(score_counts(preds))


def _auroc_micro(counts: DataFrame) -> DataFrame:
    both = counts.groupBy("class_idx").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).filter("p > 0 and n > 0")
    pooled = counts.join(both.select("class_idx"), "class_idx").groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return ranked_counts(pooled, []).agg(_auroc().alias("auroc_micro"))


def auprc_per_class(preds: DataFrame) -> DataFrame:
    """class_idx, auprc: average precision over descending distinct scores, not interpolated; null without positives."""
    return _auprc_per_class(score_counts(preds)).drop("spoilt")


def _auprc_per_class(counts: DataFrame) -> DataFrame:
    rows = ranked_counts(counts, ["class_idx"])
    total = counts.groupBy("class_idx").agg(F.sum("pos").alias("p"), F.sum(F.col("pos") + F.col("neg")).alias("all"))
    precision = (F.col("p") - F.col("pos_below")) / (F.col("all") - F.col("pos_below") - F.col("neg_below"))
    found = rows.join(total, "class_idx").groupBy("class_idx").agg(F.max("p").alias("p"), F.sum(F.col("pos") * precision).alias("s"), _undefined().alias("u"))
    spoilt = F.col("u") & (F.col("p") > 0)
    return found.select("class_idx", F.when((F.col("p") > 0) & ~spoilt, F.col("s") / F.col("p")).alias("auprc"), spoilt.alias("spoilt"))


def auprc_macro(preds: DataFrame) -> DataFrame:
    """auprc_macro: the mean over all classes, a class without positives counting 0."""
    return _auprc_per_class(score_counts(preds)).agg(_mean(F.coalesce("auprc", F.lit(0.0))).alias("auprc_macro"))


def f1_per_class(counts: DataFrame, threshold: float) -> DataFrame:
    hit = F.col("score") >= threshold
    tp = F.sum(F.when(hit, F.col("pos")).otherwise(0))
    wrong = F.sum(F.when(hit, F.col("neg")).otherwise(F.col("pos")))
    return counts.groupBy("class_idx").agg(F.coalesce(2 * tp / F.nullif(2 * tp + wrong, F.lit(0)), F.lit(0.0)).alias("f1"))


def f1_macro(preds: DataFrame, threshold: float = 0.5) -> DataFrame:
    """f1_macro: the mean over all classes of 2TP / (2TP + FP + FN), 0 where undefined."""
    return f1_per_class(score_counts(preds), threshold).agg(F.avg("f1").alias("f1_macro"))


def argmax_accuracy(wide: DataFrame) -> DataFrame:
    """accuracy: how often the largest target and the largest score (the first on ties) have one index; (targets, scores) arrays."""
    same = F.array_position("targets", F.array_max("targets")) == F.array_position("scores", F.array_max("scores"))
    return wide.agg(F.avg(same.cast("double")).alias("accuracy"))


def long_predictions(wide: DataFrame) -> DataFrame:
    """(ecg_id, targets, scores) as one row per class."""
    rows = wide.select("ecg_id", F.posexplode(F.arrays_zip("targets", "scores")).alias("class_idx", "_x"))
    return rows.select("ecg_id", "class_idx", F.col("_x.targets").cast("int").alias("target"), F.col("_x.scores").alias("score"))


def aggregate_predictions(windows: DataFrame) -> DataFrame:
    """ecg_id, class_idx, target (of the first window), score (the mean over windows). Repeated windows count once.

    Rows move once: what is dealt out by recording and class holds a window's repeats together, too.
    """
    once = windows.repartition("ecg_id", "class_idx").dropDuplicates(["ecg_id", "class_idx", "window"])
    return once.groupBy("ecg_id", "class_idx").agg(F.min_by("target", "window").alias("target"), F.avg("score").alias("score"))


def evaluate_all(preds: DataFrame, names: DataFrame) -> DataFrame:
    """metric, value: auroc_macro, auroc_micro, auprc_macro, f1_macro, and auroc_<name> per class; ``names`` has class_idx and name."""
    counts = keep(score_counts(preds))
    per = _auroc_per_class(counts)
    row = lambda df, name, value: df.select(F.lit(name).alias("metric"), F.col(value).alias("value"))
    out = row(per.agg(_mean("auroc").alias("v")), "auroc_macro", "v")
    out = out.unionByName(row(_auroc_micro(counts), "auroc_micro", "auroc_micro"))
    out = out.unionByName(row(_auprc_per_class(counts).agg(_mean(F.coalesce("auprc", F.lit(0.0))).alias("v")), "auprc_macro", "v"))
    out = out.unionByName(row(f1_per_class(counts, 0.5).agg(F.avg("f1").alias("v")), "f1_macro", "v"))
    return out.unionByName(per.join(names, "class_idx").select(F.concat(F.lit("auroc_"), "name").alias("metric"), F.col("auroc").alias("value")))
