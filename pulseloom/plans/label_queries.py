"""Queries of sources, scalar functions, joins and label tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..functions.shared import shared_dir
from ..operators import folds, joins, labels
from ..operators.results import age_group_counts, age_profile
from ..sources import arrays, tables
from .fixtures import LISTS, lists, named, table, waves

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"


def _text(col: Column | str) -> Column:
    return F.array_join(col, "|")


# ---- sources and sinks


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
def read_table(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    raw = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    raw.toDF(*[c.upper() for c in raw.columns]).write.option("header", True).csv(path)
    return tables.read_table(spark, path, "O_ORDERKEY long, O_CUSTKEY long, O_ORDERSTATUS string, O_ORDERPRIORITY string", ["o_orderkey", "o_custkey", "o_orderpriority"], lower=True)


@query("SELECT n_name AS record_name, string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey) AS codes FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def read_header_codes(spark: SparkSession, d: str) -> DataFrame:
    keys = F.array_join(F.transform(F.array_sort(F.collect_list("s_suppkey")), lambda x: x.cast("string")), ",")
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(keys.alias("k"))
    text = rows.select(F.concat(F.lit("# Age: 50\n# DX: "), "k", F.lit(", none\n# Dx: 1,2")).alias("value"), F.col("n_name").alias("record"))
    path = _folder(spark)
    text.repartition("record").write.partitionBy("record").text(path)
    return tables.read_header_codes(spark, path, r"record=([^/]+)/").withColumn("codes", F.array_join("codes", ","))


@query("""SELECT (t // 16)::INTEGER AS lead, (t % 16)::INTEGER AS sample, 4 AS n_leads, 16 AS n_samples, 16 AS fs, count(*) AS n, round(sum(embedding[t + 1]::DOUBLE), 3) + 0.0 AS total
FROM embeddings, range(0, 64) r(t) GROUP BY 1, 2""")
def read_waveforms(spark: SparkSession, d: str) -> DataFrame:
    path = arrays.write_arrays(waves(spark, d), _folder(spark))  # (N, 1, 16, 4)
    rows = tables.read_waveforms(spark, path, "samples", fs=16)
    shape = rows.select("fs", F.size("signal").alias("n_leads"), F.size(F.get("signal", F.lit(0))).alias("n_samples"), F.posexplode("signal").alias("lead", "x"))
    each = shape.select("fs", "n_leads", "n_samples", "lead", F.posexplode("x").alias("sample", "v"))
    return each.groupBy("lead", "sample", "n_leads", "n_samples", "fs").agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum(F.col("v").cast("double")), 3) + F.lit(0.0)).alias("total"))


def _vocab(spark: SparkSession, d: str) -> DataFrame:
    return labels.label_vocab(labels.label_counts(named(spark, d)), 10)


@query("SELECT replace(p_brand, ' ', '_') AS label, count(DISTINCT l_orderkey) AS n_records FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING count(*) >= 10")
def write_labels(spark: SparkSession, d: str) -> DataFrame:
    columns = tables.label_columns(_vocab(spark, d))
    path = _folder(spark)
    tables.write_labels(labels.multi_hot(named(spark, d), columns), path)
    back = tables.read_table(spark, path)
    counts = back.agg(*[F.sum(s.truthy(F.col(f"`{c}`"))).cast("long").alias(c) for _, c in columns])
    return counts.select(F.explode(F.create_map(*[x for _, c in columns for x in (F.lit(c), F.col(f"`{c}`"))])).alias("label", "n_records"))


@query("""WITH v AS (SELECT p_name AS label FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING count(*) >= 10)
SELECT 'parts' AS dataset, (SELECT count(*) FROM v) AS n_labels, replace(label, ' ', '_') AS column_name, label FROM v""")
def write_label_dictionary(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    vocab = labels.label_vocab(labels.label_counts(named(spark, d, "p_name")), 10)
    tables.write_label_dictionary(vocab, "parts", path)
    back = spark.read.schema("dataset string, n_labels long, labels map<string,string>").json(path)
    return back.select("dataset", "n_labels", F.explode("labels").alias("column_name", "label"))


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.concat(F.lit("mean_"), "event_type").alias("metric")).agg(F.round(F.avg("value"), 4).alias("value"))


@query("SELECT metric, value FROM (SELECT 'mean_' || event_type AS metric, round(avg(value), 4) AS value FROM events GROUP BY 1)")
def write_metrics(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    tables.write_metrics(_metrics(spark, d), path)
    return spark.read.text(path).select(F.split("value", ": ")[0].alias("metric"), F.split("value", ": ")[1].cast("double").alias("value"))


@query("SELECT o_orderpriority AS metric, count(*)::DOUBLE AS value FROM orders GROUP BY 1")
def read_metrics(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    counts = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    lines = counts.select(F.explode(F.array(F.concat(F.lit(" "), "o_orderpriority", F.lit(" : "), F.col("n").cast("string")), F.concat("o_orderpriority", F.lit(": none")))).alias("value"))
    lines.write.text(path)
    return tables.read_metrics(spark, path)


@query("SELECT c_mktsegment AS model, n_name AS task, count(*)::INTEGER AS num_classes, -1 AS best_epoch, round(avg(c_acctbal), 4) AS test_auroc_macro, 1 AS missing FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def append_results(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    runs = runs.groupBy(F.col("c_mktsegment").alias("model"), F.col("n_name").alias("task"), F.col("n_regionkey").alias("part")).agg(F.count(F.lit(1)).alias("num_classes"), F.round(F.avg("c_acctbal"), 4).alias("test_auroc_macro"))
    path = _folder(spark)
    for even in (True, False, True):  # to one table, and the first job once more
        tables.append_results(runs.filter((F.col("part") % 2 == 0) == even), path)
    back = tables.read_results(spark, path)
    return back.select("model", "task", "num_classes", "best_epoch", "test_auroc_macro", F.isnan("val_auroc_macro").cast("int").alias("missing"))


# ---- filters and scalar functions


@query("SELECT o_orderkey AS record_id, o_orderstatus AS dataset, 12 AS lead FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0 AND o_custkey % 5 <> 0")
def filter_dataset(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("record_id"), F.col("o_orderstatus").alias("dataset"), F.when(F.col("o_orderkey") % 3 == 0, 12).otherwise(1).alias("lead"), F.when(F.col("o_custkey") % 5 != 0, "path").alias("filepath")
    )
    return joins.filter_dataset(rows, "F", 12).drop("filepath")


@query("SELECT c_custkey AS pid, c_nationkey % 10 AS fold FROM customer WHERE c_nationkey % 10 IN (2, 7)")
def filter_folds(spark: SparkSession, d: str) -> DataFrame:
    return joins.filter_folds(table(spark, d, "customer").select(F.col("c_custkey").alias("pid"), (F.col("c_nationkey") % 10).alias("fold")), "fold", [2, 7])


@query("SELECT o_orderkey, CASE WHEN o_custkey % 6 IN (0, 1, 2, 3) THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM orders")
def truthy(spark: SparkSession, d: str) -> DataFrame:
    text = F.element_at(F.array(*[F.lit(x) for x in ("true", "TRUE", "1", "1.0", "yes", None)]), (F.col("o_custkey") % 6 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", s.truthy(text).alias("value"))


@query("""SELECT l_orderkey AS record_id, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END::DOUBLE AS first,
  CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END::DOUBLE AS second, CASE WHEN l_linenumber = 1 THEN 0.0 ELSE l_discount END AS third FROM lineitem""")
def label_matrix(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(
        F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("key"), (F.col("l_returnflag") == "A").alias("a"), F.when(F.col("l_linestatus") == "F", "1").alias("b"), F.when(F.col("l_linenumber") == 1, float("nan")).otherwise(F.col("l_discount")).alias("c")
    )
    packed = labels.label_matrix(rows, key="key")
    return packed.select(F.col("key.l_orderkey").alias("record_id"), "key.l_linenumber", "key.l_partkey", *[F.col("labels")[i].alias(n) for i, n in enumerate(("first", "second", "third"))])


@query("""WITH x AS (SELECT p_partkey, p_name || ' (' || p_type || '), ' || p_size || ':' || (p_size % 7) || '/' || p_brand || '''-x' AS t FROM part)
SELECT p_partkey, translate(t, ' -,()''', '__') AS bench, translate(t, ' -/,()''', '___') AS paper, translate(t, ' -/:,()''', '____') AS zzu FROM x""")
def sanitize_label(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("p_name", F.lit(" ("), "p_type", F.lit("), "), F.col("p_size").cast("string"), F.lit(":"), (F.col("p_size") % 7).cast("string"), F.lit("/"), "p_brand", F.lit("'-x"))
    return table(spark, d, "part").select("p_partkey", *[s.sanitize_label(text, r).alias(r) for r in ("bench", "paper", "zzu")])


@query("""WITH x AS (SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN NULL ELSE '00' || p_partkey || ', x' || p_size || ' ,, ' || p_size END AS t,
  CASE WHEN p_size % 10 = 0 THEN 'Null' WHEN p_size % 10 = 1 THEN NULL ELSE ' ''' || p_size || '''; ; ' || p_brand || '''' END AS z FROM part)
SELECT p_partkey, coalesce(p_partkey || '|' || split_part(t, ',, ', 2), '') AS paper,
  coalesce('00' || p_partkey || '|x' || split_part(t, ',, ', 2) || '|' || split_part(t, ',, ', 2), '') AS bench,
  CASE WHEN z IS NULL OR z = 'Null' THEN '' ELSE replace(trim(split_part(z, ';', 1)), '''', '') || '|' || replace(trim(split_part(z, ';', 3)), '''', '') END AS zzu FROM x""")
def parse_code_list(spark: SparkSession, d: str) -> DataFrame:
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    comma = F.when(F.col("p_size") % 10 != 0, F.concat(F.lit("00"), key, F.lit(", x"), size, F.lit(" ,, "), size))
    semi = F.when(F.col("p_size") % 10 == 0, "Null").when(F.col("p_size") % 10 != 1, F.concat(F.lit(" '"), size, F.lit("'; ; "), "p_brand", F.lit("'")))
    return table(spark, d, "part").select("p_partkey", *[_text(s.parse_code_list(c, r)).alias(r) for r, c in (("paper", comma), ("bench", comma), ("zzu", semi))])


@query("SELECT p_partkey, p_type || '|' || p_brand AS keys, 80.0::DOUBLE AS first, CASE WHEN p_size % 2 = 0 THEN p_size::DOUBLE END AS second FROM part")
def parse_code_map(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit(".0"))).otherwise("nan")
    text = F.concat(F.lit("{'"), "p_type", F.lit("': 80.0, '"), "p_brand", F.lit("': "), value, F.lit("}"))
    rows = table(spark, d, "part").select("p_partkey", "p_type", "p_brand", s.parse_code_map(text).alias("m"))
    second = F.col("m")[F.col("p_brand")]
    return rows.select("p_partkey", _text(F.map_keys("m")).alias("keys"), F.col("m")[F.col("p_type")].alias("first"), F.when(~F.isnan(second), second).alias("second"))


@query("""SELECT o_orderkey, 'r' || o_orderkey AS path, 'HR' || lpad(o_orderkey::VARCHAR, greatest(5, len(o_orderkey::VARCHAR))::INTEGER, '0') AS high_rate,
  'HR' || lpad(o_orderkey::VARCHAR, greatest(5, len(o_orderkey::VARCHAR))::INTEGER, '0') AS number FROM orders""")
def record_name(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    wide = F.format_string("%05d", "o_orderkey")
    return table(spark, d, "orders").select(
        "o_orderkey", s.record_name(F.concat(F.lit("a/b/r"), key, F.lit(".hea")), "path").alias("path"), s.record_name(F.concat(F.lit("records500/00000/"), wide, F.lit("_hr")), "rate").alias("high_rate"), s.record_name(F.col("o_orderkey"), "number").alias("number")
    )


@query("SELECT c_custkey, lower(c_mktsegment) AS model FROM customer")
def model_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", s.model_name(F.concat(F.lit("models."), "c_mktsegment", F.lit("Encoder"))).alias("model"))


_AGES = "ages AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal / 10000 END AS age FROM customer)"
_BIN = "CASE WHEN age IS NULL THEN NULL WHEN age * 100 < 20 THEN '<20' WHEN age * 100 < 40 THEN '20-40' WHEN age * 100 < 60 THEN '40-60' WHEN age * 100 < 80 THEN '60-80' ELSE '80+' END"


def _ages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / 10000).alias("age"))


@query(f"WITH {_AGES} SELECT c_custkey, {_BIN} AS age_bin FROM ages")
def age_bins(spark: SparkSession, d: str) -> DataFrame:
    return s.age_bins(_ages(spark, d), "age").select("c_custkey", "age_bin")


@query(f"WITH {_AGES} SELECT count(age) AS available, count(*) AS total, round(quantile_cont(age, 0.5), 9) AS median, round(quantile_cont(age, 0.25), 9) AS q25, round(quantile_cont(age, 0.75), 9) AS q75 FROM ages", )
def age_profile_(spark: SparkSession, d: str) -> DataFrame:
    rows = age_profile(_ages(spark, d))
    return rows.select("available", "total", *[F.round(c, 9).alias(c) for c in ("median", "q25", "q75")])


@query(f"WITH {_AGES}, b AS (SELECT {_BIN} AS age_bin FROM ages) SELECT n.age_bin, count(b.age_bin) AS n FROM (VALUES ('<20'), ('20-40'), ('40-60'), ('60-80'), ('80+'), ('none')) n(age_bin) LEFT JOIN b ON n.age_bin = b.age_bin GROUP BY 1")
def age_group_counts_(spark: SparkSession, d: str) -> DataFrame:
    return age_group_counts(s.age_bins(_ages(spark, d), "age"), ["<20", "20-40", "40-60", "60-80", "80+", "none"])


# ---- joins


@query("SELECT o_orderkey AS filepath, o_orderstatus AS status, c_mktsegment AS segment, c_name AS status_label FROM orders LEFT JOIN customer ON o_orderkey = c_custkey AND c_custkey % 2 = 0")
def join_labels(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "orders").select(F.col("o_orderkey").alias("filepath"), F.col("o_orderstatus").alias("status"))
    label = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("filepath"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("status"))
    return joins.join_labels(records, label, "filepath")


@query("SELECT l_orderkey AS record_name, o_orderdate, max_by(l_partkey, l_linenumber::BIGINT * 1000000000 + l_partkey) AS filepath FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def lookup_paths(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("record_name"), F.col("l_partkey").alias("filepath"), (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey")).alias("pos"))
    return joins.lookup_paths(table(spark, d, "orders").select(F.col("o_orderkey").alias("record_name"), "o_orderdate"), names)


def _mapping(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    one = part.select(F.concat(F.lit(" "), F.col("p_partkey").cast("string")).alias("code"), F.concat("p_type", F.lit(" ")).alias("name"), F.lit(1).alias("pos"))
    two = part.filter("p_size % 2 = 0").select(F.col("p_partkey").cast("string").alias("code"), F.col("p_brand").alias("name"), F.lit(2).alias("pos"))
    none = part.filter("p_size = 3").select(F.lit(None).cast("string").alias("code"), F.col("p_brand").alias("name"), F.lit(3).alias("pos"))
    return one.unionByName(two).unionByName(none).filter("name not like 'ECONOMY%'")


@query(f"""WITH {LISTS}, m AS (SELECT p_partkey::VARCHAR AS code, CASE WHEN p_type <> 'ECONOMY' THEN p_type WHEN p_size % 2 = 0 THEN p_brand END AS paper,
    CASE WHEN p_size % 2 = 0 THEN p_brand WHEN p_type <> 'ECONOMY' THEN p_type END AS bench FROM part),
  e AS (SELECT record_id, unnest(codes) AS code, unnest(range(1, len(codes) + 1)) AS i FROM lists)
SELECT l.record_id, coalesce(string_agg(paper, '|' ORDER BY i), '') AS paper, coalesce(string_agg(bench, '|' ORDER BY i), '') AS bench
FROM lists l LEFT JOIN e ON l.record_id = e.record_id LEFT JOIN m ON e.code = m.code GROUP BY 1""")
def map_codes(spark: SparkSession, d: str) -> DataFrame:
    rows = lists(spark, d).select("record_id", "codes")
    first = labels.map_codes(rows, _mapping(spark, d), "first").select("record_id", _text("names").alias("paper"))
    return first.join(labels.map_codes(rows, _mapping(spark, d), "last").select("record_id", _text("names").alias("bench")), "record_id")


@query("SELECT p_partkey::VARCHAR AS code, CASE WHEN p_size < 10 THEN p_brand ELSE p_type END AS name FROM part UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier")
def mapping_override(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    extra = part.filter("p_size < 10").select(F.col("p_partkey").cast("string").alias("code"), F.col("p_brand").alias("name"))
    extra = extra.unionByName(table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("code"), F.col("s_name").alias("name")))
    return labels.mapping_override(part.select(F.col("p_partkey").cast("string").alias("code"), F.col("p_type").alias("name")), extra)


@query("WITH c AS (SELECT p_brand AS code, p_name AS name, p_partkey AS pos FROM part WHERE p_size % 9 <> 0 UNION ALL SELECT p_type, p_name, p_partkey FROM part WHERE p_size % 9 <> 0) SELECT code, max_by(name, pos) AS name FROM c GROUP BY 1")
def explode_mapping(spark: SparkSession, d: str) -> DataFrame:
    key = F.when(F.col("p_size") % 9 == 0, "N/A").otherwise(F.concat("p_brand", F.lit("; "), "p_type", F.lit(";nan;")))
    return labels.explode_mapping(table(spark, d, "part").select(key.alias("keys"), F.col("p_name").alias("value"), F.col("p_partkey").alias("pos")), "keys", "value")


def _statements(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("code"), F.when(size % 2 == 0, 1.0).alias("diagnostic"), F.when(size % 3 == 0, 1.0).alias("form"), F.when(size % 5 == 0, 1.0).otherwise(0.0).alias("rhythm"),
        F.when(size % 2 == 0, F.col("p_brand")).alias("subclass"), F.when(size % 2 == 0, F.col("p_type")).alias("superclass"),
    )


@query(f"""WITH {LISTS}, e AS (SELECT record_id, unnest(codes) AS code, unnest(range(1, len(codes) + 1)) AS i FROM lists)
SELECT l.record_id, {', '.join(f"coalesce(string_agg(e.code, '|' ORDER BY i) FILTER (p_size % {k} = 0), '') AS {n}" for n, k in (('diagnostic', 2), ('form', 3), ('rhythm', 5)))}
FROM lists l LEFT JOIN e ON l.record_id = e.record_id LEFT JOIN part ON e.code = p_partkey::VARCHAR GROUP BY 1""")
def code_subsets(spark: SparkSession, d: str) -> DataFrame:
    rows, flags = lists(spark, d).select("record_id", "codes"), _statements(spark, d)
    out = None
    for flag in ("diagnostic", "form", "rhythm"):
        part = labels.code_subsets(rows, flags, flag).select("record_id", _text("codes").alias(flag))
        out = part if out is None else out.join(part, "record_id")
    return out


@query(f"""WITH {LISTS}, e AS (SELECT record_id, unnest(codes) AS code, unnest(range(1, len(codes) + 1)) AS i FROM lists)
SELECT l.record_id, {', '.join(f"coalesce(string_agg({c}, '|' ORDER BY i) FILTER (p_size % 2 = 0), '') AS {n}" for n, c in (('subclass', 'p_brand'), ('superclass', 'p_type')))}
FROM lists l LEFT JOIN e ON l.record_id = e.record_id LEFT JOIN part ON e.code = p_partkey::VARCHAR GROUP BY 1""")
def class_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows, classes = lists(spark, d).select("record_id", "codes"), _statements(spark, d)
    sub, top = (labels.class_rollup(rows, classes, level).select("record_id", _text("names").alias(level)) for level in ("subclass", "superclass"))
    return sub.join(top, "record_id")


@query("SELECT c_custkey AS record_id, c_nationkey % 10 AS fold FROM customer")
def original_folds(spark: SparkSession, d: str) -> DataFrame:
    customer = table(spark, d, "customer")
    folds_ = customer.select(F.col("c_name").alias("name"), (F.col("c_nationkey") % 10 + 1).alias("fold"))
    names = customer.select(F.col("c_custkey").alias("record_id"), F.col("c_name").alias("name"))
    return folds.original_folds(names.select("record_id"), names, folds_)


@query("SELECT o_orderkey AS record_id, coalesce(c_nationkey % 10, -1) AS fold FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 4 <> 0")
def attach_folds(spark: SparkSession, d: str) -> DataFrame:
    given = table(spark, d, "customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("pid"), (F.col("c_nationkey") % 10).alias("fold"))
    return joins.attach_folds(table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("pid")), given, "pid").drop("pid")


@query("SELECT o_custkey AS filepath, o_orderkey, c_acctbal AS age, c_mktsegment AS sid FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'")
def join_metadata(spark: SparkSession, d: str) -> DataFrame:
    sample = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("filepath"), "o_orderkey")
    return joins.join_metadata(sample, table(spark, d, "customer").select(F.col("c_custkey").alias("filepath"), F.col("c_acctbal").alias("age"), F.col("c_mktsegment").alias("sid")))


@query("""WITH g AS (SELECT * FROM (SELECT DISTINCT c_mktsegment AS model FROM customer), (SELECT n_name AS task FROM nation), (SELECT DISTINCT o_orderstatus AS mode FROM orders)),
  done AS (SELECT DISTINCT c_mktsegment AS model, n_name AS task, o_orderstatus AS mode FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_totalprice > 490000)
SELECT * FROM g EXCEPT SELECT * FROM done""")
def pending_experiments(spark: SparkSession, d: str) -> DataFrame:
    customer, nation, orders = (table(spark, d, t) for t in ("customer", "nation", "orders"))
    done = orders.filter("o_totalprice > 490000").join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    done = done.select(F.col("c_mktsegment").alias("model"), F.col("n_name").alias("task"), F.col("o_orderstatus").alias("mode"))
    models, modes = customer.select(F.col("c_mktsegment").alias("model")).distinct(), orders.select(F.col("o_orderstatus").alias("mode")).distinct()
    return joins.pending_experiments(models, nation.select(F.col("n_name").alias("task")), modes, done)


# ---- label tables


@query("SELECT p_brand AS label, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return labels.label_counts(named(spark, d))


@query(f"""WITH {LISTS}, e AS (SELECT record_id, unnest(codes) AS label, unnest(range(1, len(codes) + 1)) AS i FROM lists),
  c AS (SELECT label, count(*) AS n, min(record_id * 1000 + i) AS seen FROM e GROUP BY 1 HAVING count(*) >= 30)
SELECT 'paper' AS rule, (row_number() OVER (ORDER BY label) - 1)::INTEGER AS label_idx, label, n FROM c
UNION ALL SELECT 'bench', (row_number() OVER (ORDER BY n DESC, seen) - 1)::INTEGER, label, n FROM c""")
def label_vocab(spark: SparkSession, d: str) -> DataFrame:
    rows = lists(spark, d)
    paper = labels.label_vocab(labels.label_counts(rows, "codes"), 30, "name").select(F.lit("paper").alias("rule"), "*")
    return paper.unionByName(labels.label_vocab(labels.first_seen(rows, "codes"), 30, "count").select(F.lit("bench").alias("rule"), "*"))


@query(f"""WITH {LISTS}, e AS (SELECT record_id, unnest(codes) AS label, unnest(range(1, len(codes) + 1)) AS i FROM lists),
  v AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx FROM (SELECT label FROM e GROUP BY 1 HAVING count(*) >= 30))
SELECT l.record_id, coalesce(string_agg(v.label, '|' ORDER BY i), '') AS filtered, coalesce(string_agg(v.idx::VARCHAR, '|' ORDER BY i), '') AS encoded
FROM lists l LEFT JOIN e ON l.record_id = e.record_id LEFT JOIN v ON e.label = v.label GROUP BY 1""")
def filter_encode_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = lists(spark, d).select("record_id", "codes")
    out = labels.filter_encode_labels(rows, labels.label_vocab(labels.label_counts(rows, "codes"), 30), "codes")
    return out.select("record_id", _text("filtered").alias("filtered"), _text(F.transform("encoded", lambda x: x.cast("string"))).alias("encoded"))


_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


@query("SELECT o_orderkey AS record_id, " + ", ".join(f"coalesce(bool_or(p_type = '{t}'), false) AS {t.lower()}" for t in _TYPES) + " FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1")
def multi_hot(spark: SparkSession, d: str) -> DataFrame:
    return labels.multi_hot(named(spark, d, "p_type"), [(t, t.lower()) for t in _TYPES])


@query("""WITH t AS (SELECT o_orderkey AS record_id, coalesce(bool_or(p_type = 'ECONOMY'), false) AS e, coalesce(bool_or(p_type IN ('LARGE', 'MEDIUM')), false) AS size,
  coalesce(bool_or(p_type = 'PROMO'), false) AS promo FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT record_id, e AND NOT size AND NOT promo AS "NORM", size AS "SIZE", promo AS "PROMO", false AS "NONE" FROM t""")
def superclass_any(spark: SparkSession, d: str) -> DataFrame:
    wide = labels.multi_hot(named(spark, d, "p_type"), [(t, t) for t in _TYPES])
    return labels.superclass_any(wide, {"NORM": ["ECONOMY"], "SIZE": ["LARGE", "MEDIUM", "HUGE"], "PROMO": ["PROMO"], "NONE": ["HUGE"]}, "NORM")


@query("SELECT part, label, count(DISTINCT l_orderkey) AS n FROM (SELECT l_orderkey, p_type AS label, CASE WHEN p_type = 'PROMO' THEN 'rhythm' WHEN p_type IN ('SMALL', 'LARGE') THEN 'form' ELSE 'rest' END AS part FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1, 2")
def label_partition(spark: SparkSession, d: str) -> DataFrame:
    wide = labels.multi_hot(named(spark, d, "p_type"), [(t, t) for t in _TYPES])
    parts = labels.label_partition(wide, {"rhythm": ["PROMO", "OTHER"], "form": ["SMALL", "LARGE"]})
    out = None
    for name, df in parts.items():
        columns = [c for c in df.columns if c != "record_id"]
        counts = df.agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in columns])
        long = counts.select(F.lit(name).alias("part"), F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c))])).alias("label", "n")).filter("n > 0")
        out = long if out is None else out.unionByName(long)
    return out


@query("SELECT count_if(p_size > 25)::BIGINT AS matched, count(*) AS total, count_if(p_size > 25) / count(*) AS rate FROM part")
def match_report(spark: SparkSession, d: str) -> DataFrame:
    return joins.match_report(table(spark, d, "part"), F.col("p_size") > 25)


for _name in ("age_profile", "age_group_counts"):
    QUERIES[_name], ORACLE_SQL[_name] = QUERIES.pop(f"{_name}_"), ORACLE_SQL.pop(f"{_name}_")
