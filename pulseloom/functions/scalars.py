"""Column expressions for codes, labels and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def truthy(col: Column) -> Column:
    """1.0 if the value as text is true, 1 or 1.0 in any case, else 0.0, also when missing."""
    return F.coalesce(F.lower(col.cast("string")).isin("true", "1", "1.0").cast("double"), F.lit(0.0))


def sanitize_label(col: Column, rule: str) -> Column:
    """A label as a column name. Rules: ``bench`` leaves / and :, ``paper`` turns / to _, ``zzu`` both / and :."""
    turned = {"bench": " -", "paper": " -/", "zzu": " -/:"}[rule]
    return F.translate(col, turned + ",()'", "_" * len(turned))


def parse_code_list(col: Column, rule: str) -> Column:
    """Text to codes. ``paper``: comma, whole numbers only, leading zeros gone (codes may exceed 64 bits);
    ``bench``: comma, trimmed, empties dropped; ``zzu``: semicolon, null or Null is empty, then as bench, then ' removed.
    """
    empty = F.lit([]).cast("array<string>")
    parts = F.transform(F.split(col, ";" if rule == "zzu" else ","), lambda x: F.trim(x))
    parts = F.filter(parts, lambda x: x != "")
    if rule == "paper":
        parts = F.transform(F.filter(parts, lambda x: x.rlike(r"^[+-]?\d+$")), lambda x: F.regexp_replace(F.regexp_replace(x, r"^\+", ""), r"^(-?)0+(?=\d)", "$1"))
        parts = F.transform(parts, lambda x: F.when(x == "-0", "0").otherwise(x))
    if rule == "zzu":
        parts = F.transform(parts, lambda x: F.replace(x, F.lit("'"), F.lit("")))
        return F.when(col.isNull() | (col == "Null"), empty).otherwise(parts)
    return F.coalesce(parts, empty)


def parse_code_map(col: Column) -> Column:
    """Text of a dictionary code -> likelihood as a map, read by pattern and never evaluated; nan is allowed."""
    pattern = r"['\"]([^'\"]+)['\"]\s*:\s*([-+0-9.eE]+|nan)"
    keys = F.regexp_extract_all(col, F.lit(pattern), F.lit(1))
    values = F.transform(F.regexp_extract_all(col, F.lit(pattern), F.lit(2)), lambda x: F.when(x == "nan", float("nan")).otherwise(x.try_cast("double")))
    # a repeated key takes its last value, as in a dictionary
    last = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v"), F.sequence(F.lit(1), F.size(keys)).alias("i")), lambda x: x["i"] == F.size(keys) - F.array_position(F.reverse(keys), x["k"]) + 1)
    return F.when(F.size(keys) > 0, F.map_from_arrays(F.transform(last, lambda x: x["k"]), F.transform(last, lambda x: x["v"]))).otherwise(F.create_map().cast("map<string,double>"))


def record_name(col: Column, rule: str) -> Column:
    """The lookup key of a record. ``path``: last part without .hea; ``rate``: .../00001_hr or _lr is HR00001; ``number``: HR%05d."""
    if rule == "number":
        return F.format_string("HR%05d", col.cast("long"))
    last = F.substring_index(col, "/", -1)
    if rule == "path":
        return F.regexp_replace(last, r"\.hea$", "")
    return F.concat(F.lit("HR"), F.regexp_replace(F.regexp_replace(last, r"(?<=.)\.[^.]*$", ""), "_hr|_lr", ""))


def model_name(col: Column) -> Column:
    """The last part of a class path, without Encoder, in lower case."""
    return F.lower(F.replace(F.substring_index(col, ".", -1), F.lit("Encoder"), F.lit("")))


def age_bins(df: DataFrame, col: str, scale: float = 100.0, edges: tuple[float, ...] = (0, 20, 40, 60, 80, 120), names: tuple[str, ...] = ("<20", "20-40", "40-60", "60-80", "80+")) -> DataFrame:
    """Add age_bin: lower edge inclusive, below the first edge the first bin, from the last but one up the last; no age, no bin."""
    age = F.col(col) * scale
    bin_ = F.when(age.isNull() | F.isnan(age), None)
    for upper, name in zip(edges[1:-1], names):
        bin_ = bin_.when(age < upper, name)
    return df.withColumn("age_bin", bin_.otherwise(names[-1]))
