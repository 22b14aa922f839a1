"""What cleaning did: counters, samples of changes, whole files, and statistics of a corpus as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as T


def address_counters(rows: DataFrame, before: str, after: str) -> DataFrame:
    """One row: addresses, those with doubled commas, those whose split house numbers were merged, those changed."""
    a, b = F.col(before), F.col(after)
    joined = F.size(F.regexp_extract_all(a, F.lit(r"\d-\d"), F.lit(0))) < F.size(F.regexp_extract_all(b, F.lit(r"\d-\d"), F.lit(0)))
    return rows.agg(
        F.count(F.when(a.isNotNull() & (a != ""), 1)).alias("total"), F.count_if(F.contains(a, F.lit(",,"))).alias("double_comma"),
        F.count_if(joined).alias("merged"), F.count_if(~a.eqNullSafe(b)).alias("improved"))


def changes(rows: DataFrame, key: str, before: str, after: str, n: int) -> DataFrame:
    """key, before and after of the first n rows that changed."""
    return rows.where(~F.col(before).eqNullSafe(F.col(after))).select(key, F.col(before).alias("before"), F.col(after).alias("after")).orderBy(key).limit(n)


def clean_lines(spark: SparkSession, path: str, out: str, field: str = "Địa chỉ") -> None:
    """Writes a file of JSON lines with cleaned addresses; a line that is no object, or has no such text, stays as it is."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    value = F.get_json_object("value", f"$['{field}']")
    fields = F.from_json("value", "map<string,string>")
    # only the field's own value is replaced, so other fields keep their JSON form; an array of one text spells it quoted
    quoted = lambda c: F.regexp_replace(F.regexp_replace(F.to_json(F.array(c)), r"^\[", ""), r"\]$", "")
    old, new = quoted(value), quoted(T.clean_address(value))
    key = F.lit(f'"{field}"')
    found = F.regexp_extract("value", rf'("{field}"\s*:\s*)', 1)
    swapped = F.replace(F.col("value"), F.concat(found, old), F.concat(found, new))
    same = fields.isNull() | value.isNull() | ~F.contains("value", key)
    lines.select(F.when(same, F.col("value")).otherwise(swapped).alias("value")).write.mode("overwrite").text(out)


def json_statistics(rows: DataFrame, bad_lines: Column | int = 0) -> DataFrame:
    """One row: documents, bad lines, words, words a document to two places, vocabulary, over the rows spelled as JSON.

    Words are runs of letters, digits, marks and underscores, keys among them.
    """
    spelled = rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("j"))
    words = spelled.select(F.explode_outer(F.regexp_extract_all("j", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("word"))
    totals = words.groupBy("word").agg(F.count("word").alias("n")).agg(F.sum("n").alias("n_words"), F.count("word").alias("vocabulary"))
    n = spelled.agg(F.count(F.lit(1)).alias("n_docs"))
    one = n.crossJoin(F.broadcast(totals))  # two single rows
    return one.select("n_docs", (F.lit(bad_lines) if isinstance(bad_lines, int) else bad_lines).cast("long").alias("bad_lines"), "n_words",
                      F.round(F.col("n_words") / F.col("n_docs"), 2).alias("avg_words"), "vocabulary")
