"""Mixing sources to target weights: repetition rates and hash-seeded copies, all in SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import saved

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def words() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target and rate from (source, source_size).

    Sources in code-point order, null last, take the weights in turn. A target is the
    lesser of ``most`` times the source's size and its weight times a level; the level
    makes all targets add up to ``share`` of all sizes. That is where reshared excess
    comes to rest: sources ordered by cap per weight are capped up to the first whose
    cap exceeds the level that the others would then have.

    The windows run over one row per source, already summed: in one task, a few dozen bytes
    a source, so sources may be millions but not as many as documents. A source of size 0
    has target and rate 0; no source: no rows.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("per_weight", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy("per_weight").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    ranked = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", (F.col("source_size") * most).cast("double"))
        .withColumn("per_weight", F.col("cap") / F.col("weight"))
        .withColumns({
            "capped": F.sum("cap").over(by_cap) - F.col("cap"),  # of the sources before this one
            "open": F.sum("weight").over(every) - F.sum("weight").over(by_cap) + F.col("weight"),
            "goal": F.sum("source_size").over(every).cast("double") * share,
            "place": F.row_number().over(Window.orderBy("per_weight", F.col("source").asc_nulls_last())),
        })
        .withColumn("level_here", (F.col("goal") - F.col("capped")) / F.col("open"))
        # this source and those after it stay below their caps
        .withColumn("level", F.min(F.when(F.col("level_here") <= F.col("per_weight"), F.struct("place", "level_here")))
                    .over(every).getField("level_here"))
    )
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return ranked.select("source", "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    )


def draw(seed: str = SEED) -> Column:
    """A number from 0 to 1 (without 1) that depends on doc_id and seed alone: 52 bits of their md5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def copies(seed: str = SEED) -> Column:
    """floor(rate) and one more with the fraction's probability."""
    return (F.floor("rate") + F.when(draw(seed) < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long")


def rates(docs: DataFrame, **how) -> DataFrame:
    """``targets`` of the table's sources, whose sizes are counted over all rows."""
    return targets(docs.groupBy("source").agg(F.sum(words()).alias("source_size")), **how)


def mix_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (size times its copies) of every row.

    Null text: size 0. Null source: a source of its own, ordered last. Rows of equal
    doc_id draw alike. Reruns agree: the draw reads nothing but doc_id.
    """
    counted = saved(docs.select("doc_id", "source", words().alias("size")))
    plan = saved(targets(counted.groupBy("source").agg(F.sum("size").alias("source_size"))))
    return (
        counted.join(_sized(plan), counted["source"].eqNullSafe(plan["source"]))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * copies()).alias("taken"))
    )


#: Rate tables up to this many sources are sent to all executors; larger ones are joined by shuffle.
BROADCAST_SOURCES = 100_000


def _sized(plan: DataFrame) -> DataFrame:
    return F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every document as many times as it is taken, with the columns of ``docs``.

    Null text: size 0, so it counts for nothing, but is taken at its source's rate. Null
    sources are one source. Rows of equal doc_id, a null one too, are drawn alike. Extra
    columns may have any name. A source whose texts have no word is not taken. No rows: no rows.
    """
    plain = docs.toDF(*[f"col_{i}" for i in range(len(docs.columns))])
    col = lambda c: F.col(f"col_{docs.columns.index(c)}")
    plan = saved(rates(plain.select(col("source").alias("source"), col("text").alias("text")), **how).select(F.col("source").alias("mix_source"), "rate"))
    joined = plain.withColumn("doc_id", col("doc_id")).join(_sized(plan), col("source").eqNullSafe(F.col("mix_source")))
    times = F.sequence(F.lit(1), copies().cast("int"))
    taken = joined.withColumn("mix_copy", F.explode(F.when(copies() > 0, times).otherwise(F.array().cast("array<int>"))))
    return taken.select(*plain.columns).toDF(*docs.columns)


#: The same in DuckDB's SQL.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
    CAST(source_size * 2 AS DOUBLE) AS cap FROM s
), r AS (
  SELECT *, cap / weight AS per_weight FROM w
), l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE - (sum(cap) OVER b - cap)) / (sum(weight) OVER () - sum(weight) OVER b + weight) AS level_here,
    row_number() OVER b AS place
  FROM r WINDOW b AS (ORDER BY per_weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), t AS (
  SELECT *, (SELECT level_here FROM l WHERE level_here <= per_weight ORDER BY place LIMIT 1) AS level FROM l
), p AS (
  SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM t
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM p
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN
  ('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE < rate - floor(rate)
  THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
"""
