"""Contiguous shards of near-equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import offsets, saved

SHARDS = 16


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 1) and text_crc32 of each row."""
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )


def shards(rows: DataFrame, order: list[str], size: str, n: int = SHARDS) -> DataFrame:
    """Adds ``shard`` (0 to n-1) and ``slot`` (gapless from 0 in each shard).

    The rows are ranged by ``order`` into partitions; each partition's total gives the
    bytes before it, a running sum inside it gives each row's place in the whole, and
    the row goes to the shard in whose n-th part of all bytes its midpoint lies. Shards
    are therefore contiguous in ``order`` and differ from the equal target by less than
    the rows at their two ends.

    No rows: no rows. Rows equal in ``order`` are interchangeable. A null in ``order``
    sorts first. A row longer than a shard's target leaves some shards empty. Sizes must
    be positive and add up to less than 2**63 / (2 * n).
    """
    ranged = saved(rows.repartitionByRange(*order).withColumn("range_no", F.spark_partition_id()))
    totals = ranged.groupBy("range_no").agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("rows"))
    places = offsets(totals, "range_no", ["bytes", "rows"])
    inside = Window.partitionBy("range_no").orderBy(*order)
    # one row per range partition
    placed = (
        ranged.withColumns({
            "run": F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
            "nth": F.row_number().over(inside),
        })
        .join(F.broadcast(places), "range_no")
        .withColumns({
            "row_no": F.col("before_rows") + F.col("nth") - 1,
            "twice_mid": 2 * (F.col("before_bytes") + F.col("run")) - F.col(size),
        })
        .withColumn("shard", F.least(F.lit(n - 1), F.expr(f"twice_mid * {n} div (2 * all_bytes)")).cast("int"))
    )
    first = placed.groupBy("shard").agg(F.min("row_no").alias("shard_first"))  # at most n rows
    return (
        placed.join(F.broadcast(first), "shard")
        .withColumn("slot", F.col("row_no") - F.col("shard_first"))
        .select(*rows.columns, "shard", "slot")
    )


def balanced_shards(docs: DataFrame, n: int = SHARDS) -> DataFrame:
    """Documents in ``n`` contiguous shards by doc_id whose bytes are near equal.

    A null text counts as empty: one byte and a crc of 0. Repeated rows each get a
    slot of their own. Columns other than doc_id and text are not read.
    """
    rows = shards(sized(docs), ["doc_id", "text_crc32", "size"], "size", n)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
