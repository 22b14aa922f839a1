"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows and bytes of a batch that goes to Python at once.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds what Spark hands to a Python worker at once: texts may be long, and both sides hold a batch several times."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name)
        bytes_now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) if now and not now.lstrip("-").isdigit() else int(now)
        if not 0 < bytes_now <= most:
            spark.conf.set(name, str(most))


def returned() -> None:
    """Hands what this process has freed back to the system: workers live on through later stages."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError, TypeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def mapped(df: DataFrame, f, schema) -> DataFrame:
    """``df.mapInArrow`` in small batches; a task's memory is handed back when it ends."""
    small_batches(df.sparkSession)

    def run(batches):
        try:
            yield from f(batches)
        finally:
            returned()

    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own.
    """
    conf = spark.sparkContext.getConf()
    named = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    named = f"file://{tempfile.mkdtemp(prefix='lodestar-')}"
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def saved(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors.

    Values that depend on the partitioning (partition numbers, sampled ranges) are
    fixed by it, since later passes read the table instead of computing them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestar-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.saved_at = path
    if _scopes:
        _scopes[-1].append(path)
    return table


#: Paths that saved() made in each open scope, the innermost last.
_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes what saved() makes inside when it ends, but for tables that are kept.

    It yields the function that keeps a saved table. What leaves the block may read kept
    tables only.
    """
    own: list[str] = []
    kept: list[str] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table.saved_at)
        return table

    _scopes.append(own)
    try:
        yield keep
    finally:
        _scopes.remove(own)
        for path in set(own) - set(kept):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if _scopes:
            _scopes[-1].extend(kept)


def offsets(totals: DataFrame, key: str, amounts: list[str]) -> DataFrame:
    """Exclusive prefix sums of ``amounts`` over ``totals`` in the order of ``key``.

    ``totals`` has one row per partition of a ranged table, so the single-task window
    holds as many rows as that table has partitions, whatever its number of rows.
    Also adds ``all_<amount>``, the sum over every row.
    """
    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = totals
    for a in amounts:
        out = out.withColumns({
            f"before_{a}": F.coalesce(F.sum(a).over(before), F.lit(0)).cast("long"),
            f"all_{a}": F.coalesce(F.sum(a).over(whole), F.lit(0)).cast("long"),
        })
    return out.drop(*amounts)


#: A key is hot if it has over 1/HOT of all rows: there are fewer than HOT such keys.
HOT = 1000


def with_group(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (one row per key, ``size`` = its number of rows).

    Keys with over ``total / HOT`` rows are joined by broadcast: their count is below
    HOT by arithmetic, so what is sent is bounded whatever the input. The rest is
    shuffled by key, where no key has more than ``total / HOT`` rows.
    """
    limit = max(1, total // HOT)
    hot = groups.where(F.col(size) > limit)
    cold = groups.where(F.col(size) <= limit)
    named = [f"hot_{k}" for k in keys]
    marks = F.broadcast(hot.select(*[F.col(k).alias(n) for k, n in zip(keys, named)]))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, named)]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return (
        rows.join(F.broadcast(hot), keys)
        .unionByName(rows.join(marks, on, "left_anti").join(cold, keys))
    )


#: So many ids are sent to all tasks; more are joined by shuffle.
BROADCAST_IDS = 100_000
