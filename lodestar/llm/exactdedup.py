"""Exact duplicates by deterministic naming of blocks, then of pairs of names, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import BROADCAST_IDS, saved, scratch, with_group

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = 4096
#: A name has 63 bits: a bucket number of this many, then the rank among the bucket's sorted contents.
#: Of 2**35 different blocks (some 100 TB) about 2**13 share a bucket, and hardly three one.
BUCKET_BITS = 56
#: Contents of crowded buckets are sent to all tasks up to this many rows, else joined by shuffle.
CROWDED_ROWS = 10_000


def normalised(text: str = "text") -> Column:
    """The text with A-Z lower-cased; null is empty."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)


def _bucket(*content: Column, bits: int) -> Column:
    return F.xxhash64(*content).bitwiseAND(F.lit((1 << bits) - 1))


def _crowded(contents: DataFrame, bits: int) -> DataFrame | None:
    """bucket, content and rank of each content that shares its bucket with another; None if there are none.

    ``contents`` has bucket and content. Equal contents meet before they are shuffled.
    """
    distinct = contents.distinct()
    full = saved(distinct.groupBy("bucket").count().where("count > 1").select("bucket"))
    n = full.count()
    if not n:
        return None
    few = F.broadcast(full) if n <= CROWDED_ROWS else full
    ranked = distinct.join(few, "bucket", "left_semi").groupBy("bucket").agg(F.array_sort(F.collect_set("content")).alias("all"))
    ranked = saved(ranked.select("bucket", F.posexplode("all").alias("rank", "content")))
    if ranked.where(F.col("rank") >= 1 << (63 - bits)).limit(1).count():
        raise OverflowError("a bucket has more contents than a rank has numbers")
    return ranked


def _named(rows: DataFrame, names: str, bits: int, crowded: DataFrame | None, content: DataFrame | None = None) -> DataFrame:
    """Replaces column ``names``, an array of contents or of their buckets, by the array of their integer names.

    Where buckets are crowded, only rows that have one of them are looked at again: each
    such place gets its content's rank. ``content`` gives these places' contents from row_no
    and at; the array's own elements are taken where it is left out.
    """
    as_name = lambda bucket: F.shiftleft(bucket, 63 - bits)
    bucket = (lambda x: x) if content is not None else (lambda x: _bucket(x, bits=bits))
    if crowded is None:
        return rows.withColumn(names, F.transform(names, lambda x: as_name(bucket(x))))
    few = crowded.count() <= CROWDED_ROWS
    full = crowded.select("bucket").distinct()
    places = rows.select("row_no", F.posexplode(F.transform(names, bucket)).alias("at", "bucket"))
    places = places.join(F.broadcast(full) if few else full, "bucket", "left_semi")
    if content is None:
        own = rows.select("row_no", F.posexplode(names).alias("at", "content"))
        places = places.join(own, ["row_no", "at"])
    else:
        places = content(places)
    ranks = places.join(F.broadcast(crowded) if few else crowded, ["bucket", "content"]).where("rank > 0")
    ranks = ranks.groupBy("row_no").agg(F.map_from_entries(F.collect_list(F.struct("at", F.col("rank").cast("long")))).alias("ranks"))
    plain = F.transform(names, lambda x, i: as_name(bucket(x)) + F.coalesce(F.try_element_at("ranks", i), F.lit(0)).cast("long"))
    return rows.join(ranks, "row_no", "left").withColumn(names, plain).drop("ranks")


def identities(docs: DataFrame, keep: list[str], block: int = BLOCK, bits: int = BUCKET_BITS) -> DataFrame:
    """``keep`` of each row with row_no, level, name and text_sha256: rows have equal texts just if (level, name) agree.

    Level 0 cuts the normalised UTF-8 text into blocks of ``block`` bytes. Distinct blocks
    are sorted into buckets by hash and, in a bucket, by content; bucket and rank make the
    block's integer name, so different blocks never share one. Each further level pairs
    adjacent names (a last one without a partner pairs with -1) and names the pairs
    alike, until every text is down to one name. Rows of different levels differ in length.

    Names stay in the document's row as an array, 8 bytes a block; what is shuffled is each
    distinct block once and each distinct pair once, for the crowded-bucket test. Buckets
    of 2**56 are rarely crowded; ``bits`` can be small in tests, where ranks do the work.
    An empty or null text has one empty block. The number of levels is the logarithm of
    the longest text's blocks.
    """
    numbers = F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.octet_length("utf8") / block)).cast("int") - 1)
    piece = lambda i: F.substring(F.col("utf8"), i * block + 1, F.lit(block))
    spelled = docs.select(*keep, F.encode(normalised(), "UTF-8").alias("utf8"))
    # numbers are exploded, not blocks: an exploded array would be spelled anew for each element
    contents = spelled.select(F.explode(numbers).alias("at"), "utf8").select(piece(F.col("at")).alias("content"))
    contents = contents.select(_bucket(F.col("content"), bits=bits).alias("bucket"), "content")
    crowded = _crowded(contents, bits)
    rows = spelled.select(*keep, F.sha2("utf8", 256).alias("text_sha256"), F.transform(numbers, lambda i: _bucket(piece(i), bits=bits)).alias("names"),
                          *[] if crowded is None else ["utf8"]).withColumn("row_no", F.monotonically_increasing_id())
    if crowded is not None:
        rows = saved(rows)
        texts = rows.select("row_no", "utf8")
        rows = rows.drop("utf8")
        found = lambda places: texts.join(places, "row_no").select("row_no", "at", "bucket", piece(F.col("at")).alias("content"))
    else:
        found = lambda places: places
    rows = saved(_named(rows, "names", bits, crowded, found).withColumn("level", F.lit(0)))

    done = rows.where(F.size("names") == 1)
    left, level = rows.where(F.size("names") > 1), 0
    while left.limit(1).count():
        level += 1
        pair = F.transform(
            F.sequence(F.lit(0), ((F.size("names") + 1) / 2).cast("int") - 1),
            lambda i: F.struct(F.get("names", 2 * i).alias("a"), F.coalesce(F.get("names", 2 * i + 1), F.lit(-1).cast("long")).alias("b")))
        pairs = left.withColumn("names", pair)
        contents = pairs.select(F.explode("names").alias("content")).select(_bucket(F.col("content"), bits=bits).alias("bucket"), "content")
        crowded = _crowded(contents, bits)
        rows = saved(_named(pairs, "names", bits, crowded).withColumn("level", F.lit(level)))
        done = done.unionByName(rows.where(F.size("names") == 1))
        left = rows.where(F.size("names") > 1)
    return done.select(*keep, "row_no", "level", F.element_at("names", 1).alias("name"), "text_sha256")


def duplicate_groups(docs: DataFrame, block: int = BLOCK, bits: int = BUCKET_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows whose texts are equal up to the case of A-Z the one with the largest doc_id
    is kept; of several such rows with that doc_id, one. A null text equals an empty one;
    a null doc_id is smaller than any other. No rows: no rows.
    """
    with scratch(docs.sparkSession) as keep:
        rows = keep(saved(identities(docs, ["doc_id"], block, bits)))
    groups = saved(rows.groupBy("level", "name").agg(
        F.max(F.struct("doc_id", "row_no")).alias("top"), F.count(F.lit(1)).alias("group_size")))
    return with_group(rows, groups, ["level", "name"], "group_size", rows.count()).select(
        "doc_id", F.col("top.doc_id").alias("keep_id"), "group_size",
        (F.col("row_no") == F.col("top.row_no")).alias("kept"), "text_sha256")


def without_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were.

    Which row stays, and what null, empty and repeated rows are, is as in
    duplicate_groups(). Extra columns may have any name. No rows: no rows.
    """
    plain = docs.toDF(*[f"col_{i}" for i in range(len(docs.columns))])
    key, text = (f"col_{docs.columns.index(c)}" for c in ("doc_id", "text"))
    with scratch(docs.sparkSession) as keep:
        found = keep(saved(duplicate_groups(plain.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))))
    gone = found.where(~F.col("kept"))
    repeated = found.groupBy("doc_id").count().where("count > 1").limit(1).count()
    if not repeated:
        ids = gone.select(F.col("doc_id").alias("gone_id"))
        ids = F.broadcast(ids) if gone.count() <= BROADCAST_IDS else ids
        return plain.join(ids, F.col(key).eqNullSafe(F.col("gone_id")), "left_anti").toDF(*docs.columns)
    # a doc_id has several rows: what stays is one row of each (doc_id, text) that is kept
    stays = found.where("kept").select(F.col("doc_id").alias("stay_id"), F.col("text_sha256").alias("stay_sha"))
    marked = plain.withColumn("mark_sha", F.sha2(F.encode(normalised(text), "UTF-8"), 256))
    one = marked.join(stays, F.col(key).eqNullSafe(F.col("stay_id")) & (F.col("mark_sha") == F.col("stay_sha")), "left_semi")
    return one.dropDuplicates([key, "mark_sha"]).drop("mark_sha").toDF(*docs.columns)


#: The same in DuckDB's SQL.
SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
