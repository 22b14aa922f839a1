"""Inverted index, BM25, vectors, fusion, filters and pages, as DataFrames."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import text as T

K1, B = 1.5, 0.75


# --- index ---------------------------------------------------------------------------

def term_rows(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per term. The outer form of explode: for the inner one the optimizer infers a
    filter on the array's size, and with it cuts every text into terms again."""
    return docs.select(key, F.explode_outer(T.terms(F.col(text))).alias("term")).where("term IS NOT NULL")


def postings(docs: DataFrame, text: str = "text") -> DataFrame:
    """term, doc_id, tf. One shuffle, after counts in each input partition."""
    return term_rows(docs, text).groupBy("doc_id", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))


def doc_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and dl, its number of terms. No shuffle."""
    return docs.select("doc_id", F.size(T.terms(F.col(text))).alias("dl"))


@dataclass
class Index:
    """postings (term, doc_id, tf, dl), terms (term, df) and meta, one row: total_docs, avgdl, total_terms."""

    postings: DataFrame
    terms: DataFrame
    meta: DataFrame


def meta_row(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count(F.lit(1)).alias("total_docs"), F.avg("dl").alias("avgdl"), F.sum("dl").alias("total_terms"))


def postings_with_length(docs: DataFrame, text: str = "text") -> DataFrame:
    """term, doc_id, tf and dl: the document's length goes with each posting, so that a search joins no documents."""
    cut = docs.select("doc_id", T.terms(F.col(text)).alias("terms"))
    flat = cut.select("doc_id", F.size("terms").alias("dl"), F.explode_outer("terms").alias("term")).where("term IS NOT NULL")
    return flat.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).cast("int").alias("tf")).select("term", "doc_id", "tf", "dl")


def document_frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def index_of(docs: DataFrame, text: str = "text") -> Index:
    made = postings_with_length(docs, text)
    return Index(made, document_frequencies(made), meta_row(doc_stats(docs, text)))


def write_index(docs: DataFrame, folder: str, text: str = "text") -> Index:
    """Tables of the index; postings and terms are ranged and sorted by term, so a term's lookup skips row groups."""
    spark = docs.sparkSession

    def write(rows, name, *order):
        (rows.repartitionByRange(*order).sortWithinPartitions(*order)
         .write.mode("overwrite").option("parquet.bloom.filter.enabled#term", "true").parquet(f"{folder}/{name}"))

    stats = doc_stats(docs, text)
    stats.write.mode("overwrite").parquet(f"{folder}/doc_stats")
    meta_row(spark.read.schema("doc_id long, dl int").parquet(f"{folder}/doc_stats")).write.mode("overwrite").parquet(f"{folder}/meta")
    write(postings_with_length(docs, text), "postings", "term", "doc_id")
    write(document_frequencies(read_index(spark, folder).postings), "terms", "term")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> Index:
    """The index of a folder; tables that are not there are empty."""
    from pyspark.errors import AnalysisException

    def read(name, schema):
        try:
            return spark.read.schema(schema).parquet(f"{folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)

    return Index(read("postings", "term string, doc_id long, tf int, dl int"), read("terms", "term string, df long"),
                 read("meta", "total_docs long, avgdl double, total_terms long"))


# --- BM25 ----------------------------------------------------------------------------

def idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs - df + 0.5) / (df + 0.5) + 1)


def bm25_weight(tf: Column, dl: Column, avgdl: Column, idf_of: Column, k1: float = K1, b: float = B) -> Column:
    norm = F.when(avgdl > 0, 1 - b + b * dl / avgdl).otherwise(1.0)
    return idf_of * tf * (k1 + 1) / (tf + k1 * norm)


def query_rows(spark: SparkSession, batches: list[tuple[int, list[str]]]) -> DataFrame:
    """qid, term and first position of each distinct term."""
    rows = [(q, t, i) for q, found in batches for i, t in enumerate(dict.fromkeys(found))]
    return spark.createDataFrame(rows, "qid int, term string, pos int")


def bm25_parts(index: Index, queries: DataFrame) -> DataFrame:
    """qid, doc_id, term, pos, tf and score of every match.

    The queries are as long as what users typed: their terms are bound into the plan, so
    the one scan of the postings skips all row groups without them, and nothing is shuffled.
    """
    wanted = [r["term"] for r in queries.select("term").distinct().collect()]
    df = index.terms.where(F.col("term").isin(wanted))  # one row per query term
    return (
        index.postings.where(F.col("term").isin(wanted)).join(F.broadcast(df), "term").join(F.broadcast(queries), "term")
        .crossJoin(F.broadcast(index.meta))  # one row
        .select("qid", "doc_id", "term", "pos", "tf",
                bm25_weight(F.col("tf"), F.col("dl"), F.col("avgdl"), idf(F.col("total_docs"), F.col("df"))).alias("score"))
    )


def bm25(index: Index, queries: DataFrame) -> DataFrame:
    """qid, doc_id, score, first_pos: any term suffices."""
    return bm25_parts(index, queries).groupBy("qid", "doc_id").agg(F.sum("score").alias("score"), F.min("pos").alias("first_pos"))


def top(scores: DataFrame, k: int, *ties: str) -> DataFrame:
    """The k best of each query with their rank; equal scores in the order of ``ties``."""
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), *ties)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def with_intent(scores: DataFrame, index: Index, must: list[str], must_not: list[str]) -> DataFrame:
    """Documents with a term of ``must`` and none of ``must_not``; empty lists ask nothing."""
    having = lambda words: index.postings.where(F.col("term").isin(words)).select("doc_id").distinct()
    if must:
        scores = scores.join(having(must), "doc_id", "left_semi")
    if must_not:
        scores = scores.join(having(must_not), "doc_id", "left_anti")
    return scores


def explain(index: Index, queries: DataFrame, doc_id: int) -> DataFrame:
    """term, freq, score for each query term, 0 where the document lacks it."""
    own = bm25_parts(index, queries).where(F.col("doc_id") == doc_id).select("term", "tf", "score")
    return queries.join(own, "term", "left").select(
        "term", F.coalesce("tf", F.lit(0)).alias("freq"), F.coalesce("score", F.lit(0.0)).alias("score"))


def fetched(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Document columns for ranked hits only: the few hits go to the documents."""
    return docs.join(F.broadcast(hits), "doc_id")


# --- vectors -------------------------------------------------------------------------

def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """Length 1; the zero vector stays."""
    length = F.sqrt(dot(v, v))
    return F.when(length == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / length))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


SLOTS = 4


def slots(embeddings: DataFrame) -> DataFrame:
    """Four vectors of a document lie next to each other: name, industry, province, all."""
    return embeddings.withColumns({"doc_id": F.expr(f"vec_id div {SLOTS}"), "slot": (F.col("vec_id") % SLOTS).cast("int")})


def vector_scores(vectors: DataFrame, query: list[float], slot: int | None = None) -> DataFrame:
    """doc_id and its best slot's similarity as 0 to 100; ``slot`` looks at one slot only."""
    q = F.array(*[F.lit(float(x)) for x in query])
    some = vectors if slot is None else vectors.where(F.col("slot") == slot)
    return some.select("doc_id", dot(F.col("embedding"), q).alias("ip")).groupBy("doc_id").agg(
        (F.greatest(F.lit(0.0), F.max("ip")) * 100).alias("score"))


def coarse_cells(vectors: DataFrame, n_cells: int = 16, seed: int = 7, sample: float = 1.0):
    """Cells of an approximate index: k-means centres (fit on a sample) and each vector's cell."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = vectors.withColumn("features", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))))
    model = KMeans(k=n_cells, seed=seed, maxIter=10).fit(ready.sample(sample, seed) if sample < 1 else ready)
    return model.clusterCenters(), model.transform(ready).withColumnRenamed("prediction", "cell").drop("features")


def probe(centres, query: list[float], n_probe: int) -> list[int]:
    """The cells nearest to the query: a driver-side choice among few centres, then a partition filter."""
    distance = [sum((x - y) ** 2 for x, y in zip(c, query)) for c in centres]
    return sorted(range(len(centres)), key=lambda i: (distance[i], i))[:n_probe]


def ann_search(vectors: DataFrame, queries: DataFrame, k: int, n_probe: int) -> DataFrame:
    """query_id, vec_id, ip: the best ``k`` of ``vectors`` (vec_id, embedding) in each query's nearest cells.

    ``queries`` (query_id, embedding) go to all tasks; a task keeps the best of each batch,
    so pairs of query and vector never become rows.
    """
    import numpy as np
    import pyarrow as pa

    centres, cells = coarse_cells(vectors.select("vec_id", "embedding"))
    asked = queries.select("query_id", "embedding").toArrow()
    ids, q = asked["query_id"].to_numpy(), np.array(asked["embedding"].to_pylist(), dtype=np.float64)
    probed = np.zeros((len(ids), len(centres)), dtype=bool)
    for i, one in enumerate(q):
        probed[i, probe(centres, one, n_probe)] = True

    def best(batches):
        for b in batches:
            if not b.num_rows:
                continue
            vec_id, cell = b["vec_id"].to_numpy(), b["cell"].to_numpy()
            v = np.array(b["embedding"].to_pylist(), dtype=np.float64)
            for at in range(0, len(ids), 256):
                ip = np.where(probed[at: at + 256][:, cell], q[at: at + 256] @ v.T, -np.inf)
                least = np.partition(ip, -k, axis=1)[:, -k] if len(vec_id) > k else np.full(len(ip), -np.inf)
                i, j = np.nonzero((ip >= least[:, None]) & (ip > -np.inf))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at + i]), pa.array(vec_id[j]), pa.array(ip[i, j])], ["query_id", "vec_id", "ip"])

    found = cells.select("vec_id", "embedding", "cell").mapInArrow(best, "query_id long, vec_id long, ip double")
    order = Window.partitionBy("query_id").orderBy(F.desc("ip"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


# --- fusion and filters --------------------------------------------------------------

def fuse(lexical: DataFrame, vector: DataFrame, w_lexical: float = 0.5, w_vector: float = 0.5) -> DataFrame:
    """doc_id, hybrid, bm25, vector: the first scaled to 100 by its maximum, both capped there, missing ones 0."""
    total = w_lexical + w_vector
    best = lexical.agg(F.max("score").alias("best"))
    scaled = lexical.crossJoin(F.broadcast(best)).select(
        "doc_id", F.least(F.lit(100.0), F.col("score") / F.when(F.col("best") == 0, 1.0).otherwise(F.col("best")) * 100).alias("bm25"))
    capped = vector.select("doc_id", F.least(F.lit(100.0), "score").alias("vector"))
    both = scaled.join(capped, "doc_id", "full_outer").na.fill(0.0, ["bm25", "vector"])
    return both.withColumn("hybrid", F.col("bm25") * (w_lexical / total) + F.col("vector") * (w_vector / total))


def contains_text(c: Column, part: str) -> Column:
    """Lower-case containment of a part in composed form, as texts are since ingest; an empty part is everywhere."""
    part = unicodedata.normalize("NFC", part).lower()
    return F.lit(True) if not part else F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(part))


# fixed values: the status words of the registry
ACTIVE, INACTIVE = "Đang hoạt động", "Ngừng hoạt động"


def status_is(c: Column, wanted: str) -> Column:
    active = contains_text(c, ACTIVE)
    return active if wanted == ACTIVE else ~active if wanted == INACTIVE else F.lit(True)


def or_all(rows: DataFrame, condition: Column) -> DataFrame:
    """The rows that meet ``condition``, or all if none does; decided inside the plan by one scalar row."""
    flagged = rows.withColumn("is_match", condition)
    some = flagged.agg(F.coalesce(F.max("is_match"), F.lit(False)).alias("any_match"))
    return flagged.crossJoin(F.broadcast(some)).where("is_match OR NOT any_match").drop("is_match", "any_match")


def since_year(c: Column, year: int) -> Column:
    """Dates dd/mm/yyyy from a year on; unreadable ones pass."""
    made = F.try_to_timestamp(c, F.lit("dd/MM/yyyy"))
    return made.isNull() | (F.year(made) >= year)


def page(ranked: DataFrame, number: int, size: int = 10) -> DataFrame:
    """One page by rank; the number is clamped to the pages that there are."""
    n = ranked.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / size)).alias("pages"))
    at = F.least(F.greatest(F.lit(number), F.lit(1)), "pages")
    return ranked.crossJoin(F.broadcast(n)).where(F.ceil(F.col("rank") / size) == at).drop("pages")


# --- evaluation ----------------------------------------------------------------------

def metrics(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """method, qid, precision, recall and mrr; queries without a relevant document are left out.

    Precision divides by k, whatever was retrieved; the reciprocal rank looks at the whole list.
    """
    n = relevant.groupBy("qid").agg(F.count(F.lit(1)).alias("n_relevant"))
    hit = ranked.join(relevant.withColumn("is_hit", F.lit(1)), ["qid", "doc_id"], "left")
    at_k = F.sum(F.when((F.col("rank") <= k) & F.col("is_hit").isNotNull(), 1).otherwise(0))
    first = F.min(F.when(F.col("is_hit").isNotNull(), F.col("rank")))
    per = hit.groupBy("method", "qid").agg(at_k.alias("hits"), first.alias("first_hit")).join(n, "qid")
    return per.select(
        "method", "qid", (F.col("hits") / k).alias("precision"), (F.col("hits") / F.col("n_relevant")).alias("recall"),
        F.coalesce(1 / F.col("first_hit"), F.lit(0.0)).alias("mrr"))


def has_keyword(c: Column, keywords: Column) -> Column:
    return F.exists(keywords, lambda w: F.contains(F.lower(F.coalesce(c, F.lit("none"))), F.lower(w)))


def pooled(lists: list[DataFrame]) -> DataFrame:
    """qid and doc_id in any of the ranked lists, once."""
    return reduce(DataFrame.unionByName, [x.select("qid", "doc_id") for x in lists]).distinct()
