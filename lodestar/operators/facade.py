"""The search engine as callers see it: stores, encoders, the three searches, requests with filters, evaluation."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import query as Q
from lodestar.functions import text as T
from lodestar.operators import search as S

#: Width of the hashing encoder's vectors.
DIM = 64
#: Candidates that a fused search asks of either side, and a search by place of the vectors, per result.
OVER, GEO_OVER = 3, 10
#: Decimal places of scores: sums of other orders tie where the exact ones do.
PLACES = 9


# --- encoding ------------------------------------------------------------------------

def hashed_terms(terms: list[str], dim: int = DIM) -> list[float]:
    """The unit vector of a list of terms: each adds 1 or -1 at a place that its md5 names. No terms: zeros."""
    v = [0.0] * dim
    for t in terms:
        h = hashlib.md5(t.encode()).hexdigest()
        v[int(h[:4], 16) % dim] += 1.0 if int(h[4], 16) < 8 else -1.0
    length = sum(x * x for x in v) ** 0.5
    return [x / length for x in v] if length else v


def encode_query(text: str) -> list[float]:
    """A query's vector, under the prefix that tells queries from passages."""
    return hashed_terms(Q.terms(query_prefix(text))[1:])


def query_prefix(text: str) -> str:
    return f"query: {text}"


def hashed_vectors(rows: DataFrame, keys: list[str], text: str, dim: int = DIM) -> DataFrame:
    """``keys`` and embedding of each row's text, as hashed_terms() makes it of the column's terms.

    Terms become places before anything is shuffled, and equal places of a row are summed
    there; a row has ``dim`` of them at most.
    """
    h = F.md5(F.col("term").cast("binary"))
    hexed = lambda a, n: F.conv(F.substring(h, a, n), 16, 10).cast("int")
    terms = rows.select(*keys, F.explode_outer(T.terms(F.col(text))).alias("term"))
    places = terms.select(*keys, (hexed(1, 4) % dim).alias("place"), F.when(hexed(5, 1) < 8, 1.0).otherwise(-1.0).alias("sign"))
    sums = places.groupBy(*keys, "place").agg(F.sum(F.when(F.col("place").isNotNull(), F.col("sign"))).alias("x"))
    entries = F.map_from_entries(F.filter(F.collect_list(F.struct("place", "x")), lambda e: e["place"].isNotNull()))
    found = sums.groupBy(*keys).agg(entries.alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return found.select(*keys, S.unit(dense).alias("embedding"))


def field_vectors(docs: DataFrame, name: str, industry: str, address: str, dim: int = DIM) -> DataFrame:
    """doc_id, slot and embedding of the four texts of each document; their prefix is left out again."""
    texts = T.field_passages(F.col(name), F.col(industry), F.col(address))
    cut = F.array(*[F.substring(c, len("passage: ") + 1, 1 << 30) for c in texts.values()])
    return hashed_vectors(docs.select("doc_id", F.posexplode(cut).alias("slot", "text")), ["doc_id", "slot"], "text", dim)


# --- stores --------------------------------------------------------------------------

def build_vectors(vectors: DataFrame, folder: str, model: str = "hashed terms", cells: int | None = None, sample: float = 1.0) -> VectorStore:
    """Writes doc_id, slot, embedding, by cell where ``cells`` asks for an approximate index, and one row about them."""
    spark = vectors.sparkSession
    rows, centres = vectors.select("doc_id", "slot", "embedding"), []
    if cells:
        centres, rows = S.coarse_cells(rows, cells, sample=sample)
        rows.write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/vectors")
    else:
        rows.write.mode("overwrite").parquet(f"{folder}/vectors")
    kept = spark.read.parquet(f"{folder}/vectors")
    about = kept.agg(
        F.lit(model).alias("model"), F.count_distinct("slot").cast("int").alias("num_fields"), F.max(F.size("embedding")).alias("dim"),
        F.count_distinct("doc_id").alias("num_documents"), F.lit("cells" if cells else "flat").alias("index_type"), F.lit("inner product").alias("metric"),
        F.lit([[float(x) for x in c] for c in centres] or None).cast("array<array<double>>").alias("centres"))
    about.write.mode("overwrite").parquet(f"{folder}/meta")
    return read_vectors(spark, folder)


@dataclass
class VectorStore:
    """Stored vectors and the row about them."""

    vectors: DataFrame
    meta: DataFrame

    def near(self, query: list[float], n_probe: int) -> DataFrame:
        """The vectors of the cells nearest to a query, by partition pruning; all of a flat store."""
        centres = self.meta.first()["centres"]
        return self.vectors.where(F.col("cell").isin(S.probe(centres, query, n_probe))) if centres else self.vectors


def read_vectors(spark: SparkSession, folder: str) -> VectorStore:
    return VectorStore(spark.read.parquet(f"{folder}/vectors"), spark.read.parquet(f"{folder}/meta"))


def fetch(docs: DataFrame, doc_id: int) -> DataFrame:
    """One document by its number; the filter reaches the scan and skips row groups."""
    return docs.where(F.col("doc_id") == doc_id)


def first_docs(docs: DataFrame, n: int) -> DataFrame:
    """The n documents with the smallest doc_id."""
    return docs.orderBy("doc_id").limit(n)


# --- searches ------------------------------------------------------------------------

def fused(lexical: DataFrame, vector: DataFrame, w_lexical: float, w_vector: float) -> DataFrame:
    """qid, doc_id, score, bm25, vector of two lists of hits: bm25 scaled to 100 by its query's best, both capped there.

    The lists are ranked and cut already, so what is joined is as long as they are.
    """
    best = F.max("score").over(Window.partitionBy("qid"))
    one = lexical.select("qid", "doc_id", F.least(F.lit(100.0), F.col("score") / F.when(best == 0, 1.0).otherwise(best) * 100).alias("bm25"))
    two = vector.select("qid", "doc_id", F.least(F.lit(100.0), "score").alias("vector"))
    both = one.join(two, ["qid", "doc_id"], "full_outer").na.fill(0.0, ["bm25", "vector"])
    return both.withColumn("score", F.round(F.col("bm25") * w_lexical + F.col("vector") * w_vector, PLACES))


def keep_matches(hits: DataFrame, docs: DataFrame, wanted: dict[int, str], column: str) -> DataFrame:
    """Of each query's hits those whose document has the query's place in ``column``; all where none has."""
    if not wanted:
        return hits
    own = reduce(lambda c, q: c.when((F.col("qid") == q) & S.contains_text(F.col(column), wanted[q]), True), wanted, F).otherwise(False)
    placed = S.fetched(hits, docs.select("doc_id", column)).withColumn("is_there", own)
    some = F.max("is_there").over(Window.partitionBy("qid"))
    return placed.withColumn("some_there", some).where("is_there OR NOT some_there").select(*hits.columns)


@dataclass
class SearchEngine:
    """An index, the documents, and vectors if there are any, behind one call.

    ``docs`` has doc_id, ``name``, ``address``, ``industry`` and ``status`` columns, by
    these names or those given. A query list has few entries, which the driver binds.
    """

    index: S.Index
    docs: DataFrame
    vectors: DataFrame | None = None
    encode: Callable[[str], list[float]] = encode_query
    weights: tuple[float, float] = (0.5, 0.5)
    name: str = "name"
    address: str = "address"
    industry: str = "industry"
    status: str = "status"
    places: Callable[[str], str | None] = Q.place

    def bm25(self, queries: dict[int, str], k: int = 10) -> DataFrame:
        """qid, doc_id, score and rank of each query's best by its expanded terms."""
        bound = [(q, Q.search_terms(t)[0]) for q, t in queries.items()]
        scores = S.bm25(self.index, S.query_rows(self.docs.sparkSession, bound)).withColumn("score", F.round("score", PLACES))
        return S.top(scores, k, "first_pos", "doc_id").select("qid", "doc_id", "score", "rank")

    def vector(self, queries: dict[int, str], k: int = 10) -> DataFrame:
        """qid, doc_id, score and rank by the best slot's inner product, 0 to 100.

        A query that names a place looks at the slot of whole documents only, and of its best
        GEO_OVER * k at those with the place in their address; where none has it, at all.
        """
        if self.vectors is None:
            raise ValueError("the engine has no vectors")
        spark = self.docs.sparkSession
        found = {q: self.places(t) for q, t in queries.items()}
        asked = spark.createDataFrame([(q, self.encode(t), found[q] is not None) for q, t in queries.items()], "qid int, q array<double>, by_place boolean")
        ip = S.dot(F.col("embedding"), F.col("q"))
        # a stated list of queries against all vectors: each task meets all queries, only the best leave it
        scored = self.vectors.join(F.broadcast(asked), ~F.col("by_place") | (F.col("slot") == S.SLOTS - 1)).select("qid", "doc_id", ip.alias("ip"))
        best = scored.groupBy("qid", "doc_id").agg(F.round(F.max("ip"), PLACES).alias("ip")).withColumn("score", F.greatest(F.lit(0.0), F.col("ip") * 100))
        order = Window.partitionBy("qid").orderBy(F.desc("ip"), "doc_id")
        hits = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k * (GEO_OVER if any(found.values()) else 1))
        hits = keep_matches(hits, self.docs, {q: p for q, p in found.items() if p}, self.address)
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "doc_id", "score", "rank")

    def hybrid(self, queries: dict[int, str], k: int = 10) -> DataFrame:
        """qid, doc_id, score, bm25, vector and rank: the best OVER * k of either side, fused, then by place as vector()."""
        both = fused(self.bm25(queries, OVER * k), self.vector(queries, OVER * k), *self.weights)
        both = keep_matches(both, self.docs, {q: p for q, t in queries.items() if (p := self.places(t))}, self.address)
        return S.top(both, k, "doc_id").select("qid", "doc_id", "score", "bm25", "vector", "rank")

    def search(self, text: str, top_k: int = 10, return_details: bool = False) -> DataFrame:
        """The fused search of one query with document columns; ``return_details`` adds a struct of the three scores."""
        hits = self.hybrid({0: text}, top_k)
        details = F.struct(F.col("score").alias("hybrid"), "bm25", "vector").alias("hybrid_scores")
        shown = hits.select("doc_id", "score", "rank", *[details] if return_details else [])
        return S.fetched(shown, self.docs)

    def ask(self, request: SearchRequest) -> DataFrame:
        """Hits of a request with document columns, filtered, ranked anew, and its page of them."""
        text = Q.effective(request.query, request.industry, request.province) if request.search_filters else request.query
        method = request.method if self.vectors is not None else "bm25"
        k = min(max(request.top_k, 10), 200)
        hits = getattr(self, method)({0: text}, k).drop("qid")
        rows = S.fetched(hits, self.docs).where(
            S.contains_text(F.col(self.address), request.province) & S.contains_text(F.col(self.industry), request.industry)
            & S.status_is(F.col(self.status), request.status))
        ranked = rows.withColumn("rank", F.row_number().over(Window.orderBy("rank")))  # 200 rows at most
        return S.page(ranked, request.page, request.page_size) if request.page else ranked

    def by_industry(self, industry: str, city: str, k: int = 10) -> DataFrame:
        """BM25 on an industry's terms, kept to a city's documents where there are any."""
        hits = keep_matches(self.bm25({0: industry}, OVER * k), self.docs, {0: city} if city else {}, self.address)
        return S.fetched(S.top(hits.drop("rank"), k, "doc_id").drop("qid"), self.docs)

    def explain(self, text: str, rank: int = 1) -> DataFrame:
        """doc_id, term, freq and score of the hit at ``rank`` of a BM25 search; no rows where there is none."""
        hit = self.bm25({0: text}, rank).where(F.col("rank") == rank).first()
        queries = S.query_rows(self.docs.sparkSession, [(0, Q.search_terms(text)[0])])
        found = S.explain(self.index, queries, hit["doc_id"] if hit else -1)
        return found.select(F.lit(hit["doc_id"] if hit else -1).cast("long").alias("doc_id"), "term", "freq", "score").where(F.lit(hit is not None))

    def card(self, hits: DataFrame) -> DataFrame:
        """What a result shows: rank, name, address, industry, status, whether active, and scores to two places."""
        have = [c for c in ("score", "bm25", "vector") if c in hits.columns]
        return S.fetched(hits.select("doc_id", "rank", *have), self.docs).select(
            "rank", "doc_id", F.col(self.name).alias("name"), F.col(self.address).alias("address"), F.col(self.industry).alias("industry"),
            F.col(self.status).alias("status"), S.status_is(F.col(self.status), S.ACTIVE).alias("active"), *[F.round(c, 2).alias(c) for c in have])


@dataclass
class SearchRequest:
    """What a user asks for. ``page`` 0 gives all hits."""

    query: str
    method: str = "hybrid"
    top_k: int = 50
    province: str = ""
    industry: str = ""
    status: str = ""
    page: int = 0
    page_size: int = 10
    #: Whether the texts of province and industry are searched for too.
    search_filters: bool = True

    def turned(self, page: int) -> SearchRequest:
        return replace(self, page=page)


# --- evaluation ----------------------------------------------------------------------

#: Hits that each method adds to the pool, and places that precision and recall look at.
POOL, AT = 50, 10


def pooled_runs(engine: SearchEngine, queries: dict[int, str], pool: int = POOL) -> DataFrame:
    """method, qid, doc_id, rank: the best of each method for all queries at once."""
    methods = ["bm25"] if engine.vectors is None else ["bm25", "vector", "hybrid"]
    return reduce(DataFrame.unionByName, [getattr(engine, m)(queries, pool).select(F.lit(m).alias("method"), "qid", "doc_id", "rank") for m in methods])


def evaluate(engine: SearchEngine, queries: dict[int, tuple[str, list[str]]], text: Column, pool: int = POOL, at: int = AT) -> DataFrame:
    """method, qid, precision, recall, mrr and num_relevant over pooled hits.

    A pooled document is relevant if ``text`` (a column of the documents) has one of the
    query's keywords. Queries without a relevant document in the pool are left out.
    """
    spark = engine.docs.sparkSession
    runs = pooled_runs(engine, {q: t for q, (t, _) in queries.items()}, pool)
    words = spark.createDataFrame([(q, w) for q, (_, w) in queries.items()], "qid int, keywords array<string>")
    texts = engine.docs.select("doc_id", text.alias("text_of"))
    relevant = S.fetched(S.pooled([runs]), texts).join(F.broadcast(words), "qid").where(S.has_keyword(F.col("text_of"), F.col("keywords"))).select("qid", "doc_id")
    counts = relevant.groupBy("qid").agg(F.count(F.lit(1)).alias("num_relevant"))
    return S.metrics(runs, relevant, at).join(counts, "qid")


def summary(results: DataFrame) -> DataFrame:
    return results.groupBy("method").agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "mrr")], F.count(F.lit(1)).alias("n_queries"))


def write_report(results: DataFrame, queries: dict[int, tuple[str, list[str]]], folder: str) -> str:
    """Writes results as CSV and JSON lines, and returns a Markdown report of the means, a row per method."""
    names = results.sparkSession.createDataFrame([(q, t) for q, (t, _) in queries.items()], "qid int, query string")
    rows = results.join(F.broadcast(names), "qid")
    rows.write.mode("overwrite").option("header", "true").csv(f"{folder}/results_csv")
    rows.write.mode("overwrite").json(f"{folder}/results_json")
    lines = ["| Method | Precision | Recall | MRR | Queries |", "|---|---|---|---|---|"]
    lines += [f"| {r['method']} | {r['precision']:.3f} | {r['recall']:.3f} | {r['mrr']:.3f} | {r['n_queries']} |" for r in summary(results).orderBy("method").collect()]
    report = "\n".join(lines) + "\n"
    results.sparkSession.createDataFrame([(report,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/report_md")
    return report
