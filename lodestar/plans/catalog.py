"""Every engine query over the driver's tables by name, and the same in DuckDB's SQL.

Documents stand in for companies (text is what is searched, lang the category, source the
status), embeddings for the four slots of a document, conversations for nested reviews.
Vietnamese rules have no rows there; they run on literal fixtures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import dictionaries as D
from lodestar.functions import query as Q
from lodestar.functions import text as T
from lodestar.operators import clean as C
from lodestar.operators import facade as A
from lodestar.operators import pages as P
from lodestar.operators import resolve as R
from lodestar.operators import search as S
from lodestar.sources import files
from lodestar.streaming import ingest

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql.strip()
        return f
    return add


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs_of(spark, d):
    """The documents, dealt to all cores where they are one file with fewer splits than there are cores."""
    docs, cores = table(spark, d, "documents"), spark.sparkContext.defaultParallelism
    if len(docs.inputFiles()) > 1:
        return docs
    n = docs._jdf.queryExecution().analyzed().stats().sizeInBytes()
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return docs.repartition(cores, "doc_id") if n < most * cores else docs


def fixture(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def lit(s):
    return "NULL" if s is None else "'" + str(s).replace("'", "''") + "'"


def values(rows, names):
    body = ", ".join("(" + ", ".join(str(x) if isinstance(x, (int, float)) else lit(x) for x in r) + ")" for r in rows)
    return f"(VALUES {body}) AS v({names})"


# --- SQL parts -----------------------------------------------------------------------

PHRASES = T.phrase_pattern().replace("'", "''")
STOPS = "[" + ", ".join(lit(w) for w in D.STOP_WORDS) + "]"


def words_sql(c):
    return rf"trim(regexp_replace(lower(trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g'))), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


def tokens_sql(c):
    return f"list_transform(regexp_extract_all({words_sql(c)}, '{PHRASES}'), lambda x: replace(rtrim(x), ' ', '_'))"


def terms_sql(c):
    return f"list_filter({tokens_sql(c)}, lambda x: length(x) > 1 AND NOT list_contains({STOPS}, x))"


TERMS = ["the", "thand", "nicht", "queon", "ing", "the"]
BATCH = [(0, TERMS), (1, ["der", "die", "ones"]), (2, ["absentterm", "oneres"]), (3, ["de", "eau"])]


def query_sql(batches):
    return values([(q, t, i) for q, ts in batches for i, t in enumerate(dict.fromkeys(ts))], "qid, term, pos")


def bm25_sql(batches, tail):
    return f"""
WITH toks AS (SELECT doc_id, {terms_sql('text')} AS terms FROM documents),
stats AS (SELECT doc_id, len(terms) AS dl FROM toks), meta AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM stats),
q AS (SELECT * FROM {query_sql(batches)}),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM toks) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
parts AS (SELECT qid, tf.doc_id, tf.term, pos, tf, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE
  / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS score
  FROM tf JOIN df USING (term) JOIN q USING (term) JOIN stats USING (doc_id), meta),
scores AS (SELECT qid, doc_id, sum(score) AS score, min(pos) AS first_pos FROM parts GROUP BY ALL)
{tail}"""


# --- text ----------------------------------------------------------------------------

@query(f"SELECT doc_id, CAST(len(t) AS INT) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)")
def txt_tokenize(spark, d):
    t = docs_of(spark, d).select("doc_id", T.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


@query(f"SELECT doc_id, array_to_string(t, ' ') AS terms FROM (SELECT doc_id, {terms_sql('text')} AS t FROM documents)")
def txt_stopwords(spark, d):
    return docs_of(spark, d).select("doc_id", F.array_join(T.terms(F.col("text")), " ").alias("terms"))


TEXTS = [(i, t) for i, t in enumerate([
    "Công ty TNHH công nghiệp dệt may Hà Nội", "nguyên phụ liệu may mặc", "Nhà hàng, quán ăn tại Hồ Chí Minh!", "công nghệ thông tin & phần mềm",
    "Thiết bị điện tử; linh kiện điện tử", "cần thơ có nước", "công_nghệ y  tế", "", None, "Điện Biên  Phủ 123"])]


@query(f"SELECT id, array_to_string({tokens_sql('text')}, ' ') AS tokens FROM {values(TEXTS, 'id, text')}")
def txt_segment_phrases(spark, d):
    return fixture(spark, TEXTS, "id int, text string").select("id", F.array_join(T.tokenize(F.col("text")), " ").alias("tokens"))


@query(r"SELECT doc_id, lower(nfc_normalize(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS norm FROM documents")
def txt_normalize(spark, d):
    return docs_of(spark, d).select("doc_id", T.normalize(T.nfc("text")).alias("norm"))


@query(rf"""SELECT id, trim(regexp_replace(regexp_replace(translate(lower(coalesce(text, '')), '{D.ACCENTED}', '{D.FOLDED}'), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS folded
FROM {values(TEXTS, 'id, text')}""")
def txt_ascii_fold(spark, d):
    return fixture(spark, TEXTS, "id int, text string").select("id", T.ascii_fold(F.col("text")).alias("folded"))


# --- index ---------------------------------------------------------------------------

@query(f"SELECT doc_id, term, CAST(count(*) AS INT) AS tf FROM (SELECT doc_id, unnest({terms_sql('text')}) AS term FROM documents) GROUP BY ALL")
def idx_term_frequency(spark, d):
    return S.postings(docs_of(spark, d))


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({terms_sql('text')}) AS term FROM documents) GROUP BY term")
def idx_document_frequency(spark, d):
    return S.postings(docs_of(spark, d)).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query(f"SELECT doc_id, CAST(len({terms_sql('text')}) AS INT) AS dl FROM documents")
def idx_doc_length(spark, d):
    return S.doc_stats(docs_of(spark, d))


@query(f"""SELECT count(DISTINCT doc_id) AS n_docs, CAST(sum(n) AS BIGINT) AS n_words, round(sum(n) / count(DISTINCT doc_id), 2) AS avg_words, count(DISTINCT term) AS vocabulary
FROM (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({terms_sql('text')}) AS term FROM documents) GROUP BY ALL)""")
def idx_corpus_stats(spark, d):
    p = S.postings(docs_of(spark, d))
    return p.agg(F.countDistinct("doc_id").alias("n_docs"), F.sum("tf").alias("n_words"),
                 F.round(F.sum("tf") / F.countDistinct("doc_id"), 2).alias("avg_words"), F.countDistinct("term").alias("vocabulary"))


@query(f"""SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, min(doc_id) AS first_doc, max(doc_id) AS last_doc
FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({terms_sql('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term""")
def idx_postings(spark, d):
    return S.postings(docs_of(spark, d)).groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


# --- BM25 ----------------------------------------------------------------------------

_BUILT: dict[tuple[str, str], S.Index] = {}


def built_index(spark, d) -> S.Index:
    """The written index of the tables' documents, built at a session's first search of them."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _BUILT:
        _BUILT[at] = S.write_index(docs_of(spark, d), files.shared_folder(spark))
    return _BUILT[at]


def _scores(spark, d, batches):
    return built_index(spark, d), S.query_rows(spark, batches)


@query(bm25_sql([(0, TERMS)], "SELECT doc_id, round(score, 6) AS score FROM scores"))
def bm25_scores(spark, d):
    index, q = _scores(spark, d, [(0, TERMS)])
    return S.bm25(index, q).select("doc_id", F.round("score", 6).alias("score"))


_TOP = """, r AS (SELECT qid, doc_id, round(score, 6) AS score, first_pos FROM scores),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first_pos, doc_id) AS rank FROM r)
SELECT {cols} FROM ranked {more} WHERE rank <= 10"""


@query(bm25_sql([(0, TERMS)], _TOP.format(cols="doc_id, score, CAST(rank AS INT) AS rank, lang, source", more="JOIN documents USING (doc_id)")))
def bm25_topk(spark, d):
    index, q = _scores(spark, d, [(0, TERMS)])
    hits = S.top(S.bm25(index, q).withColumn("score", F.round("score", 6)), 10, "first_pos", "doc_id")
    return S.fetched(hits, docs_of(spark, d)).select("doc_id", "score", "rank", "lang", "source")


@query(bm25_sql(BATCH, _TOP.format(cols="CAST(qid AS INT) AS qid, doc_id, score, CAST(rank AS INT) AS rank", more="")))
def bm25_batch(spark, d):
    index, q = _scores(spark, d, BATCH)
    return S.top(S.bm25(index, q).withColumn("score", F.round("score", 6)), 10, "first_pos", "doc_id").select("qid", "doc_id", "score", "rank")


@query(bm25_sql([(0, TERMS)], "SELECT q.term, CAST(coalesce(tf, 0) AS INT) AS freq, coalesce(round(score, 6), 0.0) AS score FROM q LEFT JOIN (SELECT * FROM parts WHERE doc_id = 7) p ON p.term = q.term"))
def bm25_explain(spark, d):
    index, q = _scores(spark, d, [(0, TERMS)])
    return S.explain(index, q, 7).select("term", "freq", F.round("score", 6).alias("score"))


@query(bm25_sql([(0, TERMS)], """SELECT doc_id, round(score, 6) AS score FROM scores
WHERE doc_id IN (SELECT doc_id FROM toks WHERE list_has_any(terms, ['ones', 'ndst'])) AND doc_id NOT IN (SELECT doc_id FROM toks WHERE list_has_any(terms, ['thand', 'reti']))"""))
def bm25_intent(spark, d):
    index, q = _scores(spark, d, [(0, TERMS)])
    return S.with_intent(S.bm25(index, q), index, ["ones", "ndst"], ["thand", "reti"]).select("doc_id", F.round("score", 6).alias("score"))


# --- vectors -------------------------------------------------------------------------

_VEC_Q = [round(((i * 37) % 64 - 31) / 64, 6) for i in range(64)]
_VEC_SQL = "[" + ", ".join(f"{x}::DOUBLE" for x in _VEC_Q) + "]"
_IP = f"list_dot_product(embedding::DOUBLE[], {_VEC_SQL})"


def _vectors(spark, d):
    return S.slots(table(spark, d, "embeddings"))


@query(f"SELECT vec_id, cosine FROM (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_VEC_SQL}), 6) AS cosine FROM embeddings) ORDER BY cosine DESC, vec_id LIMIT 20")
def vec_cosine_topk(spark, d):
    q = F.array(*[F.lit(x) for x in _VEC_Q])
    s = table(spark, d, "embeddings").select("vec_id", F.round(S.cosine(F.col("embedding"), q), 6).alias("cosine"))
    return s.orderBy(F.desc("cosine"), "vec_id").limit(20)


@query(f"SELECT vec_id // 4 AS doc_id, round(greatest(0.0, max({_IP})) * 100, 6) AS score FROM embeddings GROUP BY 1")
def vec_slot_max(spark, d):
    return S.vector_scores(_vectors(spark, d), _VEC_Q).select("doc_id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id // 4 AS doc_id, round(greatest(0.0, max({_IP})) * 100, 6) AS score FROM embeddings WHERE vec_id % 4 = 3 GROUP BY 1")
def vec_geo_slot3(spark, d):
    return S.vector_scores(_vectors(spark, d), _VEC_Q, slot=3).select("doc_id", F.round("score", 6).alias("score"))


@query("""SELECT vec_id, round(sqrt(list_dot_product(u, u)), 6) AS length, round(u[1], 6) AS first, round(u[64], 6) AS last
FROM (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 3) AS v FROM embeddings))""")
def vec_normalize(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", S.unit(F.transform("embedding", lambda x: x.cast("double") * 3)).alias("u"))
    return v.select("vec_id", F.round(F.sqrt(S.dot(F.col("u"), F.col("u"))), 6).alias("length"), F.round(F.get("u", F.lit(0)), 6).alias("first"), F.round(F.get("u", F.lit(63)), 6).alias("last"))


COMPANIES = [(0, "Cty A", "Dệt may", "Số 2, Xã A, Huyện B, Bình Định"), (1, "nan", "", None), (2, "Cty C", "None", "Hà Nội"), (3, "", "bán lẻ", "Số 1,"), (4, "Cty Đ", None, "")]


@query(f"""WITH c AS (SELECT id, {', '.join(f"CASE WHEN lower(trim(coalesce({x}, ''))) IN ('', 'nan', 'none') THEN NULL ELSE trim({x}) END AS {x}" for x in ('name', 'industry', 'address'))}
FROM {values(COMPANIES, 'id, name, industry, address')})
SELECT id, 'passage: ' || coalesce(name, 'unknown') AS slot0, 'passage: ' || coalesce(industry, 'unknown') AS slot1,
'passage: ' || coalesce(nullif(trim(list_extract(string_split(address, ','), -1)), ''), 'unknown') AS slot2,
'passage: ' || coalesce(nullif(concat_ws(' ', name, industry, address), ''), 'unknown') AS slot3 FROM c""")
def vec_field_texts(spark, d):
    c = fixture(spark, COMPANIES, "id int, name string, industry string, address string")
    return c.select("id", *[x.alias(k) for k, x in T.field_passages(F.col("name"), F.col("industry"), F.col("address")).items()])


@query()
def vec_ann(spark, d):
    """Approximate search: every hundredth vector's best ten of the twelve nearest of sixteen cells."""
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return S.ann_search(e, asked, 10, 12).select("query_id", "vec_id", F.round("ip", 6).alias("ip"))


_FUSED = bm25_sql([(0, TERMS)], f""", vec AS (SELECT vec_id // 4 AS doc_id, greatest(0.0, max({_IP})) * 100 AS score FROM embeddings GROUP BY 1),
b AS (SELECT doc_id, least(100.0, score / (SELECT CASE WHEN max(score) = 0 THEN 1 ELSE max(score) END FROM scores) * 100) AS bm25 FROM scores),
h AS (SELECT doc_id, coalesce(bm25, 0.0) AS bm25, least(100.0, coalesce(score, 0.0)) AS vector FROM b FULL JOIN vec USING (doc_id)),
f AS (SELECT *, bm25 * 0.65::DOUBLE + vector * 0.35::DOUBLE AS hybrid FROM h)
""")


def _fused(spark, d):
    index, q = _scores(spark, d, [(0, TERMS)])
    return S.fuse(S.bm25(index, q).select("doc_id", "score"), S.vector_scores(_vectors(spark, d), _VEC_Q), 0.65, 0.35)


@query(_FUSED + "SELECT doc_id, round(hybrid, 6) AS hybrid FROM f")
def hybrid_fusion(spark, d):
    return _fused(spark, d).select("doc_id", F.round("hybrid", 6).alias("hybrid"))


@query(_FUSED + "SELECT doc_id, round(hybrid, 6) AS hybrid, round(bm25, 6) AS bm25, round(vector, 6) AS vector FROM f ORDER BY 2 DESC, 1 LIMIT 50")
def hybrid_details(spark, d):
    return _fused(spark, d).select("doc_id", *[F.round(c, 6).alias(c) for c in ("hybrid", "bm25", "vector")]).orderBy(F.desc("hybrid"), "doc_id").limit(50)


# --- filters and pages ---------------------------------------------------------------

STATUSES = [(0, "Đang hoạt động"), (1, "đang hoạt động (đã được cấp)"), (2, "Ngừng hoạt động"), (3, ""), (4, None)]


@query(f"SELECT id, contains(lower(coalesce(s, '')), 'đang hoạt động') AS active, NOT contains(lower(coalesce(s, '')), 'đang hoạt động') AS inactive, true AS any_status FROM {values(STATUSES, 'id, s')}")
def flt_status(spark, d):
    s = F.col("s")
    return fixture(spark, STATUSES, "id int, s string").select("id", S.status_is(s, S.ACTIVE).alias("active"), S.status_is(s, S.INACTIVE).alias("inactive"), S.status_is(s, "").alias("any_status"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'thand') AND contains(lower(lang), 'en')")
def flt_substring(spark, d):
    return docs_of(spark, d).where(S.contains_text(F.col("text"), "Thand") & S.contains_text(F.col("lang"), "en")).select("doc_id")


_GEO = "WITH m AS (SELECT doc_id, contains(lower(text), {w}) AS hit FROM documents) SELECT doc_id, {k} AS k FROM m WHERE hit OR NOT (SELECT coalesce(bool_or(hit), false) FROM m)"


@query(_GEO.format(w="'thand'", k=0) + " UNION ALL " + f"({_GEO.format(w=lit('hà nội'), k=1)})")
def flt_geo_fallback(spark, d):
    one = lambda part, k: S.or_all(docs_of(spark, d), S.contains_text(F.col("text"), part)).select("doc_id", F.lit(k).alias("k"))
    return one("thand", 0).union(one("hà nội", 1))


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) >= 1997")
def flt_year(spark, d):
    return table(spark, d, "orders").where(S.since_year(F.date_format("o_orderdate", "dd/MM/yyyy"), 1997)).select("o_orderkey")


_PAGE = "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE lang = 'en')"


@query(_PAGE + " SELECT doc_id, CAST(rank AS INT) AS rank FROM r WHERE ceil(rank / 10) = 3")
def page_results(spark, d):
    best = docs_of(spark, d).where("lang = 'en'").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(100)
    return S.page(best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id"))), 3).select("doc_id", "rank")


# --- sets ----------------------------------------------------------------------------

@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def set_dedup_keep_first(spark, d):
    return R.keep_first(docs_of(spark, d).select("doc_id", "source", F.sha2("text", 256).alias("k")), ["k"], "doc_id").select("doc_id", "source")


@query("SELECT doc_id FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 1")
def set_duplicates_all(spark, d):
    return R.all_duplicates(docs_of(spark, d).select("doc_id", F.sha2("text", 256).alias("k")), ["k"]).select("doc_id")


@query("SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark")
def set_union(spark, d):
    return docs_of(spark, d).select(F.col("doc_id").alias("id"), "text").unionByName(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"))


@query("SELECT doc_id FROM documents WHERE lang = 'de' UNION SELECT doc_id FROM documents WHERE source = 'src1' UNION SELECT doc_id FROM labels WHERE toxic = 1")
def set_pool_union(spark, d):
    docs = docs_of(spark, d)
    lists = [docs.where("lang = 'de'"), docs.where("source = 'src1'"), table(spark, d, "labels").where("toxic = 1")]
    return S.pooled([x.select(F.lit(0).alias("qid"), "doc_id") for x in lists]).select("doc_id")


# --- joins ---------------------------------------------------------------------------

REG_A = [("0101", "A", "x"), ("0102", None, "y"), (None, "nokey", "p")]
REG_B = [("0101 - 01/02/2020", "B", "z"), ("0102 - 03/04/2021", "B2", "w"), ("0199 - 1/1/2001", "B3", None), (None, "nokey b", "q")]


@query(f"""WITH a AS (SELECT coalesce(k, 'nan') AS k, name, city FROM {values(REG_A, 'k, name, city')}),
b AS (SELECT coalesce(split_part(k, ' - ', 1), 'nan') AS k, name, city FROM {values(REG_B, 'k, name, city')})
SELECT coalesce(a.k, b.k) AS k, coalesce(a.name, b.name) AS name, coalesce(a.city, b.city) AS city FROM a FULL JOIN b ON a.k = b.k""")
def join_registry_full_outer(spark, d):
    s = "k string, name string, city string"
    b = fixture(spark, REG_B, s).withColumn("k", R.key_before_dash(F.col("k")))
    return R.merge_registries(fixture(spark, REG_A, s), b, "k", ["name", "city"], compat=True)


@query("""SELECT coalesce(c_custkey, s_suppkey) AS id, coalesce(c_nationkey, s_nationkey) AS nation, coalesce(c_acctbal, s_acctbal) AS balance
FROM customer FULL JOIN supplier ON c_custkey = s_suppkey + 1000""")
def join_registry_tables(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    s = table(spark, d, "supplier").select((F.col("s_suppkey") + 1000).alias("k"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return R.merge_registries(c, s, "k", ["id", "nation", "balance"]).drop("k")


def _norm_sql(c):
    return rf"trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"""WITH c AS (SELECT p_partkey AS left_id, {_norm_sql("p_name || ' ' || p_brand")} AS name FROM part),
r AS (SELECT id AS right_id, {_norm_sql('name')} AS name FROM {values([(0, 'small ring Brand 2'), (1, 'widget Brand#17'), (2, 'red widget brand 1'), (3, ''), (4, 'ring'), (5, 'red widget brand#17!')], 'id, name')}),
m AS (SELECT left_id, right_id, r.name AS right_name, CASE WHEN c.name = '' AND r.name = '' THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * least(length(c.name), length(r.name)) / greatest(length(c.name) + length(r.name), 1) END AS score
  FROM c, r WHERE contains(c.name, r.name) OR contains(r.name, c.name)),
b AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) AS n FROM m WHERE score >= 83)
SELECT left_id, CAST(right_id AS BIGINT) AS right_id, right_name, round(score, 6) AS score FROM b WHERE n = 1""")
def join_fuzzy_substring(spark, d):
    reviews = [(0, "small ring Brand 2"), (1, "widget Brand#17"), (2, "red widget brand 1"), (3, ""), (4, "ring"), (5, "red widget brand#17!")]
    left = table(spark, d, "part").select(F.col("p_partkey").alias("left_id"), T.ascii_fold(F.concat_ws(" ", "p_name", "p_brand")).alias("name"))
    right = fixture(spark, reviews, "id long, name string").select(F.col("id").alias("right_id"), T.ascii_fold(F.col("name")).alias("name"))
    return R.substring_matches(left, right).withColumn("score", F.round("score", 6))


@query("""WITH c AS (SELECT label, list(mean ORDER BY i) AS centre FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS mean FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY ALL) GROUP BY label),
u AS (SELECT label, list_transform(centre, lambda x: x / sqrt(list_dot_product(centre, centre))) AS centre FROM c),
s AS (SELECT vec_id AS id, CAST(u.label AS BIGINT) AS match_id, list_dot_product(embedding::DOUBLE[], centre) AS cosine FROM embeddings, u)
SELECT id, match_id, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, match_id) AS n FROM s) WHERE n = 1 AND cosine >= 0.2""")
def join_semantic_argmax(spark, d):
    """Every vector and the label whose mean direction is nearest to it."""
    e = table(spark, d, "embeddings")
    large = e.select(F.col("vec_id").alias("id"), F.lit("n").alias("name"), F.col("embedding").alias("vec"))
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    centres = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "mean"))), lambda x: x["mean"]).alias("v"))
    small = centres.select(F.col("label").cast("long").alias("id"), F.lit("n").alias("name"), S.unit(F.col("v")).alias("vec"))
    return R.semantic_matches(large, small, 0.2, None).select("id", "match_id", F.round("cosine", 6).alias("cosine"))


@query("""WITH base AS (SELECT conv_id, role AS title, md5(text) AS meta FROM conversations WHERE turn = 0),
extra AS (SELECT DISTINCT conv_id, role AS title, md5(text) AS meta FROM conversations)
SELECT conv_id, count(*) AS n_reviews FROM (SELECT * FROM base UNION ALL (SELECT * FROM extra EXCEPT SELECT * FROM base)) GROUP BY conv_id""")
def join_append_reviews(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("title"), F.md5(F.col("text").cast("binary")).alias("meta"))
    base = c.where("turn = 0").groupBy("conv_id").agg(F.collect_list(F.struct("title", "meta")).alias("reviews"))
    return R.append_reviews(base, c.withColumnRenamed("turn", "seq"), "conv_id").select("conv_id", F.size("reviews").cast("long").alias("n_reviews"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def join_anti_seen(spark, d):
    return R.unseen(docs_of(spark, d), table(spark, d, "labels"), "doc_id").select("doc_id")


# --- nesting -------------------------------------------------------------------------

@query("SELECT conv_id, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def nest_reviews(spark, d):
    lists = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return lists.select("conv_id", F.size("r").cast("long").alias("n"), F.array_join(F.transform("r", lambda x: x["role"]), ",").alias("roles"))


@query("SELECT conv_id, count(*) FILTER (role = 'user') AS n FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'user') > 0")
def nest_project_reviews(spark, d):
    c = table(spark, d, "conversations").withColumn("v", F.when(F.col("role") == "user", F.col("text")))
    names = ("rating", "role", "title", "meta", "pros", "cons")
    review = F.struct(*[(F.col("v") if k == "pros" else F.lit("")).alias(k) for k in names])
    lists = c.groupBy("conv_id").agg(F.collect_list(review).alias("r")).select("conv_id", R.project_reviews(F.col("r")).alias("r"))
    return lists.where("r IS NOT NULL").select("conv_id", F.size("r").cast("long").alias("n"))


@query("SELECT conv_id, turn, '[{\"role\":\"' || role || '\",\"n\":' || CAST(length(text) AS VARCHAR) || '}]' AS reviews FROM conversations")
def nest_root_review(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    return R.root_review(c, ("role", "n")).withColumn("reviews", F.to_json("reviews"))


# --- cleaning ------------------------------------------------------------------------

DIRTY = [(0, '"Cty ""A"" (VN)"  '), (1, "  a \t b.  "), (2, None), (3, "Cty B. "), (4, '""'), (5, "1/2/2020"), (6, "ngày 03/12/1999 (x)"), (7, "12/2020")]
_CLEAN = r"""trim(regexp_replace(regexp_replace(trim(replace(coalesce(s, ''), '""', '"'), '"'), '[()]', '', 'g'), '\s+', ' ', 'g'))"""


@query(rf"SELECT id, {_CLEAN} AS clean, regexp_replace({_CLEAN}, '\.\s*$', '') AS company FROM {values(DIRTY, 'id, s')}")
def cln_text(spark, d):
    s = F.col("s")
    return fixture(spark, DIRTY, "id int, s string").select("id", T.clean_text(s).alias("clean"), T.clean_company_name(s).alias("company"))


_DATE = r"'(\d{1,2})/(\d{1,2})/(\d{4})'"


@query(rf"""SELECT id, CASE WHEN regexp_matches(c, {_DATE}) THEN lpad(regexp_extract(c, {_DATE}, 1), 2, '0') || '/' || lpad(regexp_extract(c, {_DATE}, 2), 2, '0') || '/' || regexp_extract(c, {_DATE}, 3) ELSE c END AS date
FROM (SELECT id, {_CLEAN} AS c FROM {values(DIRTY, 'id, s')})""")
def cln_date(spark, d):
    return fixture(spark, DIRTY, "id int, s string").select("id", T.normalize_date(F.col("s")).alias("date"))


# fixed values: sample addresses of the registry
ADDRESSES = [(i, a) for i, a in enumerate([
    "5 7 Nguyễn Huệ, Quận 1, TP Hồ Chí Minh", "12 14 16 Lê Thánh Tông, Quận 1", "29 31, 33 Nguyễn Văn Trỗi P.12, Quận Phú Nhuận", "25C 5 Chu Văn An P.26, Quận Bình Thạnh",
    "5 C/1 Nguyễn Oanh, Quận Gò Vấp", "Lô A 2 Khu Công Nghiệp, Phường 3", "HCM, 70000", "SN 5,,Phố Huế", "Khu ất Duy Tiến", "5 Sư Thiện Chiếu P.07, Phường 07, Quận 3", "", None])]


# what the rules make of ADDRESSES, traced by hand
CLEANED = ["5-7 Nguyễn Huệ, Quận 1, TP Hồ Chí Minh", "12-14-16 Lê Thánh Tông, Quận 1", "29-31-33 Nguyễn Văn Trỗi P.12, Quận Phú Nhuận",
           "25C/5 Chu Văn An P.26, Quận Bình Thạnh", "5C/1 Nguyễn Oanh, Quận Gò Vấp", "Lô A2 Khu Công Nghiệp, Phường 3", "HCM/7-0000", "5, Phố Huế",
           "Khuất Duy Tiến", "5 Sư Thiện Chiếu Phường 07, Quận 3", "", None]


@query(f"SELECT id, address FROM {values(list(enumerate(CLEANED)), 'id, address')}")
def cln_address(spark, d):
    """House-number rules need look-around, which DuckDB lacks: the SQL has the expected texts."""
    return fixture(spark, ADDRESSES, "id int, a string").select("id", T.clean_address(F.col("a")).alias("address"))


LOGGED = [(0, "x - Địa chỉ 1:  Số 5 Hà Nội  - Căn cứ: y"), (1, "  Số 7 "), (2, None), (3, "- Địa chỉ 1:a- Căn cứ:b- Căn cứ:")]


@query(rf"""SELECT id, CASE WHEN a IS NULL THEN NULL WHEN regexp_matches(a, '- Địa chỉ 1:\s*(.*?)\s*- Căn cứ:') THEN trim(regexp_extract(a, '- Địa chỉ 1:\s*(.*?)\s*- Căn cứ:', 1)) ELSE trim(a) END AS address FROM {values(LOGGED, 'id, a')}""")
def cln_address_log(spark, d):
    return fixture(spark, LOGGED, "id int, a string").select("id", T.clean_address_log(F.col("a")).alias("address"))


BROKEN = [(0, "a�b"), (1, "nhÃ â€™x"), (2, "aâ€“bâ€”câ€œd"), (3, None), (4, "ok")]


@query("SELECT id, " + "replace(" * 6 + "s" + "".join(f", {lit(a)}, {lit(b)})" for a, b in T.MOJIBAKE) + f" AS s FROM {values(BROKEN, 'id, s')}")
def cln_mojibake(spark, d):
    return fixture(spark, BROKEN, "id int, s string").select("id", T.repair(F.col("s")).alias("s"))


@query(r"""SELECT doc_id FROM (SELECT doc_id, text, lang, CASE WHEN doc_id % 7 = 3 THEN source || '�' ELSE source END AS source FROM documents)
WHERE contains(concat_ws(' ', text, lang, source), '�')""")
def cln_bad_chars(spark, d):
    """Rows with a broken character in any field; every seventh source is given one."""
    broken = docs_of(spark, d).withColumn("source", F.when(F.col("doc_id") % 7 == 3, F.concat("source", F.lit("�"))).otherwise(F.col("source")))
    return broken.where(F.contains(F.concat_ws(" ", "text", "lang", "source"), F.lit("�"))).select("doc_id")


NOTED = [(0, "Bán lẻ (Xem danh sách)"), (1, "Dệt may"), (2, None), (3, "(Xem danh sách)"), (4, "★ Cty-A ★"), (5, "A-b")]


@query(rf"""SELECT id, trim(regexp_replace(s, '\s*\(Xem danh sách\)', '', 'g')) AS industry, trim(translate(lower(coalesce(s, '')), '★-', '  ')) AS review_name
FROM {values(NOTED, 'id, s')}""")
def cln_list_note(spark, d):
    s = F.col("s")
    return fixture(spark, NOTED, "id int, s string").select("id", T.drop_list_note(s).alias("industry"), T.review_name(s).alias("review_name"))


# --- files ---------------------------------------------------------------------------

@query("SELECT doc_id, text, lang, source FROM documents")
def src_json_lines(spark, d):
    """All documents written as JSON lines and read back."""
    at = files.shared_folder(spark)
    files.write_json_lines(table(spark, d, "documents").select("doc_id", "text", "lang", "source"), at)
    return spark.read.schema("doc_id long, text string, lang string, source string").json(at)


@query("SELECT conv_id, turn, role, text FROM conversations")
def src_csv(spark, d):
    """All conversations appended as quoted CSV and read back."""
    at = files.shared_folder(spark)
    files.append_csv(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), at)
    return files.read_csv(spark, at, "conv_id long, turn long, role string, text string")


# --- pages ---------------------------------------------------------------------------

@query("""SELECT page_id, CAST(i - 1 AS INT) AS pos, CASE WHEN starts_with(hrefs[i], 'http') THEN hrefs[i] ELSE regexp_extract(url, '^(https?://[^/]+)', 1) || hrefs[i] END AS link
FROM (SELECT page_id, url, hrefs, unnest(range(1, len(hrefs) + 1)) AS i FROM (SELECT page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hrefs FROM pages))""")
def html_links(spark, d):
    return P.links(table(spark, d, "pages"))


@query("SELECT page_id, url, " + ", ".join(f"'' AS {c}" for c in P.COMPANY) + " FROM pages")
def html_fields(spark, d):
    """The crawled pages are no registry pages: no field is found in any."""
    return P.parse_companies(table(spark, d, "pages"))


COMPANY_PAGE = """<div class="m-panel-heading main-heading"><h1> Cty ""A"" </h1></div><div itemprop="taxID">0101</div><div itemprop="address">Hà Nội<br></div>
<div class="responsive-table-cell">Tên giao dịch</div><div class="responsive-table-cell">A JSC</div><div class="responsive-table-cell">Tình trạng hoạt động</div>
<div class="responsive-table-cell">Đang hoạt động</div><div class="responsive-table-cell">Ngày cấp giấy phép:</div><div class="responsive-table-cell">1/2/2020</div>
<div class="nnkd-table"><div class="responsive-table-cell">Bán lẻ (Ngành chính)</div></div>"""
COMPANY_FOUND = [(1, "u", 'Cty "A', "A JSC", "0101", "Hà Nội", "Đang hoạt động", "1/2/2020", "Bán lẻ"), (2, "v", "", "", "", "", "", "", "")]


@query(f"SELECT CAST(page_id AS BIGINT) AS page_id, url, {', '.join(P.COMPANY)} FROM {values(COMPANY_FOUND, 'page_id, url, ' + ', '.join(P.COMPANY))}")
def html_company(spark, d):
    """A registry page and one without fields; the SQL has the expected texts."""
    return P.parse_companies(fixture(spark, [(1, "u", COMPANY_PAGE), (2, "v", None)], "page_id long, url string, html string"))


# --- evaluation ----------------------------------------------------------------------

_METHODS = {"short": "n_chars ASC", "long": "n_chars DESC"}
_EVAL_SQL = f"""WITH r AS ({' UNION ALL '.join(f"SELECT '{m}' AS method, lang AS qid, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {o}, doc_id) AS rank FROM documents" for m, o in _METHODS.items())}),
ranked AS (SELECT * FROM r WHERE rank <= 50), rel AS (SELECT lang AS qid, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
n AS (SELECT qid, count(*) AS n FROM rel GROUP BY qid),
m AS (SELECT method, ranked.qid, count(rel.doc_id) FILTER (rank <= 10) / 10 AS precision, count(rel.doc_id) FILTER (rank <= 10) / any_value(n.n) AS recall,
  coalesce(1 / min(CASE WHEN rel.doc_id IS NOT NULL THEN rank END), 0.0) AS mrr
  FROM ranked LEFT JOIN rel ON rel.qid = ranked.qid AND rel.doc_id = ranked.doc_id JOIN n ON n.qid = ranked.qid GROUP BY method, ranked.qid)
"""


def _metrics(spark, d):
    docs = docs_of(spark, d).select("doc_id", F.col("lang").alias("qid"), "n_chars")
    lists = [
        S.top(docs.withColumn("score", F.col("n_chars") * sign), 50, "doc_id").select(F.lit(m).alias("method"), "qid", "doc_id", "rank")
        for m, sign in (("short", -1), ("long", 1))
    ]
    good = table(spark, d, "labels").where("quality = 1").join(docs, "doc_id").select("qid", "doc_id")
    return S.metrics(lists[0].union(lists[1]), good)


@query(_EVAL_SQL + "SELECT method, qid, round(precision, 6) AS precision FROM m")
def eval_precision(spark, d):
    return _metrics(spark, d).select("method", "qid", F.round("precision", 6).alias("precision"))


@query(_EVAL_SQL + "SELECT method, qid, round(recall, 6) AS recall FROM m")
def eval_recall(spark, d):
    return _metrics(spark, d).select("method", "qid", F.round("recall", 6).alias("recall"))


@query(_EVAL_SQL + "SELECT method, qid, round(mrr, 6) AS mrr FROM m")
def eval_mrr(spark, d):
    return _metrics(spark, d).select("method", "qid", F.round("mrr", 6).alias("mrr"))


@query(_EVAL_SQL + "SELECT method, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, count(*) AS n_queries FROM m GROUP BY method")
def eval_summary(spark, d):
    return _metrics(spark, d).groupBy("method").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "mrr")], F.count(F.lit(1)).alias("n_queries"))


# --- streams -------------------------------------------------------------------------

@query("SELECT event_id, user_id, event_type FROM events")
def stream_ingest_dedup(spark, d):
    """The events as a stream into a table, one row per event_id; read back as a batch."""
    out = files.shared_folder(spark)
    rows = table(spark, d, "events")
    stream = ingest.source(spark, f"{d}/event[s].parquet", rows.schema).select("event_id", "user_id", "event_type")
    ingest.ingest_once(stream, f"{out}/table", f"{out}/checkpoint", "event_id")
    return spark.read.parquet(f"{out}/table")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark, d):
    w = ingest.windowed(table(spark, d, "events"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


# --- the engine behind one call -------------------------------------------------------

#: Queries of the tables: text, keywords, and the stored vector that stands for the text.
ASKED = {0: ("thand ing", ["thand"]), 1: ("nicht queon", ["nicht", "queon"]), 2: ("eau ones in fr", ["eau", "ones"]), 3: ("absentterm", ["absentterm"])}
_VECTOR_OF = {q: 9 * q for q in ASKED}


def _place(text):
    return text.rpartition(" in ")[2] if " in " in text else None


def engine_of(spark, d):
    """The documents as companies (lang is the address, source the status), with their stored vectors."""
    e = table(spark, d, "embeddings")
    known = {r["vec_id"]: [float(x) for x in r["embedding"]] for r in e.where(F.col("vec_id").isin(list(_VECTOR_OF.values()))).collect()}
    by_text = {t: known[_VECTOR_OF[q]] for q, (t, _) in ASKED.items()}
    docs = docs_of(spark, d).withColumns({"name": F.col("source"), "address": F.col("lang"), "industry": F.col("source"), "status": F.col("source")})
    return A.SearchEngine(built_index(spark, d), docs, _vectors(spark, d), by_text.get, (0.65, 0.35), places=_place)


_ASKED_TEXTS = {q: t for q, (t, _) in ASKED.items()}
_ASKED_TERMS = [(q, Q.search_terms(t)[0]) for q, t in _ASKED_TEXTS.items()]


def _ranked(name, rows, order, k, more=""):
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {order}) AS rank FROM {rows}) WHERE rank <= {k}{more})"


def _engine_sql(k, tail):
    """Lists of k by either method, and the fused one."""
    places = values([(q, p) for q, t in _ASKED_TEXTS.items() if (p := _place(t))], "qid, place")
    kept = lambda name, rows: f"""{name} AS (SELECT * FROM (SELECT h.*, p.place IS NULL OR contains(lower(lang), p.place) AS there,
  bool_or(p.place IS NOT NULL AND contains(lower(lang), p.place)) OVER (PARTITION BY h.qid) AS some_there
  FROM {rows} h JOIN documents USING (doc_id) LEFT JOIN {places.replace(' AS v(', ' AS p(')} ON p.qid = h.qid) WHERE there OR NOT some_there)"""
    lists = lambda n, k: f"""{_ranked(f'b{n}', '(SELECT qid, doc_id, round(score, 9) AS score, first_pos FROM scores)', 'score DESC, first_pos, doc_id', k)},
{_ranked(f'v0{n}', 'vs', 'ip DESC, doc_id', 10 * k)}, {kept(f'v1{n}', f'v0{n}')},
{_ranked(f'v{n}', f'(SELECT qid, doc_id, ip, score FROM v1{n})', 'ip DESC, doc_id', k)}"""
    return bm25_sql(_ASKED_TERMS, f""", vq AS (SELECT a.qid, embedding::DOUBLE[] AS q, p.place IS NOT NULL AS by_place FROM {values([(q, v) for q, v in _VECTOR_OF.items()], 'qid, vec').replace(' AS v(', ' AS a(')}
  JOIN embeddings ON vec_id = a.vec LEFT JOIN {places.replace(' AS v(', ' AS p(')} ON p.qid = a.qid),
vs AS (SELECT qid, vec_id // 4 AS doc_id, round(max(list_dot_product(embedding::DOUBLE[], q)), 9) AS ip,
  greatest(0.0, round(max(list_dot_product(embedding::DOUBLE[], q)), 9) * 100) AS score FROM embeddings, vq WHERE NOT by_place OR vec_id % 4 = 3 GROUP BY ALL),
{lists('', k)}, {lists('w', 3 * k)},
h0 AS (SELECT qid, doc_id, coalesce(b, 0.0) AS bm25, coalesce(v, 0.0) AS vector FROM
  (SELECT qid, doc_id, least(100.0, score / max(score) OVER (PARTITION BY qid) * 100) AS b FROM bw) FULL JOIN (SELECT qid, doc_id, least(100.0, score) AS v FROM vw) USING (qid, doc_id)),
h1 AS (SELECT *, round(bm25 * 0.65::DOUBLE + vector * 0.35::DOUBLE, 9) AS score FROM h0), {kept('h2', 'h1')},
{_ranked('h', '(SELECT qid, doc_id, bm25, vector, score FROM h2)', 'score DESC, doc_id', k)}
{tail}""")


_HITS = "CAST(qid AS INT) AS qid, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank"


@query(_engine_sql(10, f"SELECT {_HITS} FROM v"))
def search_vector(spark, d):
    return engine_of(spark, d).vector(_ASKED_TEXTS).withColumn("score", F.round("score", 6))


@query(_engine_sql(10, f"SELECT {_HITS}, round(bm25, 6) AS bm25, round(vector, 6) AS vector FROM h"))
def search_hybrid(spark, d):
    return engine_of(spark, d).hybrid(_ASKED_TEXTS).withColumns({c: F.round(c, 6) for c in ("score", "bm25", "vector")})


@query(_engine_sql(10, "SELECT h.doc_id, round(h.score, 6) AS score, CAST(h.rank AS INT) AS rank, source, lang, round(vector, 6) AS vector FROM h JOIN documents USING (doc_id) WHERE h.qid = 0"))
def api_hybrid_search(spark, d):
    found = engine_of(spark, d).search(_ASKED_TEXTS[0], return_details=True)
    return found.select("doc_id", F.round("score", 6).alias("score"), "rank", "source", "lang", F.round("hybrid_scores.vector", 6).alias("vector"))


@query(_engine_sql(50, """, kept AS (SELECT b.doc_id, score, row_number() OVER (ORDER BY rank) AS rank FROM b JOIN documents USING (doc_id) WHERE qid = 0 AND contains(lower(lang), 'en') AND contains(lower(source), 'src'))
SELECT doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM kept WHERE ceil(rank / 5) = least(2, greatest(1, ceil((SELECT count(*) FROM kept) / 5)))"""))
def api_request(spark, d):
    """A BM25 request with filters, its second page of five. An engine without vectors falls back to BM25."""
    engine = engine_of(spark, d)
    engine.vectors = None
    request = A.SearchRequest("thand ing", "hybrid", 50, "EN", "SRC", page=2, page_size=5, search_filters=False)
    return engine.ask(request).select("doc_id", F.round("score", 6).alias("score"), "rank")


@query(_engine_sql(10, """SELECT CAST(rank AS INT) AS rank, doc_id, source AS name, lang AS address, source AS industry, source AS status, contains(lower(source), 'đang hoạt động') AS active,
round(score, 2) AS score, round(bm25, 2) AS bm25, round(vector, 2) AS vector FROM h JOIN documents USING (doc_id) WHERE qid = 1"""))
def api_result_card(spark, d):
    engine = engine_of(spark, d)
    return engine.card(engine.hybrid({1: _ASKED_TEXTS[1]}))


@query(bm25_sql([(0, Q.search_terms("nicht queon")[0])], """, b AS (SELECT doc_id, round(score, 9) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, first_pos, doc_id) AS r FROM scores),
k AS (SELECT b.doc_id, b.score FROM b JOIN documents USING (doc_id) WHERE r <= 30 AND contains(lower(lang), 'de'))
SELECT doc_id, round(score, 6) AS score FROM k ORDER BY k.score DESC, doc_id LIMIT 10"""))
def api_search2(spark, d):
    """Industry terms, kept to a place."""
    return engine_of(spark, d).by_industry("nicht queon", "de").select("doc_id", F.round("score", 6).alias("score"))


@query(bm25_sql([(0, Q.search_terms("thand ing")[0])], """, b AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, first_pos, doc_id) AS r FROM scores)
SELECT (SELECT doc_id FROM b WHERE r = 2) AS doc_id, q.term, CAST(coalesce(tf, 0) AS INT) AS freq, coalesce(round(score, 6), 0.0) AS score
FROM q LEFT JOIN (SELECT * FROM parts WHERE doc_id = (SELECT doc_id FROM b WHERE r = 2)) p ON p.term = q.term"""))
def api_explain(spark, d):
    return engine_of(spark, d).explain("thand ing", 2).withColumn("score", F.round("score", 6))


_WORDS_OF = values([(q, w) for q, (_, ws) in ASKED.items() for w in ws], "qid, word")
_POOLED_SQL = _engine_sql(50, f""", runs AS (SELECT 'bm25' AS method, qid, doc_id, rank FROM b UNION ALL SELECT 'vector', qid, doc_id, rank FROM v UNION ALL SELECT 'hybrid', qid, doc_id, rank FROM h),
rel AS (SELECT DISTINCT qid, doc_id FROM (SELECT DISTINCT qid, doc_id FROM runs) JOIN documents USING (doc_id) JOIN (SELECT * FROM {_WORDS_OF}) w USING (qid) WHERE contains(lower(text), lower(word))),
n AS (SELECT qid, count(*) AS n FROM rel GROUP BY qid),
m AS (SELECT method, runs.qid, count(rel.doc_id) FILTER (rank <= 10) / 10 AS precision, count(rel.doc_id) FILTER (rank <= 10) / any_value(n.n) AS recall,
  coalesce(1 / min(CASE WHEN rel.doc_id IS NOT NULL THEN rank END), 0.0) AS mrr, any_value(n.n) AS num_relevant
  FROM runs LEFT JOIN rel ON rel.qid = runs.qid AND rel.doc_id = runs.doc_id JOIN n ON n.qid = runs.qid GROUP BY method, runs.qid)
""")


def _pooled(spark, d):
    return A.evaluate(engine_of(spark, d), ASKED, F.col("text"))


@query(_POOLED_SQL + "SELECT method, CAST(qid AS INT) AS qid, round(precision, 6) AS precision, round(recall, 6) AS recall, round(mrr, 6) AS mrr, num_relevant FROM m")
def eval_pooled(spark, d):
    return _pooled(spark, d).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "mrr")})


@query(_POOLED_SQL + "SELECT method, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, count(*) AS n_queries FROM m GROUP BY method")
def eval_pooled_summary(spark, d):
    return A.summary(_pooled(spark, d)).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "mrr")})


@query(f"""WITH t AS (SELECT doc_id, unnest({terms_sql('text')}) AS term FROM documents),
p AS (SELECT doc_id, CAST('0x' || substr(md5(term), 1, 4) AS INT) % 64 AS place, CASE WHEN CAST('0x' || substr(md5(term), 5, 1) AS INT) < 8 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign FROM t),
s AS (SELECT doc_id, place, sum(sign) AS x FROM p GROUP BY ALL), l AS (SELECT doc_id, sqrt(sum(x * x)) AS length FROM s GROUP BY doc_id)
SELECT doc_id, place, round(CASE WHEN length = 0 THEN x ELSE x / length END, 6) AS x FROM s JOIN l USING (doc_id) WHERE x <> 0""")
def vec_hash_encode(spark, d):
    """The hashing encoder over all documents, place by place."""
    v = A.hashed_vectors(docs_of(spark, d).select("doc_id", "text"), ["doc_id"], "text")
    return v.select("doc_id", F.posexplode("embedding").alias("place", "x")).where("x <> 0").withColumn("x", F.round("x", 6))


@query("""SELECT 'stored' AS model, CAST(count(DISTINCT vec_id % 4) AS INT) AS num_fields, CAST(max(len(embedding)) AS INT) AS dim, count(DISTINCT vec_id // 4) AS num_documents,
'cells' AS index_type, 'inner product' AS metric, count(*) AS n_vectors FROM embeddings""")
def vec_store(spark, d):
    """Vectors written by cell and read back, with the row about them."""
    store = A.build_vectors(_vectors(spark, d), files.shared_folder(spark), "stored", cells=8)
    return store.meta.drop("centres").crossJoin(store.vectors.agg(F.count(F.lit(1)).alias("n_vectors")))


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id = 17")
def doc_fetch(spark, d):
    return A.fetch(table(spark, d, "documents"), 17).select("doc_id", "lang", "source")


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 25")
def doc_first(spark, d):
    return A.first_docs(table(spark, d, "documents"), 25).select("doc_id", "lang")


@query("""SELECT CAST(row_number() OVER (ORDER BY page_id, pos) AS INT) AS rank, link FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(link)) ORDER BY page_id, pos) AS n FROM
(SELECT page_id, i AS pos, CASE WHEN starts_with(hrefs[i], 'http') THEN hrefs[i] ELSE regexp_extract(url, '^(https?://[^/]+)', 1) || hrefs[i] END AS link
FROM (SELECT page_id, url, hrefs, unnest(range(1, len(hrefs) + 1)) AS i FROM (SELECT page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hrefs FROM pages)))
WHERE contains(link, '/th') OR contains(link, '/de')) WHERE n = 1 ORDER BY page_id, pos LIMIT 100""")
def html_discovered(spark, d):
    """Links that name one of several kinds, each once, at most a hundred."""
    return P.discovered(table(spark, d, "pages"), ["/th", "/de"], 100)


_NAME = _norm_sql("p_name || ' ' || p_brand")


@query(f"""WITH c AS (SELECT p_partkey AS left_id, p_name, {_NAME} AS name FROM part),
r AS (SELECT p_partkey AS right_id, p_type, {_norm_sql("p_name || ' ' || substr(p_brand, 1, 8)")} AS name FROM part WHERE p_partkey % 3 = 0),
u AS (SELECT name, min(right_id) AS right_id FROM r GROUP BY name), k AS (SELECT DISTINCT name FROM c),
m AS (SELECT k.name, u.right_id, u.name AS right_name, 200.0::DOUBLE * least(length(k.name), length(u.name)) / (length(k.name) + length(u.name)) AS score
  FROM k, u WHERE contains(k.name, u.name) OR contains(u.name, k.name)),
b AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, right_id) AS n FROM m WHERE score >= 83)
SELECT left_id, p_name, round(score, 6) AS match_score, right_name AS matched_name, p_type FROM c LEFT JOIN (SELECT b.*, p_type FROM b JOIN r USING (right_id) WHERE n = 1) x ON x.name = c.name""")
def join_fuzzy_merge(spark, d):
    """All parts with all of a third of them as reviews of their names: the best match's columns, and those without one."""
    part = table(spark, d, "part")
    left = part.select(F.col("p_partkey").alias("left_id"), "p_name", T.ascii_fold(F.concat_ws(" ", "p_name", "p_brand")).alias("name"))
    right = part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("right_id"), "p_type", T.ascii_fold(F.concat(F.col("p_name"), F.lit(" "), F.substring("p_brand", 1, 8))).alias("name"))
    # names that are there often are matched once
    names, kinds = left.groupBy("name").agg(F.min("left_id").alias("left_id")), right.groupBy("name").agg(F.min("right_id").alias("right_id"))
    matches = R.substring_matches(names, kinds).join(names.withColumnRenamed("left_id", "one_id"), F.col("left_id") == F.col("one_id")).drop("left_id", "one_id")
    found = left.select("left_id", "name").join(matches, "name").drop("name")
    merged = R.merged_matches(left, right, found)
    return merged.select("left_id", "p_name", F.round("match_score", 6).alias("match_score"), "matched_name", "p_type")


SPLIT = [(0, "12PhốHuế", "12 Phố Huế"), (1, "KPhường3", "K Phường 3"), (2, "Số5", "Số 5"), (3, None, None), (4, "", "")]


@query(f"SELECT id, address FROM {values([(i, b) for i, _, b in SPLIT], 'id, address')}")
def cln_split_address(spark, d):
    """The SQL has the expected texts, traced by hand."""
    return fixture(spark, [(i, a) for i, a, _ in SPLIT], "id int, a string").select("id", T.split_address(F.col("a")).alias("address"))


@query(rf"""WITH a AS (SELECT * FROM {values([(i, a, b) for (i, a), b in zip(ADDRESSES, CLEANED)], 'id, a, b')})
SELECT count(*) FILTER (a <> '') AS total, count(*) FILTER (contains(a, ',,')) AS double_comma,
count(*) FILTER (len(regexp_extract_all(a, '\d-\d')) < len(regexp_extract_all(b, '\d-\d'))) AS merged, count(*) FILTER (a IS DISTINCT FROM b) AS improved FROM a""")
def cln_counters(spark, d):
    rows = fixture(spark, ADDRESSES, "id int, a string")
    return C.address_counters(rows.withColumn("b", T.clean_address(F.col("a"))), "a", "b")


@query(f"""SELECT id, a AS before, b AS after FROM {values([(i, a, b) for (i, a), b in zip(ADDRESSES, CLEANED)], 'id, a, b')} WHERE a IS DISTINCT FROM b ORDER BY id LIMIT 5""")
def cln_changes(spark, d):
    rows = fixture(spark, ADDRESSES, "id int, a string")
    return C.changes(rows.withColumn("b", T.clean_address(F.col("a"))), "id", "a", "b", 5)


@query(r"""WITH j AS (SELECT unnest(regexp_extract_all(CAST(to_json({'doc_id': doc_id, 'lang': lang, 'source': source, 'n_chars': n_chars}) AS VARCHAR), '[\p{L}\p{N}_]+')) AS word FROM documents)
SELECT (SELECT count(*) FROM documents) AS n_docs, CAST(0 AS BIGINT) AS bad_lines, count(*) AS n_words, round(count(*) / (SELECT count(*) FROM documents), 2) AS avg_words, count(DISTINCT word) AS vocabulary FROM j""")
def stat_json_words(spark, d):
    return C.json_statistics(docs_of(spark, d).select("doc_id", "lang", "source", "n_chars"))


JOBS = [(0, "Kế toán", "Cty A", "", "10 tr | Nhân viên", None, "u"), (1, None, "", "Hà Nội", "", "hôm nay", ""), (2, "x", "y", "z", "5 tr", "w", "v")]
JOB_ROWS = [("Kế toán", "Cty A", "Bắc Kạn", "10 tr", "Nhân viên", "N/A", "u"), ("N/A", "N/A", "Hà Nội", "Thương lượng", "N/A", "hôm nay", "N/A"), ("x", "y", "z", "5 tr", "N/A", "w", "v")]


@query(f"SELECT * FROM {values(JOB_ROWS, 'title, company, location, salary, level, updated, url')}")
def html_jobs(spark, d):
    return P.job_rows(fixture(spark, JOBS, "id int, title string, company string, location string, terms string, updated string, url string"))


DETAIL = "<h4>x</h4>\nĐịa chỉ: Hà Nội\n Trạng thái: A\nTrạng thái: B"


@query(f"SELECT {', '.join(f'{lit(v)} AS {k}' for k, v in {'address': 'Hà Nội', 'legal_rep': '', 'license_date': '', 'active_date': '', 'status': 'B'}.items())}")
def html_detail(spark, d):
    rows = fixture(spark, [(DETAIL,)], "t string")
    return rows.select(*[c.alias(k) for k, c in P.detail_fields(F.regexp_replace("t", "<[^>]*>", "")).items()])


TABLE_PAGE = "<table><tr><td>Mã số thuế</td><td> 01 </td></tr><tr><td>Mã số thuế cũ</td><td>02</td></tr><tr><td>?</td><td>x</td></tr></table>"


@query(f"SELECT CAST(page_id AS INT) AS page_id, field, value FROM {values([(1, 'ma_so_thue', '01'), (1, 'ma_so_thue_cu', '02')], 'page_id, field, value')}")
def html_table(spark, d):
    return P.table_rows(fixture(spark, [(1, TABLE_PAGE)], "page_id int, html string"))


@query("SELECT 'query: ' || text AS prefixed FROM " + values(TEXTS[:3], "id, text"))
def txt_query_prefix(spark, d):
    return fixture(spark, [(A.query_prefix(t),) for _, t in TEXTS[:3]], "prefixed string")


@query("SELECT CAST(user_id AS BIGINT) AS user_id, count(*) AS n FROM events GROUP BY user_id")
def agg_counters(spark, d):
    """Counts of a table in one pass, as the ingest steps report them."""
    return table(spark, d, "events").groupBy(F.col("user_id").cast("long").alias("user_id")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH w AS (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL)
SELECT * FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_event_windows(spark, d):
    """Event-time windows of the events as a stream: those whose watermark has passed."""
    out = files.shared_folder(spark)
    stream = ingest.source(spark, f"{d}/event[s].parquet", table(spark, d, "events").schema)
    ingest.windows_of_stream(stream, f"{out}/table", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/table").withColumns({"total": F.round("total", 4), "start": F.col("start").cast("timestamp_ntz")})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
