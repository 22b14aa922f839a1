"""The engine: every query against its SQL, goldens of the text rules, files and streams."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestar.functions import query as Q
from lodestar.functions import text as T
from lodestar.operators import clean as C
from lodestar.operators import facade as A
from lodestar.operators import pages as P
from lodestar.operators import resolve as R
from lodestar.operators import search as S
from lodestar.plans import catalog
from lodestar.sources import files
from lodestar.streaming import ingest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    rows = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    if name in catalog.oracle_sql():
        rel = duck.sql(catalog.oracle_sql()[name])
        assert sorted(rel.columns) == sorted(df.columns)
        at = [rel.columns.index(c) for c in sorted(rel.columns)]
        assert rows == sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())


def column(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("s"))).collect()]


def test_addresses(spark):
    want = {
        "5 7 Nguyễn Huệ, Quận 1, TP Hồ Chí Minh": "5-7 Nguyễn Huệ, Quận 1, TP Hồ Chí Minh",
        "12 14 16 Lê Thánh Tông, Quận 1": "12-14-16 Lê Thánh Tông, Quận 1",
        "29 31, 33 Nguyễn Văn Trỗi P.12, Quận Phú Nhuận": "29-31-33 Nguyễn Văn Trỗi P.12, Quận Phú Nhuận",
        "25C 5 Chu Văn An P.26, Quận Bình Thạnh": "25C/5 Chu Văn An P.26, Quận Bình Thạnh",
        "5 C/1 Nguyễn Oanh, Quận Gò Vấp": "5C/1 Nguyễn Oanh, Quận Gò Vấp",
        "Lô A 2 Khu Công Nghiệp, Quận 2": "Lô A2 Khu Công Nghiệp, Quận 2",
        "HCM, 70000": "HCM/7-0000", "": "", None: None, "a,,b": "a, b", "SN 5 Phố Huế": "5 Phố Huế",
        "5 Sư Thiện Chiếu P.07, Phường 07": "5 Sư Thiện Chiếu Phường 07",
        "Khu ất Duy Tiến": "Khuất Duy Tiến", "D 10 Phố": "D10 Phố",
    }
    assert column(spark, T.clean_address, list(want)) == list(want.values())
    assert column(spark, T.split_address, ["12PhốHuế", "KPhường3", None, "Số5"]) == ["12 Phố Huế", "K Phường 3", None, "Số 5"]
    assert column(spark, T.is_house_number, ["22", "80A", "25 - 1", "25/4", "Phố 2"]) == [True] * 4 + [False]
    assert column(spark, T.is_admin_unit, ["Phường 2", "Phố Huế"]) == [True, False]


def test_terms_on_the_driver_equal_the_column(spark):
    rng = random.Random(1)
    words = "công nghệ thông tin dệt may mặc điện tử lực hà nội của và nhà hàng x 12 linh kiện".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(300)] + ["A-b, C!", "công_nghệ"]
    assert column(spark, T.terms, texts) == [Q.terms(t) for t in texts]


def test_search_terms():
    assert Q.search_terms("nhà hàng hà nội") == (["nhà_hàng", "hà_nội"], ["nhà_hàng", "hà_nội"])
    assert Q.search_terms("") == ([], [])
    assert Q.search_terms("company") == (["company"], [])
    wide, intent = Q.search_terms("medical")
    assert wide == ["medical", "y_tế", "trang_thiết_bị_y_tế", "phòng_khám", "bệnh", "viện"] and intent == wide
    wide, intent = Q.search_terms("electric")
    assert wide == ["electric", "điện_lực", "điện_năng", "phát", "điện", "truyền", "tải", "phân", "phối"] and len(intent) == 8
    assert Q.intent_group(["it", "power"]) == "electric_power" and Q.intent_group([]) is None


def test_query_options():
    assert Q.split_top("x --top 5") == ("x", 5) and Q.split_top("x --top 500") == ("x", 100)
    assert Q.split_top("x --top 0") == ("x --top 0", 10) and Q.split_top("x --top abc") == ("x --top abc", 10)
    assert Q.place("Quán ở HỒ CHÍ MINH") == "hồ chí minh" and Q.place("x") is None
    assert Q.effective(" a ", None, "", "b") == "a b"


def test_bm25_against_brute_force(spark):
    rng = random.Random(2)
    texts = {i: [rng.choice("alpha beta gamma delta eps".split()) for _ in range(rng.randint(0, 9))] for i in range(60)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    q = ["beta", "absent", "eps", "beta"]
    got = {r["doc_id"]: r["score"] for r in S.bm25(S.index_of(docs), S.query_rows(spark, [(0, q)])).collect()}
    n, avg = len(texts), sum(map(len, texts.values())) / len(texts)
    for i, t in texts.items():
        want = 0
        for term in dict.fromkeys(q):
            df, tf = sum(term in x for x in texts.values()), t.count(term)
            if tf:
                want += math.log((n - df + .5) / (df + .5) + 1) * tf * 2.5 / (tf + 1.5 * (.25 + .75 * len(t) / avg))
        assert (i in got) == (want > 0) and got.get(i, 0) == pytest.approx(want)


def test_written_index_scores_alike(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    q = S.query_rows(spark, [(0, ["the", "ing"])])
    one = sorted((r["doc_id"], round(r["score"], 9)) for r in S.bm25(S.index_of(docs), q).collect())
    two = sorted((r["doc_id"], round(r["score"], 9)) for r in S.bm25(S.write_index(docs, str(tmp_path)), q).collect())
    assert one == two and one


def test_page_is_clamped(spark):
    ranked = spark.range(1, 26).select(F.col("id").alias("rank"))
    assert [sorted(r[0] for r in S.page(ranked, n).collect()) for n in (0, 3, 9)] == [list(range(1, 11)), list(range(21, 26)), list(range(21, 26))]


def test_ratio_closed_form():
    rng = random.Random(3)
    for _ in range(300):
        b = "".join(rng.choice("abc") for _ in range(rng.randint(1, 20)))
        i, j = sorted((rng.randint(0, len(b)), rng.randint(0, len(b))))
        assert T.indel_ratio(b[i:j], b) == pytest.approx(200 * (j - i) / (len(b) + j - i))
    assert T.token_set_similarity("a b", "b a") == 100 and T.token_set_similarity("", "a") == 0


def test_substring_matches_against_all_pairs(spark):
    rng = random.Random(4)
    names = ["".join(rng.choice("ab c") for _ in range(rng.randint(0, 9))).strip() for _ in range(120)]
    left, right = names[:60], names[60:] + [n + "x" for n in names[:10]]
    want = {}
    for i, a in enumerate(left):
        best = None
        for j, b in enumerate(right):
            if a in b or b in a:
                s = 100.0 if not a and not b else 200.0 * min(len(a), len(b)) / (len(a) + len(b))
                if s >= 83 and (best is None or s > best[1]):
                    best = (j, s)
        if best:
            want[i] = (best[0], round(best[1], 6))
    frame = lambda rows, k: spark.createDataFrame([(i, n) for i, n in enumerate(rows)], f"{k} long, name string")
    got = {r["left_id"]: (r["right_id"], round(r["score"], 6)) for r in R.substring_matches(frame(left, "left_id"), frame(right, "right_id")).collect()}
    assert got == want


def test_company_page():
    page = """<div class="m-panel-heading main-heading"><h1> Cty "A" </h1></div><div itemprop="taxID">0101</div><div itemprop="address">Hà Nội<br></div>
    <div class="responsive-table-cell">Tên giao dịch</div><div class="responsive-table-cell">A JSC</div>
    <div class="responsive-table-cell">Ngày cấp giấy phép:</div><div class="responsive-table-cell">1/2/2020</div>
    <div class="nnkd-table"><div class="responsive-table-cell">Bán lẻ (Ngành chính)</div></div>"""
    got = P.company_fields(page)
    assert (got["ten_doanh_nghiep"], got["ma_so_thue"], got["dia_chi"], got["ten_giao_dich"], got["ngay_cap"], got["linh_vuc"].strip()) == (
        'Cty "A"', "0101", "Hà Nội", "A JSC", "1/2/2020", "Bán lẻ")
    assert set(P.company_fields(None).values()) == {""}


def test_page_tables_and_lines(spark):
    page = "<table><tr><td>Mã số thuế</td><td> 01 </td></tr><tr><td>Mã số thuế cũ</td><td>02</td></tr><tr><td>?</td><td>x</td></tr></table>"
    rows = P.table_rows(spark.createDataFrame([(1, page)], "page_id long, html string")).collect()
    assert [(r["field"], r["value"]) for r in rows] == [("ma_so_thue", "01"), ("ma_so_thue_cu", "02")]
    text = "Địa chỉ: Hà Nội\n Trạng thái: A\nTrạng thái: B"
    got = spark.createDataFrame([(text,)], "t string").select(*[c.alias(k) for k, c in P.detail_fields(F.col("t")).items()]).first()
    assert got["address"] == "Hà Nội" and got["status"] == "B" and got["legal_rep"] == ""
    jobs = spark.createDataFrame([("10 tr | Nhân viên",), ("",), ("5 tr",)], "t string").select(*[c.alias(k) for k, c in P.job_salary(F.col("t")).items()]).collect()
    assert [tuple(r) for r in jobs] == [("10 tr", "Nhân viên"), ("Thương lượng", "N/A"), ("5 tr", "N/A")]


def test_json_lines(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"Tên doanh nghiệp": "A", "Mã số thuế": "0101"}\n\nnot json\n{}\n{"Tên doanh nghiệp": "B", "reviews": [{"title": "t"}]}\n')
    rows = files.read_companies(spark, str(tmp_path / "c.jsonl")).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["name"], r["tax_id"]) for r in rows] == [(0, "A", "0101"), (1, "B", None)] and rows[1]["reviews"][0]["title"] == "t"
    assert files.corrupt_lines(spark, str(tmp_path / "c.jsonl")) == 1
    assert [r["name"] for r in files.read_companies(spark, str(tmp_path / "c.jsonl"), keep_empty=True).orderBy("doc_id").collect()] == ["A", None, "B"]
    (tmp_path / "d.jsonl").write_text('{"Tên doanh nghiệp": "Bi\u0300nh Đi\u0323nh"}\n')
    assert files.read_companies(spark, str(tmp_path / "d.jsonl")).first()["name"] == "B\u00ecnh Đ\u1ecbnh"


def test_json_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, 2,\n 3]')
    (tmp_path / "b.json").write_text('{"k": [1, 2], "l": 0}')
    found = {r["path"][-6:]: r["n"] for r in files.count_elements(spark, str(tmp_path / "*.json")).collect()}
    assert found == {"a.json": 3, "b.json": 2}
    (tmp_path / "a.csv").write_text("k,v\n01,x\n02,\n")
    files.csv_to_json_lines(spark, str(tmp_path / "a.csv"), str(tmp_path / "out"), "k string, v string")
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"k":"01","v":"x"}', '{"k":"02","v":null}']


def test_addresses_of_a_file(spark, tmp_path):
    lines = ['{"id": 1, "Địa chỉ": "5 7 Nguyễn Huệ", "x": [1.50]}', "not json", '{"id": 2}', '{"Địa chỉ": "a \\"b\\",,c"}']
    (tmp_path / "c.jsonl").write_text("\n".join(lines) + "\n\n")
    C.clean_lines(spark, str(tmp_path / "c.jsonl"), str(tmp_path / "out"))
    made = sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect())
    assert made == sorted(['{"id": 1, "Địa chỉ": "5-7 Nguyễn Huệ", "x": [1.50]}', "not json", '{"id": 2}', '{"Địa chỉ": "a \\"b\\", c"}'])


def test_csv_and_appends(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿k,v\n"01","say ""x"", y\nz"\n', encoding="utf-8")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "a.csv"), "k string, v string").collect()] == [("01", 'say "x", y\nz')]
    rows = spark.createDataFrame([("1", "a"), ("1", "a"), ("2", "b")], "k string, v string")
    out = str(tmp_path / "t")
    assert files.append_unseen(rows, out, "k") == 2 and files.append_unseen(rows, out, "k") == 0
    assert spark.read.parquet(out).count() == 2


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    rows = lambda a, b: spark.range(a, b).select(F.col("id").alias("k"), F.lit("v").alias("v"))
    rows(0, 10).write.parquet(src)
    for end in (10, 15):
        ingest.ingest_once(ingest.source(spark, src, "k long, v string"), out, mark, "k")
        assert spark.read.parquet(out).count() == end
        rows(5, 15).write.mode("append").parquet(src)
    assert spark.read.parquet(out).select("k").distinct().count() == 15


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_ann_recall(spark, sf):
    """Every hundredth vector against all by brute force: at least nine of the best ten are found on average."""
    data = f"/root/testdata/{sf}"
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    found = {}
    for r in catalog.queries()["vec_ann"](spark, data).collect():
        found.setdefault(r["query_id"], {})[r["vec_id"]] = r["ip"]
    asked = [v for v in vectors if v % 100 == 0]
    hits = 0
    for a in asked:
        ip = {v: sum(x * y for x, y in zip(vectors[a], e)) for v, e in vectors.items()}
        hits += len(set(sorted(ip, key=lambda v: (-ip[v], v))[:10]) & set(found[a]))
        assert len(found[a]) == 10 and all(abs(ip[v] - s) < 1e-5 for v, s in found[a].items())
    assert set(found) == set(asked) and hits >= 9 * len(asked)


def test_nearest_of_a_large_small_side(spark, monkeypatch):
    """A small side in several parts gives what one part gives, ties to the smallest id."""
    rng = random.Random(5)
    vec = lambda: [rng.choice([0.0, 1.0, -1.0]) for _ in range(3)]
    frame = lambda n: spark.createDataFrame([(i, "n", vec()) for i in range(n)], "id long, name string, vec array<double>")
    large, small = frame(60), frame(50)
    one = {r["id"]: (r["match_id"], r["cosine"]) for r in R.semantic_matches(large, small, -9, None).collect()}
    monkeypatch.setattr(R, "SMALL_SIDE", 9)
    assert {r["id"]: (r["match_id"], r["cosine"]) for r in R.semantic_matches(large, small, -9, None).collect()} == one and len(one) == 60


def test_hashing_encoder_on_the_driver_equals_the_column(spark):
    texts = ["công nghệ thông tin", "", "nhà hàng hà nội phần mềm abc", "the of x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    made = {r["i"]: r["embedding"] for r in A.hashed_vectors(rows, ["i"], "text").collect()}
    for i, t in enumerate(texts):
        assert made[i] == pytest.approx(A.hashed_terms(Q.terms(t))), t


def test_engine_with_hashed_fields(spark, tmp_path):
    companies = [(0, "Công ty phần mềm A", "công nghệ thông tin", "Quận 1, Hà Nội", "Đang hoạt động"), (1, "Nhà hàng B", "ăn uống", "Huyện C, Bình Định", "Ngừng hoạt động"),
                 (2, "Cty phần mềm D", "phần mềm", "Xã E, Bình Định", "Đang hoạt động"), (3, None, None, None, None)]
    docs = spark.createDataFrame(companies, "doc_id long, name string, industry string, address string, status string")
    docs = docs.withColumn("text", T.searchable_text(F.col("name"), F.col("address"), F.col("industry")))
    store = A.build_vectors(A.field_vectors(docs, "name", "industry", "address"), str(tmp_path / "v"))
    assert store.meta.first()["num_fields"] == 4 and store.vectors.count() == 16
    engine = A.SearchEngine(S.write_index(docs, str(tmp_path / "i")), docs, store.vectors)
    best = lambda df: [r["doc_id"] for r in df.orderBy("rank").collect()]
    assert set(best(engine.search("phần mềm", 2))) == {0, 2}
    assert best(engine.search("phần mềm bình định", 1)) == [2]  # the place decides
    assert best(engine.ask(A.SearchRequest("phần mềm", province="Hà Nội", search_filters=False))) == [0]
    assert set(best(engine.ask(A.SearchRequest("phần mềm nhà hàng", method="bm25", status=S.INACTIVE)))) == {1}
    assert {r["term"]: r["freq"] for r in engine.explain("phần mềm").collect()}["phần_mềm"] >= 1
    assert engine.explain("không có").count() == 0
    found = A.evaluate(engine, {0: ("phần mềm", ["phần mềm"]), 1: ("xyz", ["không đâu"])}, F.col("text"))
    assert {r["qid"] for r in found.collect()} == {0} and A.summary(found).count() == 3
    assert A.write_report(found, {0: ("phần mềm", [])}, str(tmp_path / "r")).count("\n") == 5
    assert spark.read.option("header", True).csv(str(tmp_path / "r/results_csv")).count() == 3


def test_a_missing_index_is_empty(spark, tmp_path):
    index = S.read_index(spark, str(tmp_path / "none"))
    assert S.bm25(index, S.query_rows(spark, [(0, ["a"])])).count() == 0


def test_probing_reads_few_cells(spark, tmp_path):
    rows = spark.range(200).selectExpr("id AS doc_id", "0 AS slot", "array(cos(id), sin(id)) AS embedding")
    store = A.build_vectors(rows, str(tmp_path), cells=4)
    near = store.near([1.0, 0.0], 1)
    assert 0 < near.count() < 200 and near.select("cell").distinct().count() == 1


def test_stream_that_goes_on(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    spark.range(10).select(F.col("id").alias("k")).write.parquet(src)
    running = ingest.ingest_every(ingest.source(spark, src, "k long"), out, mark, "k", "1 second")
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    assert spark.read.parquet(out).count() == 10
