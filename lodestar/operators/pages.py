"""Links and company fields from crawled pages."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text as T


def links(pages: DataFrame, contains: str = "") -> DataFrame:
    """page_id, pos and absolute link of every href; relative ones join the page's scheme and host."""
    host = F.regexp_extract("url", r"^(https?://[^/]+)", 1)
    found = pages.select("page_id", host.alias("host"), F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("pos", "href"))
    link = F.when(F.col("href").startswith("http"), F.col("href")).otherwise(F.concat("host", "href"))
    return found.select("page_id", "pos", link.alias("link")).where(F.contains("link", F.lit(contains)))


def discovered(pages: DataFrame, marks: list[str], most: int) -> DataFrame:
    """rank, link: links with any of ``marks`` in them, each once by its first spelling whatever the case, the first ``most`` in page order."""
    found = links(pages)
    if marks:
        found = found.where(F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(F.col("link"), m)))
    first = found.groupBy(F.lower(F.trim("link")).alias("spelled")).agg(F.min(F.struct("page_id", "pos", "link")).alias("m"))
    best = first.select("m.*").orderBy("page_id", "pos").limit(most)
    from pyspark.sql import Window

    return best.select(F.row_number().over(Window.orderBy("page_id", "pos")).alias("rank"), "link")  # ``most`` rows


_ELEMENT = re.compile(r"<(/?)([a-zA-Z][\w-]*)([^>]*)>")
_VOID = {"br", "img", "input", "hr", "meta", "link"}


def nodes(page: str) -> list[tuple[str, str, list[str], str]]:
    """(name, attributes, ancestors as 'name attributes', text) of each element, in page order."""
    out: list[list] = []
    stack: list[int] = []
    at = 0
    for m in _ELEMENT.finditer(page or ""):
        text = html.unescape(page[at:m.start()])
        for i in stack:
            out[i][3].append(text)
        at = m.end()
        close, name, attributes = m[1], m[2].lower(), m[3]
        if close:
            for k in range(len(stack) - 1, -1, -1):
                if out[stack[k]][0] == name:
                    del stack[k:]
                    break
        else:
            out.append([name, attributes, [f"{out[i][0]} {out[i][1]}" for i in stack], []])
            if name not in _VOID:
                stack.append(len(out) - 1)
    for i in stack:
        out[i][3].append(html.unescape(page[at:]))
    return [(n, a, up, "".join(s.strip() for s in parts)) for n, a, up, parts in out]


COMPANY = ("ten_doanh_nghiep", "ten_giao_dich", "ma_so_thue", "dia_chi", "tinh_trang", "ngay_cap", "linh_vuc")


def company_fields(page: str | None) -> dict[str, str]:
    """A registry page's raw fields; missing ones are ''."""
    found = nodes(page or "")
    first = lambda test: next((t for n, a, up, t in found if test(n, a, up)), "")
    above = lambda up, mark: any(mark in u for u in up)
    out = dict.fromkeys(COMPANY, "")
    out["ten_doanh_nghiep"] = first(lambda n, a, up: n == "h1" and above(up, "main-heading")) or first(
        lambda n, a, up: n == "h3" and above(up, 'itemprop="name"'))
    out["ma_so_thue"] = first(lambda n, a, up: n == "div" and 'itemprop="taxID"' in a)
    out["dia_chi"] = first(lambda n, a, up: n == "div" and 'itemprop="address"' in a)
    cells = [(t, up) for n, a, up, t in found if n == "div" and "responsive-table-cell" in a]
    for (label, _), (value, _) in zip(cells, cells[1:]):
        if label == "Tên giao dịch":
            out["ten_giao_dich"] = value
        elif "Ngày cấp giấy phép" in label:
            out["ngay_cap"] = value
        elif "Tình trạng hoạt động" in label:
            out["tinh_trang"] = value
    out["linh_vuc"] = next((t.replace("(Ngành chính)", "") for t, up in cells if above(up, "nnkd-table") and "(Ngành chính)" in t), "")
    return out


def parse_companies(pages: DataFrame) -> DataFrame:
    """page_id, url and the cleaned fields of each registry page."""

    def run(frames):
        for f in frames:
            fields = pd.DataFrame([company_fields(h) for h in f["html"]], columns=list(COMPANY))
            yield pd.concat([f[["page_id", "url"]].reset_index(drop=True), fields], axis=1)

    raw = pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, " + ", ".join(f"{c} string" for c in COMPANY))
    return raw.select("page_id", "url", *[T.clean_text(F.col(c)).alias(c) for c in COMPANY])


# fixed values: labels of a detail page's lines
DETAIL_LABELS = {"address": "Địa chỉ", "legal_rep": "Đại diện pháp luật", "license_date": "Ngày cấp giấy phép",
                 "active_date": "Ngày hoạt động", "status": "Trạng thái"}


def detail_fields(text: Column) -> dict[str, Column]:
    """Values of the labelled lines of a detail page's text; the last line of a label counts."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")

    def value(label: str) -> Column:
        own = F.filter(lines, lambda x: F.startswith(x, F.lit(label)))
        return F.coalesce(F.trim(F.replace(F.try_element_at(own, F.lit(-1)), F.lit(label + ":"), F.lit(""))), F.lit(""))

    return {name: value(label) for name, label in DETAIL_LABELS.items()}


def table_field(label: Column) -> Column:
    """The field that a table row's label names, tested in order; null for others."""
    has = lambda *words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(label, w))
    return (
        F.when(has("Tên đơn vị", "Tên doanh nghiệp"), "company_name")
        .when(has("Mã số thuế") & ~F.contains(F.lower(label), F.lit("cũ")), "ma_so_thue")
        .when(has("Mã số thuế cũ"), "ma_so_thue_cu").when(has("Địa chỉ"), "dia_chi").when(has("Trạng thái"), "trang_thai")
        .when(has("Cơ quan thuế"), "co_quan_thue").when(has("PP tính thuế", "Phương pháp"), "phuong_phap_tinh_thue")
        .when(has("Ngành nghề"), "nganh_nghe").when(has("Chương", "Khoản"), "chuong_khoan")
    )


def table_rows(pages: DataFrame) -> DataFrame:
    """page_id, field and value of the labelled rows of a page's tables."""
    row = F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)).alias("tr")
    cells = F.transform(F.regexp_extract_all("tr", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), 1), lambda x: T.squeeze(F.regexp_replace(x, "<[^>]*>", "")))
    found = pages.select("page_id", row).select("page_id", cells.alias("cells")).where(F.size("cells") >= 2)
    return found.select("page_id", table_field(F.get("cells", F.lit(0))).alias("field"), F.get("cells", F.lit(1)).alias("value")).where("field IS NOT NULL")


# fixed values: what a job row shows where it has nothing
JOB_DEFAULTS = {"title": "N/A", "company": "N/A", "location": "Bắc Kạn", "updated": "N/A", "url": "N/A"}


def job_rows(rows: DataFrame, terms: str = "terms") -> DataFrame:
    """The seven columns of a job listing from title, company, location, updated, url and ``terms`` ('salary | level')."""
    own = {c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(d)) for c, d in JOB_DEFAULTS.items()}
    cells = own | job_salary(F.col(terms))
    return rows.select(*[cells[c].alias(c) for c in ("title", "company", "location", "salary", "level", "updated", "url")])


def job_salary(text: Column) -> dict[str, Column]:
    """Salary and level of a job row's 'salary | level'; defaults where they are missing."""
    parts = F.transform(F.split(text, r"\|"), lambda x: F.trim(x))
    empty = F.coalesce(F.trim(text), F.lit("")) == ""
    return {
        "salary": F.when(empty, "Thương lượng").otherwise(F.get(parts, F.lit(0))),
        "level": F.when(empty | (F.size(parts) < 2), "N/A").otherwise(F.get(parts, F.lit(1))),
    }
