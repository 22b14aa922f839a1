"""JSON lines, JSON arrays and CSV in and out; declared schemas, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.text import nfc

# fixed values: the company record's fields and their short names
COMPANY_FIELDS = {
    "Tên doanh nghiệp": "name", "Tên giao dịch": "trade_name", "Địa chỉ": "address", "Ngành nghề kinh doanh": "industry",
    "Cơ quan thuế": "tax_office", "Mã số thuế": "tax_id", "Tình trạng hoạt động": "status", "Ngày cấp giấy phép": "license_date",
    "Phương pháp tính thuế": "tax_method", "Chương khoản": "chapter",
}
REVIEW = "rating string, role string, title string, meta string, pros string, cons string"
COMPANY_SCHEMA = ", ".join(f"`{k}` string" for k in COMPANY_FIELDS) + f", reviews array<struct<{REVIEW.replace(' string', ': string')}>>"


def read_companies(spark: SparkSession, path: str, keep_empty: bool = False) -> DataFrame:
    """Companies with doc_id, their ordinal among valid non-empty lines; bad and blank lines are skipped.

    The ordinal is file order: per-file-block counts first, so no task numbers all rows.
    Texts are composed (NFC) here once; ``keep_empty`` numbers lines without any field too,
    as a store of documents does.
    """
    parsed = F.from_json("value", COMPANY_SCHEMA + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    raw = spark.read.text(path).where(F.trim("value") != "").select(parsed.alias("j")).select("j.*")
    some = F.coalesce(*[F.col(f"`{c}`").cast("string") for c in COMPANY_FIELDS], F.to_json("reviews")).isNotNull()
    rows = raw.where(F.col("_corrupt_record").isNull() & (F.lit(keep_empty) | some)).drop("_corrupt_record")
    marked = rows.withColumn("line_no", F.monotonically_increasing_id()).withColumn("block", F.shiftright("line_no", 33))
    counts = marked.groupBy("block").count()
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("block").orderBy("line_no")) - 1
    numbered = marked.withColumn("nth", nth).join(F.broadcast(starts), "block")
    return numbered.select((F.col("first") + F.col("nth")).alias("doc_id"), *[nfc(F.col(f"`{k}`")).alias(v) for k, v in COMPANY_FIELDS.items()], "reviews")


def corrupt_lines(spark: SparkSession, path: str) -> int:
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.where(F.from_json("value", "map<string,string>").isNull() & F.from_json("value", "array<string>").isNull()).count()


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_json_arrays(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(paths)


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Quoted CSV with a possible byte-order mark; every column a declared type."""
    return (spark.read.schema(schema).option("header", header).option("enforceSchema", "true")
            .option("multiLine", "true").option("quote", '"').option("escape", '"').csv(path))


def csv_to_json_lines(spark: SparkSession, csv: str, out: str, schema: str) -> None:
    """A CSV file's rows as JSON lines; empty cells stay as nulls."""
    write_json_lines(read_csv(spark, csv, schema), out)


def count_elements(spark: SparkSession, path: str) -> DataFrame:
    """path and n: the elements of each JSON file's list, or the keys of its object."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    n = F.when(F.ltrim("value").startswith("["), F.size(F.from_json("value", "array<string>"))).otherwise(F.size(F.json_object_keys("value")))
    return whole.select("path", n.cast("long").alias("n"))


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path)


def append_unseen(df: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key the table does not have, one of each key; returns how many."""
    from pyspark.errors import AnalysisException

    new = df.dropDuplicates([key])
    try:
        new = new.join(df.sparkSession.read.parquet(path).select(key).distinct(), key, "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    new = new.persist()
    n = new.count()
    new.write.mode("append").parquet(path)
    new.unpersist()
    return n


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under ``spark.checkpoint.dir``; a local session may do without."""
    import tempfile
    import uuid

    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(named or f'file://{tempfile.gettempdir()}').rstrip('/')}/lodestar-{uuid.uuid4().hex}"
