"""Readers of the user's own files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.fixed_values import MIME_TYPES

SUPPLIER_SCHEMA = ("supplier_name string, category string, categories array<string>, transaction_type string, "
                   "vat_number string, raw_extraction map<string,string>")
INVOICE_SCHEMA = ("id long, date date, invoice_number string, transactor string, amount decimal(18,2), "
                  "vat decimal(18,2), total_base decimal(18,2), currency string, supplier_id long, notes string, "
                  "is_income boolean, transaction_type string, file_path string, description string, "
                  "raw_extraction string, document_type string")
TRUTH_SCHEMA = "file string, expected_type string, expected map<string,string>"
EXTRACTION_SCHEMA = "doc_id long, file_name string, stage string, attempt int, response string"


def physical_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all text files under a path: file, block (where the part that a task reads begins), line_no, line.

    Files are split like any text file, so one very large file is read by many tasks. The line
    number is not dense; it grows with the position in the file (block start, then order in the task).
    """
    rows = spark.read.text(path, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.regexp_replace("value", "\r$", "").alias("line"))
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return rows.select("file", "block", (F.col("block") * F.lit(1 << 20) + within).alias("line_no"), "line")


def statement_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all statement files under a path: file, line_no, line; see :func:`physical_lines`."""
    return physical_lines(spark, path).drop("block")


def multiline_statements(spark: SparkSession, path: str, widest: int = 256) -> DataFrame:
    """Statement files with line breaks inside quoted cells: whole records by the CSV reader, as lines again.

    Records may differ in width, as lines above the header do; a record of ``widest`` cells or more raises an error. Each
    such file is read by one task; :mod:`tallyloom.sources.quoted` reads it with many.
    """
    names = [f"c{i}" for i in range(widest)]
    rows = spark.read.schema(", ".join(f"{c} string" for c in names)).csv(
        path, header=False, multiLine=True, quote='"', escape='"', recursiveFileLookup=True)
    cells = F.transform(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in names]), lambda v: F.concat(
        F.lit('"'), F.replace(F.translate(v, "\r\n", "  "), F.lit('"'), F.lit('""')), F.lit('"')))
    filled = F.greatest(*[F.when(F.col(c).isNotNull(), F.lit(i + 1)).otherwise(F.lit(0)) for i, c in enumerate(names)])
    wide = F.raise_error(F.concat(F.lit(f"a record has {widest} cells or more in "), F.col("_metadata.file_path")))
    return rows.select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_no"),
        F.when(F.col(names[-1]).isNotNull(), wide).otherwise(F.array_join(F.slice(cells, 1, filled), ",")).alias("line"))


def _or_empty(spark: SparkSession, schema: str, load: Callable[[], DataFrame]) -> DataFrame:
    try:
        return load()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def parquet_or_empty(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None where nothing has been written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def suppliers(spark: SparkSession, path: str) -> DataFrame:
    """Supplier master from JSON (a list per file); a missing path gives an empty table."""
    rows = _or_empty(spark, SUPPLIER_SCHEMA, lambda: spark.read.schema(SUPPLIER_SCHEMA).json(path, multiLine=True))
    return rows.withColumn("arrival", F.monotonically_increasing_id())


def invoices(spark: SparkSession, path: str) -> DataFrame:
    return _or_empty(spark, INVOICE_SCHEMA, lambda: spark.read.schema(INVOICE_SCHEMA).parquet(path))


def rates(spark: SparkSession, path: str) -> DataFrame:
    """Stored rates from a JSON object such as ``{"EUR_TO_PKR": 280.5}``: currency, rate_to_base."""
    rows = _or_empty(spark, "value string", lambda: spark.read.text(path, wholetext=True))
    return rows.select(F.explode(F.from_json("value", "map<string,double>")).alias("key", "rate_to_base")).select(
        F.regexp_extract("key", "^([A-Z]+)_TO_", 1).alias("currency"), "rate_to_base")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRUTH_SCHEMA).json(path, multiLine=True)


def sheets(spark: SparkSession, path: str) -> DataFrame:
    """Sheets stored as one CSV file each, as lines: sheet, line_no, line."""
    return statement_lines(spark, path).withColumnRenamed("file", "sheet")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def documents(spark: SparkSession, path: str, extensions: list[str], with_content: bool = False) -> DataFrame:
    """Accepted files: path, extension, mime type, length and, on request, base64 content."""
    kinds = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    picked = files.withColumn("extension", extension(F.col("path"))).where(F.col("extension").isin(extensions))
    columns = ["path", "extension", F.try_element_at(kinds, F.col("extension")).alias("mime_type"), "length"]
    return picked.select(*columns, *([F.base64("content").alias("content_base64")] if with_content else []))


def texts_of(files: DataFrame, extract: Callable[[str], str | None]) -> DataFrame:
    """(path, text, status, error) with the caller's extractor run inside tasks, isolated per file."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path in batch["path"]:
                try:
                    out.append((path, extract(path), "success", None))
                except Exception as exc:  # noqa: BLE001 - a failing file must not stop the batch
                    out.append((path, None, "error", str(exc)))
            yield pd.DataFrame(out, columns=["path", "text", "status", "error"])
    return files.select("path").mapInPandas(run, "path string, text string, status string, error string")
