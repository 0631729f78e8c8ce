"""Writers. Tables without a lakehouse are published as versions: write a new folder, then commit its name."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.sources import commits


def publish(df: DataFrame, root: str, version: str, partition_by: list[str] | None = None) -> str:
    """Writes a table version and makes it current in one step. Repeating a version gives the same result.

    The folder is new each time, so readers of the version before are not disturbed; a writer that dies before the
    commit changes nothing. Of two writers at a time, the one that commits later is current.
    """
    spark = df.sparkSession
    folder = f"{root}/version={version}/{uuid.uuid4().hex}"
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(folder)
    while True:
        number, _ = commits.load(spark, root)
        try:
            commits.commit(spark, root, number + 1, {"version": version, "folder": folder.removeprefix(f"{root}/")})
            return folder
        except commits.Conflict:
            continue


def read_current(spark: SparkSession, root: str) -> DataFrame:
    _, content = commits.load(spark, root)
    if content is None:
        raise ValueError(f"nothing is published in {root}")
    return spark.read.parquet(f"{root}/{content['folder']}")


def write_ledger(invoices: DataFrame, root: str, version: str) -> str:
    """Ledger version partitioned by year and month, so period filters skip folders as well as row groups."""
    dated = invoices.withColumns({"year": F.year("date"), "month": F.month("date")})
    return publish(dated, root, version, ["year", "month"])


def write_snapshot(snapshot: DataFrame, path: str) -> None:
    """JSON export; the commit protocol publishes the files together."""
    snapshot.write.mode("overwrite").json(path)


def write_sheets(sheets: dict[str, DataFrame], root: str, fmt: str = "csv") -> None:
    """One folder per sheet."""
    for name, df in sheets.items():
        folder = f"{root}/{name.lower().replace(' ', '_')}"
        writer = df.write.mode("overwrite")
        writer.option("header", True).csv(folder) if fmt == "csv" else writer.format(fmt).save(folder)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_matches(matched: DataFrame, path: str) -> None:
    """Reconciled statements, one folder per statement file."""
    matched.write.mode("overwrite").partitionBy("file").parquet(path)


def write_evaluation(summary: DataFrame, details: DataFrame, comparison: DataFrame, root: str) -> None:
    for name, df in {"summary": summary, "details": details, "comparison": comparison}.items():
        df.write.mode("overwrite").json(f"{root}/{name}")


def column_widths(df: DataFrame) -> DataFrame:
    """(column, width): longest value or header plus two, for every column in one pass."""
    longest = df.agg(*[F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0)).alias(c) for c in df.columns])
    return longest.unpivot([], df.columns, "column", "longest").select(
        "column", (F.greatest("longest", F.length("column")) + 2).alias("width"))
