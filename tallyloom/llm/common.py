"""What the operators of this subpackage share: reading tables, written intermediate tables, word splitting.

Column names that begin with two underscores are reserved for the operators.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_LOCAL_FOLDERS: dict[str, str] = {}
_RECORDS: list[list[DataFrame]] = []

#: Lower-cases A-Z and turns every byte that is no word byte of the contamination rule into a blank.
ALNUM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: the one of ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="tallyloom-llm-")
    return _LOCAL_FOLDERS[app]


def staged(df: DataFrame, name: str, rows_a_file: int = 0) -> DataFrame:
    """Writes ``df`` once as Parquet into the shared folder, in files of ``rows_a_file`` at most if given, and reads it back.

    Later readers see the same rows even when executors are lost, also where ``df`` numbers its rows.
    The table is removed when the driver ends; :func:`discard` removes it earlier.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tallyloom-llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_a_file).parquet(path)
    back = removable(spark.read.schema(df.schema).parquet(path), path)
    if _RECORDS:
        _RECORDS[-1].append(back)
    return back


def removable(df: DataFrame, path: str) -> DataFrame:
    """``df``, read from ``path``, known to :func:`discard` and removed when the driver ends."""
    df._staged_path = path
    atexit.register(discard, df)
    return df


@contextmanager
def recorded() -> Iterator[list[DataFrame]]:
    """The tables staged inside the block, so that a caller who has written the result can discard them."""
    _RECORDS.append([])
    try:
        yield _RECORDS[-1]
    finally:
        _RECORDS.pop()


def discard(*frames: DataFrame) -> None:
    """Removes staged tables that nothing reads any more."""
    for df in frames:
        try:
            jvm = df.sparkSession.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(df._staged_path)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session may have ended; the folder belongs to the run anyway
            return


def numbered(df: DataFrame, name: str, *, label: str = "__rid") -> DataFrame:
    """``df`` staged with a number for each row, so that repeated rows can be told apart."""
    return staged(df.withColumn(label, F.monotonically_increasing_id()), name)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an operator is about to add; comparison ignores case as Spark does."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def hidden(docs: DataFrame, *used: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with reserved names for all columns but ``used``, and what each column of ``docs`` is called there."""
    names = {c: c if c in used else f"__in{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def shown(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of the table that was given to :func:`hidden`, under their own names."""
    return df.select(*[F.col(f"`{now}`").alias(name) for name, now in names.items()])


def text_hash(text: Column) -> Column:
    """64 bits of a text; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
