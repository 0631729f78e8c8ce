"""Rows by key that micro-batches add or change: one folder a batch, merged into a snapshot from time to time.

The snapshot is dealt to folders by a hash of the key, so a small batch reads only the folders that can hold its keys, besides
the few batches since the snapshot. A snapshot counts from its commit on, which names the last batch inside; batches up to
that one are skipped from then on, whether or not their folders are gone. So a stop between any two steps loses and repeats nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyloom.sources import commits

#: Folders of a snapshot.
BUCKETS = 64


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def batches(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n[6:]) for n in commits.listed(spark, root) if n.startswith("batch=") and n[6:].isdigit())


def write(rows: DataFrame, root: str, batch_id: int) -> None:
    """The rows that a batch adds or changes; a repeated batch overwrites its own."""
    rows.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")


def _tail(spark: SparkSession, root: str, content: dict | None, before: int | None) -> list[int]:
    upto = content["upto"] if content else -1
    return [b for b in batches(spark, root) if b > upto and (before is None or b < before)]


def read(spark: SparkSession, root: str, keys: list[str], before: int | None = None, asked: DataFrame | None = None) -> DataFrame | None:
    """The last row of each key (of the batches before ``before``); None where nothing has been written.

    With ``asked`` (which holds the key columns) only its keys are returned, and only their folders of the snapshot are read.
    """
    _, content = commits.load(spark, root)
    parts = []
    if content:
        snapshot = spark.read.parquet(f"{root}/{content['folder']}")
        if asked is not None:
            held = [r[0] for r in asked.select(_bucket(keys, content["buckets"]).alias("b")).distinct().collect()]
            snapshot = snapshot.where(F.col("bucket").isin(held))
        parts.append(snapshot.drop("bucket").withColumn("batch", F.lit(-1)))
    tail = _tail(spark, root, content, before)
    if tail:
        rows = spark.read.option("basePath", root).parquet(*[f"{root}/batch={b}" for b in tail])
        parts.append(rows.withColumn("batch", F.col("batch").cast("int")))
    if not parts:
        return None
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    if asked is not None:
        rows = rows.join(asked.select(*keys).distinct(), keys, "left_semi")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))
    return rows.withColumn("place", place).where("place = 1").drop("place", "batch")


def largest(spark: SparkSession, root: str, column: str, before: int | None = None) -> int | None:
    """The largest value that any batch has written; the snapshot's is in its commit."""
    _, content = commits.load(spark, root)
    tail = _tail(spark, root, content, before)
    known = [content["largest"].get(column)] if content else []
    if tail:
        known.append(spark.read.parquet(*[f"{root}/batch={b}" for b in tail]).agg(F.max(column)).first()[0])
    return max((v for v in known if v is not None), default=None)


def snapshot(rows: DataFrame, root: str, keys: list[str], upto: int, largest_of: list[str] = (), buckets: int = BUCKETS) -> None:
    """Makes ``rows`` the state after batch ``upto``, in one step once they are written."""
    spark = rows.sparkSession
    number, _ = commits.load(spark, root)
    folder = f"snapshot/{uuid.uuid4().hex}"
    rows.withColumn("bucket", _bucket(keys, buckets)).repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/{folder}")
    peaks = {}
    if largest_of:
        written = spark.read.schema(rows.schema).parquet(f"{root}/{folder}")
        peaks = written.agg(*[F.max(c).alias(c) for c in largest_of]).first().asDict()
    commits.commit(spark, root, number + 1, {"upto": upto, "folder": folder, "buckets": buckets, "largest": peaks})


def compact(spark: SparkSession, root: str, keys: list[str], before: int, every: int, largest_of: list[str] = ()) -> bool:
    """Merges the batches before ``before`` into a new snapshot if ``every`` or more lie beside the present one.

    What the new snapshot replaces goes afterwards, but for the snapshot before it, which readers may still hold.
    """
    number, content = commits.load(spark, root)
    tail = _tail(spark, root, content, before)
    if len(tail) < every:
        return False
    snapshot(read(spark, root, keys, before), root, keys, tail[-1], largest_of)
    tidy(spark, root)
    return True


def tidy(spark: SparkSession, root: str) -> None:
    """Removes batches that the snapshot holds, and snapshots and commits older than the one before it."""
    known = commits.numbers(spark, root)
    if not known:
        return
    upto = commits.load(spark, root)[1]["upto"]
    for batch in batches(spark, root):
        if batch <= upto:
            commits.remove(spark, f"{root}/batch={batch}")
    named = {commits.load(spark, root, n)[1]["folder"] for n in known[-2:]}
    for number in known[:-2]:
        commits.remove(spark, f"{root}/_commits/{number:020d}.json")
    for name in commits.listed(spark, f"{root}/snapshot"):
        if f"snapshot/{name}" not in named:
            commits.remove(spark, f"{root}/snapshot/{name}")
