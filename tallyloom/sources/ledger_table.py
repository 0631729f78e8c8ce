"""The ledger as folders of months under a commit log: an edit rewrites the months it touches, and no others.

A commit lists the folders of each month. Writers first write new folders and then commit the next number; who comes second
reads the new state and tries again. A writer that dies in between leaves folders that no commit names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tallyloom.sources import commits
from tallyloom.sources.commits import Conflict

ATTEMPTS = 5


def month_of(date: Column) -> Column:
    return F.coalesce(F.date_format(date, "yyyy-MM"), F.lit("none"))


def _written(rows: DataFrame, root: str) -> list[list[str]]:
    """(month, folder) of each month of the rows, written under a new name."""
    folder = f"data/{uuid.uuid4().hex}"
    rows.withColumn("__month", month_of(F.col("date"))).write.partitionBy("__month").parquet(f"{root}/{folder}")
    names = [n for n in commits.listed(rows.sparkSession, f"{root}/{folder}") if n.startswith("__month=")]
    return [[n.removeprefix("__month="), f"{folder}/{n}"] for n in names]


def create(rows: DataFrame, root: str) -> int:
    """The first commit of a new table. A table that exists raises :class:`Conflict`."""
    commits.commit(rows.sparkSession, root, 1, {"schema": rows.schema.json(), "folders": _written(rows, root)})
    return 1


def _read(spark: SparkSession, root: str, content: dict, months: list[str] | None = None) -> DataFrame:
    schema = StructType.fromJson(json.loads(content["schema"]))
    paths = [f"{root}/{f}" for m, f in content["folders"] if months is None or m in months]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read(spark: SparkSession, root: str, number: int | None = None, months: list[str] | None = None) -> DataFrame:
    """The table after a commit (the latest by default); with ``months`` (``yyyy-MM``, ``none`` for no date) only their folders."""
    _, content = commits.load(spark, root, number)
    if content is None:
        raise ValueError(f"{root} holds no ledger")
    return _read(spark, root, content, months)


def append(rows: DataFrame, root: str) -> int:
    """Adds rows; nothing is rewritten."""
    return edit(rows.sparkSession, root, None, lambda _: rows)


def edit(spark: SparkSession, root: str, ids: DataFrame | None, change: Callable[[DataFrame], DataFrame]) -> int:
    """Replaces the months that hold one of ``ids`` by ``change`` of their rows, and returns the number of the commit.

    ``change`` gets all rows of these months and may drop, alter and add rows, also into other months, whose folders stay.
    The months are found by reading ids and dates alone. Unknown ids touch nothing.
    """
    for _ in range(ATTEMPTS):
        number, content = commits.load(spark, root)
        if content is None:
            raise ValueError(f"{root} holds no ledger")
        whole = _read(spark, root, content)
        touched = [] if ids is None else [r[0] for r in whole.join(ids.select("id").distinct(), "id", "left_semi")
                                          .select(month_of(F.col("date"))).distinct().collect()]
        if ids is not None and not touched:
            return number
        changed = change(_read(spark, root, content, touched)).select(*whole.columns)
        folders = [[m, f] for m, f in content["folders"] if m not in touched] + _written(changed, root)
        try:
            commits.commit(spark, root, number + 1, {**content, "folders": folders})
            return number + 1
        except Conflict:
            continue
    raise Conflict(f"{ATTEMPTS} other commits came first")


def compact(spark: SparkSession, root: str, most: int = 8) -> int:
    """Rewrites the months that lie in more than ``most`` folders into one each."""
    number, content = commits.load(spark, root)
    held: dict[str, int] = {}
    for month, _ in (content or {"folders": []})["folders"]:
        held[month] = held.get(month, 0) + 1
    crowded = [m for m, n in held.items() if n > most]
    if not crowded:
        return number
    merged = _written(_read(spark, root, content, crowded), root)
    commits.commit(spark, root, number + 1, {
        **content, "folders": [[m, f] for m, f in content["folders"] if m not in crowded] + merged})
    return number + 1


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Removes commits before the last ``keep`` and folders that no commit names. No writer may be at work."""
    known = commits.numbers(spark, root)
    for number in known[:-keep]:
        commits.remove(spark, f"{root}/_commits/{number:020d}.json")
    named = {f.split("/")[1] for n in known[-keep:] for _, f in commits.load(spark, root, n)[1]["folders"]}
    for folder in commits.listed(spark, f"{root}/data"):
        if folder not in named:
            commits.remove(spark, f"{root}/data/{folder}")
