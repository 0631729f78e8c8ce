"""A commit log in a folder: numbered files, each put in place by one rename that fails where the number is taken."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has committed this number."""


def _path(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(path)


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it is missing."""
    fs, path = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, target = _path(spark, path)
    fs.delete(target, True)


def numbers(spark: SparkSession, root: str) -> list[int]:
    return [int(n[:-5]) for n in listed(spark, f"{root}/_commits") if n.endswith(".json") and n[:-5].isdigit()]


def load(spark: SparkSession, root: str, number: int | None = None) -> tuple[int, dict | None]:
    """A commit, the latest by default: its number and what it says; (0, None) before the first."""
    known = numbers(spark, root)
    number = (max(known) if known else 0) if number is None else number
    if not number:
        return 0, None
    fs, path = _path(spark, f"{root}/_commits/{number:020d}.json")
    stream = fs.open(path)
    try:
        return number, json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, root: str, number: int, content: dict) -> None:
    """Makes ``content`` commit ``number``. Readers see all of it or nothing; a number that is taken raises :class:`Conflict`."""
    fs, draft = _path(spark, f"{root}/_commits/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()
    _, final = _path(spark, f"{root}/_commits/{number:020d}.json")
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(draft, final, none)
    except Py4JJavaError as error:
        fs.delete(draft, False)
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            raise Conflict(f"commit {number} of {root} is taken") from None
        raise
