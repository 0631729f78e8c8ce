"""Session settings and the one way this library cuts lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_KEPT: dict[str, DataFrame] = {}
_SCOPES: list[list[DataFrame]] = []
_OWN_FOLDERS: dict[str, tempfile.TemporaryDirectory] = {}


def build_session(app: str = "tallyloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs expect; on a cluster the submit command sets the rest."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: the one of ``spark.checkpoint.dir``.

    A session in one process (master ``local`` or ``local[...]``) without that setting gets a temporary folder of its own,
    removed when the driver ends. On a cluster the setting must be there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDERS:
        _OWN_FOLDERS[app] = tempfile.TemporaryDirectory(prefix="tallyloom-", ignore_cleanup_errors=True)
    return _OWN_FOLDERS[app].name


def durable(df: DataFrame) -> DataFrame:
    """Writes ``df`` once as Parquet into the shared folder, so that several readers see the same rows.

    The behaviour is the same everywhere: the copy is written, also where nothing would be recomputed. Copies stay until
    :func:`discard`, until the :func:`scratch` block around the call ends, or until the driver ends.
    """
    path = f"{shared_folder(df.sparkSession)}/tallyloom/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    copy = df.sparkSession.read.schema(df.schema).parquet(path)
    copy._durable_path = path
    _KEPT[path] = copy
    if _SCOPES:
        _SCOPES[-1].append(copy)
    return copy


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Copies made inside the block go when it ends; what is computed from them has to be written by then."""
    _SCOPES.append([])
    try:
        yield _SCOPES[-1]
    finally:
        discard(*_SCOPES.pop())


def discard(*copies: DataFrame) -> None:
    """Removes durable copies that nothing reads any more."""
    for copy in copies:
        _KEPT.pop(copy._durable_path, None)
        try:
            context = copy.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(copy._durable_path)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has ended; the folder belongs to the run
            continue


@atexit.register
def _discard_all() -> None:
    discard(*list(_KEPT.values()))
