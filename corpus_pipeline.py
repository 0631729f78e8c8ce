"""From raw documents to training shards: one operator after the other, each on all that the one before it kept."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import decontamination, mixing, near_dedup, quality_rules, sharding
from tallyloom.llm.common import discard, recorded, removable, shared_folder, table

Work = Callable[[SparkSession, DataFrame, str], DataFrame]
#: What the latest call of each stage staged, by stage and folder of the tables.
_staged: dict[tuple[int, str], list[DataFrame]] = {}


def stage(number: int) -> Callable[[Work], Work]:
    """A step of a chain over one folder: once a stage is called, what the stage before it staged there goes.

    So the result of a stage has to be written before the next one is called; :func:`run` keeps its own books and shares
    nothing with other calls. Stages take null texts, keys and sources, empty tables, repeated rows, texts of any length
    and further columns of any name as their operators do.
    """
    def wrap(work: Work) -> Work:
        @functools.wraps(work)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            discard(*_staged.pop((number - 1, sf_dir), []))
            with recorded() as staged:
                out = work(spark, docs, sf_dir)
            _staged.setdefault((number, sf_dir), []).extend(staged)
            return out
        run_stage.work = work
        return run_stage
    return wrap


@stage(0)
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; lines that too many documents of a host repeat are cut out.

    Null and empty texts are rejected; a null source is a host of its own.
    """
    return quality_rules.clean(docs)


@stage(1)
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least doc_id, a null one only where there is no other."""
    return near_dedup.dedupe(docs)


@stage(2)
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more stands in the benchmark go; from the others, shared spans are cut out.

    Null and empty texts share nothing and stay; benchmark items with a null text match nothing.
    """
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@stage(3)
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stands as often as the mix takes it; which of wholly repeated rows is taken does not matter.

    Texts without words are taken as often as the share of their source says, at no cost.
    """
    return mixing.materialise(docs)


@stage(4)
def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets its shard and its place there; columns named size, shard or slot are replaced."""
    return sharding.shard(docs, shards=16)


STAGES = [
    ("quality rules", quality),
    ("near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again by the next one.

    Once a result is written, what its stage staged goes, and so does the result before it. The last one stays until the
    driver ends; every call has a folder of its own.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/tallyloom-llm/pipeline-{uuid.uuid4().hex}"
    written: DataFrame | None = None
    for i, (_, step) in enumerate(STAGES):
        with recorded() as staged:
            out = step.work(spark, docs, sf_dir)
        out.write.option("compression", "zstd").parquet(f"{folder}/{i}")
        discard(*staged, *[written] if written is not None else [])
        docs = written = removable(spark.read.schema(out.schema).parquet(f"{folder}/{i}"), f"{folder}/{i}")
    return docs


#: The stages hash, fit and sample in ways that SQL cannot repeat; tests compare them with brute-force versions.
ORACLE_SQL = None
