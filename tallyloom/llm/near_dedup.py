"""SimHash fingerprints, linked through pigeonring filtering, and the groups that the links form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallyloom.llm import common
from tallyloom.llm.components import connected

#: Four segments of 16 bits for at most three differing bits; a chain of n segments may differ in n * 3 // 4 bits.
SEGMENTS, SEGMENT_BITS, MAX_DIFFERENCE = 4, 16, 3
SEED, SHINGLE_WORDS = 42, 3
_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)


def fingerprint(text: bytes | None) -> int:
    """Unsigned 64 bits: a bit is set if over half of the shingle hashes have it. No words: zero."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    whole = b" ".join(words)
    if n <= SHINGLE_WORDS:
        return xxhash.xxh64_intdigest(whole, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = [0, *ends[:n - SHINGLE_WORDS].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(whole[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE_WORDS - 1:] - 1).tolist())), ">u8", len(starts))
    octets = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(x) for x in batch.column(batch.num_columns - 1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(found.view(np.int64))], names=[*batch.schema.names[:-1], "__print"])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``__print``, the fingerprint of the whole text as a signed long."""
    ready = docs.withColumn("__bytes", F.col(f"`{text}`").cast("binary"))
    return ready.mapInArrow(_printed, StructType([*ready.drop("__bytes").schema.fields, StructField("__print", LongType())]))


def _turned(value: Column, segment: int) -> Column:
    """The bits of ``value`` rotated so that the given segment comes first."""
    bits = SEGMENT_BITS * segment
    return value if not bits else F.shiftleft(value, bits).bitwiseOR(F.shiftrightunsigned(value, 64 - bits))


def links(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of different fingerprints with at most three differing bits, each at least once.

    Pigeonring: read as a ring, two such fingerprints have a segment from which every chain of n segments differs in at
    most n * 3 // 4 bits: 0, 1, 2, 3. So the first segment is equal and the second differs in one bit at most, which makes
    an equality on 32 bits: each fingerprint is looked up with its 17 forms of the second segment, at 4 starts. Chains of three and of
    four are compared in the join, before a pair exists. ``prints``: distinct values in ``__print``.
    """
    value = F.col("__print")
    pair = [F.shiftrightunsigned(_turned(value, s), 32) for s in range(SEGMENTS)]
    keys = F.array(*[p.bitwiseOR(F.lit(s << 32).cast("long")) for s, p in enumerate(pair)])
    indexed = prints.select(value.alias("b"), F.explode(keys).alias("key"))
    forms = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(SEGMENT_BITS)])
    asked = (
        prints.select(value.alias("a"), F.explode(keys).alias("exact"))
        .select("a", "exact", F.explode(forms).alias("form"))
        .select("a", F.col("exact").bitwiseXOR(F.col("form")).alias("key"))
    )
    differing = F.col("a").bitwiseXOR(F.col("b"))
    start = F.shiftrightunsigned(F.col("key"), 32)
    chain = F.lit(None)
    for s in reversed(range(SEGMENTS)):
        chain = F.when(start == s, F.bit_count(F.shiftrightunsigned(_turned(differing, s), SEGMENT_BITS))).otherwise(chain)
    return (
        asked.join(indexed.hint("merge"), "key")  # rows that come out of an explode are many more than their source's size tells
        .where((F.col("a") < F.col("b")) & (F.bit_count(differing) <= MAX_DIFFERENCE) & (chain <= 2))
        .select("a", "b")
    )


def classes(table: DataFrame, key: str) -> DataFrame:
    """One row for each fingerprint of ``table``: ``__print`` and ``component_id``, the least key that it reaches."""
    distinct = common.staged(table.groupBy("__print").agg(F.min(f"`{key}`").alias("__least")), "prints")
    roots = connected(links(distinct.select("__print")))
    joined = distinct.join(roots, distinct["__print"] == roots["node"], "left").select(
        "__print", "__least", F.coalesce("root", "__print").alias("__root"))
    joined = common.staged(joined, "classes")
    least = joined.groupBy("__root").agg(F.min("__least").alias("component_id"))
    return joined.join(least, "__root").select("__print", "component_id")


def _numbered(docs: DataFrame, text: str, carry: list[str]) -> DataFrame:
    """The carried columns, ``__print`` and ``__rid``, staged."""
    return common.numbered(fingerprints(docs, text).select(*[f"`{c}`" for c in carry], "__print"), "prints")


def group(docs: DataFrame, *, text: str = "text", key: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """``docs`` with ``fingerprint`` (16 hex digits) and ``component_id``.

    Equal fingerprints collapse to one class before any pair is sought, so a group of thousands of copies costs one row.
    ``carry``: the input columns to keep (all by default). Null and empty texts share fingerprint zero and are linked like
    any other. A null key is never the least one unless all keys of a component are null. Repeated rows are all
    returned; an empty table gives no rows. Input columns named like an output column are replaced.
    """
    known = common.without(docs, "fingerprint", "component_id")
    table = _numbered(known, text, [c for c in known.columns if carry is None or c in carry])
    found = table.join(classes(table, key), "__print").drop("__rid")
    return found.withColumn("fingerprint", F.lpad(F.lower(F.hex("__print")), 16, "0")).drop("__print")


def dedupe(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One document of each group: the one with the least key, and one of those if rows repeat. Columns as in ``docs``.

    The survivors are chosen on narrow rows; the texts are exchanged once. See :func:`group` for nulls, repeated rows and
    empty tables.
    """
    table = _numbered(docs, text, docs.columns)
    order = F.struct(F.col(f"`{key}`").isNull().alias("n"), F.col(f"`{key}`").alias("k"), F.col("__rid").alias("r"))
    chosen = table.select("__print", order.alias("o")).join(classes(table, key), "__print")
    survivors = chosen.groupBy("component_id").agg(F.min("o").alias("first")).select(F.col("first.r").alias("__rid"))
    return table.join(survivors, "__rid", "left_semi").select(*[f"`{c}`" for c in docs.columns])
