"""Quality rules: word and repetition counts of each text, and line frequency across the documents of a host."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType, ArrayType, IntegerType, LongType

from tallyloom.llm import common

SYMBOLS = tuple(c.encode() for c in "#*$%&|<>")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    _, pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)
    windows, where, times = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    if len(windows) == n - 2:
        return 0
    twice = times[where] > 1
    hit = np.zeros(n, bool)
    for i in range(3):
        hit[i:n - 2 + i] |= twice
    return int(hit.sum())


def measure(text: bytes | None) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """The five measures, and for each line with a word the hash of its normalised form and its number of words.

    A normalised line is lower-cased (A-Z) with single blanks between words.
    """
    text = text or b""
    words = text.split()
    lines, sizes, earlier, repeats = [], [], set(), 0
    for line in text.split(b"\n"):
        parts = line.split()
        if not parts:
            continue
        if line in earlier:
            repeats += 1
        earlier.add(line)
        lines.append(xxhash.xxh64_intdigest(b" ".join(parts).lower()) - 2**63)
        sizes.append(len(parts))
    blanks = sum(text.count(c) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
    code_points = len(text.decode("utf-8")) if not text.isascii() else len(text)
    return (len(words), code_points - blanks, sum(map(text.count, SYMBOLS)), repeats, repeated_words(words), lines, sizes)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [measure(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
        columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(5)]
        columns += [pa.array([f[5] for f in found], pa.list_(pa.int64())), pa.array([f[6] for f in found], pa.list_(pa.int32()))]
        names = batch.schema.names[:-1] + [f"__{m}" for m in MEASURES] + ["__lines", "__sizes"]
        yield pa.RecordBatch.from_arrays(batch.columns[:-1] + columns, names=names)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures of each whole text, and the arrays ``__lines`` and ``__sizes``."""
    docs = docs.withColumn("__bytes", F.col(f"`{text}`").cast("binary"))
    extra = [StructField(f"__{m}", LongType()) for m in MEASURES]
    extra += [StructField("__lines", ArrayType(LongType())), StructField("__sizes", ArrayType(IntegerType()))]
    out = docs.mapInArrow(_measured, StructType(docs.drop("__bytes").schema.fields + extra))
    return out.withColumnsRenamed({f"__{m}": m for m in MEASURES})


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def frequent_lines(table: DataFrame, text: str, max_docs: int) -> DataFrame:
    """(__host, __line) of the lines that stand in more than ``max_docs`` distinct documents of their host.

    Equal texts of a host count as one document. A hot line or host is counted in two steps, first by document, so its
    partial sums and not its rows meet in one task.
    """
    docs = table.select("__host", common.text_hash(F.col(f"`{text}`")).alias("__doc"), "__lines") \
        if "__doc" not in table.columns else table.select("__host", "__doc", "__lines")
    return (
        docs.select("__host", "__doc", F.explode(F.array_distinct("__lines")).alias("__line")).distinct()
        .groupBy("__host", "__line").count().where(F.col("count") > max_docs).select("__host", "__line")
    )


def judge(docs: DataFrame, *, text: str = "text", host: str = "source", max_docs: int = 20,
          min_left: float = 0.3, carry: list[str] | None = None) -> DataFrame:
    """``docs`` with the five measures, ``n_removed_words``, ``base_failed``, ``kept`` and ``__drop``, the places of the
    lines to remove (counting lines with a word from 0).

    A line is removed if its normalised form stands in more than ``max_docs`` distinct documents of the host, however large
    the host is. A document is rejected if the base rules fail or if fewer than ``min_left`` of its
    words remain. Copies of one text count as one document, so a group of copies does not make its own lines frequent.

    ``carry``: the input columns to keep (all by default). Null texts have no words and fail the base rules; a null host is a
    host of its own; repeated rows are judged alike and all returned; an empty table gives no rows. Input columns with
    the name of an output column are replaced. Lines are compared by 64-bit hashes within a host.
    """
    outputs = (*MEASURES, "n_removed_words", "base_failed", "kept")
    known = common.without(docs, *[c for c in outputs if c.lower() not in (text.lower(), host.lower())])
    ready = known.withColumns({
        "__host": F.xxhash64(F.col(f"`{host}`").isNull(), F.col(f"`{host}`")),
        "__doc": common.text_hash(F.col(f"`{text}`")),
        "__rid": F.monotonically_increasing_id(),
    })
    kept = [c for c in known.columns if carry is None or c in carry]
    table = measured(ready, text).select(*[f"`{c}`" for c in kept], *MEASURES, "__host", "__doc", "__rid", "__lines", "__sizes")
    table = common.staged(table, "quality")
    hits = (
        table.select("__rid", "__host", F.posexplode(F.arrays_zip("__lines", "__sizes")).alias("__at", "__l"))
        .select("__rid", "__host", "__at", F.col("__l.__lines").alias("__line"), F.col("__l.__sizes").alias("__size"))
        .join(frequent_lines(table, text, max_docs), ["__host", "__line"])
        .groupBy("__rid").agg(F.sum("__size").alias("n_removed_words"), F.collect_list("__at").alias("__drop"))
    )
    left = F.col("n_words") - F.col("n_removed_words")
    return (
        table.drop("__host", "__doc", "__lines", "__sizes").join(hits, "__rid", "left").drop("__rid")
        .withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long"))
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & (left >= min_left * F.col("n_words")))
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, drop in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
            if text is not None and drop:
                gone, at, lines = set(drop), -1, []
                for line in text.split("\n"):
                    worded = bool(line.encode().split())
                    at += worded
                    if not (worded and at in gone):
                        lines.append(line)
                text = "\n".join(lines)
            out.append(text)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.string())], names=batch.schema.names[:-1])


def clean(docs: DataFrame, *, text: str = "text", host: str = "source", **rules) -> DataFrame:
    """The kept documents with the columns of ``docs``; frequent lines are cut out of the text, and ``n_chars`` follows.

    See :func:`judge` for the rules and for nulls, repeated rows and empty tables. Further columns keep their values,
    whatever their names.
    """
    known, names = common.hidden(docs, text, host)
    kept = judge(known, text=text, host=host, **rules).where("kept")
    ready = kept.select(*[f"`{c}`" for c in names.values() if c != text], f"`{text}`", "__drop")
    out = ready.mapInArrow(_cut, StructType(ready.schema.fields[:-1]))
    if "n_chars" in docs.columns:
        out = out.withColumn(names["n_chars"], F.length(f"`{text}`").cast(docs.schema["n_chars"].dataType))
    return common.shown(out, names)
