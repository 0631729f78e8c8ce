"""Fill-in-the-middle: a text is cut at two token boundaries and its middle moved to the end."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallyloom.llm import common
from tallyloom.llm.boundary_set import BoundarySet

MARKERS = ("<P>", "<S>", "<M>")
OUTPUTS = ("n", "form", "prefix_chars", "middle_chars", "fim_text")


def boundaries(text: str) -> BoundarySet:
    """The places of the last characters of the tokens ``[A-Za-z]+|[^A-Za-z]``, in code points from 0."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    letter = (points | 32) - np.uint32(97) < 26
    inside = np.zeros(len(points), bool)
    inside[:-1] = letter[:-1] & letter[1:]
    return BoundarySet(~inside)


def cuts(places: BoundarySet, first: int, second: int) -> tuple[int, int]:
    """Code points before the cuts behind so many tokens, the smaller number first."""
    low, high = sorted((first, second))
    return (places.select(low - 1) + 1 if low else 0), (places.select(high - 1) + 1 if high else 0)


def rearrange(text: str, h: Sequence[int], rate: int, spm_rate: int, markers: Sequence[str]):
    """``OUTPUTS`` of one text; ``h`` holds four random numbers: two cuts, whether to cut, and which form."""
    places = boundaries(text)
    n = len(places)
    if not text or any(m in text for m in markers) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = cuts(places, h[0] % (n + 1), h[1] % (n + 1))
    p, s, m = markers
    if h[3] % 100 < spm_rate:
        return n, "spm", a, b - a, f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"
    return n, "psm", a, b - a, f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 that depend on the key and the seed alone; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, *, text: str = "text", key: str = "doc_id", rate: int = 90, spm_rate: int = 20, seed: int = 1,
              markers: Sequence[str] = MARKERS, carry: list[str] | None = None) -> DataFrame:
    """``docs`` with ``n`` tokens, ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and ``fim_text``.

    About ``rate`` percent of the texts are cut behind two random numbers of tokens; of these ``spm_rate`` percent put the suffix
    first. The choices depend on ``key`` and ``seed`` only, so a rerun gives the same rows. ``carry``: the input columns
    to keep (all by default).

    A null text counts as empty; empty texts and texts that hold a marker stay plain, with null lengths. A null key counts as
    an empty one; rows with equal keys draw alike. Repeated rows are all returned; an empty table gives no rows. Input
    columns named like an output are replaced. A text is one row, held in memory with 4 bytes for each character.
    """
    kept = [c for c in docs.columns if (carry is None or c in carry) and c.lower() not in OUTPUTS]
    ready = docs.select(*[f"`{c}`" for c in kept], F.array(*draws(F.col(f"`{key}`"), seed)).alias("__h"),
                        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, texts = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1)
            found = [rearrange(t.as_py(), h, rate, spm_rate, markers) for h, t in zip(numbers, texts)]
            columns = [pa.array([f[i] for f in found], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *columns], names=[*batch.schema.names[:-2], *OUTPUTS])

    added = [StructField(c, StringType() if c in ("form", "fim_text") else LongType()) for c in OUTPUTS]
    return ready.mapInArrow(run, StructType([*ready.drop("__h", "__text").schema.fields, *added]))


def restore(output: Column, form: Column, markers: Sequence[str] = MARKERS) -> Column:
    """The original text, from an output and its form alone."""
    part = F.split(output, "|".join(map(re.escape, markers)), -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(
        form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)
