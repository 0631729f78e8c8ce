"""Compression classifier: zstandard dictionaries of good and of bad text, and the calibrated difference in size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tallyloom.llm import calibration, common

#: Labelled documents of each class that take part in the fit; bytes of each that may enter a dictionary, drawn in pieces.
SAMPLE_DOCS, SAMPLE_BYTES, PIECE = 4000, 2048, 512
DICTIONARY_BYTES, CHUNK, LEVEL = 32_768, 1024, 3


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; from too few samples, their plain text."""
    parts = [s[i:i + PIECE] for s in samples for i in range(0, len(s), PIECE)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY_BYTES:]


def pieces(text: Column, seed: Column) -> Column:
    """Up to ``SAMPLE_BYTES`` of a text that is not empty: the pieces of ``PIECE`` bytes with the least hash, anywhere in it, in
    their order."""
    numbers = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / PIECE).cast("int"))
    ranked = F.sort_array(F.transform(numbers, lambda i: F.struct(F.xxhash64(seed, i).alias("h"), i.alias("i"))))
    chosen = F.array_sort(F.transform(F.slice(ranked, 1, SAMPLE_BYTES // PIECE), lambda r: r["i"]))
    return F.transform(chosen, lambda i: F.substring(text, i * PIECE + 1, F.lit(PIECE)))


def _compressor(dictionary: bytes | None):
    data = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, **data)


def measures(texts: list[bytes | None], good: bytes, bad: bytes) -> np.ndarray:
    """For each whole text, read in chunks: the size under the bad dictionary less that under the good one, as a share of
    the larger and for each byte, and the plain compressed size for each byte. Texts without bytes: zeros."""
    coders = [_compressor(d) for d in (good, bad, None)]
    out = np.zeros((len(texts), 3))
    for i, text in enumerate(texts):
        if not text:
            continue
        with_good, with_bad, plain = (
            sum(len(c.compress(text[a:a + CHUNK])) for a in range(0, len(text), CHUNK)) for c in coders)
        gap = with_bad - with_good
        out[i] = gap / max(with_good, with_bad), gap / len(text), plain / len(text)
    return out


def _measured(good: bytes, bad: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measures(batch.column(batch.num_columns - 1).to_pylist(), good, bad)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *[pa.array(found[:, i]) for i in range(3)]],
                names=[*batch.schema.names[:-1], "__m0", "__m1", "__m2"])
    return run


def _scored(good: bytes, bad: bytes, model: calibration.Logistic):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.score(measures(batch.column(batch.num_columns - 1).to_pylist(), good, bad))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found)], names=[*batch.schema.names[:-1], "score"])
    return run


class CompressionClassifier:
    """Two dictionaries and a calibration; :meth:`fit` makes one and :meth:`score` applies it."""

    def __init__(self, good: bytes, bad: bytes, model: calibration.Logistic | None, prior: float):
        self.good, self.bad, self.model, self.prior = good, bad, model, prior

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, *, label: str = "label", text: str = "text", key: str = "doc_id",
            sample_docs: int = SAMPLE_DOCS) -> CompressionClassifier:
        """Learns from the documents that ``labels`` marks 1 (good) or 0 (bad).

        ``sample_docs`` labels of each class are drawn, see :func:`calibration.draw`. One half of the documents
        makes the dictionaries, with up to ``SAMPLE_BYTES`` of each, see :func:`pieces`; the whole texts of the other half, measured in Spark, make the
        calibration, weighted to the share that the classes have among all labels. Null texts are empty. Without labels of
        both classes every score is the share of good ones, one half without any.
        """
        rows, counts = calibration.draw(docs, labels, label=label, text=text, key=key, per_class=sample_docs)
        if len(counts) < 2:
            return cls(b"", b"", None, float(next(iter(counts), 0.5)))
        prior = counts[1] / sum(counts.values())
        drawn = common.staged(rows, "quality-sample")
        even = F.pmod(F.shiftrightunsigned("h", 1), F.lit(2)) == 0
        parts = drawn.where(even).where("length(t) > 0").select("y", "h", pieces(F.col("t"), F.col("h")).alias("p")).collect()
        samples = sorted((r.h, b"".join(map(bytes, r.p)), r.y) for r in parts)
        bad, good = (_dictionary([t for _, t, label in samples if label == y]) for y in (0, 1))
        rest = drawn.where(~even).select("y", "h", "t").mapInArrow(
            _measured(good, bad), "y int, h long, __m0 double, __m1 double, __m2 double").collect()
        rest.sort(key=lambda r: (r.h, r[2:]))
        common.discard(drawn)
        y = np.array([r.y for r in rest], float)
        if len(set(y)) < 2:
            return cls(good, bad, None, prior)
        seen = {v: float((y == v).sum()) for v in (0, 1)}
        importance = np.array([counts[int(v)] / seen[int(v)] for v in y])
        return cls(good, bad, calibration.fit(np.array([r[2:] for r in rest]), y, importance), prior)

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` without ``text``, with ``score``: how likely the whole text is good, from 0 to 1.

        Null texts score like empty ones. Repeated rows are all scored; an empty table gives no rows; a column named score is
        replaced. The dictionaries travel with the job: 32 KB each.
        """
        known = common.without(docs, "score") if text.lower() != "score" else docs
        others = [c for c in known.columns if c != text]
        ready = known.select(*[f"`{c}`" for c in others], F.col(f"`{text}`").cast("binary").alias("__bytes"))
        if self.model is None:
            return ready.drop("__bytes").withColumn("score", F.lit(self.prior))
        schema = StructType([*ready.schema.fields[:-1], StructField("score", DoubleType())])
        return ready.mapInArrow(_scored(self.good, self.bad, self.model), schema)


def remainder(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``: which rows are held out of a fit."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(parts))
