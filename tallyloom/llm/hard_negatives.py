"""Hard negatives by exact inner products: residues modulo small primes, float32 products, Chinese remaindering."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.llm import common

#: Whole numbers up to this are exact in float32; sums run over so many terms at most.
EXACT, TERMS = 2**24, 4096
#: Bytes of the vectors in a block, and scores that a task holds at once.
BLOCK_BYTES, TILE_SCORES = 1 << 21, 1 << 21
#: Blocks of rows in a staged file, which one task reads whole.
BLOCKS_A_FILE = 4
NO_SCORE = {np.dtype(t): np.iinfo(t).min for t in (np.int32, np.int64)}
BLOCK = "rids array<long>, ids array<long>, labels array<long>, vectors binary, width int, norm double"
FOUND = "anchor_rid long, anchor_id long, place int, other_rid long, other_id long, score long"


def primes_for(bound: int, width: int) -> list[int]:
    """Odd primes whose product exceeds twice ``bound``, falling from the largest that keeps sums of products exact.

    Residues lie between -p/2 and p/2, so a sum of ``width`` products stays within width * (p/2)**2.
    """
    p = 2 * int((EXACT / min(max(width, 1), TERMS)) ** 0.5) + 1
    found, product = [], 1
    while product <= 2 * bound + 1:
        p -= 2
        while any(p % q == 0 for q in range(3, int(p**0.5) + 1, 2)):
            p -= 2
        found.append(p)
        product *= p
    return found


def _centred(values: np.ndarray, p: int) -> np.ndarray:
    """Residues of least absolute value."""
    rest = values % p
    rest[rest > p // 2] -= p
    return rest


def residues(vectors: np.ndarray, primes: Sequence[int]) -> list[np.ndarray]:
    """The component matrix modulo each prime, as float32."""
    return [_centred(vectors, p).astype(np.float32) for p in primes]


def multiply(left: Sequence[np.ndarray], right: Sequence[np.ndarray], primes: Sequence[int]) -> np.ndarray:
    """Exact inner products of all rows of ``left`` with all rows of ``right``, both given by their residues.

    Each float32 product is exact. The digits of a score in the mixed-radix system of the primes follow one after the
    other from its residues; as digits are taken of least absolute value, their weighted sum is the signed score itself.
    """
    total = 1
    for p in primes:
        total *= p
    kind = np.int32 if total < 2**31 else np.int64
    score = np.zeros((len(left[0]), len(right[0])), kind)
    digits: list[np.ndarray] = []
    weight = 1
    for k, (a, b, p) in enumerate(zip(left, right, primes)):
        rest = np.zeros(score.shape, np.int32)
        for low in range(0, a.shape[1], TERMS):
            rest = (rest + (a[:, low:low + TERMS] @ b[:, low:low + TERMS].T).astype(np.int32)) % p
        for j in range(k):  # take the digits found so far away, and divide by the prime each of them belongs to
            rest = (rest - digits[j]) % p * pow(primes[j], -1, p) % p
        digits.append(_centred(rest, p))
        # Sums may wrap on the way; the score fits, so the end is right.
        score += digits[-1].astype(kind) * kind((weight + 2**63) % 2**64 - 2**63 if kind is np.int64 else weight)
        weight *= p
    return score


def pack(rids: np.ndarray, ids: pa.Array, labels: np.ndarray, vectors: list[np.ndarray]) -> dict:
    """One block: rows in the order of their ids (null last), components as whole numbers; short vectors end with zeros."""
    missing = ids.is_null().to_numpy(zero_copy_only=False)
    order = np.lexsort((rids, ids.fill_null(0).to_numpy(zero_copy_only=False), missing))
    width = max(map(len, vectors), default=0)
    values = np.zeros((len(vectors), width))
    for i, at in enumerate(order):
        values[i, :len(vectors[at])] = vectors[at]
    largest = np.abs(values).max(initial=0)
    norm = float((values * values).sum(axis=1).max(initial=0))
    whole = values.astype(np.int32 if largest < 2**31 else np.int64) if largest < 2**62 else np.zeros(values.shape, np.int32)
    return {"rids": rids[order], "ids": ids.take(pa.array(order)), "labels": labels[order], "vectors": whole.tobytes(),
            "width": width, "norm": norm if largest < 2**62 else float("inf")}


def _as_batch(block: dict, **more) -> pa.RecordBatch:
    types = {"rids": pa.list_(pa.int64()), "ids": pa.list_(pa.int64()), "labels": pa.list_(pa.int64()), "vectors": pa.binary(),
             "width": pa.int32(), "norm": pa.float64(), "lows": pa.list_(pa.int64()), "highs": pa.list_(pa.int64()), "part": pa.int32()}
    row = {**block, **more}
    return pa.RecordBatch.from_arrays([pa.array([v], types[k]) for k, v in row.items()], names=list(row))


def _packed(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rids, ids, labels, vectors, size = [], [], [], [], 0
        for batch in batches:
            lists = batch.column(3)
            starts, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            whole = np.floor(flat * scale)
            start = 0
            for i in range(batch.num_rows):
                vectors.append(whole[starts[i]:starts[i + 1]].copy())
                size += 4 * max(1, len(vectors[-1]))
                if size >= BLOCK_BYTES or i + 1 == batch.num_rows:
                    part = batch.slice(start, i + 1 - start)
                    rids.append(part.column(0).to_numpy())
                    ids.append(part.column(1))
                    labels.append(part.column(2).to_numpy())
                    start = i + 1
                if size >= BLOCK_BYTES:
                    yield _as_batch(pack(np.concatenate(rids), pa.concat_arrays(ids), np.concatenate(labels), vectors))
                    rids, ids, labels, vectors, size = [], [], [], [], 0
        if vectors:
            yield _as_batch(pack(np.concatenate(rids), pa.concat_arrays(ids), np.concatenate(labels), vectors))
    return run


def _matrix(block: dict, width: int) -> np.ndarray:
    n = len(block["rids"])
    size = len(block["vectors"]) // max(1, n * block["width"])
    found = np.frombuffer(block["vectors"], "<i8" if size == 8 else "<i4").reshape(n, block["width"])
    return np.pad(found, ((0, 0), (0, width - block["width"]))).astype(np.int64)


def _block(batch: pa.RecordBatch, row: int, prefix: str) -> dict:
    out = {}
    for name in batch.schema.names:
        if name.startswith(prefix):
            value = batch.column(name)[row]
            out[name.removeprefix(prefix)] = value.values if pa.types.is_list(value.type) else value.as_py()
    for name in ("rids", "labels", "lows", "highs"):
        if name in out:
            out[name] = out[name].to_numpy()
    return out


def _best(score: np.ndarray, count: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The ``count`` highest scores of each row, the left one among equals: (rows, columns, scores) of each place. Uses up ``score``."""
    none = NO_SCORE[score.dtype]
    rows = np.arange(len(score))
    for _ in range(min(count, score.shape[1])):
        at = score.argmax(axis=1)
        value = score[rows, at]
        some = value != none
        if not some.any():
            return
        yield rows[some], at[some], value[some]
        score[rows, at] = none


def _searched(width: int, primes: list[int], count: int, positive: bool):
    """Scores each pair of blocks and returns what can still be among the ``count`` best of an anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, anchors = _block(batch, row, "b_"), _block(batch, row, "a_")
                right = residues(_matrix(block, width), primes)
                own = residues(_matrix(anchors, width), primes)
                step = max(1, TILE_SCORES // max(1, len(block["rids"])))
                for low in range(0, len(anchors["rids"]), step):
                    tile = slice(low, low + step)
                    yield from _tile(block, anchors, tile, multiply([m[tile] for m in own], right, primes), count, positive)
    return run


def _tile(block: dict, anchors: dict, tile: slice, score: np.ndarray, count: int, positive: bool) -> Iterator[pa.RecordBatch]:
    none = NO_SCORE[score.dtype]
    same = anchors["labels"][tile, None] == block["labels"][None, :]
    places = 1
    if positive:
        score[~same | (anchors["rids"][tile, None] == block["rids"][None, :])] = none
    else:
        score[same] = none
        places = len(anchors["lows"]) // len(anchors["rids"])
        lows, highs = (anchors[k].reshape(-1, places)[tile] for k in ("lows", "highs"))
        highs = highs.clip(none, -(none + 1)).astype(score.dtype)
    for place in range(places):
        left = score if positive else np.where(score <= highs[:, place, None], score, none)
        for rows, at, value in _best(left, count):
            if not positive:
                inside = value >= lows[rows, place]
                rows, at, value = rows[inside], at[inside], value[inside]
            if len(rows):
                yield pa.RecordBatch.from_arrays([
                    pa.array(anchors["rids"][tile][rows]), anchors["ids"].take(pa.array(rows + tile.start)),
                    pa.array(np.full(len(rows), place, np.int32)), pa.array(block["rids"][at]), block["ids"].take(pa.array(at)),
                    pa.array(value.astype(np.int64))], names=[f.split()[0] for f in FOUND.split(", ")])


def _pairs(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """Each block of rows beside each block of anchors, read from the staged files by the task that scores them.

    A cartesian product of the files: nothing is shuffled, and no side is sent through the driver, however small its files look.
    """
    left = blocks.select([F.col(c).alias(f"b_{c}") for c in blocks.columns])
    right = anchors.select([F.col(c).alias(f"a_{c}") for c in anchors.columns if c != "part"])
    return left.crossJoin(right.hint("shuffle_replicate_nl"))


def _first(found: DataFrame, count: int, *by: str) -> DataFrame:
    """The ``count`` best of each group, numbered from 1; ranked before the shuffle already."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("other_id").asc_nulls_last(), "other_rid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def _hundredths(value: Column) -> Column:
    """floor(value / 100) of a whole number."""
    return F.floor(value.cast("decimal(20,0)") / F.lit(100)).cast("long")


def mine(table: DataFrame, anchor: Column, *, key: str = "vec_id", vector: str = "embedding", label: str = "label",
         scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the hard negatives of each anchor.

    Components are taken as floor(``scale`` * x), scores are their exact inner products. The positives of a row for which
    ``anchor`` holds are the ``positives`` best other rows of its label; for each of them, the ``negatives`` best rows of other
    labels are returned whose score lies between ``low`` and ``high`` percent of the positive's. Equal scores go to the
    smaller key, null keys last.

    All rows are searched, in blocks: rows and anchors are packed into blocks of two megabytes, staged in files of a few, and every
    block of rows meets every block of anchors once for positives and once for negatives. A task scores one pair of blocks at a time.

    Rows with a null label, a null vector, or a null or non-finite component take no part. An anchor without positives,
    and a positive without negatives, give no rows. Vectors of different lengths end with zeros; empty vectors score
    zero. Repeated rows are rows of their own, also as anchors. An empty table gives no rows; further columns are not
    read. Vectors whose scores may reach 2**56 raise a ValueError.
    """
    value = F.col(f"`{vector}`")
    broken = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = table.where(F.col(f"`{label}`").isNotNull() & value.isNotNull() & ~broken).select(
        F.monotonically_increasing_id().alias("rid"), F.col(f"`{key}`").cast("long").alias("id"),
        F.col(f"`{label}`").cast("long").alias("label"), value.cast("array<double>").alias("vector"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = common.staged(rows, "vectors")
    blocks = common.staged(rows.drop("anchor").mapInArrow(_packed(scale), BLOCK), "blocks", BLOCKS_A_FILE)
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    limits = blocks.agg(F.max("width").alias("width"), F.max("norm").alias("norm")).first()
    chosen = rows.where("anchor").drop("anchor")
    count, most = chosen.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    if not count:
        return table.sparkSession.createDataFrame([], result)
    bound = limits.norm * (1 + 1e-9) + 1
    if bound >= 2**56:
        raise ValueError("scores of these vectors may reach 2**56")
    primes = primes_for(int(bound), limits.width)
    parts = -(-count * max(1, most) * 4 // BLOCK_BYTES)
    chosen = chosen.withColumn("part", F.pmod(F.xxhash64("rid"), F.lit(parts)).cast("int"))

    def together(group: pa.Table) -> pa.Table:
        lists = group.column("vector").combine_chunks()
        vectors = [np.floor(x.values.to_numpy(zero_copy_only=False) * scale) for x in lists]
        rids = group.column("rid").to_numpy()
        block = pack(rids, group.column("id").combine_chunks(), group.column("label").to_numpy(), vectors)
        more = {"part": group.column("part")[0].as_py()}
        if "lows" in group.column_names:
            at = np.argsort(rids)[np.searchsorted(np.sort(rids), block["rids"])]
            for name in ("lows", "highs"):
                more[name] = np.stack([x.values.to_numpy() for x in group.column(name).combine_chunks()])[at].ravel()
        return pa.Table.from_batches([_as_batch(block, **more)])

    def search(anchors: DataFrame, many: int, positive: bool) -> DataFrame:
        return _pairs(blocks, anchors).mapInArrow(_searched(limits.width, primes, many, positive), FOUND)

    asked = common.staged(chosen.groupBy("part").applyInArrow(together, f"{BLOCK}, part int"), "anchors", 1)
    near = common.staged(_first(search(asked, positives, True), positives, "anchor_rid"), "positives")
    score = F.col("score")
    # Whole-number bounds: low * p <= 100 * n <= high * p. Missing positives get a range that holds nothing.
    bands = near.withColumns({
        "lo": -_hundredths(-low * score),
        "hi": _hundredths(high * score),
    })
    top, bottom = F.lit(2**62).cast("long"), F.lit(-(2**62)).cast("long")
    by_rank = F.array_sort(F.collect_list(F.struct("rank", "lo", "hi")))
    listed = bands.groupBy("anchor_rid").agg(by_rank.alias("b")).select(
        F.col("anchor_rid").alias("rid"),
        F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.coalesce(F.get(F.col("b.lo"), i - 1), top)).alias("lows"),
        F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.coalesce(F.get(F.col("b.hi"), i - 1), bottom)).alias("highs"))
    banded = chosen.join(listed.hint("merge"), "rid").select("rid", "id", "label", "vector", "part", "lows", "highs")
    asked = common.staged(
        banded.groupBy("part").applyInArrow(together, f"{BLOCK}, part int, lows array<long>, highs array<long>"), "anchors", 1)
    far = _first(search(asked, negatives, False), negatives, "anchor_rid", "place")
    known = near.select("anchor_rid", (F.col("rank") - 1).alias("place"), F.col("other_id").alias("positive_id"),
                        score.alias("positive_score"))
    return far.join(known.hint("merge"), ["anchor_rid", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
