"""Numbers and ranks over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.session import durable


def number_rows(df: DataFrame, *order: str, name: str = "row_number", start: Column | None = None) -> DataFrame:
    """Adds 1, 2, 3 … in the given order (which must be unique), after an optional start value.

    Rows are range-partitioned by the order, sorted and numbered inside each partition while they are written, and counted per
    partition; only the partition counts meet in one place. The rows are computed twice, to find the ranges and to be dealt.
    """
    # The number of a row as Spark gives it: the partition, and 33 bits for the place in it.
    placed = durable(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumns({"_part": F.shiftright("_id", 33), "_inside": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1}).drop("_id")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    begin = F.lit(0).cast("long") if start is None else start
    return placed.join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_inside") + begin).drop("_part", "_inside", "_before")


def kth_smallest(rows: DataFrame, column: str, k: int, bins: int = 1024) -> int | None:
    """The k-th smallest (from 1) value of a whole-number column; none if there are fewer values.

    Values are counted in ``bins`` equal ranges, then again inside the range that holds the k-th, until the range is one value.
    Each round is one aggregate of at most ``bins`` rows; nothing is sorted.
    """
    value = F.col(column).cast("long")
    low, high, n = rows.agg(F.min(value), F.max(value), F.count(value)).first()
    if not 1 <= k <= n:
        return None
    while low < high:
        width = (high - low) // bins + 1
        place = F.expr(f"(cast(`{column}` as long) - {low}L) div {width}L")
        counts = rows.where(value.between(low, high)).groupBy(place.alias("place")).agg(F.count("*").alias("n"))
        for at, n in sorted(tuple(r) for r in counts.collect()):
            if k <= n:
                break
            k -= n
        low, high = low + at * width, min(high, low + (at + 1) * width - 1)
    return low
