"""Exact "text contains key" join without comparing every text with every key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.operators.joins import meet


#: Characters of a needle's anchor.
ANCHOR = 8

#: Patterns of digits and letters by which needles are looked up whole.
SHAPES = 16


def _pieces(text: Column, size: Column) -> Column:
    """Distinct substrings of one size; none if the text is shorter."""
    starts = F.when(size <= F.length(text), F.sequence(F.lit(1), F.length(text) - size + 1))
    return F.array_distinct(F.transform(starts, lambda start: F.substr(text, start, size)))


def _anchored(keys: DataFrame, size: int) -> DataFrame:
    """(kind, needle, piece): the needle's substring of the given size that the fewest needles have; all of a shorter one."""
    pieces = keys.select("needle").distinct().where(F.length("needle") >= size).select(
        "needle", F.explode(_pieces(F.col("needle"), F.lit(size))).alias("piece"))
    popularity = pieces.groupBy("piece").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("needle").orderBy("n", "piece"))
    anchors = meet(pieces, popularity, "piece").withColumn("place", place).where("place = 1").select("needle", "piece")
    short = keys.where(F.length("needle") < size).select("kind", "needle", F.col("needle").alias("piece"))
    return short.unionByName(meet(keys, anchors, "needle").select("kind", "needle", "piece"))


def _shape(text: Column) -> Column:
    """The text's pattern: every digit as 0, every letter from a to z as a, of the same length."""
    return F.translate(text, "123456789bcdefghijklmnopqrstuvwxyz", "0" * 9 + "a" * 25)


def frequent_shapes(keys: DataFrame) -> list[str]:
    """The patterns that the most needles have, at most ``SHAPES``."""
    ranked = keys.groupBy(_shape(F.col("needle")).alias("shape")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "shape")
    return [r["shape"] for r in ranked.limit(SHAPES).collect()]


def pieces(whole: DataFrame, shapes: list[str]) -> DataFrame:
    """(text, piece): the distinct substrings of each text that have one of the patterns."""
    by_size: dict[int, list[str]] = {}
    for shape in shapes:
        by_size.setdefault(len(shape), []).append(shape)

    def found(size: int, patterns: list[str]) -> Column:
        starts = F.when(F.length("text") >= size, F.sequence(F.lit(1), F.length("text") - size + 1))
        fitting = F.filter(starts, lambda at: F.substr("shape", at, F.lit(size)).isin(patterns))
        return F.array_distinct(F.transform(fitting, lambda at: F.substr("text", at, F.lit(size))))
    if not by_size:
        return whole.select("text", F.col("text").alias("piece")).limit(0)
    none = F.array().cast("array<string>")
    every = F.flatten(F.array(*[F.coalesce(found(size, patterns), none) for size, patterns in by_size.items()]))
    return whole.withColumn("shape", _shape(F.col("text"))).select("text", F.explode(every).alias("piece"))


def two_numbers(value: Column, prefix: str) -> list[Column]:
    """A text as two numbers, which are moved, sorted and compared faster."""
    return [F.xxhash64(value).alias(f"{prefix}1"), F.xxhash64(F.lit(1), value).alias(f"{prefix}2")]


def held_pieces(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """(t1, t2, p1, p2): each distinct text and pieces of it, as two numbers each; every needle that a text holds is among its pieces.

    ``texts``: one column ``text``; ``needles``: one column ``needle``. So a join with needles by their two numbers finds what texts hold,
    and no text is moved for it. Needles of other than the most frequent patterns are found by :func:`find_needles`.
    """
    whole = texts.select("text").where(F.length("text") > 0).distinct()
    shapes = frequent_shapes(needles.where(F.length("needle") > 0))
    held = pieces(whole, shapes).select(*two_numbers(F.col("text"), "t"), *two_numbers(F.col("piece"), "p"))
    if len(shapes) < SHAPES:
        return held
    rest = needles.where(~_shape(F.col("needle")).isin(shapes)).select(F.lit("").alias("kind"), "needle")
    return held.unionByName(find_needles(whole, rest).select(*two_numbers(F.col("text"), "t"), *two_numbers(F.col("needle"), "p")))


def find_needles(texts: DataFrame, needles: DataFrame, size: int = ANCHOR) -> DataFrame:
    """Pairs (text, kind, needle) where the needle occurs anywhere in the text.

    ``texts``: one column ``text``; ``needles``: ``kind``, ``needle`` (non-empty). Needles of the most frequent patterns of digits and
    letters are looked up whole, at the places of a text that have the pattern: numbers of one form cost a text a row or two. These
    patterns, at most ``SHAPES``, pass through the driver. Every other needle is looked up by one anchor, its rarest substring of
    ``size`` characters; only for those, texts are cut into pieces of that size (and of the sizes of shorter needles), so a text
    costs about its length in rows, however long the needles are. Pieces meet needles and anchors in an equi-join, and what meets is
    compared in full. Whole texts are cut.
    """
    keys = needles.select("kind", "needle").where(F.length("needle") > 0).distinct()
    whole = texts.select("text").where(F.length("text") > 0).distinct()
    shapes = frequent_shapes(needles.select("needle").where(F.length("needle") > 0))
    cut, anchored = pieces(whole, shapes), keys.withColumn("piece", F.col("needle"))
    if len(shapes) == SHAPES:
        listed = _shape(F.col("needle")).isin(shapes)
        rest = keys.where(~listed)
        # A one-row scalar subquery with at most ``size`` numbers.
        sizes = rest.select(F.least(F.length("needle"), F.lit(size)).alias("n")).agg(F.array_sort(F.collect_set("n"))).scalar()
        cut = cut.unionByName(whole.withColumn("n", F.explode(sizes)).select("text", F.explode(_pieces(F.col("text"), F.col("n"))).alias("piece")))
        anchored = anchored.where(listed).unionByName(_anchored(rest, size))
    # Only hashes of texts and pieces are shuffled; what meets is looked up and compared in full, so a clash costs nothing else.
    cut = cut.select(F.xxhash64("text").alias("h"), F.xxhash64("piece").alias("piece"))
    met = meet(cut, anchored.withColumn("piece", F.xxhash64("piece")), "piece").select("h", "kind", "needle").distinct()
    return meet(met, whole.withColumn("h", F.xxhash64("text")), "h").where(F.contains("text", "needle")).select("text", "kind", "needle")
