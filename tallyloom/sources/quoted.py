"""Statement files whose quoted cells hold line breaks, each read by many tasks.

Whether a line begins inside a quoted cell depends on all lines before it. Here every line says how it ends if it begins
outside a quoted cell, and how if it begins inside one. Such answers can be chained, so every block of a file is summed up by
itself, the short sums are chained file by file, and then each block knows how it begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec, functions as F

from tallyloom.sources.files import physical_lines

_QUOTED = r'"[^"]*+(?:""[^"]*+)*+'
_CELL = rf'{_QUOTED}"[^,]*+|[^",][^,]*+|'
#: Whole cells, then one whose quote stays open; possessive, so that long lines cost neither time nor stack.
_OPEN = rf'^(?:(?:{_CELL}),)*+{_QUOTED}\z'
_CELLS = rf',({_QUOTED}"?+[^,]*+|[^",][^,]*+|)'


def _chained(rows: DataFrame, order: WindowSpec, out: Column, into: Column) -> DataFrame:
    """``after_out`` and ``after_in``: the state after each row if the first row begins outside, or inside, a quoted cell.

    ``out`` and ``into`` say whether a row that begins outside, or inside, ends inside. A row where both agree fixes
    the state whatever was before; behind the last such row only the number of rows that swap the state matters.
    """
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    swaps = rows.withColumn("__swaps", F.sum((out & ~into).cast("long")).over(so_far))
    fixed = F.last(F.when(out == into, out), ignorenulls=True).over(so_far)
    at_fixed = F.last(F.when(out == into, F.col("__swaps")), ignorenulls=True).over(so_far)
    known = swaps.withColumns({"__fixed": fixed, "__odd": (F.col("__swaps") - F.coalesce(at_fixed, F.lit(0))) % 2 == 1})
    return known.withColumns({
        "after_out": F.coalesce("__fixed", F.lit(False)) != F.col("__odd"),
        "after_in": F.coalesce("__fixed", F.lit(True)) != F.col("__odd"),
    }).drop("__swaps", "__fixed", "__odd")


def _in_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all files with their states before and after, for either way their block may begin."""
    lines = physical_lines(spark, path)
    marked = F.contains("line", F.lit('"'))
    lines = lines.withColumns({
        "out": marked & F.col("line").rlike(_OPEN), "into": ~marked | F.concat(F.lit('"'), "line").rlike(_OPEN)})
    order = Window.partitionBy("file", "block").orderBy("line_no")
    states = _chained(lines, order, F.col("out"), F.col("into")).drop("out", "into")
    return states.withColumns({
        "before_out": F.lag("after_out", 1, False).over(order), "before_in": F.lag("after_in", 1, True).over(order)})


def _block_starts(states: DataFrame) -> DataFrame:
    """(file, block, inside, open, unclosed): whether a block begins inside a quoted cell, the line with which the record
    begun before it starts, and the line that starts a record of the file which never ends. One row a block."""
    blocks = states.groupBy("file", "block").agg(
        F.max_by("after_out", "line_no").alias("out"), F.max_by("after_in", "line_no").alias("into"),
        F.max(F.when(~F.col("before_out"), F.col("line_no"))).alias("start_out"),
        F.max(F.when(~F.col("before_in"), F.col("line_no"))).alias("start_in"))
    order = Window.partitionBy("file").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = _chained(blocks, order, F.col("out"), F.col("into")).withColumn("inside", F.lag("after_out", 1, False).over(order))
    known = known.withColumn("start", F.when(F.col("inside"), F.col("start_in")).otherwise(F.col("start_out")))
    last_start = F.last("start", ignorenulls=True)
    return known.select(
        "file", "block", "inside", last_start.over(earlier).alias("open"),
        F.when(F.last("after_out").over(whole), last_start.over(whole)).alias("unclosed"))


def split_record(record: Column) -> Column:
    """The cells of a record. A cell is quoted if a quote is its first character; quotes elsewhere stand for themselves."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_CELLS), F.lit(1))
    return F.transform(cells, lambda c: F.when(
        c.rlike(rf'^{_QUOTED}"\z'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, fields): the records of all comma-separated files under a path, in the order of ``line_no``.

    A line break inside a quoted cell becomes a blank. A file may be of any size and a record of any number of cells; a record is
    put together in one task, across blocks too. A quote that never closes makes no record: its line and all lines behind it
    stay lines. Empty lines are left out.
    """
    states = _in_blocks(spark, path)
    so_far = Window.partitionBy("file", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = states.join(_block_starts(states), ["file", "block"]).withColumns({
        f"{when}": F.when(F.col("inside"), F.col(f"{when}_in")).otherwise(F.col(f"{when}_out")) for when in ("before", "after")})
    lines = lines.withColumn("first", F.coalesce(
        F.last(F.when(~F.col("before"), F.col("line_no")), ignorenulls=True).over(so_far), "open"))
    part = (F.col("before") | F.col("after")) & ~F.col("first").eqNullSafe(F.col("unclosed"))
    key = F.when(part, F.col("first")).otherwise(F.col("line_no")).alias("key")
    # Lines meet where their block is already; only what crosses the edge of a block moves on.
    pieces = lines.groupBy("file", "block", key).agg(
        F.collect_list(F.struct("line_no", "line")).alias("lines"),
        (F.bool_or(~part | ~F.col("before")) & F.bool_or(~part | ~F.col("after"))).alias("whole"))
    pieces = pieces.withColumn("line", F.array_join(F.array_sort("lines")["line"], " "))
    crossing = pieces.where(~F.col("whole")).groupBy("file", "key").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("block", "line")))["line"], " ").alias("line"))
    found = pieces.where("whole").select("file", "key", "line").union(crossing)
    return found.where(F.col("line") != "").select("file", F.col("key").alias("line_no"), split_record(F.col("line")).alias("fields"))


def statement_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line): records as lines with every cell quoted, for the operators on statements."""
    def again(cell: Column) -> Column:
        return F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))
    return records(spark, path).select("file", "line_no", F.array_join(F.transform("fields", again), ",").alias("line"))
