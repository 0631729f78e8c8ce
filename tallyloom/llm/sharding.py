"""Histogram sort: exact byte counts below probed key boundaries, refined until every splitter fits, then one exchange."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.llm import common

#: Key columns hold whole numbers from 0 to TOP.
TOP = 2**62 - 1
KEYS = ("__k1", "__k2", "__k3")
#: Counts that one round of probing brings to the driver; pieces of all shards together; bytes of a piece, at least and at most.
MAX_COUNTS, MAX_PIECES = 1 << 17, 1 << 14
SMALL_PIECE, LARGE_PIECE = 1 << 18, 1 << 28


@dataclass(frozen=True)
class Interval:
    """Keys that share ``prefix`` and go on with ``low`` to ``high``; ``below`` bytes lie before them."""

    prefix: tuple[int, ...]
    low: int
    high: int
    below: int


def _numbers(values: Sequence[int]) -> Column:
    """A constant array of longs, as one literal however many there are."""
    return F.split(F.lit(" ".join(map(str, values))), " ").cast("array<long>")


def _reached(keys: Sequence[str], bounds: Sequence[tuple[int, ...]]) -> Column:
    """How many of the rising ``bounds`` lie at or below the row's key, by binary search in constant arrays."""
    if not bounds:
        return F.lit(0)
    columns = [_numbers([b[i] for b in bounds]) for i in range(len(keys))]
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]

    def step(found: Column, width: Column) -> Column:
        at = (found + width - 1).cast("int")
        fits = F.col(keys[-1]) >= F.get(columns[-1], at)
        for name, column in reversed(list(zip(keys[:-1], columns[:-1]))):
            bound = F.get(column, at)
            fits = (F.col(name) > bound) | ((F.col(name) == bound) & fits)
        return F.when(fits, found + width).otherwise(found)  # behind the last bound the test is null

    return F.aggregate(_numbers(steps), F.lit(0).cast("long"), step).cast("int")


def _histogram(table: DataFrame, keys: Sequence[str], weight: str, intervals: list[Interval], probes: int):
    """Exact weight and rows in each of ``probes`` equal key ranges of each interval: one aggregation, probes rows an interval.

    The intervals share no key and come in rising order, so a row's interval is found by binary search.
    """
    pad = lambda iv, last, rest: (*iv.prefix, last, *[rest] * (len(keys) - len(iv.prefix) - 1))
    ends = [pad(iv, iv.high, TOP) for iv in intervals]
    i = F.col("__i")
    depth = F.get(_numbers([len(iv.prefix) for iv in intervals]), i)
    at = F.coalesce(*[F.when(depth == n, F.col(k)) for n, k in enumerate(keys)])
    low = F.get(_numbers([iv.low for iv in intervals]), i)
    width = F.get(_numbers([-(-(iv.high - iv.low + 1) // probes) for iv in intervals]), i)
    inside = F.col(keys[-1]) <= F.get(_numbers([e[-1] for e in ends]), i)
    for n in reversed(range(len(keys) - 1)):
        end = F.get(_numbers([e[n] for e in ends]), i)
        inside = (F.col(keys[n]) < end) | ((F.col(keys[n]) == end) & inside)
    rows = (
        table.select(*keys, F.col(weight).alias("w"), (_reached(keys, [pad(iv, iv.low, 0) for iv in intervals]) - 1).alias("__i"))
        .where((i >= 0) & inside)
        .select("w", i.alias("i"), (at - low).alias("__d"), width.alias("__s"))
        .groupBy("i", F.expr("__d div __s").alias("b")).agg(F.sum("w").alias("w"), F.count("*").alias("n")).collect()
    )
    found: list[list[tuple[int, int, int]]] = [[] for _ in intervals]
    for r in rows:
        found[r.i].append((r.b, r.w, r.n))
    return [sorted(x) for x in found]


def find_splitters(table: DataFrame, keys: Sequence[str], weight: str, targets: Sequence[tuple[int, int]],
                   probes: int = 256) -> list[tuple[int, ...]]:
    """The key boundaries below which ``weight`` adds up to each target, within its tolerance.

    ``targets``: rising (weight, tolerance) pairs. Each round counts every open interval exactly and keeps, for each
    target, the one range of keys that holds it. A range of one key value goes on with the next key column; where a range
    holds a single row, or the last column ends, the nearer side is taken. A round brings at most MAX_COUNTS
    counts to the driver: the more intervals are open, the fewer ranges each is cut into.
    """
    open_at = {t: Interval((), 0, TOP, 0) for t in range(len(targets))}
    done: dict[int, tuple[int, ...]] = {}
    pad = lambda key: (*key, *[0] * (len(keys) - len(key)))
    while open_at:
        place = {iv: n for n, iv in enumerate(sorted(set(open_at.values()), key=lambda iv: (*iv.prefix, iv.low)))}
        wide = max(2, min(MAX_COUNTS, probes * len(open_at)) // len(place))
        counts = _histogram(table, keys, weight, list(place), wide)
        for t, iv in list(open_at.items()):
            goal, tolerance = targets[t]
            step = -(-(iv.high - iv.low + 1) // wide)
            before, at = iv.below, iv.low
            chosen = None
            for b, w, n in counts[place[iv]]:
                if before + w >= goal:
                    chosen = (b, before, before + w, n)
                    break
                before, at = before + w, iv.low + (b + 1) * step
            if chosen is None:
                done[t] = pad((*iv.prefix, at))
                del open_at[t]
                continue
            b, left, right, rows = chosen
            low = iv.low + b * step
            near = (left, (*iv.prefix, low)) if goal - left <= right - goal else (right, (*iv.prefix, low + step))
            last = rows == 1 or step == 1 and len(iv.prefix) + 1 == len(keys)
            if abs(near[0] - goal) <= tolerance or last:
                done[t] = pad(near[1])
                del open_at[t]
            elif step == 1:
                open_at[t] = Interval((*iv.prefix, low), 0, TOP, left)
            else:
                open_at[t] = Interval(iv.prefix, low, min(low + step - 1, iv.high), left)
    rising, most = [], pad((0,))
    for t in range(len(targets)):
        most = max(most, done[t])
        rising.append(most)
    return rising


def shard(docs: DataFrame, shards: int = 16, tolerance: float = 0.001, *, text: str = "text", key: str = "doc_id",
          probes: int = 256) -> DataFrame:
    """``docs`` with ``size``, ``shard`` and ``slot``, in shards of nearly equal bytes (law ``bytes``).

    Size is the UTF-8 length of the text plus 1. Rows are ordered by a hash of the text, a hash of ``key`` and a row
    number, so that equal texts lie side by side and a group with a third of all rows is still cut at the right byte. Each
    shard is cut into pieces by further splitters, so that no task sorts a whole shard: as many as there are shuffle
    partitions, but of 256 KB to 256 MB each where MAX_PIECES allows it. ``slot`` counts from 0 without gaps within a shard. A shard's bytes miss the mean by ``tolerance`` of it or, if that is more, by about one
    document.

    The rows are staged once with their row number, as splitters and the exchange must see the same keys; probing reads
    the four narrow columns of that copy. The texts are exchanged once.

    Null texts have size 1 and sort with empty ones; null keys are a value like any other. Repeated rows are all kept and
    may lie in different shards. An empty table gives no rows. Input columns named size, shard or slot are replaced.
    """
    spark = docs.sparkSession
    docs = common.without(docs, "size", "shard", "slot")
    body = F.col(f"`{text}`")
    ready = (
        docs.withColumn("size", F.coalesce(F.octet_length(body), F.lit(0)).cast("long") + 1)
        .withColumn("__k1", F.shiftrightunsigned(common.text_hash(body), 2))
        .withColumn("__k2", F.shiftrightunsigned(F.xxhash64(F.col(f"`{key}`")), 2))
    )
    table = common.numbered(ready, "shard", label="__k3")
    total = table.agg(F.sum("size")).first()[0]
    if total is None:
        return table.drop(*KEYS).withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    wanted = min(max(common.partitions(spark), total // LARGE_PIECE), total // SMALL_PIECE, MAX_PIECES)
    per = max(1, -(-wanted // shards))
    fine = shards * per
    targets = [
        (total * i // fine, int(total / shards * tolerance) if i % per == 0 else total // fine // 10) for i in range(1, fine)
    ]
    splitters = find_splitters(table, KEYS, "size", targets, probes)
    piece = _reached(KEYS, splitters)
    counted = {r.piece: r["count"] for r in table.select(piece.alias("piece")).groupBy("piece").count().collect()}
    starts, at = [], 0
    for i in range(fine):
        at = 0 if i % per == 0 else at
        starts.append(at)
        at += counted.get(i, 0)
    inside = F.row_number().over(Window.partitionBy("__piece").orderBy(*KEYS))
    start = F.get(_numbers(starts), F.col("__piece"))
    return (
        table.withColumn("__piece", piece)
        .withColumn("slot", start + inside - 1)
        .withColumn("shard", F.expr(f"cast(__piece div {per} as int)"))
        .drop("__piece", *KEYS)
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder of Parquet files for each shard."""
    sharded.write.mode("overwrite").partitionBy("shard").parquet(path)
