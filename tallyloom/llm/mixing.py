"""Mixing sources to target weights with the cube method: balanced sampling of documents and their words."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.llm import common

#: Documents of one flight; also the most that Spark gives one Python call at a time.
BLOCK_ROWS = 4096
#: Words take part in the balance as whole numbers, as do documents.
BALANCED = 2
#: Documents that are left to the landing besides those that the flight leaves open.
RESERVE = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``sources`` (__source, words, docs) with ``target``, and the times a document is taken: ``__whole`` and ``__share``.

    Sources are weighted in code point order, null last. Each gets a share of all words by its weight, at most ``most``
    times its own words; what lies above that is shared again by weight among the others, until none is above.

    The words left for each unit of weight only rise from round to round, so they alone tell which sources are at their
    limit: a round is one aggregate, whatever the number of sources. Counts are whole numbers, so limits are exact.
    """
    ordered = _numbered_in_order(sources)
    weight = F.get(F.array(*[F.lit(w).cast("long") for w in weights]), F.pmod("__no", F.lit(len(weights))).cast("int"))
    limit = F.col("words") * most
    table = common.staged(ordered.withColumn("__weight", weight).drop("__no"), "sources")
    exact = lambda c: c.cast("decimal(19,0)")
    left, total, before = 0, 0, None
    while before != (left, total):
        before = (left, total)
        above = exact(F.lit(left)) * exact(F.col("__weight")) > exact(limit) * exact(F.lit(total)) if total else F.lit(False)
        row = table.agg(F.sum("words").alias("all"), F.sum(F.when(above, limit)).alias("limited"),
                        F.sum(F.when(~above, F.col("__weight"))).alias("weights")).first()
        left, total = (row["all"] or 0) - (row["limited"] or 0), row["weights"] or 0
    limited = exact(F.lit(left)) * exact(F.col("__weight")) > exact(limit) * exact(F.lit(total)) if total else F.lit(True)
    shared = table.withColumns({
        "__limited": limited,
        "__due": exact(F.lit(left)) * exact(F.col("__weight")),  # in units of 1 / total, as is the next
        "__unit": exact(F.col("words")) * exact(F.lit(max(1, total))),
    }).withColumn("__whole", F.when(F.col("words") == 0, 0).when(F.col("__limited"), most).otherwise(
        F.expr("__due div nullif(__unit, 0)")).cast("int"))
    rest = (F.col("__due") - exact(F.col("__whole")) * F.col("__unit")).cast("double") / F.col("__unit").cast("double")
    return shared.select(
        "__source", "words", "docs", "__whole", F.when((F.col("words") > 0) & ~F.col("__limited"), rest).otherwise(0.0).alias("__share"),
        F.when(F.col("__limited"), limit.cast("double")).otherwise(F.col("__due").cast("double") / float(max(1, total))).alias("target"))


def _numbered_in_order(sources: DataFrame) -> DataFrame:
    """``sources`` with their place ``__no`` in code point order, null last: numbered inside ranges, which are counted first."""
    empty_last = F.col("__source").isNull()
    placed = common.staged(
        sources.repartitionByRange(empty_last, F.col("__source")).withColumn("__part", F.spark_partition_id()), "sources")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(empty_last, "__source"))
    return placed.withColumn("__at", inside).join(starts, "__part").withColumn(
        "__no", F.col("__start") + F.col("__at") - 1).drop("__part", "__at", "__start")


def flight(chance: np.ndarray, size: np.ndarray, luck: np.ndarray) -> np.ndarray:
    """Moves inclusion chances to 0 or 1 until at most two stay between, keeping their sum and their words.

    Three open documents at a time move along the null space of (1, size): one direction, both ways up to the first
    bound, chosen by the luck of the latest of the three so that every chance keeps its expectation.
    """
    p = chance.astype(float).tolist()
    sizes = size.tolist()
    edge = 1e-9
    active: list[int] = []
    for i in range(len(p)):
        if edge < p[i] < 1 - edge:
            active.append(i)
        else:
            p[i] = float(round(p[i]))
        while len(active) == BALANCED + 1:
            a, b, c = active
            x, y, z = sizes[a], sizes[b], sizes[c]
            move = (z - y, x - z, y - x)
            if not any(move):
                move = (1, -1, 0)
            up = min(((1 - p[k]) / m if m > 0 else p[k] / -m) for k, m in zip(active, move) if m)
            down = min((p[k] / m if m > 0 else (1 - p[k]) / -m) for k, m in zip(active, move) if m)
            way = up if luck[c] * (up + down) < down else -down
            for k, m in zip(active, move):
                p[k] += way * m
                if p[k] < edge or p[k] > 1 - edge:
                    p[k] = float(round(p[k]))
            still = [k for k in active if 0 < p[k] < 1]
            if len(still) == len(active):  # rounding left all three open
                k = min(active, key=lambda k: min(p[k], 1 - p[k]))
                p[k] = float(round(p[k]))
                still.remove(k)
            active = still
    return np.array(p)


def reserve(chance: np.ndarray, size: np.ndarray, most: int = RESERVE) -> np.ndarray:
    """Places of at most ``most`` open documents, each about half as long as the one before, from half the longest on."""
    free = [i for i in np.argsort(-size, kind="stable").tolist() if 0 < chance[i] < 1 and size[i] > 0]
    out: list[int] = []
    due = size[free[0]] / 2 if free else 0
    for i in free[1:]:
        if size[i] <= due and len(out) < most:
            out.append(i)
            due = size[i] / 2
    return np.array(out, np.int64)


def landing(chance: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decides the few chances that are still open: nearest to the words and the documents that are due, a document
    counting as many words as the mean of the open ones."""
    p = chance.copy()
    open_at = np.flatnonzero((p > 0) & (p < 1))
    if not len(open_at):
        return p
    choices = (np.arange(2 ** len(open_at))[:, None] >> np.arange(len(open_at))) & 1
    words = np.abs(choices @ size[open_at] - float((p[open_at] * size[open_at]).sum()))
    docs = np.abs(choices.sum(axis=1) - float(p[open_at].sum()))
    p[open_at] = choices[np.argmin(words / max(float(size[open_at].mean()), 1.0) + docs)]
    return p


def settle(chance: np.ndarray, size: np.ndarray, luck: np.ndarray, last: bool = True) -> np.ndarray:
    """The flight of a block and, in a source's last one, the landing.

    Long documents are the last to be decided and would miss the words due by half their length. So some documents of
    falling length stay out of the flight: they go on to the next round, and are landed in the end.
    """
    kept = reserve(chance, size, RESERVE if last else min(RESERVE, len(chance) // 8))
    rest = np.setdiff1d(np.arange(len(chance)), kept)
    out = chance.astype(float).copy()
    out[rest] = flight(chance[rest], size[rest], luck[rest])
    return landing(out, size) if last else out


def _luck(keys: np.ndarray, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(int(k).to_bytes(8, "little", signed=True), seed) / 2**64 for k in keys])


def _flown(seed: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["__size", "__key", "__rid"], kind="stable")
        size = block["__size"].to_numpy()
        luck = _luck(block["__key"].to_numpy(), seed)
        return block.assign(__chance=settle(block["__chance"].to_numpy(), size, luck, bool(block["__last"].iloc[0])))
    return run


def _round(table: DataFrame, round_no: int, seed: int) -> DataFrame:
    """One flight in every block. Blocks of a source are chosen by the hash of the document.

    ``__blocks`` is the number of blocks of the source; with one block left, the landing follows at once. Documents that
    repeat as a whole share their hash, so a block that came out too large is dealt again by row number.
    """
    lot = F.when(F.col("__blocks") > 1, F.pmod(F.xxhash64("__key", F.lit(round_no)), "__blocks")).otherwise(F.lit(0)).cast("long")
    dealt = table.withColumn("__lot", lot)
    full = dealt.where("__blocks > 1").groupBy("__source", "__lot").count().where(F.col("count") > 2 * BLOCK_ROWS).select(
        F.col("__source").alias("s"), F.col("__lot").alias("l"), F.ceil(F.col("count") / BLOCK_ROWS).cast("long").alias("__cuts"))
    cut = F.coalesce(F.pmod(F.xxhash64("__rid", F.lit(round_no)), "__cuts"), F.lit(0)).cast("long")
    blocks = dealt.join(full, dealt["__source"].eqNullSafe(full["s"]) & (dealt["__lot"] == full["l"]), "left").withColumn(
        "__cut", cut).withColumn("__last", F.col("__blocks") == 1).drop("s", "l", "__cuts")
    flown = blocks.groupBy("__source", "__lot", "__cut").applyInPandas(_flown(seed + round_no), blocks.schema)
    return common.staged(flown.drop("__lot", "__cut", "__last", "__blocks"), "flight")


def mix(docs: DataFrame, *, text: str = "text", source: str = "source", key: str = "doc_id",
        weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 7, carry: list[str] | None = None) -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target``, ``copies`` and ``taken`` (words times copies).

    Every document of a source is taken the same whole number of times, and once more with the fraction that is
    left. The cube method settles that fraction within each source: flights in blocks of bounded size, again among what they
    leave open, until one block with a small landing problem remains. Words and documents of a source stay at their
    expectation up to about one document. The order comes from hashes of the documents, so reruns agree.

    ``carry``: the input columns to keep (all by default). Null texts have no words; a null source is a source of its own,
    weighted last; null keys are a value like any other. Repeated rows are separate documents, of which it does
    not matter which is taken. An empty table gives no rows. Input columns named like an output column are replaced.
    """
    known = common.without(docs, *[c for c in ("size", "source_size", "target", "copies", "taken") if c not in (text, source, key)])
    kept = [c for c in known.columns if carry is None or c in carry]
    ready = known.select(
        *[F.col(f"`{c}`") for c in kept], F.col(f"`{source}`").cast("string").alias("__source"),
        word_count(F.col(f"`{text}`")).alias("__size"),
        F.xxhash64(F.col(f"`{key}`"), F.col(f"`{source}`"), F.col(f"`{text}`")).alias("__key"))
    table = common.numbered(ready, "mixing")
    totals = table.groupBy("__source").agg(F.sum("__size").alias("words"), F.count("*").alias("docs"))
    sources = common.staged(targets(totals, weights, most), "targets").select(
        F.col("__source").alias("s"), F.col("words").alias("source_size"), "target", "__whole", "__share",
        F.col("docs").alias("__docs"))
    named = table.join(sources, table["__source"].eqNullSafe(sources["s"])).drop("s")
    narrow = named.where("__share > 0").select(
        "__rid", "__source", "__size", "__key", F.col("__share").alias("__chance"),
        F.ceil(F.col("__docs") / BLOCK_ROWS).cast("long").alias("__blocks"))
    settled: DataFrame | None = None
    open_docs, round_no = narrow, 0
    while True:
        flown = _round(open_docs, round_no, seed)
        decided = flown.where("__chance = 1").select("__rid", F.lit(1).alias("__more"))
        settled = decided if settled is None else settled.union(decided)
        rest = flown.where("__chance > 0 and __chance < 1")
        counts = rest.groupBy("__source").count().select(
            F.col("__source").alias("s"), F.ceil(F.col("count") / BLOCK_ROWS).cast("long").alias("__blocks"))
        if not counts.limit(1).count():
            break
        open_docs = rest.join(counts, rest["__source"].eqNullSafe(counts["s"])).drop("s")
        round_no += 1
    # What was settled grows with the documents: one plan at every size, no broadcast of it.
    mixed = named.join(settled.hint("merge"), "__rid", "left")
    copies = (F.col("__whole") + F.coalesce("__more", F.lit(0))).cast("int")
    return mixed.select(
        *[f"`{c}`" for c in kept], F.col("__size").alias("size"), "source_size", "target", copies.alias("copies"),
        (F.col("__size") * copies).alias("taken"))


def materialise(docs: DataFrame, *, text: str = "text", source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """The mix itself: every document as often as :func:`mix` takes it, with the columns of ``docs``.

    See :func:`mix` for nulls, repeated rows and empty tables. Further columns keep their values, whatever their names.
    """
    known, names = common.hidden(docs, text, source, key)
    mixed = mix(known, text=text, source=source, key=key, **options)
    repeated = mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return common.shown(repeated, names)
