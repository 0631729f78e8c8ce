"""One sorted pass that finds the best invoice for every question of the matching.

Invoices (as points: group, day, amount) and questions are dealt by group, amount block and day block, sorted inside a
partition with the points of a block first, and read once. A point goes to every block in which a question could want
it, so a question is answered in one block. Inside a block nothing is paired: a question looks up, on each of the days
it reaches, the nearest amount on either side by binary search, and, at any date, the latest day in its best amount
ranges and the nearest amounts beyond them.

Groups have modes. A small group is one block, in which its questions are answered at any date. Large groups are dealt by day, those in
which only an amount within the tolerance can win by amount too; there a question is asked at any date only if its
answer from the days around it is not better than any answer without date points: few are, where invoices lie dense.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.operators.joins import meet
from tallyloom.session import durable

NO_DAY = -9_999_999
#: Days of a block; amount blocks for each factor e; the day blocks of what is asked for at any date, and of small groups.
DAY_BLOCK, PER_E, ANY_DATE, SMALL_GROUP = 256, 2.0, -(2**31), 2**31 - 1
#: Modes of a group: one block; dealt by day; dealt by day and amount.
SMALL, DATED, BANDED = 0, 1, 2
#: Rows that are answered together; blocks are never parted.
CHUNK = 1 << 18
GROUP = ["is_income", "g1", "g2"]
ASKED = [*GROUP, "is_debit", "t", "day", "name_points", "number_points"]
QUESTION = ["rid", *ASKED, "mode"]
ANSWER = "rid long, score double, inv_day int, nearness long, neg_id long, open boolean, is_income boolean, g1 long, g2 long, " \
    "is_debit boolean, t long, day int, name_points double, number_points double, mode int"
#: Points of the best amount tier.
MOST_FOR_AMOUNT = 0.55


@dataclass(frozen=True)
class Rule:
    days: int
    amount: float
    threshold: float

    @property
    def span(self) -> int:
        return max(14, self.days)

    def bounds(self, t: np.ndarray, debit: np.ndarray) -> dict[str, np.ndarray]:
        """As the column rule: the inclusive range of the invoice amount for each tier."""
        def down(value: np.ndarray, num: int, den: int) -> np.ndarray:
            return value // den * num + value % den * num // den

        def up(num: int, den: int) -> np.ndarray:
            return -down(-t, num, den)
        wide = round(self.amount * 10_000)
        credit_low = up(100, 102)
        return {"exact_lo": np.where(debit, up(1000, 1005), credit_low), "exact_hi": down(t, 1000, 995),
                "close_lo": np.where(debit, up(100, 105), credit_low), "close_hi": down(t, 100, 95),
                "approx_lo": np.where(debit, np.maximum(up(100, 110), up(10_000, 10_000 + wide)), credit_low),
                "approx_hi": down(t, 10_000, 10_000 - wide)}

    def date_points(self, distance: np.ndarray) -> np.ndarray:
        """As the column rule: by the distance in days."""
        return np.select([distance == 0, distance <= 3, distance <= 7, distance <= 14, distance <= self.days],
                         [0.20, 0.18, 0.15, 0.10, 0.05], 0.0)

    def amount_points(self, c: np.ndarray, q: dict[str, np.ndarray]) -> np.ndarray:
        """As the column rule: by the tier that the amount ``c`` lies in."""
        away = np.abs(c - q["x"]).astype(float) / c.astype(float)
        decay = 0.45 - ((away - 0.05) / (self.amount - 0.05)) * 0.25 if self.amount > 0.05 else np.zeros(len(c))
        inside = [(c >= q[f"{tier}_lo"]) & (c <= q[f"{tier}_hi"]) for tier in ("exact", "close", "approx")]
        return np.select(inside, [np.full(len(c), 0.55), np.full(len(c), 0.50), decay], 0.0)


class Slots:
    """Points sorted by (slot, amount): where amounts lie among the points of one slot."""

    def __init__(self, slot: np.ndarray, amount: np.ndarray) -> None:
        self.order = np.lexsort((amount, slot))
        self.values = np.unique(amount)
        self.names, self.start = np.unique(slot[self.order], return_index=True)
        self.end = np.append(self.start[1:], len(slot))
        places = np.repeat(np.arange(len(self.names)), self.end - self.start)
        self.keys = places * (len(self.values) + 1) + np.searchsorted(self.values, amount[self.order])

    def find(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each slot, and whether it has points at all."""
        if not len(self.names):
            return np.zeros(len(slot), np.int64), np.zeros(len(slot), bool)
        at = np.minimum(np.searchsorted(self.names, slot), len(self.names) - 1)
        return at, self.names[at] == slot

    def first(self, at: np.ndarray, amount: np.ndarray) -> np.ndarray:
        """The place of the first point of the slot with this amount or more; the slot's end if there is none."""
        return np.searchsorted(self.keys, at * (len(self.values) + 1) + np.searchsorted(self.values, amount))


class Winners:
    """The best answer to each question so far: score, then later day, then nearer amount, then smaller id."""

    def __init__(self, rule: Rule, q: dict[str, np.ndarray]) -> None:
        n = len(q["x"])
        self.rule, self.q = rule, q
        self.score, self.day = np.full(n, -1.0), np.full(n, NO_DAY, np.int64)
        self.nearness, self.neg_id = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def offer(self, who: np.ndarray, c: np.ndarray, day: np.ndarray, p: np.ndarray) -> None:
        if not len(who):
            return
        q = {k: v[who] for k, v in self.q.items()}
        known = (q["day"] != NO_DAY) & (day != NO_DAY)
        on_date = np.where(known, self.rule.date_points(np.abs(q["day"] - day)), 0.0)
        score = self.rule.amount_points(c, q) + on_date + q["name_points"] + q["number_points"]
        nearness, neg_id = -np.abs(c - q["x"]), -p
        better = score > self.score[who]
        tie = score == self.score[who]
        for new, old in ((day, self.day), (nearness, self.nearness), (neg_id, self.neg_id)):
            better |= tie & (new > old[who])
            tie &= new == old[who]
        better &= score >= self.rule.threshold
        who = who[better]
        self.score[who], self.day[who] = score[better], day[better]
        self.nearness[who], self.neg_id[who] = nearness[better], neg_id[better]


def _around(slots: Slots, points: dict[str, np.ndarray], wins: Winners, who: np.ndarray, at: np.ndarray) -> None:
    """Offers the nearest points on both sides in slot ``at``."""
    amounts, days, ids = (points[k][slots.order] for k in ("x", "day", "p"))
    place = slots.first(at, wins.q["x"][who])
    for fits, i in ((place < slots.end[at], place), (place > slots.start[at], place - 1)):
        wins.offer(who[fits], amounts[i[fits]], days[i[fits]], ids[i[fits]])


def _near(points: dict[str, np.ndarray], wins: Winners, span: int) -> None:
    """Every day up to ``span`` away."""
    wide = 1 << 25  # more than any distance between days
    slots = Slots(points["block"] * wide + points["day"], points["x"])
    for distance in range(-span, span + 1):
        at, there = slots.find(wins.q["block"] * wide + wins.q["day"] + distance)
        who = np.flatnonzero(there)
        _around(slots, points, wins, who, at[who])


def _firsts(points: dict[str, np.ndarray], latest: bool) -> dict[str, np.ndarray]:
    """Of each amount and day, or of each amount at its latest day, the point with the smallest id."""
    last = (points["p"], -points["day"], points["x"], points["block"]) if latest else (points["p"], points["x"], points["day"], points["block"])
    order = np.lexsort(last)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in ("block", "x") if latest else ("block", "day", "x"):
        new[1:] |= points[key][order][1:] != points[key][order][:-1]
    return {k: v[order[new]] for k, v in points.items()}


def _far(points: dict[str, np.ndarray], wins: Winners) -> None:
    """Any date: the latest day in the exact and in the close range, and the nearest amounts beyond the close one."""
    points = _firsts(points, True)
    by_amount = Slots(points["block"], points["x"])
    amounts, days, ids = (points[k][by_amount.order] for k in ("x", "day", "p"))
    at, there = by_amount.find(wins.q["block"])
    who = np.flatnonzero(there)
    at, q = at[who], {k: v[who] for k, v in wins.q.items()}
    wide = 1 << 25
    by_day = Slots(points["block"] * wide + points["day"], points["x"])
    tables = [days]
    while 2 ** len(tables) <= len(days):
        half = 2 ** (len(tables) - 1)
        tables.append(np.maximum(tables[-1][:-half], tables[-1][half:]))
    for tier in ("exact", "close"):
        low, high = by_amount.first(at, q[f"{tier}_lo"]), by_amount.first(at, q[f"{tier}_hi"] + 1)
        level = np.frexp(np.maximum(high - low, 1))[1] - 1
        latest = np.full(len(who), NO_DAY - 1, np.int64)
        for n in np.unique(level[high > low]):
            some = (high > low) & (level == n)
            latest[some] = np.maximum(tables[n][low[some]], tables[n][high[some] - 2**n])
        slot, _ = by_day.find(q["block"] * wide + latest)
        some = high > low
        _around(by_day, points, wins, who[some], slot[some])
    above = by_amount.first(at, q["close_hi"] + 1)
    below = by_amount.first(at, q["close_lo"]) - 1
    for fits, i in ((above < by_amount.end[at], above), (below >= by_amount.start[at], below)):
        wins.offer(who[fits], amounts[i[fits]], days[i[fits]], ids[i[fits]])


def _answered(rows: pa.Table, rule: Rule) -> list[pa.RecordBatch]:
    """The best answers to the questions among the rows, which hold whole blocks, and the questions that stay open."""
    data = {c: rows.column(c).to_numpy() for c in rows.column_names}
    block = np.cumsum(data.pop("new")) - 1
    asks, kinds = data["asks"], np.select([data["db"] == ANY_DATE, data["db"] == SMALL_GROUP], [2, 1], 0)
    out = []
    for kind in range(3):
        mine = kinds == kind
        at = np.flatnonzero(mine & asks)
        if not len(at):
            continue
        points = _firsts({k: data[k][mine & ~asks] for k in ("x", "p")} | {
            "block": block[mine & ~asks], "day": data["day"][mine & ~asks].astype(np.int64)}, False)
        q = {k: data[k][at] for k in ("x", "name_points", "number_points")} | {
            "block": block[at], "day": data["day"][at].astype(np.int64)} | rule.bounds(data["x"][at], data["is_debit"][at])
        wins = Winners(rule, q)
        if kind < 2:
            _near(points, wins, rule.span)
        if kind:
            _far(points, wins)
        # What is found at any date has no more than the points for amount, name and number.
        is_open = (wins.score <= MOST_FOR_AMOUNT + q["name_points"] + q["number_points"]) & (kind == 0)
        keep = (wins.score >= 0) | is_open
        some = at[keep]
        out.append(pa.RecordBatch.from_arrays(
            [pa.array(v) for v in (data["p"][some], wins.score[keep], wins.day[keep].astype(np.int32), wins.nearness[keep], wins.neg_id[keep],
                                   is_open[keep], *(np.where(is_open[keep], v, v.dtype.type(0)) for v in (
                                       data["x" if c == "t" else c][some] for c in [*ASKED, "mode"])))],
            [f.split()[0] for f in ANSWER.split(", ")]))
    return out


def _pass(rule: Rule, chunk: int):
    keys = [*GROUP, "ab", "db"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, last = 0, None

        def marked(batch: pa.RecordBatch):
            """Where a block begins."""
            nonlocal last
            columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
            new = np.ones(batch.num_rows, bool)
            if batch.num_rows > 1:
                new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
            first = tuple(c[0] for c in columns)
            new[0] = first != last
            last = tuple(c[-1] for c in columns)
            return batch.append_column("new", pa.array(new)), new

        for batch in batches:
            if not batch.num_rows:
                continue
            batch, new = marked(batch)
            # More questions to one block than are held at once: they are answered part by part, and its points stay.
            if count >= 2 * chunk and not new.any() and held[-1].column("asks")[-1].as_py():
                table = pa.Table.from_batches(held)
                yield from _answered(table, rule)
                first = table.num_rows - int(np.argmax(table.column("new").to_numpy()[::-1])) - 1
                points = table.slice(first).filter(pc.invert(table.slice(first).column("asks"))).combine_chunks()
                if points.num_rows:
                    begins = np.zeros(points.num_rows, bool)
                    begins[0] = True
                    held = points.set_column(points.column_names.index("new"), "new", pa.array(begins)).to_batches()
                else:
                    held = []
                    batch = batch.set_column(batch.schema.get_field_index("new"), "new", pa.array(np.arange(batch.num_rows) == 0))
                count = points.num_rows
            starts = np.flatnonzero(new)
            if count + batch.num_rows >= chunk and len(starts) and (held or starts[-1] > 0):
                cut = int(starts[-1])
                yield from _answered(pa.Table.from_batches([*held, batch.slice(0, cut)]), rule)
                held, count = [batch.slice(cut)], batch.num_rows - cut
            else:
                held.append(batch)
                count += batch.num_rows
        if held:
            yield from _answered(pa.Table.from_batches(held), rule)
    return run


def _amount_block(value: Column) -> Column:
    return F.floor(F.log(value.cast("double")) * F.lit(PER_E)).cast("int")


def _searched(points: DataFrame, asked: DataFrame, rule: Rule, far: bool) -> DataFrame:
    """``ANSWER`` of the questions ``asked``: around their days, or, with ``far``, at any date."""
    span = rule.span
    low = F.col("c").cast("double") * (1 - rule.amount) * 0.999 - 1
    wanted = F.sequence(_amount_block(F.greatest(low, F.lit(1.0))), _amount_block(F.col("c").cast("double") * 1.11 + 1))
    block_of = lambda day: F.floor(day / DAY_BLOCK).cast("int")
    one = lambda block: F.array(F.lit(block))
    small, banded = F.col("mode") == SMALL, F.col("mode") == BANDED
    if far:
        place, point_ab, point_db = (_amount_block(F.col("t")), F.lit(ANY_DATE)), wanted, one(ANY_DATE)
    else:
        place = (F.when(banded, _amount_block(F.col("t"))).otherwise(0), F.when(small, F.lit(SMALL_GROUP)).otherwise(block_of(F.col("day"))))
        point_ab = F.when(banded, wanted).otherwise(one(0))
        point_db = F.when(small, one(SMALL_GROUP)).when(F.col("day") == NO_DAY, F.array().cast("array<int>")).otherwise(
            F.sequence(block_of(F.col("day") - span), block_of(F.col("day") + span)))
    index = points.select(*GROUP, "mode", "day", F.col("c").alias("x"), "p", F.explode(point_ab).alias("ab"), point_db.alias("dbs")).select(
        *GROUP, "mode", "ab", F.explode("dbs").alias("db"), "day", "x", "p", F.lit(False).alias("asks"), F.lit(False).alias("is_debit"),
        F.lit(0.0).alias("name_points"), F.lit(0.0).alias("number_points"))
    questions = asked.select(*GROUP, "mode", place[0].alias("ab"), place[1].alias("db"), "day", F.col("t").alias("x"), F.col("rid").alias("p"),
                             F.lit(True).alias("asks"), "is_debit", "name_points", "number_points")
    keys = [*GROUP, "ab", "db"]
    dealt = index.unionByName(questions).repartition(*keys).sortWithinPartitions(*keys, "asks")
    return dealt.mapInArrow(_pass(rule, CHUNK), ANSWER)


def amount_blocks(asked: DataFrame) -> list[tuple[bool, int]]:
    """Directions and amount blocks of the questions: at most 2 * 88 of them, as amounts are 64-bit numbers."""
    return [tuple(r) for r in asked.select("is_income", _amount_block(F.col("t")).alias("ab")).distinct().collect()]


def in_amount_blocks(blocks: list[tuple[bool, int]], tolerance: float) -> Column:
    """Whether a point can be wanted in one of the blocks."""
    c = F.col("c").cast("double")
    first, last = _amount_block(F.greatest(c * (1 - tolerance) * 0.999 - 1, F.lit(1.0))), _amount_block(c * 1.11 + 1)
    fits = F.lit(False)
    for direction in (False, True):
        mine = sorted(ab for is_income, ab in blocks if is_income == direction)
        if mine:
            fits |= (F.col("is_income") == direction) & F.exists(F.sequence(first, last), lambda ab: ab.isin(mine))
    return fits


def best_answers(points: Callable[[DataFrame], DataFrame], asked: DataFrame, rule: Rule) -> DataFrame:
    """(rid, score, inv_day, nearness, neg_id): accepted points, among them the best one for each question.

    ``asked``: ``QUESTION``, with ``rid`` for the row that asks. ``points`` gives, for questions, the points of their groups: ``GROUP``, ``mode``,
    ``day``, ``c``, ``p`` (the id); of equal points in large groups it gives the smallest id. Answers are written on the way.
    """
    undated = (F.col("day") == NO_DAY) & (F.col("mode") != SMALL)
    near = durable(_searched(points(asked), asked.where(~undated), rule, False))
    still = durable(near.where("open").select(*QUESTION).unionByName(asked.where(undated).select(*QUESTION)))
    answers = near
    if still.limit(1).count():
        answers = answers.unionByName(durable(_searched(points(still), still, rule, True)))
    return answers.where("score >= 0").select("rid", "score", "inv_day", "nearness", "neg_id")


def best_of_each(answers: DataFrame) -> DataFrame:
    """(rid, id): the best answer of each row that asks: score, then later day, then nearer amount, then smaller id."""
    best = F.max(F.struct("score", "inv_day", "nearness", "neg_id")).alias("best")
    return durable(answers.groupBy("rid").agg(best).select("rid", (-F.col("best.neg_id")).alias("id")))


def without_answer(asking: DataFrame, found: DataFrame) -> DataFrame | None:
    """The rows that have no answer; None if there are none."""
    left = durable(meet(asking, found, "rid", "left_anti"))
    return left if left.limit(1).count() else None
