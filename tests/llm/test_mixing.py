import math
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm import mixing
from tests.llm.helpers import awkward, clash, documents, empty


def _due(sizes, weights=(1, 2, 3), most=3):
    """Shares by weight, with what lies above a source's limit shared again, in fractions."""
    order = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    done, open_to, left = {}, list(order), Fraction(sum(sizes.values()))
    while open_to:
        total = sum(weight[s] for s in open_to)
        above = [s for s in open_to if left * weight[s] / total > most * sizes[s]]
        if not above:
            return done | {s: left * weight[s] / total for s in open_to}
        done |= {s: Fraction(most * sizes[s]) for s in above}
        left -= sum(most * sizes[s] for s in above)
        open_to = [s for s in open_to if s not in done]
    return done


def _targets(spark, sizes):
    rows = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "__source string, words long, docs long")
    return {r["__source"]: r for r in mixing.targets(rows).collect()}


def test_targets(spark):
    assert _targets(spark, {}) == {} and _targets(spark, {"a": 0})["a"].target == 0
    rnd = random.Random(5)
    many = {f"s{i}": int(10 ** rnd.uniform(0, 9)) for i in range(3000)}
    for sizes in ({"a": 100, "b": 100, "c": 100, None: 300}, {"a": 1000, "b": 10, "c": 0, "d": 500, "é": 7}, many):
        found, due = _targets(spark, sizes), _due(sizes)
        assert found.keys() == due.keys()
        for s, r in found.items():
            times = due[s] / sizes[s] if sizes[s] else 0
            assert math.isclose(r.target, due[s], rel_tol=1e-12) and r["__whole"] == int(times)
            assert math.isclose(r["__share"], times - int(times), rel_tol=1e-9, abs_tol=1e-9)


def test_a_source_for_every_document(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.format_string("s%07d", "id").alias("source"))
    row = mixing.mix(docs).agg(F.sum("taken").alias("taken"), F.countDistinct("source").alias("n")).first()
    assert row.n == 3000 and row.taken % 3 == 0 and 0 < row.taken <= 9 * 3000


def test_repeated_rows_are_dealt_into_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 16)
    docs = documents(spark, [(1, "a b c", "x")] * 700 + [(i, f"w {i}", "x") for i in range(100)] + [(1, "q " * 3000, "y")])
    rows = mixing.mix(docs).collect()
    taken = sum(r.taken for r in rows if r.source == "x")
    target = next(r.target for r in rows if r.source == "x")
    assert len(rows) == 801 and abs(taken - target) <= 6


def test_flight_keeps_both_totals_and_expectations():
    rng = np.random.default_rng(1)
    size, chance = rng.integers(0, 500, 400), np.full(400, 0.37)
    mean = np.zeros(400)
    for i in range(300):
        p = mixing.flight(chance, size, rng.random(400))
        assert abs(p.sum() - chance.sum()) < 1e-6 and abs((p * size).sum() - (chance * size).sum()) < 1e-3
        assert ((p > 0) & (p < 1)).sum() <= 2
        landed = mixing.landing(p, size)
        assert set(landed) <= {0.0, 1.0} and abs((landed * size).sum() - (chance * size).sum()) <= 500
        mean += landed / 300
    assert abs(mean.mean() - 0.37) < 0.01 and np.abs(mean - 0.37).max() < 0.2
    for i in range(20):
        settled = mixing.settle(chance, size, rng.random(400))
        assert set(settled) <= {0.0, 1.0} and abs(settled.sum() - chance.sum()) < 2
        assert abs((settled * size).sum() - (chance * size).sum()) < 40
    same = mixing.landing(mixing.flight(np.full(9, 1 / 3), np.full(9, 5), rng.random(9)), np.full(9, 5))
    assert same.sum() == 3


def _docs(spark, n=9000):
    source = F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("s"), F.col("id") % 4))
    words = F.array_join(F.array_repeat(F.lit("w"), (F.pmod(F.xxhash64("id"), F.lit(90)) + 1).cast("int")), " ")
    return spark.range(n).select(F.col("id").alias("doc_id"), words.alias("text"), source.alias("source"))


def test_mix_meets_targets_and_reruns_agree(spark):
    docs = _docs(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and len({r.doc_id for r in rows}) == len(rows)
    taken, size, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert r.size == len(r.text.split()) and r.taken == r.size * r.copies and 0 <= r.copies <= 3
        taken[r.source] += r.taken
        size[r.source] += r.size
        target[r.source] = r.target
    due = _due(dict(size))
    for s in size:
        assert math.isclose(target[s], due[s]) and abs(taken[s] - target[s]) <= 90
    again = mixing.mix(docs.repartition(13)).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in rows}
    mixed = mixing.materialise(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)


def test_several_rounds_of_flights(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 16)
    rows = mixing.mix(_docs(spark, 3000)).collect()
    taken, target = defaultdict(int), {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 90 for s in taken)


def test_awkward_rows(spark):
    docs = clash(awkward(spark), "taken", "size", "copies")
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(r.taken <= 3 * r.size for r in rows)
    assert all(r.size == 0 and r.taken == 0 for r in rows if not (r.text or "").strip())
    assert mixing.mix(empty(spark)).count() == 0 and mixing.materialise(empty(spark)).count() == 0
    clashing = clash(_docs(spark, 60), "size", "target", "copies", "taken", "source_size", "words")
    made = mixing.materialise(clashing)
    assert made.columns == clashing.columns and made.count()
    assert all(set(r[3:]) == {"clash"} for r in made.collect())
    repeated = mixing.mix(documents(spark, [(1, "a b", "x")] * 50 + [(2, "c d e", "y")] * 40)).collect()
    taken = sum(r.taken for r in repeated if r.source == "x")
    assert len(repeated) == 90 and abs(taken - repeated[0].target) <= 3
