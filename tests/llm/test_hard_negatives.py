import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("width, size", [(0, 5), (1, 2**20), (64, 300), (64, 2**25), (5000, 40), (300, 2**22)])
def test_products_are_exact(width, size):
    rnd = np.random.default_rng(width + size)
    a, b = rnd.integers(-size, size, (7, width)), rnd.integers(-size, size, (9, width))
    a[0], b[0] = size, -size
    norm = max(int((m.astype(object) ** 2).sum(axis=1).max()) if width else 0 for m in (a, b))
    primes = hard_negatives.primes_for(norm, width)
    found = hard_negatives.multiply(hard_negatives.residues(a, primes), hard_negatives.residues(b, primes), primes)
    assert (found == a.astype(object) @ b.astype(object).T).all()


def _mine(rows, step=50, positives=5, negatives=3):
    usable = [(i, n, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, (n, v, label) in enumerate(rows)
              if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    last = lambda n: (n is None, n or 0)
    out = []
    for i, n, v, label in usable:
        if n is None or n % step:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), last(m), j, m, lab) for j, m, w, lab in usable if j != i))
        for score, _, _, m, lab in [s for s in scored if s[4] == label][:positives]:
            inside = [s for s in scored if s[4] != label and -50 * score <= -100 * s[0] <= -95 * score][:negatives]
            out += [(n, m, rank, s[3], -score, -s[0]) for rank, s in enumerate(inside, 1)]
    return out


def _rows(rnd, count):
    rows = [(i, [rnd.gauss(0.3, 0.4) for _ in range(8)], rnd.randint(0, 3)) for i in range(count)]
    same = [0.5] * 8
    rows += [(1000 + i, same, i % 3) for i in range(60)]  # one vector many times: ties by key
    rows += [(50, [0.1] * 8, 1), (50, [0.1] * 8, 1), (100, None, 1), (150, same, None), (None, same, 2), (None, same, 1),
             (200, [0.1, None], 1), (250, [float("nan")] * 8, 1), (300, [float("inf")] * 8, 0), (350, [], 1), (400, [0.7, -0.1], 2)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:  # several blocks and tiles
        monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 600)
        monkeypatch.setattr(hard_negatives, "TILE_SCORES", 40)
    rows = _rows(random.Random(6), 500)
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = hard_negatives.mine(table.withColumns({"score": F.lit("x"), "rid": F.lit("x")}), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(_mine(rows), key=repr)


def test_large_components(spark):
    rnd = random.Random(7)
    rows = [(i, [rnd.gauss(0, 1) * 2**17 for _ in range(4)], i % 2) for i in range(120)]
    found = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, found.collect())) == sorted(_mine(rows, 10))
    with pytest.raises(ValueError):
        hard_negatives.mine(spark.createDataFrame([(0, [1e30], 1)], SCHEMA), F.col("vec_id") % 10 == 0)


def test_empty_tables(spark):
    table = spark.createDataFrame([(1, [0.5], 1)], SCHEMA)
    assert hard_negatives.mine(table, F.col("vec_id") % 50 == 0).count() == 0
    assert hard_negatives.mine(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert hard_negatives.mine(table, F.lit(True)).count() == 0


def test_no_block_is_sent_through_the_driver(spark, monkeypatch):
    """Anchors copied for each partition filled the driver, and a task took all blocks that one file held."""
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 600)
    rows = _rows(random.Random(8), 300)
    plans, write, pairs, files = [], hard_negatives.common.staged, hard_negatives._pairs, []

    def watched(df, *more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *more)

    def met(blocks, anchors):
        files.append((blocks.count(), len(blocks.inputFiles())))
        return pairs(blocks, anchors)

    monkeypatch.setattr(hard_negatives.common, "staged", watched)
    monkeypatch.setattr(hard_negatives, "_pairs", met)
    found = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA).coalesce(1), F.col("vec_id") % 50 == 0)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert not any("Broadcast" in plan for plan in plans)
    assert all(n > 8 and many >= n / 4 for n, many in files) and len(files) == 2
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(_mine(rows), key=repr)
