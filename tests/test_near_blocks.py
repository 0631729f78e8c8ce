"""Counts and nearest invoices in blocks of amounts: ends of blocks, repeated rows, and no join."""

import random
from decimal import Decimal

import pytest

from tallyloom.operators import ledger


@pytest.mark.parametrize("threshold", [0.5, 2.0, 5000.0])
def test_blocks_against_pairs(spark, threshold):
    rnd = random.Random(7)
    edge = Decimal(str(threshold)) * ledger.BLOCK
    spread = [(edge * k + Decimal(str(threshold)) * d / 4).quantize(Decimal("0.01")) for k in (-1, 0, 1, 2) for d in range(-6, 7)]
    rows = [(i, rnd.choice(spread), rnd.choice([*spread, None])) for i in range(150)]
    # One invoice three times at one amount: it is one of the nearest three, not all of them.
    rows += [(1000, Decimal("0.10"), Decimal("0.10"))] * 3 + [(1001, Decimal("0.10"), None), (None, Decimal("0.10"), None)]
    inv = spark.createDataFrame(rows, "id long, amount decimal(18,2), total_base decimal(18,2)")
    asked = {*spread, Decimal("0.10"), Decimal("1e7")}
    targets = spark.createDataFrame([(t,) for t in asked] * 2 + [(None,)], "target decimal(18,2)")
    limit = Decimal(str(threshold))
    want, counted = set(), {}
    for t in asked:
        away = {}
        for i, *vs in rows:
            found = [abs(v - t) for v in vs if v is not None and abs(v - t) < limit]
            counted[t] = counted.get(t, 0) + bool(found)
            if found:
                away[i] = min(found + [away.get(i, limit)])
        first = sorted(away, key=lambda i: (away[i], -1 if i is None else i))[:3]
        want |= {(t, i) for i in first}
    nearest, counts = ledger.near_amounts(inv, targets, threshold, nearest=3), ledger.near_counts(inv, targets, threshold)
    got = [tuple(r) for r in nearest.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert sorted(tuple(r) for r in counts.collect()) == sorted(counted.items())
    for df in (nearest, counts):
        assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
