"""All pairs of near amounts leave the join as they are: nothing moves them again, and none comes twice."""

from decimal import Decimal

from tallyloom.operators import ledger


def test_pairs_are_not_shuffled_and_unique(spark):
    rows = [(1, "10.00", "10.00"), (1, "11.00", "14.00"), (2, "5.01", "14.99"), (2, "9.00", None), (3, None, None), (4, "15.00", "5.00"),
            (None, "10.00", "12.00"), (None, "10.00", None), (5, "10.00", "900.00"), (5, "10.00", "899.00")]
    inv = spark.createDataFrame([(i, *(v and Decimal(v) for v in vs)) for i, *vs in rows], "id long, amount decimal(18,2), total_base decimal(18,2)")
    asked = [Decimal("10.00"), Decimal("895.01"), Decimal("-3.00")]
    targets = spark.createDataFrame([(t,) for t in [*asked, *asked, None]], "target decimal(18,2)")
    want = {(t, i) for t in asked for i, *vs in rows for v in vs if v and abs(Decimal(v) - t) < 5}
    near = ledger.near_amounts(inv, targets, 5.0)
    got = [tuple(r) for r in near.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = near._jdf.queryExecution().executedPlan().toString()
    plan = plan[:plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert "Exchange" not in plan[:plan.index("Join")]
