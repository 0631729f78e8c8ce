"""Sides that grow with the input do not pass through the driver."""

import datetime as dt
from decimal import Decimal

from tallyloom.operators import reconcile
from tests.test_reconcile import INV, TXN


def test_matching_broadcasts_no_side(spark, monkeypatch):
    """Exploded sides count as small; sent to all they filled the driver."""
    day, amount = dt.date(2024, 3, 1), Decimal("100.00")
    invoices = spark.createDataFrame([(i, day, f"inv-{i:04d}", f"Nord{i} Trading", amount, None, "PKR", False) for i in range(5)], INV)
    txns = spark.createDataFrame([(i, "f", day, f"nord{i} trading", f"inv-{i:04d}", amount, None) for i in range(5)], TXN)
    plans, write = [], reconcile.durable

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(reconcile, "durable", watched)
    matched = reconcile.match_transactions(txns, invoices)
    plans.append(matched._jdf.queryExecution().executedPlan().toString())
    assert not any("BroadcastHashJoin" in plan for plan in plans)
    assert sorted((r["row_no"], r["matched_invoice_id"]) for r in matched.collect()) == [(i, i) for i in range(5)]
