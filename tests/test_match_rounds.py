"""What the matching moves: every table is read once, a text asks each set of invoices once; and its ways for large groups."""

import datetime as dt
from decimal import Decimal

import pytest

from tallyloom.operators import match_index, reconcile, text_evidence
from tests import test_reconcile
from tests.test_reconcile import INV, TXN

DAY, AMOUNT = dt.date(2024, 3, 1), Decimal("100.00")


def test_statement_and_ledger_are_read_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch
    invoices = spark.createDataFrame([(i, DAY, f"inv-{i:04d}", f"Nord{i} Trading", AMOUNT, None, "PKR", False) for i in range(5)], INV)
    txns = spark.createDataFrame([(i, "f", DAY, f"nord{i} trading", f"inv-{i:04d}", AMOUNT, None) for i in range(7)], TXN)
    matched = reconcile.match_transactions(txns.mapInArrow(counted, TXN), invoices.mapInArrow(counted, INV))
    assert sum(r["matched_invoice_id"] == r["row_no"] for r in matched.collect()) == 5
    assert reads.value == 5 + 7


def test_a_text_asks_each_set_of_invoices_once(spark, monkeypatch):
    """Word sets with the same names are one group, a number leads to its invoice, and the other direction is not asked at once."""
    written, write = [], reconcile.durable

    def watched(df):
        written.append(write(df))
        return written[-1]

    monkeypatch.setattr(reconcile, "durable", watched)
    invoices = spark.createDataFrame([(i, DAY, f"inv-{i:04d}", f"Nord{i} Trading", AMOUNT, None, "PKR", False) for i in range(5)], INV)
    txns = spark.createDataFrame([(i, "f", DAY, f"nord{i} trading", f"inv-{i:04d}", AMOUNT, None) for i in range(5)], TXN)
    matched = reconcile.match_transactions(txns, invoices)
    assert sorted((r["row_no"], r["matched_invoice_id"]) for r in matched.collect()) == [(i, i) for i in range(5)]
    assert written[-1].count() == 5 * 3  # the names with "trading", the whole name, the invoice with the number


@pytest.mark.parametrize("seed, days, tol", [(1, 30, "0.15"), (2, 10, "0.30"), (3, 45, "0.04"), (4, 30, "0.15")])
def test_large_groups_equal_brute_force(spark, monkeypatch, seed, days, tol):
    """Groups dealt by day, or by day and amount, and numbers of many invoices."""
    monkeypatch.setattr(text_evidence, "SMALL_SIZE", 12)
    monkeypatch.setattr(text_evidence, "RARE", 1)
    monkeypatch.setattr(match_index, "DAY_BLOCK", 16)
    test_reconcile.test_equals_brute_force(spark, monkeypatch, seed, days, tol)


@pytest.mark.parametrize("chunk", [2, 50])
def test_one_hot_question(spark, monkeypatch, chunk):
    """More equal transactions than a task holds at once."""
    monkeypatch.setattr(match_index, "CHUNK", chunk)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        invoices = spark.createDataFrame([(i, DAY + dt.timedelta(days=i % 3), None, None, AMOUNT + i % 2, None, "PKR", False) for i in range(40)], INV)
        txns = spark.createDataFrame([(i, "f", DAY, "card", "", AMOUNT, None) for i in range(300)] + [
            (i, "f", DAY, "card", "", None, AMOUNT) for i in range(300, 310)], TXN)
        matched = reconcile.match_transactions(txns, invoices).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["matched_invoice_id"] for r in matched} == {0} and len(matched) == 310
