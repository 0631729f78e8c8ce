"""Ledger, reconciliation and extraction scoring as Spark DataFrame jobs."""
