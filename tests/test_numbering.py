"""Numbering deals its rows once, and an ingest computes its ledger rows once."""

from pyspark.sql import functions as F

from tallyloom.operators import ledger, numbering
from tallyloom.sources import files


def test_rows_are_dealt_once(spark, monkeypatch):
    plans, write = [], numbering.durable

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(numbering, "durable", watched)
    rows = spark.range(500).select((F.col("id") * 37 % 500).alias("k"), F.repeat(F.lit("x"), F.lit(50)).alias("wide"))
    got = numbering.number_rows(rows.repartition(5), "k", start=F.lit(10).cast("long"))
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert sorted((r["k"], r["row_number"]) for r in got.collect()) == [(i, i + 11) for i in range(500)]
    assert sum(p.count("rangepartitioning") for p in plans) == 1
    assert "Exchange hashpartitioning(wide" not in plans[-1] and "RowNumber" not in plans[-1] and "row_number()" not in plans[-1]


def test_ledger_rows_are_computed_once(spark):
    computed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            computed.add(batch.num_rows)
            yield batch
    incoming = spark.range(40).select(F.col("id").alias("arrival"), F.lit("Nord").alias("transactor")).mapInArrow(counted, "arrival long, transactor string")
    suppliers = spark.createDataFrame([("Nord", 3)], "supplier_name string, arrival long")
    rows = ledger.append(spark.createDataFrame([], files.INVOICE_SCHEMA), incoming, suppliers, 100)
    assert sorted((r["id"], r["supplier_id"]) for r in rows.collect()) == [(i, 3) for i in range(101, 141)]
    assert computed.value == 40
