from pyspark.sql import functions as F

from tallyloom.operators import extraction
from tallyloom.sources import tables


def test_replies_and_their_confidences_are_parsed_once(spark):
    rows = [(1, 1, '{"Amount": 5, "Tax Amount": null, "Confidence": {"amount": 0.7, "tax_amount": 0.9}}'),
            (1, 2, '[{"Amount": "6", "Tax Amount": "1", "Confidence": "none"}, {"Amount": null}, null]'), (2, 1, "nothing"), (3, 1, None)]
    x = spark.createDataFrame(rows, "doc_id long, attempt int, response string")
    out = extraction.confidences(x)
    assert sorted(tuple(r) for r in out.select("doc_id", "pass", "field", "value", "confidence").collect()) == [
        (1, 1, "Amount", "5", 0.7), (1, 2, "Amount", "6", 0.0), (1, 2, "Tax Amount", "1", 0.0)]
    # One for the reply and one for the confidences, neither once more for each field or in a filter.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 2


def test_replies_are_made_by_as_many_tasks_as_there_are_rows_for(spark, tmp_path, monkeypatch):
    spark.range(500).select(F.col("id").alias("o_orderkey"), (F.col("id") % 9).alias("o_custkey"), F.lit(10.5).alias("o_totalprice"),
                            F.lit("1995-01-02").alias("o_orderdate")).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(9).select(F.col("id").alias("c_custkey"), F.lit("C").alias("c_name"), F.lit("S").alias("c_mktsegment")).write.parquet(
        str(tmp_path / "customer.parquet"))
    monkeypatch.setattr(tables, "ROWS_A_TASK", 20)
    made = tables.extractions(spark, str(tmp_path))
    assert made.count() == 1500 and made.rdd.getNumPartitions() == 25
