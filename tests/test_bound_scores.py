from pyspark.sql import functions as F

from tallyloom.functions import dates, money, replies
from tallyloom.operators import evaluation
from tallyloom.sources import tables


def plan_of(df, column):
    return df.select(column.alias("out"))._jdf.queryExecution().optimizedPlan().toString().lower()


def test_a_score_reads_its_texts_once(spark):
    df = spark.createDataFrame([("a", "b")], "e string, x string")
    dated = plan_of(df, replies.date_text_score(F.col("e"), F.col("x")))
    assert dated.count("date_diff(") + dated.count("datediff(") == 1 and dated.count("regexp_extract(") == 2
    assert plan_of(df, replies.numeric_score(F.col("e"), F.col("x"))).count("translate(") == 2
    assert plan_of(df, dates.date_in_text(F.col("e"))).count("regexp_extract(") == 1


def test_amounts_beside_a_total_are_read_once(spark):
    df = spark.createDataFrame([("a", "b", "c")], "a string, v string, t string")
    typed = money.fill_from_total(*[F.col(c).try_cast(money.MONEY) for c in "avt"])
    assert plan_of(df, typed).count("try_cast(") == 3


def test_payloads_are_parsed_behind_the_join(spark):
    truth = spark.createDataFrame([("f", {"amount": "5", "vat": None}), ("g", {})], "file string, expected map<string,string>")
    done = spark.createDataFrame([("m", "f", "success", 1.0, '{"Amount": "5"}'), ("m", "g", "success", 1.0, "{}")],
                                 "model string, file string, status string, seconds double, payload string")
    scores = evaluation.field_scores(truth, done)
    assert [tuple(r) for r in scores.collect()] == [("m", "f", "amount", "5", "5", 1.0)]
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan[plan.index("Join"):]


def test_invoices_are_made_by_as_many_tasks_as_there_are_rows_for(spark, tmp_path, monkeypatch):
    spark.range(100).select(F.col("id").alias("o_orderkey"), F.lit(1).alias("o_custkey"), F.lit(10.5).alias("o_totalprice"), F.lit(
        "1995-01-02").alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority")).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(2).select(F.col("id").alias("c_custkey"), F.lit("C").alias("c_name"), F.lit("S").alias("c_mktsegment")).write.parquet(
        str(tmp_path / "customer.parquet"))
    monkeypatch.setattr(tables, "ROWS_A_TASK", 5)
    made = tables.invoices(spark, str(tmp_path))
    assert made.count() == 100 and made.rdd.getNumPartitions() == 20
