from pyspark.sql import functions as F

from tallyloom.functions import money
from tallyloom.operators import statements


def by_regex(line):
    parts = F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    return F.transform(parts, lambda f: F.replace(F.regexp_replace(F.trim(f), r'^"([\s\S]*)"$', "$1"), F.lit('""'), F.lit('"')))


def test_lines_with_and_without_quotes_split_alike(spark):
    lines = ["", ",", " a , b,,", 'x,"a, b",""', "1995-01-02,Card,,12.00,,", 'say ""hi"",2', None]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    fields = statements.split_fields(F.col("line"))
    assert df.where(~fields.eqNullSafe(by_regex(F.col("line")))).count() == 0
    assert "contains" in df.select(fields)._jdf.queryExecution().analyzed().toString().lower()


def test_plain_cents_read_as_by_the_whole_parser(spark):
    texts = ["0.00", "12.34", "0012.30", "999999999999999.99", "12.345", "1,234.50", "-5.00", "12.34\n", "", None, "9" * 16 + ".00"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    whole = money.bind(F.regexp_replace("t", r"[^0-9.,\-()]", ""), money._signed_amount)
    assert df.where(~money.parse_money(F.col("t")).eqNullSafe(whole)).count() == 0
    assert "{1,15}" in df.select(money.parse_money(F.col("t")))._jdf.queryExecution().analyzed().toString()
