import random

from pyspark.sql import functions as F

from tallyloom.functions import replies

PATTERN = r"```(?:json)?\s*([\s\S]*?)\s*```"


def test_fenced_text_is_what_the_pattern_takes(spark):
    draw = random.Random(3)
    bits = ["```", "`", "``", "json", "JSON", " ", "\n", "\t", "\x0b", " ", "{", "}", "a", "é", ",", "\r", "\f", "😀"]
    texts = ["".join(draw.choices(bits, k=draw.randint(0, 14))) for _ in range(4000)] + ["", "``````", "```json```", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    by_pattern = F.nullif(F.regexp_extract("t", PATTERN, 1), F.lit(""))
    found = F.when(F.col("t").contains("```"), replies.fenced_text(F.col("t")))
    assert df.where(found.isNotNull()).count() > 100
    assert df.where(~found.eqNullSafe(by_pattern)).count() == 0


def test_no_pattern_tries_every_character_of_a_reply(spark):
    plan = spark.range(1).select(replies.reply_records(F.col("id").cast("string")))
    assert r"*?" not in plan._jdf.queryExecution().analyzed().toString()
