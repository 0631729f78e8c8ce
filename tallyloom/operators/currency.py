"""Rate table and conversions as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.fixed_values import BASE_CURRENCY, DEFAULT_RATES
from tallyloom.functions import money

RATE_SCHEMA = "currency string, rate_to_base double"


def rates(spark: SparkSession, stored: DataFrame | None = None) -> DataFrame:
    """One row per currency with a rate; a stored rate replaces the default of its currency."""
    defaults = spark.createDataFrame(list(DEFAULT_RATES.items()), RATE_SCHEMA)
    if stored is None:
        return defaults
    own = stored.select("currency", F.col("rate_to_base").alias("own"))
    return defaults.join(own, "currency", "full").select(
        "currency", F.coalesce("own", "rate_to_base").alias("rate_to_base"))


def update_rates(stored: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new rates, rejected changes). ``changes``: arrival, currency, value text.

    A change needs a currency of the fixed list and a positive value; the latest one wins.
    """
    read = changes.withColumn("rate", F.translate("value", ",", ".").try_cast("double"))
    good = F.col("currency").isin(list(DEFAULT_RATES)) & F.coalesce(F.col("rate") > 0, F.lit(False))
    latest = read.where(good).groupBy("currency").agg(F.max_by("rate", "arrival").alias("rate"))
    updated = stored.join(latest, "currency", "full").select(
        "currency", F.coalesce("rate", "rate_to_base").alias("rate_to_base"))
    return updated, read.where(~good).drop("rate")


def convert(rows: DataFrame, rate_table: DataFrame | None = None) -> DataFrame:
    """Adds ``base_amount`` and ``conversion_error`` to rows with ``amount`` and ``currency``.

    The rate table has one row per currency; without one the fixed rates are used in the expression
    itself and nothing is joined.
    """
    if rate_table is None:
        base = money.to_base(F.col("amount"), F.col("currency"))
        return rows.withColumn("_b", base).withColumns(
            {"base_amount": F.col("_b.value"), "conversion_error": F.col("_b.error")}).drop("_b")
    joined = rows.join(rate_table, "currency", "left")
    rate = F.when(F.col("currency") == BASE_CURRENCY, F.lit(1.0)).otherwise(F.col("rate_to_base")).cast("decimal(12,4)")
    return joined.withColumn("_b", money.to_base(F.col("amount"), F.col("currency"), rate)).withColumns(
        {"base_amount": F.col("_b.value"), "conversion_error": F.col("_b.error")}).drop("_b", "rate_to_base")


def display_rates(rate_table: DataFrame) -> DataFrame:
    return rate_table.select(
        F.concat("currency", F.lit(f"_TO_{BASE_CURRENCY}")).alias("rate_key"),
        money.format_rate(F.col("rate_to_base")).alias("rate_text"))
