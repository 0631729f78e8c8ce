"""Bank transaction to invoice matching.

Rule (points summed in this order): amount up to 0.55, date up to 0.20, supplier name up to 0.15,
invoice number 0.10; a pair needs 0.30. Money out is compared with expense invoices, money in with
income invoices, and only a transaction without any match there is compared with the other
direction. The highest score wins; equal scores go to the later invoice date, then to the nearer
amount, then to the smaller id. One invoice may settle many transactions.

Plan. No pair of a transaction and all invoices in its band is ever built:

* Text evidence depends only on the distinct text, so supplier names and invoice numbers are found
  once per distinct text by an equi-join (``text_evidence``). Every piece of evidence becomes an *evidence
  group* (all invoices, those of some names, those of a frequent number, or both) with its bonus. The few
  invoices of a rare number are scored one by one.
* Inside one group and one invoice day, the date points are fixed and the amount points only fall
  with the distance of the amounts. So just two invoices can win: the nearest at or above and the
  nearest below. Outside the date tolerance at most four days can win.
* These lookups are answered in one sorted pass (``match_index``): around the days of all questions, and at any
  date only for what that leaves open. The other direction is asked for what has no match after that.

Statement and ledger are written once and read from there; so are texts, questions and answers.
No join of sides that grow sends one through the driver (``joins.meet``).
Equal invoices of large groups (group, day, amount) are collapsed first, so hot amounts do not multiply.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.functions import dates, money
from tallyloom.fixed_values import BASE_CURRENCY
from tallyloom.operators import text_evidence
from tallyloom.operators.containment import two_numbers
from tallyloom.operators.joins import meet
from tallyloom.operators.match_index import BANDED, NO_DAY, QUESTION, Rule, amount_blocks, best_answers, best_of_each, in_amount_blocks, without_answer
from tallyloom.session import durable

UNITS = 10_000  # amounts are compared as whole 1/10,000 units of the bank currency
THRESHOLD = 0.30
EVERY = 0  # both numbers of the group of all invoices
ROW = "__row"  # numbers the rows of the statement


def _floor_ratio(value: str, num: int, den: int) -> Column:
    """floor(value * num / den) in whole-number arithmetic that cannot overflow on the way."""
    rest = f"pmod({value}, {den}L)"
    return F.expr(f"(({value} - {rest}) div {den}L) * {num}L + ({rest} * {num}L) div {den}L")


def _bounds(tolerance_bp: int) -> dict[str, Column]:
    """Inclusive ranges of the invoice amount for each amount tier of a transaction amount ``t``."""
    debit = F.col("is_debit")

    def up(num: int, den: int) -> Column:
        return -_floor_ratio("(-t)", num, den)

    def down(num: int, den: int) -> Column:
        return _floor_ratio("t", num, den)

    credit_low = up(100, 102)
    return {
        "exact_lo": F.when(debit, up(1000, 1005)).otherwise(credit_low),
        "exact_hi": down(1000, 995),
        "close_lo": F.when(debit, up(100, 105)).otherwise(credit_low),
        "close_hi": down(100, 95),
        "approx_lo": F.when(debit, F.greatest(up(100, 110), up(10_000, 10_000 + tolerance_bp)))
        .otherwise(credit_low),
        "approx_hi": down(10_000, 10_000 - tolerance_bp),
    }


def with_bounds(df: DataFrame, tolerance: float) -> DataFrame:
    """Adds the tier ranges of ``t`` as columns, so later expressions read them instead of repeating them."""
    return df.withColumns(_bounds(round(tolerance * 10_000)))


def amount_points(c: Column, tolerance: float) -> Column:
    """Amount points of an invoice amount ``c`` against the transaction in the same row."""
    away = F.abs(c - F.col("t")).cast("double") / c.cast("double")
    decay = F.lit(0.45) - ((away - F.lit(0.05)) / F.lit(tolerance - 0.05)) * F.lit(0.25) \
        if tolerance > 0.05 else F.lit(0.0)
    return (
        F.when(c.between(F.col("exact_lo"), F.col("exact_hi")), F.lit(0.55))
        .when(c.between(F.col("close_lo"), F.col("close_hi")), F.lit(0.50))
        .when(c.between(F.col("approx_lo"), F.col("approx_hi")), decay)
        .otherwise(F.lit(0.0))
    )


def prepare_invoices(invoices: DataFrame, bank_currency: str, rates: DataFrame | None = None) -> DataFrame:
    """Usable invoices with their gross amount in the bank currency; invoices without a rate drop out."""
    code = F.coalesce(F.upper(money.blank_to_null(F.col("currency"))), F.lit(bank_currency))
    inv = invoices.withColumn("code", code).withColumn("gross", money.gross(F.col("amount"), F.col("vat")))
    if rates is None:
        rate, bank_rate = money.default_rate(F.col("code")), money.default_rate(F.lit(bank_currency))
    else:
        inv = inv.join(rates.select(F.col("currency").alias("code"), F.col("rate_to_base").alias("rate")),
                       "code", "left")
        rate = F.when(F.col("code") == BASE_CURRENCY, F.lit(1)).otherwise(F.col("rate")).cast("decimal(12,4)")
        bank_rate = rates.where(F.col("currency") == bank_currency).agg(F.max("rate_to_base")).scalar()
        bank_rate = F.when(F.lit(bank_currency) == BASE_CURRENCY, F.lit(1)).otherwise(bank_rate)
        bank_rate = bank_rate.cast("decimal(12,4)")
    in_base = (F.col("gross") * rate).cast(money.EXACT)
    converted = (
        F.when(F.col("code") == bank_currency, F.col("gross").cast(money.EXACT))
        .when(F.lit(bank_currency) == BASE_CURRENCY, in_base)
        .otherwise(F.try_divide(in_base, bank_rate).cast(money.EXACT))
    )
    return (
        inv.withColumn("converted", converted)
        .where((F.col("gross") > 0) & (F.col("converted") > 0))
        .select(
            "id", "invoice_number", "transactor", "currency", "amount", "vat", "gross", "converted",
            F.coalesce(F.col("is_income"), F.lit(False)).alias("is_income"),
            (F.col("converted") * UNITS).cast("long").alias("c"),
            F.coalesce(F.unix_date("date"), F.lit(NO_DAY)).alias("day"),
            F.lower(F.coalesce(F.trim("transactor"), F.lit(""))).alias("name"),
            F.lower(F.coalesce(F.trim("invoice_number"), F.lit(""))).alias("number"),
        )
    )


def prepare_transactions(txns: DataFrame, keep: Sequence[Column | str]) -> DataFrame:
    """Direction, amount, day and search text of each transaction, beside the columns ``keep``; credit wins. ``t`` is null or positive."""
    credit, debit = F.coalesce(F.col("credit"), F.lit(0)), F.coalesce(F.col("debit"), F.lit(0))
    value = F.when(credit > 0, credit).when(debit > 0, debit)
    text = F.lower(F.concat_ws(" ", F.coalesce("description", F.lit("")), F.coalesce("reference", F.lit(""))))
    t = (value * UNITS).cast("long")
    return txns.select(
        *keep,
        (~(credit > 0)).alias("is_debit"),
        F.when(t > 0, t).alias("t"),
        F.coalesce(F.unix_date("date"), F.lit(NO_DAY)).alias("day"),
        text.alias("text"),
    )


def _every(txns: DataFrame) -> DataFrame:
    """``QUESTION`` without its direction: each transaction asks all invoices."""
    zero, no_points = F.lit(EVERY).cast("long"), F.lit(0.0)
    return txns.select("rid", "is_debit", "t", "day", zero.alias("g1"), zero.alias("g2"), F.lit(BANDED).alias("mode"),
                       no_points.alias("name_points"), no_points.alias("number_points"))


def _direct(found: DataFrame, rule: Rule) -> DataFrame:
    """(rid, score, inv_day, nearness, neg_id) of the accepted pairs of a transaction and an invoice whose number its text holds."""
    rows = found.select("rid", "is_debit", "t", "day", "name_points", "number_points", "invoice.c", F.col("invoice.day").alias("inv_day"), "invoice.id")
    known = (F.col("day") != NO_DAY) & (F.col("inv_day") != NO_DAY)
    on_date = F.when(known, dates.date_points(F.col("day") - F.col("inv_day"), rule.days)).otherwise(F.lit(0.0))
    score = amount_points(F.col("c"), rule.amount) + on_date + F.col("name_points") + F.col("number_points")
    return with_bounds(rows, rule.amount).withColumn("score", score).where(F.col("score") >= rule.threshold).select(
        "rid", "score", "inv_day", (-F.abs(F.col("c") - F.col("t"))).alias("nearness"), (-F.col("id")).alias("neg_id"))


def match_transactions(
    statement: DataFrame,
    invoices: DataFrame,
    key: Sequence[str] = ("file", "row_no"),
    bank_currency: str = BASE_CURRENCY,
    date_tolerance_days: int = 30,
    amount_tolerance_pct: float = 0.15,
    rates: DataFrame | None = None,
) -> DataFrame:
    """The statement with the seven match columns; ``key`` names the columns that identify a row.

    A key that repeats among the rows to match raises an error.
    """
    if not 0 < amount_tolerance_pct < 1:
        raise ValueError("amount_tolerance_pct must lie between 0 and 1")
    inv = durable(prepare_invoices(invoices, bank_currency, rates))
    lines = durable(statement.withColumn(ROW, F.monotonically_increasing_id()))
    named = [f"__key{i}" for i, _ in enumerate(key)]
    txns = prepare_transactions(lines, [F.col(ROW).alias("rid"), *[F.col(f"`{k}`").alias(n) for k, n in zip(key, named)]]).where(
        F.col("t").isNotNull())
    if txns.groupBy(*named).count().where("count > 1").limit(1).count():
        raise ValueError(f"{', '.join(key)} must identify the rows of the statement")
    names = text_evidence.names_of(inv)
    texts = text_evidence.texts_of(txns, inv, names)
    evidence, members = text_evidence.evidence(texts, names)
    asking = txns.select("rid", "is_debit", "t", "day", *two_numbers(F.col("text"), "t"))
    told = durable(meet(asking, evidence, text_evidence.TEXT).drop(*text_evidence.TEXT))
    frequent = texts.select(F.inline("frequent")).distinct()
    frequent = frequent if frequent.limit(1).count() else None
    rule = Rule(date_tolerance_days, amount_tolerance_pct, THRESHOLD)

    def points(asked: DataFrame) -> DataFrame:
        every = (F.col("g1") == EVERY) & (F.col("g2") == EVERY)
        blocks = amount_blocks(asked.where(every))
        zero = F.lit(EVERY).cast("long")
        all_of = inv.where(in_amount_blocks(blocks, amount_tolerance_pct)).select(
            "is_income", zero.alias("g1"), zero.alias("g2"), F.lit(BANDED).alias("mode"), "day", "c", F.col("id").alias("p"))
        small, large = text_evidence.group_points(inv, members, asked.where(~every).select("g1", "g2").distinct(), frequent)
        point = ["is_income", "g1", "g2", "mode", "day", "c"]
        return small.unionByName(all_of.groupBy(*point).agg(F.min("p").alias("p"))).unionByName(large.groupBy(*point).agg(F.min("p").alias("p")))

    def found(txns: DataFrame, told: DataFrame, is_income: Column) -> DataFrame:
        """(rid, id): the best invoice of one direction for each transaction that has one."""
        asked = _every(txns).unionByName(told.where("invoice is null").drop("invoice")).withColumn("is_income", is_income).select(*QUESTION)
        return best_of_each(best_answers(points, asked, rule).unionByName(_direct(told.where(F.col("invoice.is_income") == is_income), rule)))

    first = found(txns, told, ~F.col("is_debit"))
    # The other direction counts only where this one has nothing.
    left = without_answer(txns.select("rid", "is_debit", "t", "day"), first)
    if left is not None:
        first = first.unionByName(found(left, meet(told, left.select("rid"), "rid", "left_semi"), F.col("is_debit")))
    given = [*key, *[c for c in statement.columns if c not in key]]
    return _describe(given, lines, first, inv, bank_currency, date_tolerance_days, amount_tolerance_pct)


def _describe(given: Sequence[str], lines: DataFrame, found: DataFrame, inv: DataFrame, bank_currency: str,
              tolerance_days: int, tolerance: float) -> DataFrame:
    """The statement's columns ``given``; re-scores the winning pairs from the plain rule and writes the match columns."""
    hidden = {c: f"__given{i}" for i, c in enumerate(given)}
    rows = prepare_transactions(lines, [F.col(ROW).alias("rid"), *[F.col(f"`{c}`").alias(h) for c, h in hidden.items()]])
    pair = meet(meet(rows, found, "rid", "left"), inv.withColumnRenamed("day", "inv_day"), "id", "left")
    pair = with_bounds(pair, tolerance)
    known = (F.col("day") != NO_DAY) & (F.col("inv_day") != NO_DAY)
    on_date = F.when(known, dates.date_points(F.col("day") - F.col("inv_day"), tolerance_days)).otherwise(F.lit(0.0))
    on_amount = amount_points(F.col("c"), tolerance)
    words = text_evidence.long_words(F.col("name"))
    shared = F.size(F.filter(words, lambda w: F.contains(F.col("text"), w)))
    full_name = (F.col("name") != "") & F.contains("text", "name")
    part = F.when(shared > 0, F.lit(0.08) * (shared / F.size(words))).otherwise(F.lit(0.0))
    on_name = F.when(full_name, F.lit(0.15)).otherwise(part)
    has_number = (F.length("number") > 2) & F.contains("text", "number")
    score = on_amount + on_date + on_name + F.when(has_number, F.lit(0.10)).otherwise(F.lit(0.0))
    method = F.array_join(F.array_compact(F.array(
        F.when(on_amount == 0.55, "exact_amount").when(on_amount == 0.50, "close_amount")
        .when(F.col("c").between(F.col("approx_lo"), F.col("approx_hi")), "approx_amount"),
        F.when(on_date > 0, "date_proximity"),
        F.when(full_name, "supplier_name").when(part > 0, "partial_name"),
        F.when(has_number, "invoice_number"),
    )), "+")
    pct = (F.col("c") - F.col("t")).cast("double") / F.col("c").cast("double") * 100
    bank = (F.col("t").cast(money.EXACT) / UNITS).cast(money.MONEY)
    details = F.concat(
        F.lit("Invoice "), F.coalesce("invoice_number", F.lit("N/A")), F.lit(": "),
        F.col("gross").cast("string"), F.lit(" "), F.coalesce(F.upper("currency"), F.lit(bank_currency)),
        F.lit(" (net "), F.coalesce(F.col("amount"), F.lit(0).cast(money.MONEY)).cast("string"),
        F.lit(" + VAT "), F.coalesce(F.col("vat"), F.lit(0).cast(money.MONEY)).cast("string"), F.lit(") = "),
        F.format_number(F.col("converted").cast(money.MONEY), 2), F.lit(f" {bank_currency}, bank: "),
        F.format_number(bank, 2), F.lit(f" {bank_currency} (diff: "), F.format_string("%.1f", pct), F.lit("%)"),
    )
    matched = F.col("id").isNotNull()
    return pair.select(
        *[F.col(h).alias(c) for c, h in hidden.items()],
        F.col("transactor").alias("matched_supplier"),
        F.col("invoice_number").alias("matched_invoice_number"),
        F.when(matched, F.bround(score * 100).cast("int")).otherwise(0).alias("match_confidence"),
        F.when(matched, method).alias("match_method"),
        F.col("converted").cast(money.MONEY).alias("converted_invoice_amount"),
        F.round(pct, 1).alias("amount_difference_pct"),
        F.when(matched, details).alias("match_details"),
        F.col("id").alias("matched_invoice_id"),
    )


def match_stats(matched: DataFrame) -> DataFrame:
    """Per statement file: rows, matched rows, match rate text and mean confidence of the matched rows."""
    hit = F.col("matched_invoice_id").isNotNull()
    return matched.groupBy("file").agg(
        F.count("*").alias("total"),
        F.count_if(hit).alias("matched"),
        F.concat(F.format_string("%.0f", F.count_if(hit) * 100.0 / F.count("*")), F.lit("%")).alias("match_rate"),
        F.coalesce(F.floor(F.avg(F.when(hit, F.col("match_confidence")))), F.lit(0)).cast("int")
        .alias("avg_confidence"),
    )
