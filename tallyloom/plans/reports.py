"""Monthly reports: income, expenses with bank rows, summary and data alerts.

Amounts stay numeric; a dollar row carries ``fx_warning`` because its base total depends on the rate.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.fixed_values import (BASE_CURRENCY, EXPENSE_COLUMNS, FEE_LIMIT, INCOME_COLUMNS, SUSPICIOUS_BELOW)
from tallyloom.functions import money, names
from tallyloom.functions.money import blank_to_null
from tallyloom.operators import ledger
from tallyloom.operators.statements import debit_rows

AMOUNT_COLUMNS = ["amount", "total_bgn", "total_eur"]


def _mentions(word: str, *columns: str) -> Column:
    return F.upper(F.concat_ws(" ", *columns)).contains(word)


def invoice_items(invoices: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Report rows of invoices: supplier master first, then the invoice, then the default."""
    kind = F.coalesce(blank_to_null(F.col("supplier_type")), blank_to_null(F.col("transaction_type")),
                      F.when(ledger.is_income(), "INCOME").otherwise("EXPENSES with VAT"))
    text = F.coalesce(blank_to_null(F.col("description")), blank_to_null(F.col("notes")), F.lit(""))
    code = F.coalesce(F.upper("currency"), F.lit(BASE_CURRENCY))
    dollar, lev = code.isin("USD", "$"), code.isin("BGN", "BG", "G")
    return ledger.enrich(invoices, suppliers).select(
        F.when(ledger.is_income(), "INCOME").otherwise("EXPENSES").alias("sheet"),
        "date", F.coalesce("invoice_number", F.lit("")).alias("invoice_number"),
        F.coalesce("transactor", F.lit("")).alias("transactor"),
        F.when(text == "0", "").otherwise(text).alias("description"),
        names.join_categories(F.col("supplier_categories"), F.col("supplier_category")).alias("expense_category"),
        kind.alias("kind_of_transaction"),
        F.when(dollar, F.col("amount")).alias("amount"),
        F.when(F.col("vat") != 0, F.col("vat")).alias("vat"),
        F.when(lev, F.col("total_base")).alias("total_bgn"),
        F.when(~lev, F.col("total_base")).alias("total_eur"),
        F.when(lev, "BG").otherwise("EU").alias("currency"),
        F.when(_mentions("PAYPAL", "description", "notes"), "PAYPAL").otherwise("supplier").alias("payment_method"),
        (dollar & (F.col("total_base") > 0)).alias("fx_warning"),
        F.col("total_base").alias("total"),
    )


def bank_items(transactions: DataFrame, fee_limit: float = FEE_LIMIT) -> DataFrame:
    """Outgoing bank rows as expense rows: fees to the bank, everything else to its payee."""
    rows = debit_rows(transactions)
    payee = F.col("payee") if "payee" in rows.columns else F.lit(None).cast("string")
    rows = rows.withColumn("payee", F.coalesce(payee, F.lit("")))
    fee = (
        _mentions("BANK FEE", "reference") | (_mentions("FEE", "payee") & _mentions("BANK", "payee"))
        | _mentions("BANK FEE", "description") | _mentions("COMMISSION", "description") | (F.col("debit") <= fee_limit)
    )
    to = F.coalesce(blank_to_null(F.col("payee")), blank_to_null(F.col("reference")), F.lit("Unknown Payee"))
    nothing = F.lit(None).cast(money.MONEY)
    return rows.select(
        F.lit("EXPENSES").alias("sheet"), "date", F.lit("").alias("invoice_number"),
        F.when(fee, "BANK").otherwise(to).alias("transactor"), F.lit("").alias("description"),
        F.lit("").alias("expense_category"), F.when(fee, "BANK FEES").otherwise("PAYMENT").alias("kind_of_transaction"),
        nothing.alias("amount"), nothing.alias("vat"), nothing.alias("total_bgn"), F.col("debit").alias("total_eur"),
        F.lit("EU").alias("currency"),
        F.when(_mentions("PAYPAL", "reference", "payee", "description"), "PAYPAL").otherwise("BANK").alias("payment_method"),
        F.lit(False).alias("fx_warning"), F.col("debit").alias("total"))


def in_month(items: DataFrame, year: int, month: int, include_undated: bool = False) -> DataFrame:
    """Rows of one month; undated rows count, on request, as of its first day, in sheets and sums alike."""
    first = dt.date(year, month, 1)
    if include_undated:
        items = items.withColumn("date", F.coalesce(F.col("date"), F.lit(first)))
    return items.where(F.col("date").between(F.lit(first), F.last_day(F.lit(first))))


def combine(items: DataFrame, bank: DataFrame) -> DataFrame:
    """Invoice rows and the bank rows that are not among the expenses yet.

    Amounts have two decimals, so "within less than a cent" is equality and the duplicate test is an
    equi-join on date, payee and amount.
    """
    spent = items.where("sheet = 'EXPENSES'").select("date", "transactor", "total")
    return items.unionByName(bank.join(spent, ["date", "transactor", "total"], "left_anti"))


def _sums() -> list[Column]:
    income = F.coalesce(F.sum(F.when(F.col("sheet") == "INCOME", F.col("total"))), F.lit(0).cast(money.MONEY))
    spent = F.coalesce(F.sum(F.when(F.col("sheet") == "EXPENSES", F.col("total"))), F.lit(0).cast(money.MONEY))
    return [income.alias("income"), spent.alias("expenses"), (income - spent).alias("net")]


def summary(items: DataFrame) -> DataFrame:
    """Income, expenses and net in the base currency; ``level`` tells months from year totals and the grand total.

    Undated rows are a month and a year of their own (null).
    """
    level = F.when(F.grouping_id() == 0, "month").when(F.grouping_id() == 1, "year").otherwise("all")
    return items.rollup(F.year("date").alias("year"), F.month("date").alias("month")).agg(level.alias("level"), *_sums())


def month_summary(items: DataFrame) -> DataFrame:
    """The sums of the months that the items lie in."""
    return items.groupBy(F.year("date").alias("year"), F.month("date").alias("month")).agg(*_sums())


def alerts(items: DataFrame, columns: list[str] = AMOUNT_COLUMNS) -> DataFrame:
    """One row per suspicious cell: an amount of zero, below a cent or negative."""
    cells = items.unpivot(["sheet", "date", "transactor", "invoice_number"],
                          [F.col(c).cast("string").alias(c) for c in columns], "field", "text")
    value = money.parse_flagged(F.col("text"))
    return cells.withColumn("value", value).where(F.col("value") < SUSPICIOUS_BELOW).select(
        "sheet", "transactor", "invoice_number", "field", "value",
        F.format_string("REVIEW NEEDED: Suspicious amount value '%s' for %s (Invoice: %s, Column: %s)",
                        F.format_string("%.2f", "value"), "transactor", "invoice_number", "field").alias("alert"))


def ordered(items: DataFrame, columns: list[str]) -> DataFrame:
    """Rows by real date with exactly the given columns; a missing column becomes empty."""
    absent = {c: F.lit(None).cast("string") for c in columns if c not in items.columns}
    filled = items.withColumns(absent) if absent else items
    return filled.orderBy("date", "invoice_number", "transactor", "total").select(*columns)


def comprehensive_report(invoices: DataFrame, suppliers: DataFrame, year: int, month: int,
                         transactions: DataFrame | None = None, include_undated: bool = False) -> dict[str, DataFrame]:
    """The four sheets of one month's report."""
    items = in_month(invoice_items(invoices, suppliers), year, month, include_undated)
    if transactions is not None:
        items = combine(items, in_month(bank_items(transactions), year, month))
    return {
        "INCOME": ordered(items.where("sheet = 'INCOME'"), INCOME_COLUMNS),
        "EXPENSES": ordered(items.where("sheet = 'EXPENSES'"), EXPENSE_COLUMNS),
        "SUMMARY": month_summary(items),
        "DATA ALERTS": alerts(items),
    }


def classify_income(invoices: DataFrame) -> DataFrame:
    """Adds ``kind`` (own transaction type, else the one of the raw reply) and ``is_income_kind``."""
    kind = F.coalesce(blank_to_null(F.col("transaction_type")),
                      F.get_json_object("raw_extraction", "$['Kind of Transaction']"), F.lit(""))
    return invoices.withColumn("kind", kind).withColumn(
        "is_income_kind", F.upper("kind").rlike("INCOME|COLLECTION|SALES"))


def _raw(key: str) -> Column:
    return blank_to_null(F.get_json_object("raw_extraction", f"$['{key}']"))


def four_fields(invoices: DataFrame, suppliers: DataFrame | None = None) -> DataFrame:
    """Supplier name, category, transaction type and VAT number of each invoice, raw reply as fallback."""
    rows = ledger.enrich(invoices, suppliers) if suppliers is not None else invoices.withColumns({
        "supplier_category": F.lit(None).cast("string"), "supplier_categories": F.lit(None).cast("array<string>"),
        "supplier_vat": F.lit(None).cast("string")})
    listed = names.join_categories(F.col("supplier_categories"), F.col("supplier_category"))
    return classify_income(rows).select(
        "id", F.coalesce(blank_to_null(F.col("transactor")), _raw("Transactor"), F.lit("")).alias("supplier_name"),
        F.coalesce(F.nullif(listed, F.lit("")), _raw("Expense Category Account"), F.lit("")).alias("service_category"),
        F.col("kind").alias("transaction_type"),
        F.coalesce(blank_to_null(F.col("supplier_vat")), F.lit("")).alias("vat_number"))


def extraction_fields(rows: DataFrame) -> DataFrame:
    """The four fields of rows that carry their own attributes, such as suppliers or extraction results.

    Categories come from the list, else from the single one, else from the raw reply; name and type from the row, else from the raw
    reply; the VAT number is the row's, else its tax amount. Columns that ``rows`` lacks count as empty; an ``id`` stays.
    """
    def own(name: str, kind: str = "string") -> Column:
        return F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)

    def raw(key: str) -> Column:
        if "raw_extraction" not in rows.columns:
            return F.lit(None).cast("string")
        if rows.schema["raw_extraction"].dataType.simpleString().startswith("map"):
            return blank_to_null(F.try_element_at("raw_extraction", F.lit(key)))
        return _raw(key)
    listed = names.join_categories(own("categories", "array<string>"), own("category"))
    return rows.select(
        *[c for c in ("id",) if c in rows.columns],
        F.coalesce(blank_to_null(own("supplier_name")), raw("Transactor"), F.lit("")).alias("supplier_name"),
        F.coalesce(blank_to_null(listed), raw("Expense Category Account"), F.lit("")).alias("service_category"),
        F.coalesce(blank_to_null(own("transaction_type")), raw("Kind of Transaction"), F.lit("")).alias("transaction_type"),
        F.coalesce(blank_to_null(own("vat_number")), own("tax_amount"), F.lit("")).alias("vat_number"))


supplier_fields = extraction_fields


def monthly_report(invoices: DataFrame) -> dict[str, DataFrame]:
    """Income and expense sheets by transaction kind, base-currency totals and alerts on income amounts."""
    rows = classify_income(invoices)
    total = money.gross(F.col("amount"), F.col("vat"))
    income = rows.where("is_income_kind").select(
        "id", "date", F.coalesce(_raw("Kind of Transaction"), "kind").alias("kind_of_transaction"),
        F.coalesce(_raw("Transactor"), "transactor").alias("transactor"), "description",
        F.lit("Invoice").alias("kind_of_document"), "invoice_number", F.col("amount").alias("net_amount"), "vat",
        total.alias("total_amount"), F.lit(None).cast("string").alias("payment"), F.col("notes").alias("information"))
    spent = four_fields(rows.where(~F.col("is_income_kind")).drop("kind", "is_income_kind"))
    sums = rows.groupBy(F.trunc("date", "month").alias("month_start")).agg(
        F.coalesce(F.sum(F.when(F.col("is_income_kind"), F.col("total_base"))), F.lit(0).cast(money.MONEY)).alias("income"),
        F.coalesce(F.sum(F.when(~F.col("is_income_kind"), F.col("total_base"))), F.lit(0).cast(money.MONEY)).alias("expenses"),
    ).withColumn("net", F.col("income") - F.col("expenses"))
    shown = income.withColumn("sheet", F.lit("INCOME AND COLLECTIONS"))
    return {"INCOME AND COLLECTIONS": income, "EXPENSES AND PAYMENTS": spent, "SUMMARY": sums,
            "DATA ALERTS": alerts(shown, ["net_amount", "vat", "total_amount"])}


def add_unseen(current: DataFrame, session_rows: DataFrame) -> DataFrame:
    """Current rows and the session rows whose invoice number is not among them; rows without one stay."""
    known = current.where(blank_to_null(F.col("invoice_number")).isNotNull()).select("invoice_number").distinct()
    return current.unionByName(session_rows.join(known, "invoice_number", "left_anti"), allowMissingColumns=True)


def display_ledger(invoices: DataFrame) -> DataFrame:
    """Full ledger export: every column and the whole texts, dates written out and amounts grouped."""
    return invoices.select("id", *[
        F.date_format("date", "yyyy-MM-dd").alias("date") if c == "date"
        else F.format_number(c, 2).alias(c) if c in ("amount", "vat", "total_base")
        else F.coalesce(c, F.lit("")).alias(c) if c == "description" else F.col(c)
        for c in ledger.FIELDS])
