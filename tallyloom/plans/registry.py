"""Every operator as a named query over the given tables.

Results are projected to plain types (amounts as double, dates and lists as text) for comparison.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.functions import dates, money, names, replies
from tallyloom.operators import currency, evaluation, extraction, ledger, reconcile, statements
from tallyloom.operators import suppliers as supplier_ops
from tallyloom.plans import reports
from tallyloom.session import durable, shared_folder
from tallyloom.sources import files, ledger_table, quoted, sinks, tables
from tallyloom.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
AS_OF = "2002-01-01"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def plain(df: DataFrame) -> DataFrame:
    """Decimals as double, dates as text, arrays of text joined."""
    out: list[Column] = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        if kind.startswith("decimal"):
            c = c.cast("double")
        elif kind == "date":
            # Spark writes a plus before years of five digits.
            c = F.ltrim(F.date_format(c, "yyyy-MM-dd"), F.lit("+"))
        elif kind == "array<string>":
            c = F.array_join(c, "|")
        elif kind == "boolean":
            c = c.cast("int")
        out.append(c.alias(f.name))
    return df.select(*out)


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/tallyloom-run-{uuid.uuid4().hex}"


@query
def reconcile_best_match(spark: SparkSession, d: str) -> DataFrame:
    m = reconcile.match_transactions(tables.bank(spark, d), tables.invoices(spark, d))
    return plain(m.select("file", "row_no", "matched_supplier", "matched_invoice_number", "match_confidence",
                          F.coalesce("match_method", F.lit("")).alias("match_method"),
                          "converted_invoice_amount", "amount_difference_pct"))


@query
def reconcile_stats(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.match_stats(reconcile.match_transactions(tables.bank(spark, d), tables.invoices(spark, d)))


@query
def statement_standardise(spark: SparkSession, d: str) -> DataFrame:
    return plain(statements.standardise(tables.statement_lines(spark, d)))


@query
def header_mapping(spark: SparkSession, d: str) -> DataFrame:
    f = statements.detect_formats(tables.statement_lines(spark, d))
    pairs = F.array_sort(F.transform(F.map_entries("suggested_mapping"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return f.select("file", "detected_format", "header_row", "matched_columns", "confidence", "row_count",
                    F.array_join(pairs, ";").alias("mapping"))


@query
def statement_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Statements with the user's own column mapping; empty rows are dropped."""
    return plain(statements.standardise(tables.overridden_lines(spark, d), tables.overrides(spark, d))).drop("balance", "reference")


@query
def statement_formats(spark: SparkSession, d: str) -> DataFrame:
    """Format names after banks and confidences below one."""
    return statements.detect_formats(tables.overridden_lines(spark, d)).select(
        "file", "detected_format", "header_row", "matched_columns", "confidence", "row_count")


@query
def quoted_records(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a record of a file, whose quoted cell holds the line breaks of the text."""
    folder = scratch(spark)
    tables.write_quoted(tables.read(spark, d, "documents"), folder)
    fields = F.col("fields")
    return quoted.records(spark, folder).select(
        fields[0].cast("long").alias("doc_id"), fields[1].alias("text"), fields[2].alias("source"),
        fields[3].cast("long").alias("n_chars"), F.size("fields").cast("long").alias("n_cells"))


@query
def convert_to_base(spark: SparkSession, d: str) -> DataFrame:
    inv = tables.invoices(spark, d).withColumn("currency", F.when(F.col("id") % 10 == 9, "GBP").otherwise(F.col("currency")))
    shown = money.with_conversions(F.col("amount"), F.col("currency"))
    return plain(currency.convert(inv.select("id", "amount", "currency"), currency.rates(spark)).select(
        "id", "base_amount", "conversion_error", shown["original"]["amount"].alias("original_text"),
        F.try_element_at(shown["converted"], F.lit(1))["amount"].alias("converted_text")))


@query
def parse_and_format_amount(spark: SparkSession, d: str) -> DataFrame:
    """Each amount written in five ways and read back by each parser."""
    inv = tables.invoices(spark, d)
    k, grouped = F.col("id"), F.format_number("amount", 2)
    text = (
        F.when(k % 5 == 0, grouped).when(k % 5 == 1, F.translate(grouped, ",.", ".,"))
        .when(k % 5 == 2, F.concat(F.lit("("), F.col("amount").cast("string"), F.lit(")")))
        .when(k % 5 == 3, F.concat(F.lit("€ "), F.translate(F.col("amount").cast("string"), ".", ",")))
        .otherwise("no amount")
    )
    return plain(inv.select(
        "id", money.parse_money(text).alias("parsed"), money.parse_setting(text).alias("setting"),
        money.parse_flagged(text).alias("flagged"), money.format_amount(F.col("amount"), F.col("currency")).alias("shown"),
        money.format_rate(money.default_rate(F.col("currency"))).alias("rate_text")))


@query
def ledger_by_period(spark: SparkSession, d: str) -> DataFrame:
    inv = tables.invoices(spark, d)
    parts = [("expense_month", ledger.view(inv, "expense", 1996, 2)), ("income_year", ledger.view(inv, "income", 1997)),
             ("income_month_only", ledger.view(inv, "income", None, 5)),
             ("range", ledger.between(inv, dt.date(1998, 1, 1), dt.date(1998, 3, 31))),
             ("bad_month", ledger.by_month(inv, 1996, 13))]
    out = None
    for name, df in parts:
        rows = df.select(F.lit(name).alias("view"), "id", "date", "invoice_number", "total_base")
        out = rows if out is None else out.unionByName(rows)
    return plain(out)


@query
def ledger_years(spark: SparkSession, d: str) -> DataFrame:
    return ledger.years(tables.invoices(spark, d))


@query
def invoice_search(spark: SparkSession, d: str) -> DataFrame:
    inv = tables.invoices(spark, d)
    rows = ledger.find_by_number(inv, "v-0000007").select("id", F.lit("number").alias("how")).unionByName(
        ledger.by_transactor(inv, "Customer#000000007 Trading").select("id", F.lit("transactor").alias("how"))).unionByName(
        supplier_ops.search(tables.suppliers(spark, d), "asia").select(F.col("arrival").alias("id"), F.lit("supplier").alias("how")))
    return rows


@query
def amount_proximity(spark: SparkSession, d: str) -> DataFrame:
    """Invoices near any bank amount, and near one given amount."""
    inv = tables.invoices(spark, d)
    targets = tables.bank(spark, d).select(F.coalesce("debit", "credit").alias("target"))
    bulk = ledger.near_amounts(inv, targets, 5.0).select("id", F.col("target").cast("double").alias("target"))
    return bulk.unionByName(ledger.near_amount(inv, 250000.0, 100.0).select("id", F.lit(250000.0).alias("target")))


@query
def amount_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """For each bank amount how many invoices lie within five units, and which three are nearest."""
    inv = durable(tables.invoices(spark, d).select("id", "amount", "total_base"))
    targets = durable(tables.bank(spark, d).select(F.coalesce("debit", "credit").alias("target")).distinct())
    counts = ledger.near_counts(inv, targets, 5.0).select("target", F.lit("count").alias("what"), "n")
    nearest = ledger.near_amounts(inv, targets, 5.0, nearest=3).select("target", F.lit("id").alias("what"), F.col("id").alias("n"))
    return plain(counts.unionByName(nearest))


@query
def supplier_enrich(spark: SparkSession, d: str) -> DataFrame:
    return plain(ledger.detail(tables.invoices(spark, d), tables.suppliers(spark, d)).select(
        "id", "description", "transaction_type", "account_description", "expense_category", "vat_number", "total_amount",
        F.col("total.original.amount").alias("total_text")))


@query
def supplier_by_category(spark: SparkSession, d: str) -> DataFrame:
    s = tables.suppliers(spark, d)
    return supplier_ops.by_category(s, "MACHINERY").select("arrival", F.lit("category").alias("how")).unionByName(
        supplier_ops.by_transaction_type(s, "EXP. VIES").select("arrival", F.lit("type").alias("how"))).unionByName(
        supplier_ops.lookup(s, "customer#000000004_trading").select("arrival", F.lit("name").alias("how")))


@query
def supplier_upsert(spark: SparkSession, d: str) -> DataFrame:
    return plain(supplier_ops.upsert(tables.suppliers(spark, d), tables.incoming_suppliers(spark, d)).select(
        "name_key", "supplier_name", "transaction_type", "vat_number", "category", "categories", "is_new", "vat_filled"))


@query
def supplier_changes(spark: SparkSession, d: str) -> DataFrame:
    """Edit form for the suppliers of some nations, then a deletion by name."""
    s = tables.suppliers(spark, d)
    form = tables.incoming_suppliers(spark, d).where(F.col("category") > "NATION_2").select(
        "supplier_name", "category", "transaction_type", "vat_number",
        F.array(F.lit("Extra"), F.col("category"), F.lit("")).alias("additional_categories"))
    gone = tables.incoming_suppliers(spark, d).where(F.col("category") == "NATION_7")
    return plain(supplier_ops.delete(supplier_ops.merge_form(s, form).drop("name_key"), gone).select(
        "arrival", "category", "categories", "transaction_type", "vat_number"))


@query
def supplier_import(spark: SparkSession, d: str) -> DataFrame:
    return supplier_ops.read_sheets(tables.sheet_lines(spark, d)).select(
        F.lower("supplier_name").alias("supplier_name"), "transaction_type", "category")


@query
def supplier_import_stats(spark: SparkSession, d: str) -> DataFrame:
    known = tables.incoming_suppliers(spark, d).select("arrival", F.regexp_replace("supplier_name", " trading$", "").alias("supplier_name"),
                                                       "category", "transaction_type", "vat_number",
                                                       F.array("category").alias("categories"))
    return supplier_ops.import_sheets(known.where(F.col("category") > "NATION_2"), tables.sheet_lines(spark, d))[1]


@query
def invoice_merge(spark: SparkSession, d: str) -> DataFrame:
    """Append, partial update and deletion in a row over the whole ledger."""
    inv = tables.invoices(spark, d)
    s = tables.suppliers(spark, d).withColumn("supplier_name", F.regexp_replace("supplier_name", "  ", " "))
    incoming = inv.select(F.col("id").alias("arrival"), *[c for c in ledger.FIELDS if c != "document_type"])
    grown = inv.unionByName(ledger.append(inv, incoming, s))
    changes = grown.where(~F.col("is_income")).select(
        "id", F.when(F.col("currency") == "EUR", F.lit("edited")).alias("notes"), (F.col("amount") + 1).cast(money.MONEY).alias("amount"))
    updated = ledger.update(grown, changes)
    kept = ledger.delete(updated, grown.where((F.col("currency") == "BGN") & F.col("is_income")).select("id"))
    return plain(kept.select("id", "invoice_number", "amount", "notes",
                             F.coalesce("supplier_id", F.lit(-1)).alias("supplier_id"), "is_income"))


@query
def ledger_month_edits(spark: SparkSession, d: str) -> DataFrame:
    """Edits, moves to another month, deletions and additions on a stored ledger, month by month."""
    root = f"{shared_folder(spark)}/tallyloom/ledger-{uuid.uuid4().hex}"
    inv = tables.invoices(spark, d).select("id", *ledger.FIELDS)
    ledger_table.create(inv, root)
    march = inv.where(F.month("date") == 3).select(
        "id", (F.col("amount") + 1).cast(money.MONEY).alias("amount"), F.lit("edited").alias("notes"),
        F.when(F.col("currency") == "EUR", F.add_months("date", 1)).alias("date"))
    ledger_table.edit(spark, root, march, lambda rows: ledger.update(rows, march))
    gone = inv.where((F.month("date") == 5) & (F.col("currency") == "BGN"))
    ledger_table.edit(spark, root, gone, lambda rows: ledger.delete(rows, gone))
    ledger_table.append(inv.where(F.month("date") == 7).withColumn("id", -F.col("id") - 1), root)
    return plain(ledger_table.read(spark, root).select("id", "date", "amount", "notes"))


@query
def snapshot_export(spark: SparkSession, d: str) -> DataFrame:
    snap = ledger.snapshot(tables.invoices(spark, d), tables.suppliers(spark, d))
    return plain(snap.select("invoice_id", "category", "categories", "transaction_type", "vat_number",
                             F.col("raw_fields")["Kind of Transaction"].alias("raw_kind"), "raw_extraction"))


@query
def extract_json(spark: SparkSession, d: str) -> DataFrame:
    parsed = extraction.parse(tables.extractions(spark, d))
    first = F.try_element_at("records", F.lit(1))
    return parsed.select("doc_id", "stage", F.size("records").alias("records"), first["Transactor"].alias("transactor"),
                         first["Amount"].alias("amount_text"), first["VAT"].alias("vat_text"))


@query
def extraction_first_success(spark: SparkSession, d: str) -> DataFrame:
    return extraction.first_stages(tables.extractions(spark, d), ("auto", "cloud", "local"))


@query
def extraction_to_invoice(spark: SparkSession, d: str) -> DataFrame:
    recs = extraction.records(extraction.first_success(tables.extractions(spark, d)))
    return plain(extraction.invoice_rows(recs, AS_OF).select(
        "doc_id", "date", "invoice_number", "transactor", "amount", "vat", "total_base", "conversion_error", "currency",
        "description"))


@query
def extraction_suppliers(spark: SparkSession, d: str) -> DataFrame:
    recs = extraction.records(extraction.first_success(tables.extractions(spark, d)))
    rows = extraction.apply_known(extraction.supplier_rows(recs), tables.suppliers(spark, d))
    return plain(rows.select("doc_id", "category", "categories", "transaction_type", "vat_number", "is_new", "vat_updated"))


@query
def confidence_merge(spark: SparkSession, d: str) -> DataFrame:
    merged = extraction.merge_passes(extraction.confidences(tables.extractions(spark, d)))
    return merged


@query
def report_expenses(spark: SparkSession, d: str) -> DataFrame:
    items = reports.combine(reports.invoice_items(tables.invoices(spark, d), tables.suppliers(spark, d)),
                            reports.bank_items(tables.bank(spark, d)))
    return plain(items.select("sheet", "date", "invoice_number", "transactor", "description", "expense_category",
                              "kind_of_transaction", "amount", "vat", "total_bgn", "total_eur", "currency",
                              "payment_method", "fx_warning"))


@query
def report_bank_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Expenses and a statement that pays them: rows with the same day, payee and amount are there already."""
    inv = tables.invoices(spark, d)
    paid = ledger.expenses(inv).select(
        "date", (F.col("total_base") + F.when(F.col("id") % 2 == 0, 0).otherwise(1)).cast(money.MONEY).alias("debit"),
        F.lit(None).cast(money.MONEY).alias("credit"), F.col("transactor").alias("payee"), F.lit("").alias("reference"),
        F.lit("").alias("description"))
    items = reports.combine(reports.invoice_items(inv, tables.suppliers(spark, d)), reports.bank_items(paid))
    return plain(items.select("sheet", "date", "invoice_number", "transactor", "total"))


@query
def report_summary(spark: SparkSession, d: str) -> DataFrame:
    items = reports.combine(reports.invoice_items(tables.invoices(spark, d), tables.suppliers(spark, d)),
                            reports.bank_items(tables.bank(spark, d)))
    return plain(reports.summary(items)).select(
        F.coalesce("year", F.lit(0)).alias("year"), F.coalesce("month", F.lit(0)).alias("month"), "level", "income", "expenses", "net")


@query
def report_month(spark: SparkSession, d: str) -> DataFrame:
    """One month's expense sheet as a user would ask for it."""
    sheets = reports.comprehensive_report(tables.invoices(spark, d), tables.suppliers(spark, d), 1997, 3, tables.bank(spark, d))
    return plain(sheets["EXPENSES"]).select("date", "invoice_number", "transactor", "kind_of_transaction", "total_bgn", "total_eur", "payment_method")


@query
def report_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Alerts over event values read as amounts, so that some cells really are near zero."""
    inv = tables.read(spark, d, "events").select(
        F.lit("EXPENSES").alias("sheet"), F.col("ts").cast("date").alias("date"), F.col("event_type").alias("transactor"),
        F.col("event_id").cast("string").alias("invoice_number"), (F.col("value").cast(money.MONEY) - 1).cast(money.MONEY).alias("amount"),
        F.lit(None).cast(money.MONEY).alias("total_bgn"), F.col("value").cast(money.MONEY).alias("total_eur"))
    return reports.alerts(inv)


@query
def monthly_report(spark: SparkSession, d: str) -> DataFrame:
    return plain(reports.monthly_report(tables.invoices(spark, d))["SUMMARY"])


@query
def monthly_income_sheet(spark: SparkSession, d: str) -> DataFrame:
    return plain(reports.monthly_report(tables.invoices(spark, d))["INCOME AND COLLECTIONS"].select(
        "id", "date", "kind_of_transaction", "transactor", "net_amount", "vat", "total_amount"))


@query
def four_field_export(spark: SparkSession, d: str) -> DataFrame:
    return reports.four_fields(tables.invoices(spark, d), tables.suppliers(spark, d))


@query
def extraction_four_fields(spark: SparkSession, d: str) -> DataFrame:
    """The four fields of extraction rows, with what is missing taken from the raw reply."""
    k = F.col("id")
    rows = tables.invoices(spark, d).select(
        "id", F.when(k % 3 != 0, F.col("transactor")).otherwise("").alias("supplier_name"),
        F.when(k % 4 == 0, F.array(F.lit("A"), F.lit("B"))).alias("categories"), F.when(k % 4 == 1, "Single").alias("category"),
        F.when(k % 5 < 2, F.col("transaction_type")).alias("transaction_type"),
        F.when(k % 2 == 0, F.concat(F.lit("VAT"), k.cast("string"))).alias("vat_number"),
        F.when(k % 7 != 0, F.col("vat").cast("string")).alias("tax_amount"), "raw_extraction")
    return reports.extraction_fields(rows)


@query
def reconciled_export(spark: SparkSession, d: str) -> DataFrame:
    """Statement rows written to one folder a file, read back with the ledger that they were stored beside."""
    folder = scratch(spark)
    sinks.write_matches(tables.bank(spark, d), f"{folder}/statements")
    tables.invoices(spark, d).write.parquet(f"{folder}/ledger")
    stored = files.invoices(spark, f"{folder}/ledger")
    rows = spark.read.parquet(f"{folder}/statements").select("file", F.col("row_no").alias("id"), F.coalesce("debit", "credit").alias("amount"))
    first = ledger.by_id(stored, 1).select(F.lit("by id").alias("file"), "id", "amount")
    return plain(rows.unionByName(stored.select(F.lit("ledger").alias("file"), "id", "amount")).unionByName(first))


@query
def ledger_export(spark: SparkSession, d: str) -> DataFrame:
    return plain(reports.display_ledger(tables.invoices(spark, d))).withColumn("supplier_id", F.coalesce("supplier_id", F.lit(-1).cast("long")))


@query
def export_widths(spark: SparkSession, d: str) -> DataFrame:
    return sinks.column_widths(reports.display_ledger(tables.invoices(spark, d)))


@query
def unseen_by_number(spark: SparkSession, d: str) -> DataFrame:
    """Session rows added to the ledger unless their number is there; a third of them share a number."""
    inv = tables.invoices(spark, d).select("invoice_number", "transactor")
    session = tables.read(spark, d, "lineitem").groupBy("l_orderkey").count().select(
        F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("INV-"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0")))
        .when(F.col("l_orderkey") % 3 == 1, F.concat(F.lit("NEW-"), F.col("l_orderkey").cast("string"))).alias("invoice_number"),
        F.lit("session").alias("transactor"))
    return reports.add_unseen(inv, session).groupBy("transactor").agg(F.count("*").alias("rows"))


@query
def field_scores(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.field_scores(tables.ground_truth(spark, d), tables.predictions(spark, d)).select(
        "model", "file", "field", "score")


@query
def field_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.field_accuracy(evaluation.field_scores(tables.ground_truth(spark, d), tables.predictions(spark, d)))


@query
def file_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.file_accuracy(evaluation.field_scores(tables.ground_truth(spark, d), tables.predictions(spark, d)))


@query
def model_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.model_summary(tables.ground_truth(spark, d), tables.predictions(spark, d))


@query
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.status_counts(tables.ground_truth(spark, d), tables.predictions(spark, d))


@query
def model_ranking(spark: SparkSession, d: str) -> DataFrame:
    ranks = evaluation.rank_models(evaluation.model_summary(tables.ground_truth(spark, d), tables.predictions(spark, d)))
    return ranks.select("model", "accuracy_rank", "speed_rank", "reliability_rank")


@query
def classification_accuracy(spark: SparkSession, d: str) -> DataFrame:
    answers = tables.type_predictions(spark, d).withColumn("payload", F.to_json(F.struct(
        replies.document_type(F.col("raw_label")).alias("document_type"))))
    truth = tables.ground_truth(spark, d).select("file", "expected_type")
    return evaluation.classification_accuracy(evaluation.classification_results(truth, answers))


@query
def top5_labels(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.top_labels(tables.label_scores(spark, d))


@query
def label_map(spark: SparkSession, d: str) -> DataFrame:
    return tables.label_scores(spark, d).groupBy(replies.document_type(F.col("label")).alias("app_type")).agg(F.count("*").alias("rows"))


@query
def wer(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.word_errors(tables.transcripts(spark, d)).select("conv_id", "turn", evaluation.four_places(F.col("wer")).alias("wer"))


@query
def wer_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.transcription_summary(evaluation.word_errors(tables.transcripts(spark, d)))


@query
def page_slice(spark: SparkSession, d: str) -> DataFrame:
    """The third page and, beyond the end, the last page of the listing, with its totals."""
    inv = tables.invoices(spark, d)
    totals = ledger.listing_totals(inv)
    third = ledger.page(inv, 3).select(F.lit("third").alias("page"), "id")
    last = ledger.page(inv, 10**6).select(F.lit("last").alias("page"), "id")
    return third.unionByName(last).unionByName(totals.select(F.lit("rows").alias("page"), F.col("total").alias("id"))).unionByName(
        totals.select(F.lit("pages").alias("page"), F.col("pages").alias("id")))


@query
def file_to_invoice(spark: SparkSession, d: str) -> DataFrame:
    inv = durable(tables.invoices(spark, d).select("id", "invoice_number", "file_path"))
    return ledger.number_in_file_name(inv, inv.select(F.col("file_path").alias("file")))


@query
def names_and_dates(spark: SparkSession, d: str) -> DataFrame:
    """Name keys, numbers and dates out of every file name, and month texts."""
    x = tables.extractions(spark, d).select("doc_id", "file_name").distinct()
    return plain(x.select(
        "doc_id", names.invoice_number_from_name(F.col("file_name")).alias("number"),
        dates.date_in_text(F.col("file_name")).alias("date"), names.name_key(F.col("file_name")).alias("name_key"),
        dates.excel_serial(F.col("doc_id")).alias("serial_date")))


@query
def voice_drafts(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation turn as a voice memo, the role taken as an extracted name."""
    t = tables.read(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text",
        F.when(F.col("turn") > 0, F.create_map(F.lit("transactor"), F.col("role"), F.lit("amount"), F.lit("12,50"))).alias("fields"))
    out = extraction.draft_from_transcript(t, AS_OF)
    return plain(out.select("doc_id", "date", "transactor", "amount", "currency", "description", "notes"))


@query
def statement_to_match(spark: SparkSession, d: str) -> DataFrame:
    """Raw statement text to matched transactions; line numbers start anew in every file, so they repeat."""
    lines = tables.statement_lines(spark, d)
    data = F.col("line_no") >= tables.FIRST_DATA_LINE
    firsts = lines.where(data).groupBy("file").agg(F.min("line_no").alias("first"))
    lines = lines.join(firsts, "file", "left").withColumn(
        "line_no", F.when(data, F.col("line_no") - F.col("first") + tables.FIRST_DATA_LINE).otherwise(F.col("line_no"))).drop("first")
    matched = reconcile.match_transactions(statements.standardise(lines), tables.invoices(spark, d))
    return plain(matched.select("file", "row_no", "matched_invoice_number", "match_confidence", "converted_invoice_amount",
                                F.coalesce("match_details", F.lit("")).alias("match_details")))


@query
def statement_report_rows(spark: SparkSession, d: str) -> DataFrame:
    """Outgoing rows of statements whose columns are found by content, and what the report makes of them."""
    rows = statements.report_rows(tables.report_lines(spark, d))
    items = reports.bank_items(rows).groupBy("kind_of_transaction", "transactor").agg(F.sum("total").alias("debit"), F.count("*").alias("n"))
    listed = rows.select("file", "row_no", "date", "payee", "description", "reference", "debit")
    return plain(listed.unionByName(items.select(
        F.col("kind_of_transaction").alias("file"), F.col("n").alias("row_no"), F.lit(None).cast("date").alias("date"), F.col("transactor").alias("payee"),
        F.lit("").alias("description"), F.lit("").alias("reference"), F.col("debit").cast(money.MONEY).alias("debit"))))


@query
def replies_to_suppliers(spark: SparkSession, d: str) -> DataFrame:
    """Half of the supplier master, brought up to date with all suppliers that the replies name."""
    recs = extraction.records(extraction.first_success(tables.extractions(spark, d)))
    master = tables.suppliers(spark, d).where(F.col("arrival") % 2 == 0)
    grown = supplier_ops.upsert(master, extraction.supplier_rows(recs).drop("doc_id", "record_no"))
    return plain(grown.select("name_key", "supplier_name", "category", "categories", "transaction_type", "vat_number", "is_new", "vat_filled"))


@query
def supplier_import_master(spark: SparkSession, d: str) -> DataFrame:
    """The master after sheets that name every supplier three times, each time spelled another way."""
    known = tables.incoming_suppliers(spark, d).where((F.col("arrival") % 2 == 0) & F.col("supplier_name").endswith(" trading")).select(
        "arrival", F.regexp_replace("supplier_name", " trading$", " CO").alias("supplier_name"), F.lit("KNOWN").alias("category"),
        F.array(F.lit("KNOWN")).alias("categories"), F.lit(None).cast("string").alias("transaction_type"),
        F.col("vat_number"), F.to_json(F.struct("arrival")).alias("raw_extraction"))
    grown, _ = supplier_ops.import_sheets(known, tables.repeated_sheet_lines(spark, d))
    return plain(grown.select("name_key", "supplier_name", "category", "categories", "transaction_type", "vat_number",
                              "raw_extraction", "is_new"))


@query
def report_undated(spark: SparkSession, d: str) -> DataFrame:
    """One month with the undated rows counted in: the sums of the sheets beside those of the summary."""
    inv = tables.invoices(spark, d).withColumn("date", F.when(F.col("id") % 50 != 0, F.col("date")))
    sheets = reports.comprehensive_report(inv, tables.suppliers(spark, d), 1997, 3, tables.bank(spark, d), include_undated=True)
    value = F.coalesce("total_bgn", "total_eur", F.lit(0).cast(money.MONEY))
    out = sheets["SUMMARY"].select(F.explode(F.array(
        F.struct(F.lit("summary income").alias("part"), F.col("income").alias("total")),
        F.struct(F.lit("summary expenses").alias("part"), F.col("expenses").alias("total")))).alias("x")).select("x.*")
    for name in ("INCOME", "EXPENSES"):
        out = out.unionByName(sheets[name].agg(F.lit(name).alias("part"), F.sum(value).alias("total")))
    alerts = sheets["DATA ALERTS"].agg(F.lit("alerts").alias("part"), F.count("*").cast(money.MONEY).alias("total"))
    return plain(out.unionByName(alerts))


@query
def form_functions(spark: SparkSession, d: str) -> DataFrame:
    """What forms and memos do with a row: edited amounts, totals, notes, lists, months, payees, currencies in text."""
    k = F.col("id")
    inv = tables.invoices(spark, d).select("id", "date", "currency", "notes", "transactor", F.col("amount").alias("net"), F.col("vat").alias("tax"))
    edits = ledger.edit_amounts(inv.withColumns({
        "amount": F.col("net").cast("string"), "vat": F.col("tax").cast("string"),
        "total": F.when(k % 3 == 0, "").when(k % 3 == 1, "0").otherwise(F.col("net").cast("string"))}))
    text = F.concat(F.lit("Paid "), F.when(k % 4 == 0, "$").when(k % 4 == 1, "EUR ").when(k % 4 == 2, "Rs ").otherwise(""),
                    F.col("net").cast("string"))
    total = money.line_total(F.col("net"), F.col("tax"), F.col("currency"))
    spoken = extraction.transcript_text(F.array(
        F.struct(F.lit(0.0).alias("start"), F.lit(1.5).alias("end"), F.concat(F.lit(" "), "transactor", F.lit(" ")).alias("text")),
        F.struct(F.lit(1.5).alias("start"), k.cast("double").alias("end"), F.col("notes").alias("text"))))
    return plain(edits.select(
        "id", "amount", "vat", "total_base", total["original"].alias("line_total"), total["base"].alias("line_base"),
        money.currency_in_text(text).alias("named_currency"), money.first_amount_in_text(text).alias("named_amount"),
        names.append_note(F.col("notes"), F.lit("seen"), F.lit("Note")).alias("noted"),
        names.split_list(F.concat("currency", F.lit(" , "), "transactor")).alias("listed"),
        dates.month_text(F.date_format("date", "MMMM yyyy")).alias("month"),
        dates.month_number(F.date_format("date", "MMMM")).alias("month_number"), dates.slashed(F.col("date")).alias("slashed"),
        replies.override_payee(F.col("transactor"), F.when(k % 5 == 0, "UNKNOWN").when(k % 5 == 1, F.lit("Known Payee"))).alias("payee"),
        spoken["text"].alias("spoken"), spoken["duration"].alias("spoken_seconds")))


@query
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """All replies as a stream in four batches: ledger rows with supplier ids, and the grown master's size."""
    folder = scratch(spark)
    stream = jobs.read_pieces(spark, tables.extractions(spark, d), f"{folder}/in", 4, "doc_id")
    master = tables.suppliers(spark, d).where(F.col("arrival") % 2 == 0)
    jobs.ingest_replies(stream, f"{folder}/ledger", master, f"{folder}/checkpoint", AS_OF, f"{folder}/suppliers").awaitTermination()
    rows = spark.read.parquet(f"{folder}/ledger")
    grown = jobs.latest_master(spark, f"{folder}/suppliers", master)
    return plain(rows.groupBy("transactor").agg(
        F.count("*").alias("rows"), F.sum("amount").alias("amount"), F.count_if(F.col("id") > 0).alias("numbered"),
        (F.countDistinct("id") == F.count("*")).alias("unique_ids"))).unionByName(grown.agg(
            F.lit("suppliers").alias("transactor"), F.count("*").alias("rows"), F.lit(0.0).alias("amount"),
            F.countDistinct("arrival").alias("numbered"), F.lit(1).alias("unique_ids")))


@query
def rate_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Rates after one proposed change per order, and what the ledger's amounts are worth in them."""
    k = F.col("o_orderkey")
    changes = tables.read(spark, d, "orders").select(
        k.alias("arrival"), F.when(k % 5 == 1, "USD").when(k % 5 == 2, "BGN").when(k % 5 == 3, "GBP").otherwise("EUR").alias("currency"),
        F.when(k % 7 == 0, "-1").when(k % 7 == 1, "abc").otherwise(F.concat((k % 50 + 100).cast("string"), F.lit(",5"))).alias("value"))
    updated, rejected = currency.update_rates(currency.rates(spark), changes)
    shown = currency.display_rates(updated)
    worth = currency.convert(tables.invoices(spark, d).select("id", "amount", "currency"), updated).groupBy("currency").agg(
        F.sum("base_amount").cast("double").alias("worth"))
    return updated.select(F.col("currency").alias("what"), F.col("rate_to_base").alias("value")).unionByName(
        rejected.agg(F.lit("rejected").alias("what"), F.count("*").cast("double").alias("value"))).unionByName(
        shown.agg(F.lit("shown").alias("what"), F.sum(F.length("rate_key")).cast("double").alias("value"))).unionByName(
        worth.select(F.concat(F.lit("worth "), "currency").alias("what"), F.col("worth").alias("value")))


@query
def best_models(spark: SparkSession, d: str) -> DataFrame:
    """The most accurate, the fastest and the most reliable model, a model without any file among them."""
    listed = spark.range(1).select(F.explode(F.array(F.lit("alpha"), F.lit("beta"), F.lit("idle"))).alias("model"))
    summary = evaluation.model_summary(tables.ground_truth(spark, d), tables.predictions(spark, d), listed)
    order = F.array_position(F.array(F.lit("idle"), F.lit("alpha"), F.lit("beta")), F.col("model"))
    return evaluation.best_models(summary.withColumn("run_no", order))


@query
def stream_matches(spark: SparkSession, d: str) -> DataFrame:
    """Bank lines arriving in two batches, each matched with the ledger."""
    folder = scratch(spark)
    stream = jobs.read_pieces(spark, tables.bank(spark, d), f"{folder}/in", 2, "row_no")
    jobs.reconcile_arrivals(stream, tables.invoices(spark, d), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return plain(spark.read.parquet(f"{folder}/out").select("file", "row_no", "matched_invoice_number", "match_confidence"))


@query
def stream_daily_totals(spark: SparkSession, d: str) -> DataFrame:
    folder = scratch(spark)
    stream = jobs.read_events(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"),
                                               F.col("value").cast(money.MONEY).alias("amount"))
    jobs.run_updates(jobs.daily_totals(stream), f"{folder}/out", f"{folder}/checkpoint", ["day_start", "kind"])
    return plain(jobs.read_latest(spark, f"{folder}/out", ["day_start", "kind"]).withColumn("day_start", F.col("day_start").cast("date")))


@query
def stream_without_repeats(spark: SparkSession, d: str) -> DataFrame:
    folder = scratch(spark)
    stream = jobs.read_events(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    doubled = stream.unionByName(stream)
    jobs.run_to_folder(jobs.without_repeats(doubled, ["event_id"]), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").groupBy("event_type").agg(F.count("*").alias("rows"))
