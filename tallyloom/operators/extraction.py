"""Raw model replies to supplier and invoice rows.

Input rows: ``doc_id``, ``file_name``, ``stage``, ``attempt``, ``response`` (the reply text).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.fixed_values import MODE_STAGES, STAGE_ORDER
from tallyloom.functions import dates, money, names, replies
from tallyloom.functions.binding import bind
from tallyloom.functions.money import blank_to_null
from tallyloom.operators.suppliers import one_per_key


def parse(extractions: DataFrame) -> DataFrame:
    return extractions.withColumn("records", replies.reply_records(F.col("response")))


def first_success(extractions: DataFrame, mode: str = "auto") -> DataFrame:
    """Per document the first allowed stage (then attempt) whose reply holds at least one record.

    All but one reply a task and document drop out before the shuffle.
    """
    allowed = MODE_STAGES[mode]
    order = F.array_position(F.array(*[F.lit(s) for s in STAGE_ORDER]), F.col("stage"))
    # The test for records sits in the order: as a filter it would parse every reply twice.
    usable = F.size("records") > 0
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(usable.desc(), order, "attempt"))
    ranked = parse(extractions.where(F.col("stage").isin(allowed))).withColumn("place", place)
    return ranked.where((F.col("place") == 1) & usable).select("doc_id", "file_name", "stage", "attempt", "records")


def first_stages(extractions: DataFrame, modes: Sequence[str]) -> DataFrame:
    """(mode, doc_id, stage, attempt): which reply :func:`first_success` takes in each of the modes.

    Every reply is parsed once for all modes, and no record is carried along.
    """
    order = F.array_position(F.array(*[F.lit(s) for s in STAGE_ORDER]), F.col("stage"))
    usable = extractions.where(F.size(replies.reply_records(F.col("response"))) > 0).select("doc_id", "stage", "attempt")
    allowed = F.array_compact(F.array(*[F.when(F.col("stage").isin(MODE_STAGES[m]), F.lit(m)) for m in modes]))
    place = F.row_number().over(Window.partitionBy("mode", "doc_id").orderBy(order, "attempt"))
    return usable.withColumn("mode", F.explode(allowed)).withColumn("place", place).where("place = 1").select(
        "mode", "doc_id", "stage", "attempt")


def merge_passes(passes: DataFrame) -> DataFrame:
    """(doc_id, field, value) with the highest confidence; an equal confidence keeps the earlier pass.

    ``passes``: doc_id, pass, field, value, confidence.
    """
    sure = passes.withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    place = F.row_number().over(Window.partitionBy("doc_id", "field").orderBy(F.desc("confidence"), "pass"))
    return sure.withColumn("place", place).where("place = 1").select("doc_id", "field", "value", "confidence")


def confidences(extractions: DataFrame) -> DataFrame:
    """Replies as passes for ``merge_passes``: every field with the confidence its reply states for it.

    A record is written out as fields in one step, so that each reply is parsed once and its confidences once.
    """
    def fields(record: Column, scores: Column) -> Column:
        stated = F.filter(F.map_entries(record), lambda e: (e["key"] != "Confidence") & e["value"].isNotNull())
        return F.transform(stated, lambda e: F.struct(
            e["key"].alias("field"), e["value"].alias("value"), F.coalesce(
                F.try_element_at(scores, F.lower(F.replace(e["key"], F.lit(" "), F.lit("_")))), F.lit(0.0)).alias("confidence")))
    listed = F.transform(replies.reply_records(F.col("response")), lambda r: bind(
        F.from_json(r["Confidence"], "map<string,double>"), lambda scores: fields(r, scores)))
    return extractions.select("doc_id", F.col("attempt").alias("pass"), F.explode(F.flatten(listed)).alias("e")).select(
        "doc_id", "pass", "e.*")


def records(winners: DataFrame) -> DataFrame:
    """One row per extracted record of the winning replies."""
    return winners.select("doc_id", "file_name", "stage", F.posexplode("records").alias("record_no", "r"))


def supplier_rows(recs: DataFrame) -> DataFrame:
    """Records with a transactor as supplier rows; arrival is the document order."""
    r = F.col("r")
    return recs.select(
        F.struct("doc_id", "record_no").alias("arrival"), "doc_id", "record_no",
        replies.field(r, "Transactor").alias("supplier_name"),
        F.coalesce(r["Expense Category Account"], F.lit(None)).alias("category"),
        F.coalesce(r["Kind of Transaction"], F.lit(None)).alias("transaction_type"),
        F.coalesce(replies.field(r, "VAT"), F.lit("")).alias("vat_number"),
    ).where(F.col("supplier_name").isNotNull())


def apply_known(rows: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Ledger values win for known suppliers; the VAT number is taken over only where it was missing.

    Adds ``is_new`` and ``vat_updated``.
    """
    known = one_per_key(suppliers).select(
        "name_key", F.col("category").alias("k_category"), F.col("categories").alias("k_categories"),
        F.col("transaction_type").alias("k_type"), F.col("vat_number").alias("k_vat"), F.lit(True).alias("known"))
    joined = rows.withColumn("name_key", names.name_key(F.col("supplier_name"))).join(known, "name_key", "left")
    own, held = blank_to_null(F.col("vat_number")), blank_to_null(F.col("k_vat"))
    own_list = F.when(blank_to_null(F.col("category")).isNotNull(), F.array("category")).otherwise(
        F.array().cast("array<string>"))
    return joined.select(
        *[c for c in rows.columns if c not in ("category", "transaction_type", "vat_number")],
        F.coalesce(blank_to_null(F.col("k_category")), F.col("category")).alias("category"),
        F.when(F.size("k_categories") > 0, F.col("k_categories")).otherwise(own_list).alias("categories"),
        F.coalesce(blank_to_null(F.col("k_type")), F.col("transaction_type")).alias("transaction_type"),
        F.coalesce(held, own, F.lit("")).alias("vat_number"),
        F.col("known").isNull().alias("is_new"),
        (F.coalesce("known", F.lit(False)) & held.isNull() & own.isNotNull()).alias("vat_updated"),
    )


def invoice_rows(recs: DataFrame, as_of: str, supplier_rules: list[tuple[str, str | None, bool]] = ()) -> DataFrame:
    """Records as ledger rows. ``as_of`` is the date used when none is found.

    ``supplier_rules``: (name part, default date, amount and currency from the description) for
    suppliers whose documents carry no usable fields of their own.
    """
    r, file_name = F.col("r"), F.col("file_name")
    supplier = F.lower(F.coalesce(replies.field(r, "Transactor"), F.lit("")))
    text = F.coalesce(r["Description"], r["description"], F.lit(""))
    default_date, from_text = F.lit(None).cast("date"), F.lit(False)
    for part, date, use_text in supplier_rules:
        hit = supplier.contains(part.lower())
        default_date = F.when(hit, F.coalesce(dates.date_in_text(text), F.lit(date).cast("date"))).otherwise(default_date)
        from_text = from_text | (hit & F.lit(use_text))
    typed = money.fill_from_total(
        F.coalesce(F.when(from_text, money.first_amount_in_text(text)), replies.amount_field(r, "Amount")),
        replies.amount_field(r, "Tax Amount", "VAT Amount"),
        replies.amount_field(r, "Total", "Total Amount"))
    currency = F.when(from_text, F.coalesce(money.currency_in_text(text), money.ingest_currency(r["Currency"]))).otherwise(
        money.ingest_currency(r["Currency"]))
    staged = recs.withColumns({"money": typed, "code": currency})
    base = money.to_base(money.gross(F.col("money.amount"), F.col("money.vat")), F.col("code"))
    return staged.select(
        "doc_id", "record_no",
        dates.reply_date(replies.field(r, "Invoice Date"), file_name, default_date, F.lit(as_of).cast("date")).alias("date"),
        F.coalesce(replies.field(r, "Invoice Number"), names.invoice_number_from_name(file_name)).alias("invoice_number"),
        replies.field(r, "Transactor").alias("transactor"),
        F.col("money.amount").alias("amount"), F.col("money.vat").alias("vat"),
        F.when(base["error"].isNull(), base["value"]).alias("total_base"), base["error"].alias("conversion_error"),
        F.col("code").alias("currency"),
        F.concat(F.lit("Extracted from "), file_name).alias("notes"),
        replies.description(r).alias("description"),
        file_name.alias("file_path"),
        F.to_json("r").alias("raw_extraction"),
        replies.document_type(F.coalesce(replies.field(r, "Document Type"), F.lit("invoice"))).alias("document_type"),
    ).where(F.col("transactor").isNotNull())


def draft_from_transcript(transcripts: DataFrame, as_of: str, description_length: int = 500) -> DataFrame:
    """Voice memos as draft invoices: defaults overlaid with whatever was extracted.

    ``description`` is the beginning of the text, up to ``description_length`` characters; ``notes`` holds all of it.

    ``transcripts``: doc_id, text, fields map<string,string> (null when nothing was extracted).
    """
    f = F.col("fields")
    amount = F.coalesce(replies.amount_field(f, "amount"), F.lit(0).cast(money.MONEY))
    vat = F.coalesce(replies.amount_field(f, "vat"), F.lit(0).cast(money.MONEY))
    return transcripts.where(blank_to_null(F.col("text")).isNotNull()).select(
        "doc_id",
        F.coalesce(dates.parse_match_date(f["date"]), F.lit(as_of).cast("date")).alias("date"),
        F.coalesce(replies.field(f, "invoice_number"), F.lit("")).alias("invoice_number"),
        F.coalesce(replies.field(f, "transactor"), F.lit("")).alias("transactor"),
        amount.alias("amount"), vat.alias("vat"),
        F.coalesce(replies.field(f, "currency"), F.lit("PKR")).alias("currency"),
        F.concat(F.lit("[Voice Memo]: "), "text").alias("notes"),
        F.left("text", F.lit(description_length)).alias("description"),
        F.lit(False).alias("is_income"), F.lit("EXPENSES with VAT").alias("transaction_type"))


def transcript_text(segments: Column) -> Column:
    """struct(text, duration, segments) of transcript segments: trimmed texts, end of the last segment."""
    clean = F.transform(segments, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                                     F.trim(s["text"]).alias("text")))
    return F.struct(
        F.array_join(F.transform(clean, lambda s: s["text"]), " ").alias("text"),
        F.coalesce(F.try_element_at(clean, F.lit(-1))["end"], F.lit(0.0)).alias("duration"),
        clean.alias("segments"))
