"""Invoice ledger: lookups, views and changes. Sorts end with the id so that order is stable."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.functions import money, names
from tallyloom.operators.containment import find_needles
from tallyloom.operators.joins import meet
from tallyloom.operators.numbering import kth_smallest, number_rows
from tallyloom.operators.suppliers import one_per_key
from tallyloom.session import durable

FIELDS = ["date", "invoice_number", "transactor", "amount", "vat", "total_base", "currency", "supplier_id", "notes",
          "is_income", "transaction_type", "file_path", "description", "raw_extraction", "document_type"]


def newest_first(invoices: DataFrame) -> DataFrame:
    return invoices.orderBy(F.col("date").desc_nulls_last(), "id")


def by_id(invoices: DataFrame, invoice_id: int) -> DataFrame:
    return invoices.where(F.col("id") == invoice_id)


def by_transactor(invoices: DataFrame, name: str) -> DataFrame:
    return newest_first(invoices.where(F.col("transactor") == name))


by_supplier = by_transactor


def between(invoices: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """Inclusive date range; the comparison on the plain column reaches the file scan."""
    return invoices.where(F.col("date").between(F.lit(first), F.lit(last)))


def by_year(invoices: DataFrame, year: int) -> DataFrame:
    return between(invoices, dt.date(year, 1, 1), dt.date(year, 12, 31))


def by_month(invoices: DataFrame, year: int, month: int) -> DataFrame:
    """One calendar month; a month outside 1 to 12 gives no rows."""
    if not 1 <= month <= 12:
        return invoices.limit(0)
    following = dt.date(year + month // 12, month % 12 + 1, 1)
    return between(invoices, dt.date(year, month, 1), following - dt.timedelta(days=1))


def is_income() -> Column:
    return F.coalesce(F.col("is_income"), F.lit(False))


def incomes(invoices: DataFrame) -> DataFrame:
    return invoices.where(is_income())


def expenses(invoices: DataFrame) -> DataFrame:
    return invoices.where(~is_income())


def view(invoices: DataFrame, section: str, year: int | None = None, month: int | None = None) -> DataFrame:
    """Income or expense list, optionally of a year or of a month; a month without a year is no filter."""
    picked = incomes(invoices) if section == "income" else expenses(invoices)
    if year is not None:
        picked = by_year(picked, year) if month is None else by_month(picked, year, month)
    return newest_first(picked)


def find_by_number(invoices: DataFrame, number: str) -> DataFrame:
    """First invoice (by id) whose number contains the text, upper and lower case alike."""
    return invoices.where(F.lower("invoice_number").contains(number.lower())).orderBy("id").limit(1)


def near_amount(invoices: DataFrame, amount: float, threshold: float = 0.01) -> DataFrame:
    """Invoices whose net or base total lies within the threshold of an amount."""
    def close(column: str) -> Column:
        return F.abs(F.col(column) - F.lit(amount)) < threshold
    return invoices.where(close("amount") | close("total_base"))


def near_amounts(invoices: DataFrame, targets: DataFrame, threshold: float = 0.01, nearest: int | None = None) -> DataFrame:
    """Bulk form of ``near_amount``: pairs (target, id), found through buckets of the threshold's width.

    ``targets``: one column ``target``. With ``nearest``, each target keeps that many invoices, by distance, then id; without it, all
    that the threshold admits (:func:`near_counts` tells how many those are). Those pairs come straight out of the join of amounts
    and targets and are not moved again: of the amounts of an id near a target, only the smallest gives the pair.
    """
    asked = targets.select("target").where("target is not null").distinct()
    if nearest is not None:
        return _nearest(_amounts(invoices), asked, threshold, nearest)

    def bucket(value: Column) -> Column:
        return F.floor(value.cast("double") / threshold)

    def close(value: str) -> Column:
        return F.abs(F.col(value) - F.col("target")) < threshold
    # Two amounts closer than the threshold share a bucket or lie in neighbouring ones.
    around = asked.withColumn("bucket", F.explode(F.transform(
        F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda step: bucket(F.col("target")) + step)))
    # Amounts near a target follow each other in order, so the next smaller one tells whether there is a smaller one near it.
    amounts = _amounts(invoices.select("id", "amount", "total_base").repartition("id")).withColumn(
        "smaller", F.lag("value").over(Window.partitionBy("id").orderBy("value")))
    met = meet(amounts.withColumn("bucket", bucket(F.col("value"))), around, "bucket")
    return met.where(close("value") & ~F.coalesce(close("smaller"), F.lit(False))).select("target", "id")


def _amounts(invoices: DataFrame) -> DataFrame:
    """(id, value): the net and the base total of each invoice; one row if they are equal."""
    return invoices.select("id", F.explode(F.array_distinct(F.array("amount", "total_base"))).alias("value")).where("value is not null")


#: Width of a block of amounts, in thresholds.
BLOCK = 32


def _nearest(amounts: DataFrame, asked: DataFrame, threshold: float, n: int) -> DataFrame:
    """The nearest n invoices of each target, from the distinct amounts before and behind it in a block of amounts.

    An invoice has at most two amounts, so 2n distinct amounts on either side hold n invoices that are as near as any beyond;
    of one amount, the n smallest ids suffice. So a target meets a fixed number of amounts, however many invoices share one.
    An amount within the threshold of its block's end stands in the next block as well.
    """
    place = F.dense_rank().over(Window.partitionBy("value").orderBy("id"))
    held = amounts.withColumn("place", place).where(F.col("place") <= n).groupBy("value").agg(
        F.collect_set(F.struct("id")).alias("ids"))

    def block(value: str) -> Column:
        return F.col(value).cast("double") / (BLOCK * threshold)
    # Half a threshold more on either side, as the quotients are rounded.
    blocks = F.sequence(F.floor(block("value") - 1.5 / BLOCK), F.floor(block("value") + 1.5 / BLOCK))
    points = held.select(F.explode(blocks).alias("block"), F.col("value").alias("at"), F.lit(0).alias("kind"), F.struct("value", "ids").alias("held")).union(
        asked.select(F.floor(block("target")), "target", F.lit(1), F.lit(None)))
    beside = [F.expr(f"{side}(held, {i}) IGNORE NULLS OVER (PARTITION BY block ORDER BY at, kind)")
              for side in ("lag", "lead") for i in range(1, 2 * n + 1)]
    met = points.withColumn("held", F.array(*beside)).where("kind = 1").withColumnRenamed("at", "target")

    def away(value: Column) -> Column:
        return F.abs(value - F.col("target"))
    close = F.filter("held", lambda h: h.isNotNull() & (away(h["value"]) < threshold))
    near = F.array_sort(F.flatten(F.transform(close, lambda h: F.transform(
        h["ids"], lambda i: F.struct(away(h["value"]).alias("away"), i["id"].alias("id"))))))
    return met.select("target", F.explode(F.slice(F.array_distinct(F.transform(near, lambda x: x["id"])), 1, n)).alias("id"))


def near_counts(invoices: DataFrame, targets: DataFrame, threshold: float = 0.01) -> DataFrame:
    """(target, n): how many invoices ``near_amount`` finds for each distinct target, without forming a pair.

    An invoice is near all targets inside an open interval around each of its amounts; two intervals that meet are one. The
    number of intervals open at a target is the running sum of their starts and ends in order, in each block of amounts from the
    intervals that are open where it begins. Equal intervals are counted first, so a frequent amount is one row. Amounts and
    threshold are compared in millionths.
    """
    exact = "decimal(28,6)"
    step = F.lit(Decimal(str(threshold))).cast(exact)
    low = F.least("amount", "total_base").cast(exact)
    high = F.greatest("amount", "total_base").cast(exact)

    def span(first: Column, last: Column) -> Column:
        return F.struct((first - step).cast(exact).alias("start"), (last + step).cast(exact).alias("stop"))
    spans = invoices.select(F.explode(F.when(high - low >= 2 * step, F.array(span(low, low), span(high, high))).otherwise(
        F.array(span(low, high)))).alias("s")).where("s.start is not null").groupBy("s.start", "s.stop").agg(F.count("*").alias("n"))

    def block(value: Column) -> Column:
        return F.floor(value.cast(exact).cast("double") / (BLOCK * threshold))
    crossed = spans.withColumn("block", F.explode(F.sequence(block(F.col("start")), block(F.col("stop")))))
    # At one amount: ends first, then targets, then starts, as the intervals are open. A start before the block comes ahead of all.
    edges = crossed.select("block", F.explode(F.array(
        F.struct(F.when(block(F.col("start")) == F.col("block"), F.col("start")).alias("at"), F.lit(2).alias("kind"), F.col("n").alias("change")),
        F.when(block(F.col("stop")) == F.col("block"), F.struct(
            F.col("stop").alias("at"), F.lit(0).alias("kind"), (-F.col("n")).alias("change"))))).alias("e")).where("e is not null")
    asked = targets.select("target").where("target is not null").distinct()
    events = edges.select("block", "e.at", "e.kind", "e.change", F.lit(None).alias("target")).union(
        asked.select(block(F.col("target")), F.col("target").cast(exact), F.lit(1), F.lit(0).cast("long"), "target"))
    opened = F.sum("change").over(Window.partitionBy("block").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return events.withColumn("n", opened).where("kind = 1").select("target", "n")


def years(invoices: DataFrame) -> DataFrame:
    return invoices.where(F.col("date").isNotNull()).select(F.year("date").alias("year")).distinct().orderBy(
        F.col("year").desc())


def page(invoices: DataFrame, number: int, size: int = 20) -> DataFrame:
    """One listing page, newest first; a page beyond either end is moved to the nearest one.

    Counts per day, added up in listing order, tell the days of the page; ids inside its first and last day are found by counts
    as well. So no row is numbered or sorted but those of the page. One row a calendar day meets in one task.
    """
    age = F.coalesce(-F.unix_date("date").cast("long"), F.lit(2**40))
    days = invoices.groupBy("date").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.orderBy(age).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    total = days.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    last = max(1, -(-total // size))
    number = min(max(1, number), last)
    begin, end = (number - 1) * size, min(number * size, total)
    held = days.withColumn("ahead", ahead).where((F.col("ahead") < end) & (F.col("ahead") + F.col("n") > begin)).orderBy("ahead").collect()
    if not held:
        return newest_first(invoices.limit(0))

    def on(day: dt.date | None) -> Column:
        return F.col("date").isNull() if day is None else F.col("date") == F.lit(day)
    newest, oldest = held[0], held[-1]
    inside = F.lit(True) if newest["date"] is None else F.col("date") <= F.lit(newest["date"])
    inside = inside | F.col("date").isNull() if oldest["date"] is None else inside & (F.col("date") >= F.lit(oldest["date"]))
    inside = on(None) if newest["date"] is None else inside
    if begin > newest["ahead"]:
        first = kth_smallest(invoices.where(on(newest["date"])), "id", begin - newest["ahead"] + 1)
        inside = inside & (~F.coalesce(on(newest["date"]), F.lit(False)) | (F.col("id") >= first))
    if end < oldest["ahead"] + oldest["n"]:
        final = kth_smallest(invoices.where(on(oldest["date"])), "id", end - oldest["ahead"])
        inside = inside & (~F.coalesce(on(oldest["date"]), F.lit(False)) | (F.col("id") <= final))
    return newest_first(invoices.where(inside))


def listing_totals(invoices: DataFrame, size: int = 20) -> DataFrame:
    return invoices.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size))


def supplier_ids(suppliers: DataFrame) -> DataFrame:
    """(transactor, resolved_id) by exact name, the first supplier of a name."""
    return suppliers.groupBy(F.col("supplier_name").alias("transactor")).agg(F.min("arrival").alias("resolved_id"))


def append(invoices: DataFrame, incoming: DataFrame, suppliers: DataFrame, last_id: int | None = None) -> DataFrame:
    """Incoming rows as ledger rows: supplier id resolved, ids continued after the largest one (``last_id`` where it is known).

    ``incoming`` needs a unique ``arrival`` and any subset of the ledger fields.
    """
    start = invoices.agg(F.coalesce(F.max("id"), F.lit(0))).scalar() if last_id is None else F.lit(last_id).cast("long")
    missing = {f: F.lit(None).cast(invoices.schema[f].dataType) for f in FIELDS if f not in incoming.columns}
    rows = incoming.withColumns(missing) if missing else incoming
    rows = rows.join(supplier_ids(suppliers), "transactor", "left")
    rows = rows.withColumn("supplier_id", F.coalesce("supplier_id", "resolved_id")).withColumn(
        "is_income", is_income()).withColumn("description", F.coalesce("description", F.lit("")))
    # Written first: numbering reads its rows twice.
    return number_rows(durable(rows.select("arrival", *FIELDS)), "arrival", name="id", start=start).select("id", *FIELDS)


def update(invoices: DataFrame, changes: DataFrame) -> DataFrame:
    """The ledger after partial updates: a supplied (non-null) field wins, all others stay.

    ``changes``: unique ``id`` and any subset of the ledger fields, optionally ``clear``, an array of
    field names to set to null.
    """
    supplied = [f for f in FIELDS if f in changes.columns]
    new = changes.select("id", *[F.col(f).alias(f"new_{f}") for f in supplied],
                         (F.col("clear") if "clear" in changes.columns else F.array().cast("array<string>")).alias("clear"))
    joined = invoices.join(new, "id", "left")
    return joined.select("id", *[
        F.when(F.array_contains("clear", f), F.lit(None)).otherwise(
            F.coalesce(f"new_{f}", f) if f in supplied else F.col(f)).alias(f)
        for f in FIELDS])


def unknown_ids(invoices: DataFrame, changes: DataFrame) -> DataFrame:
    return changes.where(F.col("id") != 0).join(invoices.select("id"), "id", "left_anti").select("id")


def new_from_changes(changes: DataFrame) -> DataFrame:
    """Change rows with id 0 as rows to append, with the defaults of a new invoice."""
    def given(name: str, default) -> Column:
        return F.coalesce(F.col(name), default) if name in changes.columns else default
    zero = F.lit(0).cast(money.MONEY)
    return changes.where(F.col("id") == 0).drop("id").withColumns({
        "amount": given("amount", zero), "vat": given("vat", zero), "total_base": given("total_base", zero),
        "currency": given("currency", F.lit("EUR")), "notes": given("notes", F.lit("")),
        "is_income": given("is_income", F.lit(False)),
        "transaction_type": given("transaction_type", F.lit("EXPENSES with VAT")),
        "description": given("description", F.lit(""))})


def edit_amounts(edits: DataFrame) -> DataFrame:
    """Edit-form texts to amounts: three parsed fields, the base total converted or derived when absent."""
    amount, vat = money.parse_setting(F.col("amount")).cast(money.MONEY), money.parse_setting(F.col("vat")).cast(money.MONEY)
    typed = money.parse_setting(F.col("total")).cast(money.MONEY)
    total = F.when(money.blank_to_null(F.col("total")).isNull() | (typed == 0), money.gross(amount, vat)).otherwise(typed)
    return edits.withColumns({"amount": amount, "vat": vat,
                              "total_base": money.to_base(total, F.col("currency"))["value"]}).drop("total")


def delete(invoices: DataFrame, ids: DataFrame) -> DataFrame:
    return invoices.join(ids.select("id").distinct(), "id", "left_anti")


def delete_all(invoices: DataFrame) -> DataFrame:
    return invoices.limit(0)


def enrich(invoices: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Invoices with the attributes of their supplier, matched on the normalised name."""
    attributes = one_per_key(suppliers).select(
        "name_key", F.col("category").alias("supplier_category"), F.col("categories").alias("supplier_categories"),
        F.col("transaction_type").alias("supplier_type"), F.col("vat_number").alias("supplier_vat"))
    return invoices.withColumn("name_key", names.name_key(F.col("transactor"))).join(attributes, "name_key", "left")


def snapshot(invoices: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Invoices joined with their supplier, the raw reply parsed where it is valid JSON."""
    raw = F.col("raw_extraction")
    return enrich(invoices, suppliers).select(
        F.col("id").alias("invoice_id"), "invoice_number", F.col("date").alias("invoice_date"),
        F.col("transactor").alias("supplier_name"), F.col("supplier_category").alias("category"),
        F.col("supplier_categories").alias("categories"),
        F.coalesce(money.blank_to_null(F.col("transaction_type")), "supplier_type").alias("transaction_type"),
        F.col("supplier_vat").alias("vat_number"), "amount", F.col("vat").alias("vat_amount"), "total_base",
        "currency", "notes", "description", "is_income", "file_path", raw.alias("raw_extraction"),
        F.from_json(raw, "map<string,string>").alias("raw_fields"))


def detail(invoices: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Detail rows: texts with their fallbacks, supplier attributes, total with its base value."""
    total = money.gross(F.col("amount"), F.col("vat"))
    known = F.col("supplier_categories").isNotNull()
    kind = F.coalesce(money.blank_to_null(F.col("transaction_type")),
                      F.when(is_income(), "INCOME").otherwise("EXPENSE"))
    return enrich(invoices, suppliers).select(
        "id", "date", "invoice_number", "transactor",
        F.coalesce(money.blank_to_null(F.col("description")), money.blank_to_null(F.col("notes")),
                   F.lit("No description available")).alias("description"),
        kind.alias("transaction_type"),
        F.coalesce("supplier_type", F.when(known, "Not specified"), kind).alias("account_description"),
        F.coalesce(F.nullif("supplier_category", F.lit("")),
                   F.nullif(F.array_join("supplier_categories", ", "), F.lit("")),
                   F.lit("Not specified")).alias("expense_category"),
        F.coalesce("supplier_vat", F.lit("")).alias("vat_number"),
        total.alias("total_amount"), money.with_conversions(total, F.col("currency")).alias("total"))


def number_in_file_name(invoices: DataFrame, files: DataFrame) -> DataFrame:
    """(file, id): for every file the first invoice whose number occurs in the file name."""
    numbers = durable(invoices.where(F.trim("invoice_number") != "").groupBy(
        F.lower("invoice_number").alias("needle")).agg(F.min("id").alias("id")))
    hits = find_needles(files.select(F.lower("file").alias("text")), numbers.select(F.lit("n").alias("kind"), "needle"))
    best = hits.join(numbers, "needle").groupBy("text").agg(F.min("id").alias("id"))
    return files.select("file", F.lower("file").alias("text")).join(best, "text").select("file", "id")


def first_names(suppliers: DataFrame, n: int = 30) -> DataFrame:
    """First supplier names in arrival order, as context for an extraction prompt."""
    return suppliers.orderBy("arrival").limit(n).select("supplier_name")
