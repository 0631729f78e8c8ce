"""Bank statements with unknown headers to standard transactions.

Input is one row per text line: ``file``, ``line_no`` (any number that grows within the file) and
``line``. All files of a folder are resolved in one job: headers are found among the first lines of
each file, the resulting one-row-per-file mapping is joined back to the data lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.fixed_values import BANK_NAMES, HEADER_PATTERNS, STANDARD_COLUMNS
from tallyloom.functions import money
from tallyloom.functions.dates import excel_serial, parse_date
from tallyloom.session import durable

HEADER_ROWS = 10  # a header is looked for among the first ten non-blank lines of a file
DAY_FIRST = ["d/M/y", "d-M-y", "d.M.y", "d-MMM-yy", "d MMM y"]
MONTH_FIRST = ["M/d/y", "M-d-y", "M.d.y"]
MAPPED = [*STANDARD_COLUMNS, "amount", "amount_sign"]


def _any(*columns: str) -> str:
    return "(?iu)(" + "|".join(p for c in columns for p in HEADER_PATTERNS[c]) + ")"


def split_fields(line: Column) -> Column:
    """Comma-separated fields of a line, quotes honoured and removed, any number of fields."""
    parts = F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    quoted = F.transform(parts, lambda f: F.replace(
        F.regexp_replace(F.trim(f), r'^"([\s\S]*)"$', "$1"), F.lit('""'), F.lit('"')))
    # The expression looks at the rest of the line for each comma; a line without quotes needs none of it.
    return F.when(line.contains('"'), quoted).otherwise(F.transform(F.split(line, ",", -1), lambda f: F.trim(f)))


def is_header(fields: Column) -> Column:
    """At least three named columns, one of them a date and one a debit, credit or amount."""
    named = F.filter(fields, lambda f: F.trim(f) != "")
    dated = F.exists(fields, lambda f: F.trim(f).rlike(_any("date")))
    financial = F.exists(fields, lambda f: F.trim(f).rlike(_any("debit", "credit", "amount")))
    return (F.size(named) >= 3) & dated & financial


def find_headers(lines: DataFrame, header_rows: int = HEADER_ROWS) -> DataFrame:
    """(file, header_line, header_row, header, header_found): first valid header per file, else its first line.

    A header is looked for among the first ``header_rows`` non-blank lines; ``header_found`` tells files without one.
    """
    order = Window.partitionBy("file").orderBy("line_no")
    first = (
        lines.where(F.trim("line") != "")
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= header_rows + 1)
        .withColumn("fields", split_fields(F.col("line")))
    )
    # A header needs a data line behind it, so the last of the first lines never counts.
    last = F.max("rank").over(Window.partitionBy("file"))
    good = is_header(F.col("fields")) & (F.col("rank") <= header_rows) & (F.col("rank") < F.col("last"))
    pick = F.struct(F.when(good, 0).otherwise(1), "rank")
    return first.withColumn("last", last).groupBy("file").agg(
        F.min_by(F.struct("line_no", (F.col("rank") - 1).alias("row"), "fields", good.alias("good")), pick).alias("h")
    ).select("file", F.col("h.line_no").alias("header_line"), F.col("h.row").alias("header_row"),
             F.col("h.fields").alias("header"), F.col("h.good").alias("header_found"))


def map_columns(headers: DataFrame) -> DataFrame:
    """Adds one index column ``i_<standard>`` per standard column (null when no header fits).

    Standard columns are served in their fixed order, each takes the first free header that fits.
    Amount and sign columns are looked for only without a debit or credit column, and a column that
    reads like a date is never the amount.
    """
    places = F.sequence(F.lit(1), F.size("header"))
    wanted = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(_any(c)).alias("pattern")) for c in MAPPED])

    def serve(picks: Column, column: Column) -> Column:
        split = column["column"].isin("amount", "amount_sign")
        # Picks 4 and 5 are debit and credit; 0 stands for no header.
        needed = ~split | ((F.get(picks, F.lit(3)) == 0) & (F.get(picks, F.lit(4)) == 0))

        def fits(i: Column) -> Column:
            title = F.trim(F.element_at("header", i))
            dated = (column["column"] == "amount") & title.rlike(_any("date"))
            return needed & F.rlike(title, column["pattern"]) & ~F.array_contains(picks, i) & ~dated

        first = F.coalesce(F.try_element_at(F.filter(places, fits), F.lit(1)), F.lit(0))
        return F.concat(picks, F.array(first))

    picked = headers.withColumn("picks", F.aggregate(wanted, F.array().cast("array<int>"), serve))
    return picked.select(*headers.columns, *[
        F.nullif(F.get("picks", F.lit(n)), F.lit(0)).alias(f"i_{c}") for n, c in enumerate(MAPPED)])


def resolve(lines: DataFrame, overrides: DataFrame | None = None, header_rows: int = HEADER_ROWS) -> DataFrame:
    """Header and column mapping per file; ``overrides`` (file, std_col, src_col) win over detection."""
    mapped = map_columns(find_headers(lines, header_rows))
    if overrides is None:
        return mapped
    wanted = overrides.groupBy("file").agg(
        F.map_from_entries(F.collect_list(F.struct("std_col", "src_col"))).alias("wanted"))
    mapped = mapped.join(wanted, "file", "left")
    for column in MAPPED:
        place = F.array_position("header", F.try_element_at("wanted", F.lit(column))).cast("int")
        mapped = mapped.withColumn(f"i_{column}", F.when(F.col("wanted").isNull(), F.col(f"i_{column}"))
                                   .otherwise(F.nullif(place, F.lit(0))))
    return mapped.drop("wanted")


def _format_name(file: Column, columns: Column) -> Column:
    base = F.replace(F.lower(F.element_at(F.split(file, "/"), -1)), F.lit(" "), F.lit("_"))
    name = F.when(base.contains(BANK_NAMES[0][0]), BANK_NAMES[0][1])
    for keyword, title in BANK_NAMES[1:]:
        name = name.when(base.contains(keyword), title)
    return (
        name.when(columns <= 4, "Simple Statement Format").when(columns <= 7, "Standard Statement Format")
        .otherwise("Extended Statement Format")
    )


def mapping_options(lines: DataFrame) -> DataFrame:
    """(file, columns, suggested_mapping): header names and the non-null part of the mapping."""
    mapped = resolve(lines)
    entries = F.array_compact(F.array(*[
        F.when(F.col(f"i_{c}").isNotNull(),
               F.struct(F.lit(c).alias("key"), F.element_at("header", F.col(f"i_{c}")).alias("value")))
        for c in MAPPED]))
    return mapped.select("file", "header_row", F.col("header").alias("columns"),
                         F.map_from_entries(entries).alias("suggested_mapping"), "header_line", "header_found")


def detect_formats(lines: DataFrame) -> DataFrame:
    """Per file: format name, header row, mapping, confidence and number of data rows."""
    options = mapping_options(lines)
    counts = (
        lines.where(F.trim("line") != "").join(options.select("file", "header_line"), "file")
        .groupBy("file").agg(F.count_if(F.col("line_no") > F.col("header_line")).alias("row_count"))
    )
    return options.join(counts, "file").select(
        "file", _format_name(F.col("file"), F.size("columns")).alias("detected_format"), "header_row", "columns",
        "suggested_mapping", F.size("suggested_mapping").alias("matched_columns"),
        F.least(F.size("suggested_mapping") / 4, F.lit(1.0)).alias("confidence"), "row_count", "header_found")


def sign_of(text: Column) -> Column:
    """D or C from any of the usual spellings, null otherwise."""
    code = F.upper(F.trim(text))
    return F.when(code.isin("D", "DR", "DEBIT"), "D").when(code.isin("C", "CR", "CREDIT"), "C")


def split_amount(amount: Column, sign: Column, has_sign_column: Column) -> tuple[Column, Column]:
    """Debit and credit of a single amount column, by its sign column or else by its own sign."""
    debit = F.when(has_sign_column, F.when(sign == "D", amount)).otherwise(F.when(amount < 0, -amount))
    credit = F.when(has_sign_column, F.when(sign == "C", amount)).otherwise(F.when(amount > 0, amount))
    return debit, credit


def infer_sign(sign_cell: Column, fields: Column, amount: Column) -> Column:
    """Sign of a row: its sign column, else any cell that is a bare sign, else the amount's own sign."""
    bare = F.try_element_at(F.array_compact(F.transform(fields, sign_of)), F.lit(1))
    return F.coalesce(sign_of(sign_cell), bare, F.when(amount < 0, "D").otherwise("C"))


def standardise(lines: DataFrame, overrides: DataFrame | None = None, header_rows: int = HEADER_ROWS) -> DataFrame:
    """Standard transactions of all files: file, row_no, date, description, reference, debit, credit, balance."""
    mapped = resolve(lines, overrides, header_rows).select("file", "header_line", *[f"i_{c}" for c in MAPPED])
    rows = (
        lines.where(F.trim("line") != "").join(mapped, "file")
        .where(F.col("line_no") > F.col("header_line"))
        .withColumn("fields", split_fields(F.col("line")))
    )

    # Cells first, as plain text columns: the parsers below read each of them several times.
    cells = rows.select("file", "line_no", "i_amount_sign", *[
        F.trim(F.try_element_at("fields", F.col(f"i_{c}"))).alias(c) for c in MAPPED])
    money_columns = ["debit", "credit", "balance", "amount"]
    parsed = cells.withColumns({c: money.parse_money(F.col(c)) for c in money_columns}).withColumns(
        {c: money.blank_to_null(F.col(c)) for c in ("date", "description", "reference")})
    by_debit, by_credit = split_amount(
        F.col("amount"), sign_of(F.col("amount_sign")), F.col("i_amount_sign").isNotNull())
    text_rows = parsed.select(
        "file", F.col("line_no").alias("row_no"), F.col("date").alias("date_text"), "description", "reference",
        F.coalesce("debit", by_debit).alias("debit"), F.coalesce("credit", by_credit).alias("credit"), "balance")
    # Written once: the date vote and the result both read it, and without the break Catalyst would
    # push the test for empty rows, with all parsers in it, down into the join.
    rows = durable(text_rows).dropna("all", subset=["description", "debit", "credit"])
    return _read_dates(rows, _month_first(rows.select("file", "date_text")))


def _dates_of(text: Column) -> tuple[Column, Column, Column]:
    iso = F.coalesce(parse_date(text, ["y-M-d"]), F.try_to_timestamp(text).cast("date"))
    return F.when(text.rlike(r"^\d{4}-"), iso), parse_date(text, DAY_FIRST), parse_date(text, MONTH_FIRST)


def _month_first(dates: DataFrame) -> DataFrame:
    """(file, month_first): whether month-first reads more of the file's dates than day-first."""
    text = money.blank_to_null(F.col("date_text"))
    iso, day_first, month_first = _dates_of(F.col("date_text"))
    return dates.withColumn("date_text", text).where("date_text is not null").where(iso.isNull()).groupBy("file").agg(
        (F.count(month_first) > F.count(day_first)).alias("month_first"))


def _read_dates(rows: DataFrame, votes: DataFrame) -> DataFrame:
    """ISO dates are ISO; other dates are day-first unless month-first reads more rows of the file."""
    iso, day_first, month_first = _dates_of(F.col("date_text"))
    chosen = F.when(F.coalesce("month_first", F.lit(False)), month_first).otherwise(day_first)
    return rows.join(votes, "file", "left").select(
        "file", "row_no", F.coalesce(iso, chosen).alias("date"), "description", "reference", "debit", "credit",
        "balance")


def debit_rows(transactions: DataFrame) -> DataFrame:
    """Outgoing transactions for the report; amounts below one cent drop out."""
    return transactions.where(F.col("debit") >= 0.01)


def _place(fits) -> Column:
    """Place of the first header (lower-cased) that fits, null without one."""
    return F.try_element_at(F.filter(F.sequence(F.lit(1), F.size("titles")), lambda i: fits(F.element_at("titles", i))), F.lit(1))


def report_rows(lines: DataFrame, header_rows: int = HEADER_ROWS) -> DataFrame:
    """Outgoing rows of raw statements for the report: file, row_no, date, payee, description, reference, debit.

    Looser than :func:`standardise`: the date is the column named so, else the first cell that reads like one; the amount is the
    amount column, else one named after a sum, total or value; the sign comes from its column, else from any bare sign in
    the row, else from the amount; the reference is the column named so, else the first filled column without a name.
    """
    heads = find_headers(lines, header_rows).select(
        "file", "header_line", F.transform("header", lambda h: F.lower(F.trim(h))).alias("titles"))
    placed = heads.select(
        "file", "header_line", "titles",
        _place(lambda t: (t == "date") | (t.contains("date") & ~t.contains("value"))).alias("i_date"),
        F.coalesce(_place(lambda t: t == "amount"), _place(lambda t: t.rlike("amount|sum|total|value") & ~t.contains("sign"))).alias("i_amount"),
        F.coalesce(_place(lambda t: t == "amount sign"), _place(lambda t: t.contains("sign"))).alias("i_sign"),
        _place(lambda t: t.contains("reference")).alias("i_reference"),
        _place(lambda t: t == "payee").alias("i_payee"), _place(lambda t: t == "description").alias("i_description"))
    rows = lines.where(F.trim("line") != "").join(placed, "file").where(F.col("line_no") > F.col("header_line")).withColumn(
        "fields", F.transform(split_fields(F.col("line")), lambda c: F.trim(c)))

    def cell(name: str) -> Column:
        return money.blank_to_null(F.try_element_at("fields", F.col(f"i_{name}")))

    by_content = F.try_element_at(F.filter("fields", lambda c: c.rlike("[/-]") & c.rlike("[0-9]")), F.lit(1))
    unnamed = F.try_element_at(F.filter("fields", lambda c, i: (F.get("titles", i) == "") & (c != "")), F.lit(1))
    cells = rows.select(
        "file", F.col("line_no").alias("row_no"), "fields",
        F.when(F.col("i_date").isNull(), by_content).otherwise(cell("date")).alias("date_text"),
        F.coalesce(cell("payee"), F.lit("")).alias("payee"), F.coalesce(cell("description"), F.lit("")).alias("description"),
        F.coalesce(F.when(F.col("i_reference").isNull(), unnamed).otherwise(cell("reference")), F.lit("")).alias("reference"),
        cell("sign").alias("sign_cell"), money.parse_money(cell("amount")).alias("amount"))
    text = F.col("date_text")
    date = F.when(text.rlike(r"^[0-9]+(\.[0-9]+)?$"), excel_serial(text.try_cast("double"))).otherwise(
        parse_date(text, ["d/M/y", "y-M-d"]))
    signed = cells.withColumn("sign", infer_sign(F.col("sign_cell"), F.col("fields"), F.col("amount")))
    return signed.where((F.col("sign") == "D") & (F.abs("amount") >= 0.01)).select(
        "file", "row_no", date.alias("date"), "payee", "description", "reference", F.abs("amount").alias("debit")).where("date is not null")
