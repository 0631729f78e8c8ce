"""Ledger, statement, reply and evaluation views that Spark derives from the given tables.

The given tables hold orders, customers, suppliers, events and conversations. The expressions here
read them as invoices, supplier masters, bank lines, model replies and transcripts, row for row and
without leaving any row out, so every job grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.fixed_values import LABEL_TYPES
from tallyloom.functions import money


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One given table. One that comes as a single file of one row group is spread over the cores."""
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    if name in ("orders", "conversations", "lineitem") and len(table.inputFiles()) == 1:
        return table.repartition(spark.sparkContext.defaultParallelism)
    return table


#: Rows of orders that one task turns into invoices, bank lines or replies.
ROWS_A_TASK = 50_000


def _orders_of(spark: SparkSession, folder: str, customer: DataFrame) -> DataFrame:
    """Orders with the columns of their customers, dealt to as many tasks as there are rows for.

    Dealt behind the join: the join's own tasks follow the bytes of the orders, which are few beside what is made of them, and a
    task with too many rows would sort them on disk.
    """
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    tasks = max(spark.sparkContext.defaultParallelism, -(-orders.count() // ROWS_A_TASK))
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).repartition(tasks)


def _pick(key: Column, *values) -> Column:
    """One of the values by the remainder of the key."""
    choice = F.lit(values[-1])
    for i, value in enumerate(values[:-1]):
        choice = F.when(F.pmod(key, F.lit(len(values))) == i, F.lit(value)).otherwise(choice)
    return choice


def invoices(spark: SparkSession, folder: str) -> DataFrame:
    """One invoice per order."""
    k = F.col("o_orderkey")
    customer = read(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    net = F.col("o_totalprice").cast(money.MONEY)
    vat = F.when(k % 3 == 0, (net * F.lit("0.20").cast("decimal(3,2)")).cast(money.MONEY)).otherwise(
        F.lit(0).cast(money.MONEY))
    inv = _orders_of(spark, folder, customer).select(
        k.alias("id"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.concat(F.lit("INV-"), F.lpad(k.cast("string"), 9, "0")).alias("invoice_number"),
        F.concat(F.col("c_name"), F.lit(" Trading")).alias("transactor"),
        net.alias("amount"),
        vat.alias("vat"),
        _pick(k, "PKR", "EUR", "USD", "BGN").alias("currency"),
        F.lit(None).cast("long").alias("supplier_id"),
        F.when(k % 6 == 0, "Paid by PayPal").when(k % 6 == 1, "").otherwise(F.concat(F.lit("Order "), k.cast("string"))).alias("notes"),
        (k % 5 == 0).alias("is_income"),
        F.when(k % 5 == 0, "INCOME").when(k % 7 == 1, "DEDUCTION").when(k % 7 == 2, "BANK FEES")
        .when(k % 7 == 3, F.lit(None)).otherwise("EXPENSES with VAT").alias("transaction_type"),
        F.concat(F.lit("uploads/scan_inv-"), F.lpad(k.cast("string"), 9, "0"), F.lit(".pdf")).alias("file_path"),
        F.when(k % 4 == 0, "0").when(k % 4 == 1, F.concat(F.lit("Goods, "), F.col("o_orderpriority")))
        .when(k % 4 == 2, "paypal transfer").alias("description"),
        F.when(k % 9 == 0, "not json {").when(k % 9 == 1, F.lit(None)).otherwise(F.concat(
            F.lit('{"Transactor": "'), F.col("c_name"), F.lit('", "Kind of Transaction": "'),
            F.when(k % 2 == 0, "Sales").otherwise("Deduction"), F.lit('", "Expense Category Account": "'),
            F.col("c_mktsegment"), F.lit('", "Confidence": {"overall": 0.9}}'))).alias("raw_extraction"),
        _pick(k, "invoice", "receipt", "credit_note", "other").alias("document_type"),
    )
    return inv.withColumn(
        "total_base", money.to_base(money.gross(F.col("amount"), F.col("vat")), F.col("currency"))["value"])


def suppliers(spark: SparkSession, folder: str) -> DataFrame:
    """The supplier master: one row per customer, names written in three ways."""
    k = F.col("c_custkey")
    customer, nation, region = (read(spark, folder, n) for n in ("customer", "nation", "region"))
    name = F.when(k % 3 == 0, F.concat(F.upper("c_name"), F.lit("_TRADING"))).when(
        k % 3 == 1, F.concat(F.col("c_name"), F.lit("-trading"))).otherwise(
        F.concat(F.col("c_name"), F.lit("  Trading")))
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            k.alias("arrival"),
            name.alias("supplier_name"),
            F.when(k % 11 == 0, "").otherwise(F.col("r_name")).alias("category"),
            F.when(k % 11 == 0, F.array().cast("array<string>"))
            .otherwise(F.array("r_name", "c_mktsegment")).alias("categories"),
            F.when(k % 8 == 0, F.lit(None)).when(F.col("c_mktsegment") == "MACHINERY", "EXP. VIES")
            .otherwise("EXPENSES with VAT").alias("transaction_type"),
            F.when(k % 7 == 0, F.lit(None)).when(k % 7 == 1, "").otherwise(
                F.concat(F.lit("VAT"), k.cast("string"))).alias("vat_number"),
        )
    )


def incoming_suppliers(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers arriving for an upsert: every customer again by plain name, and the supplier table."""
    k = F.col("c_custkey")
    nation = read(spark, folder, "nation")
    again = read(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        k.alias("arrival"),
        F.concat(F.col("c_name"), F.lit(" trading")).alias("supplier_name"),
        F.col("n_name").alias("category"),
        F.lit("OTHER EXPENCES").alias("transaction_type"),
        F.concat(F.lit("NEW"), k.cast("string")).alias("vat_number"),
    )
    fresh = read(spark, folder, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        (F.col("s_suppkey") + 1_000_000_000).alias("arrival"),
        F.col("s_name").alias("supplier_name"),
        F.col("n_name").alias("category"),
        F.lit("EXPENSES with VAT").alias("transaction_type"),
        F.concat(F.lit("SUP"), F.col("s_suppkey").cast("string")).alias("vat_number"),
    )
    return again.unionByName(fresh)


def bank(spark: SparkSession, folder: str) -> DataFrame:
    """One bank line per order: paid in full, less fees, by half, or an amount no invoice has."""
    k = F.col("o_orderkey")
    orders = read(spark, folder, "orders")
    customer = read(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey")
    net = F.col("o_totalprice").cast(money.MONEY)
    factor = F.when(k % 17 == 0, "40.00").when(k % 3 == 0, "0.97").when(k % 3 == 1, "1.00").otherwise("0.50")
    rate = money.default_rate(_pick(k, "PKR", "EUR", "USD", "BGN"))
    value = (net * rate * factor.cast("decimal(4,2)")).cast(money.MONEY)
    number = F.concat(F.lit("inv-"), F.lpad(k.cast("string"), 9, "0"))
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("statement_"), F.col("c_nationkey").cast("string"), F.lit(".csv")).alias("file"),
        k.alias("row_no"),
        F.date_add(F.col("o_orderdate").cast("date"), (k % 11).cast("int")).alias("date"),
        F.when(k % 4 >= 2, F.concat(F.lit("Transfer "), F.col("c_name"), F.when(k % 8 >= 4, " trading").otherwise("")))
        .otherwise("Card payment").alias("description"),
        F.when(k % 2 == 1, number).otherwise("").alias("reference"),
        F.when(k % 2 == 0, value).alias("debit"),
        F.when(k % 2 == 1, value).alias("credit"),
        F.lit(None).cast(money.MONEY).alias("balance"),
    )


def statement_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The bank lines as raw statement text: three header styles, none to four lines above the header.

    One file per nation. Header lines come from the nation table, data lines from the orders.
    """
    nation = read(spark, folder, "nation").select(
        F.col("n_nationkey").alias("n"), F.concat(F.lit("statement_"), F.col("n_nationkey").cast("string"), F.lit(".csv")).alias("file"))
    style = F.pmod(F.col("n"), F.lit(3))
    above = F.when(style == 1, F.array(F.lit("Account statement"), F.lit("Period,1995"))).when(
        style == 2, F.array(F.lit("Account statement"), F.lit("Period,1995"), F.lit("Owner,A,B"), F.lit(" "))
    ).otherwise(F.array().cast("array<string>"))
    header = F.when(style == 0, "Date,Description,Reference,Debit,Credit,Balance").when(
        style == 1, "Transaction Date,Details,Ref,Withdrawal,Deposit,Closing Balance").otherwise(
        "Booking Date,Narrative,Ref,Amount,Amount Sign,Closing")
    heads = nation.select("file", F.posexplode(F.concat(above, F.array(header))).alias("line_no", "line")).select(
        "file", F.col("line_no").cast("long").alias("line_no"), "line")
    rows = bank(spark, folder).withColumn("n", F.regexp_extract("file", r"_(\d+)\.csv", 1).cast("int"))
    value = F.coalesce("debit", "credit")

    def quoted(amount: Column) -> Column:
        return F.coalesce(F.concat(F.lit('"'), F.format_number(amount, 2), F.lit('"')), F.lit(""))

    iso = F.concat_ws(",", F.date_format("date", "yyyy-MM-dd"), F.concat(F.lit('"'), "description", F.lit(', ref"')),
                      "reference", quoted(F.col("debit")), quoted(F.col("credit")), F.lit(""))
    slashed = F.concat_ws(",", F.date_format("date", "dd/MM/yyyy"), "description", "reference",
                          F.coalesce(F.col("debit").cast("string"), F.lit("")),
                          F.coalesce(F.col("credit").cast("string"), F.lit("")), F.lit("1.00"))
    european = F.concat_ws(",", F.date_format("date", "dd.MM.yyyy"), "description", "reference",
                           F.translate(quoted(value), ",.", ".,"),
                           F.when(F.col("debit").isNotNull(), "D").otherwise("C"), F.lit("x"))
    lines = rows.select("file", (F.col("row_no") + FIRST_DATA_LINE).alias("line_no"),
                        F.when(style == 0, iso).when(style == 1, slashed).otherwise(european).alias("line"))
    return heads.unionByName(lines)


def overridden_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The bank lines in files named after banks, with two dates, a signed amount and empty rows in between."""
    named = F.array(F.lit("hsbc "), F.lit("My Wells Fargo "), F.lit("paypal-"), F.lit("plain_"))

    def file_of(n: Column) -> Column:
        return F.concat(F.get(named, F.pmod(n, F.lit(4)).cast("int")), n.cast("string"), F.lit(".csv"))
    nation = read(spark, folder, "nation").select(F.col("n_nationkey").alias("n"))
    heads = nation.select(file_of(F.col("n")).alias("file"), F.lit(0).cast("long").alias("line_no"), F.when(
        F.pmod("n", F.lit(4)) == 3, "Date,Other,Amount").otherwise("Date,Value Date,Narrative,Amount").alias("line"))
    rows = bank(spark, folder).withColumn("n", F.regexp_extract("file", r"_(\d+)\.csv", 1).cast("int"))
    amount = F.coalesce(-F.col("debit"), F.col("credit")).cast("string")
    dates_, later = F.date_format("date", "yyyy-MM-dd"), F.date_format(F.date_add("date", 3), "yyyy-MM-dd")
    line = F.when(F.pmod("n", F.lit(4)) == 3, F.concat_ws(",", dates_, F.lit("x"), amount)).otherwise(
        F.concat_ws(",", dates_, later, "description", amount))
    empty = F.when(F.col("row_no") % 10 == 0, F.lit(",,,"))
    return heads.unionByName(rows.select(file_of(F.col("n")).alias("file"), F.col("row_no"), F.posexplode(
        F.array_compact(F.array(line, empty))).alias("i", "line")).select(
            "file", (F.col("row_no") * 2 + F.col("i") + 100).cast("long").alias("line_no"), "line"))


def write_quoted(documents: DataFrame, folder: str) -> None:
    """One record of four cells for each document: doc_id, text and source in quotes, n_chars."""
    def cell(name: str) -> Column:
        return F.concat(F.lit('"'), F.replace(F.coalesce(F.col(name), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "n_chars")]
    documents.select(F.concat_ws(",", plain[0], cell("text"), cell("source"), plain[1]).alias("value")).write.text(folder)


def overrides(spark: SparkSession, folder: str) -> DataFrame:
    """For half of the banks' files the user's own mapping: the value date is the date."""
    files = overridden_lines(spark, folder).where("line like 'Date,Value Date%'").where("file not like 'My %'").select("file")
    return files.select("file", F.explode(F.array(*[F.struct(F.lit(a).alias("std_col"), F.lit(b).alias("src_col")) for a, b in (
        ("date", "Value Date"), ("description", "Narrative"), ("amount", "Amount"))])).alias("o")).select("file", "o.*")


def report_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The bank lines as statements that only the report reads: dates, signs and references in columns named otherwise."""
    nation = read(spark, folder, "nation").select(F.col("n_nationkey").alias("n"))
    style = F.pmod(F.col("n"), F.lit(3))
    file = F.concat(F.lit("statement_"), F.col("n").cast("string"), F.lit(".csv"))
    heads = nation.select(file.alias("file"), F.lit(0).cast("long").alias("line_no"), F.when(
        style == 0, "Date,Description,Payee,Amount,Amount Sign").when(style == 1, "When,Payee,,Total sum,Mark").otherwise(
        "Value of,Booking date,Payee,Reference number,Amount").alias("line"))
    rows = bank(spark, folder).withColumn("n", F.regexp_extract("file", r"_(\d+)\.csv", 1).cast("int"))
    value, out = F.coalesce("debit", "credit").cast("string"), F.col("debit").isNotNull()
    plain = F.concat_ws(",", F.date_format("date", "dd/MM/yyyy"), "description", F.lit("Shop"), value, F.when(out, "D").otherwise("C"))
    bare = F.concat_ws(",", F.date_format("date", "yyyy-MM-dd"), "description", "reference", value, F.when(out, "Dr").otherwise("cr"))
    own = F.concat_ws(",", F.lit("x"), F.datediff("date", F.lit("1899-12-30").cast("date")).cast("string"), "description", "reference",
                      F.concat(F.when(out, "-").otherwise(""), value))
    return heads.unionByName(rows.select("file", (F.col("row_no") + FIRST_DATA_LINE).alias("line_no"), F.when(
        style == 0, plain).when(style == 1, bare).otherwise(own).alias("line")))


#: Data lines of the statements are numbered from here.
FIRST_DATA_LINE = 100


def repeated_sheet_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer on three sheets of its region, spelled and classed differently on each."""
    rows = read(spark, folder, "customer").join(read(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(
        read(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("c_custkey")
    turns = F.array(F.lit("third"), F.lit("first"), F.lit("second"))
    spelled = {"first": F.concat("c_name", F.lit("-Co")), "second": F.concat(F.upper("c_name"), F.lit("_CO")),
               "third": F.concat("c_name", F.lit("  co"))}
    classed = {"first": F.when(k % 10 == 0, "").otherwise(F.col("c_mktsegment")), "second": F.col("n_name"),
               "third": F.col("c_mktsegment")}
    body = rows.select("r_name", k.alias("k"), F.explode(turns).alias("turn"), "c_name", "c_mktsegment", "n_name", "c_custkey")

    def of_turn(choice: dict[str, Column]) -> Column:
        return F.when(F.col("turn") == "first", choice["first"]).when(F.col("turn") == "second", choice["second"]).otherwise(choice["third"])

    sheet = F.concat("r_name", F.lit(" "), F.col("turn"))
    lines = body.select(sheet.alias("sheet"), (F.col("k") + 10).alias("line_no"), F.concat_ws(
        ",", F.lit("1"), F.lit("EXPENSES with VAT"), of_turn(spelled), of_turn(classed)).alias("line"))
    heads = read(spark, folder, "region").select(F.col("r_name"), F.explode(turns).alias("turn")).select(
        sheet.alias("sheet"), F.lit(0).cast("long").alias("line_no"), F.lit("A,B,C,D").alias("line"))
    return heads.unionByName(lines)


def sheet_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The customers as supplier sheets, one per region, with two kinds of headers and a total line each."""
    region = read(spark, folder, "region")
    nation = read(spark, folder, "nation")
    named = F.pmod(F.col("r_regionkey"), F.lit(2)) == 0
    heads = region.select(
        F.col("r_name").alias("sheet"), F.lit(0).cast("long").alias("line_no"),
        F.when(named, "Day,Kind of Transaction,Transactor,Expense Category Account,Vendor").otherwise("A,B,C,D").alias("line"))
    totals = region.select(F.col("r_name").alias("sheet"), F.lit(1).cast("long").alias("line_no"),
                           F.lit("x,y,TOTAL of all,z,Total").alias("line"))
    k = F.col("c_custkey")
    rows = read(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.when(k % 4 == 0, F.upper("c_name")).otherwise(F.col("c_name"))
    again = F.when(k % 10 == 0, "").otherwise(F.col("c_mktsegment"))
    body = F.when(named, F.concat_ws(",", F.lit("1"), F.lit("nan"), F.lit("old name"), again, name)).otherwise(
        F.concat_ws(",", F.lit("1"), F.lit("EXPENSES with VAT"), name, again))
    return heads.unionByName(totals).unionByName(rows.select(F.col("r_name").alias("sheet"), (k + 10).alias("line_no"), body.alias("line")))


def _json(**fields: Column) -> Column:
    """JSON text with the given keys (spaces for underscores) and values already written as JSON."""
    parts = [F.concat(F.lit('"' + key.replace("_", " ") + '": '), value) for key, value in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def _text(value: Column) -> Column:
    return F.concat(F.lit('"'), value, F.lit('"'))


def extractions(spark: SparkSession, folder: str) -> DataFrame:
    """Three raw model replies per order, one per stage, in five ways of answering."""
    k = F.col("o_orderkey")
    customer = read(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    rows = _orders_of(spark, folder, customer)
    net = F.col("o_totalprice").cast(money.MONEY)
    date = F.col("o_orderdate").cast("date")
    written = F.when(k % 4 == 0, F.date_format(date, "yyyy-MM-dd")).when(k % 4 == 1, F.date_format(date, "dd/MM/yyyy")).when(
        k % 4 == 2, F.date_format(date, "MMMM d, yyyy")).otherwise("")
    # The three replies of an order differ in the last field; all before it is written once.
    same = _json(
        Transactor=_text(F.concat("c_name", F.lit(" Trading"))),
        Invoice_Number=F.when(k % 3 == 0, F.lit('""')).otherwise(_text(F.concat(F.lit("INV-"), F.lpad(k.cast("string"), 9, "0")))),
        Invoice_Date=_text(written),
        Amount=F.when(k % 7 == 0, "null").when(k % 7 == 1, _text(F.concat(F.lit("$"), F.format_number(net, 2)))).otherwise(net.cast("string")),
        Tax_Amount=F.when(k % 3 == 0, "12.50").otherwise("0"),
        Total_Amount=F.when(k % 2 == 0, (net + 20).cast("string")).otherwise('""'),
        Currency=_pick(k, '"eur"', '"USD"', '"GBP"', '"XXX"', "null"),
        Description=F.when(k % 4 == 1, _text(F.lit("None"))).otherwise(_text(F.concat(F.lit("Order "), k.cast("string")))),
        Expense_Category_Account=_text(F.concat("c_mktsegment", F.lit(", general"))),
        Kind_of_Transaction=_text(F.lit("DEDUCTION")),
        VAT=F.when(k % 5 == 0, F.lit("undefined")).otherwise(_text(F.concat(F.lit("BG"), k.cast("string")))),
    )
    rows = rows.withColumn("same", same).withColumn("stage_no", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    confidence = F.concat(F.lit('{"amount": 0.'), (F.col("stage_no") * 3 + k % 3 + 1).cast("string"), F.lit(', "transactor": 0.5}'))
    body = F.concat(F.expr("substring(same, 1, length(same) - 1)"), F.lit(', "Confidence": '), confidence, F.lit("}"))
    way = F.pmod(k + F.col("stage_no") * 2, F.lit(5))
    reply = (
        F.when(way == 0, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone.")))
        .when(way == 1, F.concat(F.lit("Result "), body, F.lit(" end")))
        .when(way == 2, F.concat(F.expr("substring(body, 1, length(body) - 1)"), F.lit(", }")))
        .when(way == 3, F.lit("I could not read this document {"))
        .otherwise(F.concat(F.lit("["), body, F.lit(",]")))
    )
    number = F.lpad(k.cast("string"), 9, "0")
    return rows.withColumn("body", body).select(
        k.alias("doc_id"),
        F.when(k % 2 == 0, F.concat(F.lit("invoice_"), number, F.lit(".pdf"))).otherwise(
            F.concat(F.lit("scan "), F.date_format(date, "d-M-yyyy"), F.lit(".pdf"))).alias("file_name"),
        F.element_at(F.array(F.lit("cloud"), F.lit("text"), F.lit("local")), F.col("stage_no") + 1).alias("stage"),
        (F.col("stage_no") + 1).alias("attempt"), reply.alias("response"))


def ground_truth(spark: SparkSession, folder: str) -> DataFrame:
    """Expected fields of every invoice; the VAT of some is unknown and not scored."""
    inv = invoices(spark, folder)
    fields = {"transactor": F.col("transactor"), "invoice_number": F.col("invoice_number"),
              "date": F.date_format("date", "yyyy-MM-dd"), "amount": F.col("amount").cast("string"),
              "vat": F.when(F.col("id") % 3 == 0, F.col("vat").cast("string")), "currency": F.col("currency"),
              "description": F.concat(F.lit("order "), F.col("id").cast("string"), F.lit(" goods"))}
    return inv.select(
        F.concat(F.lit("doc_"), F.col("id").cast("string"), F.lit(".pdf")).alias("file"),
        F.col("document_type").alias("expected_type"),
        F.create_map(*[x for key, value in fields.items() for x in (F.lit(key), value)]).alias("expected"))


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Two models' answers for every invoice: shifted amounts, dates and names, failures and gaps."""
    inv = invoices(spark, folder).withColumn("m", F.explode(F.array(F.lit(0), F.lit(1))))
    k, m = F.col("id"), F.col("m")
    turn = F.pmod(k + m * 3, F.lit(7))
    factor = F.when(turn == 0, "1.0005").when(turn == 1, "1.03").when(turn == 2, "1.08").when(turn == 3, "1.20").otherwise("1")
    days = F.when(turn == 1, 1).when(turn == 2, 5).when(turn == 4, 40).otherwise(0)
    shifted = F.date_add("date", days)
    body = _json(
        Transactor=_text(F.when(turn == 5, F.upper("transactor")).when(turn == 6, F.regexp_replace("transactor", " Trading$", ""))
                         .otherwise(F.col("transactor"))),
        Invoice_Number=F.when(turn == 4, _text(F.concat(F.lit("No. "), "invoice_number"))).otherwise(_text(F.col("invoice_number"))),
        Invoice_Date=_text(F.when(m == 0, F.date_format(shifted, "yyyy-MM-dd")).otherwise(F.date_format(shifted, "dd/MM/yyyy"))),
        Amount=(F.col("amount") * factor.cast("decimal(6,4)")).cast(money.MONEY).cast("string"),
        VAT_Amount=F.when(turn == 3, "null").otherwise(F.col("vat").cast("string")),
        Currency=F.when(turn == 0, _text(F.concat("currency", F.lit(" money")))).when(turn == 1, '""').otherwise(_text(F.col("currency"))),
        Description=F.when(turn == 2, F.concat(F.lit('["order", "'), k.cast("string"), F.lit(' goods"]'))).otherwise(
            _text(F.concat(F.lit("goods of order "), k.cast("string")))),
    )
    status = F.when(k % 13 == 0, "error").when(k % 17 == 0, "extraction_returned_none").otherwise("success")
    return inv.where(~((k % 19 == 0) & (m == 1))).select(
        F.when(m == 0, "alpha").otherwise("beta").alias("model"),
        F.concat(F.lit("doc_"), k.cast("string"), F.lit(".pdf")).alias("file"), status.alias("status"),
        ((k % 100 + m * 7 + 1) / 100).alias("seconds"), F.when(status == "success", body).alias("payload"))


def type_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Two classifiers' answers for every invoice."""
    inv = invoices(spark, folder).withColumn("m", F.explode(F.array(F.lit(0), F.lit(1))))
    k, m = F.col("id"), F.col("m")
    label = F.when((k + m) % 3 == 0, "memo").when((k + m) % 3 == 1, "Invoice").otherwise("form")
    return inv.where(~((k % 11 == 0) & (m == 0))).select(
        F.when(m == 0, "dense").otherwise("tiny").alias("model"),
        F.concat(F.lit("doc_"), k.cast("string"), F.lit(".pdf")).alias("file"),
        F.when(k % 23 == 0, "error").otherwise("success").alias("status"), F.lit(0.5).alias("seconds"),
        label.alias("raw_label"))


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation turn as reference and the next turn of the same conversation as hypothesis."""
    turns = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hypothesis"))
    return turns.join(following, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.col("role").alias("model"), F.col("text").alias("reference"), "hypothesis")


def label_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Sixteen class scores per labelled document."""
    labels = F.array(*[F.lit(label) for label in LABEL_TYPES])
    rows = read(spark, folder, "labels").select("doc_id", "quality", F.posexplode(labels).alias("i", "label"))
    return rows.select("doc_id", "label", (F.pmod(F.col("doc_id") * 7 + F.col("i") * 13 + F.col("quality"), F.lit(17)) / 100).alias("score"))
