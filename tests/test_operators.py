import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import currency, evaluation, extraction, ledger, reconcile, statements
from tallyloom.operators import suppliers as sup
from tallyloom.operators.numbering import kth_smallest, number_rows
from tallyloom.plans import reports
from tallyloom.sources import files, sinks, tables
from tallyloom.streaming import jobs

DATA = "/root/testdata/sf0.001"
SUP = ("arrival long, supplier_name string, category string, categories array<string>, transaction_type string, vat_number string")


def lines(spark, **by_file):
    rows = [(f, i, line) for f, text in by_file.items() for i, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "file string, line_no long, line string")


def test_statement_variants(spark):
    got = statements.standardise(lines(
        spark,
        plain="Date,Description,Debit,Credit,Balance\n2024-02-03,Shop,\"1,234.56\",,10\n2024-02-20,Client,,5.00,15\n,,,,\n",
        other="Transaction Date,Details,Withdrawal,Deposit\n01/31/2024,a,7,\n02/01/2024,b,,8\n",
        single="Date,Description,Amount\n15/01/2024,x,-100.00\n16/01/2024,y,50\n",
        signed="My bank\n\nPeriod,x\nDate,Value Date,Text,Amount,Amount Sign\n1.2.2024,2.2.2024,z,\"3,50\",DR\n1.2.2024,2.2.2024,z,4,C\n",
    ))
    rows = {(r["file"], r["row_no"]): r for r in got.collect()}
    d = dt.date
    assert (rows["plain", 1]["date"], rows["plain", 1]["debit"]) == (d(2024, 2, 3), Decimal("1234.56"))
    assert rows["plain", 2]["date"] == d(2024, 2, 20) and ("plain", 3) not in rows
    assert rows["other", 1]["date"] == d(2024, 1, 31) and rows["other", 2]["date"] == d(2024, 2, 1)
    assert (rows["single", 1]["debit"], rows["single", 2]["credit"]) == (Decimal("100.00"), Decimal("50.00"))
    assert (rows["signed", 4]["debit"], rows["signed", 5]["credit"]) == (Decimal("3.50"), Decimal("4.00"))


def test_statement_override_and_formats(spark):
    text = lines(spark, revolut_x="Date,Foo,Bar,Debit\n2024-01-01,one,two,3\n", odd="a,b\n1,2\n")
    over = spark.createDataFrame([("revolut_x", c, s) for c, s in (("date", "Date"), ("description", "Bar"), ("debit", "Debit"))],
                                 "file string, std_col string, src_col string")
    assert statements.standardise(text, over).where("file = 'revolut_x'").first()["description"] == "two"
    f = {r["file"]: r for r in statements.detect_formats(text).collect()}
    assert f["revolut_x"]["detected_format"] == "Revolut" and f["revolut_x"]["confidence"] == 0.5
    assert f["odd"]["detected_format"] == "Simple Statement Format" and f["odd"]["header_row"] == 0


def test_ledger_lookup_and_filters_reach_the_scan(spark):
    inv = tables.invoices(spark, DATA)
    plan = ledger.by_month(inv, 1996, 2)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan
    assert ledger.by_id(inv, 5).count() == 1
    assert ledger.by_month(inv, 1996, 2).agg(F.max(F.dayofmonth("date"))).first()[0] <= 29
    assert ledger.by_month(inv, 1996, 0).count() == 0
    assert ledger.find_by_number(inv, "inv-00000000").first()["id"] == 0
    assert ledger.find_by_number(inv, "%").count() == 0


def test_append_update_delete(spark):
    inv = spark.createDataFrame([], files.INVOICE_SCHEMA)
    incoming = spark.createDataFrame([(2, "n2", "B"), (1, "n1", "A")], "arrival long, invoice_number string, transactor string")
    known = spark.createDataFrame([(7, "A", None, None, None, None)], SUP)
    grown = ledger.append(inv, incoming, known)
    assert [(r["id"], r["invoice_number"], r["supplier_id"]) for r in grown.orderBy("id").collect()] == [(1, "n1", 7), (2, "n2", None)]
    changes = spark.createDataFrame([(1, "edited", None), (2, None, ["invoice_number"]), (9, "x", None)], "id long, notes string, clear array<string>")
    after = {r["id"]: r for r in ledger.update(grown, changes).collect()}
    assert after[1]["notes"] == "edited" and after[1]["invoice_number"] == "n1" and after[2]["invoice_number"] is None
    assert [r["id"] for r in ledger.unknown_ids(grown, changes).collect()] == [9]
    assert ledger.delete(grown, spark.createDataFrame([(1,)], "id long")).count() == 1
    assert ledger.new_from_changes(spark.createDataFrame([(0, "n9")], "id long, invoice_number string")).first()["currency"] == "EUR"


def test_numbering_is_dense(spark):
    got = number_rows(spark.range(1000).withColumn("k", F.col("id") * 37 % 1000), "k")
    assert got.where("row_number <> k + 1").count() == 0


def test_near_amounts_equals_pairs(spark):
    inv = spark.range(200).select("id", (F.col("id") * 3 % 50).cast("decimal(18,2)").alias("amount"), F.col("id").cast("decimal(18,2)").alias("total_base"))
    targets = spark.createDataFrame([(Decimal("10.00"),), (Decimal("49.99"),)], "target decimal(18,2)")
    want = {(t, r["id"]) for t in (10.0, 49.99) for r in inv.collect() if min(abs(float(r["amount"]) - t), abs(float(r["total_base"]) - t)) < 1}
    assert {(float(r["target"]), r["id"]) for r in ledger.near_amounts(inv, targets, 1.0).collect()} == want


def _pairs(inv, targets, threshold):
    return {(t, r["id"]): min(abs(v - t) for v in (r["amount"], r["total_base"]) if v is not None)
            for t in targets for r in inv if any(v is not None and abs(v - t) < threshold for v in (r["amount"], r["total_base"]))}


@pytest.mark.parametrize("threshold", [0.01, 1.0, 3.5])
def test_amounts_with_a_hot_value_against_pairs(spark, threshold):
    rnd = random.Random(4)
    cents = lambda: Decimal(rnd.randint(0, 2000)) / 100
    rows = [(i, Decimal("10.00") if rnd.random() < 0.9 else cents(), rnd.choice([Decimal("10.00"), cents(), None])) for i in range(400)]
    rows += [(400, None, None), (401, Decimal("3.00"), Decimal("10.00")), (402, Decimal("8.00"), Decimal("10.00"))]
    inv = spark.createDataFrame(rows, "id long, amount decimal(18,2), total_base decimal(18,2)")
    asked = [Decimal("10.00"), Decimal("9.00"), Decimal("11.00"), Decimal("-5.00"), Decimal("900.00"), Decimal("6.50")] + [cents() for _ in range(40)]
    targets = spark.createDataFrame([(t,) for t in [*asked, asked[0], None]], "target decimal(18,2)")
    pairs = _pairs(inv.collect(), set(asked), Decimal(str(threshold)))
    assert {tuple(r) for r in ledger.near_amounts(inv, targets, threshold).collect()} == set(pairs)
    counts = {r["target"]: r["n"] for r in ledger.near_counts(inv, targets, threshold).collect()}
    assert counts == {t: sum(p[0] == t for p in pairs) for t in set(asked)}
    for n in (1, 3):
        want = {(t, i) for t in set(asked) for _, i in sorted((away, i) for (u, i), away in pairs.items() if u == t)[:n]}
        assert {tuple(r) for r in ledger.near_amounts(inv, targets, threshold, nearest=n).collect()} == want
    assert ledger.near_counts(inv.limit(0), targets, threshold).agg({"n": "sum"}).first()[0] == 0


def test_supplier_upsert_and_changes(spark):
    base = spark.createDataFrame([(1, "Acme Ltd", "IT", ["IT"], None, "")], SUP)
    new = spark.createDataFrame([(5, "ACME_LTD", "Cloud", "DEDUCTION", "V1"), (6, "acme-ltd", "IT", "X", "V2"), (7, "Beta", "Food", None, None)],
                                "arrival long, supplier_name string, category string, transaction_type string, vat_number string")
    got = {r["name_key"]: r for r in sup.upsert(base, new).collect()}
    acme = got["ACME LTD"]
    assert (acme["supplier_name"], acme["category"], acme["categories"], acme["transaction_type"], acme["vat_number"]) == (
        "Acme Ltd", "IT", ["IT", "Cloud"], "DEDUCTION", "V1")
    assert acme["vat_filled"] and not acme["is_new"] and got["BETA"]["is_new"] and got["BETA"]["categories"] == ["Food"]
    assert sup.delete(base, new).count() == 0 and sup.lookup(base, "acme_ltd").count() == 1
    assert sup.by_category(base, "IT").count() == 1 and sup.existing(new, base).count() == 2


def test_nested_amounts(spark):
    s = spark.createDataFrame([("A", [(None, 5.0, None), (9.0, None, None)])],
                              "supplier_name string, invoices array<struct<amount:double,total_amount:double,total_base:double>>")
    assert sup.amounts_of_nested(s, 5.0).count() == 1


def test_rates(spark):
    stored = spark.createDataFrame([("EUR", 300.0)], "currency string, rate_to_base double")
    assert dict(currency.rates(spark, stored).collect()) == {"EUR": 300.0, "USD": 278.5, "BGN": 143.4}
    changes = spark.createDataFrame([(1, "USD", "280,5"), (2, "USD", "281"), (3, "GBP", "1"), (4, "EUR", "-1")], "arrival int, currency string, value string")
    new, bad = currency.update_rates(stored, changes)
    assert dict(new.collect()) == {"EUR": 300.0, "USD": 281.0} and bad.count() == 2


def test_reply_rows(spark):
    x = spark.createDataFrame([(1, "invoice_12.pdf", "cloud", 1, "sorry"), (1, "invoice_12.pdf", "local", 1, '{"Transactor": "Market Place", "description": "paid $45.50 on 3-4-2023"}')],
                              "doc_id long, file_name string, stage string, attempt int, response string")
    row = extraction.invoice_rows(extraction.records(extraction.first_success(x)), "2024-01-01", [("market", "2023-03-15", True)]).first()
    assert (row["date"], row["invoice_number"], float(row["amount"]), row["currency"]) == (dt.date(2023, 4, 3), "invoice_12", 45.5, "USD")
    assert extraction.first_success(x, "cloud").count() == 0
    passes = spark.createDataFrame([(1, 1, "Amount", "5", 0.3), (1, 2, "Amount", "6", 0.9), (1, 3, "Amount", "7", 0.9)],
                                   "doc_id int, pass int, field string, value string, confidence double")
    assert extraction.merge_passes(passes).first()["value"] == "6"


def test_run_model_isolates_failures(spark):
    def predict(path):
        if path == "bad":
            raise ValueError("broken")
        return None if path == "none" else {"Amount": 100}
    f = spark.createDataFrame([("a", "ok"), ("b", "bad"), ("c", "none")], "file string, path string")
    pred = evaluation.run_model(f, "m", predict)
    assert {r["file"]: r["status"] for r in pred.collect()} == {"a": "success", "b": "error", "c": "extraction_returned_none"}
    truth = spark.createDataFrame([(n, {"amount": "100"}) for n in "abcd"], "file string, expected map<string,string>")
    s = evaluation.model_summary(truth, pred).first()
    assert (s["accuracy"], s["failure_rate"], s["total_files"], s["successes"]) == (1.0, 0.75, 4, 1)
    empty = evaluation.model_summary(truth.limit(0), pred, spark.createDataFrame([("m",)], "model string")).first()
    assert (empty["accuracy"], empty["failure_rate"]) == (0.0, 1.0)


def test_best_models(spark):
    s = spark.createDataFrame([("a", 1, 0.7, 0.5, 0.1), ("b", 2, 0.95, 2.0, 0.05), ("c", 3, 0.8, 1.0, 0.0), ("skipped", 4, 0.0, 0.0, None)],
                              "model string, run_no int, accuracy double, avg_time double, failure_rate double")
    r = evaluation.best_models(s).first()
    assert (r["best_accuracy"], r["fastest"], r["most_reliable"]) == ("b", "a", "c")


def test_report(spark):
    bank = spark.createDataFrame([("f", 1, dt.date(1997, 3, 5), "COMMISSION", None, Decimal("50.00"), None, None),
                                  ("f", 2, dt.date(1997, 3, 5), "via paypal", "Shop", Decimal("90.00"), None, None),
                                  ("f", 3, dt.date(1997, 3, 5), "x", None, Decimal("17.00"), None, None)],
                                 "file string, row_no long, date date, description string, reference string, debit decimal(18,2), credit decimal(18,2), balance decimal(18,2)")
    sheets = reports.comprehensive_report(tables.invoices(spark, DATA), tables.suppliers(spark, DATA), 1997, 3, bank)
    rows = [r for r in sheets["EXPENSES"].collect() if r["invoice_number"] == ""]
    assert sorted((r["kind_of_transaction"], r["transactor"], r["payment_method"]) for r in rows) == [
        ("BANK FEES", "BANK", "BANK"), ("BANK FEES", "BANK", "BANK"), ("PAYMENT", "Shop", "PAYPAL")]
    total = sheets["SUMMARY"].first()
    assert total["net"] == total["income"] - total["expenses"]
    items = reports.bank_items(bank)
    assert reports.combine(items, items).count() == 3


def test_sinks_and_sources(spark, tmp_path):
    inv = tables.invoices(spark, DATA)
    root = str(tmp_path / "ledger")
    sinks.write_ledger(inv.select(*[f.split()[0] for f in files.INVOICE_SCHEMA.replace("decimal(18,2)", "d").split(", ")]), root, "1")
    back = sinks.read_current(spark, root)
    assert back.count() == inv.count() and "month" in back.columns
    assert files.invoices(spark, str(tmp_path / "missing")).count() == 0 and files.suppliers(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "st").mkdir()
    (tmp_path / "st" / "a.csv").write_text("Bank\r\nDate,Text,Debit\r\n2024-01-02,\"a, b\",5\r\n")
    got = statements.standardise(files.statement_lines(spark, str(tmp_path / "st"))).first()
    assert (got["description"], got["debit"]) == ("a, b", Decimal("5.00"))
    (tmp_path / "rates.json").write_text('{"EUR_TO_PKR": 281.5}')
    assert files.rates(spark, str(tmp_path / "rates.json")).first()["rate_to_base"] == 281.5
    docs = files.documents(spark, str(tmp_path / "st"), ["csv"], with_content=True)
    assert docs.first()["extension"] == "csv"
    assert files.texts_of(docs, lambda p: "t").first()["status"] == "success"


def test_streams(spark, tmp_path):
    src = str(tmp_path / "replies")
    tables.extractions(spark, DATA).where("doc_id < 50").write.parquet(src)
    stream = spark.readStream.schema(files.EXTRACTION_SCHEMA).parquet(src)
    out = str(tmp_path / "ledger")
    jobs.ingest_replies(stream, out, tables.suppliers(spark, DATA), str(tmp_path / "cp"), "2002-01-01").awaitTermination()
    rows = spark.read.parquet(out)
    assert rows.count() == 50 and rows.select("id").distinct().count() == 50

    txn = str(tmp_path / "txn")
    tables.bank(spark, DATA).where("row_no < 30").write.parquet(txn)
    arriving = spark.readStream.schema(spark.read.parquet(txn).schema).parquet(txn)
    matched = str(tmp_path / "matched")
    jobs.reconcile_arrivals(arriving, tables.invoices(spark, DATA).where("id < 40"), matched, str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(matched).count() == 30


def test_match_method_columns(spark):
    wanted = {"matched_supplier", "matched_invoice_number", "match_confidence", "match_method", "converted_invoice_amount",
              "amount_difference_pct", "match_details"}
    bank = tables.bank(spark, DATA).where("row_no < 3")
    assert wanted <= set(reconcile.match_transactions(bank, tables.invoices(spark, DATA).where("id < 3")).columns)


@pytest.mark.parametrize("n,last", [(1, 20), (99, 10)])
def test_pages_are_clamped(spark, n, last):
    inv = spark.range(50).withColumn("date", F.lit(dt.date(2024, 1, 1)))
    assert ledger.page(inv, n).count() == last


def test_pages_against_a_sorted_list(spark):
    rnd = random.Random(6)
    days = [None, dt.date(2024, 1, 1), dt.date(2024, 1, 1), dt.date(2024, 1, 1), dt.date(2024, 2, 1), dt.date(1965, 3, 1)]
    rows = [(i * 7919 - 5000, rnd.choice(days)) for i in range(97)]
    rnd.shuffle(rows)
    inv = spark.createDataFrame(rows, "id long, date date")
    listed = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or dt.date(2000, 1, 1)).toordinal(), r[0]))
    for size in (1, 20):
        for number in (1, 2, 3, 5, 97, 98):
            last = min(number, -(-97 // size))
            assert [tuple(r) for r in ledger.page(inv, number, size).collect()] == listed[(last - 1) * size:last * size]
    assert ledger.page(inv.limit(0), 3).count() == 0


def test_kth_smallest(spark):
    rnd = random.Random(9)
    values = sorted([rnd.randint(-2**60, 2**60) for _ in range(50)] + [5] * 30)
    rows = spark.createDataFrame([(v,) for v in [*values, None]], "v long")
    for k in (1, 17, 40, 80):
        assert kth_smallest(rows, "v", k) == values[k - 1]
    assert kth_smallest(rows, "v", 81) is None and kth_smallest(rows.limit(0), "v", 1) is None


def test_upsert_has_no_sorted_aggregate(spark):
    base = spark.createDataFrame([(1, "Acme Ltd", "IT", ["IT"], None, "")], SUP)
    new = spark.createDataFrame([(5, "ACME_LTD", "Cloud", "DEDUCTION", "V1")],
                                "arrival long, supplier_name string, category string, transaction_type string, vat_number string")
    lines = spark.createDataFrame([("s", 0, "A,B,C,D"), ("s", 1, "1,T,Acme-Ltd,First")], "sheet string, line_no long, line string")
    for frame in (sup.upsert(base, new), sup.read_sheets(lines)):
        assert "SortAggregate" not in frame._jdf.queryExecution().toString()


def test_upsert_keeps_every_column_and_the_order_of_arrival(spark):
    base = spark.createDataFrame([(4, "Acme Ltd", "IT", ["IT"], None, "", {"a": "1"}, None)], SUP + ", raw_extraction map<string,string>, phone string")
    new = spark.createDataFrame([(("d2", 0), "ACME_LTD", "Cloud", "X", "V2", {"b": "2"}, "77"), (("d1", 5), "New-Co", "First", None, None, {"c": "3"}, ""),
                                 (("d3", 0), "new co", "Third", "T", None, None, "88")],
                                "arrival struct<doc:string,no:int>, supplier_name string, category string, transaction_type string, "
                                "vat_number string, raw_extraction map<string,string>, phone string")
    got = {r["name_key"]: r for r in sup.upsert(base, new).collect()}
    acme, other = got["ACME LTD"], got["NEW CO"]
    assert acme["raw_extraction"] == {"a": "1"} and acme["phone"] == "77" and acme["arrival"] == 4
    assert (other["supplier_name"], other["category"], other["categories"], other["transaction_type"], other["phone"]) == (
        "New-Co", "First", ["First", "Third"], "T", "88")
    assert other["raw_extraction"] == {"c": "3"} and other["arrival"] > 4


def test_import_keeps_the_first_spelling(spark):
    lines = spark.createDataFrame([("s", 0, "A,B,C,D"), ("s", 1, "1,T,Acme-Ltd,First"), ("s", 2, "1,T,Acme Ltd,Second"), ("s", 3, "1,T,ACME_LTD,Third")],
                                  "sheet string, line_no long, line string")
    master, counts = sup.import_sheets(spark.createDataFrame([], SUP), lines)
    row = master.first()
    assert (row["supplier_name"], row["categories"]) == ("Acme-Ltd", ["First", "Second", "Third"]) and counts.first()["new_suppliers"] == 1


def test_replace_supplier(spark):
    base = spark.createDataFrame([(1, "Acme Ltd", "IT", ["IT"], None, ""), (2, "Beta", "x", [], None, "")], SUP)
    new = spark.createDataFrame([(9, "acme_ltd", "Z", ["Z"], "T", "V"), (9, "Nobody", "Z", [], None, None)], SUP)
    assert {(r["arrival"], r["category"]) for r in sup.replace(base, new).collect()} == {(9, "Z"), (2, "x")}


def test_multiline_statements_keep_all_columns(spark, tmp_path):
    (tmp_path / "m.csv").write_text('My bank\nDate,Description,Debit\n2024-01-02,"two\nlines, and ""more""",5.00\n')
    lines = files.multiline_statements(spark, str(tmp_path))
    row = statements.standardise(lines).first()
    assert (row["date"], row["description"], row["debit"]) == (dt.date(2024, 1, 2), 'two lines, and "more"', Decimal("5.00"))
    with pytest.raises(Exception, match="cells or more"):
        files.multiline_statements(spark, str(tmp_path), widest=3).collect()


def test_undated_rows_count_in_sheets_and_sums(spark):
    inv = tables.invoices(spark, DATA).limit(2).withColumns({
        "date": F.when(F.col("id") == F.lit(-1), F.col("date")), "is_income": F.lit(True), "currency": F.lit("PKR"), "total_base": F.lit(5).cast("decimal(18,2)")})
    sheets = reports.comprehensive_report(inv, tables.suppliers(spark, DATA), 2024, 5, include_undated=True)
    assert sheets["INCOME"].count() == 2
    assert [tuple(r) for r in sheets["SUMMARY"].collect()] == [(2024, 5, Decimal("10.00"), Decimal("0.00"), Decimal("10.00"))]
    levels = reports.summary(reports.invoice_items(inv, tables.suppliers(spark, DATA))).collect()
    assert sorted((r["level"], r["year"], r["income"]) for r in levels) == [
        ("all", None, Decimal("10.00")), ("month", None, Decimal("10.00")), ("year", None, Decimal("10.00"))]


def test_date_votes_own_signs_and_empty_rows(spark):
    text = ["Date,Description,Amount", "03/25/2024,a,-5.00", "04/01/2024,b,7.00", "04/02/2024,,", "2024-04-03,c,1"]
    lines = spark.createDataFrame([("us.csv", i, t) for i, t in enumerate(text)] + [("none.csv", i, f"x{i},y") for i in range(3)],
                                  "file string, line_no long, line string")
    rows = sorted((str(r["date"]), r["debit"], r["credit"]) for r in statements.standardise(lines).where("file = 'us.csv'").collect())
    assert rows == [("2024-03-25", Decimal("5.00"), None), ("2024-04-01", None, Decimal("7.00")), ("2024-04-03", None, Decimal("1.00"))]
    assert {r["file"]: r["header_found"] for r in statements.detect_formats(lines).collect()} == {"us.csv": True, "none.csv": False}


def test_nearest_amounts_for_each_target(spark):
    inv = spark.range(50).select("id", F.col("id").cast("decimal(18,2)").alias("amount"), F.lit(None).cast("decimal(18,2)").alias("total_base"))
    targets = spark.createDataFrame([(Decimal("10.00"),)], "target decimal(18,2)")
    assert {r["id"] for r in ledger.near_amounts(inv, targets, 5.0, nearest=3).collect()} == {9, 10, 11}


def test_a_document_over_two_batches_counts_once(spark, tmp_path):
    src, out, names = str(tmp_path / "in"), str(tmp_path / "ledger"), str(tmp_path / "suppliers")
    reply = lambda n: f'{{"Transactor": "Firm {n}", "Amount": 5}}'
    master = spark.createDataFrame([(3, "Firm 1", "IT", ["IT"], None, "")], SUP)

    def arrive(rows):
        spark.createDataFrame(rows, files.EXTRACTION_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(files.EXTRACTION_SCHEMA).parquet(src)
        jobs.ingest_replies(stream, out, master, str(tmp_path / "cp"), "2024-01-01", names).awaitTermination()

    arrive([(1, "a.pdf", "cloud", 1, reply(1)), (2, "b.pdf", "cloud", 1, "no answer")])
    arrive([(1, "a.pdf", "text", 2, reply(9)), (2, "b.pdf", "text", 2, reply(2)), (3, "a.pdf", "cloud", 1, reply(3))])
    rows = sorted((r["id"], r["transactor"]) for r in spark.read.parquet(out).collect())
    assert [n for _, n in rows] == ["Firm 1", "Firm 2", "Firm 3"] and len({i for i, _ in rows}) == 3
    grown = jobs.latest_master(spark, names, master)
    assert {r["supplier_name"] for r in grown.collect()} == {"Firm 1", "Firm 2", "Firm 3"}
    assert grown.select("arrival").distinct().count() == 3


def test_updates_over_several_batches(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for hour, value in ((1, 1), (2, 10), (30, 100)):
        spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour), "k", Decimal(value))],
                              "ts timestamp, kind string, amount decimal(18,2)").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("ts timestamp, kind string, amount decimal(18,2)").parquet(src)
        jobs.run_updates(jobs.daily_totals(stream), out, str(tmp_path / "cp"))
    rows = sorted((r["day_start"].day, r["entries"], int(r["total"])) for r in jobs.read_latest(spark, out, ["day_start", "kind"]).collect())
    assert rows == [(1, 2, 11), (2, 1, 100)]


def test_exports_read_back(spark, tmp_path):
    matched = spark.createDataFrame([("a", 1, 0), ("b", 2, 50)], "file string, row_no long, match_confidence int")
    sinks.write_matches(matched, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2
    sinks.write_evaluation(matched, matched, matched, str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e" / "details")).count() == 2
    sinks.write_sheets({"DATA ALERTS": matched}, str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s" / "data_alerts")).count() == 2


def test_four_fields_of_rows_with_few_columns(spark):
    sup_rows = spark.createDataFrame([("A", None, [], "7.5"), ("B", "One", ["X", "Y"], None)],
                                     "supplier_name string, category string, categories array<string>, tax_amount string")
    got = sorted(tuple(r) for r in reports.supplier_fields(sup_rows).collect())
    assert got == [("A", "", "", "7.5"), ("B", "X, Y", "", "")]
    raw = spark.createDataFrame([(1, "", {"Transactor": "T", "Kind of Transaction": "K", "Expense Category Account": "E"}), (2, "S", None)],
                                "id int, supplier_name string, raw_extraction map<string,string>")
    assert sorted(tuple(r) for r in reports.extraction_fields(raw).collect()) == [(1, "T", "E", "K", ""), (2, "S", "", "", "")]
