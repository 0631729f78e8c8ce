import datetime as dt

from pyspark.sql import functions as F

from tallyloom.fixed_values import MATCH_DATE_FORMATS, REPLY_DATE_FORMATS
from tallyloom.functions import dates, money, names, replies


def test_parse_setting(values):
    assert values(money.parse_setting, ["100.50", "100,50", "invalid", "100"]) == [100.5, 100.5, 0.0, 100.0]


def test_parse_money(values):
    texts = ["1,234.56", "1.234,56", "1,234", "100,00", "(20)", "-7.5", "5-", "€ 3,10", "abc", "", None, "0.125", "1.234.567"]
    got = values(money.parse_money, texts)
    assert [None if v is None else float(v) for v in got] == [
        1234.56, 1234.56, 1234.0, 100.0, -20.0, -7.5, -5.0, 3.1, None, None, None, 0.13, 1234567.0]


def test_parse_flagged(values):
    assert values(money.parse_flagged, ["$5", "€1,5", "лв 2.5", "1,000.5", "x"]) == [5.0, 1.5, 2.5, None, None]


def test_format_amount(values):
    assert values(money.format_amount, [(100.5, "EUR"), (100.5, "BGN"), (100.5, "USD")], "a double, c string") == [
        "100,50", "100,50", "100.50"]


def test_conversion(values):
    got = values(
        lambda a, c: money.to_base(a.cast("decimal(18,2)"), c), [("100", "PKR"), ("100", "EUR"), ("2", "BGN"), ("1", "GBP")], "a string, c string")
    assert [float(r["value"]) for r in got] == [100.0, 28050.0, 286.8, 0.0]
    assert [r["error"] for r in got] == [None, None, None, "Unsupported currency: GBP"]
    shown = values(lambda a, c: money.with_conversions(a.cast("decimal(18,2)"), c), [("10", "USD"), ("10", "PKR")], "a string, c string")
    assert shown[0]["converted"][0]["amount"] == "2785.00" and shown[1]["converted"] == []


def test_fill_from_total(values):
    rows = [("100", "0", "120"), ("0", "20", "120"), ("0", "0", "50"), ("1", "2", "0")]
    got = values(lambda a, v, t: money.fill_from_total(*[c.cast("decimal(18,2)") for c in (a, v, t)]), rows, "a string, v string, t string")
    assert [(float(r["amount"]), float(r["vat"])) for r in got] == [(100, 20), (100, 20), (50, 0), (1, 2)]


def test_free_text_money(values):
    assert values(money.currency_in_text, ["paid $30", "30 eur", "лв 2", "Rs 5", "none"]) == ["USD", "EUR", "BGN", "PKR", None]
    assert [None if v is None else float(v) for v in values(money.first_amount_in_text, ["0.5 then 30.25", "no"])] == [30.25, None]


def test_name_key(values):
    assert values(names.name_key, ["test supplier", "test_supplier", " test-supplier ", "", None]) == ["TEST SUPPLIER"] * 3 + ["", ""]


def test_invoice_number_from_name(values):
    got = values(names.invoice_number_from_name, ["Facture-6355.pdf", "scan20231.pdf", "letter.pdf", "INV 12.pdf"])
    assert got == ["6355", "20231", "letter", "12"]


def test_dates(values):
    d = dt.date
    assert values(lambda c: dates.parse_date(c, MATCH_DATE_FORMATS), ["2024-01-15", "15/01/2024", "1/31/2024", "15.1.2024", "5-Jan-24", "x"]) == [
        d(2024, 1, 15), d(2024, 1, 15), d(2024, 1, 31), d(2024, 1, 15), d(2024, 1, 5), None]
    assert values(lambda c: dates.parse_date(c, REPLY_DATE_FORMATS), ["March 5, 2023", "Mar 5, 2023", "05/03/2023", "5-3-23"]) == [d(2023, 3, 5)] * 4
    assert values(dates.date_in_text, ["bill 1-2-2023.pdf", "bill_2023-02-01.pdf", "bill.pdf"]) == [d(2023, 2, 1), d(2023, 2, 1), None]
    assert values(dates.month_number, ["January", "december", "x"]) == [1, 12, None]
    assert values(dates.month_text, ["January 2023"]) == [d(2023, 1, 1)]
    assert values(dates.excel_serial, ["45000"]) == [d(2023, 3, 15)]


def test_numeric_score(values):
    rows = [("100", "100.05"), ("100", "103"), ("100", "108"), ("100", "200"), ("0", "0"), ("0", "50"), ("abc", "100"), ("-100", "100")]
    assert values(replies.numeric_score, rows, "e string, x string") == [1.0, 0.8, 0.5, 0.0, 1.0, 0.0, 0.0, 1.0]


def test_date_score(values):
    rows = [("2024-01-15", "15/01/2024"), ("2024-01-15", "2024-01-16"), ("2024-01-15", "2024-01-20"), ("2024-01-15", "2024-06-15"), ("x", "2024-01-15")]
    assert values(replies.date_text_score, rows, "e string, x string") == [1.0, 0.8, 0.5, 0.0, 0.0]


def test_field_score(values):
    rows = [("currency", "EUR", "EUR - Euro"), ("currency", "EUR", None), ("currency", None, "EUR"), ("transactor", "acme corp ltd", "Acme Corp"),
            ("currency", "EUR", ""), ("date", "2024-01-15", "2024-01-16"), ("transactor", "acme", "")]
    assert values(replies.field_score, rows, "f string, e string, x string") == [0.8, 0.0, None, 0.6667, 0.0, 0.8, 0.0]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_word_error_rate(values):
    long_a = " ".join(f"w{i * 7 % 501}" for i in range(900))
    long_b = " ".join(f"w{i * 7 % 499}" for i in range(850))
    rows = [("a b c", "A b c"), ("a b", "c d"), ("", ""), ("", "x"), ("a b c d", "a c d e"), ("one", "x y z"), (long_a, long_b)]
    want = [0.0, 1.0, 0.0, 1.0, 0.5, 1.0, min(1.0, levenshtein(long_a.split(), long_b.split()) / 900)]
    assert values(replies.word_error_rate, rows, "r string, h string") == want


def test_reply_records(values):
    body = '{"Transactor": "A", "Confidence": {"overall": 0.9}, "Amount": 5, "VAT": undefined,}'
    texts = [f"x\n```json\n{body}\n```", f"Result {body} end", f"[{body}, {{\"Transactor\": \"B\"}},]", "no json", "[1, 2", None]
    got = values(replies.reply_records, texts)
    assert [[r["Transactor"] for r in g] for g in got] == [["A"], ["A"], ["A", "B"], [], [], []]
    assert got[1][0]["Confidence"] == '{"overall":0.9}' and got[0][0]["VAT"] is None


def test_description(values):
    got = values(lambda c: replies.description(F.from_json(c, "map<string,string>")), ['{"Description": "None", "Line Items": "bolts"}', '{"Expense Category Account": "IT, cloud"}', '{"Expense Category Account": "IT"}'])
    assert got == ["bolts", "Service: IT, cloud", ""]
