"""The matching rule itself: every transaction against every invoice of its direction."""

from checks.views_sql import BANK, INVOICES, rate, with_views

BASE = f"""inv AS (
  SELECT id, invoice_number, transactor, is_income, date AS inv_date, lower(transactor) AS name,
         lower(invoice_number) AS num, ((amount + vat) * {rate('currency')} * 10000)::BIGINT AS c,
         list_filter(string_split(lower(transactor), ' '), lambda x: length(x) > 3) AS words
  FROM invoices WHERE amount + vat > 0),
txn AS (
  SELECT row_no, date, coalesce(credit, 0) > 0 AS is_credit,
         (CASE WHEN coalesce(credit, 0) > 0 THEN credit ELSE debit END * 10000)::BIGINT AS t,
         lower(description || ' ' || reference) AS txt
  FROM bank WHERE coalesce(credit, 0) > 0 OR coalesce(debit, 0) > 0)"""


def best(name: str, side: str, source: str) -> str:
    """Best accepted invoice per transaction of ``source`` among the invoices with that direction."""
    return f"""{name} AS (
  SELECT row_no, id, a, d, s, n, part, c, t FROM (
    SELECT *, CASE WHEN contains(txt, name) THEN 0.15::DOUBLE ELSE part END AS s,
      CASE WHEN length(num) > 2 AND contains(txt, num) THEN 0.10::DOUBLE ELSE 0::DOUBLE END AS n
    FROM (SELECT *, 0.08::DOUBLE * (len(list_filter(words, lambda w: contains(txt, w)))::DOUBLE / len(words)) AS part
      FROM (
      SELECT *, CASE
          WHEN NOT is_credit AND t * 100 > c * 110 THEN 0::DOUBLE
          WHEN NOT is_credit AND abs(c - t) * 1000 <= c * 5 THEN 0.55::DOUBLE
          WHEN NOT is_credit AND abs(c - t) * 100 <= c * 5 THEN 0.50::DOUBLE
          WHEN NOT is_credit AND abs(c - t) * 100 <= c * 15
            THEN 0.45::DOUBLE - ((abs(c - t)::DOUBLE / c::DOUBLE - 0.05::DOUBLE) / (0.15::DOUBLE - 0.05::DOUBLE)) * 0.25::DOUBLE
          WHEN NOT is_credit THEN 0::DOUBLE
          WHEN t * 100 > c * 102 THEN 0::DOUBLE
          WHEN (c - t) * 1000 <= c * 5 THEN 0.55::DOUBLE
          WHEN (c - t) * 100 <= c * 5 THEN 0.50::DOUBLE
          WHEN (c - t) * 100 <= c * 15
            THEN 0.45::DOUBLE - ((abs(c - t)::DOUBLE / c::DOUBLE - 0.05::DOUBLE) / (0.15::DOUBLE - 0.05::DOUBLE)) * 0.25::DOUBLE
          ELSE 0::DOUBLE END AS a,
        CASE WHEN abs(date - inv_date) = 0 THEN 0.20::DOUBLE WHEN abs(date - inv_date) <= 3 THEN 0.18::DOUBLE
          WHEN abs(date - inv_date) <= 7 THEN 0.15::DOUBLE WHEN abs(date - inv_date) <= 14 THEN 0.10::DOUBLE
          WHEN abs(date - inv_date) <= 30 THEN 0.05::DOUBLE ELSE 0::DOUBLE END AS d
      FROM {source} JOIN inv ON inv.is_income = ({side}))
      WHERE a > 0 OR d > 0))
  WHERE a + d + s + n >= 0.30::DOUBLE
  QUALIFY row_number() OVER (PARTITION BY row_no ORDER BY a + d + s + n DESC, inv_date DESC, abs(c - t), id) = 1)"""


MATCHED = ",\n".join([
    BASE,
    best("first_choice", "is_credit", "txn"),
    "unmatched AS (SELECT * FROM txn WHERE row_no NOT IN (SELECT row_no FROM first_choice))",
    best("second_choice", "NOT is_credit", "unmatched"),
    "matched AS (SELECT * FROM first_choice UNION ALL SELECT * FROM second_choice)",
])

BEST_MATCH = with_views(INVOICES, BANK, MATCHED) + """
SELECT b.file, b.row_no, i.transactor AS matched_supplier, i.invoice_number AS matched_invoice_number,
  coalesce(round_even((a + d + s + n) * 100, 0), 0)::INTEGER AS match_confidence,
  concat_ws('+',
    CASE WHEN a = 0.55::DOUBLE THEN 'exact_amount' WHEN a = 0.50::DOUBLE THEN 'close_amount' WHEN a > 0 THEN 'approx_amount' END,
    CASE WHEN d > 0 THEN 'date_proximity' END,
    CASE WHEN s = 0.15::DOUBLE THEN 'supplier_name' WHEN s > 0 THEN 'partial_name' END,
    CASE WHEN n > 0 THEN 'invoice_number' END) AS match_method,
  ((m.c + 50) // 100)::DOUBLE / 100 AS converted_invoice_amount,
  round((m.c - m.t)::DOUBLE / m.c::DOUBLE * 100, 1) + 0.0::DOUBLE AS amount_difference_pct
FROM bank b LEFT JOIN matched m ON b.row_no = m.row_no LEFT JOIN inv i ON m.id = i.id"""

STATS = with_views(INVOICES, BANK, MATCHED) + """
SELECT file, count(*) AS total, count(id) AS matched,
  printf('%.0f%%', floor(count(id) * 100.0::DOUBLE / count(*) + 0.5)) AS match_rate,
  coalesce(floor(sum(round_even((a + d + s + n) * 100, 0)::INTEGER)::DOUBLE / nullif(count(id), 0)), 0)::INTEGER AS avg_confidence
FROM bank b LEFT JOIN matched m ON b.row_no = m.row_no GROUP BY file"""

LINES_TO_MATCH = with_views(INVOICES, BANK, MATCHED) + """
SELECT b.file, b.row_no - min(b.row_no) OVER (PARTITION BY b.file) + 100 AS row_no, i.invoice_number AS matched_invoice_number,
  coalesce(round_even((a + d + s + n) * 100, 0), 0)::INTEGER AS match_confidence,
  ((m.c + 50) // 100)::DOUBLE / 100 AS converted_invoice_amount,
  CASE WHEN m.id IS NULL THEN '' ELSE 'Invoice ' || i.invoice_number || ': ' || (v.amount + v.vat)::DECIMAL(18,2) || ' ' || v.currency
    || ' (net ' || v.amount || ' + VAT ' || v.vat || ') = ' || format('{:,.2f}', ((m.c + 50) // 100)::DOUBLE / 100) || ' PKR, bank: '
    || format('{:,.2f}', m.t::DOUBLE / 10000) || ' PKR (diff: '
    || format('{:.1f}', round((m.c - m.t)::DOUBLE / m.c::DOUBLE * 100, 1)) || '%)' END AS match_details
FROM bank b LEFT JOIN matched m ON b.row_no = m.row_no LEFT JOIN inv i ON m.id = i.id LEFT JOIN invoices v ON m.id = v.id"""
