"""The derived views as SQL text, written from their definition for the comparison runs."""

RATE = "CASE {c} WHEN 'PKR' THEN 1.0000 WHEN 'EUR' THEN 280.5000 WHEN 'USD' THEN 278.5000 WHEN 'BGN' THEN 143.4000 END::DECIMAL(12,4)"


def rate(column: str) -> str:
    return RATE.format(c=column)


CURRENCY_OF_KEY = "CASE o_orderkey % 4 WHEN 0 THEN 'PKR' WHEN 1 THEN 'EUR' WHEN 2 THEN 'USD' ELSE 'BGN' END"

INVOICES = f"""invoices AS (
  SELECT *, ((amount + vat) * {rate('currency')})::DECIMAL(18,2) AS total_base FROM (
  SELECT o_orderkey AS id, o_orderdate::DATE AS date,
    'INV-' || lpad(o_orderkey::VARCHAR, 9, '0') AS invoice_number,
    c_name || ' Trading' AS transactor,
    o_totalprice::DECIMAL(18,2) AS amount,
    CASE WHEN o_orderkey % 3 = 0 THEN (o_totalprice::DECIMAL(18,2) * 0.20)::DECIMAL(18,2) ELSE 0.00 END::DECIMAL(18,2) AS vat,
    {CURRENCY_OF_KEY} AS currency,
    CASE WHEN o_orderkey % 6 = 0 THEN 'Paid by PayPal' WHEN o_orderkey % 6 = 1 THEN '' ELSE 'Order ' || o_orderkey END AS notes,
    o_orderkey % 5 = 0 AS is_income,
    CASE WHEN o_orderkey % 5 = 0 THEN 'INCOME' WHEN o_orderkey % 7 = 1 THEN 'DEDUCTION' WHEN o_orderkey % 7 = 2 THEN 'BANK FEES'
         WHEN o_orderkey % 7 = 3 THEN NULL ELSE 'EXPENSES with VAT' END AS transaction_type,
    'uploads/scan_inv-' || lpad(o_orderkey::VARCHAR, 9, '0') || '.pdf' AS file_path,
    CASE WHEN o_orderkey % 4 = 0 THEN '0' WHEN o_orderkey % 4 = 1 THEN 'Goods, ' || o_orderpriority
         WHEN o_orderkey % 4 = 2 THEN 'paypal transfer' END AS description,
    CASE WHEN o_orderkey % 9 = 0 THEN 'not json {{' WHEN o_orderkey % 9 = 1 THEN NULL ELSE
      '{{"Transactor": "' || c_name || '", "Kind of Transaction": "' || CASE WHEN o_orderkey % 2 = 0 THEN 'Sales' ELSE 'Deduction' END
      || '", "Expense Category Account": "' || c_mktsegment || '", "Confidence": {{"overall": 0.9}}}}' END AS raw_extraction,
    CASE o_orderkey % 4 WHEN 0 THEN 'invoice' WHEN 1 THEN 'receipt' WHEN 2 THEN 'credit_note' ELSE 'other' END AS document_type
  FROM orders JOIN customer ON o_custkey = c_custkey))"""

SUPPLIERS = """suppliers AS (
  SELECT c_custkey AS arrival,
    CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) || '_TRADING' WHEN c_custkey % 3 = 1 THEN c_name || '-trading'
         ELSE c_name || '  Trading' END AS supplier_name,
    CASE WHEN c_custkey % 11 = 0 THEN '' ELSE r_name END AS category,
    CASE WHEN c_custkey % 11 = 0 THEN []::VARCHAR[] ELSE [r_name, c_mktsegment] END AS categories,
    CASE WHEN c_custkey % 8 = 0 THEN NULL WHEN c_mktsegment = 'MACHINERY' THEN 'EXP. VIES' ELSE 'EXPENSES with VAT' END AS transaction_type,
    CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 = 1 THEN '' ELSE 'VAT' || c_custkey END AS vat_number
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

INCOMING = """incoming AS (
  SELECT c_custkey AS arrival, c_name || ' trading' AS supplier_name, n_name AS category,
         'OTHER EXPENCES' AS transaction_type, 'NEW' || c_custkey AS vat_number
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL
  SELECT s_suppkey + 1000000000, s_name, n_name, 'EXPENSES with VAT', 'SUP' || s_suppkey
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

BANK = f"""bank AS (
  SELECT file, row_no, date, description, reference,
    CASE WHEN row_no % 2 = 0 THEN v END AS debit, CASE WHEN row_no % 2 = 1 THEN v END AS credit
  FROM (SELECT 'statement_' || c_nationkey || '.csv' AS file, o_orderkey AS row_no,
    o_orderdate::DATE + (o_orderkey % 11)::INTEGER AS date,
    CASE WHEN o_orderkey % 4 >= 2 THEN 'Transfer ' || c_name || CASE WHEN o_orderkey % 8 >= 4 THEN ' trading' ELSE '' END
         ELSE 'Card payment' END AS description,
    CASE WHEN o_orderkey % 2 = 1 THEN 'inv-' || lpad(o_orderkey::VARCHAR, 9, '0') ELSE '' END AS reference,
    (o_totalprice::DECIMAL(18,2) * {rate(CURRENCY_OF_KEY)} *
      CASE WHEN o_orderkey % 17 = 0 THEN 40.00 WHEN o_orderkey % 3 = 0 THEN 0.97 WHEN o_orderkey % 3 = 1 THEN 1.00 ELSE 0.50 END::DECIMAL(4,2)
    )::DECIMAL(18,2) AS v
  FROM orders JOIN customer ON o_custkey = c_custkey))"""


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"
