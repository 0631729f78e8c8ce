"""SQL equivalents of the registered queries, written from the rules."""

from __future__ import annotations

from checks.reconcile_sql import BEST_MATCH, LINES_TO_MATCH, STATS
from checks.views_sql import BANK, INCOMING, INVOICES, SUPPLIERS, rate, with_views

ORACLE: dict[str, str] = {"reconcile_best_match": BEST_MATCH, "reconcile_stats": STATS, "statement_to_match": LINES_TO_MATCH}


def add(name: str, *views: str):
    def put(sql: str) -> None:
        ORACLE[name] = (with_views(*views) if views else "") + sql
    return put


def key(column: str) -> str:
    """Normalised supplier name."""
    return f"trim(regexp_replace(translate(upper({column}), '_-', '  '), '\\s+', ' ', 'g'))"


def filled(column: str) -> str:
    return f"nullif(trim({column}), '')"


ROUND4 = "floor(({x}) * 10000 + 0.5::DOUBLE) / 10000"


def four(x: str) -> str:
    return ROUND4.format(x=x)


ONE_SUPPLIER = f"""one_supplier AS (
  SELECT {key('supplier_name')} AS k, * FROM suppliers QUALIFY row_number() OVER (PARTITION BY {key('supplier_name')} ORDER BY arrival) = 1)"""

ENRICHED = f"""enriched AS (
  SELECT i.*, s.category AS s_category, s.categories AS s_categories, s.transaction_type AS s_type, s.vat_number AS s_vat,
         s.k IS NOT NULL AS known
  FROM invoices i LEFT JOIN one_supplier s ON s.k = {key('i.transactor')})"""

# --- statements -------------------------------------------------------------------------------
add("statement_standardise", BANK)("""
SELECT file, row_no + 100 AS row_no, strftime(date, '%Y-%m-%d') AS date,
  description || CASE WHEN n % 3 = 0 THEN ', ref' ELSE '' END AS description,
  CASE WHEN reference <> '' THEN reference END AS reference,
  debit::DOUBLE AS debit, credit::DOUBLE AS credit, CASE WHEN n % 3 = 1 THEN 1.0::DOUBLE END AS balance
FROM (SELECT *, regexp_extract(file, '_(\\d+)', 1)::INTEGER AS n FROM bank)""")

add("header_mapping", BANK)("""
SELECT 'statement_' || n || '.csv' AS file, 'Standard Statement Format' AS detected_format,
  CASE n % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 3 END AS header_row,
  CASE n % 3 WHEN 2 THEN 5 ELSE 6 END AS matched_columns, 1.0::DOUBLE AS confidence,
  coalesce(c, 0) AS row_count,
  CASE n % 3 WHEN 0 THEN 'balance=Balance;credit=Credit;date=Date;debit=Debit;description=Description;reference=Reference'
    WHEN 1 THEN 'balance=Closing Balance;credit=Deposit;date=Transaction Date;debit=Withdrawal;description=Details;reference=Ref'
    ELSE 'amount=Amount;amount_sign=Amount Sign;date=Booking Date;description=Narrative;reference=Ref' END AS mapping
FROM (SELECT n_nationkey AS n FROM nation) LEFT JOIN (
  SELECT regexp_extract(file, '_(\\d+)', 1)::INTEGER AS m, count(*) AS c FROM bank GROUP BY 1) ON n = m""")

NAMED_FILE = "['hsbc ', 'My Wells Fargo ', 'paypal-', 'plain_'][n % 4 + 1] || n || '.csv'"
add("statement_overrides", BANK)(f"""
SELECT {NAMED_FILE} AS file, row_no * 2 + 100 AS row_no, strftime(date + CASE WHEN n % 4 IN (0, 2) THEN 3 ELSE 0 END, '%Y-%m-%d') AS date,
  CASE WHEN n % 4 <> 3 THEN description END AS description, debit::DOUBLE AS debit, credit::DOUBLE AS credit
FROM (SELECT *, regexp_extract(file, '_(\\d+)', 1)::INTEGER AS n FROM bank)""")

add("statement_formats", BANK)(f"""
SELECT {NAMED_FILE} AS file, ['HSBC', 'Wells Fargo', 'PayPal', 'Simple Statement Format'][n % 4 + 1] AS detected_format, 0 AS header_row,
  CASE WHEN n % 4 = 3 THEN 2 ELSE 3 END AS matched_columns, CASE WHEN n % 4 = 3 THEN 0.5 ELSE 0.75 END::DOUBLE AS confidence,
  coalesce(c, 0)::BIGINT AS row_count
FROM (SELECT n_nationkey AS n FROM nation) LEFT JOIN (
  SELECT regexp_extract(file, '_(\\d+)', 1)::INTEGER AS m, sum(CASE WHEN row_no % 10 = 0 THEN 2 ELSE 1 END) AS c FROM bank GROUP BY 1) ON n = m""")

add("quoted_records")(r"""
SELECT doc_id, regexp_replace(coalesce(text, ''), '\r\n|\r|\n', ' ', 'g') AS text, coalesce(source, '') AS source, n_chars::BIGINT AS n_chars,
  4::BIGINT AS n_cells FROM documents""")

# --- money ------------------------------------------------------------------------------------
CODE = "CASE WHEN id % 10 = 9 THEN 'GBP' ELSE currency END"
add("convert_to_base", INVOICES)(f"""
SELECT id, coalesce((amount * r)::DECIMAL(18,2), 0)::DOUBLE AS base_amount,
  CASE WHEN r IS NULL THEN 'Unsupported currency: ' || code END AS conversion_error,
  CASE WHEN code IN ('EUR', 'BGN') THEN replace(amount::VARCHAR, '.', ',') ELSE amount::VARCHAR END AS original_text,
  CASE WHEN code <> 'PKR' AND r IS NOT NULL THEN (amount * r)::DECIMAL(18,2)::VARCHAR END AS converted_text
FROM (SELECT *, {rate('code')} AS r FROM (SELECT id, amount, {CODE} AS code FROM invoices))""")

add("parse_and_format_amount", INVOICES)(f"""
SELECT id, CASE id % 5 WHEN 4 THEN NULL WHEN 2 THEN -amount ELSE amount END::DOUBLE AS parsed,
  CASE WHEN id % 5 IN (0, 1) AND amount < 1000 THEN amount ELSE 0 END::DOUBLE AS setting,
  CASE WHEN id % 5 = 3 OR (id % 5 IN (0, 1) AND amount < 1000) THEN amount END::DOUBLE AS flagged,
  CASE WHEN currency IN ('EUR', 'BGN') THEN replace(amount::VARCHAR, '.', ',') ELSE amount::VARCHAR END AS shown,
  {rate('currency')}::VARCHAR AS rate_text
FROM invoices""")

# --- ledger -----------------------------------------------------------------------------------
add("ledger_by_period", INVOICES)("""
SELECT v AS view, id, strftime(date, '%Y-%m-%d') AS date, invoice_number, total_base::DOUBLE AS total_base FROM (
  SELECT 'expense_month' AS v, * FROM invoices WHERE NOT is_income AND year(date) = 1996 AND month(date) = 2
  UNION ALL SELECT 'income_year', * FROM invoices WHERE is_income AND year(date) = 1997
  UNION ALL SELECT 'income_month_only', * FROM invoices WHERE is_income
  UNION ALL SELECT 'range', * FROM invoices WHERE date >= DATE '1998-01-01' AND date <= DATE '1998-03-31')""")

add("ledger_years", INVOICES)("SELECT DISTINCT year(date)::INTEGER AS year FROM invoices")

add("invoice_search", INVOICES, SUPPLIERS)("""
(SELECT id, 'number' AS how FROM invoices WHERE invoice_number ILIKE '%v-0000007%' ORDER BY id LIMIT 1)
UNION ALL SELECT id, 'transactor' FROM invoices WHERE transactor = 'Customer#000000007 Trading'
UNION ALL SELECT arrival, 'supplier' FROM suppliers WHERE supplier_name ILIKE '%asia%' OR category ILIKE '%asia%'""")

add("amount_proximity", INVOICES, BANK)("""
SELECT DISTINCT id, target::DOUBLE AS target FROM (
  SELECT id, target FROM (SELECT DISTINCT coalesce(debit, credit) AS target FROM bank) t
    JOIN invoices i ON i.amount > t.target - 5 AND i.amount < t.target + 5
  UNION ALL
  SELECT id, target FROM (SELECT DISTINCT coalesce(debit, credit) AS target FROM bank) t
    JOIN invoices i ON i.total_base > t.target - 5 AND i.total_base < t.target + 5)
UNION ALL
SELECT id, 250000.0::DOUBLE FROM invoices WHERE abs(amount - 250000) < 100 OR abs(total_base - 250000) < 100""")

add("amount_neighbours", INVOICES, BANK)("""
, targets AS (SELECT DISTINCT coalesce(debit, credit) AS target FROM bank)
, met AS (SELECT target, id, min(abs(v - target)) AS away FROM (
    SELECT target, id, amount AS v FROM targets JOIN invoices ON amount > target - 5 AND amount < target + 5
    UNION ALL SELECT target, id, total_base FROM targets JOIN invoices ON total_base > target - 5 AND total_base < target + 5) GROUP BY 1, 2)
SELECT target::DOUBLE AS target, 'count' AS what, count(id) AS n FROM targets LEFT JOIN met USING (target) WHERE target IS NOT NULL GROUP BY 1
UNION ALL
SELECT target::DOUBLE, 'id', id FROM met QUALIFY row_number() OVER (PARTITION BY target ORDER BY away, id) <= 3""")

add("supplier_enrich", INVOICES, SUPPLIERS, ONE_SUPPLIER, ENRICHED)(f"""
SELECT id, coalesce({filled('description')}, {filled('notes')}, 'No description available') AS description,
  kind AS transaction_type, coalesce(s_type, CASE WHEN known THEN 'Not specified' END, kind) AS account_description,
  coalesce(nullif(s_category, ''), nullif(array_to_string(s_categories, ', '), ''), 'Not specified') AS expense_category,
  coalesce(s_vat, '') AS vat_number, (amount + vat)::DOUBLE AS total_amount,
  CASE WHEN currency IN ('EUR', 'BGN') THEN replace((amount + vat)::DECIMAL(18,2)::VARCHAR, '.', ',')
       ELSE (amount + vat)::DECIMAL(18,2)::VARCHAR END AS total_text
FROM (SELECT *, coalesce({filled('transaction_type')}, CASE WHEN is_income THEN 'INCOME' ELSE 'EXPENSE' END) AS kind FROM enriched)""")

add("supplier_by_category", SUPPLIERS, ONE_SUPPLIER)("""
SELECT arrival, 'category' AS how FROM suppliers WHERE category = 'MACHINERY' OR list_contains(categories, 'MACHINERY')
UNION ALL SELECT arrival, 'type' FROM suppliers WHERE transaction_type = 'EXP. VIES'
UNION ALL SELECT arrival, 'name' FROM one_supplier WHERE k = 'CUSTOMER#000000004 TRADING'""")

add("supplier_upsert", SUPPLIERS, INCOMING)(f"""
, base AS (SELECT {key('supplier_name')} AS k, * FROM suppliers),
inc AS (SELECT {key('supplier_name')} AS k, * FROM incoming)
SELECT coalesce(b.k, i.k) AS name_key, coalesce(b.supplier_name, i.supplier_name) AS supplier_name,
  coalesce({filled('b.transaction_type')}, {filled('i.transaction_type')}) AS transaction_type,
  coalesce({filled('b.vat_number')}, {filled('i.vat_number')}) AS vat_number,
  CASE WHEN b.k IS NULL THEN i.category ELSE b.category END AS category,
  CASE WHEN b.k IS NULL THEN i.category
       ELSE array_to_string(list_filter(list_concat(b.categories,
         CASE WHEN i.category IS NULL OR list_contains(b.categories, i.category) THEN [] ELSE [i.category] END), lambda x: x <> ''), '|') END AS categories,
  (b.k IS NULL)::INTEGER AS is_new,
  (b.k IS NOT NULL AND {filled('b.vat_number')} IS NULL AND {filled('i.vat_number')} IS NOT NULL)::INTEGER AS vat_filled
FROM base b FULL JOIN inc i ON b.k = i.k""")

add("supplier_changes", SUPPLIERS, INCOMING)(f"""
, edited AS (SELECT {key('supplier_name')} AS k, * FROM incoming WHERE category > 'NATION_2'),
gone AS (SELECT {key('supplier_name')} AS k FROM incoming WHERE category = 'NATION_7')
SELECT s.arrival, CASE WHEN e.k IS NULL THEN s.category ELSE e.category END AS category,
  CASE WHEN e.k IS NULL THEN array_to_string(s.categories, '|') ELSE e.category || '|Extra' END AS categories,
  CASE WHEN e.k IS NULL THEN s.transaction_type ELSE e.transaction_type END AS transaction_type,
  CASE WHEN e.k IS NULL THEN s.vat_number ELSE e.vat_number END AS vat_number
FROM suppliers s LEFT JOIN edited e ON e.k = {key('s.supplier_name')}
WHERE {key('s.supplier_name')} NOT IN (SELECT k FROM gone)""")

SHEET = """sheet_rows AS (
  SELECT c_custkey, c_name, n_name, r_name, r_regionkey % 2 = 0 AS named, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE c_mktsegment END AS segment
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
add("supplier_import", SHEET)("""
SELECT lower(c_name) AS supplier_name, CASE WHEN named THEN NULL ELSE 'EXPENSES with VAT' END AS transaction_type,
  nullif(segment, '') AS category FROM sheet_rows""")
add("supplier_import_stats", SHEET)("""
SELECT count(*) AS total_suppliers, count(*) FILTER (WHERE n_name <= 'NATION_2') AS new_suppliers,
  count(*) FILTER (WHERE n_name > 'NATION_2') AS updated_suppliers FROM sheet_rows""")

add("invoice_merge", INVOICES, SUPPLIERS)("""
, named AS (SELECT replace(supplier_name, '  ', ' ') AS n, min(arrival) AS sid FROM suppliers GROUP BY 1),
top AS (SELECT max(id) AS m FROM invoices),
grown AS (
  SELECT id, invoice_number, amount, notes, NULL::BIGINT AS supplier_id, is_income, currency FROM invoices
  UNION ALL
  SELECT (SELECT m FROM top) + row_number() OVER (ORDER BY id), invoice_number, amount, notes, sid, is_income, currency
  FROM invoices LEFT JOIN named ON n = transactor)
SELECT id, invoice_number, (CASE WHEN NOT is_income THEN amount + 1 ELSE amount END)::DOUBLE AS amount,
  CASE WHEN NOT is_income AND currency = 'EUR' THEN 'edited' ELSE notes END AS notes, coalesce(supplier_id, -1) AS supplier_id, is_income::INTEGER AS is_income
FROM grown WHERE NOT (currency = 'BGN' AND is_income)""")

add("ledger_month_edits", INVOICES)("""
SELECT id, CASE WHEN month(date) = 3 AND currency = 'EUR' THEN strftime(date + INTERVAL 1 MONTH, '%Y-%m-%d') ELSE strftime(date, '%Y-%m-%d') END AS date,
  (CASE WHEN month(date) = 3 THEN amount + 1 ELSE amount END)::DOUBLE AS amount,
  CASE WHEN month(date) = 3 THEN 'edited' ELSE notes END AS notes
FROM invoices WHERE date IS NULL OR NOT (month(date) = 5 AND currency = 'BGN')
UNION ALL SELECT -id - 1, strftime(date, '%Y-%m-%d'), amount::DOUBLE, notes FROM invoices WHERE month(date) = 7""")

add("snapshot_export", INVOICES, SUPPLIERS, ONE_SUPPLIER, ENRICHED)(f"""
SELECT id AS invoice_id, s_category AS category, array_to_string(s_categories, '|') AS categories,
  coalesce({filled('transaction_type')}, s_type) AS transaction_type, s_vat AS vat_number,
  CASE WHEN json_valid(raw_extraction) THEN json_extract_string(raw_extraction, '$."Kind of Transaction"') END AS raw_kind,
  raw_extraction
FROM enriched""")

add("page_slice", INVOICES)("""
, placed AS (SELECT id, row_number() OVER (ORDER BY date DESC, id) AS n, count(*) OVER () AS total FROM invoices)
SELECT 'third' AS page, id FROM placed WHERE n BETWEEN 41 AND 60
UNION ALL SELECT 'last', id FROM placed WHERE n > (total - 1) // 20 * 20
UNION ALL SELECT 'rows', count(*) FROM placed
UNION ALL SELECT 'pages', (count(*) + 19) // 20 FROM placed""")

add("file_to_invoice", INVOICES)("""
SELECT file_path AS file, id FROM invoices WHERE contains(lower(file_path), lower(invoice_number))""")

# --- replies ----------------------------------------------------------------------------------
REPLIES = """answers AS (
  SELECT o_orderkey AS doc_id, stage_no, ['cloud', 'text', 'local'][stage_no + 1] AS stage, (o_orderkey + stage_no * 2) % 5 <> 3 AS readable,
    c_name || ' Trading' AS transactor, c_mktsegment AS segment, o_totalprice::DECIMAL(18,2) AS net, o_orderdate::DATE AS date,
    lpad(o_orderkey::VARCHAR, 9, '0') AS digits,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN '$' || format('{:t,}', o_totalprice::DECIMAL(18,2))
         ELSE o_totalprice::VARCHAR END AS amount_text,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'BG' || o_orderkey END AS vat_text
  FROM orders JOIN customer ON o_custkey = c_custkey, (VALUES (0), (1), (2)) s(stage_no))"""
DOLLARS = """'$' || regexp_replace(split_part(o_totalprice::DECIMAL(18,2)::VARCHAR, '.', 1), '(\\d)(\\d{3})$', '\\1,\\2') || '.' || split_part(o_totalprice::DECIMAL(18,2)::VARCHAR, '.', 2)"""
REPLIES = REPLIES.replace("'$' || format('{:t,}', o_totalprice::DECIMAL(18,2))", DOLLARS)

add("extract_json", REPLIES)("""
SELECT doc_id, stage, readable::INTEGER AS records, CASE WHEN readable THEN transactor END AS transactor,
  CASE WHEN readable THEN amount_text END AS amount_text, CASE WHEN readable THEN vat_text END AS vat_text FROM answers""")

add("extraction_first_success", REPLIES)("""
SELECT mode, doc_id, stage, (stage_no + 1)::INTEGER AS attempt
FROM answers JOIN (VALUES ('auto', 'cloud'), ('auto', 'text'), ('auto', 'local'), ('cloud', 'cloud'), ('cloud', 'text'), ('local', 'local')) m(mode, s) ON s = stage
WHERE readable QUALIFY row_number() OVER (PARTITION BY mode, doc_id ORDER BY stage_no) = 1""")

CHOSEN = """chosen AS (SELECT * FROM answers WHERE readable QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY stage_no) = 1)"""
add("extraction_to_invoice", REPLIES, CHOSEN)(f"""
, typed AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE net END AS a0, CASE WHEN doc_id % 3 = 0 THEN 12.50 ELSE 0 END AS v0,
    CASE WHEN doc_id % 2 = 0 THEN net + 20 ELSE 0 END AS t0,
    CASE doc_id % 5 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'GBP' ELSE 'PKR' END AS code FROM chosen),
sums AS (SELECT *, (CASE WHEN t0 > 0 AND a0 = 0 THEN t0 - v0 ELSE a0 END)::DECIMAL(18,2) AS amount,
    (CASE WHEN t0 > 0 AND a0 > 0 AND v0 = 0 THEN t0 - a0 ELSE v0 END)::DECIMAL(18,2) AS vat FROM typed)
SELECT doc_id,
  CASE WHEN doc_id % 4 = 3 AND doc_id % 2 = 0 THEN '2002-01-01' ELSE strftime(date, '%Y-%m-%d') END AS date,
  CASE WHEN doc_id % 3 <> 0 THEN 'INV-' || digits WHEN doc_id % 2 = 0 THEN digits ELSE strftime(date, '%Y') END AS invoice_number,
  transactor, amount::DOUBLE AS amount, vat::DOUBLE AS vat,
  CASE WHEN code <> 'GBP' THEN ((amount + greatest(vat, 0)) * {rate('code')})::DECIMAL(18,2)::DOUBLE END AS total_base,
  CASE WHEN code = 'GBP' THEN 'Unsupported currency: GBP' END AS conversion_error, code AS currency,
  CASE WHEN doc_id % 4 = 1 THEN 'Service: ' || segment || ', general' ELSE 'Order ' || doc_id END AS description
FROM sums""")

add("extraction_suppliers", REPLIES, CHOSEN, SUPPLIERS, ONE_SUPPLIER)(f"""
SELECT doc_id, coalesce({filled('s.category')}, segment || ', general') AS category,
  CASE WHEN len(s.categories) > 0 THEN array_to_string(s.categories, '|') ELSE segment || ', general' END AS categories,
  coalesce({filled('s.transaction_type')}, 'DEDUCTION') AS transaction_type,
  coalesce({filled('s.vat_number')}, vat_text, '') AS vat_number, (s.k IS NULL)::INTEGER AS is_new,
  (s.k IS NOT NULL AND {filled('s.vat_number')} IS NULL AND vat_text IS NOT NULL)::INTEGER AS vat_updated
FROM chosen LEFT JOIN one_supplier s ON s.k = {key('transactor')}""")

add("confidence_merge", REPLIES)("""
, fields AS (
  SELECT doc_id, stage_no, unnest([
    {'field': 'Amount', 'value': amount_text, 'confidence': ('0.' || (stage_no * 3 + doc_id % 3 + 1))::DOUBLE},
    {'field': 'Transactor', 'value': transactor, 'confidence': 0.5::DOUBLE},
    {'field': 'Currency', 'value': CASE doc_id % 5 WHEN 0 THEN 'eur' WHEN 1 THEN 'USD' WHEN 2 THEN 'GBP' WHEN 3 THEN 'XXX' END, 'confidence': 0::DOUBLE},
    {'field': 'Invoice Number', 'value': CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'INV-' || digits END, 'confidence': 0::DOUBLE},
    {'field': 'Invoice Date', 'value': CASE doc_id % 4 WHEN 0 THEN strftime(date, '%Y-%m-%d') WHEN 1 THEN strftime(date, '%d/%m/%Y')
      WHEN 2 THEN strftime(date, '%B %-d, %Y') ELSE '' END, 'confidence': 0::DOUBLE},
    {'field': 'Tax Amount', 'value': CASE WHEN doc_id % 3 = 0 THEN '12.5' ELSE '0' END, 'confidence': 0::DOUBLE},
    {'field': 'Total Amount', 'value': CASE WHEN doc_id % 2 = 0 THEN (net + 20)::DOUBLE::VARCHAR ELSE '' END, 'confidence': 0::DOUBLE},
    {'field': 'Description', 'value': CASE WHEN doc_id % 4 = 1 THEN 'None' ELSE 'Order ' || doc_id END, 'confidence': 0::DOUBLE},
    {'field': 'Expense Category Account', 'value': segment || ', general', 'confidence': 0::DOUBLE},
    {'field': 'Kind of Transaction', 'value': 'DEDUCTION', 'confidence': 0::DOUBLE},
    {'field': 'VAT', 'value': vat_text, 'confidence': 0::DOUBLE}], recursive := true)
  FROM answers WHERE readable)
SELECT doc_id, field, value, confidence FROM fields WHERE value IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY confidence DESC, stage_no) = 1""")

add("replies_to_suppliers", REPLIES, CHOSEN, SUPPLIERS)(f"""
, half AS (SELECT {key('supplier_name')} AS k, * FROM suppliers WHERE arrival % 2 = 0),
named AS (SELECT {key('transactor')} AS k, any_value(transactor) AS transactor, any_value(segment || ', general') AS account,
    arg_min(vat_text, doc_id) FILTER (WHERE vat_text IS NOT NULL) AS vat FROM chosen GROUP BY 1)
SELECT coalesce(h.k, n.k) AS name_key, coalesce(h.supplier_name, n.transactor) AS supplier_name,
  CASE WHEN h.k IS NULL THEN account ELSE h.category END AS category,
  CASE WHEN h.k IS NULL THEN account ELSE array_to_string(list_concat(h.categories, CASE WHEN account IS NULL THEN [] ELSE [account] END), '|') END AS categories,
  coalesce({filled('h.transaction_type')}, CASE WHEN n.k IS NOT NULL THEN 'DEDUCTION' END) AS transaction_type,
  coalesce({filled('h.vat_number')}, n.vat) AS vat_number, (h.k IS NULL)::INTEGER AS is_new,
  (h.k IS NOT NULL AND {filled('h.vat_number')} IS NULL AND n.vat IS NOT NULL)::INTEGER AS vat_filled
FROM half h FULL JOIN named n ON h.k = n.k""")

add("supplier_import_master", SHEET)(f"""
, placed AS (SELECT *, {key("c_name || ' Co'")} AS k, CASE WHEN c_custkey % 10 = 0 THEN [n_name, seg] ELSE [seg, n_name] END AS listed
  FROM (SELECT s.*, c.c_mktsegment AS seg FROM sheet_rows s JOIN customer c ON c.c_custkey = s.c_custkey))
SELECT k AS name_key, CASE WHEN c_custkey % 2 = 0 THEN c_name || ' CO' ELSE c_name || '-Co' END AS supplier_name,
  CASE WHEN c_custkey % 2 = 0 THEN 'KNOWN' WHEN c_custkey % 10 = 0 THEN NULL ELSE seg END AS category,
  CASE WHEN c_custkey % 2 = 0 THEN 'KNOWN|' ELSE '' END || array_to_string(listed, '|') AS categories,
  'EXPENSES with VAT' AS transaction_type, CASE WHEN c_custkey % 2 = 0 THEN 'NEW' || c_custkey END AS vat_number,
  CASE WHEN c_custkey % 2 = 0 THEN '{{"arrival":' || c_custkey || '}}' END AS raw_extraction, (c_custkey % 2 <> 0)::INTEGER AS is_new
FROM placed""")

add("names_and_dates", INVOICES)(f"""
, f AS (SELECT id, date, invoice_number, id % 2 = 0 AS even, lpad(id::VARCHAR, 9, '0') AS digits,
          day(date) || '-' || month(date) || '-' || year(date) AS written FROM invoices)
SELECT id AS doc_id, CASE WHEN even THEN digits ELSE year(date)::VARCHAR END AS number,
  CASE WHEN NOT even THEN strftime(date, '%Y-%m-%d') END AS date,
  CASE WHEN even THEN 'INVOICE ' || digits || '.PDF' ELSE 'SCAN ' || replace(written, '-', ' ') || '.PDF' END AS name_key,
  strftime(DATE '1899-12-30' + id::INTEGER, '%Y-%m-%d') AS serial_date
FROM f""")

# --- reports ----------------------------------------------------------------------------------
ITEMS = f"""items AS (
  SELECT CASE WHEN is_income THEN 'INCOME' ELSE 'EXPENSES' END AS sheet, date, invoice_number, transactor,
    CASE WHEN txt = '0' THEN '' ELSE txt END AS description,
    coalesce(nullif(array_to_string(list_filter(s_categories, lambda x: x <> ''), ', '), ''), nullif(s_category, ''), '') AS expense_category,
    coalesce({filled('s_type')}, {filled('transaction_type')}, CASE WHEN is_income THEN 'INCOME' ELSE 'EXPENSES with VAT' END) AS kind_of_transaction,
    CASE WHEN currency = 'USD' THEN amount END AS amount, CASE WHEN vat <> 0 THEN vat END AS vat,
    CASE WHEN currency = 'BGN' THEN total_base END AS total_bgn, CASE WHEN currency <> 'BGN' THEN total_base END AS total_eur,
    CASE WHEN currency = 'BGN' THEN 'BG' ELSE 'EU' END AS currency,
    CASE WHEN description ILIKE '%paypal%' OR notes ILIKE '%paypal%' THEN 'PAYPAL' ELSE 'supplier' END AS payment_method,
    (currency = 'USD' AND total_base > 0) AS fx_warning, total_base AS total
  FROM (SELECT *, coalesce({filled('description')}, {filled('notes')}, '') AS txt FROM enriched)
  UNION ALL
  SELECT 'EXPENSES', date, '', to_whom, '', '', CASE WHEN fee THEN 'BANK FEES' ELSE 'PAYMENT' END, NULL, NULL, NULL, debit, 'EU', 'BANK', false, debit
  FROM (SELECT *, CASE WHEN fee THEN 'BANK' WHEN reference <> '' THEN reference ELSE 'Unknown Payee' END AS to_whom
        FROM (SELECT *, debit <= 17 AS fee FROM bank WHERE debit >= 0.01)) b
  WHERE NOT EXISTS (SELECT 1 FROM invoices e WHERE NOT e.is_income AND e.date = b.date AND e.transactor = b.to_whom
                    AND abs(e.total_base - b.debit) < 0.01))"""
REPORT = (INVOICES, SUPPLIERS, BANK, ONE_SUPPLIER, ENRICHED, ITEMS)
add("report_expenses", *REPORT)("""
SELECT sheet, strftime(date, '%Y-%m-%d') AS date, invoice_number, transactor, description, expense_category, kind_of_transaction,
  amount::DOUBLE AS amount, vat::DOUBLE AS vat, total_bgn::DOUBLE AS total_bgn, total_eur::DOUBLE AS total_eur, currency,
  payment_method, fx_warning::INTEGER AS fx_warning FROM items""")
add("report_bank_duplicates", INVOICES)("""
, spent AS (SELECT * FROM invoices WHERE NOT is_income)
SELECT CASE WHEN is_income THEN 'INCOME' ELSE 'EXPENSES' END AS sheet, strftime(date, '%Y-%m-%d') AS date, invoice_number, transactor,
  total_base::DOUBLE AS total FROM invoices
UNION ALL
SELECT 'EXPENSES', strftime(date, '%Y-%m-%d'), '', transactor, (total_base + 1)::DOUBLE FROM spent s
WHERE id % 2 <> 0 AND NOT EXISTS (SELECT 1 FROM spent o WHERE o.date = s.date AND o.transactor = s.transactor AND o.total_base = s.total_base + 1)""")
add("report_summary", *REPORT)("""
SELECT coalesce(y, 0)::INTEGER AS year, coalesce(m, 0)::INTEGER AS month, CASE g WHEN 0 THEN 'month' WHEN 1 THEN 'year' ELSE 'all' END AS level,
  inc::DOUBLE AS income, spent::DOUBLE AS expenses, (inc - spent)::DOUBLE AS net
FROM (SELECT year(date) AS y, month(date) AS m, grouping_id(year(date), month(date)) AS g,
        coalesce(sum(total) FILTER (WHERE sheet = 'INCOME'), 0) AS inc,
        coalesce(sum(total) FILTER (WHERE sheet = 'EXPENSES'), 0) AS spent
      FROM items GROUP BY ROLLUP (year(date), month(date)))""")
add("report_month", *REPORT)("""
SELECT strftime(date, '%Y-%m-%d') AS date, invoice_number, transactor, kind_of_transaction, total_bgn::DOUBLE AS total_bgn,
  total_eur::DOUBLE AS total_eur, payment_method
FROM items WHERE sheet = 'EXPENSES' AND year(date) = 1997 AND month(date) = 3""")
add("report_alerts")("""
SELECT 'EXPENSES' AS sheet, event_type AS transactor, event_id::VARCHAR AS invoice_number, field, v::DOUBLE AS value,
  'REVIEW NEEDED: Suspicious amount value ''' || v::VARCHAR || ''' for ' || event_type || ' (Invoice: ' || event_id || ', Column: ' || field || ')' AS alert
FROM (SELECT *, 'amount' AS field, (value::DECIMAL(18,2) - 1)::DECIMAL(18,2) AS v FROM events
      UNION ALL SELECT *, 'total_eur', value::DECIMAL(18,2) FROM events)
WHERE v < 0.01""")
UNDATED = INVOICES.replace("o_orderdate::DATE AS date", "CASE WHEN o_orderkey % 50 <> 0 THEN o_orderdate::DATE END AS date")
MARCH = "coalesce(date, DATE '1997-03-01') BETWEEN DATE '1997-03-01' AND DATE '1997-03-31'"
add("report_undated", UNDATED, SUPPLIERS, BANK, ONE_SUPPLIER, ENRICHED, ITEMS)(f"""
, march AS (SELECT * FROM items WHERE {MARCH})
SELECT part, total::DOUBLE AS total FROM (
  SELECT unnest(['summary income', 'INCOME']) AS part, sum(total) FILTER (WHERE sheet = 'INCOME') AS total FROM march
  UNION ALL SELECT unnest(['summary expenses', 'EXPENSES']), sum(total) FILTER (WHERE sheet = 'EXPENSES') FROM march
  UNION ALL SELECT 'alerts', count(*) FROM march WHERE amount < 0.01 OR total_bgn < 0.01 OR total_eur < 0.01)""")
KINDS = f"""kinds AS (
  SELECT *, coalesce({filled('transaction_type')}, CASE WHEN json_valid(raw_extraction)
    THEN json_extract_string(raw_extraction, '$."Kind of Transaction"') END, '') AS kind,
    CASE WHEN json_valid(raw_extraction) THEN raw_extraction END AS raw FROM {{source}})"""
IS_INCOME = "regexp_matches(upper(kind), 'INCOME|COLLECTION|SALES')"
add("monthly_report", INVOICES, KINDS.format(source="invoices"))(f"""
SELECT strftime(date_trunc('month', date), '%Y-%m-%d') AS month_start,
  coalesce(sum(total_base) FILTER (WHERE {IS_INCOME}), 0)::DOUBLE AS income,
  coalesce(sum(total_base) FILTER (WHERE NOT {IS_INCOME}), 0)::DOUBLE AS expenses,
  (coalesce(sum(total_base) FILTER (WHERE {IS_INCOME}), 0) - coalesce(sum(total_base) FILTER (WHERE NOT {IS_INCOME}), 0))::DOUBLE AS net
FROM kinds GROUP BY 1""")
add("monthly_income_sheet", INVOICES, KINDS.format(source="invoices"))(f"""
SELECT id, strftime(date, '%Y-%m-%d') AS date, coalesce(json_extract_string(raw, '$."Kind of Transaction"'), kind) AS kind_of_transaction,
  coalesce(json_extract_string(raw, '$.Transactor'), transactor) AS transactor, amount::DOUBLE AS net_amount, vat::DOUBLE AS vat,
  (amount + vat)::DOUBLE AS total_amount
FROM kinds WHERE {IS_INCOME}""")
add("four_field_export", INVOICES, SUPPLIERS, ONE_SUPPLIER, ENRICHED, KINDS.format(source="enriched"))(f"""
SELECT id, transactor AS supplier_name,
  coalesce(nullif(array_to_string(s_categories, ', '), ''), nullif(s_category, ''), json_extract_string(raw, '$."Expense Category Account"'), '') AS service_category,
  kind AS transaction_type, coalesce({filled('s_vat')}, '') AS vat_number FROM kinds""")
add("extraction_four_fields", INVOICES)("""
, r AS (SELECT *, CASE WHEN json_valid(raw_extraction) THEN raw_extraction END AS raw FROM invoices)
SELECT id, coalesce(CASE WHEN id % 3 <> 0 THEN transactor END, json_extract_string(raw, '$.Transactor'), '') AS supplier_name,
  CASE id % 4 WHEN 0 THEN 'A, B' WHEN 1 THEN 'Single' ELSE coalesce(json_extract_string(raw, '$."Expense Category Account"'), '') END AS service_category,
  coalesce(CASE WHEN id % 5 < 2 THEN transaction_type END, json_extract_string(raw, '$."Kind of Transaction"'), '') AS transaction_type,
  coalesce(CASE WHEN id % 2 = 0 THEN 'VAT' || id END, CASE WHEN id % 7 <> 0 THEN vat::VARCHAR END, '') AS vat_number
FROM r""")
add("reconciled_export", INVOICES, BANK)("""
SELECT file, row_no AS id, coalesce(debit, credit)::DOUBLE AS amount FROM bank
UNION ALL SELECT 'ledger', id, amount::DOUBLE FROM invoices
UNION ALL SELECT 'by id', id, amount::DOUBLE FROM invoices WHERE id = 1""")
GROUPED = "regexp_replace(regexp_replace({c}::VARCHAR, '(\\d)(\\d{{3}})\\.', '\\1,\\2.'), '(\\d)(\\d{{3}}),', '\\1,\\2,')"
EXPORT_COLUMNS = ["id", "date", "invoice_number", "transactor", "amount", "vat", "total_base", "currency", "supplier_id", "notes",
                  "is_income", "transaction_type", "file_path", "description", "raw_extraction", "document_type"]
EXPORT = f"""shown AS (
  SELECT id, strftime(date, '%Y-%m-%d') AS date, invoice_number, transactor, {GROUPED.format(c='amount')} AS amount,
    {GROUPED.format(c='vat')} AS vat, {GROUPED.format(c='total_base')} AS total_base, currency, NULL::BIGINT AS supplier_id, notes,
    is_income, transaction_type, file_path, coalesce(description, '') AS description, raw_extraction, document_type
  FROM invoices)"""
add("ledger_export", INVOICES, EXPORT)("SELECT * REPLACE (is_income::INTEGER AS is_income, coalesce(supplier_id, -1) AS supplier_id) FROM shown")
add("export_widths", INVOICES, EXPORT)("\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", (greatest(coalesce(max(length({c}::VARCHAR)), 0), {len(c)}) + 2)::INTEGER AS width FROM shown"
    for c in EXPORT_COLUMNS))
add("unseen_by_number", INVOICES)("""
, session AS (SELECT CASE l_orderkey % 3 WHEN 0 THEN 'INV-' || lpad(l_orderkey::VARCHAR, 9, '0') WHEN 1 THEN 'NEW-' || l_orderkey END AS n
              FROM (SELECT DISTINCT l_orderkey FROM lineitem))
SELECT transactor, count(*) AS rows FROM (
  SELECT transactor FROM invoices
  UNION ALL SELECT 'session' FROM session WHERE n IS NULL OR n NOT IN (SELECT invoice_number FROM invoices)) GROUP BY 1""")

# --- evaluation -------------------------------------------------------------------------------
SCORED = """runs AS (
  SELECT i.*, m, (id + m * 3) % 7 AS turn, CASE WHEN m = 0 THEN 'alpha' ELSE 'beta' END AS model, 'doc_' || id || '.pdf' AS file,
    CASE WHEN id % 19 = 0 AND m = 1 THEN 'file_not_found' WHEN id % 13 = 0 THEN 'error' WHEN id % 17 = 0 THEN 'extraction_returned_none' ELSE 'success' END AS status,
    CASE WHEN NOT (id % 19 = 0 AND m = 1) THEN ((id % 100 + m * 7 + 1)::DOUBLE / 100) END AS seconds
  FROM invoices i, (VALUES (0), (1)) v(m)),
answered AS (SELECT *, (amount * CASE turn WHEN 0 THEN 1.0005 WHEN 1 THEN 1.03 WHEN 2 THEN 1.08 WHEN 3 THEN 1.20 ELSE 1 END::DECIMAL(6,4))::DECIMAL(18,2) AS got FROM runs WHERE status = 'success'),
scores AS (
  SELECT model, file, 'transactor' AS field, CASE turn WHEN 6 THEN 0.5::DOUBLE ELSE 1::DOUBLE END AS score FROM answered
  UNION ALL SELECT model, file, 'invoice_number', CASE turn WHEN 4 THEN 0.8::DOUBLE ELSE 1::DOUBLE END FROM answered
  UNION ALL SELECT model, file, 'date', CASE turn WHEN 1 THEN 0.8::DOUBLE WHEN 2 THEN 0.5::DOUBLE WHEN 4 THEN 0::DOUBLE ELSE 1::DOUBLE END FROM answered
  UNION ALL SELECT model, file, 'amount', CASE WHEN off <= 0.001 THEN 1::DOUBLE WHEN off <= 0.05 THEN 0.8::DOUBLE WHEN off <= 0.1 THEN 0.5::DOUBLE ELSE 0::DOUBLE END
    FROM (SELECT *, abs(amount::DOUBLE - got::DOUBLE) / amount::DOUBLE AS off FROM answered)
  UNION ALL SELECT model, file, 'vat', CASE turn WHEN 3 THEN 0::DOUBLE ELSE 1::DOUBLE END FROM answered WHERE id % 3 = 0
  UNION ALL SELECT model, file, 'currency', CASE turn WHEN 0 THEN 0.8::DOUBLE WHEN 1 THEN 0::DOUBLE ELSE 1::DOUBLE END FROM answered
  UNION ALL SELECT model, file, 'description', CASE turn WHEN 2 THEN 0.5::DOUBLE ELSE 0.75::DOUBLE END FROM answered)"""
add("field_scores", INVOICES, SCORED)("SELECT * FROM scores")
MEAN = "sum(score::DECIMAL(20,6))::DOUBLE / count(*)"
add("field_accuracy", INVOICES, SCORED)(f"SELECT model, field, {four(MEAN)} AS accuracy, count(*) AS files FROM scores GROUP BY 1, 2")
add("file_accuracy", INVOICES, SCORED)(f"SELECT model, file, {four(MEAN)} AS accuracy FROM scores GROUP BY 1, 2")
SUMMARY = f"""summary AS (
  SELECT r.model, {four('mean')} AS accuracy, {four('(total - good)::DOUBLE / total')} AS failure_rate,
    {four('spent / timed')} AS avg_time, {four('spent')} AS total_time, total AS total_files, good AS successes, total - good AS failures
  FROM (SELECT model, count(*) AS total, count(*) FILTER (WHERE status = 'success') AS good,
          sum(seconds::DECIMAL(20,6))::DOUBLE AS spent, count(seconds) AS timed FROM runs GROUP BY 1) r
  JOIN (SELECT model, {MEAN} AS mean FROM scores GROUP BY 1) s ON r.model = s.model)"""
add("model_summary", INVOICES, SCORED, SUMMARY)("SELECT * FROM summary")
add("status_counts", INVOICES, SCORED)("SELECT model, status, count(*) AS files FROM runs GROUP BY 1, 2")
add("model_ranking", INVOICES, SCORED, SUMMARY)("""
SELECT model, rank() OVER (ORDER BY accuracy DESC) AS accuracy_rank, rank() OVER (ORDER BY avg_time) AS speed_rank,
  rank() OVER (ORDER BY failure_rate) AS reliability_rank FROM summary""")
add("classification_accuracy", INVOICES)(f"""
SELECT model, count(*) FILTER (WHERE ok) AS correct, count(*) AS total, {four('count(*) FILTER (WHERE ok)::DOUBLE / count(*)')} AS accuracy
FROM (SELECT CASE WHEN m = 0 THEN 'dense' ELSE 'tiny' END AS model,
        NOT (id % 11 = 0 AND m = 0) AND id % 23 <> 0 AND
        document_type = CASE (id + m) % 3 WHEN 0 THEN 'credit_note' WHEN 1 THEN 'invoice' ELSE 'receipt' END AS ok
      FROM invoices, (VALUES (0), (1)) v(m)) GROUP BY 1""")
LABELS = """label_rows AS (
  SELECT doc_id, label, app_type, ((doc_id * 7 + i * 13 + quality) % 17)::DOUBLE / 100 AS score
  FROM labels, (VALUES (0, 'invoice', 'invoice'), (1, 'budget', 'invoice'), (2, 'form', 'receipt'), (3, 'letter', 'other'),
    (4, 'email', 'other'), (5, 'handwritten', 'other'), (6, 'advertisement', 'other'), (7, 'scientific_report', 'other'),
    (8, 'scientific_publication', 'other'), (9, 'specification', 'other'), (10, 'file_folder', 'other'), (11, 'news_article', 'other'),
    (12, 'presentation', 'other'), (13, 'questionnaire', 'other'), (14, 'resume', 'other'), (15, 'memo', 'credit_note')) v(i, label, app_type))"""
add("top5_labels", LABELS)("""
SELECT * FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS place, label, app_type, round(score, 4) AS score
FROM label_rows) WHERE place <= 5""")
add("label_map", LABELS)("SELECT app_type, count(*) AS rows FROM label_rows GROUP BY 1")

# Word edit distance, one row of the table of distances per recursion step. The step to the right
# within a row is a running minimum, because it only ever adds one.
WER = r"""WITH RECURSIVE pairs AS (
  SELECT a.conv_id * 1000 + a.turn AS pid, a.conv_id, a.turn, a.role AS model,
    list_filter(regexp_split_to_array(lower(a.text), '\s+'), lambda w: w <> '') AS r,
    list_filter(regexp_split_to_array(lower(b.text), '\s+'), lambda w: w <> '') AS h
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
cells AS (
  SELECT pid, 0::BIGINT AS i, j, j AS d FROM (SELECT pid, unnest(range(0, len(h) + 1)) AS j FROM pairs)
  UNION ALL
  SELECT pid, i + 1, j, (min(m - j) OVER (PARTITION BY pid ORDER BY j) + j)::BIGINT FROM (
    SELECT c.pid, c.i, c.j, least(c.d + 1, coalesce(lag(c.d) OVER (PARTITION BY c.pid ORDER BY c.j)
      + CASE WHEN p.h[c.j] = p.r[c.i + 1] THEN 0 ELSE 1 END, 1000000)) AS m
    FROM cells c JOIN pairs p ON c.pid = p.pid WHERE c.i < len(p.r))),
rates AS (
  SELECT p.conv_id, p.turn, p.model, CASE WHEN len(r) = 0 THEN CASE WHEN len(h) = 0 THEN 0::DOUBLE ELSE 1::DOUBLE END
    ELSE least(d::DOUBLE / len(r), 1::DOUBLE) END AS wer
  FROM pairs p JOIN cells c ON p.pid = c.pid AND c.i = len(p.r) AND c.j = len(p.h))
"""
ORACLE["wer"] = WER + f"SELECT conv_id, turn, {four('wer')} AS wer FROM rates"
ORACLE["wer_summary"] = WER + f"""SELECT model, {four('mean')} AS avg_wer, {four('1 - mean')} AS accuracy, total
FROM (SELECT model, sum(wer::DECIMAL(20,6))::DOUBLE / count(*) AS mean, count(*) AS total FROM rates GROUP BY 1)"""

# --- voice and streams ------------------------------------------------------------------------
add("voice_drafts")("""
SELECT conv_id * 1000 + turn AS doc_id, '2002-01-01' AS date, CASE WHEN turn > 0 THEN role ELSE '' END AS transactor,
  CASE WHEN turn > 0 THEN 12.5::DOUBLE ELSE 0::DOUBLE END AS amount, 'PKR' AS currency,
  left(text, 500) AS description, '[Voice Memo]: ' || text AS notes
FROM conversations WHERE trim(text) <> ''""")
add("stream_daily_totals")("""
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day_start, event_type AS kind, count(*) AS entries,
  sum(value::DECIMAL(18,2))::DOUBLE AS total FROM events GROUP BY 1, 2""")
add("stream_without_repeats")("SELECT event_type, count(*) AS rows FROM (SELECT DISTINCT event_id, event_type FROM events) GROUP BY 1")

add("form_functions", INVOICES)(f"""
SELECT id, amount::DOUBLE AS amount, vat::DOUBLE AS vat,
  ((CASE WHEN id % 3 = 2 THEN amount ELSE amount + vat END) * {rate('currency')})::DECIMAL(18,2)::DOUBLE AS total_base,
  (amount + vat)::DOUBLE AS line_total, ((amount + vat) * {rate('currency')})::DECIMAL(18,2)::DOUBLE AS line_base,
  CASE id % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'PKR' END AS named_currency, amount::DOUBLE AS named_amount,
  CASE WHEN notes <> '' THEN notes || chr(10) || chr(10) ELSE '' END || '[Note]: seen' AS noted,
  currency || '|' || transactor AS listed, strftime(date_trunc('month', date), '%Y-%m-%d') AS month, month(date)::INTEGER AS month_number,
  strftime(date, '%d/%m/%Y') AS slashed, CASE WHEN id % 5 = 1 THEN 'Known Payee' ELSE transactor END AS payee,
  transactor || ' ' || notes AS spoken, id::DOUBLE AS spoken_seconds
FROM invoices""")
add("stream_ingest", REPLIES, CHOSEN)(f"""
, typed AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE net END AS a0, CASE WHEN doc_id % 3 = 0 THEN 12.50 ELSE 0 END AS v0,
    CASE WHEN doc_id % 2 = 0 THEN net + 20 ELSE 0 END AS t0 FROM chosen),
rows AS (SELECT transactor, (CASE WHEN t0 > 0 AND a0 = 0 THEN t0 - v0 ELSE a0 END)::DECIMAL(18,2) AS amount FROM typed)
SELECT transactor, count(*) AS rows, sum(amount)::DOUBLE AS amount, count(*) AS numbered, 1 AS unique_ids FROM rows GROUP BY 1
UNION ALL SELECT 'suppliers', n, 0.0, n, 1 FROM (
  SELECT count(*) AS n FROM customer WHERE c_custkey % 2 = 0 OR c_custkey IN (SELECT o_custkey FROM orders))""")
add("statement_report_rows", BANK)("""
, listed AS (
  SELECT file, row_no + 100 AS row_no, date, CASE n % 3 WHEN 0 THEN 'Shop' ELSE description END AS payee,
    CASE n % 3 WHEN 0 THEN description ELSE '' END AS description, CASE n % 3 WHEN 0 THEN '' ELSE reference END AS reference, debit
  FROM (SELECT *, regexp_extract(file, '_(\\d+)', 1)::INTEGER AS n FROM bank) WHERE debit >= 0.01)
SELECT file, row_no, strftime(date, '%Y-%m-%d') AS date, payee, description, reference, debit::DOUBLE AS debit FROM listed
UNION ALL
SELECT CASE WHEN debit <= 17 THEN 'BANK FEES' ELSE 'PAYMENT' END, count(*), NULL, CASE WHEN debit <= 17 THEN 'BANK' ELSE payee END, '', '',
  sum(debit)::DOUBLE FROM listed GROUP BY 1, 4""")
add("rate_upsert", INVOICES)("""
, proposed AS (
  SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 1 THEN 'USD' WHEN 2 THEN 'BGN' WHEN 3 THEN 'GBP' ELSE 'EUR' END AS c,
    CASE WHEN o_orderkey % 7 > 1 THEN (o_orderkey % 50 + 100) + 0.5::DOUBLE END AS v FROM orders),
rates AS (SELECT c, arg_max(v, k) AS v FROM proposed WHERE c <> 'GBP' AND v IS NOT NULL GROUP BY c)
SELECT c AS what, v AS value FROM rates
UNION ALL SELECT 'rejected', count(*)::DOUBLE FROM proposed WHERE c = 'GBP' OR v IS NULL
UNION ALL SELECT 'shown', (3 * length('EUR_TO_PKR'))::DOUBLE
UNION ALL SELECT 'worth ' || currency, sum((amount * coalesce(v, 1)::DECIMAL(12,4))::DECIMAL(18,2))::DOUBLE
FROM invoices LEFT JOIN rates ON c = currency GROUP BY currency""")
add("best_models", INVOICES, SCORED, SUMMARY)("""
, ran AS (
  SELECT *, CASE model WHEN 'alpha' THEN 2 ELSE 3 END AS run_no FROM summary
  UNION ALL SELECT 'idle', 0, 1, 0, 0, (SELECT max(total_files) FROM summary), 0, (SELECT max(total_files) FROM summary), 1)
SELECT (SELECT model FROM ran ORDER BY accuracy DESC, run_no LIMIT 1) AS best_accuracy,
  (SELECT model FROM ran WHERE avg_time > 0 ORDER BY avg_time, run_no LIMIT 1) AS fastest,
  (SELECT model FROM ran ORDER BY failure_rate, run_no LIMIT 1) AS most_reliable""")
ORACLE["stream_matches"] = f"SELECT file, row_no, matched_invoice_number, match_confidence FROM ({BEST_MATCH})"
