"""They decide results, so they are stated here in one place and nowhere else."""

# Base currency and the default rates into it.
BASE_CURRENCY = "PKR"
DEFAULT_RATES = {"EUR": 280.50, "USD": 278.50, "BGN": 143.40}

# Currencies accepted on ingest; GBP has no rate and converts to an error.
INGEST_CURRENCIES = ["BGN", "EUR", "USD", "GBP", "PKR"]

# Currencies written with a decimal comma.
COMMA_CURRENCIES = ["EUR", "BGN"]

# Header patterns per standard statement column, in the order they are tried.
# The credit pattern for incoming money is bounded so that "closing" does not count as "in".
HEADER_PATTERNS = {
    "date": ["date", "trans.*date", "value.*date", "booking.*date", "posting.*date",
             "ημερομηνία", "datum", "fecha", "valeur"],
    "description": ["description", "details", "narrative", "particulars", "memo", "remark",
                    "περιγραφή", "text", r"reference\s+number", "ref.*num"],
    "reference": ["^ref(?:erence)?$", "trans.*(?:id|ref)", "check.*(?:no|num)", "αριθμός",
                  r"doc\s*no", r"transaction\s*number"],
    "debit": ["debit", "withdrawal", "charge", "χρέωση", "out", "payment", "expense"],
    "credit": ["credit", "deposit", "πίστωση", r"\bin(?:come|coming|flow)?\b", "receipt"],
    "amount": ["^amount$", "sum", "value", "ποσό"],
    "amount_sign": [r"amount\s*sign", "sign", "dc", "d/c", "dr/cr", "type"],
    "balance": ["balance", "υπόλοιπο", "running.*balance", "closing.*balance"],
}
STANDARD_COLUMNS = ["date", "description", "reference", "debit", "credit", "balance"]

# File-name keyword -> statement format name; the first keyword found wins.
BANK_NAMES = [
    ("chase", "Chase Bank"),
    ("hsbc", "HSBC"),
    ("barclays", "Barclays"),
    ("wells_fargo", "Wells Fargo"),
    ("bank_of_america", "Bank of America"),
    ("revolut", "Revolut"),
    ("wise", "Wise (TransferWise)"),
    ("paypal", "PayPal"),
    ("stripe", "Stripe"),
]

# Raw document label -> document type; anything else is "other".
LABEL_TYPES = {
    "invoice": "invoice", "budget": "invoice", "form": "receipt", "letter": "other",
    "email": "other", "handwritten": "other", "advertisement": "other",
    "scientific_report": "other", "scientific_publication": "other", "specification": "other",
    "file_folder": "other", "news_article": "other", "presentation": "other",
    "questionnaire": "other", "resume": "other", "memo": "credit_note",
}
DOCUMENT_TYPES = ["invoice", "receipt", "bank_statement", "credit_note", "other"]

# Reply key -> ground-truth field; other keys become lower snake case.
REPLY_KEYS = {
    "Transactor": "transactor", "Invoice Number": "invoice_number", "Amount": "amount",
    "Tax Amount": "vat", "VAT Amount": "vat", "VAT": "vat_number", "Date": "date",
    "Invoice Date": "date", "Currency": "currency", "Description": "description",
    "Expense Category Account": "category", "Kind of Transaction": "transaction_type",
    "Total Amount": "total_amount",
}

# Date formats, first fit wins (Spark datetime letters; single letters also read padded parts).
MATCH_DATE_FORMATS = ["y-M-d", "d-MMM-yy", "d/M/y", "d-M-y", "M/d/y", "d.M.y"]
SCORE_DATE_FORMATS = ["y-M-d", "d/M/y", "M/d/y", "d-M-y", "d.M.y"]
REPLY_DATE_FORMATS = ["d-M-yyyy", "yyyy-M-d", "d/M/yyyy", "yyyy/M/d", "d-M-yy", "M/d/yyyy",
                      "MMM d, yyyy", "MMMM d, yyyy"]
FILE_NAME_DATE_FORMATS = ["d-M-yyyy", "yyyy-M-d", "d/M/yyyy", "yyyy/M/d", "d-M-yy", "yy-M-d",
                          "d/M/yy", "yy/M/d"]

# Description keys of a reply in order of preference, and the texts that count as no description.
DESCRIPTION_KEYS = ["Description", "Service Description", "Item Description",
                    "Product Description", "Line Items"]
EMPTY_WORDS = ["0", "null", "None", "undefined"]

# Names that mark a header or total row in a supplier sheet.
SHEET_HEADER_NAMES = ["transactor", "supplier", "supplier name", "vendor", "nan"]
SHEET_TOTAL_WORDS = ["total", "date", "sum", "balance", "subtotal"]
SHEET_COLUMNS = {
    "transaction_type": (["kind of", "transaction", "type"], 1),
    "supplier_name": (["transactor", "supplier", "company", "vendor", "biller"], 2),
    "category": (["category", "expense", "account", "service"], 3),
}

# Report sheets.
EXPENSE_COLUMNS = ["date", "invoice_number", "transactor", "description", "expense_category",
                   "kind_of_transaction", "amount", "vat", "total_bgn", "total_eur", "currency",
                   "payment_method"]
INCOME_COLUMNS = ["date", "invoice_number", "transactor", "description", "kind_of_transaction",
                  "amount", "vat", "total_bgn", "total_eur", "currency", "payment_method"]
FEE_LIMIT = 17
SUSPICIOUS_BELOW = 0.01

# Accepted uploads.
UPLOAD_EXTENSIONS = ["pdf", "xlsx", "xls", "jpg", "jpeg", "png", "bmp", "tiff", "tif", "gif",
                     "mp3", "wav", "m4a", "ogg", "flac", "webm"]
AUDIO_EXTENSIONS = ["mp3", "wav", "m4a", "ogg", "flac", "webm", "wma"]
MIME_TYPES = {"pdf": "application/pdf", "jpg": "image/jpeg", "jpeg": "image/jpeg",
              "png": "image/png", "bmp": "image/bmp", "tiff": "image/tiff", "tif": "image/tif",
              "gif": "image/gif"}

# Extraction stages a processing mode may use, in order of preference.
STAGE_ORDER = ["cloud", "text", "local"]
MODE_STAGES = {"auto": ["cloud", "text", "local"], "cloud": ["cloud", "text"], "local": ["local"]}
