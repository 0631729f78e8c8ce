"""Money rules as Column -> Column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallyloom.functions.binding import bind
from tallyloom.fixed_values import BASE_CURRENCY, COMMA_CURRENCIES, DEFAULT_RATES, INGEST_CURRENCIES

MONEY = "decimal(18,2)"
EXACT = "decimal(18,4)"


def blank_to_null(text: Column) -> Column:
    """Null for null, empty and all-blank text."""
    trimmed = F.trim(text)
    return F.when(trimmed != "", trimmed)


def parse_setting(text: Column) -> Column:
    """Settings-form amount: comma is a decimal point, anything unreadable is 0.0."""
    return F.coalesce(F.translate(text, ",", ".").try_cast("double"), F.lit(0.0))


def parse_money(text: Column) -> Column:
    """The shared amount parser: null when unreadable, decimal(18,2) otherwise.

    A last separator followed by one or two digits is the decimal mark, every other separator
    groups digits. A leading or trailing minus and surrounding brackets mean a negative amount.
    """
    def read(value: Column) -> Column:
        # Plain cents, the most common spelling, need one test instead of eight expressions.
        plain = F.when(value.rlike(r"\A[0-9]{1,15}\.[0-9]{2}\z"), value.try_cast(MONEY))
        return F.coalesce(plain, bind(F.regexp_replace(value, r"[^0-9.,\-()]", ""), _signed_amount))
    return bind(text, read)


def _signed_amount(kept: Column) -> Column:
    negative = kept.startswith("-") | kept.endswith("-") | kept.rlike(r"^\(.*\)$")
    value = bind(F.translate(kept, "()-", ""), _plain_amount)
    return F.when(negative, -value).otherwise(value).cast(MONEY)


def _plain_amount(digits: Column) -> Column:
    whole = F.translate(F.regexp_replace(digits, r"[.,]\d{1,2}$", ""), ".,", "")
    plain = F.when(digits.rlike(r"[.,]\d{1,2}$"), F.concat(
        F.lit("0"), whole, F.lit("."), F.regexp_extract(digits, r"(\d{1,2})$", 1)))
    # One separator that cannot group thousands ("0.125", "12.5000", "1234.567") is a decimal mark.
    fraction = F.when(
        digits.rlike(r"^(0?[.,]\d{3,}|\d*[.,]\d{4,}|\d{4,}[.,]\d{3})$"), F.translate(digits, ",", ".")
    )
    return F.coalesce(plain, fraction, whole).try_cast(MONEY)


def parse_plain(text: Column) -> Column:
    """Amount in a machine-written reply: digits and one point, or the shared parser for the rest."""
    return F.coalesce(F.trim(text).try_cast(MONEY), parse_money(text))


def parse_flagged(text: Column) -> Column:
    """Amount as shown in a report cell: currency signs dropped, comma is a point if no point is there."""
    bare = F.trim(F.regexp_replace(text, r"[$€]|лв", ""))
    return F.when(bare.contains(","), F.when(~bare.contains("."), F.translate(bare, ",", "."))
                  .otherwise(bare)).otherwise(bare).try_cast("double")


def format_amount(amount: Column, currency: Column) -> Column:
    """Two decimals; a decimal comma for the currencies that use one."""
    text = F.format_string("%.2f", amount.cast("double"))
    return F.when(currency.isin(COMMA_CURRENCIES), F.translate(text, ".", ",")).otherwise(text)


def format_rate(rate: Column) -> Column:
    return F.format_string("%.4f", rate.cast("double"))


def gross(amount: Column, vat: Column) -> Column:
    """Net plus VAT when the VAT is positive."""
    net = F.coalesce(amount, F.lit(0).cast(MONEY))
    return (net + F.greatest(F.coalesce(vat, F.lit(0).cast(MONEY)), F.lit(0).cast(MONEY))).cast(MONEY)


def default_rate(currency: Column) -> Column:
    """Rate into the base currency from the fixed defaults; null for a currency without one."""
    rate = F.when(currency == BASE_CURRENCY, F.lit(1.0))
    for code, value in DEFAULT_RATES.items():
        rate = rate.when(currency == code, F.lit(value))
    return rate.cast("decimal(12,4)")


def to_base(amount: Column, currency: Column, rate: Column | None = None) -> Column:
    """struct(value, error): the amount in the base currency, or 0 and a message."""
    rate = default_rate(currency) if rate is None else rate
    value = F.when(amount.isNotNull() & rate.isNotNull(), (amount * rate).cast(MONEY))
    error = (
        F.when(amount.isNull(), F.lit("Invalid amount format"))
        .when(rate.isNull(), F.concat(F.lit("Unsupported currency: "), F.coalesce(currency, F.lit(""))))
    )
    return F.struct(F.coalesce(value, F.lit(0).cast(MONEY)).alias("value"), error.alias("error"))


# Earlier name of the same conversion, kept for callers of the old name.
to_eur = to_base


def with_conversions(amount: Column, currency: Column, rate: Column | None = None) -> Column:
    """struct(original, converted): display text of the amount and of its base-currency value."""
    base = to_base(amount, currency, rate)
    original = F.struct(format_amount(amount, currency).alias("amount"), currency.alias("currency"))
    shown = F.struct(
        format_amount(base["value"], F.lit(BASE_CURRENCY)).alias("amount"),
        F.lit(BASE_CURRENCY).alias("currency"),
    )
    converted = F.array_compact(F.array(F.when((currency != BASE_CURRENCY) & base["error"].isNull(), shown)))
    return F.struct(original.alias("original"), converted.alias("converted"))


def line_total(amount: Column, vat: Column, currency: Column) -> Column:
    """struct(original, base): the total of one line in its own and in the base currency."""
    total = gross(amount, vat)
    return F.struct(total.alias("original"), to_base(total, currency)["value"].alias("base"))


def fill_from_total(amount: Column, vat: Column, total: Column) -> Column:
    """struct(amount, vat): a missing amount or VAT inferred from a positive total."""
    zero = F.lit(0).cast(MONEY)

    def filled(given: Column) -> Column:
        a, v, t = given["a"], given["v"], given["t"]
        known = t > 0
        return F.struct(
            F.when(known & (a == 0), t - v).otherwise(a).cast(MONEY).alias("amount"),
            F.when(known & (a > 0) & (v == 0), t - a).otherwise(v).cast(MONEY).alias("vat"),
        )
    return bind(F.struct(*[F.coalesce(c, zero).alias(n) for c, n in ((amount, "a"), (vat, "v"), (total, "t"))]), filled)


def ingest_currency(text: Column) -> Column:
    """Upper-case code when it is on the accepted list, the base currency otherwise."""
    code = F.upper(F.trim(text))
    return F.when(code.isin(INGEST_CURRENCIES), code).otherwise(F.lit(BASE_CURRENCY))


def currency_in_text(text: Column) -> Column:
    """Currency named in free text, first hit in the fixed order; null when none is named."""
    upper = F.upper(text)
    return (
        F.when(text.contains("$") | upper.contains("USD"), "USD")
        .when(text.contains("€") | upper.contains("EUR"), "EUR")
        .when(upper.contains("BGN") | text.contains("лв"), "BGN")
        .when(text.contains("₨") | text.contains("Rs") | upper.contains("PKR"), "PKR")
    )


def first_amount_in_text(text: Column) -> Column:
    """First number of at least 1 in free text."""
    numbers = F.transform(
        F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda n: n.try_cast(MONEY)
    )
    return F.try_element_at(F.filter(numbers, lambda n: n >= 1), F.lit(1))
