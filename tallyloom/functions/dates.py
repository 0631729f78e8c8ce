"""Date rules as Column -> Column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from tallyloom.fixed_values import FILE_NAME_DATE_FORMATS, MATCH_DATE_FORMATS, REPLY_DATE_FORMATS
from tallyloom.functions.binding import bind

DATE_IN_NAME = r"(\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{4}[-/]\d{1,2}[-/]\d{1,2})"


def _shape(pattern: str) -> str:
    """Regular expression of the texts a format can read, so that a parse is tried only where it can succeed."""
    kinds = {"MMMM": "[A-Za-z]+", "MMM": "[A-Za-z]{3}", "yyyy": r"\d{4}", "yy": r"\d{2}", "y": r"\d+",
             "M": r"\d{1,2}", "d": r"\d{1,2}"}
    return "^" + re.sub(r"MMMM|MMM|yyyy|yy|[yMd.]", lambda m: kinds.get(m.group(), r"\."), pattern) + "$"


def parse_date(text: Column, formats: list[str]) -> Column:
    """The first format that reads the text wins; null when none does."""
    return bind(F.trim(text), lambda trimmed: F.coalesce(*[
        F.when(trimmed.rlike(_shape(f)), F.try_to_timestamp(trimmed, F.lit(f)).cast("date")) for f in formats]))


def leading_date(text: Column) -> Column:
    """The date that a text begins with, without a time behind it; any other text as a whole."""
    token = F.regexp_extract(F.trim(text), r"^(\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4})(?=\D|$)", 1)
    return F.coalesce(bind(token, lambda t: F.nullif(t, F.lit(""))), F.trim(text))


def parse_match_date(text: Column) -> Column:
    return parse_date(leading_date(text), MATCH_DATE_FORMATS)


def date_in_text(text: Column) -> Column:
    """First date written inside a file name or a description."""
    return parse_date(F.regexp_extract(text, DATE_IN_NAME, 1), FILE_NAME_DATE_FORMATS)


def reply_date(text: Column, file_name: Column, default: Column, as_of: Column) -> Column:
    """Date of a reply: its own text, else the file name, else the supplier default, else ``as_of``."""
    return F.coalesce(parse_date(text, REPLY_DATE_FORMATS), date_in_text(file_name), default, as_of)


def excel_serial(number: Column) -> Column:
    """Spreadsheet day number to date."""
    return F.date_add(F.lit("1899-12-30").cast("date"), number.cast("int"))


def month_number(name: Column) -> Column:
    """Month name to number; null for anything else."""
    stamp = F.try_to_timestamp(F.concat(F.initcap(F.trim(name)), F.lit(" 2000")), F.lit("MMMM y"))
    return F.month(stamp)


def month_text(text: Column) -> Column:
    """Text month such as ``January 2023`` to its first day."""
    return F.try_to_timestamp(F.trim(text), F.lit("MMMM y")).cast("date")


def slashed(date: Column) -> Column:
    return F.date_format(date, "dd/MM/yyyy")


def month_start(year: int, month: int) -> Column:
    return F.make_date(F.lit(year), F.lit(month), F.lit(1))


def date_points(days: Column, tolerance: int) -> Column:
    """Matching points for a distance in days (null counts as no evidence)."""
    distance = F.abs(days)
    return (
        F.when(distance == 0, F.lit(0.20))
        .when(distance <= 3, F.lit(0.18))
        .when(distance <= 7, F.lit(0.15))
        .when(distance <= 14, F.lit(0.10))
        .when(distance <= tolerance, F.lit(0.05))
        .otherwise(F.lit(0.0))
    )


def date_score(days: Column) -> Column:
    """Scoring of an extracted date for a distance in days."""
    distance = F.abs(days)
    return (
        F.when(distance == 0, F.lit(1.0)).when(distance <= 1, F.lit(0.8))
        .when(distance <= 7, F.lit(0.5)).otherwise(F.lit(0.0))
    )
