"""Name and text rules as Column -> Column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallyloom.fixed_values import EMPTY_WORDS
from tallyloom.functions.binding import bind
from tallyloom.functions.money import blank_to_null


def name_key(name: Column) -> Column:
    """Supplier key: upper case, separators to single spaces; empty for null."""
    spaced = F.regexp_replace(F.translate(F.upper(name), "_-", "  "), r"\s+", " ")
    return F.coalesce(F.trim(spaced), F.lit(""))


def tokens(text: Column) -> Column:
    """Words of a text, split on white space, no empty word."""
    return F.filter(F.split(text, r"\s+"), lambda word: word != "")


def token_jaccard(left: Column, right: Column) -> Column:
    """Shared words over all words, four decimals; two equal texts give 1, an empty side gives 0."""
    def share(a: Column, b: Column) -> Column:
        ratio = F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))
        return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.floor(ratio * 10000 + 0.5) / 10000)
    words = F.struct(F.array_distinct(tokens(left)).alias("a"), F.array_distinct(tokens(right)).alias("b"))
    return F.when(left == right, F.lit(1.0)).otherwise(bind(words, lambda w: share(w["a"], w["b"])))


def contains_either_way(left: Column, right: Column) -> Column:
    """0.8 when one non-empty text contains the other, else 0."""
    hit = (left != "") & (right != "") & (left.contains(right) | right.contains(left))
    return F.when(hit, F.lit(0.8)).otherwise(F.lit(0.0))


def join_categories(categories: Column, category: Column) -> Column:
    """Category list as text, falling back to the single category and then to empty text."""
    listed = F.array_join(F.filter(categories, lambda c: c.isNotNull() & (c != "")), ", ")
    return F.coalesce(F.nullif(listed, F.lit("")), F.nullif(category, F.lit("")), F.lit(""))


def fold_lines(text: Column) -> Column:
    """Line breaks to spaces, trimmed; the text ``nan`` counts as missing."""
    folded = F.trim(F.translate(text, "\n", " "))
    return F.when(F.lower(folded) != "nan", folded)


def split_list(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda part: F.trim(part))


def append_note(notes: Column, addition: Column, label: Column) -> Column:
    """Existing notes, an empty line when there are any, and the labelled addition."""
    kept = F.coalesce(notes, F.lit(""))
    gap = F.when(kept != "", F.lit("\n\n")).otherwise(F.lit(""))
    return F.concat(kept, gap, F.lit("["), label, F.lit("]: "), addition)


def shorten(text: Column, length: int = 30) -> Column:
    """Listing text: cut to ``length`` characters with dots behind."""
    return F.when(F.length(text) > length, F.concat(F.left(text, F.lit(length)), F.lit("..."))).otherwise(text)


def first_filled(*candidates: Column) -> Column:
    """First candidate that is neither blank nor one of the fixed empty words."""
    return F.coalesce(*[F.when(~F.trim(c).isin(EMPTY_WORDS), blank_to_null(c)) for c in candidates])


def invoice_number_from_name(file_name: Column) -> Column:
    """Keyword and digits, else four or more digits, else the name without its extension."""
    keyword = F.regexp_extract(F.lower(file_name), r"(?:invoice|facture|inv|bill|order)[-\s.:#]?(\d+)", 1)
    digits = F.regexp_extract(file_name, r"(\d{4,})", 1)
    stem = F.regexp_replace(file_name, r"(?<=.)\.[^.]*$", "")
    return F.coalesce(F.nullif(keyword, F.lit("")), F.nullif(digits, F.lit("")), stem)
