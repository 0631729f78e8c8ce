"""Model replies: JSON out of free text, field access and score rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallyloom.fixed_values import DESCRIPTION_KEYS, LABEL_TYPES, REPLY_KEYS, SCORE_DATE_FORMATS
from tallyloom.functions import dates, names
from tallyloom.functions.binding import bind
from tallyloom.functions.money import blank_to_null, parse_plain

RECORDS = "array<map<string,string>>"
FENCE = "```"


def fenced_text(reply: Column) -> Column:
    """What the first two fences enclose, without ``json`` and white space at its ends; null when that is empty.

    Found by the places of the fences: a pattern that tries every character is many times slower.
    """
    def inside(opening: Column) -> Column:
        return bind(F.position(F.lit(FENCE), reply, opening + len(FENCE)), lambda closing: F.when(
            closing > 0, F.substr(reply, opening + len(FENCE), closing - opening - len(FENCE))))
    text = bind(bind(F.instr(reply, FENCE), inside), lambda body: F.when(
        body.startswith("json"), F.substr(body, F.lit(5))).otherwise(body))
    return F.nullif(F.btrim(text, F.lit(" \t\n\x0b\f\r")), F.lit(""))


def reply_json(text: Column) -> Column:
    """JSON text of a reply: the fenced block, else the outermost braces, else the whole text."""
    def found(reply: Column) -> Column:
        opening, closing = F.instr(reply, "{"), F.length(reply) - F.instr(F.reverse(reply), "}") + 1
        braces = F.when((opening > 0) & (closing > opening), F.substr(reply, opening, closing - opening + 1))
        return F.coalesce(F.when(reply.contains(FENCE), fenced_text(reply)), braces, reply)
    clean = F.replace(F.trim(bind(text, found)), F.lit("undefined"), F.lit("null"))
    return F.regexp_replace(clean, r",\s*([}\]])", "$1")


def reply_records(text: Column) -> Column:
    """Records of a reply as an array of maps; an object counts as one record, anything else as none."""
    listed = bind(reply_json(text), lambda body: F.when(body.startswith("["), body).otherwise(
        F.concat(F.lit("["), body, F.lit("]"))))
    parsed = F.from_json(listed, RECORDS, {"mode": "PERMISSIVE"})
    return F.coalesce(F.filter(parsed, lambda r: r.isNotNull()), F.array().cast(RECORDS))


def field(record: Column, *keys: str) -> Column:
    """First non-blank value among the keys of a record."""
    return F.coalesce(*[blank_to_null(record[key]) for key in keys])


def description(record: Column) -> Column:
    """Best description of a record, else a telling category, else empty text."""
    chosen = names.first_filled(*[record[key] for key in DESCRIPTION_KEYS])
    category = names.first_filled(record["Expense Category Account"])
    telling = (F.length(category) > 15) | category.contains(",") | category.contains(" - ")
    return F.coalesce(chosen, F.when(telling, F.concat(F.lit("Service: "), category)), F.lit(""))


def override_payee(transactor: Column, payee: Column) -> Column:
    """A known payee replaces the extracted name unless it is UNKNOWN."""
    return F.coalesce(F.nullif(blank_to_null(payee), F.lit("UNKNOWN")), transactor)


def ground_truth_key(key: Column) -> Column:
    """Reply key to ground-truth field name."""
    known = F.create_map(*[F.lit(x) for pair in REPLY_KEYS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, key), F.lower(F.replace(key, F.lit(" "), F.lit("_"))))


def document_type(label: Column) -> Column:
    """Raw class label to document type, ``other`` for anything unknown."""
    known = F.create_map(*[F.lit(x) for pair in LABEL_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(label)), F.lit("other"))


def numeric_score(expected: Column, extracted: Column) -> Column:
    """Score of a number on absolute values: within 0.1 %, 5 %, 10 %."""
    def read(text: Column) -> Column:
        return F.abs(F.translate(text, ",", ".").try_cast("double"))

    def score(e: Column, x: Column, off: Column) -> Column:
        return (
            F.when(e.isNull() | x.isNull(), F.lit(0.0))
            .when(e == 0, F.when(x == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
            .when(off <= 0.001, F.lit(1.0)).when(off <= 0.05, F.lit(0.8)).when(off <= 0.1, F.lit(0.5))
            .otherwise(F.lit(0.0))
        )
    return bind(F.struct(read(expected).alias("e"), read(extracted).alias("x")), lambda n: bind(
        F.try_divide(F.abs(n["e"] - n["x"]), n["e"]), lambda off: score(n["e"], n["x"], off)))


def date_text_score(expected: Column, extracted: Column) -> Column:
    """Score of a date written in any of the known formats."""
    e = dates.parse_date(dates.leading_date(expected), SCORE_DATE_FORMATS)
    x = dates.parse_date(dates.leading_date(extracted), SCORE_DATE_FORMATS)
    return F.coalesce(bind(F.date_diff(e, x), dates.date_score), F.lit(0.0))


def field_score(name: Column, expected: Column, extracted: Column) -> Column:
    """Score of one field: missing 0, equal 1, otherwise by the kind of field; null expected gives null."""
    e, x = F.lower(F.trim(expected)), F.lower(F.trim(extracted))
    return F.when(expected.isNotNull(), (
        F.when(extracted.isNull(), F.lit(0.0))
        .when(e == x, F.lit(1.0))
        .when(name.isin("amount", "vat", "total_bgn", "total_euro"), numeric_score(expected, extracted))
        .when(name == "date", date_text_score(expected, extracted))
        .when(name.isin("supplier_name", "transactor", "description"), names.token_jaccard(e, x))
        .otherwise(names.contains_either_way(e, x))
    ))


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Word edit distance over reference words, at most 1; whole texts, no length limit.

    Every distinct word of the pair becomes one character, so Spark's own edit distance on the two
    coded texts is the edit distance on words.
    """
    def coded(words: Column, vocabulary: Column) -> Column:
        units = F.transform(words, lambda w: F.lpad(F.hex(F.array_position(vocabulary, w) + 0x20000), 8, "0"))
        return F.decode(F.unhex(F.array_join(units, "")), "UTF-32")

    def rate(pair: Column) -> Column:
        ref, hyp = pair["ref"], pair["hyp"]
        edits = bind(F.array_union(ref, hyp), lambda v: F.levenshtein(coded(ref, v), coded(hyp, v)))
        return F.when(F.size(ref) == 0, F.when(F.size(hyp) == 0, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(
            F.least(F.try_divide(edits.cast("double"), F.size(ref)), F.lit(1.0)))

    return bind(F.struct(names.tokens(F.lower(reference)).alias("ref"),
                         names.tokens(F.lower(hypothesis)).alias("hyp")), rate)


def amount_field(record: Column, *keys: str) -> Column:
    return parse_plain(field(record, *keys))
