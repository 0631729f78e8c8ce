"""Supplier master: lookups, upserts and sheet imports on the normalised name.

``arrival`` is unique per row and fixes what "first" means: a number in the master, anything that sorts in new rows.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.fixed_values import SHEET_COLUMNS, SHEET_HEADER_NAMES, SHEET_TOTAL_WORDS
from tallyloom.functions import names
from tallyloom.functions.money import blank_to_null
from tallyloom.operators.numbering import number_rows
from tallyloom.operators.statements import split_fields


#: Places of incoming rows begin here; arrival numbers stay below.
INCOMING = 1 << 62


def keyed(suppliers: DataFrame) -> DataFrame:
    return suppliers.withColumn("name_key", names.name_key(F.col("supplier_name")))


def one_per_key(suppliers: DataFrame) -> DataFrame:
    """First supplier of every normalised name; all but one row a task and name drop out before the shuffle."""
    place = F.row_number().over(Window.partitionBy("name_key").orderBy("arrival"))
    return keyed(suppliers).where(F.col("name_key") != "").withColumn("place", place).where("place = 1").drop("place")


def by_category(suppliers: DataFrame, category: str) -> DataFrame:
    return suppliers.where((F.col("category") == category) | F.array_contains("categories", category))


def by_transaction_type(suppliers: DataFrame, kind: str) -> DataFrame:
    return suppliers.where(F.col("transaction_type") == kind)


def lookup(suppliers: DataFrame, name: str) -> DataFrame:
    """The supplier of a name in any spelling; no row when there is none."""
    return one_per_key(keyed(suppliers).where(F.col("name_key") == names.name_key(F.lit(name))).drop("name_key"))


def existing(rows: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Rows (with ``supplier_name``) whose supplier is known."""
    return keyed(rows).join(keyed(suppliers).select("name_key"), "name_key", "left_semi")


def unseen(rows: DataFrame, suppliers: DataFrame) -> DataFrame:
    return keyed(rows).join(keyed(suppliers).select("name_key"), "name_key", "left_anti")


def search(suppliers: DataFrame, text: str) -> DataFrame:
    """Free-text search on name and category, upper and lower case alike."""
    wanted = text.lower()
    return suppliers.where(F.lower("supplier_name").contains(wanted) | F.lower("category").contains(wanted))


def amounts_of_nested(suppliers: DataFrame, amount: float, threshold: float = 0.01) -> DataFrame:
    """Amount search in a nested ``invoices`` array: amount, else total, else base total of each entry."""
    entry = suppliers.select("supplier_name", F.explode("invoices").alias("i"))
    value = F.coalesce("i.amount", "i.total_amount", "i.total_base")
    return entry.where(F.abs(value - F.lit(amount)) < threshold).select("supplier_name", "i.*")


def with_arrival(suppliers: DataFrame, incoming: DataFrame) -> DataFrame:
    """``incoming`` with whole arrival numbers after those of ``suppliers``, in the order of its own ``arrival``.

    An arrival may be anything unique that sorts, such as a struct of document and record.
    """
    if dict(incoming.dtypes)["arrival"] in ("int", "bigint"):
        return incoming
    start = suppliers.agg(F.coalesce(F.max("arrival"), F.lit(0)).cast("long")).scalar()
    given = incoming.withColumnRenamed("arrival", "given")
    return number_rows(given, "given", name="arrival", start=start).drop("given")


def upsert(suppliers: DataFrame, incoming: DataFrame) -> DataFrame:
    """Add-or-merge by name: first filled value of every column, categories united in order.

    Known suppliers come before incoming rows, incoming rows in arrival order. Columns of either side are kept. Adds
    ``is_new``, and ``vat_filled`` where an incoming row supplied a VAT number that was missing.
    """
    rows = keyed(suppliers).withColumn("turn", F.lit(0)).unionByName(
        keyed(with_arrival(suppliers, incoming)).withColumn("turn", F.lit(1)), allowMissingColumns=True).where(F.col("name_key") != "")
    # One whole number a row orders known before incoming rows, so that aggregates keep fixed-width places, not texts.
    rows = rows.withColumn("place", F.col("turn") * F.lit(INCOMING) + F.col("arrival").cast("long"))
    fields = [c for c in rows.columns if c not in ("name_key", "turn", "arrival", "place", "category", "categories")]

    def filled(name: str) -> Column:
        return blank_to_null(F.col(name)) if rows.schema[name].dataType.simpleString() == "string" else F.col(name)

    best = rows.groupBy("name_key").agg(
        F.min("place").alias("first"),
        *[F.min(F.when(filled(f).isNotNull(), F.col("place"))).alias(f"at_{i}") for i, f in enumerate(fields)])
    # What stands at the winning places is fetched by name and place, so the rows of a frequent name spread and drop out.
    wanted = best.select("name_key", F.explode(F.array_distinct(F.array("first", *[f"at_{i}" for i in range(len(fields))]))).alias("place"))
    held = rows.join(wanted, ["name_key", "place"], "left_semi").groupBy("name_key").agg(
        F.collect_list(F.struct("place", "category", *fields)).alias("held"))

    def at(place: str, name: str) -> Column:
        return F.get(F.filter("held", lambda h: h["place"] == F.col(place)), F.lit(0))[name]

    is_new = F.col("first") >= F.lit(INCOMING)
    vat_at = F.col(f"at_{fields.index('vat_number')}")
    return (
        best.join(held, "name_key").join(_united_categories(rows), "name_key", "left")
        .select("name_key", *[at(f"at_{i}", f).alias(f) for i, f in enumerate(fields)],
                # The primary category is never replaced; a new supplier takes the one it arrives with.
                at("first", "category").alias("category"),
                (F.col("first") - F.when(is_new, F.lit(INCOMING)).otherwise(F.lit(0))).cast(rows.schema["arrival"].dataType).alias("arrival"),
                is_new.alias("is_new"),
                F.coalesce("categories", F.array().cast("array<string>")).alias("categories"),
                (~is_new & F.coalesce(vat_at >= F.lit(INCOMING), F.lit(False))).alias("vat_filled"))
    )


def _united_categories(rows: DataFrame) -> DataFrame:
    """(name_key, categories): listed ones first, then incoming ones, the original single one after the first of them.

    Each distinct category keeps its earliest place before anything is collected, so the arrays are
    as long as the distinct categories of a supplier, not as its rows.
    """
    turn = F.col("turn")

    def at(category: Column, stage: int, arrival: Column, position: Column) -> Column:
        # Stage, arrival and position as one number of fixed width.
        place = F.lit(Decimal(stage * 10**32)) + arrival.cast("decimal(22,0)") * F.lit(Decimal(10**10)) + position
        return F.struct(category.alias("c"), place.cast("decimal(38,0)").alias("place"))

    listed = F.transform(F.coalesce("categories", F.array().cast("array<string>")),
                         lambda c, i: at(c, 0, F.col("arrival"), i))
    single = at(F.col("category"), 1, F.col("arrival"), F.lit(0))
    original = at(F.col("category"), 1, F.coalesce("first_in", "arrival"), F.lit(1))
    arrivals = rows.where(turn == 1).groupBy("name_key").agg(F.min("arrival").alias("first_in"))
    placed = rows.join(arrivals, "name_key", "left").select("name_key", F.explode(
        F.concat(listed, F.array(F.when(turn == 1, single).otherwise(original)))).alias("e"))
    return (
        placed.select("name_key", "e.c", "e.place").where(blank_to_null(F.col("c")).isNotNull())
        .groupBy("name_key", "c").agg(F.min("place").alias("place"))
        .groupBy("name_key").agg(F.array_sort(F.collect_list(F.struct("place", "c"))).alias("p"))
        .select("name_key", F.col("p.c").alias("categories"))
    )


def replace(suppliers: DataFrame, updated: DataFrame) -> DataFrame:
    """Rows of ``updated`` take the place of the known rows of the same normalised name; others are ignored."""
    kept = unseen(suppliers, updated)
    return kept.unionByName(existing(updated, suppliers), allowMissingColumns=True)


def delete(suppliers: DataFrame, names_to_delete: DataFrame) -> DataFrame:
    return unseen(suppliers, names_to_delete)


def delete_all(suppliers: DataFrame) -> DataFrame:
    return suppliers.limit(0)


def merge_form(suppliers: DataFrame, form: DataFrame) -> DataFrame:
    """Edit form: supplied fields win, other old fields stay, categories are the primary plus the extra ones.

    ``form``: supplier_name, category, transaction_type, vat_number, additional_categories array.
    """
    new = keyed(form).select("name_key", F.col("category").alias("n_category"), F.col("transaction_type").alias("n_type"),
                             F.col("vat_number").alias("n_vat"), "additional_categories", F.lit(True).alias("edited"))
    joined = keyed(suppliers).join(new, "name_key", "left")
    edited = F.coalesce("edited", F.lit(False))
    listed = F.array_distinct(F.filter(F.concat(F.array("n_category"), F.coalesce(
        "additional_categories", F.array().cast("array<string>"))), lambda c: blank_to_null(c).isNotNull()))
    return joined.withColumns({
        "category": F.when(edited, F.col("n_category")).otherwise(F.col("category")),
        "transaction_type": F.when(edited, F.col("n_type")).otherwise(F.col("transaction_type")),
        "vat_number": F.when(edited, F.col("n_vat")).otherwise(F.col("vat_number")),
        "categories": F.when(edited, listed).otherwise(F.col("categories")),
    }).drop("n_category", "n_type", "n_vat", "additional_categories", "edited")


def _sheet_column(name: str) -> Column:
    """Place of a sheet column: the last header holding a keyword, else its fixed position."""
    words, default = SHEET_COLUMNS[name]
    hit = F.filter(F.sequence(F.lit(1), F.size("header")),
                   lambda i: F.lower(F.element_at("header", i)).rlike("|".join(words)))
    return F.coalesce(F.try_element_at(hit, F.lit(-1)), F.lit(default + 1))


def read_sheets(lines: DataFrame) -> DataFrame:
    """Unique suppliers of all sheets, first seen first. ``lines``: sheet, line_no, line (comma-separated)."""
    rows = lines.where(F.trim("line") != "").withColumn("fields", split_fields(F.col("line")))
    headers = rows.groupBy("sheet").agg(F.min("line_no").alias("line_no")).join(rows, ["sheet", "line_no"]).select(
        "sheet", F.col("line_no").alias("header_line"), F.col("fields").alias("header"))
    places = headers.where(F.size("header") >= 4).select(
        "sheet", "header_line", *[_sheet_column(c).alias(f"i_{c}") for c in SHEET_COLUMNS])

    def cell(name: str) -> Column:
        return F.trim(F.try_element_at("fields", F.col(f"i_{name}")))

    name = F.col("supplier_name")
    furthest = F.greatest(*[F.col(f"i_{c}") for c in SHEET_COLUMNS])
    picked = (
        rows.join(places, "sheet")
        .where((F.col("line_no") > F.col("header_line")) & (F.size("fields") >= furthest))
        .select("sheet", "line_no", cell("supplier_name").alias("supplier_name"),
                names.fold_lines(cell("transaction_type")).alias("transaction_type"),
                blank_to_null(names.fold_lines(cell("category"))).alias("category"))
        .where((name != "") & ~F.lower(name).isin(SHEET_HEADER_NAMES) & ~F.lower(name).rlike("|".join(SHEET_TOTAL_WORDS)))
    )
    place = F.row_number().over(Window.partitionBy(F.lower("supplier_name")).orderBy("sheet", "line_no"))
    return picked.withColumn("place", place).where("place = 1").select(
        "supplier_name", "transaction_type", "category", "sheet", "line_no")


def import_sheets(suppliers: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Supplier master after a sheet import, and its statistics (total, new, updated)."""
    found = read_sheets(lines).withColumn("transaction_type", F.coalesce(
        blank_to_null(F.col("transaction_type")), F.lit("Not specified")))
    incoming = found.withColumn("arrival", F.struct("sheet", "line_no"))
    known = keyed(suppliers).select("name_key", F.lit(True).alias("known")).distinct()
    # Two spellings of one key: the first is new, the rest update it.
    per_key = keyed(found).groupBy("name_key").agg(F.count("*").alias("n")).join(known, "name_key", "left")
    statistics = per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_suppliers"),
        F.count_if(F.col("known").isNull()).alias("new_suppliers"),
    ).withColumn("updated_suppliers", F.col("total_suppliers") - F.col("new_suppliers"))
    return upsert(suppliers, incoming.drop("sheet", "line_no")), statistics
