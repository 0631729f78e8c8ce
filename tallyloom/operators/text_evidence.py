"""What the texts of bank lines say about invoices: names, words of names and numbers.

Texts, names, words and numbers are moved as two numbers each. A set of names is named by the exclusive or of its names' numbers, so
word sets that lead to the same names are one evidence group, and a text asks it once, with the most points it has for it. A
number that few invoices carry leads to these invoices directly; only numbers of many invoices form groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.operators.containment import held_pieces, two_numbers
from tallyloom.operators.joins import meet
from tallyloom.operators.match_index import BANDED, DATED, SMALL
from tallyloom.session import durable

#: Invoices of a small group; invoices that a text is compared with one by one because it holds their number.
SMALL_SIZE, RARE = 20_000, 8
NAME_POINTS, WORD_POINTS, NUMBER_POINTS = 0.15, 0.08, 0.10
NAME, WORD, NUMBER, TEXT, GROUP_NAME = ["n1", "n2"], ["w1", "w2"], ["m1", "m2"], ["t1", "t2"], ["g1", "g2"]


def long_words(name: Column) -> Column:
    return F.filter(F.split(name, r"\s+"), lambda w: F.length(w) > 3)


def _word_ids(words: Column) -> Column:
    return F.transform(words, lambda w: F.struct(F.xxhash64(w).alias("w1"), F.xxhash64(F.lit(1), w).alias("w2")))


def _has_number() -> Column:
    return F.length("number") > 2


def _numbered(*group: str) -> list[Column]:
    """The group of the invoices of ``group`` that carry a number; of any invoice if none is given."""
    return [F.xxhash64(F.lit(2 + i), *NUMBER, *group).alias(g) for i, g in enumerate(GROUP_NAME)]


def names_of(inv: DataFrame) -> DataFrame:
    """(name, n1, n2, ws, mode): the distinct names and their long words; ``mode`` is the one of the group of each."""
    counted = inv.where(F.col("name") != "").groupBy("name").agg(F.count("*").alias("n"))
    return durable(counted.select("name", *two_numbers(F.col("name"), "n"), long_words(F.col("name")).alias("ws"), "n", F.when(
        F.col("n") <= SMALL_SIZE, SMALL).otherwise(DATED).alias("mode")))


def texts_of(txns: DataFrame, inv: DataFrame, names: DataFrame) -> DataFrame:
    """(t1, t2, vocabulary, named, rare, frequent): words and names that each text holds, and, of its numbers, the invoices or the number."""
    words = names.select(F.explode(F.array_distinct("ws")).alias("needle")).distinct()
    numbered = inv.where(_has_number())
    needles = names.select(F.col("name").alias("needle")).unionByName(words).unionByName(numbered.select(F.col("number").alias("needle")))
    held = held_pieces(txns.select("text"), needles)
    place = F.row_number().over(Window.partitionBy("p1", "p2").orderBy("id"))
    few = numbered.select(*two_numbers(F.col("number"), "p"), "is_income", "c", "day", "id", "name").withColumn("place", place).where(
        F.col("place") <= RARE + 1)
    invoice = F.struct("is_income", "c", "day", "id", "name")
    listed = few.groupBy("p1", "p2").agg(F.collect_list(invoice).alias("listed"))
    no_mode = F.lit(None).cast("int").alias("mode")
    marks = names.select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), "mode").unionByName(
        words.select(*two_numbers(F.col("needle"), "p"), no_mode))
    found = meet(held, marks, ["p1", "p2"]).withColumn("listed", F.lit(None).cast(listed.schema["listed"].dataType)).unionByName(
        meet(held, listed, ["p1", "p2"]).withColumn("mode", no_mode))
    number, is_rare = F.col("listed").isNotNull(), F.size("listed") <= RARE
    return durable(found.groupBy(*TEXT).agg(
        F.collect_set(F.when(~number & F.col("mode").isNull(), F.struct(F.col("p1").alias("w1"), F.col("p2").alias("w2")))).alias("vocabulary"),
        F.collect_set(F.when(F.col("mode").isNotNull(), F.struct(F.col("p1").alias("n1"), F.col("p2").alias("n2"), "mode"))).alias("named"),
        F.flatten(F.collect_list(F.when(number & is_rare, F.col("listed")))).alias("rare"),
        F.collect_set(F.when(number & ~is_rare, F.struct(F.col("p1").alias("m1"), F.col("p2").alias("m2")))).alias("frequent")))


def _used_words(names: DataFrame, texts: DataFrame) -> DataFrame:
    """(n1, n2, n, mode, ws, used): the long words of each name, and those found in any text, rarest first."""
    seen = texts.select(F.inline("vocabulary")).distinct()
    listed = names.where(F.size("ws") > 0).withColumn("ws", _word_ids(F.col("ws"))).select(*NAME, "n", "mode", "ws")
    used = meet(listed.select(*NAME, F.inline(F.array_distinct("ws"))), seen, WORD, "left_semi")
    # A set is looked up through its rarest word, which leads to the fewest sets.
    popularity = used.groupBy(*WORD).agg(F.count("*").alias("popularity"))
    ranked = meet(used, popularity, WORD).groupBy(*NAME).agg(F.array_sort(F.collect_list(F.struct("popularity", *WORD))).alias("ranked"))
    pairs = F.transform("ranked", lambda r: F.struct(r["w1"].alias("w1"), r["w2"].alias("w2")))
    return meet(listed, ranked, NAME).withColumn("used", pairs).drop("ranked")


def _sets(word_sets: DataFrame) -> DataFrame:
    """(n1, n2, n, s1, s2, w1, w2, words, points): all word sets of the names with at most six used words; w1, w2 is the rarest word.

    A partial name match depends only on which of the name's words are in the text, so all names sharing a word set form one group: a
    word such as "services" costs one group, not one pair per name. Names with more used words would have too many sets; each of
    those stays a group of its own, with its points counted per text.
    """
    mask_bits = F.sequence(F.lit(1), F.expr("cast(power(2, size(used)) as int) - 1"))
    exploded = word_sets.where(F.size("used") <= 6).withColumn("mask", F.explode(mask_bits))
    words = F.expr("filter(used, (w, i) -> getbit(cast(mask as bigint), i) = 1)")
    hits, total = F.size(F.filter("ws", lambda w: F.array_contains(F.col("words"), w))), F.size("ws")
    first = F.element_at("words", 1)
    return exploded.withColumn("words", words).select(*NAME, "n", hits.alias("hits"), total.alias("total"), "words").select(
        *NAME, "n", *[F.xxhash64(F.lit(i), F.array_sort("words"), "hits", "total").alias(s) for i, s in enumerate(("s1", "s2"))],
        first["w1"].alias("w1"), first["w2"].alias("w2"), "words", (F.lit(WORD_POINTS) * (F.col("hits") / F.col("total"))).alias("points"))


def evidence(texts: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each text points to, and which names belong to which group.

    Returns (t1, t2, g1, g2, mode, name_points, number_points, invoice), with a group or an invoice, and (n1, n2, g1, g2, mode).
    """
    word_sets = durable(_used_words(names, texts))
    sets = _sets(word_sets)
    # Sets with the same names are one group. What only words lead to is won by amounts alone: 0.08 and all date points are no match.
    mode = F.when(F.sum("n") <= SMALL_SIZE, SMALL).when(F.count("*") == 1, DATED).otherwise(BANDED)
    groups = sets.groupBy("s1", "s2").agg(
        F.bit_xor("n1").alias("g1"), F.bit_xor("n2").alias("g2"), F.count("*").alias("members"), mode.alias("mode"),
        *[F.first(c).alias(c) for c in ("w1", "w2", "words", "points")])
    groups = durable(groups)
    in_text = texts.where(F.size("vocabulary") > 0).select(*TEXT, "vocabulary", F.inline("vocabulary"))
    partial = meet(in_text, groups.select(*WORD, "words", *GROUP_NAME, "mode", "points"), WORD).where(
        F.size(F.array_except("words", "vocabulary")) == 0).select(*TEXT, *GROUP_NAME, "mode", F.col("points").alias("name_points"))
    as_group = [F.col("n1").alias("g1"), F.col("n2").alias("g2"), "mode"]
    single = texts.select(*TEXT, F.inline("named")).select(*TEXT, *as_group, F.lit(NAME_POINTS).alias("name_points"))
    own = single
    long_names = word_sets.where(F.size("used") > 6)
    if long_names.limit(1).count():
        counted = meet(in_text.drop("vocabulary"), long_names.select(*NAME, "mode", F.size("ws").alias("total"), F.inline("ws")), WORD).groupBy(
            *TEXT, *NAME, "mode").agg((F.lit(WORD_POINTS) * (F.count("*") / F.first("total"))).alias("name_points"))
        own = own.unionByName(counted.select(*TEXT, *as_group, "name_points"))
    # A whole name outscores any share of its words, so the largest value is the rule's.
    by_name = partial.unionByName(own).groupBy(*TEXT, *GROUP_NAME, "mode").agg(F.max("name_points").alias("name_points"))
    none, ten = F.lit(0.0).alias("number_points"), F.lit(NUMBER_POINTS).alias("number_points")
    found = by_name.select("*", none)
    by_number = texts.select(*TEXT, F.inline("frequent"))
    if by_number.limit(1).count():
        found = found.unionByName(by_number.select(*TEXT, *_numbered(), F.lit(DATED).alias("mode"), F.lit(0.0).alias("name_points"), ten)).unionByName(
            meet(by_name, by_number, TEXT).select(*TEXT, *_numbered(*GROUP_NAME), F.lit(DATED).alias("mode"), "name_points", ten))
    # The name of an invoice that is found by its number is scored against the text's words and names.
    ids, own_name = _word_ids(long_words(F.col("invoice.name"))), F.struct(*two_numbers(F.col("invoice.name"), "n"))
    shared = F.size(F.filter(ids, lambda w: F.array_contains("vocabulary", w)))
    is_named = (F.col("invoice.name") != "") & F.exists("named", lambda n: (n["n1"] == own_name["n1"]) & (n["n2"] == own_name["n2"]))
    points = F.when(is_named, F.lit(NAME_POINTS)).when(shared > 0, F.lit(WORD_POINTS) * (shared / F.size(ids))).otherwise(F.lit(0.0))
    direct = texts.where(F.size("rare") > 0).select(*TEXT, "vocabulary", "named", F.explode("rare").alias("invoice")).select(
        *TEXT, points.alias("name_points"), ten, F.col("invoice").dropFields("name").alias("invoice"))
    members = names.select(*NAME, *as_group).unionByName(
        meet(sets.select(*NAME, "s1", "s2"), groups.where("members > 1").select("s1", "s2", *GROUP_NAME, "mode"), ["s1", "s2"])
        .select(*NAME, *GROUP_NAME, "mode").distinct())
    return found.unionByName(direct, allowMissingColumns=True), members


def group_points(inv: DataFrame, members: DataFrame, wanted: DataFrame, numbered: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The invoices of the groups ``wanted`` as (is_income, g1, g2, mode, day, c, p): of small and of large groups.

    ``wanted``: (g1, g2), each once. ``numbered``: (m1, m2), the numbers of many invoices that texts hold, if there are any.
    """
    invoice = [F.col("is_income"), F.col("day"), F.col("c"), F.col("id").alias("p")]
    keyed = inv.where(F.col("name") != "").select(*invoice, *two_numbers(F.col("name"), "n"))
    asked = meet(members, wanted, GROUP_NAME, "left_semi")
    columns = ["is_income", *GROUP_NAME, "mode", "day", "c", "p"]

    def of(mode: Column) -> DataFrame:
        return meet(keyed, asked.where(mode), NAME).select(*columns)
    small, large = of(F.col("mode") == SMALL), of(F.col("mode") != SMALL)
    if numbered is not None:
        of_number = meet(inv.where(_has_number()).select(*invoice, *two_numbers(F.col("number"), "m"), *two_numbers(F.col("name"), "n")), numbered, NUMBER)
        dated = F.lit(DATED).alias("mode")
        both = of_number.select("is_income", *_numbered(), dated, "day", "c", "p").unionByName(
            meet(of_number, members.drop("mode"), NAME).select("is_income", *_numbered(*GROUP_NAME), dated, "day", "c", "p"))
        large = large.unionByName(meet(both, wanted, GROUP_NAME, "left_semi").select(*columns))
    return small, large
