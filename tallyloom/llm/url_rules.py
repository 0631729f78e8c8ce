"""URL rules as a sort-merge range join: reversed-host keys turn rules into key intervals that one sorted sweep opens and closes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.llm import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands between host and path in a key; neither can hold it.
MARK = "#"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit(MARK), path)


def _stacked(rules: DataFrame) -> DataFrame:
    """Each rule's key with ``stack``: the rules whose intervals hold its own, outermost first, and itself last.

    Every proper prefix of a key is looked up among the keys; a stack is no longer than the key that carries it.
    """
    prefixes = rules.select("key", F.explode(F.sequence(F.lit(1), F.length("key"))).alias("n")).select(
        "key", F.expr("substring(key, 1, n)").alias("outer"))
    outer = rules.select(F.col("key").alias("outer"), F.struct(F.length("key").alias("n"), "key", "rule", "verdict").alias("entry"))
    return prefixes.join(outer, "outer").groupBy("key").agg(F.sort_array(F.collect_list("entry")).alias("stack"))


def sweep(points: DataFrame, rules: DataFrame) -> DataFrame:
    """``points`` (column ``key``) with ``stack``: the rules whose key is a prefix of the point's key, outermost first.

    A rule's interval runs from its key to the last key that begins with it, so intervals nest. In key order a rule's
    start opens its interval: the active stack becomes the rules around it and itself. A point keeps of the last opened
    stack what is still open at its own key. Points and starts are dealt to ranges of keys and swept range by range; a range
    begins with the stack that the ranges before it leave, so the points of one key may lie in several ranges: a hash of their other
    columns (but maps) spreads them. One row a range meets in one task.
    """
    starts = _stacked(rules).select("key", F.lit(0).alias("kind"), "stack", *[
        F.lit(None).cast(f.dataType).alias(f.name) for f in points.schema.fields if f.name != "key"])
    others = [c for c in points.columns if c != "key"]
    events = starts.select("key", "kind", "stack", *others).union(
        points.select("key", F.lit(1), F.lit(None).cast(starts.schema["stack"].dataType), *others))
    hashed = [f.name for f in points.schema.fields if f.name != "key" and "map<" not in f.dataType.simpleString()]
    spread = F.xxhash64(*hashed) if hashed else F.lit(0)
    dealt = common.staged(events.repartitionByRange("key", "kind", spread).withColumn("part", F.spark_partition_id()), "sweep")
    in_order = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = dealt.where("kind = 0").groupBy("part").agg(F.max(F.struct("key", "stack")).alias("last"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = dealt.select("part").distinct().join(opened, "part", "left").select(
        "part", F.last("last", ignorenulls=True).over(before).getField("stack").alias("carried"))
    active = F.coalesce(F.last("stack", ignorenulls=True).over(in_order), F.col("carried"))
    swept = dealt.join(carried, "part").withColumn("active", active).where("kind = 1")
    still = F.filter(F.col("active"), lambda r: F.startswith(F.col("key"), r["key"]))
    return swept.withColumn("stack", still).select("key", *others, "stack")


def judge(pages: DataFrame, rules: DataFrame, *, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains if the path of the url starts with the rule's; the
    longest (host and path together) wins, at equal length the lesser in code point order, and of one rule with two
    verdicts ``block``. ``rule`` is host and path of the winner, null without one; then ``verdict`` is ``otherwise``.

    Each distinct url is swept once for each of its host's parent domains: a host of n labels has n keys. So a hot url is
    one row, and a hot host spreads over key ranges by its paths.

    Urls that are null or have no ``://`` have empty host and path and fit no rule. Rules with a null host or path are left
    out. Repeated pages are all returned; empty tables give no rows, or every page without a rule. Input columns named like an output
    column are replaced.
    """
    known = common.without(pages, *[c for c in ("host", "path", "rule", "verdict") if c != url])
    text = F.col(f"`{url}`")
    keyed = rules.where("host is not null and path is not null").groupBy("host", "path").agg(
        F.max("verdict").alias("verdict")).select(
        _key(_labels(F.translate("host", UPPER, LOWER)), F.col("path")).alias("key"),
        F.concat("host", "path").alias("rule"), "verdict")
    urls = known.select(text.alias("__url")).where(text.contains("://")).distinct()
    labels = urls.select("__url", path_of(F.col("__url")).alias("__path"), _labels(host_of(F.col("__url"))).alias("__labels"))
    points = labels.select(
        "__url", F.explode(F.transform(F.sequence(F.lit(1), F.size("__labels")), lambda n: _key(
            F.slice("__labels", 1, n), F.col("__path")))).alias("key"))
    found = sweep(points, keyed).select("__url", F.explode("stack").alias("r"))
    order = F.struct((-F.length("r.rule")).alias("n"), F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict"))
    best = found.groupBy("__url").agg(F.min(order).alias("__best"))
    return known.join(best, text == F.col("__url"), "left").withColumns({
        "host": host_of(text), "path": path_of(text), "rule": F.col("__best.rule"),
        "verdict": F.coalesce("__best.verdict", F.lit(otherwise)),
    }).drop("__url", "__best")
