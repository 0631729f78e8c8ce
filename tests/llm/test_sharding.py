from bisect import bisect_left
from collections import Counter

from pyspark.sql import functions as F

from tallyloom.llm import sharding
from tests.llm.helpers import awkward, clash, documents, empty


def _sizes(rows, shards):
    total = Counter({i: 0 for i in range(shards)})
    for r in rows:
        total[r.shard] += r.size
    return total


def _gapless(rows):
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    return all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_bytes_are_near_equal_and_order_is_global(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.xxhash64("id") % 300 + 300).cast("int")).alias("text"))
    rows = sharding.shard(docs, shards=7).collect()
    assert len(rows) == 6000 and _gapless(rows)
    assert all(r.size == len(r.text) + 1 for r in rows)
    sizes, mean = _sizes(rows, 7), sum(r.size for r in rows) / 7
    assert max(abs(v - mean) for v in sizes.values()) <= 601 + 0.001 * mean


def test_a_hot_text_is_cut_between_shards(spark):
    docs = documents(spark, [(i, "hot text of all" if i % 3 else f"text {i}", "s") for i in range(900)])
    rows = sharding.shard(docs, shards=8).collect()
    sizes, mean = _sizes(rows, 8), sum(r.size for r in rows) / 8
    assert max(abs(v - mean) for v in sizes.values()) <= 17 + 0.001 * mean
    hot = sorted({r.shard for r in rows if r.text == "hot text of all"})
    assert len(hot) > 3 and hot == list(range(hot[0], hot[-1] + 1))  # equal texts lie side by side


def test_wholly_equal_rows_are_cut_too(spark):
    rows = sharding.shard(documents(spark, [(1, "same", "s")] * 800), shards=4).collect()
    assert sorted(_sizes(rows, 4).values()) == [1000] * 4 and _gapless(rows)


def test_splitters_against_brute_force(spark):
    table = spark.range(500).select((F.pmod("id", F.lit(7))).alias("__k1"), (F.col("id") * 11).alias("__k2"),
                                    F.col("id").alias("__k3"), (F.col("id") % 13 + 1).alias("w"))
    rows = sorted((r["__k1"], r["__k2"], r["__k3"], r.w) for r in table.collect())
    total = sum(r[3] for r in rows)
    targets = [(total * i // 10, 0) for i in range(1, 10)]
    found = sharding.find_splitters(table, sharding.KEYS, "w", targets, probes=16)
    for (goal, _), splitter in zip(targets, found):
        below = sum(r[3] for r in rows if r[:3] < splitter)
        cuts = [0]
        for r in rows:
            cuts.append(cuts[-1] + r[3])
        assert abs(below - goal) == min(abs(c - goal) for c in cuts)


def test_thousands_of_splitters_over_repeated_and_long_rows(spark):
    table = spark.range(6000).select(
        F.pmod(F.xxhash64(F.col("id") % 1500), F.lit(2**40)).alias("__k1"), F.lit(5).cast("long").alias("__k2"),
        F.col("id").alias("__k3"), F.when(F.col("id") % 500 == 0, 90_000).otherwise(F.col("id") % 700 + 1).cast("long").alias("w"))
    rows = sorted((r["__k1"], r["__k2"], r["__k3"], r.w) for r in table.collect())
    sums = [0]
    for r in rows:
        sums.append(sums[-1] + r[3])
    targets = [(sums[-1] * i // 5001, 0) for i in range(1, 5001)]
    found = sharding.find_splitters(table, sharding.KEYS, "w", targets)
    assert found == sorted(found)
    keys = [r[:3] for r in rows]
    for (goal, _), splitter in zip(targets, found):
        below = sums[bisect_left(keys, splitter)]
        at = bisect_left(sums, goal)
        assert abs(below - goal) <= min(sums[at] - goal, goal - sums[at - 1])


def test_many_shuffle_partitions_and_repeated_texts(spark):
    docs = documents(spark, [(i, f"text {i // 4} " * (i % 50), "s") for i in range(2000)])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "4000")
    try:
        rows = sharding.shard(docs, shards=16).select("size", "shard", "slot").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    sizes, mean = _sizes(rows, 16), sum(r.size for r in rows) / 16
    assert _gapless(rows) and max(abs(v - mean) for v in sizes.values()) <= max(r.size for r in rows) + 0.001 * mean


def test_pieces_inside_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SMALL_PIECE", 1000)
    docs = documents(spark, [(i % 700, f"text {i % 300}", "s") for i in range(3000)])
    rows = sharding.shard(docs, shards=3).collect()
    sizes, mean = _sizes(rows, 3), sum(r.size for r in rows) / 3
    assert len(rows) == 3000 and _gapless(rows) and max(abs(v - mean) for v in sizes.values()) <= 9 + 0.001 * mean


def test_awkward_rows(spark):
    docs = clash(awkward(spark), "shard", "slot", "size")
    rows = sharding.shard(docs, shards=3).collect()
    assert len(rows) == docs.count() and _gapless(rows)
    assert sorted(r.size for r in rows if r.text is None) == [1, 1]
    assert rows[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "size", "shard", "slot"}
    none = sharding.shard(empty(spark), shards=3)
    assert none.count() == 0 and {"shard", "slot", "size"} <= set(none.columns)
    single = sharding.shard(documents(spark, [(1, "a", "s")]), shards=16).collect()
    assert len(single) == 1 and single[0].slot == 0


def test_files_of_a_shard(spark, tmp_path):
    out = str(tmp_path / "out")
    sharding.write_shards(sharding.shard(documents(spark, [(i, f"t{i}", "s") for i in range(40)]), shards=4), out)
    assert spark.read.parquet(out).groupBy("shard").count().count() == 4
