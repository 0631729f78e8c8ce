import random

import pytest
import xxhash

from tallyloom.llm import near_dedup
from tallyloom.llm.components import connected
from tests.llm.helpers import awkward, clash, documents, empty


def _fingerprint(text):
    import re
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", ["", "One", "one TWO", "a b c", "a a a a a a a", "Ärger ÄRGER x y z w", " x\ty\nz\x0bq  r "])
def test_fingerprint(text):
    assert near_dedup.fingerprint(text.encode()) == _fingerprint(text)
    assert near_dedup.fingerprint(None) == 0


def test_jvm_hash_agrees(spark):
    from pyspark.sql import functions as F
    row = spark.createDataFrame([("one two three",)], "s string").select(F.xxhash64("s")).first()[0]
    assert row % 2**64 == xxhash.xxh64_intdigest(b"one two three", 42)


def test_links_against_all_pairs(spark):
    rnd = random.Random(5)
    prints = set()
    for _ in range(60):
        base = rnd.getrandbits(64)
        prints.add(base)
        for _ in range(12):
            value = base
            for b in rnd.sample(range(64), rnd.randint(1, 5)):
                value ^= 1 << b
            prints.add(value)
    prints |= {0, 2**64 - 1, 7, 2**63, 2**63 + 1}
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "__print long")
    found = {(r.a, r.b) for r in near_dedup.links(df).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    assert found == want and len(want) > 100


def test_components_of_long_paths_and_hubs(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1200)] + [(-5, 1003), (3, 3)]
    rows = connected(spark.createDataFrame(pairs, "a long, b long")).collect()
    nodes = {x for p in pairs for x in p}
    want = {n: r for n, r in _components(nodes, pairs).items() if n != r}
    assert {r.node: r.root for r in rows} == want
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_against_brute_force(spark):
    rnd = random.Random(3)
    texts = []
    for g in range(25):
        words = [f"w{rnd.randint(0, 400)}" for _ in range(120)]
        for c in range(rnd.choice([1, 1, 3, 8])):
            copy = list(words)
            for _ in range(rnd.randint(0, 2)):
                copy[rnd.randrange(len(copy))] = f"x{rnd.randint(0, 99)}"
            texts.append(" ".join(copy))
    docs = documents(spark, [(i * 3, t, "s") for i, t in enumerate(texts)])
    prints = {i * 3: _fingerprint(t) for i, t in enumerate(texts)}
    pairs = [(a, b) for a in prints for b in prints if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3]
    want = _components(prints, pairs)
    rows = near_dedup.group(docs).collect()
    assert {r.doc_id: r.component_id for r in rows} == want
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id for r in near_dedup.dedupe(docs).collect()} == set(want.values())


def test_awkward_rows(spark):
    docs = clash(awkward(spark), "fingerprint", "component_id")
    rows = near_dedup.group(docs).collect()
    assert len(rows) == docs.count()
    blank = [r for r in rows if not (r.text or "").split()]
    assert {r.fingerprint for r in blank} == {"0" * 16} and {r.component_id for r in blank} == {3}
    kept = near_dedup.dedupe(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and ids.count(3) == 1 and ids.count(None) == 1
    assert near_dedup.group(empty(spark)).count() == 0 and near_dedup.dedupe(empty(spark)).count() == 0
