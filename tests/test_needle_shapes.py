"""Needles are found by the pattern of their digits and letters; those of rarer patterns by anchors, alike."""

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import containment

TEXTS = ["uploads/scan_inv-000000012.pdf", "uploads/scan_inv-000000012.pdf", "inv-12 inv-1234", "ünï-ÀB-007/😀x😀", "aaaa1111aaaa1111", "", None, "x",
         "no number here", "a.b a+b a\\d 5\n6", "strasse straße 12"]
NEEDLES = [("n", "inv-000000012"), ("n", "inv-12"), ("n", "inv-1234"), ("m", "inv-12"), ("n", "ï-àb"), ("n", "À"), ("n", "😀x"), ("n", "1111aaaa"), ("n", "a"), ("n", ""),
           ("n", None), ("n", "a+b"), ("n", "a\\d"), ("n", "5\n6"), ("n", "straße 12"), ("n", "number here"), ("n", "not there at all"), ("n", "0" * 40)]


@pytest.mark.parametrize("shapes", [0, 1, 3, 16, 100])
def test_every_number_of_patterns_finds_the_same(spark, monkeypatch, shapes):
    monkeypatch.setattr(containment, "SHAPES", shapes)
    texts = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    needles = spark.createDataFrame(NEEDLES, "kind string, needle string")
    got = [tuple(r) for r in containment.find_needles(texts, needles).collect()]
    want = {(t, k, n) for t in TEXTS if t for k, n in NEEDLES if n and n in t}
    assert len(got) == len(set(got)) and set(got) == want


def test_only_places_of_the_pattern_are_looked_up(spark):
    """File names share most of their pieces; only where a number can stand are they cut."""
    keys = spark.range(100).select(F.format_string("inv-%09d", "id").alias("needle"))
    texts = keys.select(F.concat(F.lit("uploads/scan_"), "needle", F.lit(".pdf")).alias("text"))
    cut = containment.pieces(texts, containment.frequent_shapes(keys))
    assert cut.count() == 100 and {r["piece"] for r in cut.collect()} == {r["needle"] for r in keys.collect()}
