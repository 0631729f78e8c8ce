import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import fill_in_middle
from tallyloom.llm.boundary_set import (SPAN, ArrayContainer, BitmapContainer, BoundarySet, RunContainer)
from tests.llm import helpers


@pytest.mark.parametrize("share, form", [(0.001, ArrayContainer), (0.3, BitmapContainer), (1.0, RunContainer)])
def test_selection_in_each_container(share, form):
    mask = np.random.default_rng(1).random(3 * SPAN + 777) < share
    mask[SPAN:2 * SPAN] = False  # a container without positions
    places, at = BoundarySet(mask), np.flatnonzero(mask)
    assert isinstance(places.containers[0], form) and len(places) == len(at)
    for rank in [0, 1, len(at) // 3, len(at) // 2, len(at) - 2, len(at) - 1, *np.random.default_rng(2).integers(0, len(at), 300)]:
        assert places.select(int(rank)) == at[rank]
    for rank in (-1, len(at)):
        with pytest.raises(IndexError):
            places.select(rank)


def _plain(doc_id, text):
    """The same by regular expression and slices."""
    text = text or ""
    words = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(words)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(words[:a]), "".join(words[a:b]), "".join(words[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_against_regular_expressions(spark):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("ab Z\n\x00é😀<>PSM漢\r.") for _ in range(rnd.randint(0, 80))) for _ in range(800)]
    texts += ["Ort 5 " * 40_000, "x" * 200_000, "." * 150_000, "a <P> b", "<P", "<", "S>", "<M>"]
    docs = helpers.documents(spark, [(i, t, "a") for i, t in enumerate(texts)]).union(helpers.awkward(spark))
    made = fill_in_middle.transform(helpers.clash(docs, "n", "form", "prefix_chars", "h"))
    rows = made.withColumn("restored", fill_in_middle.restore(F.col("fim_text"), F.col("form"))).collect()
    assert len(rows) == docs.count() and {r.form for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.fim_text) == _plain(r.doc_id, r.text)
        assert r.restored == (r.text or "") and r.h == "clash"


def test_empty_table_and_rates(spark):
    assert fill_in_middle.transform(helpers.empty(spark)).count() == 0
    docs = helpers.documents(spark, [(i, "some words here", "a") for i in range(200)])
    assert {r.form for r in fill_in_middle.transform(docs, rate=0).collect()} == {"plain"}
    assert {r.form for r in fill_in_middle.transform(docs, rate=100, spm_rate=100, carry=["doc_id"]).collect()} == {"spm"}
    other = fill_in_middle.transform(docs, seed=2).select("doc_id", F.col("fim_text").alias("b"))
    assert fill_in_middle.transform(docs).join(other, "doc_id").where("fim_text <> b").count() > 100
