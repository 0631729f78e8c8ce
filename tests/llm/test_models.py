import random

import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm import quality_model, toxicity
from tallyloom.llm.registry import QUERIES
from tests.llm.helpers import clash, documents, empty

DATA = "/root/testdata/sf0.01"


def _held_out(spark, name, label):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    rows = QUERIES[name](spark, DATA)
    assert rows.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    rows = rows.where("held_out").join(labels, "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    y, s = np.array([r.y for r in rows]), np.array([r.score for r in rows])
    return ((s >= 0.5) == y).mean(), (s[y == 1][:, None] > s[y == 0]).mean()


def test_quality_on_held_out_rows(spark):
    accuracy, auc = _held_out(spark, "op3_compression_quality", "quality")
    assert accuracy > 0.95 and auc > 0.9  # some ten bad rows to tell apart


def test_toxicity_on_held_out_rows(spark):
    accuracy, auc = _held_out(spark, "op4_counterfactual_toxicity", "toxic")
    assert accuracy > 0.93 and auc > 0.9  # 329 rows to learn from


def _labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, label int, score string")


def _fit(model, rows, **options):
    return model.fit(rows.drop("label"), rows.select("doc_id", "label"), **options)


def test_swaps_lower_the_score_of_neutral_mentions(spark):
    rows, i = [], 0
    for k in range(300):
        rows.append((i, f"the {'muslim' if k % 2 else 'tall'} people are scum w{k % 50}", 1, "x"))
        rows.append((i + 1, f"the nice people w{k % 50} live {'there' if k % 9 else 'christian'}", 0, "x"))
        i += 2
    neutral = _labelled(spark, [(1, "a muslim family lives w3", None, ""), (2, "a family lives w3", None, ""), (3, "they are scum", None, ""), (4, None, None, "")])
    plain = _fit(toxicity.CounterfactualClassifier, _labelled(spark, rows), swap_penalty=0.0)
    held = _fit(toxicity.CounterfactualClassifier, _labelled(spark, rows), swap_penalty=5.0)
    a, b = ({r.doc_id: r.score for r in m.score(neutral).collect()} for m in (plain, held))
    assert a[1] - a[2] > 0.03 > 10 * abs(b[1] - b[2]) and b[3] > 0.9 and b[3] > b[1] + 0.3
    assert abs(held.weights.get(b"muslim", 0) - held.weights.get(b"christian", 0)) < 0.3


def test_features_are_counted_over_all_labelled_rows(spark):
    keys = [r.k for r in spark.range(600).select(F.col("id").alias("k")).orderBy(F.xxhash64(F.col("id").cast("string"))).collect()]
    toxic, drawn = keys[::2], set(keys[::2][:10]) | set(keys[1::2][:10])
    held = set(toxic[10:]) | {toxic[0]}  # one drawn row and all that are not drawn
    rows = _labelled(spark, [(k, f"{'scum' if k in drawn and k in toxic else ''} {'vile' if k in held else ''} text", int(k in toxic), "x") for k in keys])
    fitted = _fit(toxicity.CounterfactualClassifier, rows, sample_docs=20, features=1)
    assert fitted.weights.get(b"vile", 0) > 0 and b"scum" not in fitted.weights


def test_one_class_no_class_and_awkward_rows(spark):
    texts = [(1, "a", 1, "x"), (2, None, 1, "x"), (2, "", None, "x"), (None, "b c", 1, "x")]
    none = _labelled(spark, []).limit(0)
    for model in (quality_model.CompressionClassifier, toxicity.CounterfactualClassifier):
        for rows in (_labelled(spark, texts), none):
            scores = [r.score for r in _fit(model, rows).score(_labelled(spark, texts)).collect()]
            assert len(scores) == 4 and len(set(scores)) == 1 and 0 <= scores[0] <= 1
        both = [(k, "good words here " * 9 if k % 2 else "#### !!!! %%%% " * 9, k % 2, "x") for k in range(40)]
        fitted = _fit(model, _labelled(spark, both + texts))
        out = fitted.score(clash(_labelled(spark, texts), "held_out")).collect()
        assert len(out) == 4 and all(0 <= r.score <= 1 for r in out)
        assert fitted.score(empty(spark)).count() == 0


def test_compression_tells_junk_of_the_kind_it_learned(spark):
    rnd = random.Random(3)
    good = lambda: " ".join(rnd.choice(["river", "house", "evening", "quiet", "walked", "under", "stone"]) for _ in range(80))
    bad = lambda: " ".join(rnd.choice(["BUY!!", "$$$", "%%%", "CLICK!!", "###", "NOW!!"]) for _ in range(80))
    labelled = _labelled(spark, [(k, good() if k % 2 else bad(), k % 2, "x") for k in range(80)])
    docs = documents(spark, [(k, good() if k % 2 else bad(), "s") for k in range(100, 160)] + [(200, " ".join(bad() for _ in range(300)), "s"), (201, " ".join(good() for _ in range(300)), "s")])
    scores = {r.doc_id: r.score for r in _fit(quality_model.CompressionClassifier, labelled).score(docs).collect()}
    assert all((scores[k] > 0.5) == (k % 2 == 1) for k in scores)


def test_dictionaries_learn_from_the_whole_of_a_text(spark):
    rnd = random.Random(4)
    words = lambda n, of: " ".join(rnd.choice(of) for _ in range(n))
    prose, junk = ["river", "house", "evening", "quiet", "walked", "under", "stone"], ["BUY!!", "$$$", "CLICK!!", "###", "NOW!!"]
    rows = _labelled(spark, [(k, words(500, prose) + " " + words(900, prose if k % 2 else junk), k % 2, "x") for k in range(60)])
    fitted = _fit(quality_model.CompressionClassifier, rows)
    assert b"CLICK!!" in fitted.bad and b"river" in fitted.good and b"CLICK!!" not in fitted.good
    whole = spark.createDataFrame([("a" * 100,), ("".join(map(chr, range(33, 120))) * 20,)], "t string").select(F.col("t").cast("binary").alias("t"))
    for r in whole.select("t", quality_model.pieces(F.col("t"), F.lit(1)).alias("p")).collect():
        text, found = bytes(r.t), [bytes(x) for x in r.p]
        own = [text[i:i + 512] for i in range(0, len(text), 512)]
        assert found == own or (len(found) == 4 and [x for x in own if x in found] == found)
