import os
import random

import corpus_pipeline
from tallyloom.llm import decontamination, mixing, near_dedup, quality_rules
from tests.llm.helpers import clash, documents


def _folder(spark, tmp_path):
    rnd = random.Random(12)
    words = lambda n: [f"w{rnd.randint(0, 3000)}" for _ in range(n)]
    rows, items = [], [(i, " ".join(words(30))) for i in range(4)]
    for g in range(120):
        base = words(200)
        rows.append(" ".join(base))
        for _ in range(g % 3):
            copy = list(base)
            copy[rnd.randrange(200)] = "edited"
            rows.append(" ".join(copy))
    rows += [" ".join(words(60)) + " " + items[k % 4][1] for k in range(8)] + ["too short", None, ""] + ["a b c " * 60]
    folder = str(tmp_path)
    documents(spark, [(i, t, f"s{i % 5}") for i, t in enumerate(rows)]).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_every_stage_does_what_its_operator_decides(spark, tmp_path):
    folder = _folder(spark, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    stages = [f for _, f in corpus_pipeline.STAGES]
    outputs = []
    for i, stage in enumerate(stages):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/out{i}")
        outputs.append(out := spark.read.parquet(f"{folder}/out{i}"))
        if i < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = out
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    first = spark.read.parquet(f"{folder}/documents.parquet")
    assert ids(outputs[0]) == ids(quality_rules.judge(first).where("kept"))
    assert ids(outputs[1]) == {r.component_id for r in near_dedup.group(outputs[0]).collect()}
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    judged = decontamination.find_contamination(outputs[1], benchmark)
    assert ids(outputs[2]) == ids(judged.where("not contaminated")) and judged.where("contaminated").count() == 8
    assert outputs[3].count() == sum(r.copies for r in mixing.mix(outputs[2]).collect())
    assert outputs[4].count() == outputs[3].count() and {r.shard for r in outputs[4].collect()} == set(range(16))
    whole = corpus_pipeline.run(spark, folder)
    rows = lambda df: sorted((r.doc_id, r.shard, r.slot) for r in df.collect())
    assert rows(whole) == rows(outputs[4])


def test_runs_side_by_side_and_what_they_leave(spark, tmp_path):
    folder = _folder(spark, tmp_path)
    a = corpus_pipeline.run(spark, folder)
    b = corpus_pipeline.run(spark, folder)
    assert b.count() == a.count() > 0
    for run in (a, b):
        inside = os.path.dirname(run._staged_path)
        assert os.listdir(inside) == ["4"]  # the results of earlier stages are gone


def test_awkward_rows_and_clashing_columns_pass_through(spark, tmp_path):
    folder = str(tmp_path)
    words = " ".join(f"wort{i % 997} {i}" for i in range(30_000))
    unlike = " ".join(f"ding{i}" for i in range(400))
    rows = documents(spark, [(1, words, "a"), (1, words, "a"), (2, unlike, None), (None, None, None), (3, "", "b"), (4, unlike + " neu", "b")])
    names = ["size", "kept", "spans", "target", "items", "n_words", "taken"]
    clash(rows, *names).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(None, "some item"), (1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    found = corpus_pipeline.run(spark, folder)
    assert set(found.columns) == {*rows.columns, *names, "shard", "slot"}
    out = found.collect()
    assert {r.doc_id for r in out} <= {1, 2} and len(out) > 0
    assert all(r[n] == "clash" for r in out for n in names if n != "size") and all(r.size == len(r.text) + 1 for r in out)


def test_an_empty_corpus_passes_through(spark, tmp_path):
    folder = str(tmp_path)
    documents(spark, []).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
    assert os.path.isdir(folder)
