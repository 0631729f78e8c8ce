import random
import re

from pyspark.sql import functions as F

from tallyloom.llm import decontamination as dc
from tests.llm.helpers import awkward, clash, documents, empty


def _words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def _expected(text, items, window=13):
    words, hit, owners = _words(text), set(), set()
    for name, item in items:
        own = _words(item)
        if not own:
            continue
        n = min(window, len(own))
        for w in {tuple(own[i:i + n]) for i in range(len(own) - n + 1)}:
            for i in range(len(words) - n + 1):
                if tuple(words[i:i + n]) == w:
                    hit.update(range(i, i + n))
                    owners.add(name)
    return len(words), hit, owners


def _random_case(rnd, letters, n_items, n_docs):
    text = lambda n: " ".join(rnd.choice(letters) for _ in range(n))
    items = [(str(i), text(rnd.choice([0, 1, 2, 3, 5, 12, 13, 14, 20, 40]))) for i in range(n_items)]
    docs = []
    for _ in range(n_docs):
        parts = [text(rnd.randint(0, 20))]
        for _ in range(rnd.randint(0, 3)):
            item = rnd.choice(items)[1].split()
            if item:
                a = rnd.randrange(len(item))
                parts += [" ".join(item[a:a + rnd.randint(1, 30)]), text(rnd.randint(0, 4))]
        docs.append(rnd.choice([" ", ", ", "\n"]).join(parts))
    return items, docs


def test_automaton_against_brute_force():
    rnd = random.Random(4)
    for letters, rounds in (("ab", 60), ("abcdef", 60), ([f"w{i}" for i in range(40)], 60)):
        for _ in range(rounds):
            items, docs = _random_case(rnd, letters, rnd.randint(1, 6), 6)
            if rnd.random() < 0.5:
                items = [x for x in items if len(x[1].split()) >= 13]
            automaton = dc.Automaton(13).build([(n, dc.words_of(t.encode())) for n, t in items])
            for doc in docs:
                spans, owners = automaton.hits(dc.words_of(doc.encode()))
                _, hit, names = _expected(doc, items)
                assert {w for a, b in spans for w in range(a, b)} == hit
                assert {automaton.names[i] for i in owners} == names


def _case(spark):
    rnd = random.Random(9)
    letters = [f"w{i}" for i in range(300)]
    items, docs = _random_case(rnd, letters, 12, 60)
    docs += [" ".join(rnd.choice(letters) for _ in range(600)) + " " + items[-1][1] for _ in range(3)]
    benchmark = spark.createDataFrame(items + [(None, "alone here"), ("x", None)], "item_id string, text string")
    return items, docs, documents(spark, list(zip(range(len(docs)), docs, "s" * len(docs)))), benchmark


def test_blocks_of_items_give_the_same_as_one(spark):
    items, texts, docs, benchmark = _case(spark)
    for block in (10**6, 30):
        rows = {r.doc_id: r for r in dc.find_contamination(docs, benchmark, block_words=block).collect()}
        for i, text in enumerate(texts):
            n, hit, names = _expected(text, items)
            assert (rows[i].n_words, rows[i].n_hit, rows[i]["items"]) == (n, len(hit), sorted(names))
            assert {w for s in rows[i].spans for w in range(s.first, s.after)} == hit
            assert rows[i].contaminated == (len(hit) > 0 and 20 * len(hit) >= n)


def test_spans_below_the_coverage_limit_are_cut_out(spark):
    passage = " ".join(f"p{i}" for i in range(15))
    text = "Start. " + " ".join(f"w{i}" for i in range(400)) + f". ({passage.upper()})! " + "End, of it."
    docs = documents(spark, [(1, text, "s"), (2, f"only {passage}", "s"), (3, "clean text", "s")])
    benchmark = spark.createDataFrame([(1, passage)], "item_id long, text string")
    out = {r.doc_id: r for r in dc.decontaminate(docs, benchmark).collect()}
    assert out.keys() == {1, 3} and out[3].text == "clean text"
    assert out[1].text == text.replace(passage.upper(), "") and out[1].n_chars == len(out[1].text)


def test_awkward_rows(spark):
    docs = clash(awkward(spark), "items", "spans", "n_words")
    benchmark = spark.createDataFrame([(None, "Alone here"), ("q", None), ("r", ""), ("s", "x")], "item_id string, text string")
    rows = dc.find_contamination(docs, benchmark).collect()
    assert len(rows) == docs.count()
    assert [r["items"] for r in rows if r.text == "alone here"] == [["null"]]
    assert all(r.n_words == 0 and not r.contaminated for r in rows if not (r.text or "").strip())
    kept = dc.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns and kept.where(F.col("doc_id") == 1).count() == 2
    nothing = spark.createDataFrame([], "item_id string, text string")
    assert dc.find_contamination(docs, nothing).where("n_hit > 0 or contaminated").count() == 0
    assert dc.find_contamination(empty(spark), benchmark).count() == 0


def test_an_item_above_the_block_size_is_split(spark):
    words = [f"w{i}" for i in range(150)]
    items = spark.createDataFrame([("long", " ".join(words)), ("short", "one two")], "item_id string, text string")
    assert max(max(a.length) for a in dc.automata(items, block_words=50)) == 50
    docs = documents(spark, [(i, " ".join(words[i:i + 13]), "s") for i in range(138)] + [(200, " ".join(words), "s"), (201, "one two", "s")])
    rows = {r.doc_id: r for r in dc.find_contamination(docs, items, block_words=50).collect()}
    assert all(rows[i].n_hit == 13 and rows[i].items == ["long"] for i in range(138))
    assert rows[200].n_hit == 150 and rows[200].n_items == 1 and rows[201].items == ["short"]


def test_scans_hold_a_bounded_number_of_automata(spark):
    items, texts, docs, benchmark = _case(spark)
    for scattered in (benchmark.repartition(7), benchmark.coalesce(1)):
        sizes = [len(a.length) for a in dc.automata(scattered, block_words=30)]
        assert len(sizes) > 4 and max(sizes) <= 2 * 2 * 30 + 1
        rows = {r.doc_id: r for r in dc.find_contamination(docs, scattered, block_words=30, blocks_a_scan=3).collect()}
        for i, text in enumerate(texts):
            n, hit, names = _expected(text, items)
            assert (rows[i].n_words, rows[i].n_hit, rows[i]["items"]) == (n, len(hit), sorted(names))
            assert {w for s in rows[i].spans for w in range(s.first, s.after)} == hit
