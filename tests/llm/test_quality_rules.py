import random
import re

from tallyloom.llm import quality_rules
from tests.llm.helpers import awkward, clash, documents, empty


def _measures(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(hit))


def test_measures_against_brute_force():
    rnd = random.Random(1)
    texts = [None, "", "a", "a b c a b c", " \t", "x y z q", "é é é é é\n\né é é\né é é", "a|b <c> #1\r\na|b <c> #1\r\n"]
    for _ in range(200):
        texts.append("".join(rnd.choice(["a ", "b ", "ab\n", "c#", " \n", "é ", "\t", "a b c\n"]) for _ in range(rnd.randint(0, 80))))
    for t in texts:
        assert quality_rules.measure(None if t is None else t.encode())[:5] == _measures(t), t


def _corpus(spark):
    rnd = random.Random(2)
    words = lambda n: " ".join(f"w{rnd.randint(0, 5000)}" for _ in range(n))
    rows = [(i, f"{words(60)}\nSubscribe  to our letter\n{words(30)}", "host") for i in range(60)]
    copied = f"{words(70)}\n{words(50)}"
    rows += [(100 + i, copied, "host") for i in range(80)]
    rows += [(300 + i, "\n".join(["subscribe to OUR letter"] * 20 + [words(8)]), "host") for i in range(3)]
    rows += [(400 + i, f"{words(60)}\nSubscribe to our letter", "other") for i in range(5)]
    rows += [(500, "too short", "host"), (501, "a b c d " * 40, "host")]
    return documents(spark, rows)


def test_frequent_lines_go_and_depleted_documents_are_rejected(spark):
    rows = {r.doc_id: r for r in quality_rules.judge(_corpus(spark)).collect()}
    assert all(rows[i].kept and rows[i].n_removed_words == 4 for i in range(60))
    assert all(rows[i].kept and rows[i].n_removed_words == 0 for i in range(100, 180))  # copies are one document
    assert all(not rows[i].kept for i in range(300, 303))
    assert all(rows[i].kept and rows[i].n_removed_words == 0 for i in range(400, 405))  # rare on that host
    assert rows[500].base_failed and rows[501].base_failed and not rows[500].kept
    cleaned = {r.doc_id: r for r in quality_rules.clean(_corpus(spark)).collect()}
    assert cleaned.keys() == {i for i, r in rows.items() if r.kept}
    assert "letter" not in cleaned[0].text and cleaned[0].text.count("\n") == 1
    assert cleaned[0].n_chars == len(cleaned[0].text) and "letter" in cleaned[400].text


def test_the_limit_does_not_depend_on_the_host(spark):
    rnd = random.Random(4)
    words = lambda n: " ".join(f"w{rnd.randint(0, 5000)}" for _ in range(n))
    said = words(60)
    rows = [(i, f"{words(55)}\n{said}", "small") for i in range(25)] + [(100 + i, f"{words(55)}\n{said}", "large") for i in range(25)]
    rows += [(1000 + i, words(55), "large") for i in range(4000)]
    found = {r.doc_id: r.n_removed_words for r in quality_rules.judge(documents(spark, rows)).where("doc_id < 1000").collect()}
    assert set(found.values()) == {60} and len(found) == 50


def test_awkward_rows(spark):
    docs = clash(awkward(spark), "kept", "n_words", "base_failed", "n_removed_words", "spans", "words")
    rows = quality_rules.judge(docs).collect()
    assert len(rows) == docs.count() and [r.kept for r in rows if r.doc_id == 5] == [True]
    assert all(r.base_failed and not r.kept for r in rows if r.doc_id != 5)
    cleaned = quality_rules.clean(docs)
    assert cleaned.columns == docs.columns and [(r.doc_id, set(r[5:])) for r in cleaned.collect()] == [(5, {"clash"})]
    assert quality_rules.judge(empty(spark)).count() == 0 and quality_rules.clean(empty(spark)).count() == 0
