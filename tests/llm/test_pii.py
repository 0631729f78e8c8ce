import random
import re

from tallyloom.llm import pii
from tests.llm.helpers import awkward, clash, documents, empty


def _luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0


def _base(text):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_patterns_against_plain_expressions():
    rnd = random.Random(7)
    pieces = ["a", "b.c", "@", ".", "-", "+", "1", "22", "255", "256", " ", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 010-9999",
              "x@y.z", "_", "%", "ä", "\n", "1.2.3.4", "0001.2.3.4", "@@", "..", "()", "5500-0000-0000-0004"]
    for _ in range(20_000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 14)))
        assert pii.base_spans(text) == _base(text), text
    for text in ("1" * 60_000, "a" * 60_000 + "@", "1." * 30_000, "+" * 30_000, "9 " * 30_000):
        assert pii.base_spans(text) == [] or "." in text


def _corpus(spark):
    rnd = random.Random(1)
    rows, i = [], 0

    def add(text):
        nonlocal i
        rows.append((i, text, "s"))
        i += 1

    for k in range(60):
        add(f"words before phone: +1 555 {rnd.randint(100, 999)} {rnd.randint(1000, 9999)} and words after")
        add(f"some order {rnd.randint(10**6, 10**7)} was placed in year {rnd.randint(1900, 2020)} by them")
    add("words before phone: 1 555 777 1234 and words after")  # not a base phone: no plus
    add("some order 1 555 777 9999 was placed")
    return documents(spark, rows)


def test_contexts_find_unseen_identifiers(spark):
    rows = {r.doc_id: r for r in pii.find(_corpus(spark)).collect()}
    for r in rows.values():
        assert [tuple(s) for s in r.base] == _base(r.text) and set(map(tuple, r.base)) <= set(map(tuple, r.spans))
    new = {i: [r.text[s.start:s.end] for s in r.spans if s not in r.base] for i, r in rows.items()}
    assert new.pop(120) == ["1 555 777 1234"] and rows[120].spans[0].kind == 3
    assert not any(new.values())


def test_rounds_reach_tokens_that_share_no_pattern_with_seeds(spark):
    # A seeded pattern names token U; U's second pattern then has enough trusted tokens for token V.
    rows = [(f"seed{k}", 1, "p") for k in range(30)] + [(f"u{k}", -1, "p") for k in range(1)]
    rows += [(f"seed{k}", 1, "q") for k in range(30)] + [("u0", -1, "q"), ("v", -1, "q")]
    df = spark.createDataFrame([(hash64(t), k, hash64(p)) for t, k, p in rows], "token long, kind int, pattern long")
    found = {(r.token, r.kind) for r in pii.bootstrap(df).collect()}
    assert found == {(hash64("u0"), 1), (hash64("v"), 1)}


def test_rounds_go_on_until_nothing_changes(spark):
    rows = [(f"seed{k}", 1, "p0") for k in range(30)] + [("u0", -1, "p0")]
    for link in range(1, 7):  # each pattern counts only when the token of the one before is trusted
        rows += [(f"seed{k}", 1, f"p{link}") for k in range(20)] + [(f"u{link - 1}", -1, f"p{link}"), (f"u{link}", -1, f"p{link}")]
    df = spark.createDataFrame([(hash64(t), k, hash64(p)) for t, k, p in rows], "token long, kind int, pattern long")
    assert {(r.token, r.kind) for r in pii.bootstrap(df).collect()} == {(hash64(f"u{k}"), 1) for k in range(7)}


def _new(spark, texts):
    rows = pii.find(documents(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()
    return sorted((r.doc_id, pii.KINDS[s.kind], r.text[s.start:s.end]) for r in rows for s in r.spans if s not in r.base)


def test_tokens_with_an_at_sign_are_candidates(spark):
    texts = [f"write a mail to person{k}@host{k}.org about it" for k in range(60)]
    texts += ["write a mail to jane@intranet about it", "write a mail to joe@intranet 12 about it", "write a note @ noon about it"]
    assert _new(spark, texts) == [(60, "email", "jane@intranet"), (61, "email", "joe@intranet")]


def test_parts_of_a_run_outside_base_spans_are_candidates(spark):
    texts = [f"contact p{k}@host.org +1 555 {100 + k} {1000 + 7 * k} today" for k in range(60)]
    texts += ["contact jane@host.org 1 555 777 9999 today", "contact jane@host.org;1-555-777-8888 today"]
    assert _new(spark, texts) == [(60, "phone", "1 555 777 9999"), (61, "phone", "1-555-777-8888")]
    text = "tel:+1 555 010 9999, a@b.cc/12345678 x"
    found = [(k, text[a:b]) for a, b, k, *_ in pii.instances(text, pii.base_spans(text), 4)]
    assert found == [(3, "tel:+1 555 010 9999"), (0, "a@b.cc"), (-1, "/12345678")]


def hash64(text):
    import xxhash
    return xxhash.xxh64_intdigest(text) - 2**63


def test_awkward_rows(spark):
    docs = clash(awkward(spark), "spans", "base")
    rows = pii.find(docs).collect()
    assert len(rows) == docs.count()
    assert all([tuple(s) for s in r.base] == _base(r.text or "") for r in rows)
    assert pii.find(empty(spark)).count() == 0
