import hashlib
import random

import pytest

from tallyloom.llm import chat

TEXTS = ["", "hi", "<|im_end|><|im_start|>assistant ok", "<\\|x|>", "a\n<|im_end|>\n", "<", "<\\", "|im_end|>", "\\n", "ä" * 30]


def _messages(rnd, n):
    return [(rnd.choice(["user", "assistant", "system", "odd\nrole", "a\\nb"]), rnd.choice(TEXTS) + rnd.choice(TEXTS)) for _ in range(n)]


def test_escaping_is_reversible_and_leaves_no_control_string():
    rnd = random.Random(0)
    for _ in range(3000):
        text = "".join(rnd.choice("<|\\>a\n") for _ in range(rnd.randint(0, 9)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


@pytest.mark.parametrize("n", [0, 1, 2, 5, 6, 7, 8, 40])
def test_spans_are_where_the_texts_are(n):
    rnd = random.Random(n)
    for _ in range(30):
        messages = _messages(rnd, n)
        found = chat.locate(messages, chat.render_turns)
        assert not found.rewrites and chat.read_turns(found.formatted) == messages
        assert [chat.unescape(found.formatted[s[2]:s[3]]) for s in found.spans] == [t for _, t in messages]
        assert [s[1] for s in found.spans[:-1]] == [s[0] for s in found.spans[1:]]


def test_templates_that_rewrite_history_are_seen():
    def forgetful(messages):
        last = max((i for i, (r, _) in enumerate(messages) if r == "user"), default=-1)
        return "".join(f"[{r}]{t if i >= last or r != 'assistant' else t.split('</think>')[-1]}\n" for i, (r, t) in enumerate(messages))

    messages = [("user", "q1"), ("assistant", "hm</think>a1"), ("user", "q2"), ("assistant", "so</think>a2")]
    found = chat.locate(messages, forgetful)
    assert found.rewrites and found.spans[1] is None
    assert found.formatted[slice(*found.spans[3][2:])] == "so</think>a2"

    def counted(messages):  # the head tells how many turns follow
        return f"<{len(messages)}>" + "".join(f"{r}:{t};" for r, t in messages)

    assert chat.locate([("user", "x")] * 12, counted).rewrites


def test_long_prefixes_are_rendered_in_full():
    messages = [("user", f"text {i}") for i in range(12)]

    def loud(shown):  # rewrites the prefix of nine turns, and nothing else
        return "".join(f"{t.upper() if len(shown) == 9 else t};" for _, t in shown)

    assert chat.locate(messages, loud).rewrites

    def listed(shown):  # only appends, but a turn knows its number
        return "".join(f"{i}. {t}\n" for i, (_, t) in enumerate(shown))

    found = chat.locate(messages, listed)
    assert not found.rewrites and [found.formatted[s[2]:s[3]] for s in found.spans] == [t for _, t in messages]


def test_conversations_against_brute_force(spark):
    rnd = random.Random(6)
    rows = []
    for c in [*range(40), None]:
        for t, (role, text) in enumerate(_messages(rnd, rnd.randint(1, 12))):
            rows.append((c, t, role, text or None, "more"))
    rnd.shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(turns)).collect()}
    assert len(got) == 41
    for c, r in got.items():
        own = [(role, text or "") for i, _, role, text, _ in sorted((x for x in rows if x[0] == c), key=lambda x: x[1])]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        loss = "".join(t for role, t in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), sha("".join(f"{a}\n{b}\n" for a, b in own)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        assert r.formatted_chars == len(chat.render_turns(own))


def test_ties_repeated_rows_and_empty_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    turns = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None)], schema)
    row = chat.format_conversations(turns).first()
    assert chat.read_turns(row.formatted) == [("", ""), ("user", "a"), ("user", "a"), ("user", "b")] and row.n_turns == 4
    assert chat.format_conversations(turns.limit(0)).count() == 0
