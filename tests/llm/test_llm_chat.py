"""Operator 12: the grammar alone, and whole tables against a plain description."""

import hashlib
from collections import defaultdict

import pytest
from helpers import LONG
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelake.llm import chat_format

PIECES = st.lists(st.sampled_from(["\\", "#", "##", "###", "</turn>", "</turn", ">", ":", "\n", "### a:\n", "user", " ", "ü", "\r", "x"]), max_size=9).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=4))
def test_every_conversation_comes_back(turns):
    formatted, found = chat_format.render(turns)
    assert [f[:2] for f in found] == turns
    assert [f[:2] for f in chat_format.parse(formatted)] == turns
    assert all(chat_format.unescape_text(formatted[s:e]) == t for _, t, s, e in found)


def test_plain_turns_stay_as_they_are():
    assert chat_format.render([("user", "a # b"), ("assistant", "c \\ d")])[0] == "### user:\na # b\n</turn>\n### assistant:\nc \\ d\n</turn>\n"


@pytest.mark.parametrize("bad", ["x", "### a\n", "### a:\nb", "### a:\nb\n</turn>", "### a:\n### b:\n</turn>\n", "### a:\n</turn>\n", "### a:b:\nc\n</turn>\n"])
def test_other_texts_are_no_conversations(bad):
    with pytest.raises(chat_format.Ungrammatical):
        list(chat_format.parse(bad))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def described(data):
    convs = defaultdict(list)
    said = "\\### Assistant: </turn> ok"
    for c, turn, role, text in [*data, (-7, 0, "user", said), (-7, 1, "assistant", said)]:
        convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for c, turns in convs.items():
        turns = [(r, t) for *_, r, t in sorted(turns)]
        masked = "".join(t for r, t in turns if r == "assistant")
        out.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(masked), sha(masked), len(chat_format.render(turns)[0])))
    return sorted(out, key=str)


def test_digests_of_a_table(spark):
    data = [(c, t, ("user", "assistant")[t % 2], f"text {c} ### {t} </turn>") for c in range(50) for t in range(c % 6 + 1)]
    data += [(100, None, None, None), (100, 1, "assistant", ""), (100, 1, "assistant", "tie"), (100, 1, "assistant", "tie"), (101, 0, "assistant", LONG)]
    data += [(102, t, "assistant", f"### {t} " + "long " * 50) for t in range(1500)] + [(None, 0, "assistant", "nobody"), (103, 0, "a:\\\n### b", "\\\\</turn>")]
    df = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as part", "'x' as formatted", "2 as n_turns")
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert sorted((tuple(r[c] for c in columns) for r in chat_format.digests(df).collect()), key=str) == described(data)
    got = chat_format.digests(df.limit(0)).collect()
    assert [r["conv_id"] for r in got] == [-7]
