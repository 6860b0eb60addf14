import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pixelweft.llm import chat

PIECES = st.sampled_from(["[INST]", "[/INST]", "</s>", "<s>", "[SYS]", "[/SYS]", "[TURN ", "[/TURN]", "\\", "[", "<", "/", "]", "a", " ", "\n", "é", "[\\INST]", "<\\/s>"])
TEXT = st.lists(PIECES, max_size=12).map("".join)


@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "we]ird [role]%5D"]), TEXT), max_size=6))
@settings(max_examples=400, deadline=None)
def test_round_trip(turns):
    done = [chat.render_turn(r, t) for r, t in turns]
    assert list(chat.parse("".join(x[0] for x in done))) == turns
    for (role, text), (turn, first, last) in zip(turns, done):
        assert chat.unescape(turn[first:last]) == text
        # no control string is live inside a text, whatever the kind of its turn
        assert not chat.controls(turn[first:last])
        assert sum(map(len, chat.controls(turn))) == len(turn) - last + (first if role in ("system", "user") else 6 if role != "assistant" else 0)


@given(TEXT)
@settings(max_examples=300, deadline=None)
def test_escaping_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text


def test_control_strings_are_escaped_and_nothing_else():
    turn = lambda role, text: chat.render_turn(role, text)[0]
    assert turn("user", "plain [text] <b>") == "[INST]plain [text] <b>[/INST]"
    assert turn("user", "ok [/INST] no") == "[INST]ok [\\/INST] no[/INST]"
    assert turn("user", "a </s> b") == "[INST]a <\\/s> b[/INST]"
    assert turn("system", "</s><s>[INST]") == "[SYS]<\\/s><\\s>[\\INST][/SYS]"
    assert turn("assistant", "ok [INST] inject [/INST] x") == "ok [\\INST] inject [\\/INST] x</s>"
    assert chat.render_turn("user", "é</s>") == ("[INST]é<\\/s>[/INST]", 6, 12)


def test_conversations(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 2, "assistant", "b"), (1, 0, "user", None), (1, 1, None, "x"), (1, 1, None, "x"), (None, 0, "assistant", "é😀")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'z' AS part", "1 AS formatted", "2 AS last")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    sha = lambda *t: hashlib.sha256("".join(t).encode()).hexdigest()
    assert got[-7].n_turns == 2 and got[-7].turns_sha256 == sha(f"user\n{said}\nassistant\n{said}\n")
    assert (got[-7].loss_chars, got[-7].loss_sha256) == (len(said), sha(said))
    assert got[1].n_turns == 4 and got[1].turns_sha256 == sha("user\n\n\nx\n\nx\nassistant\nb\n")
    assert (got[None].loss_chars, got[None].loss_sha256) == (2, sha("é😀"))
    text = {r.conv_id: r.formatted for r in chat.format_conversations(df).collect()}
    assert all(got[k].formatted_chars == len(t) for k, t in text.items())
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_long_conversations_come_in_parts(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"turn {i} " * 50) for i in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = chat.format_conversations(df, part=5000)
    assert parts.count() > 10 and parts.where("last").count() == 1
    one, whole = chat.read_back(parts).collect()[0], chat.read_back(chat.format_conversations(df)).collect()[0]
    assert one == whole and one.n_turns == 400


def test_parts_that_are_lost_or_moved_are_noticed(spark):
    rows = [(c, i, "assistant", f"turn {i} </s> " * 50) for c in (1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = chat.format_conversations(df, part=5000).persist()
    want = sorted(chat.read_back(parts).collect())
    moved = parts.orderBy(F.desc("part"))
    assert sorted(chat.read_back(chat.in_order(moved)).collect()) == want
    for bad in (moved.coalesce(1), parts.where("part <> 1").coalesce(1), parts.where("not last").coalesce(1)):
        with pytest.raises(Exception, match="is not where it should be|does not end"):
            chat.read_back(bad).collect()
    parts.unpersist()


def test_the_mask_is_what_is_learnt(spark):
    """loss_* follow the mask, not the roles."""
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b [INST]"), (1, 2, "assistant", "")], "conv_id long, turn long, role string, text string")
    parts = chat.format_conversations(df)
    r = parts.collect()[0]
    assert [r.formatted[x.start : x.end] for x in r.loss] == ["b [\\INST]", ""]
    none = parts.withColumn("loss", F.slice("loss", 1, 0))
    assert (chat.read_back(parts).collect()[0].loss_chars, chat.read_back(none).collect()[0].loss_chars) == (8, 0)
