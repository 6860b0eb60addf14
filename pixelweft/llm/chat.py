"""Chat formatting with a grammar round trip.

A conversation is rendered as

    <s>  { [SYS]text[/SYS] | [INST]text[/INST] | [TURN role]text[/TURN] | text</s> }

for system, user, any other role, and assistant. The grammar is deterministic: at
the start of a turn the next characters name its kind, and the first closing
string ends it. Content of a text that conflicts with the grammar, that is each
control string, gets one backslash after its first character, as do those that have
backslashes there already, so that unescaping takes exactly one away again. Every
turn is parsed again and compared with its source before it is written.

Conversations are streamed turn by turn in sorted partitions and written in parts,
so neither side holds a whole conversation. With each part goes its loss mask: the
places of the assistant texts in it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN = {"system": "[SYS]", "user": "[INST]"}
CLOSE = {"system": "[/SYS]", "user": "[/INST]", "assistant": "</s>"}
BEGIN = "<s>"
#: Characters of a part of the output, about; a part ends at a turn's end.
PART = 1 << 20

_PLAIN = re.compile(r"(\[)(\\*)(/?INST\]|/?SYS\]|/TURN\]|TURN )|(<)(\\*)(/?s>)")
_ESCAPED = re.compile(r"(\[)(\\+)(/?INST\]|/?SYS\]|/TURN\]|TURN )|(<)(\\+)(/?s>)")


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: (m[1] or m[4]) + "\\" + (m[2] if m[1] else m[5]) + (m[3] or m[6]), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: (m[1] or m[4]) + (m[2] if m[1] else m[5])[1:] + (m[3] or m[6]), text)


def _role_name(role: str) -> str:
    """A role as it stands in [TURN role]: brackets, percent signs and line ends are percent-encoded."""
    return re.sub(r"[%\[\]<>\r\n]", lambda m: f"%{ord(m[0]):02X}", role)


def _role_back(name: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), name)


def _wrap(role: str, text: str) -> str:
    if role == "assistant":
        return text + CLOSE[role]
    if role in OPEN:
        return OPEN[role] + text + CLOSE[role]
    return f"[TURN {_role_name(role)}]{text}[/TURN]"


def controls(text: str) -> list[str]:
    """The control strings in a text that are not escaped."""
    return [m[0] for m in _PLAIN.finditer(text) if not (m[2] or m[5])]


def read_turn(rendered: str, at: int) -> tuple[str, int, int, int]:
    """(role, first and last character of the text, first character after the turn) of the turn that starts at at."""
    role = next((r for r, mark in OPEN.items() if rendered.startswith(mark, at)), None)
    if role:
        first, close = at + len(OPEN[role]), CLOSE[role]
    elif rendered.startswith("[TURN ", at):
        first, close = rendered.index("]", at) + 1, "[/TURN]"
        role = _role_back(rendered[at + 6 : first - 1])
    else:
        role, first, close = "assistant", at, CLOSE["assistant"]
    last = rendered.find(close, first)
    if last < 0:
        raise ValueError("a turn does not end")
    return role, first, last, last + len(close)


def parse(rendered: str, at: int = 0) -> Iterator[tuple[str, str]]:
    """The turns (role, text) of a rendered conversation without its opening mark."""
    while at < len(rendered):
        role, first, last, at = read_turn(rendered, at)
        yield role, unescape(rendered[first:last])


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn, and where its text begins and ends in it; each control string in the text is escaped."""
    out = _wrap(role, escape(text))
    found, first, last, end = read_turn(out, 0)
    if (found, unescape(out[first:last]), end) != (role, text, len(out)) or controls(out[first:last]):
        raise AssertionError("an escaped turn always comes back")
    return out, first, last


PARTS = "conv_id long, part int, formatted string, last boolean, loss array<struct<start:int,end:int>>"


def format_conversations(rows: DataFrame, part: int = PART) -> DataFrame:
    """rows (conv_id, turn, role, text) -> conv_id, part, formatted, last, loss.

    The turns of a conversation stand by turn (nulls first), then role and text.
    Null roles and texts count as empty; a null conv_id is a conversation of its
    own; repeated rows are repeated turns. Parts in order make the whole text;
    last marks the final one; loss has the places (code points, end exclusive) of
    the assistant texts in the part, escapes included. Other columns are ignored;
    no rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

        def table(done: list[tuple]) -> pa.RecordBatch:
            types = (pa.int64(), pa.int32(), pa.string(), pa.bool_(), span)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=["conv_id", "part", "formatted", "last", "loss"])

        now, began, no, held, size, loss, done = None, False, 0, [], 0, [], []
        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if not began or conv != now:
                    if began:
                        done.append((now, no, "".join(held), True, loss))
                    now, began, no, held, size, loss = conv, True, 0, [BEGIN], len(BEGIN), []
                elif size >= part:
                    done.append((now, no, "".join(held), False, loss))
                    no, held, size, loss = no + 1, [], 0, []
                turn, first, last = render_turn(role, text)
                if role == "assistant":
                    loss.append({"start": size + first, "end": size + last})
                held.append(turn)
                size += len(turn)
            if done:
                yield table(done)
                done = []
        if began:
            yield table([(now, no, "".join(held), True, loss)])

    clean = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("turn").cast("long").alias("turn"))
    dealt = clean.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, PARTS)


def in_order(parts: DataFrame) -> DataFrame:
    """Parts that were written somewhere, brought into the order in which read_back() takes them."""
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")


def read_back(parts: DataFrame) -> DataFrame:
    """What a parser finds in format_conversations() output, which has a conversation's parts in order within a partition.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline of each turn),
    loss_chars and loss_sha256 (what the loss mask covers, unescaped), and
    formatted_chars. Parts that are missing, repeated or out of order are an error;
    in_order() puts them right where only the order is lost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, due, turns, texts, counts = None, 0, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
        for batch in batches:
            out = []
            for conv, no, text, last, loss in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if no != due or no and conv != now:
                    raise ValueError(f"part {no} of conversation {conv} is not where it should be")
                if no == 0:
                    if not text.startswith(BEGIN):
                        raise ValueError("a conversation does not begin")
                    now, turns, texts, counts = conv, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                for role, said in parse(text, len(BEGIN) if no == 0 else 0):
                    counts[0] += 1
                    turns.update(f"{role}\n{said}\n".encode())
                for place in loss or ():
                    said = unescape(text[place["start"] : place["end"]])
                    counts[1] += len(said)
                    texts.update(said.encode())
                counts[2] += len(text)
                due = 0 if last else no + 1
                if last:
                    out.append((conv, counts[0], turns.hexdigest(), counts[1], texts.hexdigest(), counts[2]))
            if out:
                types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        if due:
            raise ValueError(f"conversation {now} does not end")

    return parts.select("conv_id", "part", "formatted", "last", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
