r"""Chat formatting with a grammar that reads back exactly what was written.

    conversation := turn*        turn := "### " role ": " text "</turn>" NEWLINE

A backslash before ``\``, ``###``, ``</turn>`` (and ``:`` in a role) takes the meaning from what follows; any other backslash
is itself. A turn is rendered as it stands, parsed again and compared with its source; when they differ, control strings are
escaped, and when they still differ, backslashes too. Most texts need no escape, and the parser needs no flag to tell.
Turns end at their own marker, so a conversation parses turn by turn and streams through a task: rows are dealt by
conversation and sorted by turn, and nothing but the current turn is in memory, however long the conversation is.

Nulls: a null role or text is empty, a null turn comes first, rows without conv_id form one conversation. Equal turns are
ordered by role and text; repeated rows are turns of their own. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, MID, END = "### ", ": ", "</turn>"
TEXT_TOKEN = re.compile(r"\\(\\|###|</turn>)|(</turn>)|(###)")
ROLE_TOKEN = re.compile(r"\\(\\|###|</turn>|:)|(:)|(###|</turn>)")
LEARNED = "assistant"


class Unreadable(ValueError):
    """The text is not in the grammar."""


def _read(token: re.Pattern[str], s: str, at: int) -> tuple[str, int]:
    """Content from ``at`` up to its end mark, unescaped, and where the mark begins."""
    out = []
    for m in token.finditer(s, at):
        out.append(s[at : m.start()])
        if m[2]:
            return "".join(out), m.start()
        if m[3]:
            raise Unreadable("control string without escape")
        out.append(m[1])
        at = m.end()
    raise Unreadable("no end mark")


def parse_turn(s: str, at: int = 0) -> tuple[str, str, int, int, int]:
    """(role, text, where the text's span begins and ends, where the next turn begins)."""
    if not s.startswith(HEAD, at):
        raise Unreadable("no head")
    role, colon = _read(ROLE_TOKEN, s, at + len(HEAD))
    if not s.startswith(MID, colon):
        raise Unreadable("no role end")
    begin = colon + len(MID)
    text, end = _read(TEXT_TOKEN, s, begin)
    if not s.startswith(END + "\n", end):
        raise Unreadable("no line end")
    return role, text, begin, end, end + len(END) + 1


def parse(s: str) -> list[tuple[str, str]]:
    """All turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(s):
        role, text, _, _, at = parse_turn(s, at)
        turns.append((role, text))
    return turns


def _escapes(s: str, marks: str) -> Iterator[str]:
    yield s
    yield re.sub(marks, r"\\\g<0>", s)
    yield re.sub(r"\\|" + marks, r"\\\g<0>", s)


def render_turn(role: str, text: str) -> str:
    """The least escaped form of a turn that reads back as the turn."""
    for a, b in zip(_escapes(role, "###|</turn>|:"), _escapes(text, "###|</turn>"), strict=True):
        s = f"{HEAD}{a}{MID}{b}{END}\n"
        try:
            back = parse_turn(s)
        except Unreadable:
            continue
        if back[:2] == (role, text) and back[4] == len(s):
            return s
    raise AssertionError("full escaping reads back")


def format_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, formatted, loss): each turn's text in the template; ``loss`` marks turns to learn from.

    A conversation is the concatenation of its rows, which lie together and in order.
    """
    src = conversations.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"))
    kinds = {c: src.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            yield pa.RecordBatch.from_pydict({
                "conv_id": batch.column("conv_id"), "turn": batch.column("turn"),
                "formatted": pa.array(map(render_turn, roles, texts), pa.string()), "loss": pa.array([r == LEARNED for r in roles], pa.bool_())})

    dealt = src.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(render, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, formatted string, loss boolean")


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation of ``format_turns``, from the formatted text alone."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None

        def close() -> tuple:
            return (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5])

        for batch in batches:
            done = []
            for conv, s, loss in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")], strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(close())
                    now = (conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0)
                role, text, begin, end, after = parse_turn(s)
                if after != len(s):
                    raise Unreadable("more than one turn in a row")
                now[2].update(f"{role}\n{text}\n".encode())
                learned = 0
                if loss:
                    masked = _read(TEXT_TOKEN, s[begin:end] + END, 0)[0]
                    now[4].update(masked.encode())
                    learned = len(masked)
                now = (conv, now[1] + 1, now[2], now[3] + learned, now[4], now[5] + len(s))
            if done:
                yield _rows(done, batch.schema.field("conv_id").type)
            id_type = batch.schema.field("conv_id").type
        if now is not None:
            yield _rows([close()], id_type)

    return formatted.mapInArrow(digest, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def _rows(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
