"""Where source text is code, string or comment, told on whole Arrow columns.

A language is an automaton over bytes. A byte maps states to states and maps compose, so the text of a whole column is scanned at
once: it is cut into blocks, all blocks are walked side by side from every state, the blocks' maps are composed, and a second walk
from the state that each block is entered in gives the state behind every byte. A text starts in code whatever stood before it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

CODE, STRING, COMMENT = range(3)
KINDS = {"code": CODE, "string": STRING, "comment": COMMENT}
BLOCK = 128
SLICE = 1 << 20


@dataclass
class Language:
    """States with their kinds, and steps by byte class; class 0 is every other byte."""

    classes: np.ndarray
    table: np.ndarray
    kinds: np.ndarray
    # A state that only the next byte explains, and what its byte is when that leads to a comment.
    pending: list[int] = field(default_factory=list)


def _language(marks: str, states: dict[str, tuple[int, dict[str, str], str]], pending: tuple[str, ...] = ()) -> Language:
    """From {state: (kind, {byte: next state}, next state otherwise)}; a next state ``=X`` is what X would do with the byte."""
    names = list(states)
    classes = np.zeros(256, np.uint8)
    for i, mark in enumerate(marks, 1):
        classes[ord(mark)] = i

    def step(state: str, mark: str | None) -> str:
        _, steps, other = states[state]
        to = steps.get(mark, other)
        return step(to[1:], mark) if to[0] == "=" else to

    table = np.array([[names.index(step(s, m)) for s in names] for m in [None, *marks]], np.uint8)
    return Language(classes, table, np.array([states[s][0] for s in names], np.uint8), [names.index(p) for p in pending])


def _quoted(q: str, triple: bool) -> dict[str, tuple[int, dict[str, str], str]]:
    """States of a text in quotes ``q``: opened, inside, escaped, twice the quote, and the same for three quotes."""
    a = {"'": "s", '"': "d", "`": "t"}[q]
    if not triple:
        line = {} if q == "`" else {"\n": "code"}
        return {a: (STRING, {q: a + "/", "\\": a + "\\", **line}, a), a + "\\": (STRING, {}, a), a + "/": (STRING, {}, "=code")}
    return {
        a + "1": (STRING, {q: a + "2", "\\": a + "\\", "\n": "code"}, a), a: (STRING, {q: a + "/", "\\": a + "\\", "\n": "code"}, a),
        a + "\\": (STRING, {}, a), a + "/": (STRING, {}, "=code"), a + "2": (STRING, {q: a + "3"}, "=code"),
        a + "3": (STRING, {q: a + "4", "\\": a + "3\\"}, a + "3"), a + "3\\": (STRING, {}, a + "3"),
        a + "4": (STRING, {q: a + "5", "\\": a + "3\\"}, a + "3"), a + "5": (STRING, {q: a + "/", "\\": a + "3\\"}, a + "3"),
    }


_BLOCK_COMMENT = {"block": (COMMENT, {"*": "star"}, "block"), "star": (COMMENT, {"/": "shut", "*": "star"}, "block"), "shut": (COMMENT, {}, "=code")}

LANGUAGES = {
    "python": _language("'\"\\\n#", {
        "code": (CODE, {"'": "s1", '"': "d1", "#": "line"}, "code"), "line": (COMMENT, {"\n": "code"}, "line"), **_quoted("'", True), **_quoted('"', True)}),
    "script": _language("'\"`\\\n/*", {
        "code": (CODE, {"'": "s", '"': "d", "`": "t", "/": "slash"}, "code"), "slash": (CODE, {"/": "line", "*": "block"}, "=code"),
        "line": (COMMENT, {"\n": "code"}, "line"), **_BLOCK_COMMENT, **_quoted("'", False), **_quoted('"', False), **_quoted("`", False)}, ("slash",)),
    "sql": _language("'\n-/*", {
        "code": (CODE, {"'": "s", "-": "dash", "/": "slash"}, "code"), "dash": (CODE, {"-": "line"}, "=code"), "slash": (CODE, {"*": "block"}, "=code"),
        "line": (COMMENT, {"\n": "code"}, "line"), **_BLOCK_COMMENT, "s": (STRING, {"'": "s/"}, "s"), "s/": (STRING, {}, "=code")}, ("dash", "slash")),
}
# Endings of files and what they are written in.
ENDINGS = {"py": "python", "js": "script", "ts": "script", "tsx": "script", "jsx": "script", "java": "script", "go": "script", "c": "script", "sql": "sql"}


def composed_blocks(maps: np.ndarray) -> np.ndarray:
    """Per block the state behind it when the first block is entered in state 0."""
    out, d = maps, 1
    while d < len(out):
        out = np.concatenate([out[:d], np.take_along_axis(out[d:], out[:-d], 1)])
        d *= 2
    return out[:, 0]


def kinds_of(language: Language, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Kind of every byte of texts that lie behind one another and begin at ``starts``."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint8)
    rows = -(-n // BLOCK)
    cls = np.zeros(rows * BLOCK, np.uint8)
    cls[:n] = language.classes[data]
    begins = np.zeros(rows * BLOCK, bool)
    begins[starts[starts < n]] = True
    # Walked byte by byte over all blocks: columns are contiguous.
    cls, begins = np.ascontiguousarray(cls.reshape(rows, BLOCK).T), np.ascontiguousarray(begins.reshape(rows, BLOCK).T)
    states = language.table.shape[1]
    flat = language.table.ravel()
    maps = np.tile(np.arange(states, dtype=np.uint8), (rows, 1))
    for j in range(BLOCK):
        if begins[j].any():
            maps[begins[j]] = 0
        maps = flat[cls[j].astype(np.int32)[:, None] * states + maps]
    entered = np.concatenate([np.zeros(1, np.uint8), composed_blocks(maps)[:-1]])
    after = np.empty((BLOCK, rows), np.uint8)
    now = entered
    for j in range(BLOCK):
        now = np.where(begins[j], 0, now)
        now = flat[cls[j].astype(np.int32) * states + now]
        after[j] = now
    after = after.T.ravel()[:n]
    out = language.kinds[after]
    for p in language.pending:
        # The first byte of a comment's opening looks like code until the second is read.
        at = np.flatnonzero(after[:-1] == p)
        at = at[(language.kinds[after[at + 1]] == COMMENT) & ~np.isin(at + 1, starts)]
        out[at] = COMMENT
    return out


def masked(texts: pa.Array, language: str, keep: str) -> pa.Array:
    """Texts of the same length in bytes with blanks for all that is not of the kind ``keep``; line ends stay."""
    texts = texts.cast(pa.large_string())
    out = []
    for part in text_parts(texts):
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if part.buffers()[2] else np.zeros(0, np.uint8)
        kind = kinds_of(LANGUAGES[language], data, offsets[:-1] - offsets[0])
        blank = np.where((kind == KINDS[keep]) | (data == 10), data, np.uint8(32))
        made = pa.LargeStringArray.from_buffers(len(part), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(blank.tobytes()))
        out.append(pc.if_else(pc.is_valid(part), made, None) if part.null_count else made)
    whole = pa.concat_arrays(out) if out else pa.array([], pa.large_string())
    return whole.cast(pa.string())


def text_parts(texts: pa.Array):
    """Pieces of about ``SLICE`` bytes; one text is never cut."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // SLICE
    starts = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
    for a, b in zip(starts, [*starts, len(sizes)][1:], strict=True):
        yield texts.slice(a, b - a)


def only(keep: str, content: Column, path: Column) -> Column:
    """Text with blanks for what is not ``keep`` (code, string or comment), by the language that the path's ending names.

    Text of other files counts as code.
    """

    @F.arrow_udf("string")
    def mask(texts: pa.Array, ending: pa.Array) -> pa.Array:
        texts, named = _one(texts), _one(ending).to_pylist()
        by = {}
        for i, e in enumerate(named):
            by.setdefault(ENDINGS.get(e or ""), []).append(i)
        if list(by) == [None]:
            return texts if keep == "code" else pa.nulls(len(texts), pa.string()).fill_null("")
        places, parts = [], []
        for language, at in by.items():
            own = texts.take(pa.array(at))
            parts.append(masked(own, language, keep) if language else own if keep == "code" else pa.array([None if x is None else "" for x in own.to_pylist()], pa.string()))
            places += at
        order = np.empty(len(places), np.int64)
        order[places] = np.arange(len(places))
        return pa.concat_arrays([p.cast(pa.string()) for p in parts]).take(pa.array(order))

    return mask(content, F.lower(F.regexp_extract(path, r"[.]([A-Za-z0-9]+)$", 1)))


def _one(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
