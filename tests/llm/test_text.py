"""Chat formatting, top-k search, personal data and language identification against plain versions."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palisade.llm import chat, langid, pii, topk

MARKS = st.lists(st.sampled_from(["\\", "###", "### ", "</turn>", ":", "\n", "a", " ", "é", "assistant", ": "]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(MARKS, MARKS)
def test_turns_read_back(role, text):
    s = chat.render_turn(role, text)
    assert chat.parse(s + s) == [(role, text)] * 2


def test_plain_text_is_not_escaped():
    assert chat.render_turn("user", r"C:\dir # heading") == "### user: C:\\dir # heading</turn>\n"


def digests(rows):
    turns, loss = "".join(f"{r}\n{t}\n" for r, t in rows), "".join(t for r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_conversations(spark, sf):
    given_rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    odd = [(None, 1, "user", "x"), (-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok"),
           (-8, None, None, None), (-8, 0, "assistant", ""), (-8, 0, "assistant", ""), (-8, 2, "assistant", "\\" * 3 + "</turn>\U0001f600"), (-9, 5, "tool: x", "y" * 200_000)]
    df = spark.createDataFrame([(*r, 1) for r in given_rows + odd], "conv_id bigint, turn bigint, role string, text string, formatted int")
    groups = defaultdict(list)
    for c, turn, role, text in given_rows + odd:
        groups[c].append((turn is not None, turn, role or "", text or ""))
    want = {c: digests([r[2:] for r in sorted(rows)]) for c, rows in groups.items()}
    got = chat.read_back(chat.format_turns(df)).collect()
    assert {r.conv_id: tuple(r[1:5]) for r in got} == want and len(got) == len(want)
    assert chat.read_back(chat.format_turns(df.where("1 = 0"))).count() == 0


def plain_top(rows, queries, k):
    ints = []
    for i, v in rows:
        ok = v is not None and all(x is not None and math.isfinite(x) for x in v)
        ints.append((i, [math.floor(1024 * x) for x in v] if ok else None))
    out = Counter()
    for i, q in ints:
        if q is None or not queries(i):
            continue
        found = [(-sum(a * b for a, b in zip(q, v, strict=True)), j is None, j) for j, v in ints if v is not None and len(v) == len(q) and j != i]
        found = [(max(min(s, 2**63), -(2**63 - 1)), a, j) for s, a, j in found]
        for rank, (s, _, j) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k], 1):
            out[i, rank, j, -s] += 1
    return out


def test_top_k(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = topk.top_k(df, df.where("vec_id % 20 = 0"))
    assert Counter(map(tuple, got.collect())) == plain_top(rows, lambda i: i % 20 == 0, 10)


def test_top_k_odd_vectors(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(40)]
    rows += [(100, None), (200, [1.0, None]), (300, [float("nan"), 1.0]), (400, [float("inf"), 0.0]), (500, []), (501, []), (600, [1.0]), (601, [2.0]),
             (None, [2.0, 1.0]), (None, [2.0, 2.0]), (700, [1e30, -1e30]), (701, [-1e30, 1e12]), (0, [0.0, 1.0]), (800, [5.0, 5.0]), (800, [5.0, 5.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, id string, dim int").repartition(4)
    got = topk.top_k(df, df.where("vec_id % 100 = 0"))
    assert Counter(map(tuple, got.collect())) == plain_top(rows, lambda i: i is not None and i % 100 == 0, 10)
    assert topk.top_k(df.where("1 = 0"), df.where("1 = 0")).count() == 0


FORMS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    out = []
    for k, form in FORMS.items():
        for m in form.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            odd = [int(c) * 2 for c in digits[-2::-2]]
            luhn = (sum(map(int, digits[-1::-2])) + sum(x - 9 * (x > 9) for x in odd)) % 10 == 0
            if (k == "email" or (k == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (k == "card" and 12 <= len(digits) <= 19 and luhn)
                    or (k == "phone" and 9 <= len(digits) <= 15)):
                out.append((m.start(), list(FORMS).index(k), m.end(), k))
    return [(k, a, b) for a, _, b, k in sorted(out)]


PARTS = st.lists(st.sampled_from(["a", "b.c", "@", ".", "x-y", " ", "+1", "+", "1", "255", "256", "4111 1111-1111 1111", "(", "00", "é", "-", "1.2.3.4", "٣"]), max_size=16).map("".join)


@settings(max_examples=1500, deadline=None)
@given(PARTS)
def test_fixed_forms(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_personal_data(spark, docs, odd, no_docs):
    for df in (docs, odd):
        rows = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
        want = Counter()
        for i, t in rows:
            spans = plain_spans(t)
            n = Counter(k for k, _, _ in spans)
            want[i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()] += 1
        assert Counter(tuple(r[:6]) for r in pii.report(pii.find(df)).collect()) == want
    assert pii.find(no_docs).count() == 0 and pii.redact(no_docs).count() == 0


def test_contexts_find_other_forms(spark):
    """Seeds after `call me` teach the pattern; a number without a plus in that place is found, elsewhere not."""
    rows = [(i, f"please call me +1 212 555 0{i:03d} today") for i in range(30)]
    rows += [(100, "please call me 212-555-0199 today"), (101, "order number 212-555-0198 was sent"), (102, "call me maybe"), (103, "please call me 212-555-0199 today")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    spans = {r.doc_id: r.spans for r in pii.report(pii.find(df)).collect()}
    assert spans[100] == spans[103] == "phone:15:27" and spans[101] == spans[102] == "" and spans[0] == "phone:15:30"
    left = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert left[100] == left[0] == "please call me [PHONE] today" and left[101] == rows[31][1]


def test_linear_on_long_runs():
    for t in ("1" * 300_000, "a" * 300_000 + "@", "1." * 100_000, "+1" * 100_000, "1 " * 150_000, "(at)" * 50_000, "12 34 " * 40_000):
        pii.loose_spans(t, pii.base_spans(t))


def test_language(spark, docs, odd, no_docs):
    rows = {r.doc_id: r for r in langid.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in rows.items())
    held = [i for i, r in rows.items() if r.held_out]
    assert sum(rows[i].lang_pred == truth[i] for i in held) >= 0.95 * len(held)
    got = langid.identify(odd).collect()
    letters = {i: any(c.isalpha() for c in t or "") for i, t in [(r.doc_id, r.text) for r in odd.collect()]}
    assert len(got) == odd.count()
    assert all((r.lang_pred != "und") == letters[r.doc_id] for r in got if r.doc_id is not None)
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    none = langid.identify(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert langid.identify(no_docs).count() == 0


def test_kernel_of_presence():
    import numpy as np
    import pyarrow as pa

    grams = langid.Grams()
    words = pa.array(["ab", "x1y", "é", "12", "a"])
    owner, code, has = grams.of(words)
    text = lambda c: "".join(chr(x) for x in ((c >> 42) & 0x1FFFFF, (c >> 21) & 0x1FFFFF, c & 0x1FFFFF) if x)
    got = {(int(o), text(int(c))) for o, c in zip(owner, code, strict=True)}
    want = set()
    for i, w in enumerate(words.to_pylist()):
        for part in re.findall(r"[^\W\d_]+", w):
            p = f" {part} "
            want |= {(i, p[k : k + n]) for n in (1, 2, 3) for k in range(len(p) - n + 1) if p[k : k + n].strip()}
    assert {g for g in got if g[1].strip() and not re.search(r"\S \S", g[1])} == want
    assert has.tolist() == [True, True, True, False, True] and isinstance(code, np.ndarray)


def test_redaction_keeps_columns_of_any_name(spark):
    rows = [(1, "mail a.b@example.com now", 1, 2, 3), (2, None, 4, 5, 6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, own int, copy int, found int")
    out = pii.redact(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect()), key=str) == [(1, "mail [EMAIL] now", 1, 2, 3), (2, None, 4, 5, 6)]
