"""Spelling variants against a plain search of all words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

from palisade.llm import common, spelling

SCHEMA = "doc_id bigint, text string, word string, n bigint, id bigint, node int, near string"


def plain_counts(rows) -> dict[str, int]:
    seen: Counter[str] = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 97 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            seen[low] += len(low) >= 5
    return {w: n for w, n in seen.items() if n >= 3}


def plain(rows) -> set[tuple]:
    words = plain_counts(rows)
    short = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            short[w[:i] + w[i + 1 :]].add((i, w))
    near = defaultdict(set)
    for rest, found in short.items():
        for i, w in found:
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
            near[w] |= {v for j, v in found if j == i and v != w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 2 * n:
            form[w] = best

    def root(w: str) -> str:
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def found(df) -> list[tuple]:
    out = [tuple(r) for r in spelling.variants(df).collect()]
    assert len(out) == len({r[0] for r in out})
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, "y") for i, t in rows], SCHEMA).repartition(3)


def test_documents(docs):
    assert set(found(docs)) == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_dense_words_chains_and_ties(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("".join(rng.choices("abÀ", k=rng.randint(4, 7))) for _ in range(400))) for i in range(6)]
    # aaaaa <- aaaab <- aaabb ...: forms of forms; words that are prefixes and runs of one letter.
    rows += [(100 + i, "chaina " * 24 + "chainb " * 12 + "chaibb " * 6 + "chabbb " * 3 + "qqqqqq " * 3 + "qqqqqqq " * 6 + "tiexx tieyx tiezx " * 3) for i in range(2)]
    got = found(table(spark, rows))
    assert set(got) == plain(rows)
    assert any(r[1] and r[1] != r[2] for r in got)


def test_odd_rows(spark):
    long = "abcdefghij" * 3000
    rows = [(1, None), (2, ""), (3, "1234 ... \n"), (None, "noid words noid words Noid WORDS words"), (None, None), (4, f"{long} {long[:-1]} {long}q " * 3),
            (5, "École ÉCOLE École école école école ×÷×÷× ×÷×÷× ×÷×÷×"), (6, "repeated"), (6, "repeated"), (6, "repeated")]
    assert set(found(table(spark, rows))) == plain(rows)


def test_texts_read_in_pieces(monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 7)
    text = "one twotwotwotwotwo three, four5five six " * 3
    assert [r for part in spelling.runs(text) for r in part] == re.findall("[A-Za-z]+", text)


def test_empty(spark, no_docs):
    assert found(no_docs) == []
    assert found(table(spark, [(1, "a b c")])) == []


def test_spread_join_of_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 10)
    left = spark.range(200).selectExpr("if(id < 150, 1, id) AS k", "id")
    right = spark.range(1, 180).selectExpr("id AS k", "id * 2 AS twice")
    want = sorted(tuple(r) for r in left.join(right, "k").collect())
    assert sorted(tuple(r) for r in common.spread_join(left, right, "k").collect()) == want
    assert common.spread_join(left, right.select("k"), "k", "left_semi").count() == len(want)
