"""The registered language-model scores against a plain escape-and-exclude recursion over all n-grams of the training texts."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from palisade.llm import ppm, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_rare_words_teach_at_any_size(spark, monkeypatch):
    """Beside three million other bytes, a word that the training texts hold once is still spelled with ease."""
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    held = [i for i in range(100) if fold(i) == 1][:2]
    teach = [i for i in range(100) if fold(i) != 1][:2]
    df = spark.createDataFrame(
        [(teach[0], "abcd " * 600_000), (teach[1], "zyxwvu"), (held[0], "zyxwvu"), (held[1], "zyxqvu")], "doc_id bigint, text string")
    monkeypatch.setattr(queries, "documents", lambda *_: df)
    got = {r.doc_id: r.score for r in queries.op7_lm_score(spark, "").collect()}
    assert got[held[0]] > got[held[1]] + 5
    # Only its first byte and the end sign are rare where they stand; each other byte is the one that follows its context.
    assert got[held[0]] > -15


def plain(rows, teaches):
    """Scores by walking down from the longest context, over dictionaries of the training texts' bytes."""
    framed = [b" " + b"".join(w.encode() + b" " for w in WORD.findall(lowered(x))) + b"\n" for x in rows]
    seen = defaultdict(Counter)
    for s, t in zip(framed, teaches, strict=True):
        for i in range(1, len(s) if t else 1):
            for k in range(min(i, ppm.ORDER) + 1):
                seen[s[i - k : i]][s[i]] += 1
    memo = {}

    def log10(context, byte):
        out, p = set(), 1.0
        for k in range(len(context), -1, -1):
            left = {b: n for b, n in seen.get(context[len(context) - k :], {}).items() if b not in out}
            if byte in left:
                return math.log10(p * left[byte] / (sum(left.values()) + len(left)))
            if left:
                p *= len(left) / (sum(left.values()) + len(left))
                out |= set(left)
        return math.log10(p / (256 - len(out)))

    def value(s, i):
        key = s[max(0, i - ppm.ORDER) : i], s[i]
        if key not in memo:
            memo[key] = log10(*key)
        return memo[key]

    return [sum(value(s, i) for i in range(1, len(s))) for s in framed]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_contexts_cross_words(docs, odd):
    """Every row of both tables; a shuffled copy of a training text scores lower than the text."""
    rows = [(r.doc_id, r.text) for r in docs.union(odd.select(*docs.columns)).collect()]
    order = next(x for i, x in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1 and x and len(x) > 1000)
    ids = [i for i in range(10**6, 10**6 + 99) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    words = order.split()
    random.Random(3).shuffle(words)
    rows += [(ids[0], order), (ids[1], " ".join(words))]
    want = defaultdict(list)
    teaches = [i is not None and zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows]
    for (i, _), x in zip(rows, plain([x for _, x in rows], teaches), strict=True):
        want[i].append(x)
    df = docs.sparkSession.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = defaultdict(list)
    for r in ppm.score(df, block_bytes=200_000).collect():
        got[r.doc_id].append(r.score)
    assert got.keys() == want.keys()
    assert all(sorted(got[i]) == pytest.approx(sorted(want[i]), rel=1e-9) for i in want)
    assert got[ids[0]][0] > got[ids[1]][0] + 100


def test_long_texts_are_cut_without_loss():
    texts = pa.array(["x", " ab \n", " " + "abcde " * 50 + "\n", " c \n", ""])
    whole, cut = ([np.concatenate(x) for x in zip(*ppm.pieces(texts, limit), strict=True)] for limit in (1 << 20, 16))
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))


def test_empty(no_docs):
    assert ppm.score(no_docs).count() == 0
