"""Near-duplicate classes against all pairs of a small table."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from palisade.llm import neardup


def bags(rows):
    out = {}
    for i, t in rows:
        w = (t or "").lower().split()
        out[i] = Counter(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else Counter()
    return out


def brute(rows, threshold=0.8, slack=0.0, strength=0.25):
    """Classes over all pairs; pairs within ``slack`` of the threshold are returned apart."""
    sets = bags(rows)
    df = Counter(s for b in sets.values() for s in b)
    idf = {s: 1 + strength * math.log((1 + len(rows)) / (1 + c)) / math.log(len(rows) + 1) for s, c in df.items()}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    close = []
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            low = sum(min(sets[a][s], sets[b][s]) * idf[s] for s in sets[a].keys() & sets[b].keys())
            high = sum(max(sets[a][s], sets[b][s]) * idf[s] for s in sets[a].keys() | sets[b].keys())
            j = low / high if high else 1.0
            if abs(j - threshold) < slack:
                close.append((a, b, j))
            if j >= threshold:
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: find(i) for i in ids}, close


def test_samples_agree_as_often_as_similar():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**32, 900, dtype=np.uint32)
    sampler = neardup.Sampler(np.ones(1 << neardup.IDF_BITS, np.float32))
    agree = []
    for k in range(40):
        other = np.concatenate([base[:800], rng.integers(0, 2**32, 100, dtype=np.uint32)])
        agree.append((sampler.of(np.sort(base)) == sampler.of(np.sort(other))).mean())
        base = rng.integers(0, 2**32, 900, dtype=np.uint32)
    assert abs(np.mean(agree) - 800 / 1000) < 0.04


def test_table_against_all_pairs(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want, close = brute(rows, slack=0.002)
    assert not close
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert got == want


def test_edited_copies_against_all_pairs(spark):
    """Groups of copies with more and more edits, and a passage that many texts share."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    passage = rnd.choices(words, k=60)
    rows = []
    for g in range(12):
        base = rnd.choices(words, k=rnd.choice([30, 120, 400]))
        for _ in range(25):
            t = list(base)
            for _ in range(rnd.randrange(0, max(2, len(t) // 22))):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            rows.append((len(rows), " ".join(t + (passage if g % 3 == 0 else []))))
    want, close = brute(rows, slack=0.0)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = {r.doc_id: r.class_id for r in neardup.classes(df).collect()}
    assert got == want
    kept = {r.doc_id for r in neardup.deduplicated(df).collect()}
    assert kept == set(want.values())


def test_odd_rows(spark, odd, no_docs):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    out = neardup.classes(odd).collect()
    assert len(out) == len(rows)
    blank = {i for i, t in rows if i is not None and not (t or "").strip(" \t\n\r\x0b\x0c")}
    assert {r.class_id for r in out if r.doc_id in blank} == {min(blank)}
    one = [i for i, t in rows if t == "one"]
    assert {r.class_id for r in out if r.doc_id in one} == {min(one)}
    kept = neardup.deduplicated(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()).most_common(1)[0][1] == 1
    assert neardup.classes(no_docs).count() == 0 and neardup.deduplicated(no_docs).count() == 0


def test_similarity_counts_repeats():
    idf = np.ones(1 << neardup.IDF_BITS, np.float32)
    a, b = np.array([1, 1, 2], np.uint32), np.array([1, 2, 2], np.uint32)
    assert neardup.similarity(a, b, idf) == 2 / 4
    found, at = neardup.shingles(pa.array(["a b c", None, "a b c d e f", "a b c d e a b c d e"]))
    assert np.diff(at).tolist() == [1, 0, 2, 6]


def test_beyond_the_lightest_member():
    """Of two members that are similar to each other but not to the hub, the rare ends of what is beyond it meet."""
    rng = np.random.default_rng(2)
    counts, idf = rng.integers(1, 50, 1 << neardup.IDF_BITS), 1 + rng.random(1 << neardup.IDF_BITS).astype(np.float32) / 4
    pool = rng.integers(0, 2**32, 60, dtype=np.uint32)
    weigh = lambda x: idf[x >> (32 - neardup.IDF_BITS)].sum()
    seen = 0
    for _ in range(4000):
        base = rng.choice(pool, rng.integers(5, 30))
        mutate = lambda: np.sort(np.concatenate([base[rng.random(len(base)) > 0.1], rng.choice(pool, rng.integers(0, 4))]))  # noqa: B023, E731
        trio = sorted((mutate() for _ in range(3)), key=weigh)
        h, x, y = trio
        cmp = neardup.Beyond(idf, counts, 0.8)
        cmp.hub(h)
        (near_x, more_x), (near_y, more_y) = cmp.member(x), cmp.member(y)
        assert near_x == (neardup.similarity(h, x, idf) >= 0.8)
        if neardup.similarity(x, y, idf) >= 0.8 and not (near_x and near_y):
            seen += 1
            assert set(more_x.tolist()) & set(more_y.tolist())
    assert seen > 100


def test_names_of_helpers_are_free(spark):
    rows = [(i, "one two three four five six seven", "a", 1, 2, 3, 4) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, own string, node int, id int, rows int, _rows int")
    out = neardup.deduplicated(df)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [rows[0]]


def test_held_sets_find_what_a_full_comparison_finds():
    rng = np.random.default_rng(7)
    idf = 1 + rng.random(1 << neardup.IDF_BITS).astype(np.float32) / 4
    pool = rng.integers(0, 2**32, 400, dtype=np.uint32)
    sets = [np.zeros(0, np.uint32)] + [np.sort(np.concatenate([b := rng.choice(pool, rng.integers(1, 60)), rng.choice(pool, rng.integers(0, 4)), b[:3]])) for _ in range(40)]
    sets += [np.sort(np.concatenate([s, rng.choice(pool, k)])) for s in sets[1:20] for k in (1, 4)]
    held = neardup.Held(idf, 0.8)
    for i, s in enumerate(sets):
        held.add(i, i % 3, s)
    hits = 0
    for j, s in enumerate(sets):
        want = [i for i, o in enumerate(sets) if i % 3 != j % 3 and neardup.similarity(s, o, idf) >= 0.8]
        hits += len(want)
        assert held.similar(j % 3, s) == want
    assert hits > 20


def test_sampler_tables_are_small():
    import tracemalloc

    idf = np.ones(1 << neardup.IDF_BITS, np.float32)
    tracemalloc.start()
    neardup.Sampler(idf)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Three tables of 16 MB, and one part of a fourth.
    assert peak < 64 << 20
