"""Large groups of near copies: compared in turns, without rounds, by a bound that loses no pair."""

from __future__ import annotations

import random

import numpy as np
import pytest

from palisade.llm import neardup


def rows_of_copies():
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(2):
        base = rnd.choices(words, k=150)
        for _ in range(60):
            t = list(base)
            for _ in range(rnd.choice([0, 1, 2, 4, 6, 8, 10])):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            rows.append((len(rows), " ".join(t)))
    return rows


@pytest.mark.parametrize("many, rounds", [(1000, False), (2, True)])
def test_turns_and_rounds_give_the_same_classes(spark, monkeypatch, many, rounds):
    df = spark.createDataFrame(rows_of_copies(), "doc_id bigint, text string").repartition(4)
    want = {r.doc_id: r.class_id for r in neardup.classes(df).collect()}
    monkeypatch.setattr(neardup, "FEW", 2)
    monkeypatch.setattr(neardup, "MANY", many, raising=False)
    met, compared = [], neardup.compared

    def counted(*args, beyond):
        met.append(beyond)
        return compared(*args, beyond=beyond)

    monkeypatch.setattr(neardup, "compared", counted)
    assert {r.doc_id: r.class_id for r in neardup.classes(df).collect()} == want
    assert any(met) == rounds


def test_sets_beyond_the_table_are_found(monkeypatch):
    """Shingles with a column and shingles with a list bound the similarity together; several members at once or one by one."""
    rng = np.random.default_rng(3)
    idf = 1 + rng.random(1 << neardup.IDF_BITS).astype(np.float32) / 4
    pool = rng.integers(0, 2**32, 300, dtype=np.uint32)
    sets = [np.zeros(0, np.uint32)] + [np.sort(np.concatenate([b := rng.choice(pool, rng.integers(1, 50)), b[:2]])) for _ in range(30)]
    sets += [np.sort(np.concatenate([s, rng.choice(pool, k)])) for s in sets[1:] for k in (1, 3, 9)]
    for columns in (1, 20, 5000):
        monkeypatch.setattr(neardup, "COLUMNS", columns)
        held = neardup.Held(idf, 0.8)
        for i, s in enumerate(sets):
            held.add(i, i % 4, s)
        want = [[i for i, o in enumerate(sets) if i % 4 != j % 4 and neardup.similarity(s, o, idf) >= 0.8] for j, s in enumerate(sets)]
        assert sum(map(len, want)) > 40
        assert held.similar_to([j % 4 for j in range(len(sets))], sets) == want
        assert [held.similar(j % 4, s) for j, s in enumerate(sets)] == want
    assert neardup.Held(idf, 0.8).similar(0, sets[1]) == []


def test_samples_do_not_depend_on_how_many_are_drawn_together(monkeypatch):
    rng = np.random.default_rng(9)
    sampler = neardup.Sampler(1 + rng.random(1 << neardup.IDF_BITS).astype(np.float32) / 4)
    for n in (1, 100, 700):
        found = np.sort(rng.choice(rng.integers(0, 2**32, n, dtype=np.uint32), 2 * n))
        kinds, tf = np.unique(found, return_counts=True)
        log_w, row = np.log(tf * sampler.idf[kinds >> (32 - neardup.IDF_BITS)]).astype(np.float32), kinds & np.uint32(neardup.DRAWS - 1)
        t = np.floor(log_w[:, None] * (1 / sampler.r[row]) + sampler.b[row])
        best = (sampler.fixed[row] - sampler.r[row] * t).argmin(0)
        x = (kinds[best].astype(np.uint64) * neardup.MIX) ^ (t[best, np.arange(neardup.SAMPLES)].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ sampler.sample
        want = ((x ^ (x >> np.uint64(31))) * neardup.MIX >> np.uint64(32)).astype(np.uint32)
        for together in (1, 64, 4096):
            monkeypatch.setattr(neardup, "TOGETHER", together, raising=False)
            assert (sampler.of(found) == want).all()
