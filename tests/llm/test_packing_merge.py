"""Bins that are not full merge, all of them, whatever their number and their tasks."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from palisade.llm import packing

BYTES_FILE = public_tokenizers.path("byte_bpe_50k.json")


def test_gaps_of_all_bins_are_used(spark):
    """20 bins of one task have a gap, and 17 other tasks a small bin each that fits there."""
    small = "id % 20 = 0 AND (id BETWEEN 20 AND 320 OR id = 640)"
    df = spark.range(660, numPartitions=33).where(f"id < 20 OR {small}").selectExpr("id AS doc_id", "repeat('a b ', if(id < 20, 750, 250)) AS text")
    places = defaultdict(list)
    for r in packing.pack(df, BYTES_FILE).collect():
        places[r.sequence_id].append((r.offset, r.length))
    fills = []
    for held in places.values():
        ends = np.cumsum([x for _, x in sorted(held)])
        assert [a for a, _ in sorted(held)] == [0, *ends[:-1]] and ends[-1] <= 2048
        fills.append(ends[-1])
    fills.sort()
    assert len(fills) == 20 and fills[0] + fills[1] > 2048


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=120), st.integers(30, 64))
def test_counted_best_fit_is_best_fit(sizes, room):
    plan = packing.counted_best_fit(Counter(sizes), room)
    bins = defaultdict(list)
    met = Counter()
    for size in sizes:
        rank, met[size] = met[size], met[size] + 1
        at = [i for i in range(len(plan["size"])) if plan["size"][i] == size and plan["first"][i] <= rank][-1]
        nth, inside = divmod(rank - plan["first"][at], plan["each"][at])
        bins[plan["bin"][at] + nth].append((plan["offset"][at] + inside * size, size))
    for held in bins.values():
        end = 0
        for offset, size in sorted(held):
            assert offset == end
            end += size
    want = Counter(sum(sizes[i] for i in b) for b in packing.best_fit(np.array(sizes, np.int64), room))
    assert Counter(sum(x for _, x in held) for held in bins.values()) == want
