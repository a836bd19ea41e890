"""Merged summaries against exact answers, and what they are used for."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from palisade.operators import sketches as SK
from palisade.operators.detect import traffic
from palisade.operators.detect.spans import fingerprints, shared_passages


def test_actors_of_many_days_are_within_bounds(spark):
    events = spark.range(60_000).selectExpr("id % 20 AS day", "if(id % 3 = 0, 'a', 'b') AS key", "(id * 7919) % if(id % 3 = 0, 17000, 300) AS actor")
    exact = {r.key: r.n for r in events.groupBy("key").agg(F.count_distinct("actor").alias("n")).collect()}
    daily = SK.daily_actors(events, F.col("day"), "key", "actor")
    assert daily.count() == 40
    for r in SK.merged_actors(daily, "key").collect():
        assert r.low <= exact[r.key] <= r.high and r.days == 20 and abs(r.actors - exact[r.key]) <= 0.05 * exact[r.key]
    # A later day is merged without reading the earlier ones again.
    later = SK.daily_actors(events.limit(0).unionByName(spark.createDataFrame([(20, "b", 10**9)], events.schema)), F.col("day"), "key", "actor")
    grown = {r.key: r for r in SK.merged_actors(daily.unionByName(later), "key").collect()}
    assert grown["b"].days == 21 and grown["b"].low <= exact["b"] + 1 <= grown["b"].high


def test_quantiles_of_merged_parts(spark):
    values = spark.range(30_000).selectExpr("id % 7 AS part", "'k' AS key", "(id * 7919) % 10007 AS value")
    parts = SK.quantile_sketches(values, F.col("part"), "key", F.col("value"))
    (r,) = SK.merged_quantiles(parts, "key", {"median": 0.5, "p90": 0.9}).collect()
    ordered = sorted(x.value for x in values.collect())
    assert r.n == 30_000
    for got, q in ((r.median, 0.5), (r.p90, 0.9)):
        below = sum(x < got for x in ordered) / len(ordered)
        assert abs(below - q) < 0.02


def test_heavy_hitters_are_exact(spark):
    rng = random.Random(1)
    rows = [("hot",)] * 9000 + [(f"warm{i}",) for i in range(8) for _ in range(700)] + [(f"x{rng.randrange(10**6)}",) for _ in range(15_000)] + [(None,)] * 500
    df = spark.createDataFrame(rows, "item string").repartition(6)
    counts = Counter(r[0] for r in rows if r[0] is not None)
    total = sum(counts.values())
    for share in (0.2, 0.02, 0.01):
        got = {r.item: (r.n, r.total) for r in SK.heavy_hitters(df, F.col("item"), share).collect()}
        assert got == {i: (n, total) for i, n in counts.items() if n >= share * total}
    assert SK.heavy_hitters(df.limit(0), F.col("item"), 0.1).collect() == []


def test_heavy_hitters_of_groups(spark):
    df = spark.range(4000).selectExpr("id % 2 AS g", "if(id % 10 < 5, id % 10, id) AS item")
    got = sorted((r.g, r.item, r.n) for r in SK.heavy_hitters(df, F.col("item"), 0.1, ["g"]).collect())
    assert got == [(0, 0, 400), (0, 2, 400), (0, 4, 400), (1, 1, 400), (1, 3, 400)]


def test_stuffing(spark):
    rows = [("s1", i, "error") for i in range(60)] + [("s1", 3, "login")] + [("s2", 1, "error")] * 60 + [(f"o{i}", i, "error") for i in range(100)]
    df = spark.createDataFrame(rows, "src string, user_id int, kind string")
    got = traffic.stuffing(df, F.col("src"), F.col("kind") == "error", 0.1, 10, 3.0).collect()
    assert [tuple(r) for r in got] == [("s1", 60, 60, 1)]


def test_a_beat_with_jitter_and_gaps(spark):
    rng = random.Random(2)
    hour = 3600
    beats = [("beacon", 24 * i * hour + rng.randint(-1800, 1800)) for i in range(60) if i % 9]
    noise = [("person", rng.randrange(60 * 24 * hour)) for _ in range(55)]
    df = spark.createDataFrame([(k, 1_700_000_000 + s) for k, s in beats + noise], "key string, s long").selectExpr("key", "timestamp_seconds(s) AS ts")
    got = {r.key: r for r in traffic.periodicity(df, "key", "ts", hour * 1_000_000, 30).collect()}
    assert got["beacon"].lag == 24 and got["beacon"].strength > 0.5 and got["beacon"].events == len(beats)
    assert got["person"].strength < 0.35


def test_beats_are_summed_within_blocks(spark):
    """Whatever the blocks, strengths are those of a plain autocorrelation, and no row is made per bin and lag."""
    rng = random.Random(6)
    rows = [(str(k), rng.choice([rng.randrange(400), 9 * rng.randrange(44)])) for k, n in enumerate([1, 3, 40, 300, 900]) for _ in range(n)]
    rows += [("2", None), ("gone", None), (None, 5)]
    df = spark.createDataFrame(rows, "key string, h long").selectExpr("key", "timestamp_seconds(1700000000 div 3600 * 3600 + h * 3600) AS ts")
    want = {}
    for key in {k for k, _ in rows if k}:
        x, undated = {}, sum(k == key and h is None for k, h in rows)
        for _, h in ((k, h) for k, h in rows if k == key and h is not None):
            for d, w in ((-1, 1), (0, 2), (1, 1)):
                x[h + d] = x.get(h + d, 0) + w
        s, q, n = sum(x.values()) + 4 * undated, sum(v * v for v in x.values()) + 16 * undated**2, max(x, default=0) - min(x, default=0) + 1
        found = []
        for lag in range(3, 31):
            p = sum(v * x.get(b + lag, 0) for b, v in x.items())
            if p and 3 * lag <= n and q > s * s / n:
                found.append((round((p * n / (n - lag) - s * s / n) / (q - s * s / n), 6), -lag))
        if found:
            want[key] = (s // 4, -max(found)[1], max(found)[0])
    for width in (40, 1024):
        out = traffic.periodicity(df, "key", "ts", 3_600_000_000, 30, width=width)
        assert {r.key: (r.events, r.lag, r.strength) for r in out.collect()} == want
    assert len(want) >= 3
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_passages(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefgh") + rng.choice("ijklmnop") + str(rng.randrange(300))
    known = [[word() for _ in range(60)] for _ in range(4)]
    rows, want = [], set()
    for i in range(30):
        text = [word() for _ in range(rng.randrange(5, 80))]
        if i % 2:
            k, a = rng.randrange(4), rng.randrange(0, 30)
            at = rng.randrange(len(text) + 1)
            part = known[k][a : a + 30]
            text[at:at] = part
            want.add((i, k, at, a))
        rows.append((i, " ".join(text).upper()))
    df, bad = spark.createDataFrame([*rows, (99, None), (98, "short")], "doc int, text string"), spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(known)], "item int, text string")
    got = shared_passages(df, bad, "doc", "item").collect()
    assert {(r.doc, r.item) for r in got} == {w[:2] for w in want} and len(got) == len(want)
    for i, k, at, a in want:
        (r,) = [x for x in got if x.doc == i]
        # The ends are off by less than a window.
        assert at <= r.start <= at + 3 and at + 27 <= r.end <= at + 30 and r.known_start - a == r.start - at


def test_every_window_keeps_a_fingerprint(spark):
    text = " ".join(f"w{i % 11}" for i in range(90))
    places = sorted(r.place for r in fingerprints(spark.createDataFrame([(1, text)], "k int, text string"), "k", "text").collect())
    assert places[0] <= 3 and all(b - a <= 4 for a, b in zip(places, places[1:], strict=False)) and places[-1] >= 90 - 5 - 3


def test_fingerprints_are_the_smallest_of_each_window(spark):
    """Equal to a plain version on odd texts; each n-gram is hashed once, in one pass over the text."""
    rng = random.Random(8)
    texts = [None, "", "one two three four five six seven", "É é Ñ ß x y z w Ω 1", "a " * 30, *[" ".join(rng.choice(["ab", "Cd", "éf", "g-h", "7"]) for _ in range(n)) for n in (8, 9, 50, 400)]]
    df = fingerprints(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), "k", "text")
    want = set()
    for k, text in enumerate(texts):
        words = re.findall("[A-Za-z0-9À-ÿ]+", (text or "").lower())
        h = [hashlib.md5(" ".join(words[i : i + 5]).encode()).hexdigest() for i in range(len(words) - 4)]
        want |= {(k, *min((h[i], -i) for i in range(s, s + 4))) for s in range(len(h) - 3)}
    assert sorted(map(tuple, df.collect())) == sorted((k, x, -back) for k, x, back in want)
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
