"""Cycles, closure and resolved imports against plain searches."""

from __future__ import annotations

import random

import pytest

from palisade.operators.detect import graph as G


def plain_reach(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)

    def from_(a):
        seen, todo = set(), list(after.get(a, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += after.get(x, ())
        return seen

    return from_


@pytest.mark.parametrize("seed", range(3))
def test_strong_components_and_closure(spark, seed):
    rng = random.Random(seed)
    n = 14
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range([10, 22, 40][seed])]
    e = spark.createDataFrame(edges, "src int, dst int")
    nodes = spark.range(n).selectExpr("cast(id as int) AS node")
    reach = plain_reach(edges)
    want = {a: min([a, *[b for b in reach(a) if a in reach(b)]]) for a in range(n)}
    found = G.strong_components(e, nodes)
    assert {r.node: r.component for r in found.collect()} == want and found.count() == n
    pairs = {(want[a], want[b]) for a in range(n) for b in reach(a) if want[a] != want[b]}
    assert {tuple(r) for r in G.closure(e, found).collect()} == pairs


def test_one_ring_and_a_tail(spark):
    edges = [(i, (i + 1) % 6) for i in range(6)] + [(5, 10), (10, 11), (11, 11)]
    got = {r.node: r.component for r in G.strong_components(spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame([(i,) for i in [*range(6), 10, 11, 12]], "n int")).collect()}
    assert got == {**dict.fromkeys(range(6), 0), 10: 10, 11: 11, 12: 12}


def test_no_edges(spark):
    none = spark.createDataFrame([], "src int, dst int")
    assert G.strong_components(none, spark.range(2)).count() == 2
    assert G.strong_components(none, spark.range(0)).collect() == []


def test_imports_are_resolved_by_the_longest_ending(spark):
    paths = ["app/util/text.py", "lib/util/text.py", "app/core/__init__.py", "web/a/index.ts", "web/b.js", "os.py", "app/main.py", "top.py"]
    files = spark.createDataFrame([("r", p) for p in paths] + [("other", "only/here.py")], "repo string, path string")
    asked = [
        ("app/main.py", "util.text", "app/util/text.py"), ("lib/x.py", "util.text", "lib/util/text.py"), ("app/main.py", "lib.util.text", "lib/util/text.py"),
        ("app/main.py", "pkg.app.util.text", "app/util/text.py"), ("app/main.py", "app.core", "app/core/__init__.py"), ("app/main.py", "os", "os.py"),
        ("app/main.py", "sys", None), ("app/main.py", "far.away.text", None), ("app/main.py", "only.here", None), ("web/c.js", "./b", "web/b.js"), ("web/c.js", "./b.js", "web/b.js"),
        ("web/deep/c.js", "../a", "web/a/index.ts"), ("web/c.js", "./top", None), ("app/util/text.py", ".text2", None), ("app/main.py", ".core", "app/core/__init__.py"),
        ("app/util/x.py", "..core", "app/core/__init__.py"), ("top.py", "top", None)]
    got = G.resolve_imports(spark.createDataFrame([("r", s, m) for s, m, _ in asked], "repo string, src string, dst string"), files).collect()
    assert {(r.src, r.module): r.file for r in got} == {(s, m): f for s, m, f in asked}
