"""Automata in parts against a plain walk."""

from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np
import pytest

from palisade.operators import automata
from palisade.operators.detect import traffic


def walk(rows, delta, start=0):
    state, last, out = start, object(), {}
    for key, at, symbol in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        state = start if key != last else state
        before, last = state, key
        state = state if symbol is None else delta[symbol][state]
        out[key, at] = (before, state)
    return out


@pytest.mark.parametrize("partitions", [1, 5, 16])
def test_hot_key(spark, partitions):
    rng = random.Random(partitions)
    rows = [("hot", i, rng.choice([0, 1, 2, None])) for i in range(900)] + [(rng.choice([None, "", "a", "b", "zz"]), i, rng.randrange(3)) for i in range(100)]
    rng.shuffle(rows)
    delta = [[1, 2, 0], [1, 1, 0], [2, 1, 2]]
    df = spark.createDataFrame(rows, "key string, at int, symbol int").repartition(7)
    got = automata.run_automaton(df, ["key"], ["at"], df.symbol, delta, 2, partitions)
    assert got.columns == ["key", "at", "symbol", "state_before", "state"]
    assert {(r.key, r.at): (r.state_before, r.state) for r in got.collect()} == walk(rows, delta, 2)


def test_hot_key_is_read_in_parts(spark):
    df = spark.range(4000).selectExpr("if(id < 3600, 1, id) AS key", "id AS at", "cast(id % 2 AS int) AS symbol")
    ranged = df.repartitionByRange(8, "key", "at").selectExpr("key", "spark_partition_id() AS p").where("key = 1").distinct()
    assert ranged.count() >= 5
    got = automata.run_automaton(df, ["key"], ["at"], df.symbol, [[1, 0], [0, 1]], 0, 8)
    assert got.count() == 4000


def test_empty(spark):
    df = spark.createDataFrame([], "key string, at int, symbol int")
    assert automata.run_automaton(df, ["key"], ["at"], df.symbol, [[0]]).collect() == []


def test_too_many_states(spark):
    df = spark.createDataFrame([], "key string, at int, symbol int")
    with pytest.raises(ValueError):
        automata.run_automaton(df, ["key"], ["at"], df.symbol, [list(range(16))])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.lists(st.integers(0, 3), min_size=4, max_size=4)), min_size=1, max_size=40))
def test_composed_maps(rows):
    first = np.array([f or not i for i, (f, _) in enumerate(rows)])
    got = automata.composed(np.array([m for _, m in rows]), first)
    now = None
    for i, (_, m) in enumerate(rows):
        now = m if first[i] else [m[s] for s in now]
        assert got[i].tolist() == now


CALL = '{"method": "tools.scan", "params": {"a": 1}}'
OTHER = '{"method":"tools.report"}'


def result(text, tool="tools.scan"):
    return f"Tool '{tool}' executed with result:\n{text}\n\nContinue reasoning or provide next instructions."


def chat(spark, *said):
    return spark.createDataFrame([(1, i, role, text) for i, (role, text) in enumerate(said)], "conv_id int, turn int, role string, text string")


def test_calls_and_their_outcomes(spark):
    messages = chat(
        spark, ("user", "go"), ("assistant", CALL), ("user", result('{"found": 2}')), ("assistant", OTHER), ("system", "still running"), ("user", result("None")),
        ("assistant", CALL), ("user", "never mind"), ("assistant", CALL), ("assistant", CALL), ("user", result('{"error": {"code": 1}}')), ("assistant", "done"), ("user", result("late")))
    got = sorted(tuple(r) for r in traffic.tool_calls(messages).collect())
    assert got == [
        (1, 1, 1, 1, "tools.scan", "ok", 2), (1, 1, 2, 3, "tools.report", "failed", 5), (1, 1, 3, 6, "tools.scan", "unanswered", None),
        (1, 2, 1, 8, "tools.scan", "unanswered", None), (1, 3, 1, 9, "tools.scan", "failed", 10)]
    chains = sorted(tuple(r) for r in traffic.call_chains(traffic.tool_calls(messages)).collect())
    assert chains == [(1, 1, 3, 2, 2, 1, True), (1, 2, 1, 1, 1, 8, True), (1, 3, 1, 1, 1, 9, True)]


def test_failures(spark):
    for text, outcome in [("", "failed"), ("null", "failed"), ('{"error": null, "a": 1}', "ok"), ("[1]", "ok"), ("plain", "ok"), ('{"error": "x"}', "failed")]:
        rows = traffic.tool_calls(chat(spark, ("assistant", CALL), ("user", result(text)))).collect()
        assert [r.outcome for r in rows] == [outcome], text


def test_one_long_conversation(spark):
    n = 2000
    messages = spark.range(2 * n).selectExpr(
        "if(id < 3900, 1, id) AS conv_id", "id AS turn", "if(id % 2 = 0, 'assistant', 'user') AS role",
        f"if(id % 2 = 0, '{CALL}', 'Tool ''tools.scan'' executed with result:\n' || if(id % 7 = 0, 'None', 'x')) AS text")
    chains = {r.conv_id: r for r in traffic.call_chains(traffic.tool_calls(messages)).collect()}
    assert chains[1].steps == 1950 and chains[1].failures == sum(i % 7 == 0 for i in range(1, 3900, 2)) and chains[1].chain == 1
