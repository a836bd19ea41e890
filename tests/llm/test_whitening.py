"""Whitening against numpy's eigenvectors, and odd vectors."""

from __future__ import annotations

import numpy as np
import pytest

from palisade.llm import whitening

SCHEMA = "vec_id bigint, embedding array<double>, id int, x string, vector string, part int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "a", "b", 2) for i, v in rows], SCHEMA).repartition(3)


def plain(rows: list[tuple], k: int = 4):
    x = np.array([np.floor(256 * np.array(v, float)) for _, v in rows]).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    e, v = np.linalg.eigh(((fit - s / n).T @ (fit - s / n)) / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    deviation = [min(sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)), 2**63 - 1) for row in x]
    return n, deviation, np.abs((x - s / n) @ v / np.sqrt(e)), e / np.trace((fit - s / n).T @ (fit - s / n) / n)


def check(got, rows, close=1e-9):
    n, deviation, whitened, explained = plain(rows)
    by_row = {}
    for r in got:
        by_row.setdefault(r.vec_id, []).append(r)
    assert len(by_row) == len(rows)
    for (i, _), d, w in zip(rows, deviation, whitened, strict=True):
        mine = sorted(by_row[i], key=lambda r: r.component)
        assert [r.component for r in mine] == list(range(1, len(w) + 1))
        assert {(r.n, r.deviation) for r in mine} == {(n, d)}
        np.testing.assert_allclose(np.abs([r.whitened for r in mine]), w, rtol=close, atol=close)
        np.testing.assert_allclose([r.explained for r in mine], explained, rtol=1e-9)
        assert mine[0].identity_error < 1e-9


def test_embeddings(spark, sf):
    src = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in src.collect()]
    check(whitening.whiten(src).collect(), rows)


def test_ill_conditioned_with_copies(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)) @ np.diag(10.0 ** np.arange(8, 0, -1)) + 1e6
    x[150:] = x[0]  # half the rows are one vector
    rows = list(enumerate(x.tolist()))
    check(whitening.whiten(table(spark, rows)).collect(), rows, 1e-6)


def test_one_sign_for_all_rows(spark, sf):
    got = whitening.whiten(spark.read.parquet(f"{sf}/embeddings.parquet")).toPandas().pivot(index="vec_id", columns="component", values="whitened")
    assert np.abs(got.mean()).max() < 1e-9 and np.abs(got.var(ddof=0) - 1).max() < 1e-9


def test_flat_directions_have_no_scale(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (2, [1.0, 3.0, 3.0]), (3, [1.0, 2.5, 3.0])]
    got = {(r.vec_id, r.component): r for r in whitening.whiten(table(spark, rows)).collect()}
    assert abs(got[1, 1].whitened) == pytest.approx(1.5**0.5) and got[1, 1].explained == pytest.approx(1)
    assert got[1, 2].whitened is None and got[1, 2].explained == 0


def test_odd_vectors(spark):
    rows = [(1, [0.5, -0.5]), (1, [0.5, -0.5]), (2, None), (3, [1.0, None]), (4, [float("nan"), 0.0]), (5, [float("inf"), 0.0]), (6, []),
            (None, [2.0, 1.0]), (7, [1.0, 2.0, 3.0]), (8, [-0.001, 0.25])]
    got = whitening.whiten(table(spark, rows)).collect()
    assert sorted((str(r.vec_id), r.component, r.n) for r in got) == sorted(
        [("1", 1, 3), ("1", 2, 3)] * 2 + [("None", 1, 3), ("None", 2, 3), ("8", 1, 3), ("8", 2, 3)] + [("7", c, 1) for c in (1, 2, 3)])
    assert all(r.whitened is None and r.explained is None for r in got if r.vec_id == 7)


def test_large_entries_stay_exact(spark):
    rows = [(1, [2.0**45, 0.0]), (2, [2.0**45 + 1, 0.0]), (3, [1e30, 0.0])]
    got = {r.vec_id: r.deviation for r in whitening.whiten(table(spark, rows[:2])).collect()}
    assert got == {1: 256**2, 2: 256**2}
    assert {r.deviation for r in whitening.whiten(table(spark, rows)).collect()} == {2**63 - 1}


def test_empty(spark):
    assert whitening.whiten(table(spark, [])).collect() == []


def test_sums_in_a_tree(spark):
    parts = spark.range(600).selectExpr("cast(id as int) AS part").repartition(5)
    data = np.arange(3.0).astype("<f8").tobytes()
    from pyspark.sql import functions as F

    assert whitening.added(parts.withColumn("data", F.lit(bytearray(data))), 3).tolist() == [0.0, 600.0, 1200.0]
