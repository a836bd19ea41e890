"""The kept report equals a full recomputation after every batch."""

from __future__ import annotations

import random

from palisade.streaming.kept_report import KeptReport

SCHEMA = "detector string, rule_id string, severity int, repo string, path string, fingerprint string, side string, sign int"


def plain(rows: list[tuple]) -> set[tuple]:
    now, before = [r for r in rows if r[6] == "current"], [r for r in rows if r[6] == "previous"]
    out: dict[tuple, int] = {}

    def add(key, n=1):
        out[key] = out.get(key, 0) + n

    score: dict[tuple, int] = {}
    for d, rule, sev, repo, path, *_ in now:
        for key in (("signals", d, rule), ("signals", d, "all"), ("signals", "all", "all"), ("severity", str(sev), "")):
            add(key)
        score[repo, path] = score.get((repo, path), 0) + sev
    for repo in {r for r, _ in score}:
        for i, (path, s) in enumerate(sorted(((p, s) for (r, p), s in score.items() if r == repo), key=lambda x: (-x[1], x[0]))[:3]):
            add(("top files", repo, f"{i + 1} {path}"), s)
    a, b = {r[5] for r in now}, {r[5] for r in before}
    for name, group in (("new", a - b), ("fixed", b - a), ("persisting", a & b)):
        if group:
            add(("delta", name, ""), len(group))
    return {(*k, n) for k, n in out.items()}


def test_every_batch_equals_a_recomputation(spark, tmp_path):
    rng = random.Random(6)
    kept = KeptReport(spark, str(tmp_path), parts=5)
    live: list[tuple] = []
    for number in range(6):
        batch = []
        for r in rng.sample(live, min(len(live), rng.choice([0, 8, 25]))) if number != 4 else list(live):  # all go in the fifth
            live.remove(r)
            batch.append((*r, -1))
        for _ in range([40, 30, 0, 25, 0, 20][number]):
            d = rng.randrange(3)
            r = (f"D{d}", f"r{rng.randrange(2)}", d + 1, f"repo{rng.randrange(2)}", f"p{rng.randrange(9)}", f"f{rng.randrange(20)}", rng.choice(["current", "current", "previous"]))
            live.append(r)
            batch.append((*r, 1))
        df = spark.createDataFrame(batch, SCHEMA)
        kept.fold(df, number)
        if number == 3:
            kept.fold(df, number)  # repeated after a failure
        assert {tuple(r) for r in kept.report().collect()} == plain(live), number


def test_a_batch_leaves_other_parts_alone(spark, tmp_path):
    kept = KeptReport(spark, str(tmp_path), parts=16)
    rows = [("D1", "r", 2, "repo", f"p{i}", f"f{i}", "current", 1) for i in range(60)]
    kept.fold(spark.createDataFrame(rows, SCHEMA), 0)
    seen = {p: p.stat().st_mtime_ns for p in tmp_path.glob("files/state/part=*/*.parquet")}
    kept.fold(spark.createDataFrame([rows[0]], SCHEMA), 1)
    after = set(tmp_path.glob("files/state/part=*/*.parquet"))
    assert len({p.parent for p in seen} & {p.parent for p in after - set(seen)}) == 1 and len(set(seen) & after) >= len(seen) - 2


def test_changes_say_what_moved(spark, tmp_path):
    kept = KeptReport(spark, str(tmp_path))
    rows = [("D1", "r", 2, "repo", "p", "f", "current", 1)] * 3
    kept.fold(spark.createDataFrame(rows, SCHEMA), 0)
    (r,) = kept.counts.changes(spark.createDataFrame([("D1", "r", 2, 1)], "detector string, rule_id string, severity int, n bigint"), 1).collect()
    assert (r.before_n, r.after_n) == (3, 4)
