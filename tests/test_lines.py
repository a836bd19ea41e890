"""Numbered lines: any split of a file gives the lines of the whole file."""

from __future__ import annotations

import gzip
import random

import pytest

from palisade.sources.lines import read_lines
from palisade.sources.scanner_log import read_log_lines, read_scanner_log


def whole(path) -> list[tuple[int, str]]:
    lines = path.read_bytes().decode().split("\n")
    if lines[-1] == "":
        lines.pop()
    return [(i, x.removesuffix("\r")) for i, x in enumerate(lines)]


@pytest.fixture()
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "256")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def test_one_file_over_many_tasks(spark, tmp_path, small_ranges):
    rng = random.Random(3)
    text = "".join(rng.choice(["", "a", "é" * rng.randint(1, 40), "x" * rng.randint(0, 700)]) + rng.choice(["\n", "\r\n"]) for _ in range(300))
    (tmp_path / "a.log").write_bytes(text.encode() + b"last")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.log").write_bytes(b"\n\nthree\n")
    (tmp_path / "empty.log").write_bytes(b"")
    assert spark.read.text(str(tmp_path / "a.log")).rdd.getNumPartitions() > 20
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    got = read_lines(spark, str(tmp_path)).collect()
    assert sorted((r.n, r.text) for r in got if r.file == "a.log") == whole(tmp_path / "a.log")
    one = read_lines(spark, str(tmp_path / "sub" / "a.log")).collect()
    assert sorted((r.file, r.n, r.text) for r in one) == [("a.log", 0, ""), ("a.log", 1, ""), ("a.log", 2, "three")]


def test_files_below_folders_and_compressed(spark, tmp_path):
    for day in ("day=1", "day=2"):
        (tmp_path / day).mkdir()
        (tmp_path / day / "x.log").write_text(f"{day}\nb\n")
    (tmp_path / "day=2" / "y.log.gz").write_bytes(gzip.compress(b"one\ntwo"))
    got = {(r.file, r.n, r.text) for r in read_lines(spark, str(tmp_path)).collect()}
    assert got == {("day=1/x.log", 0, "day=1"), ("day=1/x.log", 1, "b"), ("day=2/x.log", 0, "day=2"), ("day=2/x.log", 1, "b"),
                   ("day=2/y.log.gz", 0, "one"), ("day=2/y.log.gz", 1, "two")}


def test_a_scanner_log_over_many_tasks(spark, tmp_path, small_ranges):
    run = "[*] starting @ 14:0{i}\n[INFO] noise\nParameter: id{i} (GET)\n    Type: boolean-based blind\n    Title: AND blind\n    Payload: id={i} AND 1=1\nback-end DBMS: SQLite\n[*] ending @ 14:1{i}\n"
    (tmp_path / "scan.log").write_text("".join(run.replace("{i}", str(i)) for i in range(60)))
    log = read_scanner_log(read_log_lines(spark, str(tmp_path)), 50)
    assert sorted((r.run, r.started, r.ended, r.lines) for r in log["runs"].collect()) == [(i + 1, f"14:0{i}", f"14:1{i}", 8) for i in range(60)]
    assert sorted((r.run, r.n, r.parameter, r.payload) for r in log["points"].collect()) == [(i + 1, 8 * i + 5, f"id{i}", f"id={i} AND 1=1") for i in range(60)]
