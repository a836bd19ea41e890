"""Token counts, packing, quality rules and mixing against plain versions of themselves."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palisade.llm import mixing, packing, quality, tables, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORDS_FILE, BYTES_FILE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def sets(spark, odd, docs):
    return {"odd": odd, "docs": docs}


@pytest.mark.parametrize("name", ["odd", "docs"])
def test_token_counts(spark, odd, docs, name):
    df = sets(spark, odd, docs)[name]
    t = Tokenizer.from_file(WORDS_FILE)
    got = Counter(tuple(r) for r in token_counts.count_tokens(df, WORDS_FILE, block_bytes=100_000).collect())
    want = Counter()
    for r in df.select("doc_id", "text").collect():
        n = len(t.encode(r.text or "", add_special_tokens=False).ids)
        want[r.doc_id, len((r.text or "").encode()), n, n > 2048] += 1
    assert got == want


@pytest.mark.parametrize("name", ["odd", "docs"])
def test_packing(spark, odd, docs, name):
    df = sets(spark, odd, docs)[name].repartition(5)
    t = Tokenizer.from_file(BYTES_FILE)
    rows = packing.pack(df, BYTES_FILE).collect()
    want, total = Counter(), 0
    for r in df.select("doc_id", "text").collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[r.doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    fills = sorted(sum(x for _, x in p) for p in bins.values())
    assert len(fills) < 2 or fills[0] + fills[1] > 2048
    if name == "docs":
        assert len(bins) <= 1.02 * total / 2048 + 1


def test_rank_encoder_is_the_library(docs):
    ids = packing.Ids(BYTES_FILE)
    assert ids.fast is not None
    t = Tokenizer.from_file(BYTES_FILE)
    for r in docs.limit(50).collect():
        assert ids.whole(r.text).tolist() == t.encode(r.text, add_special_tokens=False).ids


def test_bins_of_many_tasks_merge(spark):
    """40 tasks with a large and a small bin each: the small ones end in the gaps."""
    df = spark.range(40, numPartitions=40).selectExpr("id as doc_id", "repeat('a b ', if(id % 2 = 0, 700, 280)) as text")
    rows = packing.pack(df, BYTES_FILE).collect()
    fills = Counter()
    for r in rows:
        fills[r.sequence_id] += r.length
    assert max(fills.values()) <= 2048
    two = sorted(fills.values())[:2]
    assert two[0] + two[1] > 2048


def repeat_words(words):
    w = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(w)
    return len({i + k for i, x in enumerate(w) if n[x] > 1 for k in range(5)})


@pytest.mark.parametrize("name", ["odd", "docs"])
def test_quality_measures(spark, odd, docs, name):
    df = sets(spark, odd, docs)[name]
    want = Counter()
    for r in df.select("doc_id", "text").collect():
        t = r.text or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        rep = repeat_words(w)
        want[r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep,
             len(w) < 10 or 100 * rep > 20 * len(w)] += 1
    out = quality.judge(df)
    assert Counter(tuple(r[:7]) for r in out.collect()) == want
    assert out.where("base_failed and kept").count() == 0


def test_boilerplate_counts_distinct_texts_per_host(spark):
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(12))
    rows = [(i, f"Share This  page\n{body(i)}", "a") for i in range(60)]  # a line of all texts
    rows += [(100 + i, "copy " + body(999), "a") for i in range(300)]  # copies count once
    rows += [(500 + i, "share this page and all these other words again here now\n" + "Share this page\n" * 12, "a") for i in range(1)]
    rows += [(600 + i, f"Share this page\n{body(i)}", None) for i in range(5)]  # too few documents
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    kept = {r.doc_id: r.kept for r in quality.judge(df).collect()}
    assert kept == {r[0]: r[0] != 500 for r in rows}
    left = {r.doc_id: r.text for r in quality.clean(df).collect()}
    assert left == {r[0]: r[1].split("\n")[-1] if r[0] < 60 else r[1] for r in rows if r[0] != 500}


def plain_targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        w = sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and w and left * weight[s] / w > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in capped else left * weight[s] / w for s in order}
        capped |= over


@pytest.mark.parametrize("name", ["odd", "docs"])
def test_mixing(spark, odd, docs, name):
    df = sets(spark, odd, docs)[name]
    rows = mixing.mix(df).collect()
    given = Counter((r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in df.select("doc_id", "source", "text").collect())
    assert Counter((r.doc_id, r.source, r["size"]) for r in rows) == given
    sizes = Counter()
    for (_, s, n), k in given.items():
        sizes[s] += n * k
    aims, taken = plain_targets(sizes), Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(aims[r.source])
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        taken[r.source] += r.taken
    largest = defaultdict(int)
    for r in rows:
        largest[r.source] = max(largest[r.source], r["size"])
    for s, aim in aims.items():
        assert abs(taken[s] - aim) <= largest[s] + 1e-6
    key = lambda rs: Counter((r.doc_id, r["size"], r.taken) for r in rs)
    assert key(rows) == key(mixing.mix(df.repartition(7)).collect())
    out = Counter((r.doc_id, r.text) for r in mixing.mixed(df).collect())
    assert sum(out.values()) == sum(r.copies for r in rows)


def test_copies_are_told_by_a_table_and_the_rest_joined(spark, odd, docs):
    """Whatever shares an entry, copies are the same; with room for all, only rows that are alike take part in the join."""
    rows = spark.createDataFrame([(i, i % 4) for i in range(300)] + [((1 << 40) + 5000, 7), (-5, 2)], "key long, value int")
    wide, narrow = tables.told(rows, 1 << 20), tables.told(rows, 1 << 14 >> 8)
    assert all(r.w == r.value for r in rows.select("value", wide("key").alias("w")).collect())
    assert all(r.w in (None, r.value) for r in rows.select("value", narrow("key").alias("w")).collect())
    for df in (odd, docs.unionByName(docs.where("doc_id % 7 = 0"))):
        want = Counter({(r.doc_id, r.key): 0 for r in mixing.mix(df).collect()})
        for r in mixing.mix(df).collect():
            want[(r.doc_id, r.key)] += r.copies
        key = F.xxhash64(F.lit(7), "doc_id", "source", F.coalesce("text", F.lit("")))
        for entries in (1, 64, mixing.MARKS):
            got = mixing.mixed(df, entries=entries).select("doc_id", key.alias("k")).collect()
            assert Counter((r.doc_id, r.k) for r in got) == +want
    plan = mixing.mixed(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") > plan.index("Union")


def test_rows_of_different_keys_do_not_move(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "key long, text string")
    assert "Exchange" not in quality.once(df, "key")._jdf.queryExecution().executedPlan().toString()
    twice = df.unionByName(df.where("key % 3 = 0")).unionByName(df.where("key = 6"))
    assert Counter(tuple(r) for r in quality.once(twice, "key").collect()) == Counter(tuple(r) for r in df.collect())


def test_large_source_meets_in_rounds(spark):
    df = spark.range(9000, numPartitions=4).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 37 as int)) as text", "if(id % 3 = 0, 'b', 'a') as source")
    rows = mixing.mix(df).groupBy("source", "target").sum("taken").collect()
    assert all(abs(r.target - r[2]) <= 37 for r in rows)


def test_empty(no_docs):
    assert token_counts.count_tokens(no_docs, WORDS_FILE).count() == 0
    assert packing.pack(no_docs, BYTES_FILE).count() == 0
    assert quality.judge(no_docs).count() == 0 and quality.clean(no_docs).count() == 0
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0


def test_windows_of_one_task_merge(spark, monkeypatch):
    """One partition of several windows: what the windows leave over is packed together."""
    monkeypatch.setattr(packing, "WINDOW", 50)
    df = spark.range(330, numPartitions=1).selectExpr("id as doc_id", "repeat('a b ', 50) as text")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    rows = packing.pack(df, BYTES_FILE).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    fills = Counter()
    for r in rows:
        fills[r.sequence_id] += r.length
    total = sum(fills.values())
    each = rows[0].length
    assert max(fills.values()) <= 2048 and len(fills) == -(-len(rows) // (2048 // each)) and total == each * 330


def test_names_of_helpers_are_free(spark):
    rows = [(i, f"w{i} " * 30, "a", 1, 2, 3, 4) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, key int, copies int, _key int, nth int")
    out = mixing.mixed(df)
    assert out.columns == df.columns and {tuple(r) for r in out.collect()} <= set(rows)
    odd = df.selectExpr("doc_id", "text", "source", "key AS doc", "copies AS words", "_key AS lines", "nth AS removed")
    assert quality.clean(odd).columns == odd.columns and quality.clean(odd).count() == 0
    more = df.selectExpr("doc_id", "concat('alpha beta gamma delta epsilon zeta eta theta iota kappa ', doc_id) AS text", "source", "key AS doc", "copies AS words", "_key AS lines", "nth AS repeat")
    assert {tuple(r) for r in quality.clean(more).collect()} == {tuple(r) for r in more.collect()}


def test_a_packing_worker_holds_one_tokenizer():
    """The library is loaded only where the rank encoder cannot do it, and a slice of text is small."""
    ids = packing.Ids(BYTES_FILE)
    assert ids.fast is not None and "library" not in vars(ids) and packing.SLICE <= 4 << 20
    ids.fast = None
    assert len(ids.whole("two words")) and "library" in vars(ids)
