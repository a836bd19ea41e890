"""The pipeline's stages against what each of them promises."""

from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline
import pytest

from palisade.llm import mixing, neardup, pii, quality


@pytest.fixture(scope="module")
def stages(spark, sf, docs):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf).cache())
    return out


def test_columns(stages):
    for df in stages[1:-1]:
        assert tuple(df.columns) == corpus_pipeline.COLUMNS


def test_stages_do_what_their_operators_say(spark, stages):
    docs, kept, single, clean, mixed, packed = stages
    judged = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, k in judged.items() if k}
    classes = {r.doc_id: r.class_id for r in neardup.classes(kept).collect()}
    assert Counter(r.doc_id for r in single.collect()) == Counter(set(classes.values()))
    texts = {r.doc_id: r.text for r in single.collect()}
    assert {r.doc_id for r in clean.collect()} == set(texts)
    for r in clean.collect():
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)
        assert (r.text == texts[r.doc_id]) == (not pii.base_spans(texts[r.doc_id]))
    copies = {r.doc_id: r.copies for r in mixing.mix(clean).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in copies.items() if n})
    pieces = defaultdict(int)
    for r in packed.collect():
        pieces[r.doc_id] += r.piece == 0
    assert pieces == {i: n for i, n in copies.items() if n}


def test_run(spark, sf, stages):
    assert corpus_pipeline.run(spark, sf).count() == stages[-1].count()


def test_empty_table(spark, sf, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == 0


def test_odd_and_repeated_rows_beside_copies_of_clean_documents(spark, sf, odd):
    """Null texts, repeated rows and a host of copies: of every clean text one document reaches the mix."""
    clean = [" ".join(f"{w}{i}x{k}" for k, w in enumerate(["amber", "birch", "cedar", "delta", "ember", "fjord"] * 6)) for i in range(4)]
    rows = [(1000 + 50 * i + j, text, "en", "host", len(text)) for i, text in enumerate(clean) for j in range(30)]
    rows += rows[:3] + [(None, clean[3], None, None, None), (None, None, None, None, None), (7, None, "en", "host", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").unionByName(odd.select(*corpus_pipeline.COLUMNS))
    (_, rules), (_, dedup) = corpus_pipeline.STAGES[:2]
    kept = rules(spark, docs, sf).cache()
    assert {r.text for r in kept.collect()} >= set(clean) and kept.where("text IS NULL").count() == 0
    single = [r for r in dedup(spark, kept, sf).collect() if r.text in clean]
    assert sorted(r.doc_id for r in single) == [1000, 1050, 1100, 1150]
    # All stages take the table as it is.
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() > 0


def test_texts_go_to_python_in_small_batches(spark):
    import pyarrow as pa

    import corpus_pipeline

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    docs = spark.createDataFrame([(i, f"{i} word " * 2000, "en", "s", 1) for i in range(800)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
    try:
        spark.conf.unset(name)
        corpus_pipeline.quality_stage(spark, docs, "")
        met = [r.n for r in docs.select("text").mapInArrow(sizes, "n long").collect()]
        assert max(met) < 3 << 20 < sum(met)
        spark.conf.set(name, "1000000")
        corpus_pipeline.quality_stage(spark, docs, "")
        assert spark.conf.get(name) == "1000000"
    finally:
        spark.conf.unset(name)
        if before is not None:
            spark.conf.set(name, before)
