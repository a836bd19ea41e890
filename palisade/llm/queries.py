"""Registered queries of the corpus operators, with their SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import chat, langid, mixing, neardup, packing, pii, ppm, quality, spelling, token_counts, topk, warc, whitening
from palisade.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir, "doc_id", "text"), tokenizer("word_bpe_49k.json"))


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir, "doc_id", "text"), tokenizer("byte_bpe_50k.json"))


@query
def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir, "doc_id", "text", "lang"))


@query
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold the template's own marks."""
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.read_back(chat.format_turns(given.unionByName(more)))


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find(documents(spark, sf_dir, "doc_id", "text")))


@query
def op6_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(documents(spark, sf_dir, "doc_id", "text"))


@query
def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(documents(spark, sf_dir, "doc_id", "text"))


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir, "doc_id", "text", "source"))


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir, "doc_id", "text", "source")).drop("source", "key")


@query
def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return topk.top_k(rows, rows.where(F.col("vec_id") % 100 == 0))


@query
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir, "doc_id", "text"))


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


@query
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


# SQL twins. Lines and windows meet as text here, as hashes in the operator.
_SPACE = r"[\x20\x09-\x0D]"
ORACLES["op8_quality"] = (
    f"WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents), "
    "win AS (SELECT doc_id, i, w[i : i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)), "
    "twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1), "
    "repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) r(k) GROUP BY 1), "
    "lines AS (SELECT doc_id, source, text, line, trim(regexp_replace(lower(line), '" + _SPACE + "+', ' ', 'g')) AS norm FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d)), "
    "dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE norm <> '' GROUP BY 1), "
    "held AS (SELECT DISTINCT doc_id, source, text, norm, CAST(sum(len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'))) AS BIGINT) AS n FROM lines WHERE norm <> '' GROUP BY 1, 2, 3, 4), "
    "often AS (SELECT source, norm FROM held GROUP BY 1, 2 HAVING count(*) > 20), "
    "frequent AS (SELECT h.* FROM held h JOIN often o ON h.source IS NOT DISTINCT FROM o.source AND h.norm = o.norm), "
    "own AS (SELECT f.doc_id, f.source, f.text FROM (SELECT doc_id, source, text, sum(n) AS n FROM frequent GROUP BY 1, 2, 3) f "
    "JOIN (SELECT doc_id, source, text, sum(n) AS n FROM held GROUP BY 1, 2, 3) a ON a.doc_id = f.doc_id AND a.source IS NOT DISTINCT FROM f.source AND a.text = f.text WHERE a.n - f.n >= 0.3 * a.n), "
    "boiler AS (SELECT f.source, f.norm FROM frequent f JOIN own o ON o.doc_id = f.doc_id AND o.source IS NOT DISTINCT FROM f.source AND o.text = f.text GROUP BY 1, 2 HAVING count(*) > 20), "
    "gone AS (SELECT doc_id, sum(n) AS n FROM frequent f JOIN boiler b ON f.source IS NOT DISTINCT FROM b.source AND f.norm = b.norm GROUP BY 1), "
    "m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, "
    "CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dups.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words, "
    "CAST(coalesce(gone.n, 0) AS BIGINT) AS removed_words FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN gone USING (doc_id)) "
    "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, "
    "NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - removed_words >= 0.3 * n_words AS kept, removed_words FROM m"
)
ORACLES["op10_topk"] = (
    "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings "
    "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), "
    "s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)) "
    "SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 10"
)

# crc32 by half bytes, low half first; the table follows from the polynomial.
_CRC_STEPS = []
for _i in range(16):
    for _ in range(4):
        _i = (_i >> 1) ^ (0xEDB88320 if _i & 1 else 0)
    _CRC_STEPS.append(_i)


def _crc_sql(text: str) -> str:
    half = lambda at: f"strpos('0123456789ABCDEF', substr(hex({text}), CAST({at} AS INTEGER), 1)) - 1"
    return (
        f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(2 * strlen({text})), "
        f"lambda i: CAST({half('i + 2 - 2 * (i % 2)')} AS BIGINT))), "
        f"lambda c, b: xor(c >> 4, ({_CRC_STEPS}::BIGINT[])[(xor(c, b) & 15) + 1])))")


ORACLES["op11_spelling"] = (
    "WITH RECURSIVE r AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL), "
    "l AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, n FROM r), "
    f"h AS (SELECT run, n, {_crc_sql('t')} AS h FROM (SELECT run, n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS t FROM l)), "
    "c AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h), "
    "w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM c WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3), "
    "k AS MATERIALIZED (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM w)), "
    "near AS MATERIALIZED (SELECT a.word, b.word AS near FROM k a JOIN k b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word "
    "UNION SELECT k.word, w.word FROM k JOIN w ON k.rest = w.word UNION SELECT w.word, k.word FROM k JOIN w ON k.rest = w.word), "
    "ranked AS (SELECT near.word, near.near, w.n AS near_n, count(*) OVER (PARTITION BY near.word) AS n_near, "
    "row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, near.near) AS place FROM near JOIN w ON w.word = near.near), "
    "f AS MATERIALIZED (SELECT w.word, CASE WHEN near_n >= 2 * w.n THEN near END AS form, w.n, coalesce(n_near, 0) AS n_near, "
    "CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n FROM w LEFT JOIN ranked ON ranked.word = w.word AND place = 1), "
    "path AS (SELECT word, word AS at FROM f UNION ALL SELECT path.word, f.form FROM path JOIN f ON f.word = path.at WHERE f.form IS NOT NULL) "
    "SELECT f.word, f.form, path.at AS root, f.n, f.n_near, f.form_n FROM f JOIN path ON path.word = f.word JOIN f AS last ON last.word = path.at AND last.form IS NULL"
)
ORACLES["op13_warc"] = (
    "WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), "
    "d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p) "
    "SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to "
    "FROM (SELECT *, payload_bytes >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM d)"
)
