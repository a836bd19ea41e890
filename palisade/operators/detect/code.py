"""Detectors over source text: rule packs per topic, network literals, artifacts, obfuscation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.lexer import only, text_parts
from palisade.functions.text import entropy, luhn_valid, redact
from palisade.operators.detect.registry import register_detector
from palisade.operators.detect.rules import match_rules, pack, scan
from palisade.sources.files import lines

URL = r"""https?://[^ "'<>\n]+"""
IPV4 = r"(?:[0-9]{1,3}[.]){3}[0-9]{1,3}"
CARD = r"[0-9]{16}"
LONG_TOKEN = r"[A-Za-z0-9+/=_-]{20,}"


def _pack_detector(name: str, code: str):
    @register_detector(name)
    def detect(files: DataFrame) -> DataFrame:
        return scan(files, pack(code))

    detect.__name__ = f"detect_{name}"
    detect.__doc__ = f"Findings of the {code} rules over files(repo, path, content)."
    return detect


detect_secrets = _pack_detector("secrets", "D1")
detect_sql_strings = _pack_detector("sql_strings", "D2")
detect_sinks = _pack_detector("sinks", "D3")
detect_crypto = _pack_detector("crypto", "D4")
detect_network = _pack_detector("network", "D5")
detect_leakage = _pack_detector("leakage", "D8")
detect_licences = _pack_detector("licences", "D22")
detect_logging = _pack_detector("logging", "D25")


def unescape_quotes(files: DataFrame) -> DataFrame:
    """HTML sources: quotes back to characters before the text rules run."""
    return files.withColumn("content", F.replace(F.replace("content", F.lit("&quot;"), F.lit('"')), F.lit("&#39;"), F.lit("'")))


def literals(files: DataFrame, pattern: str, *keys: str, content: str = "content") -> DataFrame:
    """All matches of one pattern: (keys…, value)."""
    return files.select(*keys, F.explode(F.regexp_extract_all(content, F.lit(pattern), F.lit(0))).alias("value"))


def urls(files: DataFrame, *keys: str) -> DataFrame:
    return literals(files.where(F.contains("content", F.lit("://"))), URL, *keys)


def ips(files: DataFrame, *keys: str) -> DataFrame:
    """IPv4 literals with valid octets and whether they are private."""
    found = literals(files, IPV4, *keys).withColumn("_o", F.transform(F.split("value", "[.]"), lambda o: o.cast("int")))
    a, b = F.col("_o")[0], F.col("_o")[1]
    private = (a == 10) | (a == 127) | ((a == 192) & (b == 168)) | ((a == 172) & b.between(16, 31)) | ((a == 169) & (b == 254))
    return found.where(F.forall("_o", lambda o: o <= 255)).select(*keys, "value", private.alias("private"))


def pii(files: DataFrame, *keys: str) -> DataFrame:
    """Addresses, phone numbers, card numbers (Luhn) and IPs: (keys…, kind, value redacted)."""
    rules = {r.rule_id: r.pattern for r in pack("D21")}
    text = F.col("content")

    def tagged(kind, found):
        return F.transform(found, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    none = F.array().cast("array<struct<kind:string,value:string>>")
    all_of = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))
    hits = F.concat(
        F.when(F.contains(text, F.lit("@")), tagged("email", all_of(rules["pii.email"]))).otherwise(none),
        F.when(F.contains(text, F.lit("+1 (")), tagged("phone", all_of(rules["pii.phone"]))).otherwise(none),
        tagged("card", F.filter(all_of(CARD), luhn_valid)),
        tagged("ip", F.filter(all_of(IPV4), lambda v: F.forall(F.split(v, "[.]"), lambda o: o.cast("int") <= 255))),
    )
    return files.select(*keys, F.inline(hits)).select(*keys, "kind", redact("value").alias("value"))


def _long_token(text: Column) -> Column:
    """Whether a text holds a long token; null for null."""

    @F.arrow_udf("boolean")
    def found(column: pa.Array) -> pa.Array:
        return pc.match_substring_regex(column, pattern=LONG_TOKEN)

    return found(text)


def obfuscation(files: DataFrame, *keys: str) -> DataFrame:
    """Per file: highest entropy of a long token, longest line, hidden-code runs, non-ASCII share, score."""
    text = F.col("content")
    chars = F.length(text)
    counted = lambda p: F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0)))
    gated = lambda test, value: F.when(~test, F.lit(0)).otherwise(value)
    # Few texts hold a long token: the others are told on whole Arrow columns, and their entropy and runs of base64 are not looked for.
    long = F.col("_long")
    out = files.withColumn("_long", _long_token(text)).select(
        *keys,
        F.when(~long, F.lit(0.0)).otherwise(
            F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(LONG_TOKEN), F.lit(0)), entropy)), F.lit(0.0))).alias("max_entropy"),
        F.array_max(F.transform(F.split(text, "\n"), F.length)).alias("longest_line"),
        gated(long, counted(r"[A-Za-z0-9+/]{40,}={0,2}")).alias("base64_runs"),
        gated(F.contains(text, F.lit("\\x")), counted(r"([\\]x[0-9a-fA-F]{2}){8,}")).alias("hex_runs"),
        F.when((F.contains(text, F.lit("eval(")) | F.contains(text, F.lit("exec("))) & text.rlike(
            r"(eval|exec)[(][ ]*(atob|base64|unescape|bytes[.]fromhex)"), 1).otherwise(0).alias("eval_decode"),
        # A text with as many bytes as characters is ASCII throughout.
        F.round(F.try_divide(gated(F.octet_length(text) > chars, F.length(F.regexp_replace(text, r"[\x00-\x7F]+", ""))), chars), 6).alias("non_ascii"),
    )
    score = (
        F.when(F.col("max_entropy") > 4.5, 30).otherwise(0)
        + F.when(F.col("longest_line") > 2000, 20).otherwise(0)
        + F.least(F.col("base64_runs"), F.lit(2)) * 10
        + F.least(F.col("hex_runs"), F.lit(2)) * 10
        + F.col("eval_decode") * 30
        + F.when(F.col("non_ascii") > 0.3, 10).otherwise(0)
    )
    return out.withColumn("score", score.cast("int"))


def signature_overlap(files: DataFrame, known: DataFrame, key: str, known_key: str, n: int = 8) -> DataFrame:
    """Share of each known-bad text's n-word shingles found in each file.

    The files' text is read once and never shuffled: only hashed shingles, distinct
    per file, meet the known ones (broadcast at run time if those are few), and
    hits are counted per task. Copies among the known texts are compared once.
    """
    hashed = known.select(known_key, F.md5("content").alias("k"), "content")
    theirs = hashed.groupBy("k").agg(F.first("content").alias("content"))
    bad = word_shingles(theirs, "k", n)
    grams = word_shingles(files, key, n).select(key, "g")
    hits = grams.join(bad, "g").groupBy(key, "k").agg(F.count("*").alias("shared"), F.first("total").alias("total"))
    return hits.join(hashed.select(known_key, "k"), "k").select(
        key, known_key, "shared", F.round(F.col("shared") / F.col("total"), 6).alias("overlap")
    )


def word_shingles(files: DataFrame, key: str, n: int) -> DataFrame:
    """(key, g, total): the distinct n-word shingles of each row's whole text as 64-bit hashes, and how many the row has."""
    src = files.select(F.col(key).alias("_key"), F.col("content").alias("_text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in text_parts(batch.column("_text")):
                owner, found = shingle_hashes(texts, n)
                total = np.bincount(owner, minlength=len(texts))[owner]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_key").slice(done, len(texts)).take(pa.array(owner)), pa.array(found.view(np.int64)), pa.array(total.astype(np.int64))], ["_key", "g", "total"])
                done += len(texts)

    kind = src.schema["_key"].dataType.simpleString()
    return src.mapInArrow(hashed, f"_key {kind}, g bigint, total bigint").withColumnRenamed("_key", key)


def shingle_hashes(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct n-word shingles of each text; words stand between runs of blanks, tabs and line ends."""
    lists = pc.split_pattern_regex(pc.fill_null(texts, ""), r"[ \n\t\r]+")
    words = pc.list_flatten(lists)
    owner = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists), dtype=np.int64))
    full = pc.not_equal(pc.binary_length(words), 0)
    coded = words.filter(full).dictionary_encode()
    owner, m = owner[np.asarray(full)], len(coded) - n + 1
    if m < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = pd.util.hash_array(np.asarray(coded.dictionary.to_pandas(), dtype=object), categorize=False)[np.asarray(coded.indices)]
    # Places count: each has an odd factor of its own, the same in every task.
    factor = np.random.default_rng(16).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    found = np.zeros(m, np.uint64)
    for k in range(n):
        found += word[k : k + m] * factor[k]
    inside = owner[:m] == owner[n - 1 :]
    owner, found = owner[:m][inside], found[inside]
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return owner[first], found[first]


def licences(files: DataFrame) -> DataFrame:
    """Licence phrases as SPDX identifiers, counted per repo."""
    spdx = F.when(F.col("rule_id") == "licence.mit", "MIT").otherwise("Apache-2.0")
    return (
        match_rules(files, pack("D22")).groupBy("repo", spdx.alias("spdx"))
        .agg(F.count("*").alias("n"), F.count_distinct("path").alias("files"))
    )


def db_artifacts(files: DataFrame) -> DataFrame:
    """Connection strings, models, statements and schema changes, every kind that a line holds: (repo, path, line, kind, detail, migration)."""
    text = F.col("text")
    src = lines(files, "repo", "path")
    table = F.regexp_extract("text", r"(?i)create table (?:if not exists )?([A-Za-z0-9_]+)", 1)
    altered = F.regexp_extract("text", r"(?i)alter table ([A-Za-z0-9_]+)", 1)
    migration = F.col("path").rlike(r"(^|/)migrations/")

    def found(kind: str, pattern: str, detail: Column | None = None) -> Column:
        return F.when(text.rlike(pattern), F.struct(F.lit(kind).alias("kind"), (F.lit("") if detail is None else detail).alias("detail")))

    kinds = F.array_compact(F.array(
        found("connection", r"[a-z][a-z0-9+]+://[^ /:@]+:[^ /@]+@[^ /]+"),
        found("create_table", r"(?i)create table ", table),
        found("alter_table", r"(?i)alter table ", altered),
        found("model", r"class [A-Za-z_]+[(](Base|db[.]Model|models[.]Model)[)]"),
        found("statement", r"(?i)(select .* from|insert into|update .* set|delete from) "),
    ))
    return src.select("repo", "path", "line", F.inline(kinds), migration.alias("migration")).select(
        "repo", "path", "line", "kind", "detail", "migration"
    )


def table_columns(files: DataFrame) -> DataFrame:
    """CREATE TABLE statements as (repo, path, table, column, type); types in upper case."""
    stmt = F.regexp_extract_all("content", F.lit(r"(?i)create table (?:if not exists )?[A-Za-z0-9_]+ ?[(][^;]*"), F.lit(0))
    each = files.where(F.contains(F.lower("content"), F.lit("create table"))).select("repo", "path", F.explode(stmt).alias("s"))
    named = each.select(
        "repo", "path",
        F.regexp_extract("s", r"(?i)create table (?:if not exists )?([A-Za-z0-9_]+)", 1).alias("table"),
        F.explode(F.split(F.regexp_extract("s", r"(?s)[(](.*)[)]", 1), ",")).alias("d"),
    )
    return named.select(
        "repo", "path", "table",
        F.regexp_extract("d", r"^\s*([A-Za-z0-9_]+)", 1).alias("column"),
        F.upper(F.regexp_extract("d", r"^\s*[A-Za-z0-9_]+\s+([A-Za-z0-9_]+)", 1)).alias("type"),
    )


def code_endpoints(files: DataFrame) -> DataFrame:
    """API inventory from source: exported route handlers and decorated functions."""
    text = F.col("content")
    handler = files.where(F.col("path").rlike(r"(^|/)route[.](ts|js)$")).select(
        "repo",
        F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace("path", r"/route[.](ts|js)$", ""), r"\[(\w+)\]", "{$1}")).alias("path"),
        F.explode(F.regexp_extract_all(text, F.lit(r"export async function (GET|POST|PUT|PATCH|DELETE)"), F.lit(1))).alias("method"),
    )
    decorated = (
        files.where(F.contains(text, F.lit("@app.route(")))
        .select("repo", F.explode(F.regexp_extract_all(text, F.lit(r"@app[.]route[(][^\n]*"), F.lit(0))).alias("d"))
        .select(
            "repo",
            F.regexp_extract("d", r"""@app[.]route[(]["']([^"']+)["']""", 1).alias("path"),
            F.explode(F.regexp_extract_all(
                F.when(F.contains("d", F.lit("methods=")), F.regexp_extract("d", r"methods=\[([^\]]*)\]", 1)).otherwise("GET"),
                F.lit("[A-Z]+"), F.lit(0))).alias("method"),
        )
    )
    return handler.unionByName(decorated)


def import_edges(files: DataFrame) -> DataFrame:
    """Import statements as edges (repo, src file, dst module)."""
    src = lines(files.where(F.contains("content", F.lit("import"))), "repo", "path")
    dst = F.coalesce(
        F.nullif(F.regexp_extract("text", r"^from ([A-Za-z0-9_.]+) import ", 1), F.lit("")),
        F.nullif(F.regexp_extract("text", r"""^import .* from ["']([^"']+)["']""", 1), F.lit("")),
        F.nullif(F.regexp_extract("text", r"^import ([A-Za-z0-9_.]+)\s*$", 1), F.lit("")),
    )
    return src.select("repo", F.col("path").alias("src"), dst.alias("dst"), F.lit("import").alias("kind")).where(F.col("dst").isNotNull())


def call_counts(files: DataFrame) -> DataFrame:
    """Dynamic calls and function heads per Python file, counted on whole Arrow columns; strings and comments do not count."""

    @F.arrow_udf("struct<dynamic_calls: int, functions: int>")
    def count(content: pa.Array) -> pa.Array:
        # A name before the call, as in obj.eval( or my_exec(, is another function.
        calls = pc.count_substring_regex(content, r"(?:^|[^A-Za-z0-9_.])(?:eval|exec)[(]")
        heads = pc.count_substring_regex(content, r"(?m)^[ \t]*(?:async[ ]+)?def[ ]+[A-Za-z_]")
        return pa.StructArray.from_arrays([calls.cast(pa.int32()), heads.cast(pa.int32())], ["dynamic_calls", "functions"])

    return files.where(F.col("path").endswith(".py")).select("repo", "path", count(only("code", F.col("content"), F.col("path"))).alias("c")).select("repo", "path", "c.*")
