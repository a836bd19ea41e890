"""Corpora, findings and the report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.operators import aggs as A
from palisade.operators import findings as R
from palisade.operators import sketches as SK
from palisade.operators.detect.rules import COMPLIANCE, ORGANIZERS, PACK, pack, scan
from palisade.plans.catalog import ORACLES, findings_ctes, query, sql_text
from palisade.session import cut_lineage, scratch_path
from palisade.sources.files import corpus_layout, describe
from palisade.sources.sinks import report_rows, write_report
from palisade.sources.tables import Tables
from palisade.sources.vectors import vectors
from palisade.streaming.kept_report import KeptReport

ALL = findings_ctes(pack())


def all_findings(t: Tables) -> DataFrame:
    return scan(t.files)


@query(
    "s3_scan_corpus",
    "SELECT repo, path, CAST(strlen(content) AS BIGINT) AS bytes, sha256(content) AS sha256, 'text' AS lang FROM files",
)
def s3(t: Tables) -> DataFrame:
    return describe(t.files).drop("content")


@query(
    "s4_concat_corpus",
    "WITH f AS (SELECT repo, path, CAST(length(content) AS BIGINT) AS chars, md5(content) AS md5 FROM files) "
    "SELECT repo, path, chars, CAST(sum(chars + 1) OVER (PARTITION BY repo ORDER BY path ROWS UNBOUNDED PRECEDING) - chars - 1 AS BIGINT) AS \"offset\", md5 FROM f",
)
def s4(t: Tables) -> DataFrame:
    """Place of every file in its repo's single document, and the hash of what stands there."""
    return corpus_layout(t.files).select("repo", "path", "chars", "offset", "md5")


@query(
    "s9_report_rows",
    f"WITH {ALL} SELECT repo, path, line, rule_id, severity, match FROM findings",
)
def s9(t: Tables) -> DataFrame:
    """Written as partitioned JSON, then read back."""
    path = scratch_path(t.spark, "report")
    found = all_findings(t)
    write_report(found, path, A.summarize(found))
    back = t.spark.read.schema("repo string, path string, line int, rule_id string, severity int, match string").json(f"{path}/signals")
    return back.select("repo", "path", "line", "rule_id", "severity", "match")


@query("s9_signal_json", f"WITH {ALL} SELECT repo, path, rule_id, count(*) AS n FROM findings GROUP BY ALL")
def s9_json(t: Tables) -> DataFrame:
    rows = report_rows(all_findings(t))
    get = lambda k: F.get_json_object("signal", f"$.{k}").alias(k)
    return rows.select("repo", get("path"), get("rule_id")).groupBy("repo", "path", "rule_id").agg(F.count("*").alias("n"))


@query(
    "a3_signal_summary",
    f"WITH {ALL} SELECT detector, severity, count(*) AS signals, count(DISTINCT (repo, path)) AS files, max(line) AS max_line FROM findings GROUP BY 1, 2",
)
def a3(t: Tables) -> DataFrame:
    return A.summarize(all_findings(t))


@query(
    "a4_rollup",
    f"WITH {ALL} SELECT detector, rule_id, count(*) AS n, max(severity) AS worst, CAST(grouping(detector, rule_id) AS BIGINT) AS level FROM findings GROUP BY ROLLUP (detector, rule_id)",
)
def a4_rollup(t: Tables) -> DataFrame:
    return A.report_rollup(all_findings(t))


@query(
    "a4_cube",
    f"WITH {ALL} SELECT repo, severity, count(*) AS n, CAST(grouping(repo, severity) AS BIGINT) AS level FROM findings GROUP BY CUBE (repo, severity)",
)
def a4_cube(t: Tables) -> DataFrame:
    return A.report_cube(all_findings(t))


@query(
    "a4_grouping_sets",
    f"WITH {ALL} SELECT repo, rule_id, count(*) AS n, CAST(grouping(repo, rule_id) AS BIGINT) AS level FROM findings GROUP BY GROUPING SETS ((repo), (rule_id), ())",
)
def a4_sets(t: Tables) -> DataFrame:
    return A.grouping_sets(all_findings(t), [["repo"], ["rule_id"], []], ["repo", "rule_id"])


@query(
    "a5_risk",
    f"WITH {ALL} SELECT repo, CAST(least(100, sum(severity)) AS BIGINT) AS risk, max(severity) AS worst, count(*) AS findings FROM findings GROUP BY repo",
)
def a5(t: Tables) -> DataFrame:
    return A.risk_score(all_findings(t))


@query(
    "a6_dedup",
    f"WITH {ALL} SELECT fingerprint, arg_min(path, (path, line)) AS path, arg_min(line, (path, line)) AS line, min(rule_id) AS rule_id, max(severity) AS severity, "
    "array_to_string(list_sort(list_distinct(list(detector))), ',') AS detectors, count(*) AS occurrences FROM findings GROUP BY fingerprint",
)
def a6(t: Tables) -> DataFrame:
    return A.dedup_findings(all_findings(t))


@query(
    "a7_benchmark",
    f"WITH {ALL}, p AS (SELECT rule_id, repo, count(*) AS n FROM findings GROUP BY 1, 2) SELECT rule_id, count(*) AS repos, "
    "CAST(quantile_cont(n, 0.5) AS DOUBLE) AS median, CAST(quantile_cont(n, 0.9) AS DOUBLE) AS p90 FROM p GROUP BY 1 HAVING count(*) >= 3",
)
def a7(t: Tables) -> DataFrame:
    return A.benchmark(all_findings(t), 3, "salt")


@query(
    "a7_sketches",
    f"WITH {ALL}, p AS (SELECT rule_id, repo, count(*) AS n FROM findings GROUP BY 1, 2) SELECT rule_id, count(*) AS n, "
    "CAST(list_sort(list(n))[CAST(ceil(0.5 * count(*)) AS INTEGER)] AS BIGINT) AS median, CAST(list_sort(list(n))[CAST(ceil(0.9 * count(*)) AS INTEGER)] AS BIGINT) AS p90 FROM p GROUP BY 1",
)
def a7_sketches(t: Tables) -> DataFrame:
    """Findings a repository, per rule: quantiles merged from stored sketches of the repositories' halves."""
    per_repo = all_findings(t).groupBy("rule_id", "repo").agg(F.count("*").alias("n"))
    parts = SK.quantile_sketches(per_repo, F.pmod(F.crc32("repo"), F.lit(2)), "rule_id", F.col("n"))
    return SK.merged_quantiles(parts, "rule_id", {"median": 0.5, "p90": 0.9})


@query(
    "a8_meter",
    "SELECT repo, count(*) AS files, CAST(sum(strlen(content)) AS BIGINT) AS bytes, CAST(sum(length(content) - length(replace(content, chr(10), '')) + 1) AS BIGINT) AS lines, "
    "CAST(sum((length(content) + 3) // 4) AS BIGINT) AS tokens FROM files GROUP BY repo",
)
def a8(t: Tables) -> DataFrame:
    return A.meter(t.files)


@query(
    "a11_eval",
    f"WITH {ALL}, p AS (SELECT DISTINCT CAST(replace(path, '.txt', '') AS BIGINT) AS doc_id FROM findings WHERE detector IN ('D1', 'D21')), "
    "b AS (SELECT l.toxic = 1 AS t, p.doc_id IS NOT NULL AS p FROM labels l LEFT JOIN p USING (doc_id)), "
    "c AS (SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn FROM b) "
    "SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c",
)
def a11(t: Tables) -> DataFrame:
    flagged = scan(t.files, pack("D1", "D21")).select(F.replace("path", F.lit(".txt"), F.lit("")).cast("bigint").alias("doc_id")).distinct()
    truth = t.labels.select("doc_id", (F.col("toxic") == 1).alias("flag"))
    return A.evaluate(flagged.withColumn("flag", F.lit(True)), truth, "doc_id")


@query(
    "r1_parsed",
    f"WITH {findings_ctes(pack(), 'files', 'doc')}, {findings_ctes(pack('D1', 'D21'), '(SELECT * FROM web_files)', 'web')} "
    "SELECT repo, path, line, rule_id, severity, match, fingerprint FROM doc UNION ALL SELECT repo, path, line, rule_id, severity, match, fingerprint FROM web",
)
def r1(t: Tables) -> DataFrame:
    out = R.parsed(all_findings(t), scan(t.web_files, pack("D1", "D21")))
    return out.select("repo", "path", "line", "rule_id", "severity", "match", "fingerprint")


# The cache knows every document that carries a label; all others are new to the scanner.
@query(
    "r2_incremental",
    f"WITH {ALL} SELECT repo, path, line, rule_id, fingerprint FROM findings",
)
def r2(t: Tables) -> DataFrame:
    """Findings of all files, although only uncached content is scanned."""
    files, cache = _cached(t)
    _, found = R.incremental(files, cache, _scan_with_hash)
    return found.select("repo", "path", "line", "rule_id", "fingerprint")


@query("r2_to_scan", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def r2_to_scan(t: Tables) -> DataFrame:
    files, cache = _cached(t)
    todo, _ = R.incremental(files, cache, _scan_with_hash)
    return todo.select(F.replace("path", F.lit(".txt"), F.lit("")).cast("bigint").alias("doc_id"))


def _scan_with_hash(files: DataFrame) -> DataFrame:
    return scan(files.select("repo", "path", "content")).join(files.select("repo", "path", "sha256"), ["repo", "path"])


def _cached(t: Tables) -> tuple[DataFrame, DataFrame]:
    files = t.files.select("repo", "path", "content", F.sha2("content", 256).alias("sha256"))
    seen = t.labels.select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    old = files.join(seen, "path", "left_semi").select("repo", "path", "content", "sha256")
    return files, _scan_with_hash(old).unionByName(old.select("repo", "path", "sha256"), allowMissingColumns=True)


_CHAIN_ARMS = ", ".join(f"({sql_text(a)}, {sql_text(b)}, {sql_text(i)})" for a, b, i in R.CHAINS)


@query(
    "r3_correlate",
    f"WITH {ALL}, f AS (SELECT repo, path, list_distinct(list(detector)) AS d, count(*) AS findings FROM findings GROUP BY 1, 2) "
    f"SELECT repo, path, findings, issue FROM f, (VALUES {_CHAIN_ARMS}) c(a, b, issue) WHERE list_contains(d, a) AND list_contains(d, b)",
)
def r3(t: Tables) -> DataFrame:
    return R.correlate(all_findings(t))


def _mapping(mapping: dict[str, list[str]]) -> str:
    return ", ".join(f"({sql_text(k)}, '{d}')" for k, ds in mapping.items() for d in ds)


@query(
    "r4_organizers",
    f"WITH {ALL} SELECT organizer, count(*) AS findings, max(severity) AS worst FROM findings JOIN (VALUES {_mapping(ORGANIZERS)}) o(organizer, d) ON detector = d GROUP BY 1",
)
def r4(t: Tables) -> DataFrame:
    return R.organizers(all_findings(t))


@query(
    "r5_import",
    "SELECT 'src' || CAST(quality AS STRING) AS repo, CAST(doc_id AS STRING) || '.txt' AS path, 'lint.' || CASE WHEN toxic = 1 THEN 'toxic' ELSE 'style' END AS rule_id, "
    "CASE WHEN toxic = 1 THEN 4 WHEN quality = 1 THEN 2 ELSE 3 END AS severity FROM labels",
)
def r5(t: Tables) -> DataFrame:
    """Results of a static tool, one JSON line per labelled document."""
    level = F.when(F.col("toxic") == 1, "error").when(F.col("quality") == 1, "note").otherwise("warning")
    results = t.labels.select(F.to_json(F.struct(
        F.concat(F.lit("src"), F.col("quality").cast("string")).alias("repo"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"),
        F.lit(1).alias("line"),
        F.when(F.col("toxic") == 1, "toxic").otherwise("style").alias("rule"),
        level.alias("level"),
        F.lit("seen").alias("message"),
    )).alias("value"))
    return R.import_results(results, "lint").select("repo", "path", "rule_id", "severity")


@query(
    "r5_sarif",
    "SELECT 'src' || CAST(quality AS STRING) AS repo, CAST(doc_id AS STRING) || '.txt' AS path, CAST(1 + doc_id % 9 AS INTEGER) AS line, 'probe.' || CASE WHEN toxic = 1 THEN 'toxic' ELSE 'style' END AS rule_id, "
    "CASE WHEN toxic = 1 THEN 4 WHEN quality = 1 THEN 2 ELSE 3 END AS severity FROM labels",
)
def r5_sarif(t: Tables) -> DataFrame:
    """A SARIF document per label, without a level where the default holds."""
    body = (
        "concat('{\"version\":\"2.1.0\",\"runs\":[{\"tool\":{\"driver\":{\"name\":\"Probe\"}},\"results\":[{\"ruleId\":\"', CASE WHEN toxic = 1 THEN 'toxic' ELSE 'style' END, "
        "'\",', CASE WHEN toxic = 1 THEN '\"level\":\"error\",' WHEN quality = 1 THEN '\"level\":\"note\",' ELSE '' END, '\"message\":{\"text\":\"seen\"},\"locations\":[{\"physicalLocation\":"
        "{\"artifactLocation\":{\"uri\":\"', CAST(doc_id AS STRING), '.txt\"},\"region\":{\"startLine\":', CAST(1 + doc_id % 9 AS STRING), '}}}]}]}]}') AS content"
    )
    results = t.labels.selectExpr("concat('src', CAST(quality AS STRING)) AS repo", body)
    return R.import_sarif(results).select("repo", "path", "line", "rule_id", "severity")


_FIXES = ", ".join(f"('{r.rule_id}', {sql_text(r.fix)})" for r in PACK)


@query(
    "r6_remediation",
    f"WITH {ALL} SELECT repo, path, line, f.rule_id, 'Fix ' || f.rule_id || ': ' || fix AS remediation, "
    "'Open ' || path || ' of ' || repo || ' at line ' || CAST(line AS STRING) || ' and look for ' || match AS replication "
    f"FROM findings f JOIN (VALUES {_FIXES}) x(rule_id, fix) ON f.rule_id = x.rule_id",
)
def r6(t: Tables) -> DataFrame:
    return R.remediation(all_findings(t))


@query("r7_exact_dups", "SELECT md5(text) AS hash, count(*) AS copies, min(doc_id) AS keep FROM documents GROUP BY 1 HAVING count(*) > 1")
def r7(t: Tables) -> DataFrame:
    return R.exact_duplicates(t.documents, "doc_id", "text")


@query("r7_near_dups")
def r7_near(t: Tables) -> DataFrame:
    return R.near_duplicates(t.documents, "doc_id", "text")


PREVIOUS_FILES = "(SELECT * FROM files UNION ALL SELECT role AS repo, CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS path, text AS content FROM conversations)"
CURRENT_FILES = (
    "(SELECT source AS repo, CAST(doc_id AS STRING) || '.txt' AS path, text AS content FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) "
    "UNION ALL SELECT * FROM web_files)"
)


@query(
    "r8_report",
    f"WITH {findings_ctes(pack(), CURRENT_FILES, 'findings')}, {findings_ctes(pack(), PREVIOUS_FILES, 'previous')}, "
    "s AS (SELECT repo, path, sum(severity) AS score FROM findings GROUP BY 1, 2), "
    "w AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY score DESC, path) AS place FROM s QUALIFY place <= 3), "
    "d AS (SELECT fingerprint, CASE WHEN sum(b) = 0 THEN 'new' WHEN sum(c) = 0 THEN 'fixed' ELSE 'persisting' END AS status FROM "
    "(SELECT fingerprint, 1 AS c, 0 AS b FROM findings UNION ALL SELECT fingerprint, 0, 1 FROM previous) GROUP BY 1) "
    "SELECT 'signals' AS section, coalesce(detector, 'all') AS item, coalesce(rule_id, 'all') AS detail, count(*) AS n FROM findings GROUP BY ROLLUP (detector, rule_id) UNION ALL "
    "SELECT 'severity', CAST(severity AS STRING), '', count(*) FROM findings GROUP BY severity UNION ALL "
    "SELECT 'top files', repo, CAST(place AS STRING) || ' ' || path, CAST(score AS BIGINT) FROM w UNION ALL "
    "SELECT 'delta', status, '', count(*) FROM d GROUP BY status",
)
def r8(t: Tables) -> DataFrame:
    """The flagship: report on the current estate and what changed since the previous scan."""
    toxic = t.labels.where("toxic = 1").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    current = t.files.join(toxic, "path", "left_anti").select("repo", "path", "content").unionByName(t.web_files)
    chats = t.conversations.select(
        F.col("role").alias("repo"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"), F.col("text").alias("content")
    )
    # The text is read once per scan; the findings, far smaller, are written and read by every section.
    folder = scratch_path(t.spark, "findings")
    scan(current).write.parquet(f"{folder}/current")
    scan(t.files.unionByName(chats)).write.parquet(f"{folder}/previous")
    read = lambda name: t.spark.read.parquet(f"{folder}/{name}")
    return R.report(read("current"), read("previous"), vectors(t.spark))


@query(
    "r9_compliance",
    f"WITH {ALL} SELECT control, count(*) AS findings FROM findings JOIN (VALUES {_mapping(COMPLIANCE)}) o(control, d) ON detector = d GROUP BY 1",
)
def r9(t: Tables) -> DataFrame:
    return R.compliance(all_findings(t))


# The twin of the report that is made at once.
ORACLES["r8_kept"] = ORACLES["r8_report"]


@query("r8_kept")
def r8_kept(t: Tables) -> DataFrame:
    """The same report kept up to date: the previous scan and all documents arrive, then toxic ones go and the pages come."""
    folder, base = scratch_path(t.spark, "changes"), scratch_path(t.spark, "kept")
    signed = lambda df, side, sign: df.select("detector", "rule_id", "severity", "repo", "path", "fingerprint", F.lit(side).alias("side"), F.lit(sign).alias("sign"))
    toxic = t.labels.where("toxic = 1").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path")).distinct()
    chats = t.conversations.select(
        F.col("role").alias("repo"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"), F.col("text").alias("content"))
    found = cut_lineage(scan(t.files))
    arrivals = [
        signed(found, "current", 1).unionByName(signed(found, "previous", 1)).unionByName(signed(scan(chats), "previous", 1)),
        signed(found.join(toxic, "path", "left_semi"), "current", -1).unionByName(signed(scan(t.web_files), "current", 1)),
    ]
    kept = KeptReport(t.spark, base, parts=8)
    for i, rows in enumerate(arrivals):
        rows.write.parquet(f"{folder}/{i}")
        # Each arrival is one run that goes on from the checkpoint of the last.
        kept.run(t.spark.readStream.schema(rows.schema).parquet(f"{folder}/*"))
    return kept.report()
