"""Findings after detection: normalise, classify, correlate, score, route, compare, report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.coerce import let
from palisade.functions.text import fingerprint, normalize_match, split_words
from palisade.operators.detect.graph import components
from palisade.operators.detect.rules import COMPLIANCE, ORGANIZERS, mapping_table, rules_table
from palisade.operators.sets import scan_diff
from palisade.operators.windows import top_k
from palisade.schemas import FINDINGS
from palisade.session import cut_lineage

# Pairs of detectors that together make a bigger issue.
CHAINS = [
    ("D1", "D21", "credential beside personal data"),
    ("D1", "D22", "credential in redistributable file"),
    ("D2", "D8", "injection with error oracle"),
    ("D2", "D17", "injection near database access"),
    ("D3", "D5", "code execution reachable from the network"),
    ("D4", "D5", "unprotected transport"),
]


def parsed(*outputs: DataFrame) -> DataFrame:
    """One normalised findings table: schema enforced, no scores or opinions added."""
    names = FINDINGS.fieldNames()
    cast = []
    for df in outputs:
        unknown = set(df.columns) - set(names)
        if unknown:
            raise ValueError(f"not findings columns: {sorted(unknown)}")
        cast.append(df.select(*[
            (F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in FINDINGS
        ]))
    return reduce(lambda a, b: a.unionByName(b), cast)


def classify(findings: DataFrame, vectors: DataFrame) -> DataFrame:
    """Attach the vector dimension (at most 300 rows, hence the broadcast)."""
    v = vectors.select(F.col("id").alias("vector_id"), F.col("name").alias("vector"), "family")
    return findings.join(F.broadcast(v), "vector_id", "left")


def organizers(findings: DataFrame) -> DataFrame:
    """Findings per organizer and severity."""
    table = F.broadcast(mapping_table(findings.sparkSession, ORGANIZERS, "organizer"))
    counted = findings.groupBy("detector", "severity").agg(F.count("*").alias("n"))
    return counted.join(table, "detector").groupBy("organizer").agg(F.sum("n").alias("findings"), F.max("severity").alias("worst"))


def compliance(findings: DataFrame) -> DataFrame:
    """Findings per compliance control; a detector may touch several controls."""
    table = F.broadcast(mapping_table(findings.sparkSession, COMPLIANCE, "control"))
    counted = findings.groupBy("detector").agg(F.count("*").alias("n"))
    return counted.join(table, "detector").groupBy("control").agg(F.sum("n").alias("findings"))


def correlate(findings: DataFrame, keys: tuple[str, ...] = ("repo", "path")) -> DataFrame:
    """Second round: files where two detectors of a chain meet.

    Detectors per file are folded into one row first (a set of at most as many
    names as there are detectors), so no pairs of findings are ever formed.
    """
    per_file = findings.groupBy(*keys).agg(F.collect_set("detector").alias("_d"), F.count("*").alias("findings"))
    issues = F.array_compact(F.array(*[
        F.when(F.array_contains("_d", a) & F.array_contains("_d", b), F.lit(issue)) for a, b, issue in CHAINS
    ]))
    return per_file.select(*keys, "findings", F.explode(issues).alias("issue"))


def incremental(files: DataFrame, cache: DataFrame, scan) -> tuple[DataFrame, DataFrame]:
    """(files to scan, findings of all files): only content not in the cache is scanned.

    ``cache`` holds findings plus one row per scanned (repo, path, sha256) with a NULL rule.
    """
    keys = ["repo", "path", "sha256"]
    todo = files.join(cache.select(*keys).distinct(), keys, "left_anti")
    old = cache.where(F.col("rule_id").isNotNull()).join(files.select(*keys).distinct(), keys, "left_semi")
    return todo, old.unionByName(scan(todo), allowMissingColumns=True)


def import_results(results: DataFrame, tool: str, body: str = "value") -> DataFrame:
    """JSON results of an external static tool → findings."""
    shape = "STRUCT<repo: STRING, file: STRING, line: INT, rule: STRING, level: STRING, message: STRING>"
    r = results.select(F.from_json(body, shape).alias("r")).where(F.col("r").isNotNull())
    severity = (
        F.when(F.lower("r.level") == "error", 4).when(F.lower("r.level") == "warning", 3).otherwise(2)
    )
    return r.select(
        F.lit("import").alias("scan_id"), F.col("r.repo").alias("repo"), F.col("r.file").alias("path"), F.col("r.line").alias("line"),
        F.lit(tool).alias("detector"), F.concat(F.lit(tool + "."), F.col("r.rule")).alias("rule_id"), F.lit(0).alias("vector_id"),
        severity.alias("severity"), F.lit("").alias("match"), F.lit(0.5).alias("confidence"),
        F.sha2(F.concat_ws("\u0001", "r.repo", "r.file", F.concat(F.lit(tool + "."), F.col("r.rule")), normalize_match("r.message")), 256).alias("fingerprint"),
        F.create_map(F.lit("message"), F.col("r.message")).alias("attrs"),
    )


SARIF = (
    "STRUCT<runs: ARRAY<STRUCT<tool: STRUCT<driver: STRUCT<name: STRING>>, results: ARRAY<STRUCT<ruleId: STRING, level: STRING, message: STRUCT<text: STRING>, "
    "locations: ARRAY<STRUCT<physicalLocation: STRUCT<artifactLocation: STRUCT<uri: STRING>, region: STRUCT<startLine: INT>>>>>>>>>"
)


def import_sarif(documents: DataFrame, repo: str = "repo", body: str = "content") -> DataFrame:
    """SARIF documents of static tools → findings, one per location of a result, or one without a place; text that is no SARIF gives none."""
    runs = documents.select(F.col(repo).alias("repo"), F.explode(F.from_json(body, SARIF)["runs"]).alias("run"))
    results = runs.select("repo", F.col("run.tool.driver.name").alias("tool"), F.explode("run.results").alias("r"))
    each = results.select("repo", "tool", "r", F.explode_outer("r.locations").alias("l"))
    place = F.col("l.physicalLocation")
    # The default level of a result is a warning.
    severity = F.when(F.col("r.level") == "error", 4).when(F.col("r.level").isin("note", "none"), 2).otherwise(3)
    rule = F.concat_ws(".", F.lower("tool"), "r.ruleId")
    return each.select(
        F.lit("import").alias("scan_id"), "repo", place["artifactLocation"]["uri"].alias("path"), place["region"]["startLine"].alias("line"),
        F.lower("tool").alias("detector"), rule.alias("rule_id"), F.lit(0).alias("vector_id"), severity.alias("severity"), F.lit("").alias("match"),
        F.lit(0.5).alias("confidence"), fingerprint(F.col("repo"), place["artifactLocation"]["uri"], rule, F.col("r.message.text")).alias("fingerprint"),
        F.create_map(F.lit("message"), F.col("r.message.text")).alias("attrs"),
    )


def remediation(findings: DataFrame) -> DataFrame:
    """Remediation and replication text per finding."""
    table = F.broadcast(rules_table(findings.sparkSession).select("rule_id", "fix"))
    return findings.join(table, "rule_id", "left").select(
        "repo", "path", "line", "rule_id",
        F.concat(F.lit("Fix "), F.col("rule_id"), F.lit(": "), F.coalesce("fix", F.lit("Review."))).alias("remediation"),
        F.format_string("Open %s of %s at line %d and look for %s", "path", "repo", "line", "match").alias("replication"),
    )


def exact_duplicates(files: DataFrame, key: str, text: str = "content") -> DataFrame:
    """Groups of identical texts: hash, copies and the copy to scan."""
    return files.groupBy(F.md5(text).alias("hash")).agg(
        F.count("*").alias("copies"), F.min(key).alias("keep")
    ).where(F.col("copies") > 1)


def band_keys(text: Column, n: int, bands: int, rows: int) -> Column:
    """Band keys of a MinHash signature over the hashed n-word shingles of the whole text.

    Permutation i of a shingle's 28-bit hash h is (a·h + b) mod p with p = 2^31-1.
    """
    p = (1 << 31) - 1

    def shingles(words: Column) -> Column:
        # A text shorter than one shingle is its own single shingle.
        count = F.greatest(F.size(words) - (n - 1), F.lit(1))
        return F.array_distinct(F.transform(
            F.sequence(F.lit(1), count),
            lambda i: F.conv(F.substring(F.md5(F.array_join(F.slice(words, i, n), " ")), 1, 7), 16, 10).cast("bigint"),
        ))

    def keys(h: Column) -> Column:
        def minimum(i: int) -> Column:
            a, b = (1103515245 * (i + 1) + 12345) % p, (69069 * (i + 1) + 1) % p
            return F.array_min(F.transform(h, lambda x: (x * F.lit(a) + F.lit(b)) % F.lit(p)))

        return F.array(*[
            F.concat_ws(":", F.lit(str(band)), *[minimum(band * rows + r).cast("string") for r in range(rows)])
            for band in range(bands)
        ])

    return let(let(split_words(text), shingles), keys)


def near_duplicates(files: DataFrame, key: str, text: str = "content", n: int = 3, bands: int = 4, rows: int = 4) -> DataFrame:
    """(key, component): files linked by a common MinHash band, transitively.

    The text is read once and never shuffled: hashes and band keys, a few dozen
    bytes per file, are written and everything after works on them. Exact copies
    are collapsed, and a band key links its files to the smallest of them, so a
    group of any size costs one edge per file and never its pairs.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = cut_lineage(files.select(F.col(key).alias("_key"), F.md5(body).alias("_h"), band_keys(body, n, bands, rows).alias("_bands")))
    # All rows of a hash have the same text, hence the same bands: any copy stands for it.
    reps = cut_lineage(keyed.groupBy("_h").agg(F.min("_key").alias("rep"), F.first("_bands").alias("_bands")))
    banded = reps.select("rep", F.explode("_bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("rep").alias("hub"))
    edges = banded.join(hubs, "band").where(F.col("rep") != F.col("hub")).select(F.col("rep").alias("src"), F.col("hub").alias("dst")).distinct()
    comp = components(edges, reps.select("rep"))
    members = keyed.select("_key", "_h").join(reps.select("_h", "rep"), "_h")
    return members.join(comp, F.col("rep") == F.col("node")).select(F.col("_key").alias(key), "component")


def report(findings: DataFrame, previous: DataFrame, vectors: DataFrame, k: int = 3) -> DataFrame:
    """The final report as rows (section, item, detail, n).

    Sections: signal counts per detector, sub-totals per severity, the k most
    exposed files per repo, and what is new, fixed or persisting since the
    previous scan.
    """
    row = lambda df, section, item, detail, n: df.select(
        F.lit(section).alias("section"), item.cast("string").alias("item"), detail.cast("string").alias("detail"), n.cast("bigint").alias("n")
    )
    # All counts by (detector, rule, vector, severity) come from one small aggregate.
    counts = findings.groupBy("detector", "rule_id", "vector_id", "severity").agg(F.count("*").alias("n"))
    signals = classify(counts, vectors).rollup("detector", "rule_id").agg(F.sum("n").alias("n"), F.max("severity").alias("worst"))
    per_file = findings.groupBy("repo", "path").agg(F.sum("severity").alias("score"), F.count("*").alias("n"))
    worst = top_k(per_file, "repo", [F.desc("score"), F.asc("path")], k)
    delta = scan_diff(findings, previous).groupBy("status").agg(F.count("*").alias("n"))
    sev = counts.groupBy("severity").agg(F.sum("n").alias("n"))
    return reduce(lambda a, b: a.unionByName(b), [
        row(signals, "signals", F.coalesce("detector", F.lit("all")), F.coalesce("rule_id", F.lit("all")), F.col("n")),
        row(sev, "severity", F.col("severity"), F.lit(""), F.col("n")),
        row(worst, "top files", F.col("repo"), F.concat(F.col("place").cast("string"), F.lit(" "), F.col("path")), F.col("score")),
        row(delta, "delta", F.col("status"), F.lit(""), F.col("n")),
    ])
