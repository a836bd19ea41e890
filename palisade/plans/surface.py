"""The extension surface."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions import surface as U
from palisade.operators.detect import code as D
from palisade.operators.detect.registry import register_detector, run_detectors
from palisade.operators.detect.rules import Rule, pack, scan
from palisade.plans.catalog import findings_ctes, query, sql_text
from palisade.sources.tables import Tables

# A user's rule: forty hexadecimal digits, as in access tokens.
HEX_TOKEN = Rule("user.hex_token", "X1", 127, 3, "[0-9a-f]{40}", "a" * 40)


@register_detector("user_tokens")
def user_tokens(files: DataFrame) -> DataFrame:
    return scan(files, [HEX_TOKEN])


@query(
    "x1_custom_rule",
    f"WITH {findings_ctes([HEX_TOKEN], 'files', 'mine')}, {findings_ctes(pack('D1'), 'files', 'own')} SELECT path, line, rule_id, match FROM mine UNION ALL SELECT path, line, rule_id, match FROM own",
)
def x1(t: Tables) -> DataFrame:
    return run_detectors(t.files, ["user_tokens", "secrets"]).select("path", "line", "rule_id", "match")


@query(
    "x2_pandas_udf",
    "SELECT repo, path, CAST(len(regexp_extract_all(content, '(?:^|[^A-Za-z0-9_.])(?:eval|exec)[(]')) AS INTEGER) AS dynamic_calls, "
    "CAST(len(regexp_extract_all(content, '(?:^|\\n)[ \\t]*(?:async[ ]+)?def[ ]+[A-Za-z_]')) AS INTEGER) AS functions FROM code_files WHERE path LIKE '%.py'",
)
def x2(t: Tables) -> DataFrame:
    return D.call_counts(t.code_files)


_X3 = " UNION ALL ".join(
    f"SELECT doc_id, '{r.rule_id}' AS rule_id, unnest(regexp_extract_all(text, {sql_text(r.pattern)}, 0)) AS match FROM documents"
    for r in pack("D1", "D21") if not r.check
)


@query("x3_udtf", _X3)
def x3(t: Tables) -> DataFrame:
    t.spark.udtf.register("finding_rows", U.finding_rows())
    # The gate of the function's own rules keeps documents without any candidate away from it.
    U.finding_candidates(t.documents.select("doc_id", "text"), "text").createOrReplaceTempView("x3_documents")
    return t.spark.sql("SELECT d.doc_id, f.rule_id, f.match FROM x3_documents d, LATERAL finding_rows(d.text) f")


@query(
    "x4_udaf",
    f"WITH {findings_ctes(pack())}, s AS (SELECT repo, severity, count(*) AS n FROM findings GROUP BY 1, 2) "
    "SELECT repo, round(100 * (1 - product(pow(1 - severity / 50.0, n))), 6) AS risk FROM s GROUP BY repo",
)
def x4(t: Tables) -> DataFrame:
    return U.risk_by(scan(t.files))


@query(
    "x5_sql_function",
    "SELECT substr(c_name, 1, 4) || '***' AS name, CASE WHEN c_nationkey >= 5 THEN 'critical' WHEN c_nationkey = 4 THEN 'high' WHEN c_nationkey = 3 THEN 'medium' WHEN c_nationkey = 2 THEN 'low' ELSE 'info' END AS level, count(*) AS n FROM customer GROUP BY 1, 2",
)
def x5(t: Tables) -> DataFrame:
    U.register_sql_functions(t.spark)
    U.register_views({"x5_customer": t.customer})
    return t.spark.sql("SELECT redact(c_name) AS name, severity_name(c_nationkey) AS level, count(*) AS n FROM x5_customer GROUP BY 1, 2")
