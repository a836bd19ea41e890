"""Rule packs, literals, traffic, dependencies, specs and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions.text import host
from palisade.operators.detect import code as D
from palisade.operators.detect import deps as P
from palisade.operators.detect import graph as G
from palisade.operators.detect import traffic as N
from palisade.operators.detect.rules import in_code, match_rules, pack, scan
from palisade.operators.detect.spans import shared_passages
from palisade.operators.findings import classify
from palisade.operators.joins import constraint_drift, drift, lookup
from palisade.operators.sets import append
from palisade.operators.windows import outliers
from palisade.plans.catalog import LINES, ORACLES, findings_ctes, matches_sql, query, sql_text
from palisade.sources import specs as S
from palisade.sources.scanner_log import read_scanner_log
from palisade.sources.tables import Tables
from palisade.sources.vectors import coverage_sql, vectors
from palisade.sources.yaml_rows import text_lines, yaml_rows

COLUMNS = ["repo", "path", "line", "rule_id", "severity", "match", "fingerprint"]
_COLS = ", ".join(COLUMNS)


def findings_sql(*detectors: str, src: str = "files") -> str:
    return f"WITH {findings_ctes(pack(*detectors), src)} SELECT {_COLS} FROM findings"


@query(
    "j8_rule_match",
    f"WITH lines AS MATERIALIZED ({LINES.format(src='files')}) SELECT repo, path, line, rule_id, count(*) AS n "
    f"FROM ({matches_sql(pack(), checked=False)}) GROUP BY ALL",
)
def j8(t: Tables) -> DataFrame:
    return match_rules(t.files, pack(), checked=False).groupBy("repo", "path", "line", "rule_id").agg(F.count("*").alias("n"))


@query(
    "j12_classify",
    f"WITH {findings_ctes(pack('D1'))} SELECT vector_id, 'vector ' || CAST(vector_id AS STRING) AS vector, {coverage_sql('vector_id')} AS family, count(*) AS n FROM findings GROUP BY 1, 2, 3",
)
def j12(t: Tables) -> DataFrame:
    found = classify(D.detect_secrets(t.files), vectors(t.spark))
    return found.groupBy("vector_id", "vector", "family").agg(F.count("*").alias("n"))


@query(
    "s7_vectors",
    f"WITH {findings_ctes(pack())}, c AS (SELECT vector_id, count(*) AS n FROM findings GROUP BY 1) "
    f"SELECT CAST(id AS INTEGER) AS id, {coverage_sql()} AS family, coalesce(n, 0) AS signals FROM range(1, 301) r(id) LEFT JOIN c ON id = vector_id",
)
def s7(t: Tables) -> DataFrame:
    """The whole dimension with the signals of every vector in the documents."""
    counts = scan(t.files).groupBy("vector_id").agg(F.count("*").alias("n"))
    return vectors(t.spark).join(counts, F.col("id") == F.col("vector_id"), "left").select(
        "id", "family", F.coalesce("n", F.lit(0)).alias("signals")
    )


@query("d1_secrets", findings_sql("D1"))
def d1(t: Tables) -> DataFrame:
    return D.detect_secrets(t.files).select(*COLUMNS)


_UNESCAPED = "(SELECT regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS repo, CAST(page_id AS STRING) || '.html' AS path, replace(replace(html, '&quot;', chr(34)), '&#39;', chr(39)) AS content FROM pages)"


@query("d1_secrets_html", findings_sql("D1", src=_UNESCAPED))
def d1_html(t: Tables) -> DataFrame:
    return D.detect_secrets(D.unescape_quotes(t.web_files)).select(*COLUMNS)


@query("d2_sql_concat", findings_sql("D2", src="code_files"))
def d2(t: Tables) -> DataFrame:
    return D.detect_sql_strings(t.code_files).select(*COLUMNS)


_BOTH = "(SELECT * FROM code_files UNION ALL SELECT * FROM web_files)"


@query("d3_sinks", findings_sql("D3", src=_BOTH))
def d3(t: Tables) -> DataFrame:
    return D.detect_sinks(append(t.code_files, t.web_files)).select(*COLUMNS)


@query("d4_crypto", findings_sql("D4", src="code_files"))
def d4(t: Tables) -> DataFrame:
    return D.detect_crypto(t.code_files).select(*COLUMNS)


@query("d5_network", findings_sql("D5", src=_BOTH))
def d5(t: Tables) -> DataFrame:
    return D.detect_network(append(t.code_files, t.web_files)).select(*COLUMNS)


@query(
    "d5_urls",
    f"SELECT 'documents' AS src, doc_id AS id, unnest(regexp_extract_all(text, {sql_text(D.URL)}, 0)) AS value FROM documents UNION ALL "
    f"SELECT 'pages', page_id, unnest(regexp_extract_all(url || ' ' || html, {sql_text(D.URL)}, 0)) FROM pages",
)
def d5_urls(t: Tables) -> DataFrame:
    docs = t.documents.select(F.lit("documents").alias("src"), F.col("doc_id").alias("id"), F.col("text").alias("content"))
    web = t.pages.select(F.lit("pages").alias("src"), F.col("page_id").alias("id"), F.concat_ws(" ", "url", "html").alias("content"))
    return D.urls(append(docs, web), "src", "id")


_IPS = f"unnest(regexp_extract_all(text, {sql_text(D.IPV4)}, 0)) AS value"
_OCTETS = "list_transform(string_split(value, '.'), lambda x: CAST(x AS INTEGER))"


@query(
    "d5_ips",
    f"WITH v AS (SELECT 'documents' AS src, doc_id AS id, {_IPS} FROM documents UNION ALL SELECT 'pages', page_id, {_IPS} FROM (SELECT page_id, html AS text FROM pages)), "
    f"o AS (SELECT *, {_OCTETS} AS o FROM v) "
    "SELECT src, id, value, o[1] IN (10, 127) OR (o[1] = 192 AND o[2] = 168) OR (o[1] = 172 AND o[2] BETWEEN 16 AND 31) OR (o[1] = 169 AND o[2] = 254) AS private "
    "FROM o WHERE list_max(o) <= 255",
)
def d5_ips(t: Tables) -> DataFrame:
    docs = t.documents.select(F.lit("documents").alias("src"), F.col("doc_id").alias("id"), F.col("text").alias("content"))
    web = t.pages.select(F.lit("pages").alias("src"), F.col("page_id").alias("id"), F.col("html").alias("content"))
    return D.ips(append(docs, web), "src", "id")


@query(
    "d6_sqli",
    "SELECT req_id, CASE WHEN event_type = 'error' AND (value < 40 OR event_id = events.user_id) THEN 'boolean' WHEN event_type = 'signup' AND value < 40 THEN 'union' "
    "WHEN event_type = 'signup' THEN 'time' WHEN event_type = 'purchase' AND value >= 20 AND value < 40 THEN 'quote' END AS class "
    "FROM payloads JOIN events ON req_id = event_id",
)
def d6(t: Tables) -> DataFrame:
    return t.payloads.select("req_id", N.sqli_class(F.col("query")).alias("class"))


_PLAIN = "url_decode(url_decode(url_decode(url_decode(query))))"


@query(
    "d6_hidden",
    f"WITH t AS (SELECT req_id, regexp_replace(regexp_replace({_PLAIN}, '/\\*![0-9]*((?:.|\\n)*?)\\*/', ' \\1 ', 'g'), '/\\*(?:.|\\n)*?\\*/', ' ', 'g') AS q FROM hidden_payloads) "
    "SELECT req_id, CASE WHEN regexp_matches(q, '(?i)union([ ]+all)?[ ]+select') THEN 'union' WHEN regexp_matches(q, '(?i)(sleep|benchmark|randomblob)[ ]*[(]') THEN 'time' "
    "WHEN contains(q, chr(39)) THEN 'quote' END AS class FROM t",
)
def d6_hidden(t: Tables) -> DataFrame:
    """Injections behind comments and several layers of encoding."""
    return t.hidden_payloads.select("req_id", N.sqli_class(F.col("query")).alias("class"))


@query(
    "d7_url_payload",
    "SELECT 'request' AS src, event_id AS id, CASE WHEN event_type = 'click' AND value < 40 THEN 'traversal' WHEN event_type = 'click' THEN 'parameter_pollution' ELSE 'ssrf' END AS kind "
    "FROM events WHERE event_type = 'click' OR (event_type = 'purchase' AND value < 20) UNION ALL "
    "SELECT 'request', event_id, 'redirect' FROM events WHERE event_type = 'purchase' AND value < 20 UNION ALL "
    "SELECT 'page', page_id, 'redirect' FROM pages WHERE regexp_matches(url, '(?i)[?&](next|url|redirect|return)=https?://')",
)
def d7(t: Tables) -> DataFrame:
    requests = t.payloads.select(F.lit("request").alias("src"), F.col("req_id").alias("id"), F.col("query").alias("q"))
    web = t.pages.select(
        F.lit("page").alias("src"), F.col("page_id").alias("id"), F.regexp_extract("url", r"[?]([^#]*)", 1).alias("q")
    )
    return N.payload_flags(append(requests, web), "q", "src", "id")


@query("d7_verb_tampering", "SELECT event_id, event_type AS method FROM events WHERE upper(event_type) NOT IN ('VIEW', 'CLICK', 'PURCHASE')")
def d7_verbs(t: Tables) -> DataFrame:
    asked = t.events.select("event_id", F.col("event_type").alias("method"))
    return N.verb_tampering(asked, ("VIEW", "CLICK", "PURCHASE"))


@query(
    "d8_error_rate",
    "SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS rate FROM events GROUP BY 1 HAVING rate >= 0.2",
)
def d8(t: Tables) -> DataFrame:
    return N.error_rate(t.events, F.col("user_id"), "user_id", F.col("event_type") == "error", 0.2)


@query("d8_leaks", findings_sql("D8", src="code_files"))
def d8_leaks(t: Tables) -> DataFrame:
    return D.detect_leakage(t.code_files).select(*COLUMNS)


@query("d9_foreign_access", "SELECT event_id, user_id, o_custkey AS owner FROM events JOIN orders ON event_id = o_orderkey WHERE user_id <> o_custkey")
def d9(t: Tables) -> DataFrame:
    asked = t.events.select("event_id", "user_id")
    return N.foreign_access(asked, "event_id", "user_id", t.orders, "o_orderkey", "o_custkey")


@query(
    "d9_cross_tenant",
    "SELECT event_id, user_id, o_custkey AS owner, a.c_nationkey AS tenant, b.c_nationkey AS owner_tenant FROM events JOIN orders ON event_id = o_orderkey "
    "JOIN customer a ON a.c_custkey = user_id JOIN customer b ON b.c_custkey = o_custkey WHERE user_id <> o_custkey AND a.c_nationkey <> b.c_nationkey",
)
def d9_tenant(t: Tables) -> DataFrame:
    """Nations as tenants: users at orders of another nation's customers."""
    return N.cross_tenant(t.events.select("event_id", "user_id"), "event_id", "user_id", t.orders, "o_orderkey", "o_custkey", t.customer, "c_custkey", "c_nationkey")


@query("d10_mass_assign", "SELECT event_id, unnest(list_filter(json_keys(props), lambda k: k NOT IN ('name', 'role'))) AS key FROM events")
def d10(t: Tables) -> DataFrame:
    return N.mass_assignment(t.events, ["name", "role"], "props", "event_id")


@query(
    "d11_bruteforce",
    "WITH b AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n "
    "FROM events WHERE event_type = 'error') SELECT user_id, count(*) AS alarms, max(n) AS peak, min(event_id) AS first_event FROM b WHERE n >= 2 GROUP BY 1",
)
def d11(t: Tables) -> DataFrame:
    return N.bruteforce(t.events_utc, 2, 3_600_000_000)


@query(
    "d11_spraying",
    "SELECT json_extract_string(props, '$.k') AS source, count(*) AS failures, count(DISTINCT user_id) AS users FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(DISTINCT user_id) >= 20",
)
def d11_spraying(t: Tables) -> DataFrame:
    return N.spraying(t.events, F.get_json_object("props", "$.k"), F.col("event_type") == "error", 20)


@query(
    "d11_takeover",
    "WITH f AS (SELECT a.user_id, a.event_id, min(epoch_us(b.ts) - epoch_us(a.ts)) AS gap FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' "
    "AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR GROUP BY 1, 2) SELECT user_id, count(*) AS failures, min(gap) AS fastest_us FROM f GROUP BY 1",
)
def d11_takeover(t: Tables) -> DataFrame:
    return N.takeovers(t.events_utc, 3_600_000_000)


_ASK = r"TRY_CAST(nullif(regexp_extract(raw_id, '^\s*([+-]?[0-9]+)', 1), '') AS BIGINT)"


@query(
    "d9_forced_browsing",
    f"WITH l AS (SELECT user_id, {_ASK} IS NOT NULL AND {_ASK} NOT IN (SELECT c_custkey FROM customer) AS miss FROM requests) "
    "SELECT user_id, count(*) AS total, count(*) FILTER (miss) AS errors, round(count(*) FILTER (miss) / count(*), 6) AS rate FROM l GROUP BY 1 HAVING rate >= 0.5",
)
def d9_browsing(t: Tables) -> DataFrame:
    """Users most of whose lookups end in 404."""
    seen = lookup(t.requests, t.users)
    return N.error_rate(seen, F.col("user_id"), "user_id", F.col("status") == 404, 0.5)


_HOST = "regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)"


@query(
    "d12_host_entropy",
    f"WITH h AS (SELECT {_HOST} AS host, count(*) AS n FROM pages GROUP BY 1), l AS (SELECT host, n, unnest(string_split(host, '.')) AS label FROM h) "
    "SELECT host, any_value(n) AS n, arg_max(label, (length(label), label)) AS label, round(list_entropy(string_split(arg_max(label, (length(label), label)), '')), 4) AS entropy FROM l GROUP BY host",
)
def d12(t: Tables) -> DataFrame:
    return N.host_entropy(t.pages)


@query(
    "d11_stuffing",
    "WITH e AS (SELECT json_extract_string(props, '$.k') AS source, user_id, event_type = 'error' AS failed FROM events), "
    "s AS (SELECT source, count(*) FILTER (failed) AS failures, count(DISTINCT user_id) FILTER (failed) AS users, count(DISTINCT user_id) FILTER (NOT failed) AS entered FROM e WHERE source IS NOT NULL GROUP BY 1) "
    "SELECT * FROM s WHERE failures >= 0.011 * (SELECT sum(failures) FROM s) AND users >= 10 AND failures <= 1.5 * users",
)
def d11_stuffing(t: Tables) -> DataFrame:
    return N.stuffing(t.events, F.get_json_object("props", "$.k"), F.col("event_type") == "error", 0.011, 10, 1.5)


_BEAT = (
    "WITH w AS (SELECT user_id, epoch_us(ts) // 3600000000 AS b FROM events), x AS (SELECT user_id, b + d AS b, CAST(sum(k) AS BIGINT) AS c FROM w, (VALUES (-1, 1), (0, 2), (1, 1)) v(d, k) GROUP BY 1, 2), "
    "s AS (SELECT user_id, sum(c) AS s, sum(c * c) AS q, max(b) - min(b) + 1 AS n FROM x GROUP BY 1), "
    "p AS (SELECT a.user_id, b.b - a.b AS lag, sum(a.c * b.c) AS p FROM x a JOIN x b ON a.user_id = b.user_id AND b.b - a.b BETWEEN 3 AND 48 GROUP BY 1, 2), "
    "r AS (SELECT user_id, CAST(s // 4 AS BIGINT) AS events, lag, round((p * n / (n - lag) - s * s / n) / (q - s * s / n), 6) AS strength FROM p JOIN s USING (user_id) WHERE 3 * lag <= n AND q > s * s / n), "
    "beat AS (SELECT user_id, events, CAST(lag AS INTEGER) AS lag, strength FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY strength DESC, lag) = 1) "
)


def beat(t: Tables) -> DataFrame:
    return N.periodicity(t.events_utc, "user_id", "ts", 3_600_000_000, 48)


@query("d12_periodicity", _BEAT + "SELECT * FROM beat")
def d12_periodicity(t: Tables) -> DataFrame:
    return beat(t)


@query(
    "d12_exfiltration",
    _BEAT + f", l AS (SELECT page_id AS user_id, unnest(string_split({_HOST}, '.')) AS label FROM pages), h AS (SELECT user_id, round(list_entropy(string_split(arg_max(label, (length(label), label)), '')), 4) AS entropy FROM l GROUP BY 1), "
    "m AS (SELECT user_id, avg(value) AS mean, stddev(value) AS sd FROM events GROUP BY 1), z AS (SELECT user_id, count(*) AS spikes FROM events JOIN m USING (user_id) WHERE round((value - mean) / nullif(sd, 0), 4) > 2.0 GROUP BY 1) "
    "SELECT user_id, strength, coalesce(spikes, 0) AS spikes, coalesce(entropy, 0.0) AS entropy, round(50 * greatest(strength, 0.0) + 10 * least(coalesce(spikes, 0), 3) + 5 * least(coalesce(entropy, 0.0), 4.0), 5) AS score "
    "FROM beat LEFT JOIN z USING (user_id) LEFT JOIN h USING (user_id)",
)
def d12_exfiltration(t: Tables) -> DataFrame:
    """Beat and volumes of each user, and the host of the page with the user's number."""
    hosts = t.pages.select("page_id", F.concat(F.lit("x://"), host("url"), F.lit("/"), F.col("page_id").cast("string")).alias("url"))
    entropy = N.host_entropy(hosts).select("host", "entropy")
    contacted = t.pages.select(F.col("page_id").alias("user_id"), host("url").alias("host")).join(entropy, "host")
    return N.exfiltration(beat(t), outliers(t.events, "user_id", "value", 2.0), contacted, "user_id")


_PRINTS = (
    "{name}_w AS (SELECT {key}, regexp_extract_all(lower(text), '[A-Za-z0-9À-ÿ]+') AS w FROM {table}), "
    "{name}_h AS (SELECT {key}, list_transform(range(len(w) - 4), lambda i: md5(array_to_string(w[i + 1 : i + 5], ' '))) AS h FROM {name}_w WHERE len(w) >= 8), "
    "{name}_s AS (SELECT {key}, h, unnest(range(len(h) - 3)) AS s FROM {name}_h), "
    "{name} AS (SELECT DISTINCT {key}, list_min(list_transform(range(4), lambda i: {{'hash': h[s + i + 1], 'back': -(s + i)}})) AS k FROM {name}_s)"
)


@query(
    "d16_spans",
    "WITH " + _PRINTS.format(name="mine", key="doc_id", table="documents") + ", " + _PRINTS.format(name="theirs", key="item_id", table="benchmark")
    + ", met AS (SELECT doc_id, item_id, -a.k.back AS place, -b.k.back AS there FROM mine a JOIN theirs b ON a.k.hash = b.k.hash), "
    "runs AS (SELECT *, there - place AS d, CASE WHEN place - lag(place) OVER w > 9 THEN 1 ELSE 0 END AS s FROM met WINDOW w AS (PARTITION BY doc_id, item_id, there - place ORDER BY place)), "
    "r AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, item_id, d ORDER BY place) AS r FROM runs) "
    "SELECT doc_id, item_id, CAST(min(place) AS INTEGER) AS start, CAST(max(place) + 5 AS INTEGER) AS end, CAST(min(there) AS INTEGER) AS known_start, count(*) AS marks FROM r GROUP BY doc_id, item_id, d, r.r HAVING max(place) + 5 - min(place) >= 12",
)
def d16_spans(t: Tables) -> DataFrame:
    """Passages of the benchmark texts in the documents."""
    return shared_passages(t.documents, t.benchmark, "doc_id", "item_id")


_DEPS = (
    "WITH d AS (SELECT p_brand AS repo, CAST(p_partkey AS STRING) AS module, p_type, replace(p_name, ' ', '-') AS n, CAST(p_size AS STRING) AS s FROM part) "
    "SELECT repo, 'requirements.txt' AS manifest, module, 'pip' AS ecosystem, n AS name, '==' || s || '.0' AS spec, s || '.0' AS version, 'runtime' AS scope FROM d WHERE p_type = 'ECONOMY' UNION ALL "
    "SELECT repo, 'requirements.txt', module, 'pip', 'base', '>=1.0', '1.0', 'runtime' FROM d WHERE p_type = 'ECONOMY' UNION ALL "
    "SELECT repo, 'package.json', module, 'npm', n, '^' || s, s, 'runtime' FROM d WHERE p_type = 'STANDARD' UNION ALL "
    "SELECT repo, 'package.json', module, 'npm', 'lint', '9.0.1', '9.0.1', 'dev' FROM d WHERE p_type = 'STANDARD' UNION ALL "
    "SELECT repo, 'Dockerfile', module, 'docker', n, s || '-slim', s, 'build' FROM d WHERE p_type = 'PROMO' UNION ALL "
    "SELECT repo, 'pom.xml', module, 'maven', 'org.acme:' || n, s || '.1', s || '.1', 'runtime' FROM d WHERE p_type = 'SMALL' UNION ALL "
    "SELECT repo, 'go.mod', module, 'go', 'example.org/' || n, 'v' || s || '.2.0', s || '.2.0', 'runtime' FROM d WHERE p_type NOT IN ('ECONOMY', 'STANDARD', 'PROMO', 'SMALL')"
)


@query("d13_dependencies", _DEPS)
def d13(t: Tables) -> DataFrame:
    return P.dependencies(t.manifests)


_ADVISED = "SELECT replace(p_name, ' ', '-') AS name, max(p_size) AS fixed FROM part WHERE p_type = 'PROMO' GROUP BY 1"


@query(
    "d14_risk_signals",
    f"WITH d AS ({_DEPS}) SELECT module, name, 'range' AS signal FROM d WHERE spec LIKE '^%' OR spec LIKE '>%' UNION ALL "
    "SELECT module, name, 'private_name' FROM d WHERE name IN (SELECT replace(p_name, ' ', '-') FROM part WHERE p_type = 'SMALL') UNION ALL "
    f"SELECT module, d.name, 'advisory' FROM d JOIN ({_ADVISED}) a ON a.name = d.name WHERE CAST(string_split(version, '.')[1] AS INTEGER) < a.fixed",
)
def d14(t: Tables) -> DataFrame:
    """Internal names are those of Maven modules; advisories cover images below their newest tag."""
    plain = F.replace(F.col("p_name"), F.lit(" "), F.lit("-")).alias("name")
    internal = t.part.where("p_type = 'SMALL'").select(plain)
    advisories = t.part.where("p_type = 'PROMO'").select(plain, "p_size").groupBy("name").agg(F.max("p_size").cast("string").alias("fixed"))
    return P.risk_signals(P.dependencies(t.manifests), internal, advisories).select("module", "name", "signal")


@query("d14_missing_locks", "SELECT p_brand AS repo, count(*) AS manifests FROM part GROUP BY 1")
def d14_locks(t: Tables) -> DataFrame:
    return P.missing_locks(t.manifests)


_TOKENS = f"regexp_extract_all(text, {sql_text(D.LONG_TOKEN)}, 0)"


@query(
    "d15_obfuscation",
    f"WITH f AS (SELECT doc_id, coalesce(list_max(list_transform({_TOKENS}, lambda k: round(list_entropy(string_split(k, '')), 6))), 0.0) AS max_entropy, "
    "CAST(list_max(list_transform(string_split(text, chr(10)), lambda l: length(l))) AS INTEGER) AS longest_line, "
    "CAST(len(regexp_extract_all(text, '[A-Za-z0-9+/]{40,}={0,2}')) AS INTEGER) AS base64_runs, "
    "CAST(len(regexp_extract_all(text, '([\\\\]x[0-9a-fA-F]{2}){8,}')) AS INTEGER) AS hex_runs, "
    "CASE WHEN regexp_matches(text, '(eval|exec)[(][ ]*(atob|base64|unescape|bytes[.]fromhex)') THEN 1 ELSE 0 END AS eval_decode, "
    "round(length(regexp_replace(text, '[\\x00-\\x7F]+', '', 'g')) / nullif(length(text), 0), 6) AS non_ascii FROM documents) "
    "SELECT *, CAST(CASE WHEN max_entropy > 4.5 THEN 30 ELSE 0 END + CASE WHEN longest_line > 2000 THEN 20 ELSE 0 END + least(base64_runs, 2) * 10 + least(hex_runs, 2) * 10 "
    "+ eval_decode * 30 + CASE WHEN non_ascii > 0.3 THEN 10 ELSE 0 END AS INTEGER) AS score FROM f",
)
def d15(t: Tables) -> DataFrame:
    return D.obfuscation(t.documents.select("doc_id", F.col("text").alias("content")), "doc_id")


_GRAMS = (
    "SELECT DISTINCT {id}, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT {id}, w, unnest(range(1, len(w) - 6)) AS i FROM "
    "(SELECT {id}, list_filter(regexp_split_to_array(text, '[ \\n\\t\\r]+'), lambda x: x <> '') AS w FROM {src}) WHERE len(w) >= 8)"
)


@query(
    "d16_signature",
    f"WITH d AS ({_GRAMS.format(id='doc_id', src='documents')}), b AS ({_GRAMS.format(id='item_id', src='benchmark')}), t AS (SELECT item_id AS i, count(*) AS total FROM b GROUP BY 1) "
    "SELECT doc_id, item_id, count(*) AS shared, round(count(*) / any_value(total), 6) AS overlap FROM d JOIN b USING (g) JOIN t ON item_id = i GROUP BY 1, 2",
)
def d16(t: Tables) -> DataFrame:
    files = t.documents.select("doc_id", F.col("text").alias("content"))
    known = t.benchmark.select("item_id", F.col("text").alias("content"))
    return D.signature_overlap(files, known, "doc_id", "item_id")


@query(
    "d17_db_artifacts",
    "SELECT repo, path, CASE k WHEN 1 THEN 1 WHEN 2 THEN 5 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 2 ELSE 2 END AS line, "
    "CASE k WHEN 1 THEN 'create_table' WHEN 2 THEN 'alter_table' WHEN 3 THEN 'connection' WHEN 4 THEN 'model' ELSE 'statement' END AS kind, "
    "CASE WHEN k <= 2 THEN replace(p_name, ' ', '_') ELSE '' END AS detail, k <= 2 AS migration "
    "FROM (SELECT p_brand AS repo, p_partkey, p_name, p_size FROM part) p JOIN (SELECT path, CAST(regexp_extract(path, '([0-9]+)', 1) AS BIGINT) AS pk FROM code_files) c ON c.pk = p_partkey "
    "JOIN (VALUES (1), (2), (3), (4), (5), (6)) v(k) ON (k <= 2 AND p_size BETWEEN 16 AND 20) OR (k IN (3, 4) AND p_size BETWEEN 21 AND 25) OR (k = 5 AND p_size <= 5) OR (k = 6 AND p_size BETWEEN 11 AND 15)",
)
def d17(t: Tables) -> DataFrame:
    return D.db_artifacts(t.code_files)


@query(
    "d17_table_columns",
    "SELECT p_brand AS repo, 'db/migrations/' || CAST(p_partkey AS STRING) || '.sql' AS path, replace(p_name, ' ', '_') AS \"table\", c AS \"column\", ty AS type "
    "FROM part, (VALUES ('id', 'INTEGER'), ('size', 'TEXT')) v(c, ty) WHERE p_size BETWEEN 16 AND 20",
)
def d17_columns(t: Tables) -> DataFrame:
    return D.table_columns(t.code_files)


@query(
    "d18_endpoints",
    "SELECT regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '[0-9]+', '{id}', 'g') AS template, count(*) AS hits FROM pages GROUP BY 1",
)
def d18(t: Tables) -> DataFrame:
    return N.url_endpoints(t.pages)


@query(
    "d18_code_endpoints",
    "SELECT p_brand AS repo, '/api/items' || CAST(p_partkey AS STRING) || '/{id}' AS path, m AS method FROM part, (VALUES ('GET'), ('PUT')) v(m) WHERE p_size BETWEEN 31 AND 35 UNION ALL "
    "SELECT p_brand, '/views/' || CAST(p_partkey AS STRING), 'POST' FROM part WHERE p_size BETWEEN 36 AND 40",
)
def d18_code(t: Tables) -> DataFrame:
    return D.code_endpoints(t.code_files)


@query(
    "j6_spec_code",
    f"WITH s AS (SELECT '/api/' || CAST(page_id AS STRING) AS path, 'GET' AS method FROM pages), c AS (SELECT DISTINCT path, method FROM ({ORACLES['d18_code_endpoints']})) "
    "SELECT coalesce(s.path, c.path) AS path, coalesce(s.method, c.method) AS method, CASE WHEN c.path IS NULL THEN 'only_spec' WHEN s.path IS NULL THEN 'only_code' ELSE 'both' END AS status "
    "FROM s FULL JOIN c ON s.path = c.path AND s.method = c.method",
)
def j6_spec_code(t: Tables) -> DataFrame:
    """Operations of the descriptions against the handlers in the source."""
    spec = S.read_openapi(t.spec_files)["endpoints"]
    return drift(spec, D.code_endpoints(t.code_files), ["path", "method"])


_SERVER = "regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)"


@query(
    "s5_spec_flatten",
    "SELECT CAST(page_id AS STRING) || '.json' AS spec, 'GET /api/' || CAST(page_id AS STRING) || ' 200' AS source, f AS field_path, ty AS type, CAST(d AS INTEGER) AS depth "
    "FROM pages, (VALUES ('id', 'integer', 1), ('title', 'string', 1), ('owner', 'object', 1), ('owner.email', 'string', 2)) v(f, ty, d)",
)
def s5(t: Tables) -> DataFrame:
    """Every response field of every description, references resolved."""
    api = S.read_openapi(t.spec_files)
    return S.resolve_refs(api["responses"], api["schema_fields"]).drop("cyclic")


@query(
    "s5_params",
    "SELECT CAST(page_id AS STRING) || '.json' AS spec, '/api/' || CAST(page_id AS STRING) AS path, 'GET' AS method, 'q' AS name, 'query' AS location, true AS required, 'string' AS type FROM pages",
)
def s5_params(t: Tables) -> DataFrame:
    return S.read_openapi(t.spec_files)["params"].select("spec", "path", "method", "name", "location", "required", "type")


@query(
    "d19_spec_lint",
    "WITH s AS (SELECT CAST(page_id AS STRING) || '.json' AS spec, page_id, url FROM pages) "
    "SELECT spec, 'no_security' AS lint, 'GET /api/' || CAST(page_id AS STRING) AS at FROM s UNION ALL "
    "SELECT spec, 'no_401_403', 'GET /api/' || CAST(page_id AS STRING) FROM s UNION ALL SELECT spec, 'unbounded_string', 'Page.title' FROM s UNION ALL "
    f"SELECT spec, 'plain_http', {_SERVER} FROM s WHERE url LIKE 'http://%'",
)
def d19(t: Tables) -> DataFrame:
    return S.lint(S.read_openapi(t.spec_files))


# YAML descriptions; the twins take the JSON spelling of the same descriptions apart.
_OPS = (
    "WITH d AS (SELECT path AS spec, CAST(content AS JSON) AS doc FROM spec_json), "
    "pa AS (SELECT spec, doc, p, json_extract(doc, '$.paths.\"' || p || '\"') AS ms FROM (SELECT spec, doc, unnest(json_keys(doc, '$.paths')) AS p FROM d)), "
    "o AS (SELECT spec, doc, p AS path, upper(m) AS method, json_extract(ms, '$.' || m) AS op FROM (SELECT spec, doc, p, ms, unnest(json_keys(ms)) AS m FROM pa)) "
)


def yaml_tables(t: Tables) -> dict[str, DataFrame]:
    return S.spec_tables(yaml_rows(text_lines(t.spec_yaml)))


@query(
    "s5_yaml_endpoints",
    _OPS + "SELECT spec, path, method, json_extract_string(op, '$.summary') AS summary, json_extract(doc, '$.security') IS NOT NULL OR json_extract(op, '$.security') IS NOT NULL AS has_security FROM o",
)
def s5_yaml_endpoints(t: Tables) -> DataFrame:
    return yaml_tables(t)["endpoints"]


@query(
    "s5_yaml_params",
    _OPS + "SELECT spec, path, method, json_extract_string(q, '$.name') AS name, json_extract_string(q, '$.in') AS location, coalesce(json_extract_string(q, '$.required') = 'true', false) AS required, "
    "json_extract_string(q, '$.schema.type') AS type, CAST(json_extract_string(q, '$.schema.minimum') AS DOUBLE) AS minimum, array_to_string(CAST(json_extract(q, '$.schema.enum') AS VARCHAR[]), '|') AS enum "
    "FROM (SELECT spec, path, method, unnest(CAST(json_extract(op, '$.parameters') AS JSON[])) AS q FROM o)",
)
def s5_yaml_params(t: Tables) -> DataFrame:
    return yaml_tables(t)["params"].withColumn("enum", F.array_join("enum", "|"))


@query(
    "s5_yaml_responses",
    _OPS + "SELECT spec, path, method, s AS status, json_extract_string(op, '$.responses.' || s || '.description') AS description, "
    "nullif(regexp_extract(CAST(json_extract(op, '$.responses.' || s) AS VARCHAR), '\"[$]ref\":\"#/components/schemas/([A-Za-z0-9_]+)\"', 1), '') AS ref "
    "FROM (SELECT spec, path, method, op, unnest(json_keys(op, '$.responses')) AS s FROM o)",
)
def s5_yaml_responses(t: Tables) -> DataFrame:
    return yaml_tables(t)["responses"]


@query(
    "s5_yaml_fields",
    _OPS + ", owners AS (SELECT spec, 'body' AS kind, method || ' ' || path AS owner, json_extract(op, '$.requestBody.content.\"application/json\".schema') AS s FROM o "
    "UNION ALL SELECT spec, 'schema', k, json_extract(doc, '$.components.schemas.' || k) FROM (SELECT spec, doc, unnest(json_keys(doc, '$.components.schemas')) AS k FROM d)), "
    "f AS (SELECT spec, kind, owner, s, f AS field, json_extract(s, '$.properties.' || f) AS v FROM (SELECT *, unnest(json_keys(s, '$.properties')) AS f FROM owners WHERE s IS NOT NULL)) "
    "SELECT spec, kind, owner, field, json_extract_string(v, '$.type') AS type, json_extract_string(v, '$.format') AS format, "
    "nullif(regexp_extract(CAST(v AS VARCHAR), '#/components/schemas/([A-Za-z0-9_]+)', 1), '') AS ref, CAST(json_extract_string(v, '$.minimum') AS DOUBLE) AS minimum, "
    "CAST(json_extract_string(v, '$.minLength') AS DOUBLE) AS min_length, CAST(json_extract_string(v, '$.minItems') AS DOUBLE) AS min_items, "
    "CAST(json_extract_string(v, '$.maxLength') AS DOUBLE) AS max_length, coalesce(list_contains(CAST(json_extract(s, '$.required') AS VARCHAR[]), field), false) AS required FROM f",
)
def s5_yaml_fields(t: Tables) -> DataFrame:
    return yaml_tables(t)["schema_fields"].drop("enum")


@query(
    "j6_yaml_code",
    _OPS + f", c AS (SELECT DISTINCT path, method FROM ({ORACLES['d18_code_endpoints']})) "
    "SELECT coalesce(s.path, c.path) AS path, coalesce(s.method, c.method) AS method, CASE WHEN c.path IS NULL THEN 'only_spec' WHEN s.path IS NULL THEN 'only_code' ELSE 'both' END AS status "
    "FROM (SELECT DISTINCT path, method FROM o) s FULL JOIN c ON s.path = c.path AND s.method = c.method",
)
def j6_yaml_code(t: Tables) -> DataFrame:
    """Operations of the YAML descriptions against the handlers in the source, which they share paths with."""
    return drift(yaml_tables(t)["endpoints"], D.code_endpoints(t.code_files), ["path", "method"])


# What the handlers check: limits by the attributes of the parts behind them.
_CHECKS = "SELECT 'PUT /api/items' || CAST(p_partkey AS STRING) || '/{id}' AS owner, 'name' AS field, CAST(50 + p_size AS DOUBLE) AS max_length, p_size % 2 = 0 AS required FROM part"


@query(
    "j6_constraints",
    f"WITH y AS ({ORACLES['s5_yaml_fields']}), c AS ({_CHECKS}), b AS (SELECT y.owner, y.field, y.max_length AS s1, c.max_length AS c1, y.required AS s2, c.required AS c2 FROM y JOIN c ON y.owner = c.owner AND y.field = c.field) "
    "SELECT owner, field, 'max_length' AS attr, CAST(s1 AS STRING) AS spec, CAST(c1 AS STRING) AS code FROM b WHERE s1 IS DISTINCT FROM c1 UNION ALL "
    "SELECT owner, field, 'required', CAST(s2 AS STRING), CAST(c2 AS STRING) FROM b WHERE s2 IS DISTINCT FROM c2",
)
def j6_constraints(t: Tables) -> DataFrame:
    """Limits that the YAML descriptions and the handlers state differently for the same field."""
    code = t.part.selectExpr(
        "'PUT /api/items' || CAST(p_partkey AS STRING) || '/{id}' AS owner", "'name' AS field", "CAST(50 + p_size AS DOUBLE) AS max_length", "p_size % 2 = 0 AS required")
    spec = yaml_tables(t)["schema_fields"].where("kind = 'body'")
    return constraint_drift(spec, code, ["owner", "field"], ["max_length", "required"])


@query(
    "d19_yaml_lint",
    _OPS + "SELECT spec, 'no_security' AS lint, method || ' ' || path AS at FROM o WHERE json_extract(doc, '$.security') IS NULL UNION ALL "
    "SELECT spec, 'no_401_403', method || ' ' || path FROM o WHERE NOT list_has_any(json_keys(op, '$.responses'), ['401', '403']) UNION ALL "
    "SELECT spec, 'unbounded_string', 'Page.title' FROM d UNION ALL "
    "SELECT spec, 'plain_http', json_extract_string(doc, '$.servers[0].url') FROM d WHERE json_extract_string(doc, '$.servers[0].url') LIKE 'http://%'",
)
def d19_yaml(t: Tables) -> DataFrame:
    return S.lint(yaml_tables(t))


_RUNS = (
    "WITH l AS (SELECT file, n, block, sum(CASE WHEN block LIKE '[*] starting%' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY n ROWS UNBOUNDED PRECEDING) AS run FROM scanner_lines) "
)


def log_lines(t: Tables) -> DataFrame:
    return t.scanner_lines.select("file", "n", F.posexplode(F.split("block", "\n")).alias("k", "text")).select(
        "file", (F.col("n") * 10 + F.col("k")).alias("n"), "text"
    )


@query(
    "s6_scanner_runs",
    _RUNS + "SELECT file, CAST(run AS BIGINT) AS run, max(CASE WHEN block LIKE '[*] starting%' THEN substr(block, 16) END) AS started, "
    "max(CASE WHEN block LIKE '[*] ending%' THEN substr(block, 14) END) AS ended, max(CASE WHEN block LIKE 'back-end%' THEN 'SQLite' END) AS dbms, "
    "CAST(sum(1 + length(block) - length(replace(block, chr(10), ''))) AS BIGINT) AS lines FROM l WHERE run > 0 GROUP BY 1, 2",
)
def s6_runs(t: Tables) -> DataFrame:
    return read_scanner_log(log_lines(t))["runs"]


@query(
    "s6_scanner_points",
    _RUNS + "SELECT file, CAST(run AS BIGINT) AS run, n * 10 + 3 AS n, regexp_extract(block, 'Parameter: (p[0-9]+)', 1) AS parameter, 'GET' AS place, "
    "'boolean-based blind' AS type, 'AND boolean-based blind' AS title, 'id=1 AND ' || CAST(n AS STRING) || '=' || CAST(n AS STRING) AS payload FROM l WHERE run > 0 AND block LIKE 'Parameter%'",
)
def s6_points(t: Tables) -> DataFrame:
    return read_scanner_log(log_lines(t))["points"]


_LINKS = f"SELECT page_id, {_HOST} AS src, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS dst FROM pages"


@query("d20_links", f"SELECT src, dst, count(*) AS n FROM ({_LINKS}) GROUP BY 1, 2")
def d20_links(t: Tables) -> DataFrame:
    return N.page_links(t.pages).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(
    "d20_degrees",
    f"WITH e AS (SELECT DISTINCT src, dst FROM ({_LINKS})) SELECT node, CAST(sum(o) AS BIGINT) AS fan_out, CAST(sum(i) AS BIGINT) AS fan_in FROM "
    "(SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY 1",
)
def d20_degrees(t: Tables) -> DataFrame:
    return G.degrees(N.page_links(t.pages))


_TREE = (
    "SELECT 'region ' || CAST(r_regionkey AS STRING) AS src, 'nation ' || CAST(n_nationkey AS STRING) AS dst FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL "
    "SELECT 'nation ' || CAST(c_nationkey AS STRING), 'customer ' || CAST(c_custkey AS STRING) FROM customer UNION ALL "
    "SELECT 'customer ' || CAST(o_custkey AS STRING), 'order ' || CAST(o_orderkey AS STRING) FROM orders UNION ALL "
    "SELECT DISTINCT 'order ' || CAST(l_orderkey AS STRING), 'part ' || CAST(l_partkey AS STRING) FROM lineitem"
)


@query(
    "d20_reach",
    f"WITH RECURSIVE e AS MATERIALIZED ({_TREE}), r(node, depth) AS (SELECT 'region ' || CAST(r_regionkey AS STRING), 0 FROM region WHERE r_name = 'ASIA' UNION SELECT dst, depth + 1 FROM r JOIN e ON src = node) "
    "SELECT node, min(depth) AS depth FROM r GROUP BY 1",
)
def d20_reach(t: Tables) -> DataFrame:
    """Everything reachable from one region along region → nation → customer → order → part."""
    edge = lambda df, a, x, b, y: df.select(
        F.concat(F.lit(a + " "), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b + " "), F.col(y).cast("string")).alias("dst")
    )
    edges = append(
        edge(t.nation, "region", "n_regionkey", "nation", "n_nationkey"),
        edge(t.customer, "nation", "c_nationkey", "customer", "c_custkey"),
        edge(t.orders, "customer", "o_custkey", "order", "o_orderkey"),
        edge(t.lineitem, "order", "l_orderkey", "part", "l_partkey"),
    )
    roots = t.region.where("r_name = 'ASIA'").select(F.concat(F.lit("region "), F.col("r_regionkey").cast("string")).alias("node"))
    return G.reach(edges, roots)


@query(
    "d20_imports",
    "SELECT p_brand AS repo, path AS src, CASE WHEN p_size <= 5 THEN 'os' WHEN p_size <= 10 THEN 'hashlib' WHEN p_size <= 15 THEN 'http' WHEN p_size <= 25 THEN 'models' ELSE 'logging' END AS dst "
    "FROM part JOIN (SELECT path, CAST(regexp_extract(path, '([0-9]+)', 1) AS BIGINT) AS pk FROM code_files) c ON c.pk = p_partkey WHERE p_size <= 15 OR p_size BETWEEN 21 AND 30",
)
def d20_imports(t: Tables) -> DataFrame:
    return D.import_edges(t.code_files).select("repo", "src", "dst")


# The twin takes strings and comments out by one alternation, whose leftmost match decides.
_STRINGS = "'(?:\\\\.|[^'\\\\\\n])*'|\"(?:\\\\.|[^\"\\\\\\n])*\""
_OUT = {
    "py": sql_text('\'\'\'(?:.|\\n)*?\'\'\'|"""(?:.|\\n)*?"""|' + _STRINGS + "|#[^\\n]*"),
    "js": sql_text("//[^\\n]*|/\\*(?:.|\\n)*?\\*/|`[^`]*`|" + _STRINGS),
}
_CALLED = "len(regexp_extract_all(code, '(?:^|[^A-Za-z0-9_.])(?:eval|exec)[(]'))"


@query(
    "d3_code_calls",
    f"WITH c AS (SELECT repo, path, CASE WHEN path LIKE '%.py' THEN regexp_replace(content, {_OUT['py']}, ' ', 'g') ELSE regexp_replace(content, {_OUT['js']}, ' ', 'g') END AS code FROM talking_files) "
    f"SELECT repo, path, CAST({_CALLED} AS BIGINT) AS calls FROM c WHERE {_CALLED} > 0",
)
def d3_code_calls(t: Tables) -> DataFrame:
    """Dynamic calls that are code: what strings and comments say does not count."""
    rules = in_code([r for r in pack("D3") if r.rule_id == "sink.eval"])
    return match_rules(t.talking_files, rules).groupBy("repo", "path").agg(F.count("*").alias("calls"))


# Imports read from the text; endings of module and path meet as strings.
_RESOLVED = (
    "l AS (SELECT repo, path AS src, unnest(regexp_extract_all(content, '(?m)^(?:from|import) ([A-Za-z0-9_.]+)', 1)) AS module FROM module_files), "
    "i AS (SELECT repo, path AS file, string_split(regexp_replace(path, '[.]py$', ''), '/') AS parts FROM module_files), "
    "c AS (SELECT DISTINCT l.repo, l.src, l.module, i.file, k, len(string_split(l.module, '.')) AS n FROM l JOIN (SELECT repo, file, parts, unnest(range(1, len(parts) + 1)) AS k FROM i) i "
    "ON l.repo = i.repo AND array_to_string(parts[-k:], '/') = array_to_string(string_split(l.module, '.')[-k:], '/') AND i.file <> l.src AND (k > 1 OR len(string_split(l.module, '.')) = 1)), "
    "b AS (SELECT repo, src, module, file FROM c QUALIFY row_number() OVER (PARTITION BY repo, src, module ORDER BY k DESC, file) = 1), "
    "resolved AS (SELECT l.repo, l.src, l.module, b.file FROM l LEFT JOIN b ON b.repo = l.repo AND b.src = l.src AND b.module = l.module) "
)


def resolved(t: Tables) -> DataFrame:
    return G.resolve_imports(D.import_edges(t.module_files), t.module_files)


@query("d20_resolved", f"WITH {_RESOLVED} SELECT * FROM resolved")
def d20_resolved(t: Tables) -> DataFrame:
    return resolved(t)


@query(
    "d20_code_graph",
    f"WITH RECURSIVE {_RESOLVED}, e AS MATERIALIZED (SELECT DISTINCT repo, src, file AS dst FROM resolved WHERE file IS NOT NULL), "
    "r(repo, a, b) AS (SELECT repo, src, dst FROM e UNION SELECT r.repo, a, e.dst FROM r JOIN e ON e.repo = r.repo AND e.src = b), "
    "ring AS (SELECT x.repo, x.a, x.b FROM r x JOIN r y ON x.repo = y.repo AND x.a = y.b AND x.b = y.a), "
    "comp AS (SELECT m.repo, m.path, coalesce(least(min(ring.b), m.path), m.path) AS component FROM module_files m LEFT JOIN ring ON ring.repo = m.repo AND ring.a = m.path GROUP BY 1, 2) "
    "SELECT c.repo, c.path, component, count(*) OVER (PARTITION BY c.repo, component) AS cycle_files, coalesce(n, 0) AS reaches FROM comp c "
    "LEFT JOIN (SELECT repo, a, count(*) AS n FROM r WHERE a <> b GROUP BY 1, 2) x ON x.repo = c.repo AND x.a = c.path",
)
def d20_code_graph(t: Tables) -> DataFrame:
    """Import cycles and how far a file's imports lead."""
    return G.code_graph(resolved(t), t.module_files)


_DIGITS = "list_transform(string_split(reverse(v), ''), lambda c: CAST(c AS INTEGER))"
_LUHN = (
    f"list_sum(list_transform({_DIGITS}, lambda d, i: CASE WHEN i % 2 = 1 THEN d WHEN d * 2 > 9 THEN d * 2 - 9 ELSE d * 2 END)) % 10 = 0"
)


def _pii_sql(src: str, table: str, key: str) -> str:
    p = {r.rule_id: sql_text(r.pattern) for r in pack("D21")}
    each = lambda kind, pattern, where: (
        f"SELECT '{src}' AS src, id, '{kind}' AS kind, substr(v, 1, 4) || '***' AS value FROM "
        f"(SELECT {key} AS id, unnest(regexp_extract_all(text, {pattern}, 0)) AS v FROM {table}) WHERE {where}"
    )
    return " UNION ALL ".join([
        each("email", p["pii.email"], "true"), each("phone", p["pii.phone"], "true"),
        each("card", sql_text(D.CARD), _LUHN),
        each("ip", sql_text(D.IPV4), "list_max(list_transform(string_split(v, '.'), lambda x: CAST(x AS INTEGER))) <= 255"),
    ])


@query("d21_pii", f"{_pii_sql('documents', 'documents', 'doc_id')} UNION ALL {_pii_sql('conversations', 'conversations', 'conv_id')}")
def d21(t: Tables) -> DataFrame:
    docs = t.documents.select(F.lit("documents").alias("src"), F.col("doc_id").alias("id"), F.col("text").alias("content"))
    chats = t.conversations.select(F.lit("conversations").alias("src"), F.col("conv_id").alias("id"), F.col("text").alias("content"))
    return D.pii(append(docs, chats), "src", "id")


@query(
    "d22_licenses",
    f"WITH lines AS MATERIALIZED ({LINES.format(src='files')}) SELECT repo, CASE rule_id WHEN 'licence.mit' THEN 'MIT' ELSE 'Apache-2.0' END AS spdx, count(*) AS n, count(DISTINCT path) AS files "
    f"FROM ({matches_sql(pack('D22'))}) GROUP BY 1, 2",
)
def d22(t: Tables) -> DataFrame:
    return D.licences(t.files)


@query(
    "d23_page_risks",
    "SELECT page_id, CAST(len(regexp_extract_all(html, '<script')) - len(regexp_extract_all(html, '<script[^>]* src=\"([^\"]*)\"')) AS INTEGER) AS inline_scripts, "
    f"CAST(len(list_filter(regexp_extract_all(html, '<script[^>]* src=\"([^\"]*)\"', 1), lambda s: regexp_extract(s, '^[a-z]+://([^/?#:]+)', 1) NOT IN ('', {_HOST}))) AS INTEGER) AS third_party, "
    "CAST(len(list_filter(regexp_extract_all(html, '(?s)<form.*?</form>'), lambda f: NOT contains(lower(f), 'token'))) AS INTEGER) AS open_forms, "
    "CAST(len(regexp_extract_all(html, '(?s)<!--.*?-->')) AS INTEGER) AS comments, CAST(len(regexp_extract_all(html, '(?i) on(click|load|error|mouseover)=')) AS INTEGER) AS handlers FROM pages",
)
def d23(t: Tables) -> DataFrame:
    return N.page_risks(t.pages)


@query(
    "d24_transcript",
    "SELECT conv_id, turn, 'tool_call' AS kind, 'tools.scan' || CAST(turn AS STRING) AS tool, '{\"n\":' || CAST(turn AS STRING) || '}' AS tool_params FROM conversations WHERE role = 'assistant' UNION ALL "
    "SELECT conv_id, turn, 'text', NULL, NULL FROM conversations WHERE role <> 'assistant' UNION ALL SELECT conv_id, turn, 'text', NULL, NULL FROM conversations",
)
def d24(t: Tables) -> DataFrame:
    """The chats as they are, and once more with the assistant calling tools and the others sending JSON."""
    q = "chr(34)"
    calls = t.conversations.selectExpr(
        "conv_id", "turn",
        f"CASE WHEN role = 'assistant' THEN '{{' || {q} || 'method' || {q} || ':' || {q} || 'tools.scan' || CAST(turn AS STRING) || {q} || ',' || {q} || 'params' || {q} || ':{{' || {q} || 'n' || {q} || ':' "
        f"|| CAST(turn AS STRING) || '}}}}' ELSE '{{' || {q} || 'a' || {q} || ':1}}' END AS text",
    )
    return N.transcript(append(calls, t.conversations.select("conv_id", "turn", "text"))).select("conv_id", "turn", "kind", "tool", "tool_params")


# The twin reads the messages' text, drops notes and looks one and two messages back.
_CALLS = (
    "WITH m AS (SELECT conv_id, turn, role, text, CASE WHEN json_valid(text) THEN json_extract_string(text, '$.method') END AS method, "
    "regexp_extract(text, '^Tool ''([^'']*)'' executed with result:\\n', 1) AS answering, "
    "regexp_replace(regexp_replace(text, '^Tool ''[^'']*'' executed with result:\\n', ''), '(?s)\\n\\nContinue reasoning.*$', '') AS body FROM agent_messages), "
    "e AS (SELECT conv_id, turn, coalesce(method, answering) AS tool, CASE WHEN role = 'assistant' AND method LIKE 'tools.%' THEN 'call' "
    "WHEN role = 'user' AND answering <> '' THEN CASE WHEN trim(body) IN ('', 'None', 'null') OR (CASE WHEN json_valid(body) THEN json_type(body, '$.error') END) NOT IN ('NULL') THEN 'failed' ELSE 'ok' END "
    "WHEN role = 'system' THEN 'note' ELSE 'other' END AS event FROM m), "
    "s AS (SELECT *, lag(event) OVER w AS b1, lag(event, 2) OVER w AS b2, lead(event) OVER w AS f1, lead(turn) OVER w AS f1_turn FROM e WHERE event <> 'note' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), "
    "c AS (SELECT *, NOT coalesce(b1 IN ('ok', 'failed') AND b2 = 'call', false) AS starts FROM s WHERE event = 'call'), "
    "n AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS chain FROM c), "
    "calls AS (SELECT conv_id, CAST(chain AS BIGINT) AS chain, row_number() OVER (PARTITION BY conv_id, chain ORDER BY turn) AS step, turn, tool, "
    "CASE WHEN f1 IN ('ok', 'failed') THEN f1 ELSE 'unanswered' END AS outcome, CASE WHEN f1 IN ('ok', 'failed') THEN f1_turn END AS answer_turn FROM n) "
)


@query("d24_calls", _CALLS + "SELECT * FROM calls")
def d24_calls(t: Tables) -> DataFrame:
    return N.tool_calls(t.agent_messages)


@query(
    "d24_chains",
    _CALLS + "SELECT conv_id, chain, count(*) AS steps, CAST(sum(CASE WHEN outcome <> 'ok' THEN 1 ELSE 0 END) AS BIGINT) AS failures, count(DISTINCT tool) AS tools, "
    "min(turn) AS first_turn, arg_max(outcome, step) <> 'ok' AS ends_in_failure FROM calls GROUP BY 1, 2",
)
def d24_chains(t: Tables) -> DataFrame:
    return N.call_chains(N.tool_calls(t.agent_messages))


@query("d25_logging", findings_sql("D25", src="code_files"))
def d25(t: Tables) -> DataFrame:
    return D.detect_logging(t.code_files).select(*COLUMNS)


