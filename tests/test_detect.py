from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from palisade.operators import findings as R
from palisade.operators.detect import code as D
from palisade.operators.detect import deps as P
from palisade.operators.detect import graph as G
from palisade.operators.detect import traffic as N
from palisade.operators.detect.rules import PACK, Rule, match_rules, pack, scan, with_rules
from palisade.sources.files import corpus_layout, read_files, write_corpus
from palisade.sources.sinks import write_report
from palisade.sources.vectors import vectors

# A file with planted flaws, and a service with unsafe statements.
FLAWED = 'password = "k7Qz9vLm2XwT4hunter"\ndb.execute(stmt)\ny = eval(x)\n'
SERVICE = """
def rename(store, key, label):
    store.run(f"UPDATE shelf SET label = '{label}' WHERE key = {key}")

def prune(store, day):
    store.run("DELETE FROM visit WHERE day < '" + day)
    store.run("INSERT INTO prune_log VALUES ('" + day + "')")
    log.error("stack trace follows")

app.start("0.0.0.0")
"""


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "repo string, path string, content string")


def test_rules_match_their_samples_and_gates(spark):
    assert all(any(w in r.sample.lower() for w in r.gate) for r in PACK)
    got = match_rules(files(spark, *[("r", r.rule_id, "one\n" + r.sample) for r in PACK]), PACK)
    hit = {r["path"] for r in got.where("path = rule_id AND line = 2").collect()}
    assert hit == {r.rule_id for r in PACK}


def test_gate_never_hides_a_match(spark):
    f = files(spark, *[("r", str(i), r.sample) for i, r in enumerate(PACK)])
    open_rules = [Rule(r.rule_id, r.detector, r.vector_id, r.severity, r.pattern, "", (), r.check) for r in PACK]
    rows = lambda rules: sorted(map(tuple, match_rules(f, rules).collect()))
    assert rows(PACK) == rows(open_rules)


def test_planted_flaws(spark):
    found = scan(files(spark, ("r", "a.py", FLAWED)), pack("D1", "D2", "D3"))
    assert sorted((r["line"], r["rule_id"]) for r in found.collect()) == [(1, "secret.assign"), (2, "sql.raw_execute"), (3, "sink.eval")]
    assert all("hunter" not in r["match"] for r in found.collect())


def test_service_with_unsafe_statements(spark):
    got = {(r["rule_id"]): r["n"] for r in scan(files(spark, ("r", "s.py", SERVICE)), pack("D2", "D8", "D5")).groupBy("rule_id").agg(F.count("*").alias("n")).collect()}
    assert got == {"sql.fstring": 1, "sql.concat": 2, "leak.db_error": 1, "net.bind_all": 1}


def test_fingerprint_survives_line_shift(spark):
    one = scan(files(spark, ("r", "a.py", FLAWED))).select("fingerprint").collect()
    two = scan(files(spark, ("r", "a.py", "\n\n" + FLAWED))).select("fingerprint").collect()
    assert sorted(one) == sorted(two)


def test_low_entropy_secret_is_dropped(spark):
    assert scan(files(spark, ("r", "a", "password = aaaaaaaaaa")), pack("D1")).count() == 0


def test_further_rules(spark):
    rules = with_rules([{"rule_id": "t.todo", "detector": "X9", "severity": 3, "pattern": "TODO"}])
    assert len(rules) == len(PACK) + 1 and len(pack()) == len(PACK)
    src = files(spark, ("r", "a", "x TODO y"), ("r", "b", FLAWED))
    assert sorted(r["rule_id"] for r in scan(src, rules).collect()) == ["secret.assign", "sink.eval", "sql.raw_execute", "t.todo"]
    with pytest.raises(ValueError, match="duplicate"):
        with_rules([PACK[0]])


def test_versions_compare(spark):
    order = ["0.9", "1.0.dev1", "1.0a2", "1.0rc1", "1.0", "1.0.1", "1.2", "1.10", "2"]
    df = spark.createDataFrame([(a, b) for a in order for b in order], "a string, b string")
    for r in df.select("a", "b", (P.version_key(F.col("a")) < P.version_key(F.col("b"))).alias("less")).collect():
        assert r["less"] == (order.index(r["a"]) < order.index(r["b"])), r
    same = spark.createDataFrame([("1.2", "1.2.0"), ("v1", "1.0.0")], "a string, b string")
    assert all(r[0] for r in same.select(P.version_key(F.col("a")) == P.version_key(F.col("b"))).collect())


def test_images_and_advisories(spark):
    text = "FROM --platform=linux/amd64 python:3.9\nFROM reg.io:5000/team/img:1.2-linux AS b\nfrom alpine\nFROM x@sha256:ab"
    deps = P.dependencies(spark.createDataFrame([("r", "Dockerfile", "m", text)], "repo string, manifest string, module string, content string"))
    assert sorted((r["name"], r["spec"]) for r in deps.collect()) == [("alpine", ""), ("python", "3.9"), ("reg.io:5000/team/img", "1.2-linux"), ("x", "")]
    advisories = spark.createDataFrame([("python", "3.0", "3.9.0"), ("python", "3.1", "3.9.1"), ("python", "3.10", None)], "name string, introduced string, fixed string")
    got = sorted((r["name"], r["signal"]) for r in P.risk_signals(deps, None, advisories).collect())
    assert got == [("alpine", "wildcard"), ("python", "advisory"), ("x", "wildcard")]


def test_further_manifests(spark):
    texts = {
        "pyproject.toml": '[project]\nname = "x"\ndependencies = [\n  "httpx[http2]>=0.27",\n  "rich",\n]\n',
        "poetry.lock": '[[package]]\nname = "idna"\nversion = "3.7"\n\n[[package]]\nname = "anyio"\nversion = "4.4.0"\n',
        "Cargo.lock": '[[package]]\nname = "serde"\nversion = "1.0.200"\n',
        "yarn.lock": 'left-pad@^1.3.0:\n  version "1.3.0"\n\n"@scope/kit@^2":\n  version "2.1.0"\n',
        "package-lock.json": '{"packages":{"":{"version":"1.0.0"},"node_modules/ms":{"version":"2.1.3"},"node_modules/a/node_modules/@b/c":{"version":"0.1.0"}}}',
        "package.json": '{"peerDependencies":{"vue":"^3"},"optionalDependencies":{"fsevents":"2.3.3"}}',
        "Gemfile": "source 'https://gems.example'\ngem 'rack', '~> 3.0'\ngem 'puma'\n",
        "build.gradle": "dependencies {\n  implementation 'org.slf4j:slf4j-api:2.0.13'\n}\n",
        "compose.yaml": "services:\n  db:\n    image: reg.io:5000/pg:16.2\n  web:\n    image: nginx\n",
    }
    df = spark.createDataFrame([("r", m, "m", c) for m, c in texts.items()], "repo string, manifest string, module string, content string")
    got = sorted((r["ecosystem"], r["name"], r["spec"], r["scope"]) for r in P.dependencies(df).collect())
    assert got == sorted([
        ("pip", "httpx", ">=0.27", "runtime"), ("pip", "rich", "", "runtime"), ("pip", "idna", "3.7", "lock"), ("pip", "anyio", "4.4.0", "lock"),
        ("cargo", "serde", "1.0.200", "lock"), ("npm", "left-pad", "1.3.0", "lock"), ("npm", "@scope/kit", "2.1.0", "lock"), ("npm", "ms", "2.1.3", "lock"),
        ("npm", "@b/c", "0.1.0", "lock"), ("npm", "vue", "^3", "peer"), ("npm", "fsevents", "2.3.3", "optional"), ("gem", "rack", "~> 3.0", "runtime"),
        ("gem", "puma", "", "runtime"), ("maven", "org.slf4j:slf4j-api", "2.0.13", "runtime"), ("docker", "reg.io:5000/pg", "16.2", "deploy"), ("docker", "nginx", "", "deploy"),
    ])


def test_all_kinds_of_a_line(spark):
    line = "open('pg://u:pw@h/d').run('create table t (a int); delete from s where 1')"
    got = D.db_artifacts(files(spark, ("r", "db/migrations/1.py", line))).collect()
    assert sorted((r["kind"], r["detail"], r["migration"]) for r in got) == [("connection", "", True), ("create_table", "t", True), ("statement", "", True)]


@pytest.mark.parametrize(
    "query,kind",
    [
        ("id=1 AND 77=77", "boolean"), ("id=1 AND 1=2", None), ("id=-7 UNION ALL SELECT CHAR(113,112),NULL-- x", "union"),
        ("id=1 AND 9=LIKE(CHAR(65),HEX(RANDOMBLOB(5)))", "time"), ("q=test%27%20UNION%20ALL%20SELECT%20NULL--", "union"), ("q=it's", "quote"), ("q=plain", None),
    ],
)
def test_sqli_classes(spark, query, kind):
    df = spark.createDataFrame([(query,)], "q string")
    assert df.select(N.sqli_class(F.col("q"))).first()[0] == kind


def test_transcript(spark):
    rows = [(1, '{"method":"tools.x","params":{"a":1}}'), (2, '{"a":1}'), (3, "hello"), (4, '{"method":"other"}'), (5, '{"method":"tools.y"}')]
    got = N.transcript(spark.createDataFrame(rows, "i int, text string")).orderBy("i").collect()
    assert [(r["kind"], r["tool"], r["tool_params"]) for r in got] == [
        ("tool_call", "tools.x", '{"a":1}'), ("text", None, None), ("text", None, None), ("text", None, None), ("tool_call", "tools.y", "{}"),
    ]


def test_manifests(spark):
    js = '{"dependencies":{"react":"19.1.0","next":"15.5.4"},"devDependencies":{"typescript":"^5","lint":"^9","cfg":"15.5.4"}}'
    m = spark.createDataFrame(
        [("r", "requirements.txt", "m", "flask==2.2.5\nrequests==2.31.0\n"), ("r", "package.json", "m", js), ("r", "Dockerfile", "m", "FROM python:3.11-slim\nEXPOSE 5000")],
        "repo string, manifest string, module string, content string",
    )
    deps = P.dependencies(m).cache()
    assert {(r["ecosystem"], r["scope"]): r["n"] for r in deps.groupBy("ecosystem", "scope").agg(F.count("*").alias("n")).collect()} == {
        ("pip", "runtime"): 2, ("npm", "runtime"): 2, ("npm", "dev"): 3, ("docker", "build"): 1,
    }
    advisories = spark.createDataFrame([("flask", "2.10.0"), ("requests", "2.4.0")], "name string, fixed string")
    signals = P.risk_signals(deps, advisories=advisories)
    assert sorted((r["name"], r["signal"]) for r in signals.select("name", "signal").collect()) == [("flask", "advisory"), ("lint", "range"), ("typescript", "range")]


def test_similar_names(spark):
    known = spark.createDataFrame([("requests",), ("flask",)], "name string")
    seen = spark.createDataFrame([("reqeusts",), ("request",), ("flask",), ("flaskk",), ("numpy",)], "name string")
    got = sorted((r["name"], r["known"], r["distance"]) for r in P.typosquats(seen, known).collect())
    assert got == [("flaskk", "flask", 1), ("reqeusts", "requests", 2), ("request", "requests", 1)]


def test_pages(spark):
    html = '<script src="https://cdn.other/x.js"></script><script>a()</script><form a></form><form><i name="token"></form><!-- x --><b onclick="f()">'
    df = spark.createDataFrame([(1, "https://me.example/p", html)], "page_id long, url string, html string")
    assert tuple(N.page_risks(df).first()) == (1, 1, 1, 1, 1, 1)


def test_reach_and_components_against_brute_force(spark):
    rnd = random.Random(11)
    pairs = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    depth, frontier = {100: 0}, {100}
    while frontier:
        frontier = {b for a, b in pairs if a in frontier and b not in depth}
        depth.update({n: max(depth.values()) + 1 for n in frontier})
    got = {r["node"]: r["depth"] for r in G.reach(edges, spark.createDataFrame([(100,)], "node long")).collect()}
    assert got == depth
    nodes = sorted({n for p in pairs for n in p} | {999})
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    comp = G.components(edges, spark.createDataFrame([(n,) for n in nodes], "node long"))
    assert {r["node"]: r["component"] for r in comp.collect()} == label


def test_near_duplicates_against_brute_force(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    base = [rnd.choices(words, k=60) for _ in range(6)]
    texts = [" ".join(b) for b in base]
    texts += [" ".join(b[:30] + ["changed"] + b[31:]) for b in base[:3]] + [texts[0], "tiny", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    keys = {r["id"]: set(r["k"]) for r in df.select("id", R.band_keys(F.col("content"), 3, 4, 4).alias("k")).collect()}
    label = {i: i for i in keys}
    for _ in keys:
        for i in keys:
            for j in keys:
                if keys[i] & keys[j]:
                    label[i] = label[j] = min(label[i], label[j])
    got = {r["id"]: r["component"] for r in R.near_duplicates(df, "id").collect()}
    assert got == label
    assert got[9] == 0 and got[1] != got[2]
    jaccard = lambda a, b: len(a & b) / len(a | b)
    grams = lambda t: {tuple(t.split()[i:i + 3]) for i in range(len(t.split()) - 2)}
    for i in range(3):
        assert jaccard(grams(texts[i]), grams(texts[6 + i])) > 0.8 and got[6 + i] == got[i]


def test_files_and_corpus(spark, tmp_path):
    for repo, path, text in [("a", "z.py", "zz"), ("a", "sub/b.py", "bb\nb"), ("b", "c.txt", "c")]:
        target = tmp_path / "root" / repo / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    f = read_files(spark, str(tmp_path / "root"))
    assert sorted((r["repo"], r["path"], r["bytes"], r["lang"]) for r in f.collect()) == [
        ("a", "sub/b.py", 4, "python"), ("a", "z.py", 2, "python"), ("b", "c.txt", 1, "text"),
    ]
    assert read_files(spark, str(tmp_path / "root"), ["*.py", "*.go"]).count() == 2
    assert sorted((r["path"], r["offset"]) for r in corpus_layout(f.select("repo", "path", "content")).collect()) == [("c.txt", 0), ("sub/b.py", 0), ("z.py", 5)]
    write_corpus(f, str(tmp_path / "corpus"))
    parts = sorted((tmp_path / "corpus" / "repo=a").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == "bb\nb\nzz\n"


@pytest.mark.parametrize("fmt", ["json", "csv"])
def test_report_sink(spark, tmp_path, fmt):
    write_report(scan(files(spark, ("r", "a.py", FLAWED))), str(tmp_path / "out"), fmt=fmt)
    assert (tmp_path / "out" / "signals" / "repo=r").exists()


def test_correlate_and_diff(spark):
    found = scan(files(spark, ("r", "a.py", FLAWED + "x = a@b.example\n"), ("r", "b.py", FLAWED)))
    assert [(r["path"], r["issue"]) for r in R.correlate(found).collect()] == [("a.py", "credential beside personal data")]


def test_import_results(spark):
    rows = spark.createDataFrame([('{"repo":"r","file":"f","line":3,"rule":"x","level":"ERROR","message":"m"}',), ("nope",)], "value string")
    got = R.import_results(rows, "lint").where("path IS NOT NULL").collect()
    assert [(r["rule_id"], r["severity"], r["line"]) for r in got] == [("lint.x", 4, 3)]


def test_vector_listing(spark, tmp_path):
    (tmp_path / "list.txt").write_text("Intro\n1. First\n2. Second (x)\n")
    v = {r["id"]: (r["name"], r["family"]) for r in vectors(spark, str(tmp_path / "list.txt")).collect()}
    assert len(v) == 300 and v[1] == ("First", "D2") and v[2] == ("Second (x)", "D6") and v[300][1] == "D5"
    assert sum(f == "none" for _, f in v.values()) == 160


def test_organizer_of_every_detector():
    from palisade.operators.detect.rules import ORGANIZERS

    assert {r.detector for r in PACK} <= {d for ds in ORGANIZERS.values() for d in ds}
    assert len(ORGANIZERS) == 9


def test_manifests_as_they_are_written(spark):
    """Stages, options, urls, extras, markers and scopes."""
    rows = {
        "requirements.txt": "-r other.txt\n--index-url https://x/y\nflask[async]>=2.0 ; python_version>'3'\ngit+https://h/p.git@v1#egg=tool\nhttps://h/w.whl\nlib @ https://h/l.zip\n"
                            "plain\n# note\nspaced == 1.2  # why\n",
        "Dockerfile": "FROM golang:1.22 AS build\nFROM --platform=linux/amd64 node:20 as web\nFROM build\nFROM scratch\nFROM reg.io:5000/a/b:3\nCOPY --from=build /x /x\nFROM python AS python\n",
        "pom.xml": "<dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version><scope>test</scope></dependency>\n"
                   "<dependency><groupId>g</groupId><artifactId>b</artifactId><scope>compile</scope></dependency>",
        "other.txt": "flask==1",
    }
    df = spark.createDataFrame([("r", k, "m", v) for k, v in rows.items()] + [("r", "pom.xml", "m", None)], "repo string, manifest string, module string, content string")
    got = sorted((r["ecosystem"], r["name"], r["spec"], r["scope"]) for r in P.dependencies(df).collect())
    assert got == sorted([
        ("pip", "flask", ">=2.0", "runtime"), ("pip", "tool", "git+https://h/p.git@v1", "runtime"), ("pip", "lib", "https://h/l.zip", "runtime"), ("pip", "plain", "", "runtime"),
        ("pip", "spaced", "== 1.2", "runtime"), ("docker", "golang", "1.22", "build"), ("docker", "node", "20", "build"), ("docker", "reg.io:5000/a/b", "3", "build"), ("docker", "python", "", "build"),
        ("maven", "g:a", "1", "test"), ("maven", "g:b", "", "runtime")])


def test_sarif_results_without_a_place(spark):
    from palisade.operators.findings import import_sarif

    doc = '{"runs":[{"tool":{"driver":{"name":"T"}},"results":[{"ruleId":"a","message":{"text":"x"}},{"ruleId":"b","locations":[],"message":{"text":"y"}},' \
          '{"ruleId":"c","message":{"text":"z"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"f.py"},"region":{"startLine":3}}}]}]}]}'
    got = sorted((r.rule_id, r.path, r.line) for r in import_sarif(spark.createDataFrame([("r", doc)], "repo string, content string")).collect())
    assert got == [("t.a", None, None), ("t.b", None, None), ("t.c", "f.py", 3)]


def test_table_function_sees_every_candidate(spark):
    from palisade.functions import surface as U

    texts = [*[r.sample for r in U.finding_rules()], "COPY .env /app", "nothing here", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    spark.udtf.register("finding_rows", U.finding_rows())
    df.createOrReplaceTempView("all_texts")
    U.finding_candidates(df, "text").createOrReplaceTempView("some_texts")
    found = lambda view: sorted(tuple(r) for r in spark.sql(f"SELECT doc_id, f.rule_id, f.match FROM {view}, LATERAL finding_rows(text) f").collect())
    assert found("some_texts") == found("all_texts") and {r[0] for r in found("some_texts")} == set(range(len(texts) - 2))


def test_hidden_injections(spark):
    from palisade.functions.text import url_decoded
    from palisade.operators.detect import traffic

    cases = {
        "id=1 UNION/**/SELECT 1": "union", "id=1 union/*a*/all/*b*/select 2": "union", "id=1%2520UNION%2520SELECT%25201": "union", "id=1 /*!50000UNION*/ /*!SELECT*/ 1": "union",
        "id=%2525252527": "quote", "note=a /* union select */ b": None, "p=100%": None, "id=1%20AND%20SLEEP%28%35%29": "time",
    }
    df = spark.createDataFrame([(q,) for q in cases], "q string")
    assert {r.q: r.c for r in df.select("q", traffic.sqli_class(df.q).alias("c")).collect()} == cases
    deep = spark.createDataFrame([("%25252541",), ("%41%2542",), ("50%",), (None,), ("%25",)], "q string")
    assert [r.d for r in deep.select(url_decoded("q").alias("d")).collect()] == ["A", "AB", "50%", None, "%"]


def test_signature_shingles_against_plain(spark):
    import re

    import pyarrow as pa

    from palisade.operators.detect.code import shingle_hashes, signature_overlap

    texts = ["a b c d e f g h i", "", None, "  a\tb\nc d e f g h\r\n", "a b c d e f g h a b c d e f g h", "é x b c d e f g h i", "one two"]
    owner, found = shingle_hashes(pa.array(texts), 8)

    def plain(text):
        w = [x for x in re.split("[ \n\t\r]+", text or "") if x]
        return {tuple(w[i : i + 8]) for i in range(len(w) - 7)}

    sets = [set(found[owner == i].tolist()) for i in range(len(texts))]
    assert [len(s) for s in sets] == [len(plain(t)) for t in texts] and len(found) == sum(map(len, sets))
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len(sets[i] & sets[j]) == len(plain(a) & plain(b))
    files = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, content string")
    known = spark.createDataFrame([(7, texts[0]), (8, texts[0]), (9, texts[6])], "item int, content string")
    got = signature_overlap(files, known, "id", "item")
    want = {(i, k, len(plain(t) & plain(texts[0])), len(plain(t) & plain(texts[0])) / 2) for i, t in enumerate(texts) for k in (7, 8) if plain(t) & plain(texts[0])}
    assert {tuple(r) for r in got.collect()} == want
    # Shingles are hashed on whole columns and not made as rows of words in the JVM.
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()


def test_obfuscation_of_odd_texts(spark):
    from palisade.operators.detect.code import obfuscation

    texts = [None, "", "plain words only", "x" * 19, "y" * 20, "A1b2" * 10 + "==", "é" * 30, "exec( atob(1)) eval (atob", "\\x41" * 8 + " \\x", "\\x41" * 7, "a\n" + "b " * 1500]
    rows = obfuscation(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, content string"), "id")
    got = {r.id: tuple(r)[1:] for r in rows.collect()}
    # In order: the entropy of the longest tokens, longest line, base64, hex, eval, share of other characters, score.
    assert got[1] == (0.0, 0, 0, 0, 0, None, 0) and got[2] == (0.0, 16, 0, 0, 0, 0.0, 0) and got[3] == (0.0, 19, 0, 0, 0, 0.0, 0)
    assert got[4] == (0.0, 20, 0, 0, 0, 0.0, 0) and got[5][1:] == (42, 1, 0, 0, 0.0, 10) and got[6] == (0.0, 30, 0, 0, 0, 1.0, 10)
    assert got[7][4] == 1 and got[8][3] == 1 and got[9][3] == 0 and got[10][1] == 3000 and got[10][6] == 20
    # One linear test on whole columns keeps the patterns of long tokens from most texts.
    assert "ArrowEvalPython" in rows._jdf.queryExecution().executedPlan().toString()
