"""Dependencies: extraction from manifests and risk signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.operators.joins import similar_names


# Flags, then registry (with a port) and path, then the tag. A digest is part of neither.
IMAGE = r"(?i)^from\s+(?:--[a-z]+=\S+\s+)*((?:[^\s/]+/)*[^\s:/@]+)(?::([^\s@]+))?"


URL_SPEC = r"^(git[+]|https?://|file:|[.]{0,2}/)"
DEPENDENCY = "struct<ecosystem: string, name: string, spec: string, scope: string>"


def dependencies(manifests: DataFrame) -> DataFrame:
    """manifests(repo, manifest, module, content) → one normalised row per dependency, in one pass over the manifests.

    The file's name says what is looked for in its text. Options, extras and markers of requirements are no part of a
    name or spec; images that name an earlier stage of the same file, or nothing (``scratch``), are no packages.
    """
    keys = ["repo", "manifest", "module"]
    name = F.element_at(F.split("manifest", "/"), -1)
    text = F.col("content")
    lines = F.split(text, "\r?\n")
    group = lambda x, pattern, i=1: F.regexp_extract(x, pattern, i)

    def dep(ecosystem: str, dep_name: Column, spec: Column, scope: Column | str = "runtime") -> Column:
        scope = F.lit(scope) if isinstance(scope, str) else scope
        return F.struct(F.lit(ecosystem).alias("ecosystem"), dep_name.alias("name"), F.coalesce(spec, F.lit("")).alias("spec"), scope.alias("scope"))

    def each(items: Column, make) -> Column:
        return F.transform(items, make)

    def requirement(x: Column) -> Column:
        """A requirement: name [extras] spec ; marker, ``name @ url``, or a url with its name behind #egg=."""
        x = F.trim(F.regexp_replace(x, r"\s#.*$", ""))
        url = x.rlike(URL_SPEC)
        bare = F.regexp_replace(x, r"\s*;.*$", "")
        named_url = group(bare, r"^[A-Za-z0-9_.-]+\s*(?:\[[^\]]*\])?\s*@\s*(\S+)")
        spec = F.when(named_url != "", named_url).otherwise(F.trim(group(bare, r"^[A-Za-z0-9_.-]+\s*(?:\[[^\]]*\])?\s*(.*)$")))
        return F.when(url, dep("pip", group(x, r"#egg=([A-Za-z0-9_.-]+)"), F.regexp_replace(x, "#.*$", ""))).otherwise(
            dep("pip", group(bare, r"^([A-Za-z0-9_.-]+)"), spec))

    pip = each(F.filter(lines, lambda x: ~x.rlike(r"^\s*(#|$|-)")), requirement)
    packages = "STRUCT<dependencies: MAP<STRING, STRING>, devDependencies: MAP<STRING, STRING>, peerDependencies: MAP<STRING, STRING>, optionalDependencies: MAP<STRING, STRING>>"
    none = F.array().cast(f"array<{DEPENDENCY}>")
    # A lambda of two parameters would be handed the index as its second.
    in_scope = lambda scope: lambda e: dep("npm", e["key"], e["value"], scope)
    npm = F.concat(*[
        F.coalesce(each(F.map_entries(F.from_json(text, packages)[field]), in_scope(scope)), none)
        for field, scope in (("dependencies", "runtime"), ("devDependencies", "dev"), ("peerDependencies", "peer"), ("optionalDependencies", "optional"))])
    froms = F.filter(lines, lambda x: x.rlike(r"(?i)^\s*from\s"))
    staged = F.transform(froms, lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("x"), F.lower(group(x, r"(?i)\sas\s+(\S+)\s*$")).alias("stage")))
    images = F.filter(staged, lambda me: (F.lower(group(me["x"], IMAGE)) != "scratch") & ~F.exists(
        staged, lambda other: (other["i"] < me["i"]) & (other["stage"] != "") & (other["stage"] == F.lower(group(me["x"], IMAGE)))))
    docker = each(images, lambda me: dep("docker", group(me["x"], IMAGE), group(me["x"], IMAGE, 2), "build"))
    all_of = lambda pattern, i=0, src=text: F.regexp_extract_all(src, F.lit(pattern), F.lit(i))
    maven_scope = lambda d: F.when(group(d, "<scope>([^<]*)").isin("", "compile"), F.lit("runtime")).otherwise(group(d, "<scope>([^<]*)"))
    maven = each(all_of(r"(?s)<dependency>.*?</dependency>"), lambda d: dep(
        "maven", F.concat(group(d, "<groupId>([^<]*)"), F.lit(":"), group(d, "<artifactId>([^<]*)")), group(d, "<version>([^<]*)"), maven_scope(d)))
    go = each(F.filter(lines, lambda x: x.rlike(r"^\s*(require +)?[a-z0-9.-]+[.][a-z]+/[^ ]+ v")),
              lambda x: dep("go", group(x, r"^\s*(?:require +)?([^ ]+) v"), group(x, r" (v[^ ]+)")))

    def matched(ecosystem: str, pattern: str, scope: Column | str = "runtime") -> Column:
        """Lines with a name and a spec as the pattern's two groups."""
        return each(F.filter(lines, lambda x: x.rlike(pattern)), lambda x: dep(ecosystem, group(x, pattern), group(x, pattern, 2), scope))

    def blocks(ecosystem: str, block: str, dep_name: str, version: str) -> Column:
        """Lock files: one text block per package, with its name and version."""
        return each(all_of(block), lambda x: dep(ecosystem, group(x, dep_name), group(x, version), "lock"))

    listed = all_of("[\"']([^\"']+)[\"']", 1, group(text, r"(?s)(?:^|\n)dependencies\s*=\s*\[(.*?)\n?\]\s*(?:\n|$)"))
    toml_lock = (r"(?s)\[\[package\]\]\nname = .*?\nversion = [^\n]*", 'name = "([^"]+)"', 'version = "([^"]+)"')
    locked_npm = F.from_json(text, "STRUCT<packages: MAP<STRING, STRUCT<version: STRING>>>")["packages"]
    found = (
        F.when(name.rlike(r"^requirements.*[.]txt$"), pip)
        .when(name == "package.json", npm)
        .when(name.startswith("Dockerfile"), docker)
        .when(name == "pom.xml", maven)
        .when(name == "go.mod", go)
        .when(name == "pyproject.toml", each(listed, requirement))
        .when(name == "poetry.lock", blocks("pip", *toml_lock))
        .when(name == "Cargo.lock", blocks("cargo", *toml_lock))
        .when(name == "yarn.lock", blocks("npm", r'(?m)^"?@?[^\s"#][^\n]*:\n  version[^\n]*', r'^"?(@?[^@"\s]+)@', r'version:? "?([^"\s]+)'))
        .when(name == "package-lock.json", each(F.map_entries(locked_npm), lambda e: dep(
            "npm", group(e["key"], "(?:^|/)node_modules/((?:@[^/]+/)?[^/]+)$"), e["value"]["version"], "lock")))
        .when(name == "Gemfile", matched("gem", r"""^\s*gem\s+["']([^"']+)["'](?:\s*,\s*["']([^"']+)["'])?"""))
        .when(name.rlike(r"^build[.]gradle([.]kts)?$"), matched(
            "maven", r"""^\s*(?:implementation|api|compileOnly|runtimeOnly|testImplementation)[\s(]+["']([^:"']+:[^:"']+):([^"']+)["']"""))
        .when(name.rlike(r"^(docker-)?compose([.-][a-z]+)?[.]ya?ml$"), matched(
            "docker", r"^\s*image:\s*[\"']?((?:[^\s/\"']+/)*[^\s:/@\"']+)(?::([^\s@\"']+))?", "deploy"))
    )
    rows = manifests.select(*keys, F.inline(found)).where(F.col("name") != "")
    return rows.withColumn("version", F.regexp_extract("spec", r"([0-9]+(?:[.][0-9A-Za-z]+)*)", 1))


def spec_signals(spec: Column) -> Column:
    """Static risk signals of a version spec, as an array."""
    return F.array_compact(F.array(
        F.when(spec.isin("", "*", "latest"), F.lit("wildcard")),
        F.when(spec.rlike(r"^[\^~]|^[<>]|^!=|[.][xX*]$|^[xX]$|[0-9] *[,|-] *[<>]|\|\||[0-9] - [0-9]"), F.lit("range")),
        F.when(spec.rlike(r"(?i)[0-9.-](alpha|beta|a|b|rc|dev)[.-]?[0-9]*$"), F.lit("pre_release")),
        F.when(spec.rlike(r"^(git|https?)[:+]"), F.lit("url")),
    ))


# How far before its release a pre-release stands.
STAGES = {"dev": 0, "a": 1, "alpha": 1, "b": 2, "beta": 2, "rc": 3, "pre": 3}


def version_key(version: Column) -> Column:
    """A version as (numbers, stage, stage number), which compares like versions.

    Zeros at the end do not count (1.2 is 1.2.0); a pre-release comes before its release. NULL if it does not start with a number.
    """
    numbers = F.regexp_extract(version, r"^[vV=]*([0-9]+(?:[.][0-9]+)*)", 1)
    stage = F.lower(F.regexp_extract(version, r"^[vV=]*[0-9.]+[._-]?([A-Za-z]+)", 1))
    nth = F.regexp_extract(version, r"^[vV=]*[0-9.]+[._-]?[A-Za-z]+[._-]?([0-9]+)", 1)
    rank = F.create_map(*[F.lit(x) for pair in STAGES.items() for x in pair])
    return F.when(numbers != "", F.struct(
        F.transform(F.split(F.regexp_replace(numbers, "([.]0+)+$", ""), "[.]"), lambda p: p.try_cast("decimal(38,0)")).alias("numbers"),
        F.coalesce(F.try_element_at(rank, stage), F.lit(9)).alias("stage"), F.coalesce(nth.try_cast("bigint"), F.lit(0)).alias("nth"),
    ))


def risk_signals(deps: DataFrame, internal: DataFrame | None = None, advisories: DataFrame | None = None) -> DataFrame:
    """(…deps, signal): spec signals, private-name clashes and advisories whose range covers the version.

    advisories(name, fixed) or (name, introduced, fixed): a version is affected from ``introduced`` (default: any) up to, not including, ``fixed``
    (null: not fixed yet).
    """
    out = deps.select("*", F.explode(spec_signals(F.col("spec"))).alias("signal"))
    if internal is not None:
        own = internal.select(F.col("name").alias("_n")).distinct()
        clash = deps.join(own, deps.name == F.col("_n"), "left_semi").select("*", F.lit("private_name").alias("signal"))
        out = out.unionByName(clash)
    if advisories is not None:
        since = F.col("introduced") if "introduced" in advisories.columns else F.lit(None).cast("string")
        adv = advisories.select(F.col("name").alias("_n"), since.alias("_since"), F.col("fixed").alias("_fixed"))
        own, low, high = (version_key(F.col(c)) for c in ("version", "_since", "_fixed"))
        hit = deps.join(adv, deps.name == F.col("_n")).where(
            own.isNotNull() & (F.col("_since").isNull() | (own >= low)) & (F.col("_fixed").isNull() | (own < high)))
        out = out.unionByName(hit.select(*deps.columns, F.lit("advisory").alias("signal")).distinct())
    return out


def missing_locks(manifests: DataFrame) -> DataFrame:
    """Repos with a manifest but no lock file."""
    lock = F.col("manifest").rlike(r"(package-lock[.]json|yarn[.]lock|poetry[.]lock|go[.]sum|requirements[.]lock|Cargo[.]lock|Gemfile[.]lock)$")
    return manifests.groupBy("repo").agg(F.max(lock).alias("_l"), F.count("*").alias("manifests")).where(~F.col("_l")).drop("_l")


def typosquats(deps: DataFrame, popular: DataFrame, k: int = 2) -> DataFrame:
    return similar_names(deps, popular, "name", k)
