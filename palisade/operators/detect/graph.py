"""Code and link graphs: degrees, reachability, components, cycles and resolved imports, by iterated joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.session import cut_lineage


def degrees(edges: DataFrame) -> DataFrame:
    """Fan-in and fan-out per node; counted per task before the shuffle."""
    ends = edges.select("src", "dst").distinct().select(
        F.inline(F.array(
            F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
            F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")),
        ))
    )
    return ends.groupBy("node").agg(F.sum("o").alias("fan_out"), F.sum("i").alias("fan_in"))


def reach(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Nodes reachable from the roots with their distance (breadth first), as deep as the graph goes.

    ``max_depth`` asks for the nodes within that distance only.

    One join per level; the edges and every frontier are written tables, so the plan does not grow,
    and the loop ends with the first empty level.
    """
    steps = cut_lineage(edges.select("src", "dst").distinct())
    seen = cut_lineage(roots.select(F.col(roots.columns[0]).alias("node")).distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = (
            frontier.join(steps, frontier.node == steps.src)
            .select(F.col("dst").alias("node")).distinct()
            .join(seen.select("node"), "node", "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        frontier = cut_lineage(step)
        if frontier.isEmpty():
            return seen
        # A plan over written parts: it holds one scan per level, folded every eighth.
        seen = seen.unionByName(frontier) if depth % 8 else cut_lineage(seen.unionByName(frontier))
    return seen


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Connected components as (node, component = smallest node).

    Every round hooks each node to the smallest label around it and then jumps
    to that label's label, which shortens long chains by more than one step a
    round; the loop ends when no label moves. Minima are taken per task first: a hub does not gather its edges.
    """
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    both = cut_lineage(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut_lineage(nodes.select(F.col(nodes.columns[0]).alias("node")).distinct().withColumn("label", F.col("node")))
    while True:
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("label").alias("m"))
        hooked = label.join(near, label.node == near.a, "left").select(
            "node", F.col("label").alias("old"), F.least("label", F.coalesce("m", F.col("label"))).alias("label")
        )
        hooked = cut_lineage(hooked)
        jump = hooked.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        jumped = hooked.join(jump, hooked.label == F.col("_n"), "left").select(
            "node", "old", F.least("label", F.coalesce("_l", F.col("label"))).alias("label")
        )
        jumped = cut_lineage(jumped)
        if jumped.where(F.col("label") != F.col("old")).isEmpty():
            return jumped.select("node", F.col("label").alias("component"))
        label = jumped.select("node", "label")


def strong_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Strongly connected components as (node, component = smallest node), by forward and backward colouring.

    A round first peels off nodes without a step in or without a step out, which are components of their own. Every other node
    then takes the smallest node that reaches it as its colour; a node of its own colour is the smallest of its component, and
    the component is what reaches it backwards within the colour. What is left goes into the next round. All steps are joins
    on written tables; no component is ever gathered.
    """
    left = cut_lineage(nodes.select(F.col(nodes.columns[0]).alias("node")).distinct())
    steps = cut_lineage(edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct())
    done = []
    while not left.isEmpty():
        left, steps, single = _peeled(left, steps)
        done.append(single.select("node", F.col("node").alias("component")))
        if left.isEmpty():
            break
        colour = _smallest_ancestor(left, steps)
        a, b = (colour.select(F.col("node").alias(end), F.col("colour").alias(f"c_{end}")) for end in ("src", "dst"))
        same = cut_lineage(steps.join(a, "src").join(b, "dst").where(F.col("c_src") == F.col("c_dst")).select("src", "dst"))
        roots = colour.where(F.col("node") == F.col("colour")).select("node")
        back = reach(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")), roots)
        found = cut_lineage(back.select("node").join(colour, "node").select("node", F.col("colour").alias("component")))
        done.append(found)
        left, steps = _without(left, steps, found)
    out = done[0] if done else left.select("node", F.col("node").alias("component"))
    for more in done[1:]:
        out = out.unionByName(more)
    return cut_lineage(out)


def _without(left: DataFrame, steps: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = gone.select("node")
    rest = cut_lineage(left.join(gone, "node", "left_anti"))
    ahead = steps.join(gone.withColumnRenamed("node", "src"), "src", "left_anti")
    return rest, cut_lineage(ahead.join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))


def _peeled(left: DataFrame, steps: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left without the nodes that lie on no cycle because nothing leads to them or on from them, and these."""
    gone = left.limit(0)
    while True:
        on = steps.select(F.col("src").alias("node")).distinct().join(steps.select(F.col("dst").alias("node")).distinct(), "node", "left_semi")
        ends = cut_lineage(left.join(on, "node", "left_anti"))
        if ends.isEmpty():
            return left, steps, gone
        gone = cut_lineage(gone.unionByName(ends))
        left, steps = _without(left, steps, ends)


def _smallest_ancestor(left: DataFrame, steps: DataFrame) -> DataFrame:
    """(node, colour): the smallest node that leads to each node, itself included; only nodes that changed send on."""
    colour = cut_lineage(left.select("node", F.col("node").alias("colour")))
    moved = colour
    while True:
        sent = moved.join(steps, moved.node == steps.src).groupBy("dst").agg(F.min("colour").alias("new"))
        new = cut_lineage(colour.join(sent, colour.node == sent.dst, "left").select(
            "node", F.least("colour", F.coalesce("new", "colour")).alias("colour"), (F.col("new") < F.col("colour")).alias("less")))
        moved = new.where("less").select("node", "colour")
        colour = new.select("node", "colour")
        if moved.isEmpty():
            return colour


def closure(edges: DataFrame, component: DataFrame) -> DataFrame:
    """(component, reaches): all pairs of different components, the second reachable from the first.

    The condensation has no cycles, so a level's new pairs are the last level's new pairs with one more step in front.
    """
    a, b = (component.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}")) for end in ("src", "dst"))
    steps = cut_lineage(edges.join(a, "src").join(b, "dst").where(F.col("c_src") != F.col("c_dst")).select(
        F.col("c_src").alias("component"), F.col("c_dst").alias("reaches")).distinct())
    ahead = steps.select(F.col("component").alias("first"), F.col("reaches").alias("component"))
    pairs, new, level = steps, steps, 0
    while True:
        level += 1
        longer = new.join(ahead, "component").select(F.col("first").alias("component"), "reaches").distinct()
        new = cut_lineage(longer.join(pairs, ["component", "reaches"], "left_anti"))
        if new.isEmpty():
            return pairs
        pairs = pairs.unionByName(new) if level % 8 else cut_lineage(pairs.unionByName(new))


def suffixes(path: Column) -> Column:
    """All endings of a path at a slash: (suffix, parts), the whole path included."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(F.array_join(F.slice(parts, n - k + 1, k), "/").alias("suffix"), k.alias("parts")))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports(repo, src, dst module) and files(repo, path) → (repo, src, module, file); file is null for what is not in the repository.

    A dotted module is a path without its ending; ``./`` and ``../`` are taken from the importing file's folder. A file is found
    by the longest ending that it shares with the module: the whole module, or else at least two parts of it. Among equals the
    file that shares most leading folders with the importer wins, then the shortest and smallest path. Endings of paths meet
    endings of modules in one equi-join on (repo, ending); a module that many files import is looked up once.
    """
    stem = F.regexp_replace(F.regexp_replace("path", r"[.][A-Za-z0-9]+$", ""), r"/(__init__|index)$", "")
    index = files.select("repo", F.col("path").alias("file"), F.explode(suffixes(stem)).alias("s")).select("repo", "file", F.col("s.suffix").alias("suffix"))
    folder = F.regexp_replace("src", r"[^/]*$", "")
    # ./x, ../x and .x are relative; each further .. leaves a folder.
    relative = F.col("module").rlike(r"^[.]")
    rest = F.regexp_replace("module", r"^[./]+", "")
    ups = F.when(F.contains("module", F.lit("/")), F.size(F.split("module", r"[.][.]/", -1)) - 1).otherwise(F.length(F.regexp_extract("module", r"^[.]+", 0)) - 1)
    base = F.split(F.regexp_replace(folder, "/$", ""), "/")
    up = F.concat_ws("/", F.filter(F.slice(base, F.lit(1), F.greatest(F.size(base) - ups, F.lit(0))), lambda x: x != ""))
    slashed = F.when(F.contains("module", F.lit("/")), F.regexp_replace(rest, r"[.][A-Za-z0-9]+$", "")).otherwise(F.replace(rest, F.lit("."), F.lit("/")))
    asked = imports.select("repo", "src", F.col("dst").alias("module")).distinct()
    asked = asked.withColumn("_want", F.when(relative, F.concat_ws("/", F.nullif(up, F.lit("")), slashed)).otherwise(slashed)).withColumn("_relative", relative)
    wants = asked.select("repo", "_want", "_relative").distinct()
    n = F.size(F.split("_want", "/"))
    keys = wants.withColumn("_n", n).select("repo", "_want", "_relative", "_n", F.explode(suffixes(F.col("_want"))).alias("s")).select(
        "repo", "_want", "_relative", "_n", F.col("s.suffix").alias("suffix"), F.col("s.parts").alias("_parts"))
    keys = keys.where((F.col("_parts") == F.col("_n")) | ((F.col("_parts") > 1) & ~F.col("_relative")))
    hits = cut_lineage(keys.join(index, ["repo", "suffix"]))
    longest = hits.groupBy("repo", "_want", "_relative").agg(F.max("_parts").alias("_parts"))
    able = hits.join(longest, ["repo", "_want", "_relative", "_parts"]).select("repo", "_want", "_relative", "file")
    # A relative module names one file; its path from the root is known.
    exact = F.regexp_replace(F.regexp_replace("file", r"[.][A-Za-z0-9]+$", ""), r"/(__init__|index)$", "") == F.col("_want")
    able = able.where(~F.col("_relative") | exact)
    shared = F.size(F.filter(F.arrays_zip(F.split("src", "/").alias("a"), F.split("file", "/").alias("b")), lambda x: x["a"] == x["b"]))
    best = asked.join(able, ["repo", "_want", "_relative"]).where(F.col("file") != F.col("src")).groupBy("repo", "src", "module").agg(
        F.min(F.struct((-shared).alias("far"), F.length("file").alias("size"), "file"))["file"].alias("file"))
    return asked.join(best, ["repo", "src", "module"], "left").select("repo", "src", "module", "file")


def code_graph(resolved: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, path, component, cycle_files, reaches): a file's import cycle, its size, and how many other files it leads to."""
    name = lambda path: F.concat_ws("\x01", "repo", path)
    edges = cut_lineage(resolved.where(F.col("file").isNotNull()).select(name("src").alias("src"), name("file").alias("dst")).distinct())
    nodes = files.select(name("path").alias("node")).distinct()
    component = strong_components(edges, nodes)
    sizes = component.groupBy("component").agg(F.count("*").alias("n"))
    reached = closure(edges, component).join(sizes.withColumnRenamed("component", "reaches"), "reaches").groupBy("component").agg(F.sum("n").alias("beyond"))
    part = lambda c, i: F.split(c, "\x01")[i]
    return component.join(sizes, "component").join(reached, "component", "left").select(
        part("node", 0).alias("repo"), part("node", 1).alias("path"), part("component", 1).alias("component"), F.col("n").alias("cycle_files"),
        (F.coalesce("beyond", F.lit(0)) + F.col("n") - 1).alias("reaches"))
