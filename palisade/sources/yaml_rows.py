"""YAML text as rows of (path, value), read from lines: no file is parsed as a whole.

What a line belongs to follows from indentation: a stack of the keys and list items above it. A stretch of lines turns the stack
it meets into another one by cutting it at the stretch's least indentation and putting its own end on top, so stretches compose:
the lines of all files are dealt by ranges of (file, n), every task keeps the stack of its stretch, and only one stack per range
and file is carried on. A file of any size is read by many tasks.

A value that goes on over deeper lines (plain, quoted, flow, literal or folded) is an entry of the stack that is marked as open;
lines below the outermost such entry are its text, whatever they look like. Read are block maps and lists, flow collections,
plain, quoted, literal and folded scalars, comments and several documents. Anchors and tags are skipped, aliases are kept as
text; ``? `` keys are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.session import cut_lineage

# Ranks order what encloses what: a list item may stand at its key's indentation, and is inside it.
KEY, ITEM, TEXT, STEP = 0, 2, -1, 4
DOCUMENT = -2
DEEPEST = 1 << 30

ENTRY = "struct<rank: int, label: string, item: boolean, nth: bigint, again: boolean, at: bigint, open: string>"
ENTRIES = f"array<{ENTRY}>"
QUOTED = re.compile(r'"(?:[^"\\]|\\.)*"|\'(?:[^\']|\'\')*\'')
PLAIN_KEY = re.compile(r"([^\s\[\]{}#&*!|>'\"%@`,].*?|-\S.*?)\s*:(?:\s+|$)")
BLOCK = re.compile(r"([|>])([0-9+-]*)\s*(?:#.*)?$")
PROPERTY = re.compile(r"(?:[!&]\S*\s+)+|[!&]\S*$")
COMMENT = re.compile(r"\s+#.*$")
FLOW = re.compile(r"\s*(?:([\[\]{},])|(:)(?=\s|$|[\[\]{},\"'])|(\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*')|((?:[^\s\[\]{},:]|:(?=[^\s,\[\]{}]))(?:[^\[\]{},:]|:(?=[^\s,\[\]{}]))*))\s*")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "a": "\a", "f": "\f", "v": "\v", "e": "\x1b", "N": "\x85", "_": "\xa0"}


def unquoted(text: str) -> str:
    if text[:1] == "'":
        return text[1:-1].replace("''", "'")
    code = r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|(.))"
    return re.sub(code, lambda m: chr(int(m[1] or m[2] or m[3], 16)) if m[4] is None else ESCAPES.get(m[4], m[4]), text[1:-1], flags=re.S)


def typed(text: str) -> tuple[str, str | None]:
    """(type, value) of a plain scalar."""
    low = text.lower()
    if low in ("", "~", "null"):
        return "null", None
    if low in ("true", "false"):
        return "boolean", low
    if re.fullmatch(r"[-+]?([0-9]+|0x[0-9a-f]+|0o[0-7]+)", low):
        return "integer", text
    if re.fullmatch(r"[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[-+]?[0-9]+)?", low):
        return "number", text
    return "string", text


def flow_leaves(text: str) -> Iterator[tuple[list[str], str, str | None]]:
    """(path, type, value) of the leaves of a flow collection; an empty collection is a leaf."""
    path: list[str] = []
    stack: list[list] = []  # [is a list, entries so far, value seen]
    key = None

    def leaf(kind: str, value: str | None):
        nonlocal key
        if stack:
            top = stack[-1]
            name = str(top[1]) if top[0] else key if key is not None else value or ""
            out = ([*path, name], *((kind, value) if top[0] or key is not None else ("null", None)))
            top[1], top[2], key = top[1] + 1, True, None
            return out
        return path[:], kind, value

    at, waiting = 0, None  # a scalar that may turn out to be a key
    while at < len(text) and (m := FLOW.match(text, at)) and m.end() > at:
        at = m.end()
        mark, colon, quoted, plain = m.groups()
        if quoted is not None or plain is not None:
            waiting = ("string", unquoted(quoted)) if quoted is not None else typed(plain.strip())
            if plain is not None:
                waiting = (*waiting, plain.strip())
        elif colon:
            key, waiting = (waiting[2] if len(waiting) > 2 else waiting[1]) if waiting else "", None
        elif mark in "[{":
            if stack:
                path.append(str(stack[-1][1]) if stack[-1][0] else key or "")
                stack[-1][1], stack[-1][2], key = stack[-1][1] + 1, True, None
            stack.append([mark == "[", 0, False])
        else:
            if waiting or key is not None:
                yield leaf(*(waiting[:2] if waiting else ("null", None)))
                waiting = None
            if mark in "]}" and stack:
                top = stack.pop()
                if not top[2]:
                    yield path[:], "array" if top[0] else "object", None
                if stack:
                    path.pop()


def closed(text: str) -> bool:
    """Whether a quoted or flow value ends where the text ends, a comment aside."""
    if text[0] in "'\"":
        return QUOTED.match(text) is not None
    depth = 0
    for m in re.finditer(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[\[\]{}]", text):
        depth += (m[0] in "[{") - (m[0] in "]}")
    return depth <= 0


def value_kind(text: str) -> tuple[str, str]:
    """(open, text) of what follows a key or a dash: block, quote, flow, plain, done (a whole value) or nothing."""
    text = PROPERTY.sub("", text, count=1) if text[:1] in "!&" else text
    if not text or text[0] == "#":
        return "", ""
    if BLOCK.match(text):
        return "block", COMMENT.sub("", text)
    if text[0] in "'\"":
        m = QUOTED.match(text)
        return ("done", m[0]) if m else ("quote", text)
    if text[0] in "[{":
        return ("done", text) if closed(text) else ("flow", text)
    return "plain", COMMENT.sub("", text).rstrip()


def parts(line: str) -> tuple[int, list[tuple[int, str | None]], str]:
    """(column, entries, rest) of a line: (rank, key, or null for an item) from the outside in, and the text behind them."""
    col = len(line) - len(line.lstrip(" "))
    rest, entries = line[col:].rstrip(), []
    at = col
    while rest == "-" or rest.startswith(("- ", "-\t")):
        entries.append((STEP * at + ITEM, None))
        shorter = rest[1:].lstrip()
        at += len(rest) - len(shorter)
        rest = shorter
    m = QUOTED.match(rest)
    if m:
        after = rest[m.end():].lstrip()
        if after == ":" or after.startswith((": ", ":\t")):
            entries.append((STEP * at + KEY, unquoted(m[0])))
            return at, entries, after[1:].lstrip()
    elif rest[:1] not in ("[", "{", "'", '"'):
        tagged = PROPERTY.sub("", rest, count=1) if rest[:1] in "!&" else rest
        if (m := PLAIN_KEY.match(tagged)) and " #" not in m[1]:
            entries.append((STEP * at + KEY, m[1]))
            return at, entries, tagged[m.end():]
    return at, entries, rest


class Stretch:
    """The stack of a stretch of lines of one file, which does not know what came before."""

    def __init__(self) -> None:
        self.stack: list[dict] = []
        self.least = DEEPEST

    def push(self, rank: int, label: str | None, at: int, item: bool) -> None:
        self.least = min(self.least, rank)
        nth, again = 0, False
        while self.stack and self.stack[-1]["rank"] > rank:
            self.stack.pop()
        if self.stack and self.stack[-1]["rank"] == rank:
            last = self.stack.pop()
            if item and last["item"]:
                nth, again = last["nth"] + 1, last["again"]
        elif item:
            again = not self.stack  # an earlier stretch may hold items of this list
        self.stack.append({"rank": rank, "label": label, "item": item, "nth": nth, "again": again, "at": at, "open": ""})

    def line(self, n: int, text: str) -> dict:
        """The line's row: its entries on the stack, what kind of line it is, and its text."""
        bare = text.strip()
        if not bare or bare[0] == "#":
            rank = STEP * (len(text) - len(text.lstrip(" "))) if bare else DEEPEST
            return self._row(n, "comment" if bare else "blank", text, rank, text)
        if text[:3] in ("---", "...") and (len(text.rstrip()) == 3 or text[3] in " \t"):
            if text[:3] == "---":
                self.push(DOCUMENT, None, n, True)
            return self._row(n, "comment", text, DOCUMENT, text)
        col, entries, rest = parts(text)
        if self._inside(STEP * col if not entries else entries[0][0]):
            # Text of an open value seen in this stretch: it changes nothing.
            return self._row(n, "text", text, entries[0][0] if entries else STEP * col, text)
        if not entries:
            kind, _ = value_kind(rest)
            row = self._row(n, "text", text, STEP * col, text)
            if kind in ("quote", "flow"):
                self.push(STEP * col + TEXT, None, n, False)
                self.stack[-1]["open"] = "more"
            return row
        for rank, label in entries:
            self.push(rank, label, n, label is None)
        kind, value = value_kind(rest)
        if kind not in ("", "done"):
            self.stack[-1]["open"] = kind
        return self._row(n, "node:" + kind, value, DEEPEST, text)

    def _inside(self, rank: int) -> bool:
        for e in self.stack:  # from the outside in: the first that is open is the outermost
            if e["open"]:
                return e["rank"] < rank
        return False

    def _row(self, n: int, kind: str, value: str, rank: int, text: str) -> dict:
        return {"n": n, "kind": kind, "value": value, "least": min(self.least, rank), "text": text,
                "entries": [e for e in self.stack if e["rank"] < rank]}  # an entry does not change once a row holds it


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (file, n, text), in order, to rows; behind the last line of a file in a task a row with its stack."""
    part, now, name = TaskContext.get().partitionId(), None, None
    kinds = {"file": pa.string(), "part": pa.int32(), "n": pa.int64(), "kind": pa.string(), "value": pa.string(), "least": pa.int32(), "text": pa.string()}
    fields = {"rank": pa.int32(), "label": pa.string(), "item": pa.bool_(), "nth": pa.int64(), "again": pa.bool_(), "at": pa.int64(), "open": pa.string()}

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        held = [e for r in rows for e in r["entries"]]
        ends = list(accumulate((len(r["entries"]) for r in rows), initial=0))
        entries = pa.StructArray.from_arrays([pa.array([e[f] for e in held], t) for f, t in fields.items()], list(fields))
        columns = {c: pa.array([r[c] for r in rows], t) for c, t in kinds.items()}
        return pa.RecordBatch.from_pydict(columns | {"entries": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)})

    def end() -> dict:
        return {"file": name, "part": part, "n": None, "kind": "end", "value": None, "least": now.least, "text": None, "entries": now.stack}

    for batch in batches:
        rows = []
        for file, n, text in zip(*[batch.column(c).to_pylist() for c in ("file", "n", "text")], strict=True):
            if now is None or file != name:
                if now is not None:
                    rows.append(end())
                now, name = Stretch(), file
            row = now.line(n, text or "")
            row["file"], row["part"] = file, part
            rows.append(row)
            if len(rows) >= 2000:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)
    if now is not None:
        yield batch_of([end()])


def joined_stack(before: list[dict], least: int, entries: list[dict]) -> list[dict]:
    """The stack behind a stretch, from the one ahead of it."""
    entries = [dict(e) for e in entries]
    if entries and entries[0]["again"]:
        for e in before:
            if e["rank"] == entries[0]["rank"] and e["item"]:
                entries[0] |= {"nth": entries[0]["nth"] + e["nth"] + 1, "again": e["again"]}
    return [dict(e) for e in before if e["rank"] < least] + entries


def yaml_rows(lines: DataFrame, partitions: int | None = None) -> DataFrame:
    """lines(file, n, text) → leaves (file, doc, n, path, type, value); an empty collection is a leaf."""
    src = lines.select(F.col("file").cast("string").alias("file"), F.col("n").cast("bigint").alias("n"), "text")
    dealt = src.repartitionByRange(partitions, "file", "n") if partitions else src.repartitionByRange("file", "n")
    rows = cut_lineage(dealt.sortWithinPartitions("file", "n").mapInArrow(
        scan, f"file string, part int, n bigint, kind string, value string, least int, text string, entries {ENTRIES}"))
    ends = rows.where("kind = 'end'").select("file", "part", "least", "entries")
    # Files that lie in several ranges: at most two a range, or one file in all.
    several = ends.groupBy("file").agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select("file")
    entries_type = rows.schema["entries"].dataType

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, stack = None, []
        for batch in batches:
            met = []
            for file, least, entries in zip(*[batch.column(c).to_pylist() for c in ("file", "least", "entries")], strict=True):
                stack = stack if file == name else []
                met.append(stack)
                name, stack = file, joined_stack(stack, least, entries)
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("part"), pa.array(met, batch.schema.field("entries").type)], ["file", "part", "before"])

    carried = cut_lineage(ends.join(F.broadcast(several), "file").repartition("file").sortWithinPartitions("file", "part").mapInArrow(
        carry, f"file string, part int, before {entries_type.simpleString()}"))
    met = rows.where("kind <> 'end'").join(F.broadcast(carried), ["file", "part"], "left")
    none = F.array().cast(ENTRIES)
    first = F.get("entries", F.lit(0))
    earlier = F.get(F.filter(F.coalesce("before", none), lambda e: (e["rank"] == first["rank"]) & e["item"]), F.lit(0))
    shift = F.when(F.coalesce(first["again"], F.lit(False)), F.coalesce(earlier["nth"] + 1, F.lit(0))).otherwise(F.lit(0))
    own = F.transform("entries", lambda e, i: F.when(i == 0, e.withField("nth", e["nth"] + F.col("_shift"))).otherwise(e))
    above = F.filter(F.coalesce("before", none), lambda e: e["rank"] < F.col("least"))
    full = met.withColumn("_shift", shift.cast("bigint")).withColumn("all", F.concat(above, own)).select("file", "n", "kind", "value", "text", "all")
    # The outermost open value above a line, its own entry aside, holds the line as text; other text belongs to what it stands below.
    is_node = F.startswith("kind", F.lit("node:"))
    over = F.when(is_node, F.slice("all", F.lit(1), F.size("all") - 1)).otherwise(F.col("all"))
    nth_open = F.array_position(F.transform(over, lambda e: e["open"] != ""), True).cast("int")
    placed = full.withColumn("_over", over).withColumn("_nth", nth_open)
    holder = F.get("_over", F.col("_nth") - 1)
    # A value that begins on a line of its own belongs to what is above it.
    above_it = F.get("_over", F.when(F.col("_nth") == 0, F.size("_over") - 1).otherwise(F.col("_nth") - 2))
    key_of = lambda e: F.struct(e["at"].alias("at"), e["rank"].alias("rank"))
    document = F.struct(F.lit(-1).cast("bigint").alias("at"), F.lit(DOCUMENT).alias("rank"))
    placed = cut_lineage(placed.withColumn("_owner", F.when((F.col("_nth") > 0) & (holder["open"] != "more"), key_of(holder)).when(
        (F.col("_nth") > 0) | (F.col("kind") == "text"), F.when(above_it.isNotNull(), key_of(above_it)).otherwise(document))).drop("_over", "_nth"))
    texts = placed.where(F.col("_owner").isNotNull()).groupBy("file", F.col("_owner.at").alias("at"), F.col("_owner.rank").alias("rank")).agg(
        F.array_sort(F.collect_list(F.struct("n", F.when(F.col("kind") == "comment", F.lit(True)).otherwise(F.lit(False)).alias("comment"), "text"))).alias("lines"))
    nodes = placed.where(F.col("_owner").isNull() & is_node)
    me, parent = F.element_at("all", -1), F.get("all", F.size("all") - 2)
    nodes = nodes.select("file", "n", F.substring("kind", 6, 10).alias("open"), "value", "all", me["at"].alias("at"), me["rank"].alias("rank"))
    # A key or item is a parent if another entry stands on it; the line that makes the other one says so.
    below = F.filter(F.slice("all", F.lit(1), F.size("all") - 1), lambda e, i: F.get("all", i + 1)["at"] == F.col("n"))
    parents = nodes.select("file", F.explode(F.transform(below, key_of)).alias("p")).select("file", "p.at", "p.rank").distinct()
    label = lambda e: F.when(e["item"], e["nth"].cast("string")).otherwise(e["label"])
    is_document = lambda e: e["rank"] == DOCUMENT
    leaves = nodes.join(parents, ["file", "at", "rank"], "left_anti").join(texts, ["file", "at", "rank"], "left").select(
        "file", F.coalesce(F.get(F.filter("all", is_document), F.lit(0))["nth"] + 1, F.lit(0)).cast("bigint").alias("doc"), "n", "open", "value",
        F.transform(F.filter("all", lambda e: ~is_document(e)), label).alias("path"), "lines",
        F.floor(F.coalesce(parent["rank"], F.lit(0)) / STEP).cast("int").alias("column"))
    # Text below no key: a document that is one scalar or flow collection.
    bare = texts.where(F.col("rank") == DOCUMENT).select(
        "file", F.lit(0).cast("bigint").alias("doc"), F.get("lines", F.lit(0))["n"].alias("n"), F.lit("plain").alias("open"), F.lit("").alias("value"),
        F.array().cast("array<string>").alias("path"), "lines", F.lit(0).alias("column"))
    return leaves.unionByName(bare).mapInArrow(values, "file string, doc bigint, n bigint, path array<string>, type string, value string")


def folded(lines: list[str]) -> str:
    out, gap = "", 0
    for i, x in enumerate(lines):
        if not x:
            gap += 1
            continue
        out += ("\n" * gap if gap else " " if i else "") + x
        gap = 0
    return out


def block_text(header: str, lines: list[str], column: int) -> str:
    style, more = BLOCK.match(header).groups()
    digits = re.sub("[+-]", "", more)
    filled = [x for x in lines if x.strip()]
    indent = column + int(digits) if digits else len(filled[0]) - len(filled[0].lstrip(" ")) if filled else 0
    body = [x[indent:] if x.strip() or len(x) > indent else "" for x in lines]
    blanks = 0
    while body and not body[-1].strip():
        body.pop()
        blanks += 1
    if style == "|":
        text = "\n".join(body)
    else:
        text, gap, deep = "", 0, False
        for i, x in enumerate(body):
            if not x:
                gap += 1
                continue
            own = x[0] in " \t"
            text += ("\n" * (gap + (deep or own)) if gap or deep or own else " ") + x if text or gap else x
            gap, deep = 0, own
    if not body:
        return "\n" * blanks if "+" in more else ""
    return text + ("" if "-" in more else "\n" * (1 + blanks) if "+" in more else "\n")


def value_of(kind: str, value: str, lines: list[dict], column: int) -> Iterator[tuple[list[str], str, str | None]]:
    """Leaves (path below the node, type, value) of a node's text."""
    if kind == "block":
        yield [], "string", block_text(value, [x["text"] for x in lines], column)
        return
    quote = value[:1] in ("'", '"')
    more = [x["text"].strip() for x in lines if quote or not x["comment"]]
    if not value and more:  # the value begins below its key
        while more and not more[0]:
            more.pop(0)
        quote = bool(more) and more[0][:1] in ("'", '"')
    if not quote:
        more = [COMMENT.sub("", x) for x in more]
    while more and not more[-1]:
        more.pop()
    text = folded([x for x in ([value] if value else []) + more])
    if text[:1] in ("[", "{"):
        yield from flow_leaves(text)
    elif quote and (m := QUOTED.match(text)):
        yield [], "string", unquoted(m[0])
    else:
        yield [], *typed(text)


def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("file", "doc", "n", "path", "type", "value")}
        file, doc, n, above, *texts = (batch.column(c).to_pylist() for c in ("file", "doc", "n", "path", "open", "value", "lines", "column"))
        for row, (opened, text, lines, column) in enumerate(zip(*texts, strict=True)):
            for path, kind, value in value_of(opened, text or "", lines or [], column):
                for c, v in zip(out.values(), (file[row], doc[row], n[row], above[row] + path, kind, value), strict=True):
                    c.append(v)
        kinds = {"file": pa.string(), "doc": pa.int64(), "n": pa.int64(), "path": pa.list_(pa.string()), "type": pa.string(), "value": pa.string()}
        yield pa.RecordBatch.from_pydict({c: pa.array(out[c], t) for c, t in kinds.items()})


def text_lines(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Files held as rows → lines(file, n, text)."""
    return files.select(F.col(path).alias("file"), F.posexplode(F.split(content, "\r?\n")).alias("n", "text"))
