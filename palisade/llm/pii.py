r"""Personal data: fixed forms, and identifiers of other forms found by the contexts that fixed forms induce.

Seeds are the addresses, numbers and cards of the fixed forms. Around each identifier the words before and after give lexical
patterns. Candidates are looser forms (digit runs of phone length without a plus, card-length numbers that fail the check, IPv6 addresses,
compressed ones included, spelled-out e-mail). Patterns and instances form a graph, one edge per distinct (kind, pattern, instance) with its mentions;
Spark scores it in rounds: a pattern's confidence is the score of its mentions over the times that its words occur in the
corpus at all, an instance's score the chance that not all of its patterns fail. The graph begins with the patterns that hold
enough seeds and a candidate; candidates that end the rounds above the threshold are seeds of further patterns, which join it,
until none is reached. Only the graph's patterns are counted in the corpus. Candidates that end above the threshold become spans; spans of the fixed forms are never changed.

Nulls: a null text is empty. Every row gives a row, repeated ids and texts included (equal texts have equal spans). An empty
table gives no rows. Other columns are ignored by ``find`` and kept by ``redact``. All scans are linear in the text's length.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import WORD, coded, free_names, slices, split_words
from palisade.llm.tables import filled
from palisade.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_WORD = re.compile(WORD)
BITS = 1 << 23


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            done = m.end()


def base_spans(text: str) -> list[Span]:
    """Fixed forms, leftmost and not overlapping within a kind, by start and then kind."""
    found: list[Span] = []
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) < 4 and int(x[-4:]) <= 255 for x in m[0].split(".")):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() <= 38:
                digits = "".join(_DIGITS.findall(m[0]))
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15:
                    found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# Looser forms of each kind; the context decides.
_LOOSE = (
    ("phone", re.compile(r"(?<![\w+.-])\(?[0-9]{2,5}\)?[ .-][0-9]{2,5}(?:[ .-][0-9]{2,5}){0,3}(?![\w-])")),
    ("card", re.compile(r"(?<![\w.-])[0-9]{3,7}(?:[ -]?[0-9]{2,7}){1,5}(?![\w-])")),
    ("ip", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])")),
)
# Any run of digits, with or without separators; what stands after it is looked at apart, so that the scan stays linear.
_RUN = re.compile(r"(?<![\w+.-])\(?[0-9](?:[ ().-]{0,2}[0-9])*+")
_IPV6 = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
_TAIL = re.compile(r"[\w-]")
_SPELLED = re.compile(r"[\[({] ?at ?[\])}]", re.I)
_BEFORE, _AFTER = re.compile(r"[\w.+-]{1,64} ?\Z"), re.compile(r" ?[\w-]{1,63}(?: ?(?:\.|[\[({] ?dot ?[\])}]) ?[\w-]{1,63}){1,8}", re.I)


def _ipv6(form: str) -> bool:
    """Whether a form with colons is a compressed address other than the empty one."""
    try:
        return "::" in form and form != "::" and ipaddress.IPv6Address(form) is not None
    except ValueError:
        return False


def loose_spans(text: str, taken: list[Span]) -> list[Span]:
    """Candidates that overlap no span of ``taken``.

    The first forms overlap each other nowhere; the wider ones (any run of 7 to 15 digits, compressed IPv6) stand where the first
    do not, or as a phone number over the very place of a card.
    """
    found: list[Span] = []
    wide: list[Span] = []
    if _DIGIT.search(text):
        for kind, form in _LOOSE:
            for m in form.finditer(text):
                n = sum(map(len, _DIGITS.findall(m[0])))
                if kind == "ip" or (kind == "phone" and 7 <= n <= 11) or (kind == "card" and 12 <= n <= 19):
                    found.append((kind, *m.span()))
        for m in _RUN.finditer(text):
            if 7 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15 and not _TAIL.match(text, m.end()):
                wide.append(("phone", *m.span()))
    if "::" in text:
        wide += [("ip", *m.span()) for m in _IPV6.finditer(text) if _ipv6(m[0])]
    for m in _SPELLED.finditer(text):
        a, b = _BEFORE.search(text[max(0, m.start() - 66) : m.start()]), _AFTER.match(text, m.end())
        if a and b:
            found.append(("email", m.start() - len(a[0]), b.end()))
    first = _apart(found, [(a, b) for _, a, b in taken])
    cards = {(a, b) for k, a, b in first if k == "card"}
    twins = [s for s in wide if s[0] == "phone" and s[1:] in cards]
    return sorted([*first, *twins, *_apart(wide, [(a, b) for _, a, b in [*taken, *first]])], key=lambda s: (s[1], KINDS.index(s[0])))


def _apart(found: list[Span], busy: list[tuple[int, int]]) -> list[Span]:
    """Spans that overlap neither ``busy`` nor each other, leftmost and longest first."""
    busy = sorted(busy)
    out, last, i, reach = [], -1, 0, -1
    for s in sorted(found, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        while i < len(busy) and busy[i][0] < s[2]:
            reach = max(reach, busy[i][1])
            i += 1
        if reach <= s[1] and s[1] >= last:
            out.append(s)
            last = s[2]
    return out


def patterns(text: str, span: Span) -> list[str]:
    """Two words before; one word before and one after. Digits count as one sign, case does not count."""
    _, a, b = span
    before = _WORD.findall(_DIGITS.sub("0", text[max(0, a - 160) : a].lower()))[-2:]
    after = _WORD.findall(_DIGITS.sub("0", text[b : b + 80].lower()))[:1]
    out = []
    if len(before) == 2:
        out.append(f"{before[0]} {before[1]} _")
    if before and after:
        out.append(f"{before[-1]} _ {after[0]}")
    return out


def _word_hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(np.asarray(words.to_pandas(), dtype=object), categorize=False)


def _pattern_hash(one: np.ndarray, two: np.ndarray, gap: bool) -> np.ndarray:
    x = one * np.uint64(0x9E3779B97F4A7C15) + two * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(gap)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pattern) to (pattern, hash)."""
    for batch in batches:
        parts = [p.split(" ") for p in batch.column("pattern").to_pylist()]
        gap = np.array([p[1] == "_" for p in parts], dtype=bool)
        one, two = (_word_hashes(pa.array([p[i] if i == 0 or p[1] != "_" else p[2] for p in parts], pa.string())) for i in (0, 1))
        yield pa.RecordBatch.from_pydict({
            "pattern": batch.column("pattern"), "hash": np.where(gap, _pattern_hash(one, two, True), _pattern_hash(one, two, False)).view(np.int64)})


def occurrences(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pattern, occurs): how often the words of each wanted pattern stand in the corpus, whatever fills the gap.

    A bit set of fixed size drops most other word pairs where they are read; the rest are counted per slice, summed and met exactly.
    """
    hashed = cut_lineage(wanted.mapInArrow(_hashed, "pattern string, hash bigint"))

    def mark(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> None:
        for batch in batches:
            table[np.asarray(batch.column("hash")).view(np.uint64) % np.uint64(BITS)] = 1

    shared = texts.sparkSession.sparkContext.broadcast(filled(hashed.select("hash"), mark, BITS, np.maximum).astype(bool))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, at = split_words(batch.column("text"))
            codes, kinds = coded(words)
            if len(codes) < 2:
                continue
            word = _word_hashes(pc.replace_substring_regex(pc.utf8_lower(kinds), "[0-9]+", "0"))[codes]
            owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
            found = []
            for gap in (1, 2):
                same = owner[:-gap] == owner[gap:]
                h = _pattern_hash(word[:-gap][same], word[gap:][same], gap == 2)
                found.append(h[shared.value[h % np.uint64(BITS)]])
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_pydict({"hash": h.view(np.int64), "n": n})

    counted = texts.mapInArrow(count, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("occurs"))
    return hashed.join(counted, "hash", "left").select("pattern", F.coalesce("occurs", F.lit(0)).alias("occurs"))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SPANS = "array<struct<kind: string, start: bigint, end: bigint>>"
SEEN = "array<struct<kind: string, start: bigint, end: bigint, instance: string, seed: boolean, patterns: array<string>>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = {"copy": [], "base": [], "seen": []}
        for text in batch.column("text").to_pylist():
            text = text or ""
            base = base_spans(text)
            loose = loose_spans(text, base)
            rows["copy"].append(hashlib.md5(text.encode()).digest() if loose else None)
            rows["base"].append([{"kind": k, "start": a, "end": b} for k, a, b in base])
            rows["seen"].append([
                {"kind": s[0], "start": s[1], "end": s[2], "instance": text[s[1] : s[2]][:200].lower(), "seed": seed, "patterns": patterns(text, s)}
                for group, seed in ((base, True), (loose, False)) for s in group])
        span = pa.struct({"kind": pa.string(), "start": pa.int64(), "end": pa.int64()})
        seen = pa.struct({**{f.name: f.type for f in span}, "instance": pa.string(), "seed": pa.bool_(), "patterns": pa.list_(pa.string())})
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(rows["copy"], pa.binary()), pa.array(rows["base"], pa.list_(span)), pa.array(rows["seen"], pa.list_(seen))],
            ["doc_id", "copy", "base", "seen"])


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Written table (doc_id, copy, base, seen): spans of the fixed forms, and all mentions with their patterns. No text."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return cut_lineage(src.mapInArrow(_scan, f"doc_id {kind}, copy binary, base {SPANS}, seen {SEEN}"))


def discover(scanned: DataFrame, texts: DataFrame, rounds: int = 3, threshold: float = 0.7, min_seeds: int = 3) -> DataFrame:
    """Written table (copy, found): spans of confident candidates per distinct text; ``texts`` is the corpus (text).

    ``min_seeds``: distinct seeds, of fixed form or discovered, that a pattern needs. While discoveries bring further patterns to
    that number, these join the graph and ``rounds`` more rounds are made. A candidate's mention counts when its instance's score reaches the threshold.
    """
    seen = scanned.select("copy", F.explode("seen").alias("s")).select("copy", "s.*")
    edges = seen.select("kind", "instance", "seed", F.explode("patterns").alias("pattern")).groupBy("kind", "pattern", "instance").agg(
        F.max("seed").alias("seed"), F.count("*").alias("mentions"))
    edges = cut_lineage(edges)
    # A pattern's seeds count as one number; its candidates are the edges that the rounds work on.
    held = cut_lineage(edges.groupBy("kind", "pattern").agg(
        F.sum(F.col("seed").cast("int")).alias("seeds"), F.sum(F.when(F.col("seed"), F.col("mentions")).otherwise(0)).alias("sure_mentions"),
        F.sum("mentions").alias("all_mentions"), F.min("seed").alias("only_seeds")).where(~F.col("only_seeds")).drop("only_seeds"))
    candidates = edges.where(~F.col("seed")).drop("seed")
    score = cut_lineage(candidates.select("kind", "instance").limit(0).withColumn("score", F.lit(0.0)))
    useful = cut_lineage(held.where(F.col("seeds") >= min_seeds))
    fresh, counts = useful, None
    while not fresh.isEmpty():
        more = occurrences(texts, fresh.select("pattern").distinct())
        counts = cut_lineage(more if counts is None else counts.unionByName(more).groupBy("pattern").agg(F.max("occurs").alias("occurs")))
        graph = cut_lineage(candidates.join(useful, ["kind", "pattern"]).join(counts, "pattern").select(
            "kind", "pattern", "instance", "mentions", "sure_mentions", F.greatest("all_mentions", "occurs").alias("n")))
        score = graph.select("kind", "instance").distinct().join(score, ["kind", "instance"], "left").select(
            "kind", "instance", F.coalesce("score", F.lit(0.0)).alias("score"))
        for _ in range(rounds):
            sure = graph.join(score, ["kind", "instance"]).groupBy("kind", "pattern").agg(
                ((F.first("sure_mentions") + F.sum(F.col("score") * F.col("mentions"))) / (F.first("n") + 1)).alias("sure"))
            score = cut_lineage(graph.join(sure, ["kind", "pattern"]).groupBy("kind", "instance").agg(
                (1 - F.exp(F.sum(F.log1p(-F.col("sure"))))).alias("score")))
        # What was discovered is a seed, too: it may bring further patterns to the number they need.
        taught = candidates.join(score.where(F.col("score") >= threshold).select("kind", "instance"), ["kind", "instance"]).groupBy(
            "kind", "pattern").agg(F.count("*").alias("taught"))
        fresh = cut_lineage(held.join(taught, ["kind", "pattern"]).where(F.col("seeds") + F.col("taught") >= min_seeds).drop("taught").join(
            useful, ["kind", "pattern"], "left_anti"))
        useful = cut_lineage(useful.unionByName(fresh))
    known = score.where(F.col("score") >= threshold).select("kind", "instance")
    spans = seen.where(~F.col("seed")).join(known, ["kind", "instance"]).select("copy", F.struct("kind", "start", "end").alias("s")).distinct()
    return cut_lineage(spans.groupBy("copy").agg(F.collect_list("s").alias("found")))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(doc_id, base, found): spans of the fixed forms and discovered ones, per document."""
    scanned = scan(docs, doc_id, text)
    found = discover(scanned, docs.select(F.col(text).alias("text")), **how).withColumnRenamed("copy", "_copy")
    # A null copy has no candidates; it must not gather in one task of the join.
    none = scanned.where(F.col("copy").isNull()).select("doc_id", "base", F.lit(None).cast(SPANS).alias("found"))
    some = scanned.where(F.col("copy").isNotNull()).join(found, F.col("copy") == F.col("_copy"), "left").select("doc_id", "base", "found")
    return none.unionByName(some)


def spans_text(spans: Column) -> Column:
    """Spans as kind:start:end, by start and then kind as listed."""
    order = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(order), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """Counts and digest of the fixed forms, and all spans written out."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    every = F.concat("base", F.coalesce("found", F.array().cast(SPANS)))
    return found.select("doc_id", *map(count, KINDS), F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(every).alias("spans"))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; all columns stay."""
    own, copy, more = free_names(docs, "own", "copy", "found")
    found = discover(scan(docs, doc_id, text), docs.select(F.col(text).alias("text")), **how).select(F.hex("copy").alias(copy), F.col("found").alias(more))
    met = docs.withColumn(own, F.upper(F.md5(F.coalesce(F.col(text), F.lit(""))))).join(found, F.col(own) == F.col(copy), "left").drop(own, copy)

    names = docs.columns

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            out = []
            for t, others in zip(batch.column(text).to_pylist(), batch.column(more).to_pylist(), strict=True):
                if t:
                    parts, at = [], 0
                    every = base_spans(t) + [(s["kind"], s["start"], s["end"]) for s in others or []]
                    for k, a, b in sorted(every, key=lambda s: (s[1], -s[2])):
                        if a >= at:
                            parts += [t[at:a], f"[{k.upper()}]"]
                        at = max(at, b)
                    t = "".join([*parts, t[at:]]) if parts else t
                out.append(t)
            cols = [pa.array(out, pa.string()) if c == text else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(cols, names)

    return met.mapInArrow(replace, docs.schema)
