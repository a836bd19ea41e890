"""Spelling variants: words that differ by one letter, found by walking a distributed trie, and each word's commoner form.

Words are counted over whole texts. Every word length has a trie of its own and one of the reversed words; a node is the hash of
(direction, length, depth, prefix), the edge table holds the letters below a node. A word meets the tries as states
(word, position, node, edits). States without an edit lie on the word's own path, so they are taken from the halfway node on: an
edit in the second half of a word is found in the forward trie, one in the first half in the trie of the reversed words, where
few letters go on from a node. At the edit level a state joins the letters below its node: another letter is a replacement, and
the letter after the next one, below the same node in the trie of the words that are one shorter, is a deletion (insertions are
deletions of the other word). The states with one edit then walk on level by level, each level joining the node reached with the
node table; a level takes twice as many letters as the one before, so the walk ends after log2(length) levels, whatever the
length. States that reach their end join the words that end there. The levels only ever keep too much (hashes can meet), so a
pair counts if its edit distance is 1.

No join has a hot key: keys that hold more than 1/10,000 of the rows (and 10,000 rows) are at most 10,000 keys, each with one row
on the other side, and these rows are broadcast. Forms lead to words at least twice as common, so following them ends; it takes
log2(steps) joins.

Nulls: a null text has no words; a null id is the empty text in the hash. Repeated rows count again. A run of any length is one
word (texts are read in pieces that end between runs). Ties among near words go to the smallest in code-point order. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import spread_join
from palisade.session import cut_lineage

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
PIECE = 1 << 20
HELD = 200_000  # distinct words that a task counts before it sends them on
BASE = 0x9E3779B97F4A7C15  # odd, so that a shift to the left can be undone
BACK = np.uint64(pow(BASE, -1, 1 << 64))


def runs(text: str) -> Iterator[list[str]]:
    """The letter runs of a text, piece by piece."""
    a = 0
    while a < len(text):
        b = a + PIECE
        if b < len(text) and (rest := RUN.match(text, b)):
            b = rest.end()
        yield RUN.findall(text, a, b)
        a = b


def lowered(run: str) -> str:
    return run.lower() if run.isascii() else run.translate(LOWER)


def misspelt(doc_id: str, run: str, every: int = 97) -> str:
    """The word a run counts for: one letter goes where the hash of document and run says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_letters: int = 5, least_count: int = 3) -> DataFrame:
    """Written table (id, word, n) of the words that are long and frequent enough; id is a hash of the word."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return out

        for batch in batches:
            for name, value in zip(batch.column("id"), batch.column("text"), strict=True):
                own = name.as_py() or ""
                for found in runs(value.as_py() or ""):
                    for run, n in Counter(found).items():
                        word = misspelt(own, lowered(run))
                        if len(word) >= least_letters:
                            held[word] += n
                    if len(held) >= HELD:
                        yield flush()
        if held:
            yield flush()

    src = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"))
    counted = src.mapInArrow(task, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return cut_lineage(counted.where(F.col("n") >= least_count).select(F.xxhash64("word").alias("id"), "word", "n"))


class Letters:
    """Words of one direction as code points, with the hashes of all their prefixes."""

    def __init__(self, words: list[str], direction: int) -> None:
        self.text = "".join(w[::-1] for w in words) if direction else "".join(words)
        self.direction = direction
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.cumsum(self.size) - self.size
        code = np.frombuffer(self.text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        steps = np.full(self.size.max(initial=0) + 1, BASE, np.uint64)
        steps[:1] = 1
        self.power = np.cumprod(steps, dtype=np.uint64)
        place = np.arange(len(code)) - np.repeat(self.start, self.size)
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.letter(code) * self.power[place], dtype=np.uint64)])

    @staticmethod
    def letter(code: np.ndarray) -> np.ndarray:
        return (code + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F) ^ (code << np.uint64(17))

    def prefix(self, which: np.ndarray, depth: np.ndarray) -> np.ndarray:
        return self.total[self.start[which] + depth] - self.total[self.start[which]]

    def node(self, prefix: np.ndarray, size: np.ndarray, depth: np.ndarray) -> np.ndarray:
        x = prefix ^ ((size * 2 + self.direction).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ (depth.astype(np.uint64) << np.uint64(40))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(BASE)
        return (x ^ (x >> np.uint64(29))).view(np.int64)


def places(words: DataFrame) -> DataFrame:
    """Written table (id, direction, at, node, shorter, letter, after): the states without an edit, from halfway on.

    ``shorter`` is the node of the same prefix in the trie of the words one shorter.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                ids, listed = np.asarray(part.column("id")), part.column("word").to_pylist()
                for direction in (0, 1):
                    w = Letters(listed, direction)
                    first = w.size - w.size // 2 if direction else w.size // 2
                    n = w.size - first
                    which = np.repeat(np.arange(len(n)), n)
                    at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + first[which]
                    own = w.prefix(which, at)
                    here = (w.start[which] + at).tolist()
                    last = at + 1 == w.size[which]
                    letter = [w.text[i] for i in here]
                    after = [None if end else w.text[i + 1] for i, end in zip(here, last.tolist(), strict=True)]
                    yield pa.RecordBatch.from_pydict({
                        "id": ids[which], "direction": np.full(len(at), direction, np.int32), "at": at.astype(np.int32),
                        "node": w.node(own, w.size[which], at), "shorter": w.node(own, w.size[which] - 1, at),
                        "letter": pa.array(letter, pa.string()), "after": pa.array(after, pa.string())})

    return cut_lineage(words.select("id", "word").mapInArrow(
        task, "id bigint, direction int, at int, node bigint, shorter bigint, letter string, after string"))


def ends(words: DataFrame) -> DataFrame:
    """(node, near): the words by the node they end at, in both directions."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for direction in (0, 1):
                w = Letters(batch.column("word").to_pylist(), direction)
                every = np.arange(len(w.size))
                yield pa.RecordBatch.from_pydict({"node": w.node(w.prefix(every, w.size), w.size, w.size), "near": batch.column("word")})

    return words.select("word").mapInArrow(task, "node bigint, near string")


def step(letters: int):
    """States with an edit go ``letters`` letters on: the node they would be at, and whether their word ends there."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            direction = np.asarray(batch.column("direction"))
            for d in (0, 1):
                part = batch.filter(pa.array(direction == d))
                if not part.num_rows:
                    continue
                w = Letters(part.column("word").to_pylist(), d)
                every, at, done = np.arange(part.num_rows), np.asarray(part.column("at")).astype(np.int64), np.asarray(part.column("done")).astype(np.int64)
                replaced = np.asarray(pc.is_valid(part.column("letter")))
                code = np.array([ord(c) if c else 0 for c in part.column("letter").to_pylist()], np.uint64)
                to = np.minimum(done + letters, w.size)
                before, behind = w.prefix(every, at), w.prefix(every, to) - w.prefix(every, at + 1)
                there = before + np.where(replaced, w.letter(code) * w.power[at] + behind, behind * BACK)
                less = (~replaced).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("word", "direction", "at", "letter")]
                    + [pa.array(to.astype(np.int32)), pa.array(w.node(there, w.size - less, to - less)), pa.array(to == w.size)],
                    ["word", "direction", "at", "letter", "done", "node", "ended"])

    return task


STATE = "word string, direction int, at int, letter string, done int"


def near_words(words: DataFrame) -> DataFrame:
    """Written table (word, near) of the pairs at one edit, both ways round."""
    own = places(words)
    edges = cut_lineage(own.groupBy("node").agg(F.collect_set("letter").alias("below")))
    # The edit level. A deletion inside a run of one letter takes the run's last.
    branching = edges.where(F.size("below") > 1)
    other = spread_join(own.select("node", "id", "direction", "at", F.col("letter").alias("own")), branching, "node").select(
        "id", "direction", "at", F.explode(F.filter("below", lambda c: c > F.col("own"))).alias("letter"), (F.col("at") + 1).alias("done"))
    gone = spread_join(
        own.where(F.col("after") != F.col("letter")).select(F.col("shorter").alias("node"), "id", "direction", "at", "after"), edges, "node"
    ).where(F.array_contains("below", F.col("after"))).select("id", "direction", "at", F.lit(None).cast("string").alias("letter"), (F.col("at") + 2).alias("done"))
    last = own.where(F.col("after").isNull()).select("id", "direction", "at", F.lit(None).cast("string").alias("letter"), (F.col("at") + 1).alias("done"))
    states = other.unionByName(gone).unionByName(last).join(words.select("id", "word"), "id").select("word", "direction", "at", "letter", "done")
    ended, letters = [], 1
    while True:
        walked = cut_lineage(states.mapInArrow(step(letters), STATE + ", node bigint, ended boolean"))
        ended.append(walked.where("ended").select("node", "word"))
        on = walked.where("NOT ended").drop("ended")
        if on.isEmpty():
            break
        states = spread_join(on, edges.select("node"), "node", "left_semi").drop("node")
        letters *= 2
    met = ended[0]
    for more in ended[1:]:
        met = met.unionByName(more)
    pairs = met.join(ends(words), "node").where(F.levenshtein("word", "near", 1) == 1).select("word", "near")
    return cut_lineage(pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near"))).distinct())


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", times: int = 2, **least) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = count_words(docs, doc_id, text, **least)
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = near_words(words).join(counts, "near").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    better = -F.col("best.less") >= times * F.col("n")
    formed = cut_lineage(words.select("word", "n").join(best, "word", "left").select(
        "word", F.when(better, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(better, -F.col("best.less")).alias("form_n")))
    roots = followed(formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("to")))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def followed(links: DataFrame) -> DataFrame:
    """(word, to): the last word that each word's links lead to; every round doubles the steps taken."""
    links = cut_lineage(links)
    while True:
        on = links.select(F.col("word").alias("to"), F.col("to").alias("further"))
        moved = cut_lineage(links.join(on, "to", "left").select("word", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
        links = moved.select("word", "to")
        if moved.where("moved").isEmpty():
            return links
