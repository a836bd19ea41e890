"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles, banded and verified.

A text is a weighted set: its 5-word shingles with weight tf * idf. The document frequencies come from all documents, as counts
hashed into a table of 2^20 entries; a shingle that meets others there only looks a little more common. Consistent weighted
sampling picks a shingle and a level per sample so that two texts agree with the chance of their weighted Jaccard similarity;
its random numbers are read from a table of fixed size by the shingle's hash. 16 bands of 4 samples make candidates: two texts
of similarity 0.8 miss each other with chance 0.0002.

Candidates are verified by the weighted Jaccard similarity of their whole shingle sets. Copies (equal texts) are one node. In a
band's bucket every member is compared with one hub, the member whose buckets are largest, so a group of any size costs one
comparison a member, and components are taken. Buckets whose members are still in different components go on in rounds, each of
one comparison a member again. The hub of a round is the group's lightest member, because of this: if x is not similar to the
lightest member h, then whatever is similar to x shares with it a shingle beyond h, one that both hold more often than h. (Were all
that x and y share within h, they would share no more than x and h do, and y weighs no less than h.) So the next round's groups
are the members that hold one more shingle beyond their hub; of these shingles, from rare to common, a member needs only as many as
weigh (1 - threshold) of it, as similar texts leave no more unshared. Groups of one component end; in groups with at most ``MANY``
members outside the largest component these are compared with all others, ``FEW`` at a time, and the group ends: a round leaves a
member in tens of groups, so it costs more than these comparisons. No pair of similar members of a bucket is lost, and no member
meets more than ``MANY`` others of a group in a round.

The idf runs from 1 to 1.25: a stronger one would let a group of thousands of near copies make its own shingles light and its
edits heavy, and so fall apart.

Nulls: a null text is empty; texts without words are one class; a text of fewer than five words is one shingle. Case and the
amount of white space do not count. Repeated rows and ids are in the class of their text; a class's id is its smallest doc_id,
null when it has none. Nodes are 64-bit hashes of texts. An empty table gives no rows. Other columns are ignored by ``classes``
and kept by ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import coded, free_names, slices, split_words, spread_join, text_or_empty
from palisade.llm.tables import filled, marked
from palisade.operators.detect.graph import components
from palisade.session import cut_lineage

N = 5
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
IDF_BITS = 20
DRAWS, DRAW_ROWS = 1 << 16, 1 << 12
TOGETHER = 256  # shingles sampled together: their draws stay in the processor's cache
BLOOM = 1 << 23
SALT_ROWS = 256
SLICE = 2 << 20  # bytes of text that a task looks at together
FEW = 1024  # members outside a group's largest component that are held in a task
MANY = 8 * FEW  # and those that are compared with all members of the group, in turns
COLUMNS = 1024  # shingles of the table that all members are multiplied with
BATCH = 128  # members compared at once
SLACK = 1e-6  # of rounding
ROUGH = 1e-4  # of rounding in sums of 32 bits, relative
MIX = np.uint64(0x9E3779B97F4A7C15)


def node(text: str = "text") -> Column:
    return F.xxhash64(text_or_empty(text))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All shingle hashes (32 bits) of the texts, sorted within a text, and where each text's begin."""
    words, at = split_words(pc.utf8_lower(texts))
    codes, kinds = coded(words)
    n, m = len(at) - 1, len(codes)
    if not m:
        return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
    word = pd.util.hash_array(np.asarray(kinds.to_pandas(), dtype=object), categorize=False)[codes]
    factor = np.random.default_rng(3).integers(1, 2**63, N, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    owner = np.repeat(np.arange(n), np.diff(at))
    key, inside = np.zeros(m, np.uint64), np.ones(m, bool)
    for k in range(N):
        key[: m - k] += word[k:] * factor[k]
    inside[max(m - N + 1, 0) :] = False
    if m >= N:
        inside[: m - N + 1] = owner[: m - N + 1] == owner[N - 1 :]
    short = np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < N))
    for i in short:  # the whole text is the shingle
        key[at[i]] = (word[at[i] : at[i + 1]] * factor[: at[i + 1] - at[i]]).sum()
        inside[at[i]] = True
    key = ((key ^ (key >> np.uint64(29))) * MIX) >> np.uint64(32)
    both = np.sort((owner[inside].astype(np.uint64) << np.uint64(32)) | key[inside])
    count = np.bincount((both >> np.uint64(32)).astype(np.int64), minlength=n)
    return (both & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.concatenate([[0], np.cumsum(count)])


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """Hashed document frequencies over all documents, and the number of documents."""

    def count(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> None:
        for batch in slices(batches, "text", SLICE):
            found, at = shingles(batch.column("text"))
            owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
            first = np.ones(len(found), bool)
            first[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
            table += np.bincount(found[first] >> (32 - IDF_BITS), minlength=len(table)).astype(np.int32)

    src = docs.select(F.col(text).alias("text"))
    return filled(src, count, 1 << IDF_BITS), docs.count()


def idf_table(df: np.ndarray, n: int, strength: float) -> np.ndarray:
    return (1 + strength * np.log((1 + n) / (1 + np.minimum(df, n))) / np.log(max(n, 1) + 1)).astype(np.float32)


class Sampler:
    """Consistent weighted samples: r and c from Gamma(2, 1), b uniform, per shingle and sample."""

    def __init__(self, idf: np.ndarray) -> None:
        rng = np.random.default_rng(17)
        shape = (DRAWS, SAMPLES)
        parts = range(0, DRAWS, DRAW_ROWS)  # drawn in parts: the draws of 64 bits are twice the table
        r, fixed = np.empty(shape, np.float32), np.empty(shape, np.float32)
        for a in parts:
            r[a : a + DRAW_ROWS] = rng.gamma(2.0, 1.0, (DRAW_ROWS, SAMPLES))
        b = rng.random(shape, np.float32)
        # ln a = ln c - r (t - b) - r
        for a in parts:
            at = slice(a, a + DRAW_ROWS)
            fixed[at] = np.log(rng.gamma(2.0, 1.0, (DRAW_ROWS, SAMPLES)).astype(np.float32)) + r[at] * b[at] - r[at]
        self.idf, self.r, self.b, self.fixed = idf, r, b, fixed
        self.sample = rng.integers(0, 2**63, SAMPLES, dtype=np.uint64)

    def of(self, found: np.ndarray) -> np.ndarray:
        """Samples of one text as 32-bit numbers; of a text without shingles zeros."""
        if not len(found):
            return np.zeros(SAMPLES, np.uint32)
        first = np.flatnonzero(np.diff(found.astype(np.int64), prepend=-1))
        kinds, tf = found[first], np.diff(first, append=len(found))
        log_w = np.log(tf * self.idf[kinds >> (32 - IDF_BITS)]).astype(np.float32)
        low, kind, level = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.uint32), np.zeros(SAMPLES, np.int64)
        for a in range(0, len(kinds), TOGETHER):
            part = kinds[a : a + TOGETHER]
            row = part & np.uint32(DRAWS - 1)
            r = self.r.take(row, 0)
            t = 1 / r
            t *= log_w[a : a + TOGETHER, None]
            t += self.b.take(row, 0)
            np.floor(t, t)
            ln_a = self.fixed.take(row, 0)
            r *= t
            ln_a -= r
            value = ln_a.min(0)
            less = np.flatnonzero(value < low)
            if not len(less):
                continue
            best = np.empty(SAMPLES, np.int64)
            at, sample = np.nonzero(ln_a == value)
            best[sample[::-1]] = at[::-1]  # of equal ones the first
            best = best[less]
            low[less], kind[less], level[less] = value[less], part[best], t[best, less].astype(np.int64)
        x = (kind.astype(np.uint64) * MIX) ^ (level.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ self.sample
        return ((x ^ (x >> np.uint64(31))) * MIX >> np.uint64(32)).astype(np.uint32)


def similarity(a: np.ndarray, b: np.ndarray, idf: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted multisets of shingles."""
    (ka, na), (kb, nb) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    if not len(ka) or not len(kb):
        return float(len(ka) == len(kb))
    at = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
    both = kb[at] == ka
    low = (np.minimum(na[both], nb[at[both]]) * idf[ka[both] >> (32 - IDF_BITS)]).sum(dtype=np.float64)
    total = (na * idf[ka >> (32 - IDF_BITS)]).sum(dtype=np.float64) + (nb * idf[kb >> (32 - IDF_BITS)]).sum(dtype=np.float64)
    return float(low / (total - low))


def sketches(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """Written table (node, sketch, bands) of the distinct texts of (node, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(shared.value)
        salt = np.random.default_rng(19).integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
        for batch in slices(batches, limit=SLICE):
            found, at = shingles(batch.column("text"))
            all_samples = np.array([sampler.of(found[a:b]) for a, b in zip(at, at[1:], strict=False)])
            keys = ((all_samples.reshape(-1, BANDS, ROWS).astype(np.uint64) + np.uint64(1)) * salt).sum(2, dtype=np.uint64)
            keys = (keys ^ (keys >> np.uint64(29))) * MIX
            yield pa.RecordBatch.from_arrays([
                batch.column("node"), pa.array([s.tobytes() for s in all_samples], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), pa.array(keys.view(np.int64).ravel()))],
                ["node", "sketch", "bands"])

    made = docs.mapInArrow(sketch, "node bigint, sketch binary, bands array<bigint>")
    return cut_lineage(made.dropDuplicates(["node"]))


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Written table (node, found) of the distinct texts in ``wanted``.

    A bit set of fixed size drops most other texts before they are moved; one that passes by chance costs its transport only.
    """

    def mark(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> None:
        for batch in batches:
            table[np.asarray(batch.column("node")).astype(np.uint64) % np.uint64(BLOOM)] = 1

    shared = docs.sparkSession.sparkContext.broadcast(filled(wanted.select("node"), mark, BLOOM, np.maximum).astype(bool))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, done = shared.value, set()
        for whole in batches:
            nodes = np.asarray(whole.column("node"))
            keep = bits[nodes.astype(np.uint64) % np.uint64(BLOOM)]
            for i in np.flatnonzero(keep).tolist():  # a copy was sent already
                keep[i] = nodes[i] not in done
                done.add(nodes[i])
            for batch in slices(iter([whole.filter(pa.array(keep))]), limit=SLICE):
                found, at = shingles(batch.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node"), pa.array([found[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())], ["node", "found"])

    sets = docs.mapInArrow(take, "node bigint, found binary").dropDuplicates(["node"])
    return cut_lineage(sets.join(wanted.select("node").distinct(), "node", "left_semi"))


class Beyond:
    """Comparison of members with one hub: similarity, and what a member holds beyond it."""

    def __init__(self, idf: np.ndarray, counts: np.ndarray, threshold: float) -> None:
        self.idf, self.counts, self.threshold = idf, counts, threshold

    def hub(self, found: np.ndarray) -> None:
        self.kinds, self.times = np.unique(found, return_counts=True)
        self.weight = (self.times * self.idf[self.kinds >> (32 - IDF_BITS)]).sum(dtype=np.float64)

    def member(self, found: np.ndarray) -> tuple[bool, np.ndarray]:
        """Whether a member is similar to the hub, and the rare end of its shingles beyond the hub."""
        kinds, times = np.unique(found, return_counts=True)
        idf = self.idf[kinds >> (32 - IDF_BITS)].astype(np.float64)
        weight = (times * idf).sum()
        if not len(kinds) or not len(self.kinds):
            return len(kinds) == len(self.kinds), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.kinds, kinds), len(self.kinds) - 1)
        held = np.where(self.kinds[at] == kinds, self.times[at], 0)
        low = (np.minimum(times, held) * idf).sum()
        similar = low / (weight + self.weight - low) >= self.threshold
        more = np.flatnonzero(times > held)
        more = more[np.lexsort((kinds[more], self.counts[kinds[more] >> (32 - IDF_BITS)]))]
        over = ((times[more] - held[more]) * idf[more]).cumsum()
        needed = np.searchsorted(over, (1 - self.threshold) * weight + SLACK, side="right") + 1
        return bool(similar), kinds[more[:needed]].astype(np.int64)


def compared(pairs: DataFrame, sets: DataFrame, idf: np.ndarray, counts: np.ndarray, threshold: float, beyond: bool) -> DataFrame:
    """Written table (hub, node, similar, beyond) of the distinct pairs (hub, node).

    A hub with many pairs is dealt to several tasks, each of which gets the hub's set once, ahead of its members'.
    """
    shared = pairs.sparkSession.sparkContext.broadcast((idf, counts))
    pairs = cut_lineage(pairs)
    salts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    deal = F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt")
    members = pairs.join(salts, "hub").select("hub", deal, "node").join(sets, "node").select("hub", "salt", "node", "found")
    hubs = salts.join(sets, F.col("hub") == F.col("node")).select(
        "hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("bigint").alias("node"), "found")
    dealt = hubs.unionByName(members).repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.asc_nulls_first("node"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_hub = Beyond(*shared.value, threshold)
        for batch in batches:
            rows: list[tuple] = []
            for hub, member, data in zip(*[batch.column(c).to_pylist() for c in ("hub", "node", "found")], strict=True):
                found = np.frombuffer(data, np.uint32)
                if member is None:
                    with_hub.hub(found)
                else:
                    similar, more = with_hub.member(found)
                    if similar or beyond:
                        rows.append((hub, member, similar, more if beyond else None))
            kinds = {"hub": pa.int64(), "node": pa.int64(), "similar": pa.bool_(), "beyond": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(kinds.items())})

    return cut_lineage(dealt.mapInArrow(compare, "hub bigint, node bigint, similar boolean, beyond array<bigint>"))


def weights(sets: DataFrame, idf: np.ndarray) -> DataFrame:
    """Written table (node, w): what the shingles of each text weigh."""
    shared = sets.sparkSession.sparkContext.broadcast(idf)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = [float(shared.value[np.frombuffer(d, np.uint32) >> (32 - IDF_BITS)].sum(dtype=np.float64)) for d in batch.column("found").to_pylist()]
            yield pa.RecordBatch.from_pydict({"node": batch.column("node"), "w": pa.array(w, pa.float64())})

    return cut_lineage(sets.mapInArrow(weigh, "node bigint, w double"))


def links(docs: DataFrame, text: str = "text", threshold: float = 0.8, strength: float = 0.25) -> DataFrame:
    """(node, component) of every text that has a near duplicate; nodes are ``node(text)``."""
    counts, n = document_frequencies(docs, text)
    idf = idf_table(counts, n, strength)
    src = docs.select(node(text).alias("node"), text_or_empty(text).alias("text"))
    sketched = sketches(src, idf)
    banded = sketched.select("node", F.explode("bands").alias("key"))
    crowded = banded.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    members = cut_lineage(banded.join(crowded, "key"))
    # The hub of a bucket: the member whose buckets are largest.
    central = members.groupBy("node").agg(F.sum("n").alias("met"))
    ranked = members.join(central, "node").select("key", "node", F.struct((-F.col("met")).alias("m"), "node").alias("order"))
    hubs = ranked.groupBy("key").agg(F.min("order")["node"].alias("hub"))
    stars = cut_lineage(members.join(hubs, "key").where(F.col("node") != F.col("hub")).select("hub", "node").distinct())
    sets = shingle_sets(src, members.select("node").distinct())
    pair = lambda met: met.where("similar").select(F.col("hub").alias("src"), F.col("node").alias("dst"))
    near = pair(compared(stars, sets, idf, counts, threshold, beyond=False))
    grouped = components(near, near.select("src").unionByName(near.select(F.col("dst").alias("src"))))
    # What is left: groups with members of different components.
    groups, weighed = members.select(F.col("key").alias("g"), "node"), weights(sets, idf)
    while True:
        placed = cut_lineage(groups.join(grouped, "node", "left").select("g", "node", F.coalesce("component", "node").alias("c")))
        parts = placed.groupBy("g", "c").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
        open_groups = parts.groupBy("g").agg(
            F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("c", "n").alias("top"), F.count("*").alias("kinds"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
        # Groups of the same members are one.
        open_groups = open_groups.where(F.col("kinds") > 1).groupBy("n", "x", "y").agg(F.min_by(F.struct("g", "top", "most"), "g").alias("g"))
        open_groups = cut_lineage(open_groups.select("g.g", "n", "g.top", (F.col("n") - F.col("g.most")).alias("others")))
        if open_groups.isEmpty():
            return grouped
        left = cut_lineage(spread_join(placed, open_groups, "g"))
        near = settled(left.where(F.col("others") <= MANY), sets, idf, threshold)
        left = left.where(F.col("others") > MANY).select("g", "node")
        if left.isEmpty():
            return merged(grouped, near)
        hubs = left.join(weighed, "node").groupBy("g").agg(F.min_by("node", "w").alias("hub"))
        pairs = spread_join(left, cut_lineage(hubs), "g").where(F.col("node") != F.col("hub")).select("hub", "node").distinct()
        met = compared(pairs, sets, idf, counts, threshold, beyond=True)
        grouped = merged(grouped, near.unionByName(pair(met)))
        # Members of several groups with one hub are one group from here on.
        held = cut_lineage(met.select(F.explode("beyond").alias("shingle"), "hub", "node").select(F.xxhash64("hub", "shingle").alias("g"), "node").distinct())
        crowded = held.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("g")
        groups = cut_lineage(spread_join(held, cut_lineage(crowded), "g", "left_semi"))


def settled(members: DataFrame, sets: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """Written table (src, dst): the similar pairs of groups (g, node, c, n, top, others) with ``others`` members outside the component ``top``.

    These are dealt into turns of about ``FEW``. A turn's are sent ahead of all members, to each task of the group and turn, and
    every member is compared with them as it comes. No pairs are sent, and a large group is dealt to several tasks.
    """
    shared = sets.sparkSession.sparkContext.broadcast(idf)
    salts, turns = F.ceil(F.col("n") / FEW).cast("int"), F.ceil(F.col("others") / FEW).cast("int")
    found = members.join(sets, "node").select("g", "node", "c", "n", "top", "others", "found")
    few = found.where(F.col("c") != F.col("top")).select(
        "g", F.pmod(F.xxhash64("node", F.lit(1)), turns).cast("int").alias("turn"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(True).alias("few"), "node", "c", "found")
    rest = found.select(
        "g", F.explode(F.sequence(F.lit(0), turns - 1)).alias("turn"), F.pmod(F.xxhash64("node"), salts).cast("int").alias("salt"), F.lit(False).alias("few"), "node", "c", "found")
    dealt = few.unionByName(rest).repartition("g", "turn", "salt").sortWithinPartitions("g", "turn", "salt", F.desc("few"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, Held(shared.value, threshold)
        for batch in batches:
            src, dst, waiting = [], [], []

            def compare_waiting() -> None:
                near = held.similar_to([c for _, c, _ in waiting], [x for *_, x in waiting])  # noqa: B023
                for (node_id, *_), found in zip(waiting, near, strict=True):  # noqa: B023
                    src.extend(found)  # noqa: B023
                    dst.extend([node_id] * len(found))  # noqa: B023
                waiting.clear()  # noqa: B023

            for g, turn, salt, ahead, node_id, c, data in zip(*[batch.column(x).to_pylist() for x in ("g", "turn", "salt", "few", "node", "c", "found")], strict=True):
                if (g, turn, salt) != group or len(waiting) == BATCH:
                    compare_waiting()
                if (g, turn, salt) != group:
                    group, held = (g, turn, salt), Held(shared.value, threshold)
                if ahead:
                    held.add(node_id, c, np.frombuffer(data, np.uint32))
                else:
                    waiting.append((node_id, c, np.frombuffer(data, np.uint32)))
            compare_waiting()
            yield pa.RecordBatch.from_pydict({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return cut_lineage(dealt.mapInArrow(compare, "src bigint, dst bigint"))


class Held:
    """The few of a group, which every member is compared with.

    What a held set weighs in the shingles that a member has bounds from above what they share. The bound of all pairs comes from
    a table of the ``COLUMNS`` shingles that most held sets have, by a product of matrices, and from lists of the sets that have
    each other shingle; only pairs that may pass are compared in full.
    """

    def __init__(self, idf: np.ndarray, threshold: float) -> None:
        self.idf, self.threshold = idf, threshold
        self.sets: list[tuple] = []
        self.ready = False

    def _seen(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        kinds, times = np.unique(found, return_counts=True)
        each = self.idf[kinds >> (32 - IDF_BITS)].astype(np.float64)
        return kinds, times, each, float((times * each).sum())

    def add(self, node_id: int, component: int, found: np.ndarray) -> None:
        self.sets.append((node_id, component, *self._seen(found)))
        self.ready = False

    def _index(self) -> None:
        n = len(self.sets)
        self.components = np.array([x[1] for x in self.sets], np.int64)
        self.weights = np.array([x[5] for x in self.sets])
        owner = np.repeat(np.arange(n), [len(x[2]) for x in self.sets])
        weight = np.concatenate([np.zeros(0), *[x[3] * x[4] for x in self.sets]])
        self.kinds, of, count = np.unique(np.concatenate([np.zeros(0, np.uint32), *[x[2] for x in self.sets]]), return_inverse=True, return_counts=True)
        most = np.argsort(-count, kind="stable")[:COLUMNS]
        self.column = np.full(len(count), -1)
        self.column[most] = np.arange(len(most))
        column = self.column[of]
        self.table = np.zeros((len(most), n), np.float32)
        self.table[column[column >= 0], owner[column >= 0]] = weight[column >= 0]
        rest = np.flatnonzero(column < 0)
        rest = rest[np.argsort(of[rest], kind="stable")]
        self.owner, self.weight = owner[rest], weight[rest]
        self.start = np.searchsorted(of[rest], np.arange(len(count) + 1))
        self.ready = True

    def similar(self, component: int, found: np.ndarray) -> list[int]:
        """The held nodes of other components that are similar to a set."""
        return self.similar_to([component], [found])[0]

    def similar_to(self, components: list[int], founds: list[np.ndarray]) -> list[list[int]]:
        """The same for each of several sets."""
        if not self.sets or not founds:
            return [[] for _ in founds]
        if not self.ready:
            self._index()
        seen = [self._seen(x) for x in founds]
        has, listed = np.zeros((len(founds), len(self.table)), np.float32), []
        for i, (kinds, *_) in enumerate(seen):
            at = np.minimum(np.searchsorted(self.kinds, kinds), max(len(self.kinds) - 1, 0))
            at = at[self.kinds[at] == kinds] if len(self.kinds) else at[:0]
            column = self.column[at]
            has[i, column[column >= 0]] = 1
            at = at[column < 0]
            places = np.repeat(self.start[at], count := self.start[at + 1] - self.start[at]) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            listed.append(np.bincount(self.owner[places], self.weight[places], len(self.sets)))
        most = (has @ self.table + np.array(listed)) * (1 + ROUGH) + SLACK
        weight = np.array([x[3] for x in seen])[:, None]
        able = (self.components != np.array(components)[:, None]) & (most >= self.threshold * (weight + self.weights - most))
        out: list[list[int]] = [[] for _ in founds]
        for j, i in np.argwhere(able).tolist():
            kinds, times, each, w = seen[j]
            node_id, _, other, other_times, _, other_w = self.sets[i]
            _, at, there = np.intersect1d(kinds, other, assume_unique=True, return_indices=True)
            low = (np.minimum(times[at], other_times[there]) * each[at]).sum()
            if (not w and not other_w) or low / (w + other_w - low) >= self.threshold:
                out[j].append(node_id)
        return out


def merged(grouped: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after further links (src, dst): components of components."""
    ends = links.select(F.col("src").alias("node")).unionByName(links.select(F.col("dst").alias("node"))).distinct()
    alone = ends.join(grouped, "node", "left_anti").select("node", F.col("node").alias("component"))
    every = cut_lineage(grouped.unionByName(alone))
    a, b = (every.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}")) for end in ("src", "dst"))
    edges = links.join(a, "src").join(b, "dst").where(F.col("c_src") != F.col("c_dst")).select(F.col("c_src").alias("src"), F.col("c_dst").alias("dst"))
    edges = cut_lineage(edges.distinct())
    if edges.isEmpty():
        return every
    label = components(edges, edges.select("src").unionByName(edges.select(F.col("dst").alias("src"))))
    label = label.select(F.col("node").alias("component"), F.col("component").alias("label"))
    return cut_lineage(every.join(label, "component", "left").select("node", F.coalesce("label", "component").alias("component")))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(doc_id, class_id, class_docs) per document: the smallest doc_id of its class, and the class's documents."""
    grouped = links(docs, text, **how)
    rows = cut_lineage(docs.select(F.col(doc_id).alias("doc_id"), node(text).alias("node")).join(grouped, "node", "left").select(
        "doc_id", F.coalesce("component", "node").alias("component")))
    ids = rows.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_docs"))
    return rows.join(ids, "component").select("doc_id", "class_id", "class_docs")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One document of each class, the one with the smallest doc_id; all columns stay, whatever their names."""
    grouped = links(docs, text, **how)
    rows = docs.select(F.col(doc_id).alias("doc_id"), node(text).alias("node")).groupBy("node", "doc_id").agg(F.count("*").alias("rows"))
    placed = cut_lineage(rows.join(grouped, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component"))
    first = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "node", "rows")
    chosen = cut_lineage(placed.groupBy("c").agg(F.min(first).alias("k"), F.sum("rows").alias("docs")))
    # A document that is alone in its class stays where it is; only the texts of the others move.
    known = marked(spread_join(placed, chosen.where(F.col("docs") > 1).select("c"), "c", "left_semi").select(F.col("node").alias("key")))
    own, its_node, its_id, times = free_names(docs, "own", "node", "id", "rows")
    kept = chosen.select(F.col("k.node").alias(its_node), F.col("k.doc_id").alias(its_id), F.col("k.rows").alias(times))
    src = docs.withColumn(own, node(text))
    alone = src.where(~known(F.col(own))).select(*docs.columns)
    met = src.where(known(F.col(own))).join(kept, (F.col(own) == F.col(its_node)) & F.col(doc_id).eqNullSafe(F.col(its_id)))
    if kept.where(F.col(times) > 1).isEmpty():
        return alone.unionByName(met.select(*docs.columns))
    # Repeated rows: any of them stands for all.
    one = met.where(F.col(times) == 1).unionByName(met.where(F.col(times) > 1).dropDuplicates([own]))
    return alone.unionByName(one.select(*docs.columns))
