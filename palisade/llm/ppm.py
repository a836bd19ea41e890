"""Language-model scores by prediction by partial matching over a byte-context trie, with all counts of the corpus.

A text is its words, lower-cased in A to Z, with a space before the first and after each, and an end sign. The context of a byte
is what stands before it in its text, up to ``ORDER`` bytes, ends of words included. A context predicts the bytes it was followed by
in the training texts with their counts, and an escape (method C: as often as it has different bytes). After an escape the next
shorter context predicts, without the bytes that the longer one had (symbol exclusion); below the empty context the bytes left
are alike. Every n-gram of the training texts counts, at any size of the corpus.

A gram is a context with its byte. A block of documents sends its distinct grams with their counts, and its distinct words with
theirs, packed: one row per part of the trie. A part is a share of the contexts' three nearest bytes, so it holds a gram, the grams
of its context and the grams of its suffixes down to order 3; for given three bytes there are at most 2^24 grams of order 5, however
large the corpus, and a part streams the blocks' rows, so its memory is bounded by its distinct grams. The shorter orders, a small
table, are valued by joins first, since the bytes seen after a context were also seen after its suffix and what exclusion leaves
there is a difference of two numbers; a part gets the rows of its own contexts. Values go back to the blocks packed, where each
document adds its bytes up. Nothing is collected but two sums, and nothing broadcast.

Nulls: a null text is empty: the end sign alone. A null id is not held out and teaches nothing. Repeated rows count and are
scored each. An empty table gives no rows; without training texts every byte is alike. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.blocks import frequencies
from palisade.llm.common import coded, fold, slices, split_words
from palisade.session import cut_lineage

ORDER = 5
TOP = 2  # longest order of the table that all parts share
BLOCK_BYTES = 6 << 20
END = "\n"  # no word holds it
SYMBOLS = 256
PARTS = (16, 4096)  # least and most
PIECE = 1 << 20  # bytes that are looked at together
MERGE = 1 << 21  # grams that a part holds besides its distinct ones


def grams(data: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Per byte its gram of the longest order: the byte, those before it, and the order; ``inside``: how many may be its context."""
    one = data.astype(np.int64)
    packed = one.copy()
    for k in range(1, ORDER + 1):
        packed[k:] |= np.where(inside[k:] >= k, one[:-k] << (8 * k), 0)
    return packed | (np.minimum(inside, ORDER) << 56)


def stretches(size: np.ndarray, limit: int) -> Iterator[tuple[int, int, int, int]]:
    """(first text, text behind, from, to) of pieces of framed texts. A text is cut only if it is longer than ``limit``, always at the same places."""
    group, giant = (np.cumsum(size) - size) // limit, size > limit
    new = np.diff(group, prepend=-1) != 0
    new |= giant
    new[1:] |= giant[:-1]
    cuts = [*np.flatnonzero(new).tolist(), len(size)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        total = int(size[a:b].sum())
        for lo in range(0, total, limit if giant[a] else max(total, 1)):
            yield a, b, lo, min(lo + limit, total) if giant[a] else total


def pieces(texts: pa.Array, limit: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grams, their texts' numbers) of framed texts, piece by piece."""
    size = np.asarray(pc.binary_length(texts), dtype=np.int64)
    held, data = None, np.zeros(0, np.uint8)
    for (a, b, lo, hi), owner in zip(stretches(size, limit), owners(texts, limit), strict=True):
        if held != a:
            held, data = a, np.frombuffer("".join(texts.slice(a, b - a).to_pylist()).encode(), np.uint8)
        ahead = min(lo, ORDER)
        begins = np.repeat(np.cumsum(size[a:b]) - size[a:b], size[a:b])[lo - ahead : hi] if b - a > 1 else 0
        inside = np.arange(lo - ahead, hi) - begins
        gram, later = grams(data[lo - ahead : hi], inside)[ahead:], inside[ahead:] > 0
        yield gram[later], owner


def owners(texts: pa.Array, limit: int = PIECE) -> Iterator[np.ndarray]:
    """The texts' numbers of the grams of each piece: a text has one gram less than bytes."""
    size = np.asarray(pc.binary_length(texts), dtype=np.int64)
    for a, b, lo, hi in stretches(size, limit):
        yield np.repeat(np.arange(a, b), np.maximum(size[a:b] - 1, 0)) if b - a > 1 else np.full(hi - lo - (lo == 0), a)


def text_blocks(docs: DataFrame, limit: int) -> DataFrame:
    """Written table (block, doc_id, held_out, teaches, sizes, data) of slices of documents; the framed texts are one compressed value."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for i, batch in enumerate(slices(batches, limit=limit)):
            words, at = split_words(pc.ascii_lower(batch.column("text")))
            joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), words), " ")
            framed = pc.if_else(pa.array(np.diff(at) > 0), pc.binary_join_element_wise(" ", joined, " " + END, ""), " " + END)
            sizes = pc.binary_length(framed).cast(pa.int64())
            data = pa.compress("".join(framed.to_pylist()).encode(), "zstd", asbytes=True)
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([(task << 32) + i], pa.int64()), **{c: one(batch.column(c)) for c in ("doc_id", "held_out", "teaches")},
                "sizes": one(sizes), "data": pa.array([data], pa.binary())})

    return cut_lineage(docs.mapInArrow(pack, f"block bigint, doc_id array<{kind}>, held_out array<boolean>, teaches array<boolean>, sizes array<bigint>, data binary"))


def framed_texts(batch: pa.RecordBatch, r: int, data: str = "data") -> pa.Array:
    """The texts of a block."""
    at = np.concatenate([[0], np.cumsum(np.asarray(batch.column("sizes")[r].values, dtype=np.int64))])
    raw = pa.decompress(batch.column(data)[r].as_py(), int(at[-1]), "zstd")
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.tobytes()), raw)


def shrunk(numbers: np.ndarray) -> bytes:
    """Eight-byte numbers as byte planes, compressed."""
    return pa.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def grown(data: bytes, n: int, kind: str = "<i8") -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


def shrunk_words(words: list[str]) -> tuple[bytes, int]:
    data = " ".join(words).encode()
    return pa.compress(data, "zstd", asbytes=True), len(data)


def grown_words(data: bytes, n_bytes: int) -> list[str]:
    return pa.decompress(data, n_bytes, "zstd", asbytes=True).decode().split(" ") if n_bytes else []


def part_of(gram: np.ndarray, parts: int) -> np.ndarray:
    """Part by the three nearest bytes of the context; grams with shorter contexts are the last part."""
    near = (gram >> 8) & 0xFFFFFF
    mixed = (near * 0x9E3779B1 & 0xFFFFFFFF) >> 7
    return np.where(gram >> 56 > TOP, mixed % parts, parts)


class Block:
    """Distinct grams and words of a block's texts, by part and in order, and where the texts hold them."""

    def __init__(self, framed: pa.Array, parts: int) -> None:
        self.framed, self.parts = framed, parts
        words, at = split_words(framed)
        n = len(framed)
        codes, kinds = coded(words)
        kinds = pa.concat_arrays([kinds.cast(pa.string()), pa.array([END])])
        part = (pd.util.hash_array(np.asarray(kinds.to_pandas(), dtype=object), categorize=False) % np.uint64(parts)).astype(np.int64)
        order = np.asarray(pc.sort_indices(pa.table({"part": part, "word": kinds}), sort_keys=[("part", "ascending"), ("word", "ascending")]))
        self.words, self.word_part = kinds.take(pa.array(order)), part[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        # Each text's words, and its end.
        self.tokens = np.full(len(codes) + n, place[-1], np.int64)
        is_word = np.ones(len(self.tokens), bool)
        is_word[at[1:] + np.arange(n)] = False
        self.tokens[is_word] = place[codes]
        self.at = at + np.arange(n + 1)

    def word_counts(self, teaches: np.ndarray) -> np.ndarray:
        return np.bincount(self.tokens[np.repeat(teaches, np.diff(self.at))], minlength=len(self.words)).astype(np.int64)

    def pieces(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(grams' numbers, texts' numbers, distinct grams) of a piece of the texts after the other."""
        for gram, owner in pieces(self.framed):
            codes, kinds = coded(pa.array(gram))
            yield codes, owner, np.asarray(kinds)

    def in_parts(self, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of distinct grams, by part and gram, and the parts there."""
        part = part_of(kinds, self.parts)
        order = np.argsort(part, kind="stable")
        return order, part[order]

    def gram_counts(self, teaches: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(gram, part, times in training texts), by part and gram."""
        found = [(np.zeros(0, np.int64),) * 2]
        for codes, owner, kinds in self.pieces():
            found.append((kinds, np.bincount(codes, teaches[owner], len(kinds)).astype(np.int64)))
        kinds, n = summed(np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]))
        order, part = self.in_parts(kinds)
        return kinds[order], part, n[order]

    def scores(self, value: np.ndarray) -> np.ndarray:
        """Sums per text of the grams' values, which come by part and gram."""
        held = [(codes.astype(np.int32), kinds) for codes, _, kinds in self.pieces()]
        every = np.unique(np.concatenate([np.zeros(0, np.int64), *[k for _, k in held]]))
        order, _ = self.in_parts(every)
        by_gram = np.empty(len(every))
        by_gram[order] = value
        out = np.zeros(len(self.framed))
        for (codes, kinds), owner in zip(held, owners(self.framed), strict=True):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            out[owner[first]] += np.add.reduceat(by_gram[np.searchsorted(every, kinds)][codes], first)
        return out


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their numbers."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else np.zeros(0, np.int64)
    return keys[first], (np.add.reduceat(n, first) if len(first) else n)


def by_part(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    starts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    for a, b in zip(starts, [*starts, len(part)][1:], strict=True):
        yield int(part[a]), slice(a, b)


ITEMS = "kind string, part int, block bigint, size int, bytes int, items binary, counts binary"


def sent_items(parts: int):
    """Blocks to their rows: per part the distinct grams (kind g) and words (kind w) with their counts in training texts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                block, teaches = Block(framed_texts(batch, r), parts), np.asarray(batch.column("teaches")[r].values.to_pylist(), dtype=bool)
                rows = []
                gram, part, n = block.gram_counts(teaches)
                for p, s in by_part(part):
                    rows.append(("g", p, len(gram[s]), 0, shrunk(np.diff(gram[s], prepend=0)), shrunk(n[s])))
                counts = block.word_counts(teaches)
                for p, s in by_part(block.word_part):
                    data, size = shrunk_words(block.words.slice(s.start, s.stop - s.start).to_pylist())
                    rows.append(("w", p, s.stop - s.start, size, data, shrunk(counts[s])))
                own = batch.column("block")[r].as_py()
                kinds = {"kind": pa.string(), "part": pa.int32(), "size": pa.int32(), "bytes": pa.int32(), "items": pa.binary(), "counts": pa.binary()}
                columns = {c: pa.array([x[i] for x in rows], t) for i, (c, t) in enumerate(kinds.items())}
                columns["block"] = pa.array([own] * len(rows), pa.int64())
                yield pa.RecordBatch.from_pydict({c: columns[c] for c in ("kind", "part", "block", "size", "bytes", "items", "counts")})

    return task


MERGED = "kind string, part int, size int, bytes int, items binary, counts binary, short array<bigint>, short_n array<bigint>, total bigint, distinct bigint"


def merged_items(parts: int):
    """Rows of parts, sorted by (kind, part), to one row a part: its distinct items with their sums, and its grams' suffixes of order ``TOP``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, words = None, [], 0, {}

        def merge() -> None:
            nonlocal held, size
            if held:
                held = [summed(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))]
                size = 0

        def end() -> pa.RecordBatch:
            kind, part = now
            short = short_n = np.zeros(0, np.int64)
            if kind == "g":
                merge()
                keys, n = held[0]
                row = (len(keys), 0, shrunk(np.diff(keys, prepend=0)), shrunk(n))
                order = keys >> 56
                short, short_n = summed(suffix_of(keys[order > TOP], TOP), n[order > TOP]) if part < parts else (keys, n)
            else:
                listed = sorted(words)
                n = np.array([words[w] for w in listed], np.int64)
                data, n_bytes = shrunk_words(listed)
                row = (len(listed), n_bytes, data, shrunk(n))
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int64()))
            values = {"kind": pa.array([kind]), "part": pa.array([part], pa.int32()), "size": pa.array([row[0]], pa.int32()), "bytes": pa.array([row[1]], pa.int32()),
                      "items": pa.array([row[2]], pa.binary()), "counts": pa.array([row[3]], pa.binary()), "short": one(short), "short_n": one(short_n),
                      "total": pa.array([int(n.sum())], pa.int64()), "distinct": pa.array([int((n > 0).sum())], pa.int64())}
            return pa.RecordBatch.from_pydict(values)

        for batch in batches:
            for kind, part, n_items, n_bytes, items, counts in zip(*[batch.column(c).to_pylist() for c in ("kind", "part", "size", "bytes", "items", "counts")], strict=True):
                if (kind, part) != now:
                    if now:
                        yield end()
                    now, held, size, words = (kind, part), [], 0, {}
                n = grown(counts, n_items)
                if kind == "g":
                    held.append((np.cumsum(grown(items, n_items)), n))
                    size += n_items
                    if size > MERGE:
                        merge()
                else:
                    for w, c in zip(grown_words(items, n_bytes), n.tolist(), strict=True):
                        words[w] = words.get(w, 0) + c
        if now:
            yield end()

    return task


def suffix_of(gram: np.ndarray, order: int) -> np.ndarray:
    return (gram & ((1 << (8 * (order + 1))) - 1)) | (order << 56)


def suffix(gram: Column, order: int) -> Column:
    """The gram of a lower order."""
    return gram.bitwiseAND(F.lit((1 << (8 * (order + 1))) - 1)).bitwiseOR(F.lit(order << 56))


def short_values(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Values of the grams of (gram, n) up to order ``TOP``; n = 0 for grams that no training text holds.

    (gram, value) of all of them, and for order ``TOP`` what the next order needs: (gram, n, d, t, r, f).
    """
    order = F.shiftright("gram", 56)
    level = {TOP: counted.where(order == TOP).select("gram", "n", F.lit(True).alias("asked"))}
    for k in range(TOP - 1, -1, -1):
        own = counted.where(order == k).select("gram", "n", F.lit(True).alias("asked"))
        # What is asked for at this order counts here; what is longer counts by its suffix.
        longer = level[k + 1].select(suffix(F.col("gram"), k).alias("gram"), "n", F.lit(False).alias("asked"))
        level[k] = cut_lineage(longer.unionByName(own).groupBy("gram").agg(F.sum("n").alias("n"), F.max("asked").alias("asked")))
    n, log = F.col("n"), F.log10
    t, d = level[0].agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((n > 0).cast("bigint")), F.lit(0))).first()
    rest = -log(F.lit(float(SYMBOLS - d)))
    known = level[0].select(
        "gram", "n", "asked", F.lit(d).cast("bigint").alias("d"), F.lit(t).cast("bigint").alias("t"), rest.alias("r"),
        (F.when(n > 0, log(n / F.lit(float(t + d)))).otherwise(log(F.lit(d / (t + d))) + rest) if t else rest).alias("f"))
    out = known.where("asked").select("gram", F.col("f").alias("value"))
    for k in range(1, TOP + 1):
        short = known.select(F.col("gram").alias("_suffix"), *[F.col(c).alias(f"{c}1") for c in ("n", "d", "t", "r", "f")])
        met = level[k].withColumn("_suffix", suffix(F.col("gram"), k - 1)).join(short, "_suffix")
        same = Window.partitionBy(F.shiftright("gram", 8))
        d, t = F.sum((n > 0).cast("bigint")).over(same), F.sum("n").over(same)
        both = met.select("gram", "n", "asked", "n1", "d1", "t1", "r1", "f1", d.alias("d"), t.alias("t"),
                          F.sum(F.when(n > 0, F.col("n1")).otherwise(0)).over(same).alias("x"))
        left, total = F.col("d1") - F.col("d"), F.col("d1") - F.col("d") + F.col("t1") - F.col("x")
        r = F.when(F.col("n1") > 0, log("n1") - log(total)).otherwise(F.when(left > 0, log(left) - log(total)).otherwise(0.0) + F.col("r1"))
        down = both.withColumn("r", r)
        whole = F.col("t") + F.col("d")
        f = F.when(F.col("t") == 0, F.col("f1")).when(n > 0, log(n) - log(whole)).otherwise(log("d") - log(whole) + F.col("r"))
        known = cut_lineage(down.select("gram", "n", "asked", "d", "t", "r", f.alias("f")))
        out = out.unionByName(known.where("asked").select("gram", F.col("f").alias("value")))
    return out, known.select("gram", "n", "d", "t", "r", "f")


def deeper(gram: np.ndarray, n: np.ndarray, known: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """n, d, t, r and f of the grams of one order, from those of the order below; both in the order of the grams."""
    at = np.searchsorted(known["gram"], suffix_of(gram, int(gram[0] >> 56) - 1))
    n1, d1, t1, r1, f1 = (known[c][at] for c in ("n", "d", "t", "r", "f"))
    first = np.flatnonzero(np.diff(gram >> 8, prepend=-1))
    times = np.diff(first, append=len(gram))
    same = lambda x: np.repeat(np.add.reduceat(x, first), times)
    seen = n > 0
    d, t, x = same(seen.astype(np.int64)), same(n), same(np.where(seen, n1, 0))
    left = d1 - d
    total = left + t1 - x
    with np.errstate(divide="ignore", invalid="ignore"):
        log = np.log10
        r = np.where(n1 > 0, log(n1) - log(total), np.where(left > 0, log(left) - log(total), 0.0) + r1)
        whole = t + d
        f = np.where(t == 0, f1, np.where(seen, log(n) - log(whole), log(d) - log(whole) + r))
    return {"gram": gram, "n": n, "d": d, "t": t, "r": r, "f": f}


def part_values(gram: np.ndarray, n: np.ndarray, known: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(gram, value) of a part's own grams, in their order; ``known`` has order ``TOP`` of its contexts."""
    order = gram >> 56
    level = {ORDER: (gram[order == ORDER], n[order == ORDER])}
    for k in range(ORDER - 1, TOP, -1):
        longer, n_longer = level[k + 1]
        own = order == k
        level[k] = summed(np.concatenate([suffix_of(longer, k), gram[own]]), np.concatenate([n_longer, n[own]]))
    out = np.zeros(len(gram))
    for k in range(TOP + 1, ORDER + 1):
        if not len(level[k][0]):
            break
        known = deeper(*level[k], known)
        own = order == k
        out[own] = known["f"][np.searchsorted(known["gram"], gram[own])]
    return gram, out


NUMBERS = {"gram": "bigint", "n": "bigint", "d": "bigint", "t": "bigint", "r": "double", "f": "double"}
VALUED = "block bigint, kind string, part int, size int, data binary"


def valued_items(parts: int):
    """Rows of parts (what is known of order ``TOP``, the part's sums, the blocks' items) to the blocks' values, packed."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, given, keys, values, words = None, [], None, None, {}

        def ready() -> None:
            nonlocal keys, values
            known = {c: np.concatenate([x[c] for x in given]) for c in NUMBERS} if given else {c: np.zeros(0, np.int64) for c in NUMBERS}
            order = np.argsort(known["gram"], kind="stable")
            known = {c: x[order] for c, x in known.items()}
            if now[1] == parts:
                keys, values = known["gram"], known["f"]
            else:
                keys, values = part_values(*sums, known)

        sums = None
        for batch in batches:
            rows: list[tuple] = []
            where = [batch.column(c).to_pylist() for c in ("kind", "part", "role", "block", "size", "bytes", "items", "counts")]
            numbers = {c: np.asarray(pc.fill_null(batch.column(c), 0)) for c in NUMBERS}
            roles = np.asarray(batch.column("role"))
            i = 0
            while i < batch.num_rows:
                kind, part, role, block, size, n_bytes, items, counts = (x[i] for x in where)
                if (kind, part) != now:
                    now, given, keys, values, words, sums = (kind, part), [], None, None, {}, None
                if role == 0:
                    # The rows of one part that lie in a row.
                    j = i
                    while j < batch.num_rows and roles[j] == 0 and where[1][j] == part and where[0][j] == kind:
                        j += 1
                    given.append({c: numbers[c][i:j] for c in NUMBERS})
                    i = j
                    continue
                i += 1
                if role == 1:
                    if kind == "w":
                        words = dict(zip(grown_words(items, n_bytes), grown(counts, size).tolist(), strict=True))
                    else:
                        sums = (np.cumsum(grown(items, size)), grown(counts, size))
                elif kind == "w":
                    c = np.array([words[w] for w in grown_words(items, n_bytes)], np.int64)
                    rows.append((block, kind, part, size, shrunk(c)))
                else:
                    if keys is None:
                        ready()
                    value = values[np.searchsorted(keys, np.cumsum(grown(items, size)))]
                    rows.append((block, kind, part, size, shrunk(value)))
            kinds = {"block": pa.int64(), "kind": pa.string(), "part": pa.int32(), "size": pa.int32(), "data": pa.binary()}
            yield pa.RecordBatch.from_pydict({c: pa.array([x[k] for x in rows], t) for k, (c, t) in enumerate(kinds.items())})

    return task




def added(parts: int, tokens: int, distinct: int):
    """Rows of a block, its values before its texts, to a row per document."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {"g": [], "w": []}
        for batch in batches:
            kind, size, data = (batch.column(c).to_pylist() for c in ("kind", "size", "data"))
            for r in range(batch.num_rows):
                if kind[r] is not None and kind[r] != "z":
                    held[kind[r]].append(grown(data[r], size[r], "<f8" if kind[r] == "g" else "<i8"))
                    continue
                framed = framed_texts(batch, r)
                block = Block(framed, parts)
                score = block.scores(np.concatenate([np.zeros(0), *held["g"]]))
                c = np.concatenate([np.zeros(0, np.int64), *held["w"]])
                doc, word, times = frequencies(block.tokens, block.at, len(block.words))
                starts = np.searchsorted(doc, np.arange(len(framed)))
                times = times.astype(np.int64)
                known = np.add.reduceat(times * (c > 0)[word], starts)
                # A sum per document on its own, so that its value does not depend on its neighbours.
                base = np.add.reduceat(times * np.log10((c + 0.5) / (tokens + 0.5 * (distinct + 1)))[word], starts)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id")[r].values, "held_out": batch.column("held_out")[r].values, "n_tokens": np.diff(block.at),
                    "n_known": known, "base_score": base, "score": score})
                held = {"g": [], "w": []}

    return task


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per document."""
    f = fold(doc_id, 5)
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(f == 1, F.lit(False)).alias("held_out"),
                      F.coalesce(f != 1, F.lit(False)).alias("teaches"))
    table = text_blocks(src, block_bytes)
    blocks = max(table.count(), 1)
    parts = min(max(blocks, PARTS[0]), PARTS[1])
    items = cut_lineage(table.select("block", "sizes", "data", "teaches").mapInArrow(sent_items(parts), ITEMS))
    merged = cut_lineage(items.repartition(parts, "kind", "part").sortWithinPartitions("kind", "part").mapInArrow(merged_items(parts), MERGED))
    n, v = merged.where("kind = 'w'").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()

    short = merged.where("kind = 'g'").select(F.explode(F.arrays_zip("short", "short_n")).alias("s")).groupBy(F.col("s.short").alias("gram")).agg(F.sum("s.short_n").alias("n"))
    value, known = short_values(cut_lineage(short))
    # A part is told of the contexts that its own begin with.
    context = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF))
    wanted = merged.where((F.col("kind") == "g") & (F.col("part") < parts)).select("part", F.explode("short").alias("gram")).select("part", context.alias("context")).distinct()
    told = wanted.join(known.withColumn("context", context), "context").select("part", *NUMBERS)
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    starts = merged.where((F.col("kind") == "g") & (F.col("part") == parts)).select(F.explode("short").alias("gram"))
    ends = value.join(starts, "gram", "left_semi").select(F.lit(parts).alias("part"), "gram", *[F.lit(0).cast("bigint").alias(c) for c in "ndt"], F.lit(0.0).alias("r"), F.col("value").alias("f"))
    role0 = told.unionByName(ends).select(
        F.lit("g").alias("kind"), "part", F.lit(0).alias("role"), none("block", "bigint"), none("size", "int"), none("bytes", "int"), none("items", "binary"), none("counts", "binary"), *NUMBERS)
    rest = lambda df, role, block: df.select(
        "kind", "part", F.lit(role).alias("role"), block, "size", "bytes", "items", "counts", *[none(c, t) for c, t in NUMBERS.items()])
    role1 = rest(merged.where((F.col("kind") == "w") | (F.col("part") < parts)), 1, none("block", "bigint"))
    role2 = rest(items.withColumn("counts", none("counts", "binary")), 2, F.col("block"))
    dealt = role0.unionByName(role1).unionByName(role2).repartition(parts, "kind", "part").sortWithinPartitions("kind", "part", "role")
    valued = dealt.mapInArrow(valued_items(parts), VALUED)

    kind = table.schema["doc_id"].dataType
    texts = table.select("block", F.lit("z").alias("kind"), none("part", "int"), none("size", "int"), "data", "doc_id", "held_out", "sizes")
    valued = valued.select("*", F.lit(None).cast(kind).alias("doc_id"), none("held_out", "array<boolean>"), none("sizes", "array<bigint>"))
    # About a block a task: what a task gets at once is then a block, however few the parts are.
    by_block = valued.unionByName(texts).repartition(min(blocks, PARTS[1]), "block").sortWithinPartitions("block", "kind", "part")
    out = by_block.mapInArrow(added(parts, int(n), int(v)), (
        f"doc_id {kind.elementType.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")
