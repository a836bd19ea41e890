"""Best-fit packing of documents into sequences: local best-fit, full bins leave, all the others merge by their counts.

Round 0 tokenises, cuts longer documents into pieces and packs each slice of pieces by best-fit decreasing. Every bin that is
not full then meets those of all tasks, as an item of its fill: best-fit decreasing over all of them, so that no two sequences
of the result fit together. Items of one size are alike and best-fit depends on sizes alone, so it needs to know only how many
bins have each fill: ``room`` numbers, whatever the size of the table. It works on stretches of equal bins and gives each
stretch its place; a bin finds its own by its fill and its rank among the bins of that fill. No task gathers bins.

Nulls: a null text is empty: one end id. Every row is packed, repeated ids and rows included. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import coded, slices, text_or_empty
from palisade.session import cut_lineage

LEFT = 1 << 62  # numbers from here on are those of sequences of several bins
WINDOW = 1 << 17  # pieces that are packed together
SLICE = 2 << 20  # bytes of text tokenised at once: their units, ids and places take many times as much
# White space before a space: there a run of white space could end in the middle of a unit.
UNSAFE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}] |[\s\x0b\x1c-\x1f\x{85}\p{Z}]\z"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Ids:
    """Ids of texts under a byte-level BPE file of the tokenizers library, equal to the library's own.

    When the file's ids are its merge ranks, merges run in the faster rank encoder and each distinct unit (a space and the
    characters up to the next one) of a slice is encoded once; any other file goes through the library text by text.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            self.fast = self._ranks(json.load(f))
        self.path = path

    @cached_property
    def library(self):
        """The library's own tokenizer; a worker that goes by ranks does without."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _ranks(self, spec: dict):
        import tiktoken

        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = (model.get("type") == "BPE" and pre == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
                 and not spec.get("normalizer") and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
                 and all(not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]) for x in spec["added_tokens"]))
        vocab, special = model["vocab"], {x["content"]: x["id"] for x in spec["added_tokens"]}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        if not plain or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
            return None
        seen = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
        byte_of = {chr(c): c for c in seen} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in seen)}
        ranks = {bytes(byte_of[c] for c in s): i for s, i in vocab.items() if s not in special}
        self.size = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)
        for token, i in special.items():
            self.size[i] = len(token.encode())
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def whole(self, text: str) -> np.ndarray:
        if self.fast is None:
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special="all")

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and per text where they begin."""
        texts = pc.fill_null(texts, "")
        if self.fast is None:
            ids = [self.whole(t) for t in texts.to_pylist()]
            return np.concatenate([*ids, np.zeros(0, np.uint32)]), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        odd = np.asarray(pc.or_(pc.match_substring_regex(texts, UNSAFE), pc.equal(pc.binary_length(texts), 0)))
        n = len(texts)
        lists = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        sizes = np.asarray(pc.list_value_length(lists), dtype=np.int64)
        first = np.zeros(sizes.sum(), bool)
        first[np.cumsum(sizes) - sizes] = True
        units = pc.if_else(pa.array(first), pc.list_flatten(lists), pc.binary_join_element_wise(" ", pc.list_flatten(lists), ""))
        codes, kinds = coded(units)
        table, start = self._each(kinds)
        count = np.diff(start)[codes]
        ids = _gather(table, start[codes], count)
        length = np.zeros(n, np.int64)
        length[~odd] = np.add.reduceat(np.append(count, 0), np.cumsum(sizes) - sizes) if len(sizes) else 0
        alone = {i: self.whole(texts[i].as_py()) for i in np.flatnonzero(odd)}
        for i, x in alone.items():
            length[i] = len(x)
        at = np.concatenate([[0], np.cumsum(length)])
        if not alone:
            return ids, at
        out = np.empty(at[-1], np.uint32)
        mask = np.ones(at[-1], bool)
        for i, x in alone.items():
            out[at[i] : at[i + 1]] = x
            mask[at[i] : at[i + 1]] = False
        out[mask] = ids
        return out, at

    def _each(self, kinds: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, one after the other. Units that begin with a space are encoded in one text and told apart by bytes."""
        spaced = np.asarray(pc.starts_with(kinds, " "), dtype=bool)
        joined = "".join(kinds.filter(pa.array(spaced)).to_pylist())
        ids = self.fast.encode_to_numpy(joined, allowed_special="all").astype(np.uint32)
        ends = np.cumsum(self.size[ids])
        cuts = np.concatenate([[0], np.searchsorted(ends, np.cumsum(np.asarray(pc.binary_length(kinds.filter(pa.array(spaced))), dtype=np.int64)), "right")])
        others = [self.whole(x) for x in kinds.filter(pa.array(~spaced)).to_pylist()]
        count = np.zeros(len(kinds), np.int64)
        count[spaced], count[~spaced] = np.diff(cuts), [len(x) for x in others]
        place = np.zeros(len(kinds), np.int64)
        place[spaced] = cuts[:-1]
        place[~spaced] = len(ids) + np.cumsum(count[~spaced]) - count[~spaced]
        table = np.concatenate([ids, *others]).astype(np.uint32)
        start = np.concatenate([[0], np.cumsum(count)])
        return _gather(table, place, count), start


def _gather(table: np.ndarray, place: np.ndarray, count: np.ndarray) -> np.ndarray:
    """table[place[i] : place[i] + count[i]] for all i, one after the other."""
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return table[np.repeat(place, count) + inside]


def best_fit(sizes: np.ndarray, room: int) -> list[list[int]]:
    """Best-fit decreasing: item numbers per bin. Bins are kept by the space left, so an item costs O(log room)."""
    by_gap: dict[int, list[int]] = {}
    gaps: list[int] = []  # the different gaps, sorted
    bins: list[list[int]] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        k = bisect.bisect_left(gaps, size)
        if k == len(gaps):
            b, left = len(bins), room - size
            bins.append([i])
        else:
            gap = gaps[k]
            same = by_gap[gap]
            b = same.pop()
            if not same:
                del by_gap[gap], gaps[k]
            bins[b].append(i)
            left = gap - size
        if left:
            if left not in by_gap:
                bisect.insort(gaps, left)
                by_gap[left] = []
            by_gap[left].append(b)
    return bins


PIECE = "doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, node bigint, fill int, rank bigint"


def _emit(cols: dict[str, np.ndarray | pa.Array], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) if not isinstance(v, pa.Array) else v for v, t in zip(cols.values(), types, strict=True)], list(cols))


def pack(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", room: int = 2048, end: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then ``end``. Pieces of a longer one are full but for the first.
    """
    src = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    schema = PIECE.format(kind=kind)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, task, made, met = Ids(tokenizer_path), TaskContext.get().partitionId(), 0, np.zeros(room + 1, np.int64)
        waiting: list[dict] = []
        for batch in slices(batches, limit=SLICE):
            waiting.append(_cut(batch, ids_of, room, end))
            if sum(len(w["length"]) for w in waiting) >= WINDOW:
                out, made = _pack_pieces(waiting, room, task, made, met)
                yield out
                waiting = []
        if waiting:
            yield _pack_pieces(waiting, room, task, made, met)[0]

    # node: the task that the bin waits in, null for a bin that is full; rank: its place among the task's bins of its fill.
    table = cut_lineage(src.mapInArrow(first, schema))
    done, rest = table.where(F.col("node").isNull()), table.where(F.col("node").isNotNull())
    # Of each fill: the bins of the tasks ahead, and all.
    found = cut_lineage(rest.groupBy("node", "fill").agg((F.max("rank") + 1).alias("n")))
    ahead = found.select("node", "fill", (F.sum("n").over(Window.partitionBy("fill").orderBy("node")) - F.col("n")).alias("ahead"))
    total = {r.fill: r.n for r in found.groupBy("fill").agg(F.sum("n").alias("n")).collect()}
    placed = rest.join(ahead, ["node", "fill"]).withColumn("rank", F.col("rank") + F.col("ahead")).select(*table.columns)
    return done.unionByName(placed.mapInArrow(_moved(counted_best_fit(total, room)), schema)).drop("node", "fill", "rank")


def _cut(batch: pa.RecordBatch, ids_of: Ids, room: int, end: int) -> dict:
    """Pieces of a slice of documents."""
    ids, at = ids_of.of(batch.column("text"))
    n = np.diff(at) + 1
    full = np.empty(at[-1] + len(n), "<u4")
    mark = np.zeros(len(full), bool)
    mark[np.cumsum(n) - 1] = True
    full[mark], full[~mark] = end, ids
    begin = np.cumsum(n) - n
    pieces = -(-n // room)
    doc = np.repeat(np.arange(len(n)), pieces)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    short = n - (pieces - 1) * room  # length of the first piece
    start = np.where(nth == 0, 0, short[doc] + (nth - 1) * room)
    length = np.where(nth == 0, short[doc], room)
    raw, where = memoryview(full).cast("B"), (begin[doc] + start) * 4
    crc = np.fromiter((zlib.crc32(raw[a : a + 4 * k]) for a, k in zip(where.tolist(), length.tolist(), strict=True)), np.int64, len(doc))
    return {"doc_id": batch.column("doc_id").take(pa.array(doc)), "piece": nth, "start": start, "length": length, "ids_crc32": crc}


def _pack_pieces(waiting: list[dict], room: int, task: int, made: int, met: np.ndarray) -> tuple[pa.RecordBatch, int]:
    """The packed pieces; ``met`` counts the task's bins of each fill."""
    cols = {c: np.concatenate([w[c] for w in waiting]) for c in ("piece", "start", "length", "ids_crc32")}
    doc_id = pa.concat_arrays([w["doc_id"] for w in waiting])
    n = len(doc_id)
    seq, offset, fill = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    bins = best_fit(cols["length"], room)
    fills = np.zeros(len(bins), np.int64)
    for b, items in enumerate(bins):
        at = 0
        for i in items:
            seq[i], offset[i] = b, at
            at += int(cols["length"][i])
        fills[b] = at
        fill[items] = at
    rank = np.zeros(len(bins), np.int64)
    order = np.argsort(fills, kind="stable")
    sizes, at, n_of = np.unique(fills[order], return_index=True, return_counts=True)
    rank[order] = np.arange(len(bins)) - np.repeat(at - met[sizes], n_of)
    met[sizes] += n_of
    node = pa.array(np.full(n, task, np.int64), mask=fill == room)
    ids = (task << 40) + made + seq
    types = [doc_id.type, pa.int32(), *[pa.int64()] * 6, pa.int32(), pa.int64()]
    return _emit({"doc_id": doc_id, **cols, "sequence_id": ids, "offset": offset, "node": node, "fill": fill, "rank": rank[seq]}, types), made + len(bins)


def counted_best_fit(total: dict[int, int], room: int) -> dict[str, np.ndarray]:
    """Best-fit decreasing of ``total[size]`` items of each size, as stretches of items.

    A stretch: the items of one ``size`` from rank ``first`` on, ``each`` of them a bin, from the bin ``bin`` on, in it from
    ``offset`` on; ``alone`` if nothing else is in these bins. Stretches are sorted by size and rank and hold every item. Bins of one content are a row: what is left of its
    room, how many there are, and per size (size, rank of its first item, items a bin, offset). An item goes to the smallest gap
    that takes it and so do its like, until that bin takes no more; then comes the next bin of the row.
    """
    by_gap: dict[int, list[tuple[int, tuple]]] = {}
    gaps: list[int] = []  # the different gaps, sorted

    def keep(gap: int, n: int, content: tuple) -> None:
        if n and gap not in by_gap:
            bisect.insort(gaps, gap)
            by_gap[gap] = []
        if n:
            by_gap[gap].append((n, content))

    for size in sorted(total, reverse=True):
        left, rank = total[size], 0
        while left:
            k = bisect.bisect_left(gaps, size)
            if k < len(gaps):
                gap = gaps[k]
                n, content = by_gap[gap].pop()
                if not by_gap[gap]:
                    del by_gap[gap], gaps[k]
            else:
                gap, n, content = room, -(-left // (room // size)), ()
            each = gap // size
            whole = min(n, left // each)  # bins that take as many as fit
            more = left - whole * each if whole < n else 0  # and one that takes the last
            for bins, items in ((whole, each), (int(more > 0), more)):
                keep(gap - items * size, bins, (*content, (size, rank, items, room - gap)))
                rank, left, content = rank + bins * items, left - bins * items, _behind(content, bins)
            keep(gap, n - whole - (more > 0), content)
    rows, at = [], 0
    for gap in gaps:
        for n, content in by_gap[gap]:
            alone = len(content) == 1 and content[0][2] == 1
            rows += [(size, first, items, at, offset, alone) for size, first, items, offset in content]
            at += n
    return dict(zip(("size", "first", "each", "bin", "offset", "alone"), np.array(sorted(rows), np.int64).reshape(-1, 6).T, strict=True))


def _behind(content: tuple, bins: int) -> tuple:
    """The content of a row behind its first bins."""
    return tuple((size, first + bins * items, items, offset) for size, first, items, offset in content)


def _moved(plan: dict[str, np.ndarray]):
    """Pieces of the bins that were not full, where the plan has these; a bin's pieces move by what lies ahead of it."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (plan["size"] << 48) + plan["first"]
        for batch in batches:
            fill, rank, offset = (np.asarray(batch.column(c)).astype(np.int64) for c in ("fill", "rank", "offset"))
            i = np.searchsorted(key, (fill << 48) + rank, "right") - 1
            nth, inside = np.divmod(rank - plan["first"][i], plan["each"][i])
            name = np.where(plan["alone"][i], np.asarray(batch.column("sequence_id")), LEFT + plan["bin"][i] + nth)
            new = {"sequence_id": name, "offset": offset + plan["offset"][i] + inside * fill}
            yield pa.RecordBatch.from_arrays([pa.array(new[c]) if c in new else batch.column(c) for c in batch.schema.names], batch.schema.names)

    return move
