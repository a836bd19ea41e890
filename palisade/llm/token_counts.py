"""Token counts without token ids: pieces are counted once per distinct pre-token, then summed over each document's.

A pre-token is what the tokenizer's own normaliser and pre-tokenizer leave as a unit of its merges, so the tokens of a text
are the sum over its pre-tokens. White space never lies inside one, hence texts are first cut into words and each distinct
word of a block is pre-tokenised once. Special strings inside a text are one token, as the library takes them by default.

Nulls: a null text is empty and has 0 tokens. Every row gives a row, repeated ids included; other columns are ignored.
An empty table gives no rows. Very long texts form a block of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.blocks import Reader, blocks, by_string, document_sums
from palisade.llm.common import coded, split_words

BLOCK_BYTES = 20 << 20
# Marks special strings among pre-tokens; no pre-token of a byte-level vocabulary holds a space.
SPECIAL = " "


def pretokens(tokenizer_path: str) -> Reader:
    import re

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path)
    special = [x.content for x in t.get_added_tokens_decoder().values()]
    cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
    normal = t.normalizer.normalize_str if t.normalizer else str
    split = t.pre_tokenizer.pre_tokenize_str

    def units(word: str) -> list[str]:
        if cut is None or not cut.search(word):
            return [x for x, _ in split(normal(word))]
        parts = cut.split(word)  # every second part is a special string
        return [y for i, x in enumerate(parts) if x for y in ([SPECIAL + x] if i % 2 else [z for z, _ in split(normal(x))])]

    def read(batch: pa.RecordBatch):
        words, at = split_words(batch.column("text"))
        codes, kinds = coded(words)
        found = [units(w) for w in kinds.to_pylist()]
        sizes = np.fromiter(map(len, found), np.int32, len(found))
        unit_codes, unit_kinds = coded(pa.array([u for x in found for u in x], pa.string()))
        del found
        start = (np.cumsum(sizes) - sizes).astype(np.int32)
        # Each word becomes its pre-tokens.
        n = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        place = np.arange(ends[-1], dtype=np.int32)
        place += np.repeat(start[codes] - ends[:-1].astype(np.int32), n)
        out = unit_codes[place]
        n_bytes = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), dtype=np.int64)
        return out, ends[at], unit_kinds, {"n_bytes": n_bytes}

    return read


def pieces(tokenizer_path: str):
    """Count each distinct pre-token of a sorted run once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(tokenizer_path).model
        last, n = None, 0
        for batch in batches:
            codes, kinds = coded(batch.column("string"))
            sizes = []
            for unit in kinds.to_pylist():
                if unit != last:
                    last, n = unit, 1 if unit.startswith(SPECIAL) else len(model.tokenize(unit))
                sizes.append(n)
            yield pa.RecordBatch.from_pydict({
                "block": batch.column("block"), "place": batch.column("place"), "n_tokens": np.asarray(sizes, np.int64)[codes]})

    return count


def count_tokens(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 2048,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per document; ``tokenizer_path`` is a JSON file of the tokenizers library."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    table = blocks(src, lambda: pretokens(tokenizer_path), {"n_bytes": "bigint"}, block_bytes)
    counted = by_string(table).mapInArrow(pieces(tokenizer_path), "block bigint, place int, n_tokens bigint")
    out = document_sums(table, counted, {"n_tokens": "bigint"}, {"n_bytes": "bigint"})
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
