"""Language identification by a string kernel with Nystroem landmarks and kernel ridge regression.

The kernel of two texts is the number of letter n-grams (n = 1 to 3, word ends as a sign) that both hold, over the root of the
product of their own numbers. Landmark texts span the approximation: a text is seen through its kernel values with them, so
the n-grams of the landmarks are all the features there are. One ridge regression per language on these values gives the
weights. As the kernel is a product of presence vectors, landmarks and weights fold into one matrix (n-grams by languages),
and a batch of texts is scored by one product of its presence matrix with it.

The fit is on a bounded sample: ``per_lang`` labelled texts a language, the first ``landmarks`` of them as landmarks. Every
text is scored, whole. The model's size is bounded by the landmarks' n-grams.

Nulls: a null text, or one without a letter, gives ``und`` with score 0; rows without lang teach nothing; a null id is not held
out and teaches nothing. Without any labelled text everything is ``und``. Repeated rows are scored alike. Other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.llm.common import coded, slices, split_words
from palisade.llm.common import fold as fold_of
from palisade.session import cut_lineage

ORDERS = (1, 2, 3)
UNKNOWN = "und"
DOCS_AT_ONCE = 256
SLICE = 3 << 20
PARTS = 64


class Grams:
    """n-gram codes of words: up to three code points of 21 bits each; what is no letter ends a word."""

    def __init__(self) -> None:
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)

    def of(self, kinds: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word number, code) of all n-grams of the distinct words, and which words hold a letter."""
        lower = pc.utf8_lower(kinds)
        flat = " " + " ".join(lower.to_pylist()) + " "
        code = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.int32).copy()
        n = np.asarray(pc.utf8_length(lower), dtype=np.int64)
        owner = np.zeros(len(code), np.int32)
        if len(n):
            owner[1:] = np.repeat(np.arange(len(n), dtype=np.int32), n + 1)
        is_letter = self.letter[code]
        code[~is_letter] = 32
        has = np.zeros(len(n), bool)
        has[owner[is_letter]] = True
        words, codes = [], []
        for k in ORDERS:
            m = len(code) - k + 1
            if m <= 0:
                continue
            packed = np.zeros(m, np.int64)
            for j in range(k):
                packed = (packed << 21) | code[j : j + m]
            # Letters inside, a word end at the first or last place at most, and a letter somewhere.
            good = is_letter[1 : 1 + m] if k == 3 else (is_letter[:m] if k == 1 else is_letter[:m] | is_letter[1 : 1 + m])
            at = np.flatnonzero(good)
            words.append(owner[at + (1 if k == 3 else 0)] if k != 2 else np.where(is_letter[at], owner[at], owner[at + 1]))
            codes.append(packed[at])
        return np.concatenate(words) if words else np.zeros(0, np.int32), np.concatenate(codes) if codes else np.zeros(0, np.int64), has


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(fold_of(doc_id, 4) == 2, F.lit(False))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct n-grams of each text."""
    grams = Grams()
    for batch in slices(batches, limit=SLICE):
        out = []
        for i in range(batch.num_rows):
            words, _ = split_words(batch.column("text").slice(i, 1))
            out.append(np.unique(grams.of(coded(words)[1])[1]))
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang": batch.column("lang"), "grams": pa.array(out, pa.list_(pa.int64()))})


def fit(docs: DataFrame, per_lang: int = 300, landmarks: int = 48, ridge: float = 1e-2) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, sorted n-gram codes, weights per code and language) from (doc_id, text, lang)."""
    able = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    # A text is a row of its own for the sample, however often its row or its id is repeated.
    kinds = able.select("lang", "doc_id", F.xxhash64("text").alias("copy")).distinct()
    dealt = kinds.withColumn("key", F.xxhash64("doc_id", "copy", F.lit(11))).withColumn("part", F.pmod("key", F.lit(PARTS)))
    # The first of a language are among the first of its parts, so a language of most rows is not ranked in one task.
    for part in (["part"], []):
        dealt = dealt.withColumn("r", F.row_number().over(W.partitionBy("lang", *part).orderBy("key", "doc_id", "copy"))).where(F.col("r") <= per_lang)
    chosen = cut_lineage(dealt.select("lang", "doc_id", "copy"))
    sample = able.withColumn("copy", F.xxhash64("text")).join(F.broadcast(chosen), ["lang", "doc_id", "copy"]).select("doc_id", "lang", "copy", "text")
    sample = sample.dropDuplicates(["lang", "doc_id", "copy"])
    rows = sample.select("doc_id", "lang", "text").mapInArrow(_sets, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, grams array<bigint>").collect()
    texts = {(r.lang, i): np.array(r.grams) for i, r in enumerate(sorted(rows, key=lambda r: (r.lang, str(r.doc_id), r.grams))) if r.grams}
    langs = sorted({lang for lang, _ in texts})
    if not langs:
        return [], np.zeros(0, np.int64), np.zeros((0, 0), np.float32)
    marks = [texts[k] for lang in langs for k in [k for k in texts if k[0] == lang][:landmarks]]
    vocab = np.unique(np.concatenate(marks))
    mark_rows = np.zeros((len(marks), len(vocab)), np.float32)
    for i, g in enumerate(marks):
        mark_rows[i, np.searchsorted(vocab, g)] = 1
    mark_rows /= np.sqrt(mark_rows.sum(1, keepdims=True))
    seen = np.zeros((len(texts), len(vocab)), np.float32)
    for i, g in enumerate(texts.values()):
        seen[i, np.searchsorted(vocab, g[np.isin(g, vocab)])] = 1
    seen /= np.sqrt(np.maximum(seen.sum(1, keepdims=True), 1))
    kernel, inner = (seen @ mark_rows.T).astype(np.float64), (mark_rows @ mark_rows.T).astype(np.float64)
    goal = np.array([[float(lang == k[0]) for lang in langs] for k in texts])
    solved = np.linalg.solve(kernel.T @ kernel + ridge * len(texts) / len(langs) * inner + 1e-6 * np.eye(len(marks)), kernel.T @ goal)
    return langs, vocab, (mark_rows.T.astype(np.float64) @ solved).astype(np.float32)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **how) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per document."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    langs, vocab, weights = fit(src, **how)
    model = docs.sparkSession.sparkContext.broadcast((langs, vocab, weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, vocab, weights = model.value
        grams = Grams()
        for batch in slices(batches, limit=SLICE):
            words, at = split_words(batch.column("text"))
            codes, kinds = coded(words)
            owner, gram, letters = grams.of(kinds)
            place = np.minimum(np.searchsorted(vocab, gram), max(len(vocab) - 1, 0))
            known = vocab[place] == gram if len(vocab) else np.zeros(len(gram), bool)
            order = np.argsort(owner[known], kind="stable")
            place, owner = place[known][order].astype(np.int32), owner[known][order]
            start = np.searchsorted(owner, np.arange(len(kinds) + 1))
            best, value = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            able = np.zeros(batch.num_rows, bool)
            for a in range(0, batch.num_rows, DOCS_AT_ONCE):
                b = min(a + DOCS_AT_ONCE, batch.num_rows)
                presence = np.zeros((b - a, len(vocab)), np.float32)
                for i in range(a, b):
                    own = np.unique(codes[at[i] : at[i + 1]])
                    able[i] = letters[own].any()
                    n = start[own + 1] - start[own]
                    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    presence[i - a, place[np.repeat(start[own], n) + inside]] = 1
                if len(langs):
                    f = presence @ weights / np.sqrt(np.maximum(presence.sum(1, keepdims=True), 1))
                    best[a:b], value[a:b] = f.argmax(1), f.max(1)
            able &= bool(langs)
            names = [langs[j] if ok else UNKNOWN for j, ok in zip(best.tolist(), able.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": pa.array(names, pa.string()),
                "score": np.where(able, np.clip(value, 0.0, 1.0), 0.0)})

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(score, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
