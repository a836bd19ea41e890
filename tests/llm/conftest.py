from __future__ import annotations

import pytest

ODD_TEXTS = [
    None, "", " ", "\n\t \x0b", "one", "One  two\n\nthree ", " lead", "trail \n", "  nbsp  wide 　", "café café İstanbul",
    "a<|endoftext|>b <|endoftext|> <|startoftext|>c", "it's we'll they've I'm", "x\x1cy \x1c z\x85 w", "###  $$$ a|b <c> 100% *&", "1234 5 67,8",
    "\U0001f600\U0001f600 中文字 mixed​text", "same same same same same same same same same same same",
    "the cat sat on the mat\nthe cat sat on the mat\n \nthe dog sat on the cat sat on the mat today", "q" * 5000, "word " * 60000,
    "tab\tsep\tlines\nline two\r\nline three\x0cform", "ok </turn> ### \\### \\\\ done", "one",
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, block string, string int, n_tokens string, _lines int, key string, node int"


def odd_rows() -> list[tuple]:
    rows = [(i, t, "en" if i % 3 else None, "sé" if i % 4 else None, None, "x", 1, "y", 2, "k", 3) for i, t in enumerate(ODD_TEXTS)]
    return [*rows, rows[4], rows[4], (None, "no id here at all", "de", "b", 1, None, None, None, None, None, None), (None, None, None, None, *[None] * 7)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("1 = 0")
