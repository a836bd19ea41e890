"""YAML read from lines: values, any split, and the tables of descriptions."""

from __future__ import annotations

import json

from hypothesis import given, settings
from hypothesis import strategies as st
import pytest

from palisade.sources import specs as S
from palisade.sources import yaml_rows as Y
from palisade.sources.lines import read_lines
from palisade.sources.tables import Tables

TEXT = '''# head
openapi: 3.0.3   # version
info:
  title: "A \\"q\\" title: x"
  long: >-
    folded text
    more: here

    # not a comment
  lit: |
    key: value
      - deeper
    # kept

  plain: one
    two
    three # gone
  quoted: "a
    b: c

    d"
  below:
    text under
    it
  flow below:
    [1,
     {a: b}]
empty:
nulls: ~
'200':
  - a
  - b: 1
    c: [x, "y z", {k: v, l: []}]
  -
    - n1
    - n2
  - - m1
    - m2: !tag &anchor q
same:
- 1
-   two: 2
    three: true
flow: {a: 1, "b": [1, 2.5],
  c: null}
e1: []
e2: {}
url: http://x:80/y#z
k with space: v
'''
WANT = [
    ("openapi", "string", "3.0.3"), ("info/title", "string", 'A "q" title: x'), ("info/long", "string", "folded text more: here\n# not a comment"),
    ("info/lit", "string", "key: value\n  - deeper\n# kept\n"), ("info/plain", "string", "one two three"), ("info/quoted", "string", "a b: c\nd"),
    ("info/below", "string", "text under it"), ("info/flow below/0", "integer", "1"), ("info/flow below/1/a", "string", "b"), ("empty", "null", None), ("nulls", "null", None),
    ("200/0", "string", "a"), ("200/1/b", "integer", "1"), ("200/1/c/0", "string", "x"), ("200/1/c/1", "string", "y z"), ("200/1/c/2/k", "string", "v"), ("200/1/c/2/l", "array", None),
    ("200/2/0", "string", "n1"), ("200/2/1", "string", "n2"), ("200/3/0", "string", "m1"), ("200/3/1/m2", "string", "q"),
    ("same/0", "integer", "1"), ("same/1/two", "integer", "2"), ("same/1/three", "boolean", "true"), ("flow/a", "integer", "1"), ("flow/b/0", "integer", "1"),
    ("flow/b/1", "number", "2.5"), ("flow/c", "null", None), ("e1", "array", None), ("e2", "object", None), ("url", "string", "http://x:80/y#z"), ("k with space", "string", "v"),
]


def rows(spark, *files, partitions=1):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(files)], "path string, content string")
    return Y.yaml_rows(Y.text_lines(df), partitions)


def found(df):
    return sorted((r.file, r.doc, "/".join(r.path), r.type, r.value or "") for r in df.collect())


def test_values(spark):
    got = rows(spark, TEXT).collect()
    assert sorted(("/".join(r.path), r.type, r.value or "") for r in got) == sorted((p, t, v or "") for p, t, v in WANT)


@pytest.mark.parametrize("partitions", [3, 17, 50])
def test_a_file_in_many_ranges(spark, partitions):
    assert found(rows(spark, TEXT, "a: 1", TEXT, partitions=partitions)) == found(rows(spark, TEXT, "a: 1", TEXT))


def test_long_lists_count_across_ranges(spark):
    text = "top:\n" + "".join(f"- name: n{i}\n  sub:\n  - x{i}\n  - y\n" for i in range(200)) + "end: 1\n"
    got = {(tuple(r.path), r.value) for r in rows(spark, text, partitions=13).collect()}
    want = {(("end",), "1")} | {(("top", str(i), *p), v) for i in range(200) for p, v in [(("name",), f"n{i}"), (("sub", "0"), f"x{i}"), (("sub", "1"), "y")]}
    assert got == want


def test_documents_and_odd_files(spark):
    assert found(rows(spark, "a: 1\n---\na: 2\nb:\n- x\n---\n- y\n", "", "# only\n\n", "plain words", '{"a": [1, {"b": "c d"}],\n"e": {}}', "a:\r\n  b: 1\r\n")) == [
        ("0", 0, "a", "integer", "1"), ("0", 1, "a", "integer", "2"), ("0", 1, "b/0", "string", "x"), ("0", 2, "0", "string", "y"),
        ("3", 0, "", "string", "plain words"), ("4", 0, "a/0", "integer", "1"), ("4", 0, "a/1/b", "string", "c d"), ("4", 0, "e", "object", ""), ("5", 0, "a/b", "integer", "1")]


def test_from_files(spark, tmp_path):
    (tmp_path / "a.yaml").write_text(TEXT)
    got = Y.yaml_rows(read_lines(spark, str(tmp_path)))
    assert sorted(("/".join(r.path), r.value or "") for r in got.collect()) == sorted((p, v or "") for p, _, v in WANT)


SCALARS = st.one_of(st.none(), st.booleans(), st.integers(-999, 999), st.text(st.sampled_from("ab :#-'\"\\{[,]}\né|>&"), max_size=12))
TREES = st.recursive(SCALARS, lambda t: st.lists(t, max_size=3) | st.dictionaries(st.sampled_from(["a", "b c", "200", "x-y", "$ref"]), t, max_size=3), max_leaves=8)


def leaves(tree, path=()):
    if isinstance(tree, dict) and tree:
        return [x for k, v in tree.items() for x in leaves(v, (*path, k))]
    if isinstance(tree, list) and tree:
        return [x for i, v in enumerate(tree) for x in leaves(v, (*path, str(i)))]
    kind = {bool: "boolean", int: "integer", str: "string", list: "array", dict: "object", type(None): "null"}[type(tree)]
    return [(path, kind, None if kind in ("array", "object", "null") else str(tree).lower() if kind == "boolean" else str(tree))]


def written(tree, indent=0) -> str:
    """The tree in block style; texts in double quotes."""
    pad = " " * indent
    if isinstance(tree, dict) and tree:
        return "".join(f"{pad}{json.dumps(k)}:" + nested(v, indent + 2) for k, v in tree.items())
    return "".join(f"{pad}-" + nested(v, indent + 2) for v in tree)


def nested(v, indent):
    return "\n" + written(v, indent) if isinstance(v, dict | list) and v else f" {json.dumps(v, ensure_ascii=False)}\n"


def walk(text: str):
    """Leaves of a text by the functions the tasks run, in one stretch."""
    stretch = Y.Stretch()
    nodes = [r for r in (stretch.line(n, line) for n, line in enumerate(text.split("\n"))) if r["kind"].startswith("node:")]
    parents = {(e["at"], e["rank"]) for r in nodes for e in r["entries"][:-1]}
    for r in nodes:
        own = r["entries"][-1]
        if (own["at"], own["rank"]) not in parents:
            path = tuple(str(e["nth"]) if e["item"] else e["label"] for e in r["entries"])
            for more, kind, value in Y.value_of(r["kind"][5:], r["value"], [], 0):
                yield (*path, *more), kind, value


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.lists(TREES, min_size=1, max_size=3), st.dictionaries(st.sampled_from(["k", "key two", "0"]), TREES, min_size=1, max_size=3)))
def test_trees_in_block_style(tree):
    assert sorted(walk(written(tree)), key=str) == sorted(leaves(tree), key=str)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.lists(TREES, min_size=1), st.dictionaries(st.sampled_from(["k", "key two", "0"]), TREES, min_size=1)))
def test_trees_in_flow_style(tree):
    got = [(tuple(p), k, v) for p, k, v in Y.flow_leaves(json.dumps(tree, ensure_ascii=False))]
    assert sorted(got, key=str) == sorted(leaves(tree), key=str)


@pytest.mark.parametrize("header, want", [
    ("|", "a\n b\n\nc\n"), ("|-", "a\n b\n\nc"), ("|+", "a\n b\n\nc\n\n"), (">", "a\n b\n\nc\n"), ("|1", "a\n b\n\nc\n")])
def test_block_scalars(header, want):
    assert Y.block_text(header, ["  a", "   b", "", "  c", ""], 1) == want


def test_folding():
    assert Y.block_text(">-", ["a", "b", "", "c", "  d", "e"], 0) == "a b\nc\n  d\ne"


def test_both_spellings_give_the_same_tables(spark, sf):
    t = Tables(spark, sf)
    by_yaml, by_json = S.spec_tables(Y.yaml_rows(Y.text_lines(t.spec_yaml))), S.read_openapi(t.spec_json)
    for name, df in by_json.items():
        mine = by_yaml[name].select(*df.columns)
        assert mine.count() == df.count() > 0
        assert mine.exceptAll(df).count() == 0, name


def test_references_of_yaml(spark, sf):
    api = S.spec_tables(Y.yaml_rows(Y.text_lines(Tables(spark, sf).spec_yaml)))
    got = {r.field_path for r in S.resolve_refs(api["responses"], api["schema_fields"]).where("spec = '3'").collect()}
    assert got == {"id", "title", "owner", "owner.email"}
