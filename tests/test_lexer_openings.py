"""What stands ahead of a comment's opening is no part of it."""

import pyarrow as pa

from palisade.functions import lexer


def test_a_slash_ahead_of_dashes_is_code():
    assert lexer.masked(pa.array(["/--", "/--x", "a-/*b*/-", "//--"]), "sql", "code").to_pylist() == ["/  ", "/   ", "a-     -", "//  "]
