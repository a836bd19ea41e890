"""Text helpers used by the detectors: entropy, redaction, decoding, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.coerce import _col, let

SEPARATOR = "\u0001"


def entropy(x: Column | str) -> Column:
    """Shannon entropy in bits per character, rounded to 6 digits; NULL for ''."""

    def total_bits(v: Column) -> Column:
        total = F.length(v).cast("double")

        def bits(acc: Column, c: Column) -> Column:
            p = F.try_divide(total - F.length(F.replace(v, c, F.lit(""))), total)
            return acc - p * F.log2(p)

        chars = F.array_distinct(F.filter(F.split(v, ""), lambda c: c != ""))
        return F.when(total > 0, F.round(F.aggregate(chars, F.lit(0.0), bits), 6))

    return let(_col(x), total_bits)


def redact(x: Column | str) -> Column:
    """First four characters only, so that reports leak nothing."""
    return F.concat(F.substring(_col(x), 1, 4), F.lit("***"))


def normalize_match(x: Column | str) -> Column:
    return F.lower(F.trim(_col(x)))


def fingerprint(repo: Column, path: Column, rule_id: Column, match: Column) -> Column:
    """Stable identity of a finding: no line number, so it survives line shifts."""
    return F.sha2(F.concat_ws(SEPARATOR, repo, path, rule_id, normalize_match(match)), 256)


def url_decoded(x: Column | str) -> Column:
    """URL-decode until nothing changes: a sign that was encoded n times over is told by the ``25`` behind its percent sign."""
    x = _col(x)
    once = lambda v: F.coalesce(F.try_url_decode(v), v)
    again = F.array_max(F.transform(F.regexp_extract_all(x, F.lit("%((?:25)+)"), F.lit(1)), F.length))
    deep = F.aggregate(F.sequence(F.lit(0), F.floor(again / 2).cast("int")), x, lambda acc, _: once(acc))
    return F.when(F.contains(x, F.lit("%25")), deep).otherwise(once(x))


def without_sql_comments(x: Column) -> Column:
    """Comments that stand for white space become a blank; of ``/*! … */`` the inside is code."""
    plain = F.regexp_replace(F.regexp_replace(x, r"/\*![0-9]*([\s\S]*?)\*/", " $1 "), r"/\*[\s\S]*?\*/", " ")
    return F.when(F.contains(x, F.lit("/*")), plain).otherwise(x)


def decode_payload(x: Column | str) -> Column:
    """URL-decode, blank SQL comments, then replace CHAR(n,…) runs by the characters they spell."""

    def spell(acc: Column, numbers: Column) -> Column:
        text = F.array_join(
            F.transform(F.split(numbers, ","), lambda n: F.char(n.cast("int"))), ""
        )
        call = F.concat(F.lit("CHAR("), numbers, F.lit(")"))
        return F.replace(F.replace(acc, call, text), F.lower(call), text)

    def decode(plain: Column) -> Column:
        calls = F.regexp_extract_all(plain, F.lit(r"(?i)CHAR[(]([0-9]{1,3}(?:,[0-9]{1,3})*)[)]"), F.lit(1))
        # Most requests hold no such call: those skip the pattern.
        return F.when(F.contains(F.lower(plain), F.lit("char(")), F.aggregate(calls, plain, spell)).otherwise(plain)

    return let(without_sql_comments(url_decoded(x)), decode)


def luhn_valid(digits: Column | str) -> Column:
    """Luhn checksum over a string of decimal digits."""

    def weigh(d: Column, i: Column) -> Column:
        doubled = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, doubled).otherwise(d)

    def check(rev: Column) -> Column:
        total = F.aggregate(F.transform(rev, weigh), F.lit(0), lambda a, d: a + d)
        return (F.size(rev) > 0) & (total % 10 == 0)

    rev = F.transform(F.split(F.reverse(_col(digits)), ""), lambda c: c.try_cast("int"))
    return let(F.filter(rev, lambda c: c.isNotNull()), check)


def split_words(x: Column | str) -> Column:
    return F.filter(F.split(_col(x), r"[ \n\t\r]+"), lambda w: w != "")


def host(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), r"^[a-z]+://([^/?#:]+)", 1)


def path_template(url: Column | str) -> Column:
    """Path of a URL with runs of digits replaced by ``{id}``."""
    path = F.regexp_extract(_col(url), r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    return F.regexp_replace(path, "[0-9]+", "{id}")


def sha256_text(x: Column | str) -> Column:
    return F.sha2(_col(x), 256)
