"""Scalar text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that trimming removes: all Unicode white space and the byte order mark.
SPACE = r"[\s   -     　﻿]"
JS_EXTENSIONS = ("js", "ts", "jsx", "tsx", "mjs", "cjs")


def trim_all(x: Column) -> Column:
    return F.regexp_replace(x, rf"\A{SPACE}+|{SPACE}+\z", "")


def truncate(x: Column, longest: int = 120) -> Column:
    """At most ``longest`` characters, the last three of them dots if something was cut."""
    return F.when(F.length(x) <= longest, x).otherwise(F.concat(F.substring(x, 1, longest - 3), F.lit("...")))


def strip_bom(x: Column) -> Column:
    return F.regexp_replace(x, r"\A﻿", "")


def shannon_entropy(x: Column) -> Column:
    """Bits for each character; 0 for an empty text."""
    letters = F.split(x, "")
    n = F.length(x)

    def add(acc: Column, c: Column) -> Column:
        p = (n - F.length(F.replace(x, c, F.lit("")))) / n
        return acc - p * F.log2(p)

    return F.when(n == 0, F.lit(0.0)).otherwise(F.abs(F.aggregate(F.array_distinct(F.filter(letters, lambda c: c != "")), F.lit(0.0), add)))


def last_extension(path: Column) -> Column:
    """What follows the last dot, in lower case (the whole name if there is none)."""
    return F.lower(F.element_at(F.split(path, r"\."), -1))


def is_js_path(path: Column) -> Column:
    return last_extension(path).isin(*JS_EXTENSIONS)


def has_js_suffix(path: Column) -> Column:
    """As ``is_js_path``, for lower-case suffixes alone."""
    out = F.lit(False)
    for e in JS_EXTENSIONS:
        out = out | F.endswith(path, F.lit("." + e))
    return out


def or_else(x: Column, other: Column) -> Column:
    """``x`` unless it is null or empty."""
    return F.coalesce(F.nullif(x, F.lit("")), other)


def git_version(raw: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(raw, r"git version (\d+\.\d+\.\d+)", 1), F.lit("")), raw)


def commit_record(raw: Column) -> Column:
    """Six NUL-separated fields; null if there are fewer. The text is split once, not once for each field."""
    names = ("sha", "short_sha", "author", "email", "date", "message")
    of = lambda parts: F.when(F.size(parts) >= 6, F.struct(*[F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(names)]))
    return F.get(F.transform(F.array(F.split(trim_all(raw), "\\x00")), of), F.lit(0))
