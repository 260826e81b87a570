"""Column-expression helpers shared by the operators.

All helpers return built-in Spark expressions (no Python UDFs): rows stay in the
JVM. Inside the lambdas of higher-order functions Spark interprets expressions;
only the projections around them are compiled. Literal regular expressions are
compiled once per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dims

def u(pattern: str, flags: str = "U") -> str:
    """Spark form of a shared pattern: \\w and \\s as in Python's re, Unicode-aware and with \\x1c-\\x1f as blanks."""
    return f"(?{flags})" + pattern.replace(r"\s", r"[\s\x1c-\x1f]")


def strip(col: Column) -> Column:
    """Python ``str.strip()``: drop Unicode white space (and \\x1c-\\x1f) at both ends."""
    return F.btrim(col, F.lit(dims.STRIP_CHARS))


def split_lines(text: Column) -> Column:
    """Python ``str.splitlines()`` as an array: no phantom last line, '' -> [].

    One trailing line break is removed before splitting (``\\z`` = very end), so
    ``split`` runs once per file.
    """
    body = F.regexp_replace(text, f"(?:{dims.LINE_BREAK_REGEX})\\z", "")
    return F.when(text == F.lit(""), F.array().cast("array<string>")).otherwise(
        F.split(body, dims.LINE_BREAK_REGEX, -1))


def any_contains(col: Column, fragments: Sequence[str]) -> Column:
    """True when any fragment occurs in ``col`` (plain substring test)."""
    out = F.lit(False)
    for frag in fragments:
        out = out | F.contains(col, F.lit(frag))
    return out


def first_group(col: Column, patterns: Sequence[str]) -> Column:
    """Group 1 of the first pattern that matches, else NULL (patterns tried in order).

    With several patterns, one combined test runs first; the ordered extraction
    only runs on the (rare) lines that match at all.
    """
    if not patterns:
        return F.lit(None).cast("string")
    pick = F.coalesce(*[F.nullif(F.regexp_extract(col, u(p), 1), F.lit("")) for p in patterns])
    if len(patterns) == 1:
        return pick
    return F.when(any_match(col, patterns), pick)


def any_match(col: Column, patterns: Sequence[str]) -> Column:
    if not patterns:
        return F.lit(False)
    return F.regexp_like(col, F.lit(u("|".join(f"(?:{p})" for p in patterns))))


def by_language(language: Column, table: Mapping[str, Column] | Mapping[int, Column], default: Column) -> Column:
    """CASE language WHEN ... : one literal-pattern branch per language."""
    expr = None
    for lang, value in table.items():
        expr = (F.when(language == F.lit(lang), value) if expr is None
                else expr.when(language == F.lit(lang), value))
    return default if expr is None else expr.otherwise(default)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den as DOUBLE, 0.0 when den is 0 (ANSI-safe)."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def pct1(x: Column) -> Column:
    """Format a percentage with one decimal from a DOUBLE fraction (0.1234 -> '12.3').

    The value is rounded half-up on tenths with IEEE arithmetic, so the SQL oracle
    can reproduce the text exactly.
    """
    tenths = F.floor(x * F.lit(1000.0) + F.lit(0.5)).cast("bigint")
    return F.concat(F.floor(tenths / 10).cast("bigint").cast("string"), F.lit("."),
                    F.pmod(tenths, F.lit(10)).cast("string"))


def pct0(x: Column) -> Column:
    """Whole-number percentage text from a DOUBLE fraction (0.456 -> '46')."""
    return F.floor(x * F.lit(100.0) + F.lit(0.5)).cast("bigint").cast("string")


def lookup_map(mapping: Mapping[str, str]) -> Column:
    """Literal MAP<STRING,STRING> (constant-folded once per query)."""
    kv = []
    for k, v in mapping.items():
        kv += [F.lit(k), F.lit(v)]
    return F.create_map(*kv)
