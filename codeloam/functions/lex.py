"""String-level functions on source text: stripping, tokens, counts. All stay inside generated JVM code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloam.functions.rules import OPERATORS

TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|\d+(?:\.\d+)?|" + "|".join(re.escape(o) for o in OPERATORS) + r"|[()\[\]{},;:.\\]"
BAG_TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|\d+|[^\sA-Za-z0-9_]"
# a slash pair is a comment only where no operand stands before it
_COMMENTS_AND_TEXTS = r"/\*[\s\S]*?(?:\*/|\z)|<!--[\s\S]*?(?:-->|\z)|#[^\n]*|(?<![A-Za-z0-9._)\]][ \t]{0,80})//[^\n]*|\"(?:\\[\s\S]|[^\"\\])*(?:\"|\z)|'(?:\\[\s\S]|[^'\\])*(?:'|\z)|`(?:\\[\s\S]|[^`\\])*(?:`|\z)"


def literal(pattern: str) -> Column:
    return F.lit(pattern)


def stripped(code: Column) -> Column:
    """Text without comments and without what stands in quotes; a blank is left in place of each."""
    for q in ('"""', "'''"):
        code = F.regexp_replace(code, q + r"[\s\S]*?" + q, " ")
    return F.regexp_replace(code, _COMMENTS_AND_TEXTS, " ")


def line_stripped(code: Column) -> Column:
    """The line-wise variant: everything from a slash pair (but in ``://``) or ``#`` to the line end goes, quoted texts shrink to quotes."""
    code = F.regexp_replace(code, r"(?<!:)//[^\n]*", "")
    code = F.regexp_replace(code, r"#[^\n]*", "")
    code = F.regexp_replace(code, r'"[^"\\]*(?:\\.[^"\\]*)*"', '""')
    return F.regexp_replace(code, r"'[^'\\]*(?:\\.[^'\\]*)*'", "''")


def tokens(code: Column) -> Column:
    return F.regexp_extract_all(stripped(code), F.lit(TOKEN), F.lit(0))


def bag_tokens(code: Column) -> Column:
    return F.regexp_extract_all(code, F.lit(BAG_TOKEN), F.lit(0))


def normal(code: Column) -> Column:
    """Lower case, every run of blanks one blank."""
    return F.lower(F.regexp_replace(code, r"\s+", " "))


def among(toks: Column, words: list[str]) -> Column:
    """How many tokens are among ``words``."""
    return F.size(F.filter(toks, lambda t: t.isin(*words)))


def count_pattern(text: Column, patterns: list[str]) -> Column:
    """Matches of all patterns together."""
    return sum((F.regexp_count(text, F.lit(p)) for p in patterns[1:]), F.regexp_count(text, F.lit(patterns[0])))


def count_text(text: Column, part: str) -> Column:
    """Occurrences of ``part`` that do not overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def count_texts(text: Column, parts: list[str]) -> Column:
    return sum((count_text(text, p) for p in parts[1:]), count_text(text, parts[0]))


def matches_any(text: Column, patterns: list[str]) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def lines(code: Column) -> Column:
    return F.split(code, r"\n")


def words(code: Column) -> Column:
    return F.regexp_extract_all(code, F.lit(r"[A-Za-z_]\w*"), F.lit(0))


def recursive(code: Column, head: str = r"(?:def|function|public\s+\w+\s+\w+|int|void|var)\s+(\w+)\s*\(") -> Column:
    """Does the first defined name occur again, as text, after its definition?"""
    name = F.regexp_extract(code, head, 1)
    first = F.regexp_extract(code, head, 0)
    rest = F.substring(code, F.instr(code, first) + F.length(first), F.length(code))
    return (name != "") & F.contains(rest, name)
