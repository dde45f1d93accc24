"""Regular-expression steps of a rule: cleaning chains, first-match extraction, whole-page lists."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .text import web_trim


def java_replacement(text: str) -> str:
    """Replacement text of web scripts in Java's form: ``$&`` is the match, ``\\`` is literal."""
    out = text.replace("\\", "\\\\")
    out = re.sub(r"\$(?![0-9&<$])", r"\\$", out)
    return out.replace("$$", "\\$").replace("$&", "$0")


@lru_cache(maxsize=4096)
def is_valid_pattern(pattern: str) -> bool:
    """Compile on the JVM, where the pattern will run."""
    spark = SparkSession.getActiveSession()
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except Exception:
        return False


def split_chain(rule: str) -> tuple[str, list[tuple[str, str, bool]]]:
    """``selector##pattern##replacement…`` as the selector and (pattern, replacement, only_first).

    ``@#`` and ``@@`` stand for ``#`` and ``@``; a closing ``###`` marks the last pair.
    """
    def plain(part: str) -> str:
        return part.replace("\u0000", "#").replace("\u0001", "@")

    head, *rest = rule.replace("@#", "\u0000").replace("@@", "\u0001").split("##")
    only_first = bool(rest) and rest[-1] == "#"
    if only_first:
        rest.pop()
    pairs = [(plain(rest[i]), plain(rest[i + 1]) if i + 1 < len(rest) else "") for i in range(0, len(rest), 2)]
    return plain(head), [(p, r, only_first and i == len(pairs) - 1) for i, (p, r) in enumerate(pairs)]


def regex_chain(c: Column, ops: Sequence[tuple[str, str]]) -> Column:
    """Replace every match, pair after pair; a pattern that does not compile is skipped."""
    for pattern, replacement in ops:
        if is_valid_pattern(pattern):
            c = F.regexp_replace(c, F.lit(pattern), F.lit(java_replacement(replacement)))
    return c


def regex_only_one(c: Column, pattern: str, replacement: str) -> Column:
    """The first match alone, rewritten; an empty string where nothing matches."""
    if not is_valid_pattern(pattern):
        return c
    match = F.regexp_extract(c, pattern, 0)
    return F.when(
        c.rlike(pattern), F.regexp_replace(match, F.lit(pattern), F.lit(java_replacement(replacement)))
    ).otherwise("")


def apply_ops(c: Column, ops: Sequence[tuple[str, str, bool]]) -> Column:
    for pattern, replacement, only_first in ops:
        c = regex_only_one(c, pattern, replacement) if only_first else regex_chain(c, [(pattern, replacement)])
    return c


def group_count(pattern: str) -> int:
    spark = SparkSession.getActiveSession()
    compiled = spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    return compiled.matcher("").groupCount()


def regex_all_in_one(c: Column, pattern: str, ops: Sequence[tuple[str, str, bool]] = ()) -> Column:
    """All matches over the raw text, line anchors on: group 1 if there is one, else the match."""
    multi = f"(?m){pattern}"
    if pattern == "" or not is_valid_pattern(multi):
        return F.array().cast("array<string>")
    group = 1 if group_count(multi) > 0 else 0
    hits = F.transform(
        F.regexp_extract_all(c, F.lit(multi), F.lit(group)),
        lambda v: web_trim(apply_ops(F.coalesce(v, F.lit("")), ops)),
    )
    return F.filter(hits, lambda v: v != "")


def compiles(pattern: Column) -> Column:
    """Whether a pattern that is data compiles, asked of the JVM class that will run it."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern).isNotNull()


def replace_by_pairs(c: Column, pairs: Column) -> Column:
    """A chain whose (p, r) pairs are data: ``pairs`` is ARRAY<STRUCT<p,r>> with Java replacements."""
    return F.aggregate(pairs, c, lambda acc, op: F.regexp_replace(acc, op["p"], op["r"]))


def source_replace_pairs(rules_text: Column) -> Column:
    """Cleaning lines of a source (one per line) as pairs.

    The pattern is the first non-empty part of a line and the replacement the part after it, so
    ``##ad text`` and ``ad text##`` both delete, and ``##a##b`` rewrites. Bad patterns are skipped.
    """
    lines = F.filter(
        F.transform(F.split(F.coalesce(rules_text, F.lit("")), "\n"), web_trim),
        lambda x: x.contains("##") & (F.regexp_replace(x, "#", "") != ""),
    )

    def pair(line: Column) -> Column:
        parts = F.split(F.regexp_replace(line, "^(?:##)+", ""), "##")
        replacement = F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
        quoted = F.regexp_replace(F.replace(replacement, F.lit("\\"), F.lit("\\\\")), r"\$(?![0-9])", r"\\\$")
        return F.struct(F.get(parts, F.lit(0)).alias("p"), quoted.alias("r"))

    return F.filter(F.transform(lines, pair), lambda op: compiles(op["p"]))


def source_replace_regex(text: Column, rules_text: Column) -> Column:
    return replace_by_pairs(text, source_replace_pairs(rules_text))
