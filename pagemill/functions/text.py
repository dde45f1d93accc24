"""Text columns: whitespace rules, content normalising, HTML flattening, search, titles."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import let

# --- fixed values -----------------------------------------------------------------------------
# White space as scripts on the web see it (wider than Java's \s and Spark's trim).
SPACE_CHARS = (
    "\t \n \x0b \f \r".replace(" ", "")
    + " \u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
)
SPACE_SET = r"\s\x0b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE = f"[{SPACE_SET}]"

# Elements whose edges put a line break into flattened text.
BLOCK_TAGS = (
    "address article aside blockquote caption center dd details div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr legend li main nav ol p pre section summary "
    "table tbody td tfoot th thead tr ul"
).split()
# Elements whose text is never content.
SKIPPED_TAGS = "script style noscript template head title iframe".split()
# Tags that make a value count as HTML.
HTML_HINT_TAGS = (
    "br p div span a img font strong em b i u s ul ol li h[1-6] table thead tbody tr td th "
    "blockquote section article center hr pre code figure figcaption dl dt dd"
).split()
# The commonest named character references ("amp" must stay last), also in the SQL twins.
NAMED_ENTITIES = {
    "nbsp": "\u00a0", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "hellip": "\u2026",
    "mdash": "\u2014", "ndash": "\u2013", "ldquo": "\u201c", "rdquo": "\u201d",
    "lsquo": "\u2018", "rsquo": "\u2019", "laquo": "\u00ab", "raquo": "\u00bb",
    "middot": "\u00b7", "bull": "\u2022", "copy": "\u00a9", "reg": "\u00ae", "trade": "\u2122",
    "times": "\u00d7", "deg": "\u00b0", "ensp": "\u2002", "emsp": "\u2003", "thinsp": "\u2009",
    "amp": "&",
}
# All those that end with a semicolon, the commonest first.
ENTITIES = {f"&{name};": char for name, char in NAMED_ENTITIES.items()} | {f"&{name}": chars for name, chars in html5.items() if name.endswith(";")}
# ----------------------------------------------------------------------------------------------

_BREAK = "\u0001"


def web_trim(c: Column) -> Column:
    """Trim every kind of web white space, not only blanks."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def blank_to_null(c: Column) -> Column:
    """Missing values are empty strings at the edges and NULL inside."""
    trimmed = web_trim(c)
    return F.when(trimmed != "", trimmed)


def norm_key(c: Column) -> Column:
    """Comparison key of a title or author: no white space at all, lower case."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE}+", ""))


def collapse_space(c: Column) -> Column:
    return web_trim(F.regexp_replace(c, f"{SPACE}+", " "))


def normalize_content(c: Column) -> Column:
    """LF line ends, one blank for tab/NBSP/wide-space runs, trimmed lines, no blank lines."""
    unix = let(c, lambda v: F.when(v.contains("\r"), F.regexp_replace(v, r"\r\n?", "\n")).otherwise(v))
    spaced = F.regexp_replace(unix, r"[\t\u00a0\u3000]+", " ")
    lines = F.transform(F.split(spaced, "\n"), web_trim)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def looks_like_html(c: Column) -> Column:
    return F.coalesce(c.rlike(rf"(?i)</?(?:{'|'.join(HTML_HINT_TAGS)})\b[^>]*>"), F.lit(False))


def decode_entities(c: Column) -> Column:
    """Numeric references and all named ones; a reference is decoded once, never twice."""
    return let(c, lambda v: F.when(v.contains("&"), _decoded(v)).otherwise(v))


def _decoded(c: Column) -> Column:
    named = F.from_json(F.lit(json.dumps(ENTITIES)), "map<string,string>")

    def code_point(e: Column) -> Column:
        body = F.regexp_replace(e, "[&#;]", "")
        value = F.when(
            F.lower(F.substring(body, 1, 1)) == "x", F.conv(F.substring(body, 2, 8), 16, 10)
        ).otherwise(body).cast("bigint")
        usable = value.between(1, 0x10FFFF) & ~value.between(0xD800, 0xDFFF)
        return F.decode(F.unhex(F.lpad(F.hex(F.when(usable, value).otherwise(0xFFFD)), 8, "0")), "UTF-32")

    def decoded(piece: Column) -> Column:
        number = F.when(piece.rlike(r"^&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});$"), code_point(piece))
        reference = piece.startswith("&") & piece.endswith(";")
        return F.when(reference, F.coalesce(number, F.try_element_at(named, piece), piece)).otherwise(piece)

    # Pieces end before each ampersand and after each semicolon, so a reference is one piece.
    return F.array_join(F.transform(F.split(c, "(?=&)|(?<=;)"), decoded), "")


def html_to_text(c: Column) -> Column:
    """Flatten HTML: one line break at block edges and <br>, skipped parts dropped, entities decoded.

    A break is not added where the text already ends with one. Pure regular expressions, so whole
    pages are flattened inside the scan stage.
    """
    out = F.regexp_replace(c, r"(?s)<!--.*?(?:-->|\z)", "")
    out = F.regexp_replace(
        out, rf"(?is)<({'|'.join(SKIPPED_TAGS)})\b[^>]*>.*?(?:</\1\s*>|\z)", ""
    )
    out = F.regexp_replace(out, rf"(?i)</?(?:br|{'|'.join(BLOCK_TAGS)})(?:[\s/][^>]*)?>", _BREAK)
    out = F.regexp_replace(out, r"<[a-zA-Z/!?][^>]*>", "")
    out = decode_entities(out)
    out = F.regexp_replace(out, f"{_BREAK}+", _BREAK)
    return F.replace(F.replace(out, F.lit("\n" + _BREAK), F.lit("\n")), F.lit(_BREAK), F.lit("\n"))


def content_text(c: Column) -> Column:
    """Last step of a text chapter: flatten only what looks like HTML, then normalise."""
    return normalize_content(let(c, lambda v: F.when(looks_like_html(v), html_to_text(v)).otherwise(v)))


def quote_literal(text: str) -> str:
    """A literal for a Java pattern."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def search_count(c: Column, query: str) -> Column:
    """Literal, case-insensitive, non-overlapping hits; a blank query matches nothing."""
    needle = query.strip(SPACE_CHARS)
    if needle == "":
        return F.lit(0)
    return F.regexp_count(c, F.lit("(?iu)" + quote_literal(needle)))


def excerpt(c: Column, query: str, radius: int = 40) -> Column:
    """Text around the first hit with ellipses; without a hit the first 2 * radius characters."""
    needle = query.strip(SPACE_CHARS)
    return let(collapse_space(F.coalesce(c, F.lit(""))), lambda plain: _excerpt(plain, needle, radius))


def _excerpt(plain: Column, needle: str, radius: int) -> Column:
    head = F.substring(plain, 1, radius * 2)
    if needle == "":
        return head
    at = F.instr(F.lower(plain), needle.lower())
    start = F.greatest(F.lit(1), at - radius)
    stop = F.least(F.length(plain), at + len(needle) - 1 + radius)
    body = F.concat(
        F.when(start > 1, F.lit("\u2026")).otherwise(""),
        F.substring(plain, start, stop - start + 1),
        F.when(stop < F.length(plain), F.lit("\u2026")).otherwise(""),
    )
    return F.when(at > 0, body).otherwise(head)


# --- fixed values: numerals in chapter titles ---------------------------------------------------
NUMERAL_DIGITS = {
    "零": 0, "〇": 0, "一": 1, "壹": 1, "二": 2, "两": 2, "贰": 2, "三": 3, "叁": 3, "四": 4, "肆": 4,
    "五": 5, "伍": 5, "六": 6, "陆": 6, "七": 7, "柒": 7, "八": 8, "捌": 8, "九": 9, "玖": 9,
}
NUMERAL_UNITS = {"十": 10, "拾": 10, "百": 100, "佰": 100, "千": 1000, "仟": 1000}
TEN_THOUSANDS = "万萬"
HUNDRED_MILLIONS = "亿億"
# ------------------------------------------------------------------------------------------------


def _number_table(table: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def chapter_number(c: Column) -> Column:
    """The first run of Chinese numerals in a title as Arabic digits.

    The run is read left to right with three sums: closed sections, the open section and the digit
    waiting for its unit. A unit without a digit counts as one of it. Titles without a positive
    number stay as they are.
    """
    return let(c, _chapter_number)


def _chapter_number(c: Column) -> Column:
    letters = "".join([*NUMERAL_DIGITS, *NUMERAL_UNITS]) + TEN_THOUSANDS + HUNDRED_MILLIONS
    word = F.regexp_extract(c, f"[{letters}]+", 0)
    digit_of, unit_of = _number_table(NUMERAL_DIGITS), _number_table(NUMERAL_UNITS)

    def sums(closed: Column, section: Column, digit: Column) -> Column:
        return F.struct(closed.alias("closed"), section.alias("section"), digit.alias("digit"))

    zero = F.lit(0).cast("bigint")

    def step(s: Column, ch: Column) -> Column:
        digit, unit = digit_of[ch].cast("bigint"), unit_of[ch].cast("bigint")
        held = F.when(s["digit"] == 0, F.lit(1)).otherwise(s["digit"])
        return (
            F.when(digit.isNotNull(), sums(s["closed"], s["section"], digit))
            .when(unit.isNotNull(), sums(s["closed"], s["section"] + held * unit, zero))
            .when(
                F.lit(TEN_THOUSANDS).contains(ch),
                sums(s["closed"] + (s["section"] + s["digit"]) * 10_000, zero, zero),
            )
            .otherwise(sums((s["closed"] + s["section"] + s["digit"]) * 100_000_000, zero, zero))
        )

    value = F.aggregate(
        F.regexp_extract_all(word, F.lit("."), F.lit(0)),
        sums(zero, zero, zero),
        step,
        lambda s: s["closed"] + s["section"] + s["digit"],
    )
    found = (word != "") & (value > 0)
    first = F.instr(c, word)
    replaced = F.concat(
        F.substring(c, F.lit(1), first - 1),
        value.cast("string"),
        F.substring(c, first + F.length(word), F.length(c)),
    )
    return F.when(found, replaced).otherwise(c)
