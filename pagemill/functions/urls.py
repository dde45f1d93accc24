"""Addresses: resolving, request options behind an address, hosts, page templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import let
from .text import web_trim

_PARTS = r"(?is)^(https?):/*([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
# An option block starts at a comma before a brace; "<," opens an optional page segment instead.
OPTIONS_AT = r"(?<!<),\s*\{"


def _percent_encode(value: Column, unsafe: str) -> Column:
    """Percent-encode single characters of the class ``unsafe`` (UTF-8, upper-case digits)."""
    def encoded(ch: Column) -> Column:
        return F.regexp_replace(F.hex(F.encode(ch, "utf-8")), "(..)", r"%$1")

    def all_encoded(c: Column) -> Column:
        chars = F.array_distinct(F.regexp_extract_all(c, F.lit(unsafe), F.lit(0)))
        return F.when(
            c.rlike(unsafe), F.aggregate(chars, c, lambda acc, ch: F.replace(acc, ch, encoded(ch)))
        ).otherwise(c)

    return let(value, all_encoded)


def _drop_dots(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments."""
    def fold(segments: Column) -> Column:
        folded = F.aggregate(
            segments,
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc)
            .otherwise(F.concat(acc, F.array(s))),
        )
        tail = F.when(F.element_at(segments, -1).isin("..", "."), F.array(F.lit(""))).otherwise(
            F.array().cast("array<string>")
        )
        return F.concat(F.lit("/"), F.array_join(F.concat(folded, tail), "/"))

    return let(
        path,
        lambda p: F.when(p.contains("/."), let(F.split(F.substr(p, F.lit(2)), "/"), fold)).otherwise(p),
    )


def _canonical(u: Column) -> Column:
    scheme = F.lower(F.regexp_extract(u, _PARTS, 1))
    host = F.lower(F.regexp_extract(u, _PARTS, 2))
    default_port = F.when(scheme == "http", F.lit(":80$")).otherwise(F.lit(":443$"))
    path = F.replace(F.regexp_extract(u, _PARTS, 3), F.lit("\\"), F.lit("/"))
    rooted = let(path, lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p)))
    return F.concat(
        scheme, F.lit("://"), F.regexp_replace(host, default_port, ""),
        _percent_encode(_drop_dots(rooted), r'[^\x21-\x7e]|["<>`{}^]'),
        _percent_encode(F.regexp_extract(u, _PARTS, 4), r"""[^\x21-\x7e]|["<>']"""),
        _percent_encode(F.regexp_extract(u, _PARTS, 5), r'[^\x21-\x7e]|["<>`]'),
    )


def canonical_url(u: Column) -> Column:
    """Canonical form of an absolute http(s) address."""
    return let(u, _canonical)


def _join(v: Column, base: Column) -> Column:
    """``v`` set against the parts of ``base``, dots and spelling still as they are."""
    scheme = F.lower(F.regexp_extract(base, _PARTS, 1))
    origin = F.concat(scheme, F.lit("://"), F.regexp_extract(base, _PARTS, 2))
    path = F.regexp_extract(base, _PARTS, 3)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1))
    return (
        F.when(v.rlike(r"(?i)^https?:"), v)
        .when(v.rlike(r"^[/\\]{2}"), F.concat(scheme, F.lit("://"), F.substr(v, F.lit(3))))
        .when(v.rlike(r"^[/\\]"), F.concat(origin, v))
        .when(v.startswith("?"), F.concat(origin, path, v))
        .when(v.startswith("#"), F.concat(F.regexp_replace(base, "(?s)#.*$", ""), v))
        .otherwise(F.concat(origin, folder, v))
    )


def resolve_url(value: Column, base: Column) -> Column:
    """A relative address made absolute; anything that cannot be resolved is returned as it is."""
    def resolved(raw: Column) -> Column:
        v = F.regexp_replace(raw, r"[\t\n\r]", "")
        free = v.rlike(r"(?i)^https?:") | (
            ~v.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") & base.rlike(r"(?i)^https?://[^/?#]")
        )
        target = let(
            F.when(free, let(v, lambda w: _join(w, base))),
            lambda t: F.when(t.rlike(r"(?i)^https?:/*[^/?#\s]"), _canonical(t)),
        )
        return F.when(raw == "", raw).otherwise(F.coalesce(target, raw))

    return let(web_trim(F.coalesce(value, F.lit(""))), resolved)


def has_options(c: Column) -> Column:
    return F.coalesce(c.rlike(OPTIONS_AT), F.lit(False))


def address_part(c: Column) -> Column:
    return web_trim(F.regexp_replace(c, f"(?s){OPTIONS_AT}.*$", ""))


def options_part(c: Column) -> Column:
    """The ``{…}`` text behind an address, '' when there is none."""
    return web_trim(F.regexp_extract(c, r"(?s)(?<!<),\s*(\{.*)$", 1))


def resolve_address(value: Column, base: Column) -> Column:
    """Resolve the address part only and keep the option block untouched."""
    def resolved(v: Column) -> Column:
        address = resolve_url(address_part(v), base)
        return F.when(has_options(v), F.concat(address, F.lit(","), options_part(v))).otherwise(address)

    return let(F.coalesce(value, F.lit("")), resolved)


# --- fixed values: the repairs a sloppy JSON text gets before it is read again -----------------
SINGLE_QUOTED = r"'((?:\\.|[^'\\])*)'"
BARE_KEY = r"([{,]\s*)([A-Za-z_$][\w$]*)(\s*:)"
TRAILING_COMMA = r",(\s*[}\]])"
# -----------------------------------------------------------------------------------------------


def repair_json(c: Column) -> Column:
    """Single quotes, bare keys and trailing commas put right."""
    quoted = F.regexp_replace(c, SINGLE_QUOTED, '"$1"')
    keyed = F.regexp_replace(quoted, BARE_KEY, '$1"$2"$3')
    return F.replace(F.regexp_replace(keyed, TRAILING_COMMA, "$1"), F.lit("\\'"), F.lit("'"))


def is_json(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull()


def loose_json_text(c: Column) -> Column:
    """The JSON text itself when it parses, the repaired one when only that parses, else NULL."""
    return let(
        web_trim(c),
        lambda t: F.when(is_json(t), t).otherwise(let(repair_json(t), lambda f: F.when(is_json(f), f))),
    )


def loose_json(c: Column) -> Column:
    """Tolerant JSON as VARIANT."""
    return F.try_parse_json(loose_json_text(c))


def split_url_options(c: Column) -> Column:
    """STRUCT<url, method, charset, headers, body, valid>; an object body brings its content type."""
    return let(
        web_trim(F.coalesce(c, F.lit(""))),
        lambda raw: let(loose_json_text(options_part(raw)), lambda text: _options(raw, text)),
    )


def _options(raw: Column, text: Column) -> Column:
    body = F.get_json_object(text, "$.body")
    headers = F.coalesce(
        F.from_json(F.get_json_object(text, "$.headers"), "map<string,string>"),
        F.create_map().cast("map<string,string>"),
    )
    object_body = F.from_json(text, "struct<body:variant>")["body"]
    is_object = F.schema_of_variant(object_body).rlike("^(?:OBJECT|ARRAY|BIGINT|DECIMAL|DOUBLE|BOOLEAN)")
    has_type = F.exists(F.map_keys(headers), lambda k: F.lower(k) == "content-type")
    typed = F.when(
        F.coalesce(is_object, F.lit(False)) & ~has_type,
        F.map_concat(headers, F.create_map(F.lit("Content-Type"), F.lit("application/json"))),
    ).otherwise(headers)
    return F.struct(
        address_part(raw).alias("url"),
        F.get_json_object(text, "$.method").alias("method"),
        F.get_json_object(text, "$.charset").alias("charset"),
        typed.alias("headers"),
        body.alias("body"),
        (~has_options(raw) | text.isNotNull()).alias("valid"),
    )


def first_address(c: Column) -> Column:
    """First address of a value of several lines; a balanced option block keeps its lines."""
    return let(web_trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")), _first_of_lines)


def _first_of_lines(text: Column) -> Column:
    opened = F.regexp_extract(text, r"(?s)^(.*?(?<!<),\s*)\{", 1)
    rest = F.substr(text, F.length(opened) + 1)
    # Strings first, then braces: depth after each token tells where the block closes.
    tokens = F.regexp_extract_all(rest, F.lit(r'(?s)"(?:\\.|[^"\\])*"|[{}]|[^"{}]+|"'), F.lit(0))
    scan = F.aggregate(
        tokens,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("used"), F.lit(False).alias("done")),
        lambda s, t: F.when(s["done"], s).otherwise(
            F.struct(
                (s["depth"] + F.when(t == "{", 1).when(t == "}", -1).otherwise(0)).alias("depth"),
                (s["used"] + F.length(t)).alias("used"),
                ((t == "}") & (s["depth"] == 1)).alias("done"),
            )
        ),
    )
    whole = F.concat(opened, F.substr(rest, F.lit(1), scan["used"]))
    line = F.get(F.filter(F.transform(F.split(text, "\n"), web_trim), lambda x: x != ""), F.lit(0))
    return F.coalesce(F.when(has_options(text) & scan["done"], web_trim(whole)).otherwise(line), F.lit(""))


def needs_proxy(c: Column) -> Column:
    """Covers a browser cannot load itself: with request options, or plain http."""
    return has_options(c) | F.coalesce(c.rlike("(?i)^http://"), F.lit(False))


def host_of(c: Column) -> Column:
    """Lower-case host name; a bare host is accepted, '' when there is none."""
    v = web_trim(F.coalesce(c, F.lit("")))
    full = F.when(v.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), v).otherwise(F.concat(F.lit("http://"), v))
    host = F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:\s]+)", 1)
    return F.when(v == "", F.lit("")).otherwise(F.lower(host))


def url_page_template(template: Column, key: Column, page: Column) -> Column:
    """Search address: the optional ``<,…>`` segment goes on page 1, then key and page go in."""
    optional = F.when(page <= 1, F.regexp_replace(template, r"<,[^<>]*>", "")).otherwise(
        F.regexp_replace(template, r"<,([^<>]*)>", "$1")
    )
    keyed = F.replace(optional, F.lit("{{key}}"), key)
    return F.replace(keyed, F.lit("{{page}}"), page.cast("string"))
