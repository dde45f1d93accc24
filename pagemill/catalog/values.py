"""Value lists, addresses, JSON, templates, variables and helper functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonpath, lists, scalars, template, urls
from ..operators import links
from .base import query, table, texts
from .text import sql_normalize, sql_trim

# --- value lists: the words of the first line and of the whole text ----------------------------
WORDS = "regexp_extract_all(\"text\", '[^\\s]+')"


def _words(spark, sf):
    words = F.regexp_extract_all("text", F.lit(r"[^\s]+"), F.lit(0))
    return texts(spark, sf, "documents", "doc_id", "text").select("doc_id", words.alias("w"))


def _joined(c):
    return F.array_join(c, " ")


PICKS = {
    "one": ("1", "CASE WHEN len(w) > 1 THEN w[2:2] ELSE [] END"),
    "last_two": ("-2:-1", "CASE WHEN len(w) = 1 THEN w WHEN len(w) > 1 THEN w[len(w)-1:len(w)] ELSE [] END"),
    "some": ("1,3,-1", "list_filter([w[2], w[4], w[len(w)]], lambda x: x IS NOT NULL)"),
    "by_two": ("0:6:2", "list_filter([w[1], w[3], w[5], w[7]], lambda x: x IS NOT NULL)"),
    "backwards": ("-1:0", "list_reverse(w)"),
    "without": ("!0:1:-1", "list_filter(w, lambda x, i: i > 2 AND i < len(w))"),
    "beyond": ("999999", "[]"),
    "no_index": ("important", "w"),
}


@query(
    "pick_index",
    f"WITH t AS (SELECT doc_id, {WORDS} AS w FROM documents) SELECT doc_id, "
    + ", ".join(f"array_to_string({sql}, ' ') AS {name}" for name, (_, sql) in PICKS.items())
    + " FROM t",
)
def pick_index(spark, sf):
    return _words(spark, sf).select(
        "doc_id", *[_joined(lists.pick_index(F.col("w"), spec)).alias(n) for n, (spec, _) in PICKS.items()]
    )


@query(
    "reverse_list",
    f"SELECT doc_id, array_to_string(list_reverse({WORDS}), ' ') AS words FROM documents",
)
def reverse_list(spark, sf):
    return _words(spark, sf).select("doc_id", _joined(lists.reverse_list(F.col("w"))).alias("words"))


# Two lists of different length: capitalised words and words with a full stop.
TWO = """WITH t AS (SELECT doc_id, regexp_extract_all("text", '[A-Z][a-z]+') AS a,
                          regexp_extract_all("text", '[a-z]+\\.') AS b FROM documents)"""


def _two(spark, sf):
    return texts(spark, sf, "documents", "doc_id", "text").select(
        "doc_id",
        F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)).alias("a"),
        F.regexp_extract_all("text", F.lit(r"[a-z]+\."), F.lit(0)).alias("b"),
    )


@query("combine_concat", TWO + " SELECT doc_id, array_to_string(list_concat(a, b), ' ') AS words FROM t")
def combine_concat(spark, sf):
    return _two(spark, sf).select("doc_id", _joined(lists.combine_concat(F.col("a"), F.col("b"))).alias("words"))


@query(
    "combine_first",
    TWO + " SELECT doc_id, array_to_string(CASE WHEN len(a) > 0 THEN a ELSE b END, ' ') AS words FROM t",
)
def combine_first(spark, sf):
    return _two(spark, sf).select("doc_id", _joined(lists.combine_first(F.col("a"), F.col("b"))).alias("words"))


@query(
    "combine_interleave",
    TWO
    + """ SELECT doc_id, array_to_string(list_filter(flatten(list_transform(
             range(1, greatest(len(a), len(b)) + 1), lambda i: [a[i], b[i]])), lambda x: x IS NOT NULL), ' ') AS words
          FROM t""",
)
def combine_interleave(spark, sf):
    return _two(spark, sf).select(
        "doc_id", _joined(lists.combine_interleave(F.col("a"), F.col("b"))).alias("words")
    )


@query(
    "value_join",
    """SELECT doc_id, array_to_string(list_filter(string_split("text", '.'), lambda x: x <> ''), chr(10)) AS value
       FROM documents""",
)
def value_join(spark, sf):
    parts = F.split("text", r"\.")
    return texts(spark, sf, "documents", "doc_id", "text").select("doc_id", lists.value_join(parts).alias("value"))


# --- addresses ---------------------------------------------------------------------------------
def sql_encode(expr: str) -> str:
    """Percent-encode what an address may not hold, character by character."""
    return (
        f"array_to_string(list_transform(string_split({expr}, ''), "
        "lambda ch: CASE WHEN ord(ch) > 126 OR ord(ch) <= 32 OR ch IN ('\"', '<', '>') THEN url_encode(ch) ELSE ch END), '')"
    )


ORIGIN = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
HREFS = """SELECT page_id, url, ordinality - 1 AS pos, href FROM (
             SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS hs FROM pages),
             unnest(hs) WITH ORDINALITY AS u(href, ordinality)"""


@query(
    "extract_links",
    f"""SELECT page_id, pos, {sql_trim('href')} AS href,
               CASE WHEN href LIKE '/%' THEN {ORIGIN} || {sql_encode(sql_trim('href'))} ELSE href END AS abs_url
        FROM ({HREFS})""",
)
def extract_links(spark, sf):
    return links.extract_links(texts(spark, sf, "pages", "page_id", "url", "html"))


@query(
    "resolve_url",
    f"""WITH p AS (SELECT page_id, url, {ORIGIN} AS origin,
                          regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages)
        SELECT page_id,
               CASE WHEN path = '' THEN origin || '/' ELSE origin || regexp_extract(path, '^(.*/)', 1) END || 'x/y?z=1' AS sibling,
               origin || '/up' AS dots,
               regexp_extract(url, '^(https?):', 1) || '://other.example.com/' AS other_host,
               origin || path || '?q=a%20b' AS with_query,
               regexp_replace(url, '#.*$', '') || '#end' AS with_fragment,
               'https://abs.example.com/a/c?x=%C3%A9' AS absolute, 'mailto:a@b.c' AS no_web, '' AS nothing
        FROM p""",
)
def resolve_url(spark, sf):
    base = F.col("url")

    def to(value):
        return urls.resolve_url(F.lit(value), base)

    return table(spark, sf, "pages").select(
        "page_id", to("x/./y?z=1").alias("sibling"), to("/a/../b/../up").alias("dots"),
        to("//Other.example.com").alias("other_host"), to("?q=a b").alias("with_query"),
        to(" #end ").alias("with_fragment"), to("HTTPS://abs.example.com:443/a/b/../c?x=é").alias("absolute"),
        to("mailto:a@b.c").alias("no_web"), to("  ").alias("nothing"),
    )


@query(
    "split_url_options",
    """SELECT page_id, CASE WHEN page_id % 4 = 3 THEN url || '<,{{page}}>' ELSE url END AS url,
              CASE WHEN page_id % 4 = 1 THEN 'POST' END AS method, CASE WHEN page_id % 4 = 1 THEN 'gbk' END AS charset,
              CASE page_id % 4 WHEN 1 THEN 'a=1' WHEN 2 THEN '{"id":7}' END AS body, true AS valid,
              CASE WHEN page_id % 4 = 2 THEN '{"Referer":"x","Content-Type":"application/json"}' ELSE '{}' END AS headers FROM pages""",
)
def split_url_options(spark, sf):
    """Addresses with a block of request options of every kind behind them."""
    block = F.concat(
        F.col("url"),
        F.when(F.col("page_id") % 4 == 0, F.lit("")).when(
            F.col("page_id") % 4 == 1, F.lit(", {'method':'POST', charset:'gbk', body:'a=1',}")
        ).when(F.col("page_id") % 4 == 2, F.lit(',{"body":{"id":7},"headers":{"Referer":"x"}}')).otherwise(
            F.lit("<,{{page}}>")
        ),
    )
    out = table(spark, sf, "pages").select("page_id", urls.split_url_options(block).alias("o"))
    return out.select(
        "page_id", "o.url", "o.method", "o.charset", "o.body", "o.valid",
        F.to_json("o.headers").alias("headers"),
    )


@query(
    "first_address",
    """SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN url || ',{' || chr(10) || '  "body": {"k": "}"}' || chr(10) || '}'
              ELSE url || '?a' END AS address FROM pages""",
)
def first_address(spark, sf):
    value = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("\n  "), "url", F.lit("  \nhttp://second.example.com\n"))).when(
        F.col("page_id") % 3 == 1, F.concat("url", F.lit(',{\n  "body": {"k": "}"}\n}\nhttp://later.example.com'))
    ).otherwise(F.concat("url", F.lit("?a\r\nhttp://b.example.com")))
    return table(spark, sf, "pages").select("page_id", urls.first_address(value).alias("address"))


@query(
    "needs_proxy",
    """SELECT page_id, regexp_matches(url, '(?i)^http://') AS plain,
              true AS with_options FROM pages""",
)
def needs_proxy(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", urls.needs_proxy(F.col("url")).alias("plain"),
        urls.needs_proxy(F.concat(F.lit("https://a.example.com/x.jpg,"), F.to_json(F.struct("url")))).alias("with_options"),
    )


@query(
    "url_page_template",
    """SELECT event_id, '/s?q=' || event_type || CASE WHEN user_id % 3 <= 1 THEN '' ELSE '&p=' || CAST(user_id % 3 AS VARCHAR) END
              || '&size=' || CAST(user_id % 3 AS VARCHAR) AS address FROM events""",
)
def url_page_template(spark, sf):
    address = urls.url_page_template(
        F.lit("/s?q={{key}}<,&p={{page}}>&size={{page}}"), F.col("event_type"), F.col("user_id") % 3
    )
    return table(spark, sf, "events").select("event_id", address.alias("address"))


# --- links of media chapters: page links turned into images and downloads -----------------------
CHAPTER_LINKS = f"""
    SELECT page_id // 4 AS chapter_key, page_id % 4 AS page_no, pos,
           {ORIGIN} || {sql_encode(sql_trim('href'))} AS link FROM ({HREFS}) WHERE href LIKE '/%'"""


@query(
    "image_links",
    f"""WITH l AS ({CHAPTER_LINKS}),
         f AS (SELECT chapter_key, link, min(page_no * 1000000 + pos) AS spot FROM l GROUP BY chapter_key, link)
       SELECT chapter_key, row_number() OVER (PARTITION BY chapter_key ORDER BY spot) - 1 AS ord, link AS url FROM f""",
)
def image_links(spark, sf):
    lazy = F.regexp_replace(
        "html", '<a href="([^"]*)">', '<img alt="src=/no.png" src="/img/loading.gif" data-original="$1">'
    )
    bare = F.regexp_replace(lazy, r"(?:https?:)?//", "")
    return links.image_links(
        texts(spark, sf, "pages", "page_id", "url", "html").select(
            F.floor(F.col("page_id") / 4).alias("chapter_key"), (F.col("page_id") % 4).alias("page_no"),
            bare.alias("raw"), F.col("url").alias("base_url"),
        )
    )


@query(
    "download_links",
    f"""WITH l AS (SELECT page_id, pos, {ORIGIN} || {sql_encode(sql_trim('href'))} AS link, {sql_trim('href')} AS href
                   FROM ({HREFS}) WHERE href LIKE '/%'),
         f AS (SELECT page_id, link, min(pos) AS spot, arg_min(href, pos) AS href FROM l GROUP BY page_id, link)
       SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY spot) - 1 AS ord, link AS url,
              nullif(regexp_extract(regexp_extract(href, '^[^?#]*'), '([^/]+)/*$', 1), '') AS name FROM f""",
)
def download_links(spark, sf):
    hrefs = F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), F.lit(1))
    values = F.transform(hrefs, lambda h: F.concat(F.lit(" \n"), h, F.lit("\nftp://x.example.com/")))
    pages = texts(spark, sf, "pages", "page_id", "url", "html")
    return links.download_links(
        pages.select("page_id", values.alias("values"), F.col("url").alias("base_url")), "page_id"
    )


@query(
    "audio_link",
    f"""SELECT page_id, CASE page_id % 4
               WHEN 0 THEN {ORIGIN} || '/a/1.mp3' WHEN 1 THEN url END AS url,
               CASE page_id % 4 WHEN 2 THEN 'no file behind the host' WHEN 3 THEN 'not an address' END AS error
        FROM pages""",
)
def audio_link(spark, sf):
    raw = F.when(F.col("page_id") % 4 == 0, "\n \t\n  /a/1.mp3 \n/a/2.mp3").when(F.col("page_id") % 4 == 1, " \n").when(
        F.col("page_id") % 4 == 2, "http://bare.example.com"
    ).otherwise("javascript:play()")
    rows = table(spark, sf, "pages").select(
        "page_id", raw.alias("raw"), F.col("url").alias("page_url"), F.col("url").alias("chapter_url")
    )
    return links.audio_link(rows).select("page_id", "url", "error")


@query(
    "explore_categories",
    """WITH c AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS source_id, s_name AS name, s_suppkey % 3 AS shape FROM supplier),
         e AS (SELECT source_id, unnest(CASE shape
                 WHEN 0 THEN [(0, 'top', '/top'), (1, name, '/bare'), (2, name, 'x')]
                 WHEN 1 THEN [(0, 'A', '/a'), (1, 'G · B', '/b'), (2, 'G · ' || name, '/c'), (3, 'D', '/d')]
                 ELSE [(0, 'N', '/n'), (1, 'c · ' || name, '/d'), (2, 'd · E', '/e')] END) AS r FROM c)
       SELECT source_id, CAST(r[1] AS BIGINT) AS ord, r[2] AS title, r[3] AS url FROM e""",
)
def explore_categories(spark, sf):
    lines = "# note\ntop::/top\n/bare\n::x\nno address\ntop :: /top\nempty::"
    nested = (
        '[{"title":"A","url":"/a"},{"name":"G","url":[{"title":"B","url":"/b"},{"url":"/c"}]},"D::/d",'
        '{"title":"A","url":"/a"},{"title":"none"},]'
    )
    raw = F.when(F.col("s_suppkey") % 3 == 0, lines).when(F.col("s_suppkey") % 3 == 1, nested).otherwise(
        '{"list":[{"title":"N","url":" /n "},{"title":"a","url":[{"title":"b","url":[{"title":"c","url":[{"url":"/d"}]},'
        '{"title":"d","url":"[{\\"title\\":\\"E\\",\\"url\\":\\"/e\\"}]"}]}]}]}'
    )
    return links.explore_categories(
        table(spark, sf, "supplier").select(
            F.concat(F.lit("s"), "s_suppkey").alias("source_id"), F.col("s_name").alias("name"), raw.alias("raw")
        )
    )


@query(
    "cacheable_media",
    """SELECT event_id, event_type <> 'error' AND event_type <> 'view' AND value > 0 AND value <= 31.45728 AS keep
       FROM events""",
)
def cacheable_media(spark, sf):
    facts = table(spark, sf, "events").select(
        "event_id", F.lit(False).alias("logged_in"), F.lit(False).alias("file_source"), F.lit(False).alias("ranged"),
        F.when(F.col("event_type") == "error", 404).otherwise(200).alias("status"),
        F.when(F.col("event_type") == "view", "text/html").otherwise("IMAGE/png").alias("content_type"),
        (F.col("value") * 100000).alias("content_length"),
    )
    return facts.select("event_id", links.cacheable_media().alias("keep"))


# --- JSON --------------------------------------------------------------------------------------
# A JSON page per page row, from its links: objects in a list, some with a price.
def _json_pages(spark, sf):
    hrefs = F.regexp_extract_all("html", F.lit('<a href="/([^"]*)">'), F.lit(1))
    items = F.transform(
        hrefs, lambda h, i: F.struct(h.alias("name"), (i % 3).alias("n"), F.when(i % 2 == 0, i.cast("string")).alias("tag"))
    )
    body = F.to_json(
        F.struct(
            F.lit(0).alias("code"),
            F.struct(items.alias("list"), F.struct(F.lit("deep").alias("name")).alias("more")).alias("data"),
        )
    )
    return texts(spark, sf, "pages", "page_id", "html").select("page_id", body.alias("body"))


JSON_ITEMS = """
    WITH t AS (SELECT page_id, regexp_extract_all(html, '<a href="/([^"]*)">', 1) AS h FROM pages)"""


@query(
    "json_select",
    JSON_ITEMS
    + """ SELECT page_id, array_to_string(h, '|') AS names,
              array_to_string(CASE WHEN len(h) > 0 THEN h[len(h):len(h)] ELSE [] END, '|') AS last_name,
              array_to_string(h[2:3], '|') AS middle,
              array_to_string(list_filter(h, lambda x, i: (i - 1) % 3 = 1), '|') AS ones,
              array_to_string(list_filter(h, lambda x, i: (i - 1) % 3 >= 1), '|') AS more_than_zero,
              array_to_string(list_filter(h, lambda x, i: (i - 1) % 2 = 0), '|') AS tagged,
              array_to_string(list_concat(h, ['deep']), '|') AS anywhere,
              '0' AS code, '' AS missing
          FROM t""",
)
def json_select(spark, sf):
    c = F.col("body")
    paths = {
        "names": "$.data.list[*].name", "last_name": "$['data'].list[-1].name", "middle": "$.data.list[1:3].name",
        "ones": '$.data.list[?(@.n=="1")].name', "more_than_zero": "$.data.list[?(@.n > 0)].name",
        "tagged": "$.data.list[?(@.tag)].name", "anywhere": "$..name", "code": "$.code", "missing": "$.data.nope[0].x",
    }
    return _json_pages(spark, sf).select(
        "page_id", *[F.array_join(jsonpath.json_values(c, p), "|").alias(n) for n, p in paths.items()]
    )


@query(
    "json_bare_field",
    "SELECT event_id, json_extract_string(props, '$.k') AS k, NULL::VARCHAR AS of_text FROM events",
)
def json_bare_field(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", jsonpath.json_bare_field(F.col("props"), "k").alias("k"),
        jsonpath.json_bare_field(F.col("event_type"), "k").alias("of_text"),
    )


@query(
    "json_list_items",
    JSON_ITEMS
    + """, i AS (SELECT page_id, ordinality - 1 AS item_pos, name FROM t, unnest(h) WITH ORDINALITY AS u(name, ordinality))
        SELECT page_id, item_pos, '{"name":' || to_json(name) || '}' AS item FROM i
        UNION ALL SELECT page_id, 0, '[]' FROM t WHERE len(h) = 0 AND false""",
)
def json_list_items(spark, sf):
    listed = F.to_json(
        F.transform(
            F.regexp_extract_all("html", F.lit('<a href="/([^"]*)">'), F.lit(1)), lambda h: F.struct(h.alias("name"))
        )
    )
    with_null = F.regexp_replace(listed, r"^\[", "[null,")
    out = texts(spark, sf, "pages", "page_id", "html").where(F.col("html").contains('<a href="/')).select(
        "page_id", F.posexplode(jsonpath.json_list_items(with_null)).alias("item_pos", "item")
    )
    return out.select("page_id", F.col("item_pos").cast("bigint").alias("item_pos"), "item")


@query(
    "loose_json",
    """SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE json_extract_string(props, '$.k') END AS k,
              event_id % 4 <> 3 AS readable FROM events""",
)
def loose_json(spark, sf):
    k = F.get_json_object("props", "$.k")
    sloppy = F.when(F.col("event_id") % 4 == 0, F.col("props")).when(
        F.col("event_id") % 4 == 1, F.concat(F.lit("{'k': "), k, F.lit(", 'it': 'isn\\'t',}"))
    ).when(F.col("event_id") % 4 == 2, F.concat(F.lit("{k : "), k, F.lit(", b:[1,2,],}"))).otherwise(
        F.concat(F.lit("{k = "), k, F.lit("}"))
    )
    parsed = urls.loose_json(sloppy)
    return table(spark, sf, "events").select(
        "event_id", F.try_variant_get(parsed, "$.k", "string").alias("k"), parsed.isNotNull().alias("readable")
    )


# --- templates and variables ---------------------------------------------------------------------
@query(
    "template_expand",
    """SELECT event_id, 'https://x.example.com/' || event_type || '/' || json_extract_string(props, '$.k') || '?u='
              || CAST(user_id AS VARCHAR) || '&c=${x}' AS address FROM events""",
)
def template_expand(spark, sf):
    address = template.template_expand(
        "https://x.example.com/{{type}}/{$.k}?u={{ user }}&c=${x}",
        {"type": F.col("event_type"), "$.k": F.get_json_object("props", "$.k"), "user": F.col("user_id")},
    )
    return table(spark, sf, "events").select("event_id", address.alias("address"))


@query(
    "put_get_vars",
    """SELECT event_id, event_type AS t, CAST(user_id AS VARCHAR) AS overwritten, '' AS absent,
              event_type || '-' || CAST(user_id AS VARCHAR) AS both FROM events""",
)
def put_get_vars(spark, sf):
    first = template.put_vars(None, {"t": F.col("event_type"), "id": F.lit("old")})
    held = template.put_vars(first, {"id": F.col("user_id").cast("string")})
    book = F.create_map(F.lit("id"), F.lit("book"), F.lit("t2"), F.lit("x"))
    rows = table(spark, sf, "events").select("event_id", held.alias("v"), book.alias("book"))

    def read(name):
        return template.get_var(name, F.col("v"), F.col("book"))

    return rows.select(
        "event_id", read("t").alias("t"), read("id").alias("overwritten"), read("none").alias("absent"),
        F.concat_ws("-", read("t"), read("id")).alias("both"),
    )


# --- helper functions ----------------------------------------------------------------------------
@query(
    "scalar_helpers",
    """SELECT doc_id, to_base64(encode("text")) AS b64, "text" AS unb64, lower(hex(encode("text"))) AS hexed, "text" AS unhexed,
              md5("text") AS md5, substr(md5("text"), 9, 16) AS md5_16, sha1("text") AS sha1, sha256("text") AS sha256,
              to_base64(unhex(sha256("text"))) AS sha256_b64, regexp_replace("text", '<[^>]*>', '', 'g') AS bare,
              CASE WHEN regexp_matches("text", '[",\r\n]') THEN '"' || replace("text", '"', '""') || '"' ELSE "text" END AS csv,
              trim(regexp_replace(replace(replace("text", '\\', '\\\\'), '|', '\\|'), '\r\n|\r|\n', '<br>', 'g')) AS md
       FROM documents""".replace("\\\\\\\\", "\\\\").replace("'\\\\'", "'\\'").replace("'\\\\|'", "'\\|'"),
)
def scalar_helpers(spark, sf):
    c = F.col("text")
    return texts(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", scalars.base64_encode(c).alias("b64"), scalars.base64_decode(scalars.base64_encode(c)).alias("unb64"),
        scalars.hex_encode(c).alias("hexed"), scalars.hex_decode(scalars.hex_encode(c)).alias("unhexed"),
        scalars.digest_hex(c, "MD5").alias("md5"), scalars.md5_16(c).alias("md5_16"),
        scalars.digest_hex(c, "SHA-1").alias("sha1"), scalars.digest_hex(c, "SHA-256").alias("sha256"),
        scalars.digest_base64(c, "SHA-256").alias("sha256_b64"), scalars.strip_tags(c).alias("bare"),
        scalars.csv_cell(c).alias("csv"), scalars.markdown_cell(c).alias("md"),
    )


@query(
    "scalar_times",
    """SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS stamp,
              strftime(ts + INTERVAL 8 HOUR, '%Y%m%d') AS compact, strftime(ts, '%H:%M:%S') AS utc_time,
              strftime(ts, '%Y-%m-%dT%H:%M') AS with_letter,
              lower(hex(user_id)) AS hexed, TRY_CAST(event_type AS INT) AS no_int FROM events""",
)
def scalar_times(spark, sf):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select(
        "event_id", scalars.format_stamp(ms).alias("stamp"), scalars.format_stamp_compact(ms).alias("compact"),
        scalars.time_format(ms, "HH:mm:ss", 0).alias("utc_time"), scalars.time_format(ms, "yyyy-MM-ddTHH:mm", 0).alias("with_letter"),
        scalars.to_hex_string(F.col("user_id")).alias("hexed"),
        scalars.parse_int(F.col("event_type")).alias("no_int"),
    )


@query("scalar_ciphers")
def scalar_ciphers(spark, sf):
    """Keyed digests and AES round trips over every document (no SQL counterpart)."""
    c, key, iv = F.col("text"), F.lit("0123456789abcdef"), F.lit("fedcba9876543210")
    boxed = scalars.aes_encrypt_base64(c, key, "CBC", iv)
    ecb = scalars.aes_encrypt_base64(c, key, "ECB")
    return texts(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", scalars.hmac_hex(c, "k", "HmacSHA256").alias("mac"),
        (scalars.aes_decrypt_base64(boxed, key, "CBC", iv) == c).alias("cbc_back"),
        (scalars.aes_decrypt_base64(ecb, key, "ECB") == c).alias("ecb_back"),
    )


@query(
    "encode_uri",
    """SELECT doc_id, replace(replace(replace(replace(replace(url_encode("text"), '%21', '!'), '%27', ''''), '%28', '('),
              '%29', ')'), '%2A', '*') AS encoded FROM documents""",
)
def encode_uri(spark, sf):
    return texts(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", scalars.encode_uri(F.col("text")).alias("encoded")
    )
