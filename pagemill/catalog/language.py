"""The rule language inside the jobs: selector lists and conditions, templates, variables, patterns, functions, hooks.

Every page is read by the same rules, as the source its host ending names; the SQL twins take the same
values from the known markup by patterns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import hooks
from ..operators import library
from ..operators import select as S
from ..plans import books as B
from ..session import stored
from .base import query, texts
from .books import h1, source_of
from .nodes import NAV, NAV_HREFS, NAV_WORDS, _selected, oracle
from .text import sql_trim
from .values import ORIGIN, sql_encode

AD = "regexp_extract_all(html, '<div class=\"ad\">([^<]*)</div>', 1)"
TITLE = "regexp_extract_all(html, '<h1>([^<]*)</h1>', 1)"


# --- selectors --------------------------------------------------------------------------------------
@query("select_css_list", oracle(f"list_concat(list_concat({NAV_WORDS}[1:1], {AD}), {TITLE})"))
def select_css_list(spark, sf):
    """Hits of several selectors in page order, each node once."""
    return _selected(spark, sf, lambda n, c: S.select_css(n, c, "article > h1, div.ad, h1, nav li:first-child > a"))


@query("select_css_not", oracle(f"list_filter({NAV_HREFS}, lambda h: NOT starts_with(h, '/t') AND NOT contains(h, 'a'))"))
def select_css_not(spark, sf):
    return _selected(spark, sf, lambda n, c: S.select_css(n, c, "nav a:not([href^='/t'], [href*=a])"), "href")


@query("select_css_has", oracle(f"regexp_extract_all({NAV}, '<a href=\"/t[^\"]*\">([^<]*)</a>', 1)"))
def select_css_has(spark, sf):
    return _selected(spark, sf, lambda n, c: S.select_css(n, c, "nav li:has(> a[href^='/t']):not(:has(h1, p))"))


@query("select_css_nth", oracle(f"list_filter({NAV_WORDS}, lambda w, i: i % 3 = 2 OR i = len({NAV_WORDS}))"))
def select_css_nth(spark, sf):
    return _selected(spark, sf, lambda n, c: S.select_css(n, c, "nav li:nth-child(3n-1), nav li:nth-last-child(1)"))


@query("select_css_type", oracle(f"list_concat({AD}, {TITLE})"))
def select_css_type(spark, sf):
    return _selected(spark, sf, lambda n, c: S.select_css(n, c, "body > div:first-of-type, body > article:only-of-type > h1:last-of-type"))


@query("select_xpath_or", oracle(f"list_filter({NAV_HREFS}, lambda h: starts_with(h, '/t') OR contains(h, 'a'))"))
def select_xpath_or(spark, sf):
    return _selected(spark, sf, lambda n, c: S.select_xpath(n, c, "//nav//a[starts-with(@href,'/t') or contains(@href,'a')]"), "href")


@query("select_xpath_not", oracle(f"list_filter({NAV_HREFS}, lambda h, i: i < 4 AND NOT starts_with(h, '/t'))"))
def select_xpath_not(spark, sf):
    return _selected(spark, sf, lambda n, c: S.select_xpath(n, c, "//nav//li[position()<4][a]/a[not(starts-with(@href,'/t'))]"), "href")


@query("select_xpath_union", oracle(f"list_concat(list_concat({NAV_WORDS}[2:2], {AD}), {TITLE})"))
def select_xpath_union(spark, sf):
    return _selected(spark, sf, lambda n, c: S.select_xpath(n, c, "//h1 | //div[@class='ad'] | //nav//li[a][2]/a | //article/h1"))


@query("select_xpath_below", oracle(f"CASE WHEN list_contains({NAV_HREFS}, '/the') THEN {TITLE} ELSE [] END"))
def select_xpath_below(spark, sf):
    """A condition on nodes elsewhere below, with a value."""
    return _selected(spark, sf, lambda n, c: S.select_xpath(n, c, "//body[nav//a/@href='/the']/article/h1"))


# --- rules in the jobs --------------------------------------------------------------------------------
def _pages(spark, sf):
    raw = texts(spark, sf, "pages", "page_id", "url", "html")
    return stored(raw.select("page_id", source_of().alias("source_id"), "url", "html"), "pages")


def _rules(spark, pages, grp, rules):
    """The same rules for every source of the pages."""
    given = spark.createDataFrame([(grp, f, r) for f, r in rules.items()], "grp string, field string, rule string")
    return stored(pages.select("source_id").dropDuplicates().crossJoin(F.broadcast(given)), "rule-fields")


SOURCE = "regexp_extract(url, '^https?://[^/?#]*\\.(\\w+)(?:[/?#]|$)', 1) AS source_id"
# The list entries: place, address and word.
ITEMS = f"""
    SELECT page_id, source_id, ordinality - 1 AS item, x.href AS href, x.word AS word, {ORIGIN} AS origin, url FROM (
      SELECT page_id, {SOURCE}, url, list_transform(regexp_extract_all({NAV}, '<a href="[^"]*">[^<]*</a>'),
             lambda a: {{'href': regexp_extract(a, 'href="([^"]*)"', 1), 'word': regexp_extract(a, '>([^<]*)<', 1)}}) AS xs FROM pages),
      unnest(xs) WITH ORDINALITY AS u(x, ordinality)"""
WORD, HREF = sql_trim("word"), sql_trim("href")


@query(
    "extract_all_in_one",
    f"""SELECT page_id, source_id, item, {WORD} AS name, regexp_replace({HREF}, '^/', '') AS author, {HREF} AS kind, {HREF} || ' is ' || {WORD} AS intro,
               origin || {sql_encode(HREF)} AS "bookUrl" FROM ({ITEMS}) WHERE {WORD} <> ''""",
)
def extract_all_in_one(spark, sf):
    """A list rule that is one pattern over the page: fields read its groups, or rules on the piece of text."""
    pages = _pages(spark, sf)
    rules = {"bookList": r':<li><a href="([^"]*)">([^<]*)</a>(?:</li>||)', "name": "$2", "author": "$1##^/", "kind": "text", "intro": "$1 is $2", "bookUrl": "$1"}
    books, _ = B.extract_book_list(pages, _rules(spark, pages, "ruleSearch", rules))
    return books.select("page_id", "source_id", "item", "name", "author", "kind", "intro", "bookUrl")


@query(
    "extract_templates",
    f"""SELECT page_id, source_id, item, {WORD} || ' - ' || {HREF} AS name, 'No. ' || replace({WORD}, 'a', 'A') AS author,
               {WORD} AS kind, url || '#' || {WORD} AS intro, origin || {sql_encode(f"'/b' || {HREF}")} AS "bookUrl" FROM ({ITEMS}) WHERE {WORD} <> ''""",
)
def extract_templates(spark, sf):
    """Texts and addresses put together from several rules; the pages of odd number are JSON."""
    pages = _pages(spark, sf)
    entries = F.regexp_extract_all(F.regexp_extract("html", "(?s)<nav>(.*?)</nav>", 1), F.lit('<a href="[^"]*">[^<]*</a>'), F.lit(0))
    entry = F.transform(entries, lambda a: F.struct(F.regexp_extract(a, 'href="([^"]*)"', 1).alias("u"), F.regexp_extract(a, ">([^<]*)<", 1).alias("t")))
    as_json = F.to_json(F.struct(F.struct(entry.alias("list")).alias("data")))
    odd = F.col("page_id") % 2 == 1
    pages = stored(pages.withColumn("html", F.when(odd, as_json).otherwise(F.col("html"))).withColumn(
        "source_id", F.when(odd, F.concat("source_id", F.lit(" json"))).otherwise(F.col("source_id"))), "pages")
    common = {"intro": "{{baseUrl}}#{{$.t}}{{tag.a@text}}", "kind": "{{class.none@text}}||{{$.none}}||{{$.t}}||{{tag.a@text}}"}
    html = {"bookList": "tag.nav@tag.li", "name": "{{tag.a@text}} - {{tag.a@href}}", "author": "No. {{tag.a@text##a##A}}", "bookUrl": "/b{{@css:a@href}}"}
    json = {"bookList": "$.data.list", "name": "{$.t} - {{$.u}}", "author": "No. {$.t}##a##A", "bookUrl": "/b{$.u}"}
    is_json = F.col("source_id").endswith(" json")
    every = _rules(spark, pages.where(~is_json), "ruleSearch", html | common).unionByName(_rules(spark, pages.where(is_json), "ruleSearch", json | common))
    books, _ = B.extract_book_list(pages, every)
    return books.select("page_id", F.regexp_replace("source_id", " json$", "").alias("source_id"), "item", "name", "author", "kind", "intro", "bookUrl")


VARIABLES = {
    "bookList": "tag.nav@tag.li", "name": 'tag.a@text@put:{w:"tag.a@text", h:tag.a@href}', "author": "@get:{h}",
    "intro": '@put:{both:"@get:{w}-@get:{h}"}w=@get:{w} both=@get:{both} none=@get:{none}', "kind": "@get:{none}||tag.a@text",
    "bookUrl": "/b@get:{h}",
}


@query(
    "extract_variables",
    f"""SELECT page_id, source_id, item, {WORD} AS name, {HREF} AS author, 'w=' || {WORD} || ' both=' || {WORD} || '-' || {HREF} || ' none=' AS intro,
               '' AS kind, origin || {sql_encode(f"'/b' || {HREF}")} AS "bookUrl" FROM ({ITEMS}) WHERE {WORD} <> ''""",
)
def extract_variables(spark, sf):
    """Variables one rule writes and others read, in the order of what they need."""
    pages = _pages(spark, sf)
    books, _ = B.extract_book_list(pages, _rules(spark, pages, "ruleSearch", VARIABLES))
    return books.select("page_id", "source_id", "item", "name", "author", "intro", "kind", "bookUrl")


@query(
    "extract_variables_flush",
    f"""SELECT source_id || chr(10) || origin || {sql_encode(f"'/b' || {HREF}")} AS book_key, v.name AS name, v.value AS value FROM (
          SELECT source_id, origin, href, unnest([{{'name': 'w', 'value': {WORD}}}, {{'name': 'h', 'value': {HREF}}}, {{'name': 'both', 'value': {WORD} || '-' || {HREF}}}]) AS v
          FROM ({ITEMS}) WHERE {WORD} <> '') WHERE v.value <> '' AND length(v.value) <= 8192""",
)
def extract_variables_flush(spark, sf):
    """What an item's rules wrote, filed under its own book."""
    pages = _pages(spark, sf)
    books, _ = B.extract_book_list(pages, _rules(spark, pages, "ruleSearch", VARIABLES), with_vars=True)
    return library.item_var_flush(books.select("source_id", "name", F.col("bookUrl").alias("book_url"), "vars"))


@query(
    "extract_scalars",
    f"""SELECT page_id, {SOURCE}, CAST(len({NAV_WORDS}) AS VARCHAR) AS name, CAST(length({sql_trim(h1("regexp_extract(html, '<h1>([^<]*)</h1>', 1)"))}) AS VARCHAR) AS author,
               'ad: ' || {sql_trim(h1("regexp_extract(html, '<div class=\"ad\">([^<]*)</div>', 1)"))} || '!' AS intro FROM pages""",
)
def extract_scalars(spark, sf):
    """XPath functions whose results are no nodes."""
    pages = _pages(spark, sf)
    rules = {"name": "@xpath:count(//nav//a)", "author": "@XPath:string-length(//article/h1)", "intro": "@xpath:concat('ad: ', //div[@class='ad'], '!')"}
    info, _ = B.extract_book_info(pages, _rules(spark, pages, "ruleBookInfo", rules))
    return info.select("page_id", "source_id", "name", "author", "intro")


@query(
    "hook_in_rules",
    f"""SELECT page_id, source_id, item, reverse({WORD}) AS name, {HREF} || '*' AS author, {WORD} AS kind FROM ({ITEMS}) WHERE {WORD} <> ''""",
)
def hook_in_rules(spark, sf):
    """User functions as steps of rules, routed by the name a rule gives."""
    hooks.register_hook("mirrored", lambda values: [v[::-1] for v in values])
    hooks.register_hook("starred", lambda values: "".join(values) + "+")
    pages = _pages(spark, sf)
    rules = {"bookList": "tag.nav@tag.li", "name": "tag.a@text@js:mirrored", "author": "tag.a@href@js:starred##\\+$##*", "kind": "tag.a@text"}
    books, _ = B.extract_book_list(pages, _rules(spark, pages, "ruleSearch", rules))
    return books.select("page_id", "source_id", "item", "name", "author", "kind")
