"""Node table and selectors over the pages, checked against patterns of their known markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nodes as N
from ..operators import select as S
from ..plans.books import node_table
from .base import query, table, texts
from .text import sql_trim


def _pages(spark, sf):
    return texts(spark, sf, "pages", "page_id", "html")


def _selected(spark, sf, pick, kind="text", **more):
    """One row per hit of a selector applied to the whole page, with its value."""
    pages = _pages(spark, sf)
    nodes = node_table(pages)
    hits = pick(nodes, N.root_context(pages))
    values = S.extract_value(nodes, hits, kind, pages if kind in ("html", "all", "outerHtml") else None)
    return values.select("page_id", F.posexplode("values").alias("pos", "value")).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "value"
    )


# Entities of the pages are these few; the markup is regular enough for patterns.
def decoded(expr: str) -> str:
    return f"replace(replace(replace(replace({expr}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


def oracle(found: str, value: str = "x") -> str:
    return f"""SELECT page_id, ordinality - 1 AS pos, {sql_trim(decoded(value))} AS value FROM (
                 SELECT page_id, {found} AS xs FROM pages), unnest(xs) WITH ORDINALITY AS u(x, ordinality)"""


NAV = "regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1)"
NAV_WORDS = f"regexp_extract_all({NAV}, '<a href=\"[^\"]*\">([^<]*)</a>', 1)"
NAV_HREFS = f"regexp_extract_all({NAV}, '<a href=\"([^\"]*)\">', 1)"


@query(
    "html_tokens",
    r"""WITH t AS (SELECT page_id, regexp_extract_all(html,
              '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<[^>]+>|[^<]+') AS ts FROM pages)
        SELECT page_id, ordinality - 1 AS pos,
               CASE WHEN starts_with(x, '<!--') THEN 'comment' WHEN regexp_matches(x, '(?i)^<(script|style)\b') THEN 'block'
                    WHEN starts_with(x, '<') THEN 'tag' ELSE 'text' END AS kind, x AS token
        FROM t, unnest(ts) WITH ORDINALITY AS u(x, ordinality)""",
)
def html_tokens(spark, sf):
    return N.html_tokens(_pages(spark, sf))


@query(
    "html_nodes",
    r"""SELECT page_id, count(*) AS opened FROM (
          SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->|<script\b[^>]*>.*?</script>', '<script>', 'g'),
                 '<[a-z][^>]*>')) AS t FROM pages) GROUP BY page_id""",
)
def html_nodes(spark, sf):
    """Elements per page; the pages write html, head and body out, so each opening tag is one element."""
    pages = _pages(spark, sf).withColumn("html", F.regexp_replace("html", "(?s)<!--.*?-->", "<script></script>"))
    elements = N.html_nodes(pages).where("node_id > 0")
    return elements.groupBy("page_id").agg(F.count("*").alias("opened"))


@query("select_children", oracle("CASE WHEN html LIKE '%<nav>%' THEN ['nav', 'article'] ELSE [] END"))
def select_children(spark, sf):
    """Element children of body that are not advertising, by tag name."""
    pages = _pages(spark, sf)
    nodes = node_table(pages)
    body = S.select_descendants(nodes, N.root_context(pages), "tag", "body")
    hits = S.select_children(nodes, body).join(nodes.select("page_id", "node_id", "tag"), ["page_id", "node_id"])
    named = hits.where(F.col("tag").isin("nav", "article"))
    return named.select("page_id", F.when(F.col("tag") == "nav", 0).otherwise(1).cast("bigint").alias("pos"), F.col("tag").alias("value"))


@query("select_descendants", oracle(NAV_WORDS))
def select_descendants(spark, sf):
    return _selected(
        spark, sf, lambda n, c: S.select_descendants(n, S.select_descendants(n, c, "tag", "nav"), "tag", "a")
    )


@query(
    "select_by_text",
    oracle(f"list_filter({NAV_WORDS}, lambda w: contains(w, 'an'))"),
)
def select_by_text(spark, sf):
    def pick(nodes, ctx):
        nav = S.select_descendants(nodes, ctx, "tag", "nav")
        return S.select_by_text(nodes, nav, "an").join(
            nodes.where("tag = 'a'").select("page_id", "node_id"), ["page_id", "node_id"], "left_semi"
        )

    return _selected(spark, sf, pick)


@query("select_css", oracle(f"list_filter({NAV_HREFS}, lambda h: starts_with(h, '/t'))"))
def select_css(spark, sf):
    return _selected(spark, sf, lambda n, c: S.select_css(n, c, 'body > nav li > a[href^="/t"]'), "href")


@query("select_css_class", oracle("regexp_extract_all(html, '<div class=\"ad\">([^<]*)</div>', 1)"))
def select_css_class(spark, sf):
    return _selected(spark, sf, lambda n, c: S.select_css(n, c, "html div.ad"))


@query("select_css_sibling", oracle("regexp_extract_all(html, '<div class=\"ad\">([^<]*)</div>', 1)[1:1]"))
def select_css_sibling(spark, sf):
    return _selected(spark, sf, lambda n, c: S.select_css(n, c, "nav + div.ad"))


@query("select_xpath", oracle(f"CASE WHEN len({NAV_HREFS}) > 1 THEN [({NAV_HREFS})[2]] ELSE [] END"))
def select_xpath(spark, sf):
    return _selected(spark, sf, lambda n, c: S.select_xpath(n, c, "//nav/ul/li[2]/a[@href]"), "href")


@query("select_xpath_last", oracle(f"list_reverse({NAV_WORDS})[1:1]"))
def select_xpath_last(spark, sf):
    return _selected(spark, sf, lambda n, c: S.select_xpath(n, c, "/html/body/nav//li[last()]"))


@query("select_xpath_parent", oracle(f"CASE WHEN len({NAV_WORDS}) > 0 THEN [array_to_string({NAV_WORDS}, '')] ELSE [] END"))
def select_xpath_parent(spark, sf):
    return _selected(spark, sf, lambda n, c: S.select_xpath(n, c, "//nav//li/.."))


@query("pick_hits", oracle(f"list_filter([({NAV_WORDS})[len({NAV_WORDS})], ({NAV_WORDS})[1]], lambda x: x IS NOT NULL)"))
def pick_hits(spark, sf):
    return _selected(spark, sf, lambda n, c: S.pick_hits(S.select_css(n, c, "nav a"), "-1,0"))


@query("extract_value", oracle("regexp_extract_all(html, '<h1>([^<]*)</h1>', 1)"))
def extract_value(spark, sf):
    return _selected(spark, sf, lambda n, c: S.select_css(n, c, "article > h1"))


@query(
    "extract_value_html",
    f"""SELECT page_id, 0 AS pos, {sql_trim("regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1)")} AS value FROM pages""",
)
def extract_value_html(spark, sf):
    return _selected(spark, sf, lambda n, c: S.select_css(n, c, "nav"), "html")


@query("extract_value_nodes", oracle(NAV_WORDS))
def extract_value_nodes(spark, sf):
    return _selected(spark, sf, lambda n, c: S.select_css(n, c, "nav"), "textNodes")


@query("extract_value_own", oracle("regexp_extract_all(html, '<div class=\"ad\">([^<]*)</div>', 1)"))
def extract_value_own(spark, sf):
    return _selected(spark, sf, lambda n, c: S.select_css(n, c, ".ad"), "ownText")
