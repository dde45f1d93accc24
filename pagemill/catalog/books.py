"""Rule-driven extraction over the pages: one source per host ending, three dialects of one site.

The SQL twins know the three endings of the given tables only; the queries take every page.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import toc as T
from ..plans import books as B
from ..plans import chapters as C
from ..plans import rulesets as R
from ..session import stored
from .base import query, table, texts
from .derive import derived, with_tables
from .text import sql_flatten, sql_normalize, sql_trim
from .values import HREFS, ORIGIN, sql_encode

# source -> rules; com speaks the default dialect, net CSS, org XPath.
RULES = {
    "com": {
        ("ruleSearch", "bookList"): "tag.nav@tag.li", ("ruleSearch", "name"): "tag.a@text", ("ruleSearch", "author"): "tag.a@href##^/##",
        ("ruleSearch", "kind"): "tag.em@text||class.none@text||tag.a@text", ("ruleSearch", "intro"): "tag.a@text&&tag.a@href",
        ("ruleBookInfo", "name"): "tag.h1@text", ("ruleBookInfo", "intro"): "class.ad@text", ("ruleBookInfo", "init"): "tag.body",
        ("ruleToc", "chapterList"): "-tag.nav@tag.li", ("ruleToc", "nextTocUrl"): "id.next@href", ("ruleToc", "isVip"): "tag.a@rel",
        ("ruleContent", "content"): "tag.article@html", ("ruleContent", "nextContentUrl"): "id.next@href",
        ("ruleExplore", "bookList"): "tag.nav@li", ("ruleExplore", "name"): "a@text", ("ruleExplore", "nextPageUrl"): "#next@href",
    },
    "net": {
        ("ruleSearch", "bookList"): "@css:nav > ul > li", ("ruleSearch", "name"): "@css:a@text", ("ruleSearch", "author"): "@css:a[href]@href##^/##",
        ("ruleSearch", "kind"): "em||.none||a", ("ruleSearch", "intro"): "a@text&&a@href", ("ruleSearch", "bookUrl"): "@css:a@href",
        ("ruleBookInfo", "name"): "@css:article > h1@text", ("ruleBookInfo", "intro"): ".ad@ownText", ("ruleBookInfo", "tocUrl"): "#next@href",
        ("ruleToc", "chapterList"): "-nav li", ("ruleToc", "nextTocUrl"): "#next@href", ("ruleToc", "chapterUrl"): "a.0@href",
        ("ruleContent", "content"): "@css:article@html", ("ruleContent", "nextContentUrl"): "#next@href",
        ("ruleExplore", "bookList"): "nav li", ("ruleExplore", "name"): "a@text", ("ruleExplore", "nextPageUrl"): "a#next@href",
    },
    "org": {
        ("ruleSearch", "bookList"): "//nav//li", ("ruleSearch", "name"): "//a/text()", ("ruleSearch", "author"): "/a/@href##^/##",
        ("ruleSearch", "kind"): "//em/text()||//a/text()", ("ruleSearch", "intro"): "//a/text()&&//a/@href", ("ruleSearch", "coverUrl"): "//img[",
        ("ruleBookInfo", "name"): "//article/h1[1]/text()", ("ruleBookInfo", "intro"): "//div[@class='ad']",
        ("ruleToc", "chapterList"): "//nav/ul/li", ("ruleToc", "nextTocUrl"): "//a[@id='next']/@href",
        ("ruleContent", "content"): "//article@html", ("ruleContent", "nextContentUrl"): "//a[@id=\"next\"]/@href",
        ("ruleExplore", "bookList"): "//nav//li", ("ruleExplore", "name"): "//a", ("ruleExplore", "nextPageUrl"): "//a[contains(@id,'nex')]/@href",
    },
}
# Every other ending, and addresses without one: the default dialect from the page on.
OTHER = {place: rule for place, rule in RULES["com"].items() if place != ("ruleBookInfo", "init")}
ENDING = "regexp_extract(url, '^https?://[^/?#]*\\.(\\w+)(?:[/?#]|$)', 1)"


def source_of():
    """The host ending of a page's address, '' when it has none."""
    return F.coalesce(F.regexp_extract("url", r"^https?://[^/?#]*\.(\w+)(?:[/?#]|$)", 1), F.lit(""))


def _rules(spark, pages):
    """Rules of the three sources and of every other one in ``pages``."""
    kind = "source_id string, grp string, field string, rule string"
    named = spark.createDataFrame([(s, g, f, r) for s, fields in RULES.items() for (g, f), r in fields.items()], kind)
    others = pages.where(~F.col("source_id").isin(*RULES)).select("source_id").dropDuplicates()
    usual = spark.createDataFrame([(g, f, r) for (g, f), r in OTHER.items()], "grp string, field string, rule string")
    # The rules are read by several steps of a job.
    return stored(named.unionByName(others.crossJoin(F.broadcast(usual))), "rule-fields")


def _pages(spark, sf):
    """All pages, each linking to the page with the next number of its ending's chain."""
    raw = texts(spark, sf, "pages", "page_id", "url", "html")
    nexts = table(spark, sf, "pages").select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next"))
    linked = raw.join(nexts, "page_id", "left").withColumn(
        "html", F.when((F.col("page_id") % 4 != 3) & F.col("next").isNotNull(),
                       F.concat(F.regexp_replace("html", "</body></html>$", ""), F.lit('<a id="next" rel="VIP" href="'), "next", F.lit('"></a></body></html>')))
        .otherwise(F.col("html")),
    )
    # A captured corpus is a stored table; every step of the jobs reads it.
    return stored(linked.select("page_id", source_of().alias("source_id"), "url", "html"), "pages")


PAGES = f"SELECT page_id, url, html, {ENDING} AS source_id FROM pages WHERE {ENDING} IN ('com', 'net', 'org')"
# Items: the list entries of the navigation; bold words decode to the same text as they have few entities.
ITEMS = f"""
    SELECT page_id, source_id, ordinality - 1 AS item, {sql_trim("x.href")} AS href, {sql_trim("x.word")} AS word, {ORIGIN} AS origin FROM (
      SELECT page_id, source_id, url, list_transform(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1),
             '<a href="[^"]*">[^<]*</a>'),
             lambda a: {{'href': regexp_extract(a, 'href="([^"]*)"', 1), 'word': regexp_extract(a, '>([^<]*)<', 1)}}) AS xs FROM ({PAGES})),
      unnest(xs) WITH ORDINALITY AS u(x, ordinality)"""


@query(
    "extract_book_list",
    f"""SELECT page_id, source_id, item, word AS name, regexp_replace(href, '^/', '') AS author, word AS kind, word || chr(10) || href AS intro,
               origin || {sql_encode('href')} AS "bookUrl" FROM ({ITEMS}) WHERE word <> ''""",
)
def extract_book_list(spark, sf):
    pages = _pages(spark, sf)
    books, _ = B.extract_book_list(pages, _rules(spark, pages), "ruleSearch")
    return books.select("page_id", "source_id", "item", "name", "author", "kind", "intro", "bookUrl")


@query(
    "search_all",
    f"""WITH b AS (SELECT source_id, count(*) AS n FROM ({ITEMS}) WHERE word <> '' GROUP BY source_id),
             r AS (SELECT source_id, max(page_id) AS ms, CASE WHEN source_id = 'net' THEN 'HTTP 503' END AS error FROM ({PAGES}) GROUP BY source_id)
        SELECT r.source_id, error IS NULL AS ok, CASE WHEN error IS NULL THEN coalesce(n, 0) ELSE 0 END AS count, ms AS elapsed_ms, error
        FROM r LEFT JOIN b ON b.source_id = r.source_id""",
)
def search_all(spark, sf):
    pages = _pages(spark, sf)
    responses = pages.select(
        "source_id", "page_id", F.col("page_id").alias("elapsed_ms"), F.when(F.col("source_id") == "net", "HTTP 503").alias("error")
    )
    _, summary = B.search_all(pages, _rules(spark, pages), responses)
    return summary


CELLS = """SELECT 's' || CAST(user_id AS VARCHAR) AS source_id, CASE event_type WHEN 'click' THEN 'bookUrl' ELSE event_type END AS field,
                  props AS value, CASE WHEN event_type = 'error' OR (event_type = 'click' AND event_id % 97 = 0) THEN 'bad rule ' || CAST(event_id AS VARCHAR) END AS error,
                  event_id AS ord FROM events"""


def _cells(spark, sf):
    bad = (F.col("event_type") == "error") | ((F.col("event_type") == "click") & (F.col("event_id") % 97 == 0))
    return table(spark, sf, "events").select(
        F.concat(F.lit("s"), "user_id").alias("source_id"), F.when(F.col("event_type") == "click", "bookUrl").otherwise(F.col("event_type")).alias("field"),
        F.col("props").alias("value"), F.when(bad, F.concat(F.lit("bad rule "), "event_id")).alias("error"), F.col("event_id").alias("ord"),
    )


@query(
    "tolerant_fields",
    f"""WITH c AS ({CELLS}), dead AS (SELECT DISTINCT source_id FROM c WHERE error IS NOT NULL AND field = 'bookUrl')
        SELECT source_id, field, CASE WHEN error IS NULL THEN value ELSE '' END AS value, ord FROM c WHERE source_id NOT IN (SELECT source_id FROM dead)""",
)
def tolerant_fields(spark, sf):
    values, _ = B.tolerant_fields(_cells(spark, sf))
    return values


@query(
    "tolerant_warnings",
    f"""WITH c AS ({CELLS}) SELECT source_id, field, arg_min(error, ord) AS message, field = 'bookUrl' AS fatal
        FROM c WHERE error IS NOT NULL GROUP BY source_id, field""",
)
def tolerant_warnings(spark, sf):
    _, warnings = B.tolerant_fields(_cells(spark, sf))
    return warnings


def h1(expr: str) -> str:
    return f"replace(replace(replace(replace({expr}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


NEXT = f"""
    nx AS (SELECT a.page_id, b.url AS next FROM pages a JOIN pages b ON b.page_id = a.page_id + 1 WHERE a.page_id % 4 <> 3),
    p AS ({PAGES})"""


def _plain_url(expr: str) -> str:
    """The page addresses are canonical but for a missing path."""
    return f"CASE WHEN regexp_matches({expr}, '^https?://[^/]*$') THEN {expr} || '/' ELSE {expr} END"


@query(
    "extract_book_info",
    f"""WITH {NEXT.strip()}
        SELECT p.page_id, p.source_id, CASE WHEN p.source_id = 'net' THEN coalesce({_plain_url('nx.next')}, p.url) ELSE p.url END AS toc_url,
               {sql_trim(h1("regexp_extract(html, '<h1>([^<]*)</h1>', 1)"))} AS name, '' AS author,
               {sql_trim(h1("regexp_extract(html, '<div class=\"ad\">([^<]*)</div>', 1)"))} AS intro, '' AS cover_url
        FROM p LEFT JOIN nx ON nx.page_id = p.page_id""",
)
def extract_book_info(spark, sf):
    pages = _pages(spark, sf)
    info, _ = B.extract_book_info(pages, _rules(spark, pages))
    return info


@query(
    "explore_page",
    f"""WITH {NEXT.strip()}, i AS ({ITEMS})
        SELECT p.page_id, (SELECT count(*) FROM i WHERE i.page_id = p.page_id AND word <> '') AS books, {_plain_url('nx.next')} AS next_url
        FROM p LEFT JOIN nx ON nx.page_id = p.page_id""",
)
def explore_page(spark, sf):
    pages = _pages(spark, sf)
    books, onward, _ = B.explore_page(pages, _rules(spark, pages))
    counts = books.groupBy("page_id").agg(F.count("*").alias("books"))
    return pages.select("page_id").join(counts, "page_id", "left").join(onward.select("page_id", "next_url"), "page_id", "left").select(
        "page_id", F.coalesce("books", F.lit(0)).alias("books"), "next_url"
    )


@query(
    "init_reroot",
    f"""SELECT page_id, source_id, CASE WHEN source_id = 'com' THEN 'body' ELSE '#document' END AS tag FROM ({PAGES})""",
)
def init_reroot(spark, sf):
    pages = _pages(spark, sf)
    nodes = B.node_table(pages)
    compiled = R.compile_rules(_rules(spark, pages).where("grp = 'ruleBookInfo' AND field = 'init'"))
    starts = B.init_reroot(nodes, pages, compiled.parts)
    return starts.join(nodes.select("page_id", "node_id", "tag"), ["page_id", "node_id"]).select("page_id", "source_id", "tag")


# --- chapter lists -----------------------------------------------------------------------------------
# A book is four pages in a row as far as they belong to one source and link on.
BOOK_PAGES = f"""
    pg AS ({PAGES}),
    bp AS (SELECT a.page_id, a.source_id, a.url, a.page_id - a.page_id % 4 AS book, a.page_id % 4 AS page_no FROM pg a
           WHERE (SELECT count(*) FROM pg b WHERE b.source_id = a.source_id AND b.page_id BETWEEN a.page_id - a.page_id % 4 AND a.page_id) = a.page_id % 4 + 1)"""


@query(
    "extract_toc",
    f"""WITH {BOOK_PAGES.strip()},
         i AS ({ITEMS}),
         n AS (SELECT page_id, max(item) AS top FROM i GROUP BY page_id),
         r AS (SELECT i.source_id, book, page_no, CASE WHEN i.source_id = 'org' THEN item ELSE top - item END AS pos, word, origin || {sql_encode('href')} AS url
               FROM i JOIN bp ON bp.page_id = i.page_id JOIN n ON n.page_id = i.page_id WHERE word <> ''),
         f AS (SELECT source_id, book, url, min(page_no * 1000000 + pos) AS spot, arg_min(word, page_no * 1000000 + pos) AS name FROM r GROUP BY ALL)
       SELECT source_id, book AS book_key, row_number() OVER (PARTITION BY source_id, book ORDER BY spot) - 1 AS ord, name, url FROM f""",
)
def extract_toc(spark, sf):
    pages = _pages(spark, sf)
    seeds = pages.where("page_id % 4 = 0").select("source_id", F.col("page_id").alias("book_key"), "url")
    toc, _ = C.extract_toc(pages, _rules(spark, pages), seeds)
    return toc.select("source_id", "book_key", "ord", "name", "url")


@query(
    "content_by_kind",
    f"""WITH {BOOK_PAGES.strip()},
         t AS (SELECT p.source_id, book, string_agg({sql_trim("regexp_extract(html, '(?s)<article>(.*?)</article>', 1)")}, chr(10) ORDER BY page_no) AS raw
               FROM pages JOIN bp p ON p.page_id = pages.page_id GROUP BY ALL)
       SELECT source_id, book AS chapter_key, 'text' AS kind, {sql_normalize(sql_flatten("regexp_replace(raw, '%%%', '', 'g')"))} AS "text" FROM t""",
)
def content_by_kind(spark, sf):
    pages = _pages(spark, sf)
    chapters = pages.where("page_id % 4 = 0").select("source_id", F.col("page_id").alias("chapter_key"), "url")
    kinds = pages.select("source_id").dropDuplicates().select("source_id", F.lit(0).alias("source_type"), F.lit("##%%%").alias("replace_regex"))
    contents, _ = C.content_by_kind(pages, _rules(spark, pages), chapters, kinds)
    return contents.select("source_id", "chapter_key", "kind", "text")


@query(
    "page_chain",
    """WITH RECURSIVE l AS (SELECT page_id AS u, CASE WHEN page_id % 50 = 49 THEN page_id - 5 WHEN page_id % 31 = 30 THEN page_id
                                ELSE page_id + 1 END AS v FROM pages),
         c(seed, page_no, u, seen) AS (
           SELECT page_id, 0, page_id, [page_id] FROM pages WHERE page_id % 10 = 0
           UNION ALL SELECT seed, page_no + 1, v, list_append(seen, v) FROM c JOIN l ON l.u = c.u
           WHERE page_no < 19 AND NOT list_contains(seen, v) AND v < (SELECT count(*) FROM pages))
       SELECT seed, CAST(page_no AS INT) AS page_no, CAST(u AS VARCHAR) AS url FROM c""",
)
def page_chain(spark, sf):
    """Links between page numbers with a cycle in fifty, a self link in thirty-one, and an end."""
    n = F.col("page_id")
    onward = F.when(n % 50 == 49, n - 5).when(n % 31 == 30, n).otherwise(n + 1)
    pages = table(spark, sf, "pages")
    links = pages.select(n.cast("string").alias("url"), onward.cast("string").alias("next_url"))
    seeds = pages.where("page_id % 10 = 0").select(n.alias("seed"), n.cast("string").alias("url"))
    return T.page_chain(links, seeds)


TOC_CLEAN = """
    f AS (SELECT source_id, book_key, page_no, pos, trim(name) AS name, url, lower(trim(is_volume)) NOT IN ('', 'false', '0') AS is_volume,
                 lower(trim(is_vip)) NOT IN ('', 'false', '0') AS is_vip, lower(trim(is_pay)) NOT IN ('', 'false', '0') AS is_pay,
                 nullif(trim(update_time), '') AS update_time FROM toc_raw),
    k AS (SELECT *, row_number() OVER (PARTITION BY source_id, book_key, CASE WHEN url = '' THEN 'v' || CAST(pos AS VARCHAR) ELSE url END ORDER BY page_no, pos) AS rn
          FROM f WHERE name <> '' AND (url <> '' OR is_volume)),
    t AS (SELECT source_id, book_key, row_number() OVER (PARTITION BY source_id, book_key ORDER BY page_no, pos) - 1 AS ord, name, url, is_volume, is_vip, is_pay, update_time
          FROM k WHERE rn = 1)"""


@query("clean_toc", with_tables(f"WITH {TOC_CLEAN} SELECT * FROM t", "toc_raw"))
def clean_toc(spark, sf):
    return T.clean_toc(derived(spark, sf, "toc_raw")).select(
        "source_id", "book_key", "ord", "name", "url", "is_volume", "is_vip", "is_pay", "update_time"
    )


@query(
    "toc_flags",
    with_tables("SELECT book_key, pos, lower(trim(is_vip)) NOT IN ('', 'false', '0') AS vip, nullif(trim(update_time), '') AS updated FROM toc_raw", "toc_raw"),
)
def toc_flags(spark, sf):
    return derived(spark, sf, "toc_raw").select(
        "book_key", "pos", T.toc_flag(F.col("is_vip")).alias("vip"), T.toc_time(F.col("update_time")).alias("updated")
    )


@query(
    "mark_cap",
    with_tables(f"WITH {TOC_CLEAN} SELECT book_key, ord, CASE WHEN ord < 3 THEN is_vip END AS is_vip FROM t", "toc_raw"),
)
def mark_cap(spark, sf):
    marked, _ = T.mark_cap(T.clean_toc(derived(spark, sf, "toc_raw")), 3)
    return marked.select("book_key", "ord", "is_vip")


@query(
    "stitch_content",
    """SELECT conv_id AS chapter_key, string_agg("text", chr(10) ORDER BY turn) AS "text" FROM conversations
       WHERE turn % 3 <> 2 GROUP BY conv_id""",
)
def stitch_content(spark, sf):
    raw = F.when(F.col("turn") % 3 == 2, " \n ").otherwise(F.col("text"))
    return T.stitch_content(table(spark, sf, "conversations").select(F.col("conv_id").alias("chapter_key"), F.col("turn").alias("page_no"), raw.alias("raw")))


# --- rule texts --------------------------------------------------------------------------------------
@query(
    "rule_dialect",
    with_tables(
        r"""SELECT source_id, grp, field, CASE
              WHEN regexp_matches(rule, '(?i)^@css:') THEN 'css' WHEN regexp_matches(rule, '(?i)@js:|<js[\s>]') THEN 'js'
              WHEN rule LIKE '/%' THEN 'xpath' WHEN regexp_matches(rule, '^\$[.\[]') THEN 'json' WHEN rule LIKE ':%' THEN 'allinone'
              WHEN split_part(rule, '@', 1) = '' OR regexp_matches(split_part(rule, '@', 1), '^-?(class|id|tag|text|children)(\.|$)')
                THEN 'default' ELSE 'css' END AS dialect FROM rule_fields""",
        "rule_fields",
    ),
)
def rule_dialect(spark, sf):
    return R.rule_dialect(derived(spark, sf, "rule_fields")).select("source_id", "grp", "field", "dialect")


@query(
    "rule_steps",
    with_tables(
        """WITH k AS (SELECT source_id, grp, field, rule, unnest(CASE rule
             WHEN 'class.item.0@tag.a@href' THEN [(0, '', 0, 'class', 'item', '0', 'href'), (0, '', 1, 'tag', 'a', '', 'href')]
             WHEN 'id.info@tag.p.-1@text##^by ##' THEN [(0, '', 0, 'id', 'info', '', 'text'), (0, '', 1, 'tag', 'p', '-1', 'text')]
             WHEN 'class.a b@li!0:1@text||tag.h1@text' THEN [(0, '||', 0, 'class', 'a b', '', 'text'), (0, '||', 1, 'tag', 'li', '!0:1', 'text'), (1, '||', 0, 'tag', 'h1', '', 'text')]
             WHEN 'tag.dd@a@href&&tag.dt@a@href' THEN [(0, '&&', 0, 'tag', 'dd', '', 'href'), (0, '&&', 1, 'tag', 'a', '', 'href'), (1, '&&', 0, 'tag', 'dt', '', 'href'), (1, '&&', 1, 'tag', 'a', '', 'href')]
             WHEN '-class.chapters@tag.li' THEN [(0, '', 0, 'class', 'chapters', '', 'text'), (0, '', 1, 'tag', 'li', '', 'text')]
             WHEN '@put:{bid:tag.a@href}tag.h3@text' THEN [(0, '', 0, 'tag', 'h3', '', 'text')]
             WHEN 'tag.span.1:3@ownText%%tag.em@text' THEN [(0, '%%', 0, 'tag', 'span', '1:3', 'ownText'), (1, '%%', 0, 'tag', 'em', '', 'text')]
             ELSE [] END) AS s FROM rule_fields)
           SELECT source_id, grp, field, CAST(s[1] AS INT) AS part, nullif(s[2], '') AS joiner, CAST(s[3] AS INT) AS step_ord, s[4] AS "by", s[5] AS name,
                  s[6] AS index_expr, s[7] AS extract FROM k""",
        "rule_fields",
    ),
)
def rule_steps(spark, sf):
    return R.rule_steps(derived(spark, sf, "rule_fields"))
