"""The rule language: selector lists and conditions, templates, variables, patterns, functions and hooks."""

import pytest
from pyspark.sql import functions as F

from pagemill import hooks
from pagemill.functions import rulesyntax, scalars
from pagemill.operators import cache, nodes, select
from pagemill.plans import books, chapters, rulesets

PAGES = "page_id bigint, source_id string, url string, html string"
RULES = "source_id string, grp string, field string, rule string"

HTML = """<html><body><ul id="u"><li class="x">1</li><li class="y" id="b">2<b>in</b></li><li>3</li><li class="x z">4</li></ul>
<div><p>p1</p><span>s1</span><p>p2</p><a href="/a">link</a></div><div class="e"><p>p3</p></div>
<table><tr><td>k</td><td>v1</td></tr><tr><td>k2</td><td>v2</td></tr></table></body></html>"""

CSS = {
    "li.x, li": ["1", "2in", "3", "4"], "p, li.y, span": ["2in", "p1", "s1", "p2", "p3"], "li:not(.x)": ["2in", "3"],
    "li:not(.x):not([id])": ["3"], "li:not(.x, #b)": ["3"], "li:nth-child(2n)": ["2in", "4"], "li:nth-child(odd)": ["1", "3"],
    "li:nth-child(-n+2)": ["1", "2in"], "li:nth-last-child(1)": ["4"], "li:nth-child(3)": ["3"], "p:first-of-type": ["p1", "p3"],
    "p:last-of-type": ["p2", "p3"], "p:nth-of-type(2)": ["p2"], "div > :only-child": ["p3"], "span:only-of-type": ["s1"], "p:nth-last-of-type(2)": ["p1"],
    "div:has(> span) > p": ["p1", "p2"], "div:not(:has(a)) p": ["p3"], "li:has(b)": ["2in"], "p:has(+ span)": ["p1"], "p:has(~ a)": ["p1", "p2"],
    "div:has(p + a, .none) a": ["link"], "li:is(.y, .z)": ["2in", "4"], "li:not(:contains(2))": ["1", "3", "4"], "li:eq(1)": ["2in"], "li:gt(1)": ["3", "4"],
    "li:lt(2)": ["1", "2in"], "tr:has(td:contains(k2)) td:last-child": ["v2"],
}
XPATH = {
    "//li[@class='x' or @id='b']": ["1", "2in"], "//li[not(@class)]": ["3"], "//li[not(@class='x') and not(@id)]": ["3", "4"],
    "//li|//p": ["1", "2in", "3", "4", "p1", "p2", "p3"], "//p | //li[2]": ["2in", "p1", "p2", "p3"], "//li[position()<3 or @class='x z']": ["1", "2in", "4"],
    "//li[contains(@class,'x')][2]": ["4"], "//li[2][@id]": ["2in"], "//li[2][@class='x']": [], "//li[@class and position()>1]": ["2in", "4"],
    "(//p)[2]": ["p2"], "(//p)[last()]": ["p3"], "//p[1]": ["p1", "p3"], "//tr[td='k2']/td[2]": ["v2"], "//div[.//a]/p": ["p1", "p2"],
    "//div[not(a)]/p": ["p3"], "//div[a/@href='/a']/span": ["s1"], "//li[.='3']": ["3"], "//li[text()='2']/b": ["in"], "//li[(@id or @class='x') and b]": ["2in"],
    "//li[not(position()=1 or position()=last())]": ["2in", "3"], "//tr[contains(td,'k')]/td[1]": ["k", "k2"], "//p[normalize-space()='p2']": ["p2"],
}


def test_selectors_in_rules(spark):
    """All cases as rules of one source, which are evaluated in the same rounds."""
    cases = [(f"@css:{text}@text", want) for text, want in CSS.items()] + list(XPATH.items())
    pages = spark.createDataFrame([(1, "s", "https://s.com/", HTML)], PAGES)
    compiled = rulesets.compile_rules(spark.createDataFrame([("s", "g", f"f{n}", text) for n, (text, _) in enumerate(cases)], RULES))
    assert compiled.errors.collect() == []
    start = spark.createDataFrame([(1, "s", 0, 0, None)], "page_id bigint, source_id string, item bigint, node_id int, json string")
    values = rulesets.field_values(books.node_table(pages), pages, start, compiled)
    got = {r.field: r["values"] for r in values.collect()}
    for n, (text, want) in enumerate(cases):
        assert got.get(f"f{n}", []) == want, text


@pytest.mark.parametrize(
    ("pick", "text"), [(select.select_css, "p, li.y, span"), (select.select_css, "div:has(> span) > p"), (select.select_xpath, "(//p)[2]"), (select.select_xpath, "//li[2][@id]")]
)
def test_selectors_alone(spark, pick, text):
    table = nodes.html_nodes(spark.createDataFrame([(1, HTML)], "page_id bigint, html string"))
    context = nodes.root_context(spark.createDataFrame([(1,)], "page_id bigint"))
    found = select.extract_value(table, pick(table, context, text), "text").collect()
    assert found[0]["values"] == (CSS | XPATH)[text]


def test_conditions_become_clauses():
    a, b, c = (rulesyntax.test("attr", name=n, op="has") for n in "abc")
    names = lambda clauses: [["!" * t["no"] + t["name"] for t in clause] for clause in clauses]
    assert names(rulesyntax.clauses_of(("or", [a, ("and", [b, c])]))) == [["a", "b"], ["a", "c"]]
    assert names(rulesyntax.clauses_of(("not", ("or", [a, ("and", [b, ("not", c)])])))) == [["!a"], ["!b", "c"]]
    for bad in ("li:nth-child(x)", "li::after", "a,,b", "li:not(a b)", "li:has(b:has(i))", "li:has(b:eq(1))"):
        assert rulesyntax.parse_rule(f"@css:{bad}@text")["error"], bad
    for bad in ("//a[", "//a[foo()]", "//a[position()=1 or contains(.,'x')]", "//a/@href|//b", "(//a)[1]/b", "//a[b[2]]", "//ancestor::a"):
        assert rulesyntax.parse_rule(bad)["error"], bad


def book_rows(spark, pages, rules, **more):
    found, warnings = books.extract_book_list(spark.createDataFrame(pages, PAGES), spark.createDataFrame(rules, RULES), **more)
    rows = {}
    for r in found.orderBy("source_id", "item").collect():
        rows.setdefault(r.source_id, []).append(r)
    return rows, sorted((r.source_id, r.field, r.fatal) for r in warnings.collect())


def rules_of(source, **fields):
    return [(source, "ruleSearch", f, r) for f, r in fields.items()]


def test_lists_templates_and_variables(spark):
    html = '<html><body><li><a href="/1">one  x</a><i>I</i></li><li><a href="/2">two</a></li><li><a href="/3"> </a></li></body></html>'
    body = '{"l":[{"id":1,"t":"A","g":["p","q"]},{"id":2,"t":"B"}]}'
    pages = [(i, s, f"https://{s}.com/s", body if s.startswith("j") else html) for i, s in enumerate(
        ["all", "whole", "bad", "both", "t", "v", "loop", "jt", "h", "nohook", "order"])]
    rules = [
        *rules_of("all", bookList=r':<li><a href="([^"]*)">([^<]*)</a>(?:<i>([^<]*)</i>||)', name="$2##\\s+##_", author="$1-$3", kind="text", bookUrl="$1?x"),
        *rules_of("whole", bookList=":<li>[\\s\\S]*?</li>", name="tag.a@text", author="tag.i@text||tag.a@href", bookUrl="tag.a@href"),
        *rules_of("bad", bookList=":<li>(", name="$1"),
        *rules_of("both", bookList="-tag.li", name="第{{tag.a@text}}章", author="{{tag.i@text}}||tag.a@href", kind="{{tag.i@text##I##J}}&&tag.i@text"),
        *rules_of("t", bookList="tag.li", name="{{tag.a@text}}", author="x {{'lit'}} {{@@tag.a@href}}##/##:", intro="{{baseUrl}}", kind="{{java.x()}}", wordCount="tag.{{tag.i}}@text"),
        *rules_of("v", bookList="tag.li@put:{z:tag.a}", name='@put:{n:"tag.a@text", "u":tag.a@href}tag.a@text', author="@get:{u}", kind="@put:{c:\"{{tag.i@text}}/@get:{n}\"}", intro="c=@get:{c} none=[@get:{no}]"),
        *rules_of("loop", bookList="tag.li", name="tag.a@text", author='@put:{a:"x@get:{b}"}', kind='@put:{b:"y@get:{a}"}', bookUrl="tag.a@href"),
        *rules_of("jt", bookList="$.l", name="{$.t}!", author="{{$.id}}-{{$.g[*]}}", kind="@get:{k}", bookUrl="/b/{$.id}@put:{k:$.t}"),
        *rules_of("h", bookList="tag.li", name="tag.a@text@js:upper##X$##Z", author="tag.i@text||tag.a@href@js:upper", kind="tag.a@text##o##0@js:upper()"),
        *rules_of("nohook", bookList="tag.li", name="tag.a@text", author="tag.a@text@js:missing", kind="@js:var x = 1; x"),
        *rules_of("order", bookList="tag.li", name="tag.a@text", author="@put:{k:\"{{'first'}}\"}", kind="@put:{k:\"{{'second'}}\"}", intro="@get:{k}"),
    ]
    hooks.register_hook("upper", lambda values: [v.upper() for v in values])
    rows, warnings = book_rows(spark, pages, rules, with_vars=True)
    pick = lambda s, *f: [tuple(r[x] for x in f) for r in rows.get(s, [])]
    assert pick("all", "item", "name", "author", "kind", "bookUrl") == [
        (0, "one_x", "/1-I", "/1", "https://all.com/1?x"), (1, "two", "/2-", "/2", "https://all.com/2?x")]
    assert pick("whole", "name", "author", "bookUrl") == [("one  x", "I", "https://whole.com/1"), ("two", "/2", "https://whole.com/2")]
    assert pick("both", "name", "author", "kind") == [("第章", "/3", ""), ("第two章", "/2", ""), ("第one  x章", "I", "J\nI")]
    assert pick("t", "name", "author", "intro", "kind", "wordCount") == [
        ("one  x", "x lit :1", "https://t.com/s", "", ""), ("two", "x lit :2", "https://t.com/s", "", "")]
    assert pick("v", "name", "author", "kind", "intro") == [
        ("one  x", "/1", "", "c=I/one  x none=[]"), ("two", "/2", "", "c=/two none=[]")]
    assert [r.vars for r in rows["v"]] == [{"n": "one  x", "u": "/1", "c": "I/one  x"}, {"n": "two", "u": "/2", "c": "/two"}]
    assert pick("loop", "name", "author", "kind") == [("one  x", "", ""), ("two", "", "")]
    assert pick("jt", "name", "author", "kind", "bookUrl") == [("A!", "1-p\nq", "A", "https://jt.com/b/1"), ("B!", "2-", "B", "https://jt.com/b/2")]
    assert pick("h", "name", "author", "kind") == [("ONE  Z", "I", "0NE  X"), ("TWO", "/2", "TW0")]
    assert pick("nohook", "name", "author") == [("one  x", ""), ("two", "")]
    assert pick("order", "intro") == [("second",), ("second",)]
    assert warnings == [
        ("bad", "bookList", True), ("loop", "author", False), ("loop", "kind", False), ("nohook", "author", False), ("nohook", "kind", False),
        ("t", "kind", False), ("t", "wordCount", False), ("v", "bookList", False)]


def test_functions_and_variables_from_search_to_chapters(spark):
    html = '<html><body><h1> T  t </h1><a id="n" href="/2">next</a><li>a</li><li>b</li><p>key=v1;rest</p></body></html>'
    pages = spark.createDataFrame([(1, "s", "https://s.com/1", html), (2, "s", "https://s.com/2", html.replace("/2", "/3")), (3, "s", "https://s.com/3", html.replace("/2", "/1"))], PAGES)
    given = [
        ("ruleBookInfo", "init", '@put:{m:"tag.h1@text"}'), ("ruleBookInfo", "name", "@xpath:count(//li)"), ("ruleBookInfo", "author", "@xpath:normalize-space(//h1)"),
        ("ruleBookInfo", "intro", "@xpath:concat(substring-after(//p,'x'),//li,'+',//none)"), ("ruleBookInfo", "coverUrl", "/c/@get:{bid}/@get:{m}"), ("ruleBookInfo", "tocUrl", "@xpath:string(//a/@href)"),
        ("ruleToc", "chapterList", "tag.li"), ("ruleToc", "chapterName", "{{text}}-@get:{bid}"), ("ruleToc", "chapterUrl", "/ch/{{tag.li@text}}@get:{bid}"), ("ruleToc", "nextTocUrl", "id.n@href"),
        ("ruleContent", "content", "@get:{bid} - {{tag.p@text}}"),
    ]
    given = [(g, f, r) for g, f, r in given if f not in ("intro", "chapterName", "chapterUrl")] + [
        ("ruleBookInfo", "intro", "@xpath:substring-before(//p,';')"), ("ruleToc", "chapterName", "{{tag.body@text}}-@get:{bid}"), ("ruleToc", "chapterUrl", "/ch/@get:{bid}/{{@css:body@text}}"),
    ]
    table = spark.createDataFrame([("s", *g) for g in given], RULES)
    known = spark.createDataFrame([("s", "https://s.com/1", {"bid": "77"})], "source_id string, url string, vars map<string,string>")
    info, warnings = books.extract_book_info(pages.where("page_id = 1"), table, variables=known, with_vars=True)
    row = info.first()
    assert (row.name, row.author, row.intro, row.cover_url, row.toc_url) == ("2", "T t", "key=v1", "https://s.com/c/77/T%20%20t", "https://s.com/2")
    assert row.vars == {"bid": "77", "m": "T  t"} and warnings.isEmpty()
    seeds = spark.createDataFrame([("s", "k", "https://s.com/1")], "source_id string, book_key string, url string")
    book = spark.createDataFrame([("s", "k", {"bid": "77"})], "source_id string, book_key string, vars map<string,string>")
    toc, warnings = chapters.extract_toc(pages, table, seeds, variables=book, max_pages=2)
    assert [(r.field, r.fatal) for r in warnings.collect()] == [("nextTocUrl", False)] and "2 pages" in warnings.first().message
    toc, warnings = chapters.extract_toc(pages, table, seeds, variables=book)
    assert warnings.isEmpty()
    keys = spark.createDataFrame([("s", 5, "https://s.com/1")], "source_id string, chapter_key int, url string")
    kinds = spark.createDataFrame([("s", 0, None)], "source_id string, source_type int, replace_regex string")
    known = spark.createDataFrame([("s", 5, {"bid": "77"})], "source_id string, chapter_key int, vars map<string,string>")
    texts, _ = chapters.content_by_kind(pages, table, keys, kinds, variables=known)
    assert [r.text.strip() for r in texts.collect()] == ["77 - key=v1;rest"]


def test_programs_are_put_in_order():
    read = lambda f, rule: (f, rulesyntax.parse_rule(rule)["programs"])
    programs, errors = rulesyntax.in_order([read("a", "@get:{x}"), read("b", '@put:{x:"@get:{y}1"}'), read("c", '@put:{y:"$.k"}')])
    assert [p["name"] for p in programs] == ["y", "x", "a"] and errors == []
    programs, errors = rulesyntax.in_order([read("a", '@put:{x:"@get:{x}"}'), read("b", "{{$.k}}")])
    assert [p["name"] for p in programs] == ["b"] and [f for f, _ in errors] == ["a"]


def test_cache_reads_what_was_written_before(spark):
    import random

    draw = random.Random(3)
    writes = [(draw.choice("ab"), draw.choice([None, f"v{i}"]), draw.randrange(500), i, draw.choice([None, 0, 30, 200])) for i in range(120)]
    reads = [(draw.choice("abc"), draw.randrange(520), 1000 + i, f"r{i}") for i in range(150)]
    want = {}
    for key, at, seq, name in reads:
        last = max(((w[2], w[3]), w) for w in [*writes, (key, None, -1, -1, None)] if w[0] == key and (w[2], w[3]) <= (at, seq))[1]
        want[name] = last[1] if last[1] is not None and (not last[4] or at < last[2] + last[4]) else None
    log = spark.createDataFrame(writes, "key string, value string, at long, seq long, ttl_ms long")
    asked = spark.createDataFrame(reads, "key string, at long, seq long, name string")
    for step in (1, 60, cache.STEP_MS):
        assert {r.name: r.cached for r in cache.cache_lookup(log, asked, step).collect()} == want
    kept = cache.cache_compact(log, F.lit(519))
    later = asked.withColumn("at", F.lit(519).cast("long"))
    before = {r.name: r.cached for r in cache.cache_lookup(log, later).collect()}
    assert {r.name: r.cached for r in cache.cache_lookup(kept, later).collect()} == before


def test_small_helpers(spark):
    row = spark.createDataFrame([(["b", "a", None], "aé\U0001f600")], "v array<string>, t string").select(
        scalars.sorted_values(F.col("v")).alias("s"), scalars.reversed_text(F.col("t")).alias("r"), scalars.random_uuid().alias("u"),
        scalars.to_simplified(F.col("t")).alias("x"), scalars.to_traditional(F.col("t")).alias("y"),
    ).first()
    assert row.s == ["a", "b", None] and row.r == "\U0001f600éa" and row.x == row.y == "aé\U0001f600" and len(row.u) == 36
    assert rulesets.variable_field("k") != "k"
