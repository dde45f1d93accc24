"""Rules and pages the jobs once passed over without a word."""

from pyspark.sql import functions as F

from pagemill.catalog import QUERIES
from pagemill.functions import jsonpath, text
from pagemill.plans import books, chapters

PAGES = "page_id bigint, source_id string, url string, html string"
RULES = "source_id string, grp string, field string, rule string"
SEEDS = "source_id string, book_key string, url string"


def named(warnings):
    return sorted((r["source_id"], r["field"], r["fatal"]) for r in warnings.collect())


def test_broken_rules_of_chapters_and_explore_are_named(spark):
    html = '<html><body><li><a href="/1">one</a></li><p>text</p></body></html>'
    pages = spark.createDataFrame([(i, s, f"https://{s}.com/", html) for i, s in enumerate("abcd")], PAGES)
    rows = [
        *[(s, g, f, "tag.li") for s in "abcd" for g, f in (("ruleToc", "chapterList"), ("ruleExplore", "bookList"))],
        *[(s, "ruleContent", "content", "tag.p@text") for s in "acd"],
        ("a", "ruleToc", "isVip", "//img["), ("b", "ruleToc", "nextTocUrl", "//a[foo()]"), ("c", "ruleToc", "chapterUrl", "{{java.u()}}"),
        ("b", "ruleContent", "content", "//p[foo()]"), ("c", "ruleContent", "nextContentUrl", "{{java.next()}}"), ("d", "ruleContent", "title", "@get:{t}"),
        ("a", "ruleExplore", "nextPageUrl", "//a["), ("b", "ruleExplore", "kind", "<js>1</js>"), ("d", "ruleExplore", "name", "@put:{n:tag.a@text}tag.a@text"),
    ]
    rules = spark.createDataFrame(rows, RULES)
    seeds = spark.createDataFrame([(s, "k", f"https://{s}.com/") for s in "abcd"], SEEDS)

    toc, warnings = chapters.extract_toc(pages, rules, seeds)
    assert named(warnings) == [("a", "isVip", False), ("b", "nextTocUrl", True), ("c", "chapterUrl", True)]
    assert sorted(r["source_id"] for r in toc.collect()) == ["a", "d"]

    keys = seeds.withColumnRenamed("book_key", "chapter_key")
    kinds = spark.createDataFrame([(s, 0, None) for s in "abcd"], "source_id string, source_type int, replace_regex string")
    texts, warnings = chapters.content_by_kind(pages, rules, keys, kinds)
    assert named(warnings) == [("b", "content", False), ("c", "nextContentUrl", True)]
    assert sorted((r["source_id"], r["text"]) for r in texts.collect()) == [("a", "text"), ("d", "text")]

    found, _, warnings = books.explore_page(pages, rules)
    assert named(warnings) == [("a", "nextPageUrl", True), ("b", "kind", False)]
    assert sorted((r["source_id"], r["name"]) for r in found.collect()) == [("b", "one"), ("c", "one"), ("d", "one")]


def test_json_rules_of_every_kind(spark):
    body = '{"x":{"list":[{"id":1,"t":"A","tags":["p","q"]},{"id":2,"t":"B"},null,{"id":10,"t":"C","sub":{"t":"D"}}]},"n":1}'
    lists = {
        "deep": ("$..list[*]", "ABC"), "whole": ("$.x.list", "ABC"), "slice": ("$.x.list[0:2]", "AB"), "same": ("$.x.list[?(@.id==2)]", "B"),
        "more": ("$..list[?(@.id>=2)]", "BC"), "last": ("$.x.list[-1]", "C"), "two": ("$.x.list[0]&&$.x.list[3]", "AC"),
    }
    pages = spark.createDataFrame([(i, s, "https://a.com/", body) for i, s in enumerate([*lists, "bad"])], PAGES)
    rows = [(s, "ruleSearch", *f) for s, (rule, _) in lists.items() for f in (("bookList", rule), ("name", "$.t"), ("author", "$..t"), ("kind", "$.tags[*]"))]
    rows += [("bad", "ruleSearch", "bookList", "$.x.list[?(@.id>'a')]"), ("bad", "ruleSearch", "name", "$.t")]
    found, warnings = books.extract_book_list(pages, spark.createDataFrame(rows, RULES))
    got = found.orderBy("source_id", "item").collect()
    for s, (_, names) in lists.items():
        assert "".join(r["name"] for r in got if r["source_id"] == s) == names, s
    deep = [(r["author"], r["kind"]) for r in got if r["source_id"] == "whole"]
    assert deep == [(lines("A"), lines("p", "q")), ("B", ""), (lines("C", "D"), "")]
    assert named(warnings) == [("bad", "bookList", True)]


def lines(*values):
    return "\n".join(values)


def test_paths_as_data_equal_literal_paths(spark):
    docs = ['{"a":[{"b":1,"c":{"d":"x"}},{"b":"2","c":{}},{"b":3}],"e":{"a":[5]}}', "[[1,2],[3]]", "no json", '"text"', '{"a":[1', None]
    paths = ["$.a[*].b", "$..b", "$.a[?(@.b>1)].b", "$.a[?(@.c.d=='x')]", "$.a[?(@.c)]", "$.a[1:]", "$.a[-2:-1]", "$[*][0]", "$[0]", "$..a[*]", "$.e.*", "$..[?(@.b==3)]", "$.none"]
    rows = [(i, d, p, k) for i, d in enumerate(docs) for k, p in enumerate(paths)]
    table = spark.createDataFrame(rows, "i int, doc string, text string, k int")
    data = spark.createDataFrame([(k, jsonpath.path_rows(p)) for k, p in enumerate(paths)], f"k int, path array<{jsonpath.STEP}>")
    got = {(r["i"], r["k"]): r["values"] for r in jsonpath.with_json_values(table.join(data, "k"), "doc", "path", [0, 1]).collect()}
    for k, p in enumerate(paths):
        for r in table.where(F.col("k") == k).select("i", jsonpath.json_values(F.col("doc"), p).alias("v")).collect():
            assert got[(r["i"], k)] == r["v"], (p, r["i"])


def test_pages_of_other_endings_stay(spark, sf, tmp_path):
    given = spark.read.parquet(f"{sf}/pages.parquet").orderBy("page_id").limit(8)
    host = F.element_at(F.array(*map(F.lit, ["http://a.dev", "http://localhost", "http://a.io", "http://b.com"])), (F.col("page_id") % 4 + 1).cast("int"))
    pages = given.withColumn("url", F.concat(host, F.lit("/p/"), "page_id"))
    pages.coalesce(1).write.parquet(f"{tmp_path}/some/pages.parquet")
    want = {r["page_id"]: {1: "", 2: "io", 3: "com", 0: "dev"}[r["page_id"] % 4] for r in pages.collect()}
    for name in ("extract_book_list", "init_reroot"):
        rows = QUERIES[name](spark, f"{tmp_path}/some").select("page_id", "source_id").distinct().collect()
        assert {r["page_id"]: r["source_id"] for r in rows} == want, name


def test_all_named_references_are_decoded_once(spark):
    rows = [
        ("caf&eacute; &Omega;&AMP;&NotEqualTilde;", "café Ω&≂̸"), ("&amp;lt; &#38;lt; &lt&semi; &num;38;", "&lt; &lt; &lt; #38;"),
        ("a & b; &nosuch; &x &lt;&#x41;&#0;", "a & b; &nosuch; &x <A\ufffd"), ("&copy", "&copy"), ("", ""),
    ]
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select("b", text.decode_entities(F.col("a")).alias("got")).collect():
        assert r["got"] == r["b"]
    assert df.limit(1).select(text.html_to_text(F.lit("<p>caf&eacute;</p>"))).first()[0].strip() == "café"


def test_selectors_read_a_stored_node_table(spark, sf):
    """Each step of a selection reads the node table again; the pages are parsed once, in bounded batches."""
    for name in ("select_descendants", "select_by_text", "select_xpath_not", "select_css", "select_css_class", "select_children"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan, name
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_streams_read_a_table_of_several_files(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet").where("page_id < 40")
    pages.repartition(2).write.parquet(f"{tmp_path}/pages.parquet")
    assert len(QUERIES["stream_page_extract"](spark, str(tmp_path)).select("page_id").distinct().collect()) > 1


def test_sessions_end_without_python(spark, tmp_path):
    from pagemill.catalog.streams import _drain
    from pagemill.streaming import jobs

    rows = [("a", 1, 0, 600), ("a", 1, 300, 900), ("b", 2, 0, 600), ("c", 3, 100, 5000), ("d", 4, 1000, 1600), ("e", 5, 10, None), ("f", 6, 50, 40)]
    starts = spark.createDataFrame(rows, "token string, user_id bigint, s int, e int")
    starts.select("token", "user_id", F.timestamp_seconds("s").alias("at"), (F.col("e") * 1000).cast("bigint").alias("expires_at")).write.parquet(f"{tmp_path}/s")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/s").schema).parquet(f"{tmp_path}/s")
    ended = jobs.stream_session_expiry(stream)
    assert "Pandas" not in ended._jdf.queryExecution().analyzed().toString()
    got = sorted(tuple(r) for r in _drain(spark, ended).collect())
    assert got == [("a", 1, 900_000), ("b", 2, 600_000), ("f", 6, 40_000)]


def test_lists_of_a_backup_meet_in_one_shuffle(spark):
    from pagemill.sources import backup

    place = "chapter_url string, chapter_name string, chapter_index int, page_index int"
    book = "owner string, book_key string, source_id string, book_url string"
    kinds = {
        "shelf": f"{book}, name string, author string, cover_url string, created_at bigint, updated_at bigint",
        "progress": f"owner string, book_key string, {place}, updated_at bigint",
        "bookmarks": f"{book}, id string, {place}, percent double, excerpt string, note string, created_at bigint, updated_at bigint",
        "notes": f"{book}, id string, {place}, percent double, excerpt string, text string, created_at bigint, updated_at bigint",
    }
    lists = {n: spark.createDataFrame([], k) for n, k in kinds.items()}
    lists["shelf"] = spark.createDataFrame(
        [("o", "s\nb", "s", "b", "n2", "", "", 2, 2), ("o", "s\na", "s", "a", "n1", "", "", 1, 1), ("p", None, "s", "c", "n3", "", "", None, 1)], kinds["shelf"]
    )
    docs = backup.export_backup(**lists, now=1)
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    (row,) = docs.select("owner", "part", F.from_json("doc", "shelf array<struct<name:string>>")["shelf"]["name"].alias("names")).collect()
    assert tuple(row) == ("o", 0, ["n1", "n2"])


def test_plain_lists_of_a_backup_are_seen_at_first_sight(spark):
    from pagemill.sources import backup

    head, place = '{"kind":"library-backup","version":1', '"sourceId":"s","bookUrl":"b"'
    shelf = head + ',"shelf":[{' + place + ',"name":"n"%s}]}'
    progress = head + ',"progress":[{' + place + ',"chapterUrl":"/c","chapterIndex":%s}]}'
    docs = [
        (0, shelf % ',"author":null,"createdAt":5', True, []), (1, shelf % ',"author":7', False, ["author"]),
        (2, progress % "3", True, []), (3, progress % '" 3 "', False, []), (4, progress % "-1", False, ["chapterIndex"]),
        (5, progress % "true", False, []), (6, progress % '["3"]', False, ["chapterIndex"]), (7, progress % "0.5", True, []),
        (8, shelf % (',"author":"' + "x" * 200 + '"'), True, []), (9, shelf % (',"author":"' + "x" * 200 + ' "'), False, []),
        (10, shelf % (',"author":"' + "x" * 201 + '"'), False, ["author"]), (11, head + ',"shelf":[null]}', False, ["record"]),
        (12, (shelf % "").replace('"n"', '"\u3000 "'), False, ["name"]), (13, head + ',"shelf":{}}', False, [None]),
        (14, head + ',"shelf":null}', False, []), (15, head + ',"shelf":[]}', True, []),
    ]
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id int, doc string")
    got = df.select(
        "doc_id", backup.backup_errors(F.col("doc")).alias("e"),
        *[backup._is_plain(F.try_parse_json("doc"), F.from_json("doc", f"{n} {backup._plain_type(n)}")[n], n).alias(n) for n in ("shelf", "progress")],
    )
    found = {r["doc_id"]: (r["shelf"] or r["progress"], [x["field"] for x in r["e"]]) for r in got.collect()}
    assert found == {i: (plain, fields) for i, _, plain, fields in docs}


def test_bookmark_lists_are_numbered_by_book(spark):
    """Books that share a heading, and books without a source, an address, a heading or an owner."""
    from pagemill.sources import exports

    schema = (
        "owner string, source_id string, book_url string, book_name string, book_author string, chapter string, position string, "
        "excerpt string, note string, chapter_index int, page_index int, created_at bigint"
    )
    books = [
        ("u", "s2", "b1", "A", ""), ("u", "s1", "b9", "B", "x"), ("u", "s3", "b0", "A", " "), ("u", None, "b1", "C", None), ("u", "s1", None, "A", ""),
        ("u", None, None, "C", ""), ("u", "s4", "b", None, "y"), (None, "s1", "b1", "A", ""), ("v", "s1", "b1", "A", ""), ("v", "s1", "b1", "A2", ""),
    ]
    rows = [(*b, f"c{i}", "p", f"e{k}", "", i, None if (i + k) % 4 == 0 else 7 - i, 10 * k) for k, b in enumerate(books) for i in (2, 0, 1, 3)]
    got = exports.export_bookmarks_md(spark.createDataFrame(rows, schema).repartition(5), 0).collect()

    def rank(values):
        return tuple((v is not None, v if v is not None else 0) for v in values)

    want = []
    for owner in (None, "u", "v"):
        mine = [(None if r[3] is None else r[3] + (f"（{r[4].strip()}）" if (r[4] or "").strip() else ""), r) for r in rows if r[0] == owner]
        spots = {}
        for heading, r in mine:
            spots.setdefault(heading, []).append((rank((r[1], r[2], *r[9:])), r))
        lines = ["# 书签清单", "", "- 导出时间：1970-01-01 08:00（UTC+8）", f"- 共 {len(mine)} 条，来自 {len(spots)} 本书"]
        for heading in sorted(spots, key=lambda h: (min(s for s, _ in spots[h]), rank((h,)))):
            lines += ["", None if heading is None else f"## {heading}", "", exports.MD_TABLE_HEAD, exports.MD_TABLE_RULE]
            for _, r in sorted(spots[heading], key=lambda x: x[0]):
                lines.append(f"| {r[5]} | p | {r[7]} |  | 1970-01-01 08:00 |" if owner and heading else "gone")
        want += [(owner, i, line) for i, line in enumerate(lines) if line != "gone"]
    assert sorted(map(tuple, got), key=rank) == sorted(want, key=rank)


def test_bookmarks_are_read_once_for_a_list(spark, sf):
    """Counting the entries of a book and writing them share the shuffles below."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        out = QUERIES["export_bookmarks_md"](spark, sf)
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set(name, before)
    assert plan.count("FileScan parquet [l_") == 1


def test_shelves_are_aggregated_as_numbers(spark):
    from pagemill.operators import merge

    schema = "source_id string, source_name string, ok boolean, ord bigint, name string, author string, book_url string"
    rows = [
        ("s1", "", True, 30, "A b", "x", "u1"), ("s2", "", True, 10, "a B", "X", "u2"), ("s3", "", None, 20, "AB", "", "u3"), ("s4", "", True, 5, "ab", "y", "u4"),
        ("s5", "", False, 1, "ab", "x", "u5"), ("s6", "", True, None, "c", "z", "u6"), ("s7", "", True, None, "ab", "y", "u7"), ("s8", "", True, 1, " ", "", "u8"),
    ]
    books = spark.createDataFrame([*rows, rows[0]], schema)
    kept = [("o", "s1", "u1"), ("o", "s1", "u1"), ("o", "s3", "u3"), ("o", "s7", "u7"), (None, "s2", "u2"), (None, "s1", "u1"), ("p", "s6", "u6"),
            ("p", "s4", "u4"), ("p", "s7", "u7"), ("p", "s5", "u5"), ("p", "s8", "u8"), ("p", "s1", "u2"), ("q", None, "u1")]
    out = merge.preferred_source(books, spark.createDataFrame(kept, "owner string, source_id string, book_url string"))
    assert {tuple(r) for r in out.collect()} == {
        ("o", "ab", "x", "s1", "u1"), ("o", "ab", "y", "s3", "u3"), (None, "ab", "x", "s2", "u2"),
        ("p", "c", "z", None, None), ("p", "ab", "y", "s4", "u4"),
    }
    assert out.count() == 5
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
