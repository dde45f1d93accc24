"""Column functions on hand-written cases."""

import pytest
from pyspark.sql import functions as F

from pagemill.functions import jsonpath, lists, regex, scalars, template, text, urls


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "spec, want",
    [
        ("1", ["b"]), ("-1", ["e"]), ("-2", ["d"]), ("1:2", ["b", "c"]), ("1:4:2", ["b", "d"]), ("-1:0", ["e", "d", "c", "b", "a"]),
        ("!0,2", ["b", "d", "e"]), ("!0:1:2", ["d", "e"]), ("!0:-1", ["b", "c", "d"]), ("!important", list("abcde")), ("99", []),
        ("", list("abcde")), ("2:", ["c", "d", "e"]), (":1", ["a", "b"]), ("1,3,-1", ["b", "d", "e"]), ("0,0", ["a", "a"]),
        ("3:1:1", []), ("-9:1", ["a", "b"]), ("4:0:-2", ["e", "c", "a"]), ("0:99:3", ["a", "d"]),
    ],
)
def test_pick_index(spark, spec, want):
    assert one(spark, lists.pick_index(F.array(*map(F.lit, "abcde")), spec)) == want


def test_pick_index_of_nothing(spark):
    empty = F.array().cast("array<string>")
    assert one(spark, lists.pick_index(empty, "-1:0")) == []
    assert one(spark, lists.pick_index(F.lit(None).cast("array<string>"), "0")) == []


def test_combiners_with_nulls(spark):
    none, ab, c = F.lit(None).cast("array<string>"), F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c"))
    assert one(spark, lists.combine_concat(none, ab)) == ["a", "b"]
    assert one(spark, lists.combine_first(none, F.array().cast("array<string>"), c)) == ["c"]
    assert one(spark, lists.combine_interleave(ab, none, c)) == ["a", "c", "b"]
    assert one(spark, lists.value_join(F.array(F.lit("a"), F.lit(""), F.lit("b")))) == "a\nb"


@pytest.mark.parametrize(
    "html, want",
    [
        ("一<br>二<br/><br>三", "一\n二\n三"), ("<div><p>a</p>\n<p>b</p></div>", "a\nb"), ("<span>甲</span><span>乙</span>", "甲乙"),
        ("x<script>var a='</p>'</script>y<!-- <p> -->z", "xyz"), ("a &lt;b&gt; &amp;lt; &#20013;&#x6587; &#38;lt;<br>", "a <b> &lt; 中文 &lt;"),
        ("a<b and 1<3", "a<b and 1<3"), ("<head><title>t</title></head><header>h</header><p>", "h"), ("　　段<br>&nbsp;&nbsp;落", "段\n落"),
    ],
)
def test_content_text(spark, html, want):
    assert one(spark, text.content_text(F.col("h")), h=html) == want


def test_normalize_content(spark):
    assert one(spark, text.normalize_content(F.col("t")), t=" a\t b \r\n\r\n　 \r c  d　") == "a b\nc  d"


@pytest.mark.parametrize(
    "title, want",
    [("第十五章", "第15章"), ("第一百二十三章", "第123章"), ("第两千零一回", "第2001回"), ("第三万四千章", "第34000章"), ("第一亿二千万", "第120000000"),
     ("序章", "序章"), ("第十章", "第10章"), ("第零章", "第零章"), ("番外", "番外"), ("拾贰", "12")],
)
def test_chapter_number(spark, title, want):
    assert one(spark, text.chapter_number(F.col("t")), t=title) == want


def test_search_and_excerpt(spark):
    assert one(spark, text.search_count(F.col("t"), "aa"), t="aaaAa") == 2
    assert one(spark, text.search_count(F.col("t"), "  "), t="aaa") == 0
    assert one(spark, text.search_count(F.col("t"), "a.(b"), t="xA.(By a-(b") == 1
    assert one(spark, text.excerpt(F.col("t"), "HIT", 3), t="0123456 hit 789") == "…56 hit 78…"
    assert one(spark, text.excerpt(F.col("t"), "none", 3), t="0123456789") == "012345"
    assert one(spark, text.excerpt(F.col("t"), "01", 3), t="0123456789") == "01234…"


def test_regex_steps(spark):
    assert regex.split_chain("a.0@href##x@#y##r##.*##$1###") == ("a.0@href", [("x#y", "r", False), (".*", "$1", True)])
    assert one(spark, regex.regex_chain(F.col("t"), [("(bad", "x"), (r"\d+", "<$&>")]), t="a12b3") == "a<12>b<3>"
    cover = regex.regex_only_one(F.col("t"), r".+\D((\d+)\d{3})\D", "/files/$2/$1/$1s.jpg")
    assert one(spark, cover, t="/book/12345.html") == "/files/12/12345/12345s.jpg"
    assert one(spark, regex.regex_only_one(F.col("t"), "zz", "y"), t="abc") == ""
    assert one(spark, regex.regex_all_in_one(F.col("t"), r"<i>(.*?)</i>"), t="<i> a </i><i></i>\n<i>b</i>") == ["a", "b"]
    assert one(spark, regex.source_replace_regex(F.col("t"), F.lit("##ad\nx##y\n(z##q")), t="an ad x (z") == "an  y (z"


@pytest.mark.parametrize(
    "value, base, want",
    [
        ("b.html", "https://A.com/x/a.html", "https://a.com/x/b.html"), ("../b", "https://a.com/x/y/z", "https://a.com/x/b"),
        ("//c.com/q", "https://a.com/", "https://c.com/q"), ("?p=2", "https://a.com/l?p=1#t", "https://a.com/l?p=2"),
        ("#e", "https://a.com/l?p=1#t", "https://a.com/l?p=1#e"), ("/中 文", "http://a.com:80", "http://a.com/%E4%B8%AD%20%E6%96%87"),
        ("javascript:void(0)", "https://a.com/", "javascript:void(0)"), ("", "https://a.com", ""), ("b", "not a url", "b"),
        ("https://a.com/a/./b/..", "x", "https://a.com/a/"), (" HTTP://A.com ", "", "http://a.com/"),
    ],
)
def test_resolve_url(spark, value, base, want):
    assert one(spark, urls.resolve_url(F.col("v"), F.col("b")), v=value, b=base) == want


def test_address_options(spark):
    kept = urls.resolve_address(F.col("v"), F.lit("https://a.com/x/"))
    assert one(spark, kept, v='b, {"method":"POST"}') == 'https://a.com/x/b,{"method":"POST"}'
    got = one(spark, urls.split_url_options(F.col("v")), v="https://a.com/s<,{{page}}>,{'method':'POST','body':{'id':1}}")
    assert (got["url"], got["method"], got["body"], got["headers"]) == (
        "https://a.com/s<,{{page}}>", "POST", '{"id":1}', {"Content-Type": "application/json"},
    )
    assert one(spark, urls.split_url_options(F.col("v")), v="https://a.com,{oops")["valid"] is False
    assert one(spark, urls.url_page_template(F.lit("/s<,{{page}}>?k={{key}}"), F.lit("x"), F.lit(1))) == "/s?k=x"
    assert one(spark, urls.url_page_template(F.lit("/s<,{{page}}>?k={{key}}"), F.lit("x"), F.lit(3))) == "/s3?k=x"


DOC = '{"a":{"b":[{"n":1,"t":"x"},{"n":2},{"n":"10","t":null}],"z":"s"},"n":7}'


@pytest.mark.parametrize(
    "path, want",
    [
        ("$.a.b[*].n", ["1", "2", "10"]), ("$.a.b[0]", ['{"n":1,"t":"x"}']), ("$.a.b[-1].n", ["10"]), ("$.a.b[:2].n", ["1", "2"]),
        ("$.a.b[1:].n", ["2", "10"]), ("$..n", ["1", "2", "10", "7"]), ("$['a'].z", ["s"]), ("$.a.b[?(@.n==2)].n", ["2"]),
        ("$.a.b[?(@.n > 1)].n", ["2", "10"]), ("$.a.b[?(@.t)].n", ["1"]), ("$.a.b[9]", []), ("$.nope", []), ("$.a.[*]", None),
    ],
)
def test_json_paths(spark, path, want):
    got = one(spark, jsonpath.json_values(F.col("d"), path), d=DOC)
    assert got == want if want is not None else len(got) == 2


def test_json_paths_fail_loudly(spark):
    for path in ("$.a[?(@.x && @.y)]", "$.a[(1)]", "$.a b"):
        with pytest.raises(jsonpath.UnsupportedRule):
            jsonpath.path_steps(path)
    assert one(spark, jsonpath.json_values(F.col("d"), "$.a"), d="no json") == []


def test_templates_and_scalars(spark):
    assert one(spark, template.template_expand("{{a}}-{$.b}-${c}", {"a": F.lit("1"), "$.b": F.lit(2)})) == "1-2-${c}"
    assert one(spark, scalars.time_format(F.lit(0))) == "1970-01-01 08:00"
    assert one(spark, scalars.encode_uri(F.col("t")), t="a b(中)!*") == "a%20b(%E4%B8%AD)!*"
    assert one(spark, scalars.hmac_hex(F.lit("data"), "key", "HmacMD5")) == "9d5c73ef85594d34ec4438b7c97e51d8"
    assert one(spark, scalars.mime_type(F.lit("https://a.com/x.y/p.JPG?q=1"))) == "image/jpeg"
    assert one(spark, scalars.safe_file_name(F.lit(' a/b:  "c" '))) == "ab c"
