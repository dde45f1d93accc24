"""Text columns over pages, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import regex, text
from .base import query, table, texts

# White space class of the SQL dialect, and the trim set behind it.
SQL_SPACE = (
    r"[\s\x0b\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
)
SQL_TRIM = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(160)||chr(5760)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)||chr(65279)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)"


def sql_trim(expr: str) -> str:
    return f"trim({expr}, {SQL_TRIM})"


def sql_normalize(expr: str) -> str:
    """Line by line, the long way round, so that it checks the one-pass pattern."""
    return (
        "array_to_string(list_filter(list_transform(string_split("
        rf"regexp_replace({expr}, '\r\n?', chr(10), 'g'), chr(10)), "
        rf"lambda x: {sql_trim(r'''regexp_replace(x, '[\t\x{00a0}\x{3000}]+', ' ', 'g')''')}), lambda x: x <> ''), chr(10))"
    )


def sql_flatten(expr: str) -> str:
    """HTML flattening: skipped parts one tag at a time (no back references in this dialect)."""
    out = rf"regexp_replace({expr}, '(?s)<!--.*?-->', '', 'g')"
    for tag in text.SKIPPED_TAGS:
        out = rf"regexp_replace({out}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', '', 'g')"
    blocks = "|".join(text.BLOCK_TAGS)
    out = rf"regexp_replace({out}, '(?i)</?(?:br|{blocks})(?:[\s/][^>]*)?>', chr(1), 'g')"
    out = rf"regexp_replace({out}, '<[a-zA-Z/!?][^>]*>', '', 'g')"
    for name, char in text.NAMED_ENTITIES.items():
        out = f"replace({out}, '&{name};', chr({ord(char)}))"
    out = rf"regexp_replace({out}, '\x01+', chr(1), 'g')"
    return f"replace(replace({out}, chr(10)||chr(1), chr(10)), chr(1), chr(10))"


HTML_HINT_SQL = rf"(?i)</?(?:{'|'.join(text.HTML_HINT_TAGS)})\b[^>]*>"


@query(
    "norm_key",
    rf"""SELECT doc_id, lower(regexp_replace("text", '{SQL_SPACE}+', '', 'g')) AS norm_text FROM documents""",
)
def norm_key(spark, sf):
    return texts(spark, sf, "documents", "doc_id", "text").select("doc_id", text.norm_key(F.col("text")).alias("norm_text"))


@query("normalize_content", f"""SELECT doc_id, {sql_normalize('"text"')} AS clean FROM documents""")
def normalize_content(spark, sf):
    return texts(spark, sf, "documents", "doc_id", "text").select("doc_id", text.normalize_content(F.col("text")).alias("clean"))


@query("html_to_text", f"SELECT page_id, {sql_flatten('html')} AS flat FROM pages")
def html_to_text(spark, sf):
    return texts(spark, sf, "pages", "page_id", "html").select("page_id", text.html_to_text(F.col("html")).alias("flat"))


@query(
    "looks_like_html",
    f"""SELECT 'page' AS kind, page_id AS id, regexp_matches(html, '{HTML_HINT_SQL}') AS is_html FROM pages
        UNION ALL
        SELECT 'document', doc_id, regexp_matches("text", '{HTML_HINT_SQL}') FROM documents""",
)
def looks_like_html(spark, sf):
    def pick(name, key, col):
        return texts(spark, sf, name, key, col).select(
            F.lit(name[:-1]).alias("kind"), F.col(key).alias("id"), text.looks_like_html(F.col(col)).alias("is_html")
        )

    return pick("pages", "page_id", "html").unionAll(pick("documents", "doc_id", "text"))


@query(
    "text_search",
    rf"""WITH lines AS (
           SELECT doc_id, ordinality - 1 AS line_no, line
           FROM documents, unnest(string_split("text", chr(10))) WITH ORDINALITY AS u(line, ordinality)),
         parts AS (
           SELECT doc_id, line_no, regexp_extract_all(line, '(?i)the|(?s).') AS bits FROM lines),
         hits AS (SELECT doc_id, line_no, len(list_filter(bits, lambda b: len(b) = 3)) AS hits FROM parts)
       SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(hits AS BIGINT) AS hits FROM hits WHERE hits > 0""",
)
def text_search(spark, sf):
    from ..operators.clean import text_search as search

    return search(texts(spark, sf, "documents", "doc_id", "text"), "doc_id", "text", "the")


@query(
    "text_search_segments",
    r"""WITH lines AS (
           SELECT doc_id, ordinality - 1 AS line_no, line
           FROM documents, unnest(string_split("text", chr(10))) WITH ORDINALITY AS u(line, ordinality)),
         cut AS (
           SELECT doc_id, line_no,
                  list_filter(string_split(regexp_replace(line, '(?i)(the)', chr(1)||'\1'||chr(1), 'g'), chr(1)),
                              lambda s: s <> '') AS segs FROM lines)
       SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(ordinality - 1 AS BIGINT) AS seg_no, seg,
              lower(seg) = 'the' AS hit
       FROM cut, unnest(segs) WITH ORDINALITY AS u(seg, ordinality)""",
)
def text_search_segments(spark, sf):
    from ..operators.clean import text_segments

    return text_segments(texts(spark, sf, "documents", "doc_id", "text"), "doc_id", "text", "the")


@query(
    "text_excerpt",
    rf"""WITH p AS (SELECT doc_id, {sql_trim(f'''regexp_replace("text", '{SQL_SPACE}+', ' ', 'g')''')} AS t FROM documents),
         a AS (SELECT doc_id, t, instr(lower(t), 'und') AS k FROM p),
         b AS (SELECT doc_id, t, k, greatest(1, k - 40) AS s, least(length(t), k + 2 + 40) AS e FROM a)
       SELECT doc_id, CASE WHEN k = 0 THEN substr(t, 1, 80)
              ELSE CASE WHEN s > 1 THEN '…' ELSE '' END || substr(t, s, e - s + 1)
                   || CASE WHEN e < length(t) THEN '…' ELSE '' END END AS excerpt
       FROM b""",
)
def text_excerpt(spark, sf):
    return texts(spark, sf, "documents", "doc_id", "text").select("doc_id", text.excerpt(F.col("text"), "und").alias("excerpt"))


@query(
    "chapter_number",
    "SELECT event_id, '第' || CAST(event_id % 9999 + 1 AS VARCHAR) || '章' AS numbered FROM events",
)
def chapter_number(spark, sf):
    """Titles built from the events: the value spelled in Chinese numerals, read back as a number."""
    digits = F.array(*[F.lit(x) for x in "零一二三四五六七八九"])
    n = F.floor(F.pmod(F.col("event_id"), F.lit(9999))) + 1
    words = F.lit("")
    for unit, name in ((1000, "千"), (100, "百"), (10, "十"), (1, "")):
        d = (F.floor(n / unit) % 10).cast("int")
        spelled = F.concat(F.get(digits, d), F.when(d > 0, F.lit(name)).otherwise(""))
        rest = n % (unit * 10) if unit < 1000 else n
        words = F.concat(words, F.when(rest >= unit, spelled).when((words != "") & (n % unit != 0) & (d == 0) & ~words.endswith("零"), F.lit("零")).otherwise(""))
    title = F.concat(F.lit("第"), words, F.lit("章"))
    return (
        table(spark, sf, "events").select("event_id", title.alias("title"))
        .select("event_id", text.chapter_number(F.col("title")).alias("numbered"))
    )


@query(
    "regex_chain",
    r"""SELECT page_id,
               regexp_replace(regexp_replace(html, '(?s)<script\b[^>]*>.*?</script>', '', 'g'),
                              '<a href="([^"]*)">', '[\1] ', 'g') AS cleaned
        FROM pages""",
)
def regex_chain(spark, sf):
    ops = [(r"(?s)<script\b[^>]*>.*?</script>", ""), ("(broken", "x"), ('<a href="([^"]*)">', "[$1] ")]
    return texts(spark, sf, "pages", "page_id", "html").select("page_id", regex.regex_chain(F.col("html"), ops).alias("cleaned"))


@query(
    "regex_only_one",
    r"""SELECT page_id, CASE WHEN regexp_matches(url, '//([^/]+)\.example\.(\w+)/')
               THEN regexp_replace(regexp_extract(url, '//([^/]+)\.example\.(\w+)/'), '//([^/]+)\.example\.(\w+)/', '\2:\1')
               ELSE '' END AS site
        FROM pages""",
)
def regex_only_one(spark, sf):
    site = regex.regex_only_one(F.col("url"), r"//([^/]+)\.example\.(\w+)/", "$2:$1")
    return table(spark, sf, "pages").select("page_id", site.alias("site"))


@query(
    "regex_all_in_one",
    rf"""SELECT page_id, ordinality AS pos, v FROM (
           SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?m)<p>([^<]*)', 1),
                                       lambda x: {sql_trim('x')}), lambda x: x <> '') AS vs FROM pages),
           unnest(vs) WITH ORDINALITY AS u(v, ordinality)""",
)
def regex_all_in_one(spark, sf):
    hits = regex.regex_all_in_one(F.col("html"), "<p>([^<]*)")
    return (
        texts(spark, sf, "pages", "page_id", "html").select("page_id", F.posexplode(hits).alias("pos", "v"))
        .select("page_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "v")
    )


@query(
    "source_replace_regex",
    r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace("text", 'the', '', 'g'),
               '(\w)ing\b', '\1ed', 'g'), '[0-9]{4,}', '', 'g') AS cleaned FROM documents""",
)
def source_replace_regex(spark, sf):
    """Cleaning lines as data: leading ##, pair, trailing ##; a line without ## is no rule."""
    rules = F.lit("##the\n(\\w)ing\\b##$1ed\n[0-9]{4,}##\nnot a rule")
    return texts(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", regex.source_replace_regex(F.col("text"), rules).alias("cleaned")
    )


@query(
    "host_pages",
    rf"""WITH t AS (
           SELECT lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host,
                  {sql_trim("regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)")} AS title,
                  {sql_normalize(sql_flatten('html'))} AS clean
           FROM pages)
         SELECT host, count(*) AS pages, count(DISTINCT title) AS titles,
                CAST(sum(length(clean)) AS BIGINT) AS chars,
                CAST(max(len(string_split(clean, chr(10)))) AS BIGINT) AS most_lines
         FROM t GROUP BY host""",
)
def host_pages(spark, sf):
    from ..functions.urls import host_of

    clean = text.content_text(F.col("html"))
    title = text.web_trim(F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1))
    return (
        texts(spark, sf, "pages", "page_id", "url", "html")
        .select(host_of(F.col("url")).alias("host"), title.alias("title"), clean.alias("clean"))
        .groupBy("host")
        .agg(
            F.count("*").alias("pages"),
            F.countDistinct("title").alias("titles"),
            F.sum(F.length("clean")).alias("chars"),
            F.max(F.size(F.split("clean", "\n"))).cast("bigint").alias("most_lines"),
        )
    )
