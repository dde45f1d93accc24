"""Cleaning rules, quality reports and rule-corpus reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import hooks
from ..operators import clean, quality
from ..sources import pages as P
from .base import query, table, texts
from .derive import derived, with_tables

# --- replace rules ------------------------------------------------------------------------------
OWN_RULES = [
    (10, "literal", "x", "(the", "[the", True), (11, "flags", "x", "THE##i", "<$&>", True), (12, "off", "x", "a", "", False),
    (13, "empty", "x", "", "y", True), (14, "groups", "x", r"(\w)ing\b", "$1ed", True),
]


def _rules(spark):
    return clean.replace_presets(spark).unionByName(spark.createDataFrame(OWN_RULES, clean.RULE_SCHEMA))


def _sql_rules():
    out = '"text"'
    for _, _, pattern, replacement in clean.PRESETS:
        sql = pattern.replace(r"\u3000", r"\x{3000}")
        out = f"regexp_replace({out}, '(?m){sql}', '{replacement}', 'g')"
    out = f"replace({out}, '(the', '[the')"
    out = rf"regexp_replace({out}, '(?i)(THE)', '<\1>', 'g')"
    return rf"regexp_replace({out}, '(\w)ing\b', '\1ed', 'g')"


@query("replace_apply", f"""SELECT doc_id, {_sql_rules()} AS "text" FROM documents""")
def replace_apply(spark, sf):
    return clean.replace_apply(texts(spark, sf, "documents", "doc_id", "text"), "text", _rules(spark))


def _hits_sql():
    counted = [(i, p[0], f"len(regexp_extract_all(\"text\", '(?m){p[2].replace(chr(92) + 'u3000', chr(92) + 'x{3000}')}'))") for i, p in enumerate(clean.PRESETS)]
    counted += [
        (10, "literal", "(length(\"text\") - length(replace(\"text\", '(the', ''))) // 4"), (11, "flags", "len(regexp_extract_all(\"text\", '(?i)THE'))"),
        (12, "off", "0"), (13, "empty", "0"), (14, "groups", r"""len(regexp_extract_all("text", '(\w)ing\b'))"""),
    ]
    return " UNION ALL ".join(f"SELECT {i} AS ord, '{n}' AS name, CAST(sum({c}) AS BIGINT) AS hits FROM documents" for i, n, c in counted)


@query("replace_hits", _hits_sql())
def replace_hits(spark, sf):
    return clean.replace_hits(texts(spark, sf, "documents", "doc_id", "text"), "text", _rules(spark))


@query("replace_presets", f"""SELECT doc_id, {_sql_rules()} = "text" AS untouched FROM documents""")
def replace_presets(spark, sf):
    """Which documents the ready-made and own rules leave as they are."""
    docs = texts(spark, sf, "documents", "doc_id", "text").withColumn("before", F.col("text"))
    return clean.replace_apply(docs, "text", _rules(spark)).select("doc_id", (F.col("text") == F.col("before")).alias("untouched"))


# Rule documents of customers, some of them faulty.
RULE_DOCS = """
    SELECT 'u:' || CAST(c_custkey AS STRING) AS owner, c_custkey % 6 AS kind,
           CASE c_custkey % 6 WHEN 0 THEN '{{"a":1}}' WHEN 1 THEN '[{{}},7]'
             WHEN 2 THEN '[{{"name":"' || c_name || '","pattern":"' || c_mktsegment || '","enabled":false}},{{"group":"g","pattern":5,"enabled":"false"}}]'
             WHEN 3 THEN '[]' WHEN 4 THEN '[{{"name":"' || repeat('n', 300) || '","replacement":null}}]' ELSE 'no json' END AS doc
    FROM {customer}"""


def _rule_docs(spark, sf):
    return spark.sql(RULE_DOCS, customer=table(spark, sf, "customer")).select("owner", "doc")


VALID_RULES = """
    r AS (SELECT 'u:' || CAST(c_custkey AS VARCHAR) AS owner, unnest(CASE c_custkey % 6
            WHEN 2 THEN [(0, c_name, '默认', c_mktsegment, 'off'), (1, '', 'g', '5', 'on')]
            WHEN 4 THEN [(0, repeat('n', 200), '默认', '', 'on')] ELSE [] END) AS x FROM customer)"""


@query(
    "replace_validate",
    f"""WITH {VALID_RULES.strip()} SELECT owner, CAST(x[1] AS INT) AS ord, x[2] AS name, x[3] AS "group", x[4] AS pattern, x[5] = 'on' AS enabled FROM r""",
)
def replace_validate(spark, sf):
    rules, _ = clean.replace_validate(_rule_docs(spark, sf))
    return rules.select("owner", "ord", "name", "group", "pattern", "enabled")


@query(
    "replace_validate_errors",
    """SELECT 'u:' || CAST(c_custkey AS VARCHAR) AS owner, CASE WHEN c_custkey % 6 = 1 THEN 1 END AS idx,
              CASE WHEN c_custkey % 6 = 1 THEN 'not an object' ELSE 'not a list' END AS reason FROM customer WHERE c_custkey % 6 IN (0, 1, 5)""",
)
def replace_validate_errors(spark, sf):
    _, errors = clean.replace_validate(_rule_docs(spark, sf))
    return errors


@query(
    "replace_summary",
    f"WITH {VALID_RULES.strip()} SELECT owner, count(*) AS total, count_if(x[5] = 'off') AS disabled FROM r GROUP BY owner",
)
def replace_summary(spark, sf):
    rules, _ = clean.replace_validate(_rule_docs(spark, sf))
    return clean.replace_summary(rules)


# --- surveys ------------------------------------------------------------------------------------
CLASS_SQL = """CASE WHEN ok THEN CASE WHEN cnt > 0 THEN 'has results' ELSE 'silent 0' END
    WHEN error LIKE '%请求超时%' THEN 'timeout' WHEN regexp_matches(error, 'HTTP 4\\d\\d') THEN 'upstream 4xx' WHEN regexp_matches(error, 'HTTP 5\\d\\d') THEN 'upstream 5xx'
    WHEN regexp_matches(error, 'TypeError|cannot read|is not a function') THEN 'script' WHEN regexp_matches(error, 'XPath 执行失败|CSS 选择器无效') THEN 'selector'
    WHEN error LIKE '%不是合法 JSON%' THEN 'bad options' WHEN regexp_matches(error, '(?i)webview') THEN 'needs a browser' ELSE 'other error' END"""


@query(
    "systematic_sample",
    with_tables("SELECT source_id, ord FROM (SELECT *, row_number() OVER (ORDER BY elapsed_ms, ord) - 1 AS rk FROM survey) WHERE rk % 13 = 0 AND rk < 780", "survey"),
)
def systematic_sample(spark, sf):
    return quality.systematic_sample(derived(spark, sf, "survey"), [F.col("elapsed_ms"), F.col("ord")], 13, 60).select("source_id", "ord")


@query("outcome_class", with_tables(f"SELECT ord, {CLASS_SQL} AS class FROM survey", "survey"))
def outcome_class(spark, sf):
    return quality.with_class(derived(spark, sf, "survey")).select("ord", "class")


@query(
    "outcome_tally",
    with_tables(f"""SELECT class, count(*) AS n, CAST(round(count(*) * 100.0 / (SELECT count(*) FROM survey)) AS INT) AS pct
                    FROM (SELECT {CLASS_SQL} AS class FROM survey) GROUP BY class""", "survey"),
)
def outcome_tally(spark, sf):
    return quality.outcome_tally(derived(spark, sf, "survey"))


@query(
    "field_fill_rate",
    with_tables(
        " UNION ALL ".join(
            f"SELECT '{f}' AS field, count_if({f} <> '') AS filled, CAST(round(count_if({f} <> '') * 100.0 / count(*)) AS INT) AS pct FROM books"
            for f in quality.FILL_FIELDS
        ),
        "books",
    ),
)
def field_fill_rate(spark, sf):
    return quality.field_fill_rate(derived(spark, sf, "books"))


@query(
    "slowest_sources",
    with_tables("SELECT source_id, name, ord, elapsed_ms, cnt FROM survey WHERE ok ORDER BY elapsed_ms DESC, ord LIMIT 5", "survey"),
)
def slowest_sources(spark, sf):
    return quality.slowest_sources(derived(spark, sf, "survey")).select("source_id", "name", "ord", "elapsed_ms", "cnt")


@query(
    "error_detail",
    with_tables(f"SELECT source_id, name, ord, {CLASS_SQL} AS class, substr(regexp_replace(error, '\\s+', ' ', 'g'), 1, 120) AS message FROM survey WHERE NOT ok", "survey"),
)
def error_detail(spark, sf):
    return quality.error_detail(derived(spark, sf, "survey"))


@query(
    "residual_tags",
    """SELECT page_id, array_to_string(list_transform(range(1, least(5, len(d) + 1)), lambda i: d[i]), ' ') AS tags,
              CAST(length(html) AS INT) AS length, CAST(len(list_filter(string_split(html, chr(10)), lambda x: trim(x) <> '')) AS INT) AS paragraphs
       FROM (SELECT page_id, html, list_reduce(list_prepend([]::VARCHAR[], list_transform(regexp_extract_all(html, '<[a-zA-Z/][^>]{0,120}>'), lambda x: [x])),
                    lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END) AS d FROM pages)""",
)
def residual_tags(spark, sf):
    out = quality.residual_tags(texts(spark, sf, "pages", "page_id", "html"), "html")
    return out.select("page_id", F.array_join("tags", " ").alias("tags"), "length", "paragraphs")


@query(
    "content_class",
    """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'cut off by the platform' WHEN 1 THEN 'no content rule' WHEN 2 THEN 'upstream 4xx'
              WHEN 3 THEN 'not text: images' WHEN 4 THEN 'empty' ELSE CASE WHEN regexp_matches(html, '<[a-zA-Z/][^>]{0,120}>') THEN 'tags left' ELSE 'content' END END AS class FROM pages""",
)
def content_class(spark, sf):
    k = F.col("page_id") % 6
    error = F.when(k == 0, "响应不是 JSON").when(k == 1, "未配置正文规则").when(k == 2, "上游返回 HTTP 404")
    rows = texts(spark, sf, "pages", "page_id", "html").select(
        "page_id", error.alias("content_error"), F.when(k == 3, "images").otherwise("text").alias("content_kind"),
        F.when(k == 4, "").otherwise(F.col("html")).alias("content"),
    )
    return quality.content_class(rows).select("page_id", "class")


@query(
    "cover_liveness",
    """SELECT CASE WHEN user_id % 3 = 0 THEN 'proxy' ELSE 'direct' END AS via, count_if(event_type <> 'error' AND event_type <> 'view') AS ok,
              count_if(event_type = 'error' OR event_type = 'view') AS bad FROM events GROUP BY ALL""",
)
def cover_liveness(spark, sf):
    return quality.cover_liveness(
        table(spark, sf, "events").select(
            (F.col("user_id") % 3 == 0).alias("proxied"), F.when(F.col("event_type") == "error", 404).otherwise(200).alias("status"),
            F.when(F.col("event_type") == "view", F.lit(None)).otherwise("image/png").alias("content_type"),
        )
    )


# --- rule corpus --------------------------------------------------------------------------------
def _fields(spark, sf):
    return derived(spark, sf, "rule_fields")


def _construct_sql(pattern: str) -> str:
    return pattern.replace(r"^-(?!\d)", r"^-[^\d]")


@query(
    "rule_corpus_profile",
    with_tables(
        " UNION ALL ".join(
            f"SELECT '{n}' AS construct, count(*) AS rules, count(DISTINCT source_id) AS sources FROM rule_fields WHERE regexp_matches(rule, '{_construct_sql(p)}') HAVING count(*) > 0"
            for n, p in quality.CONSTRUCTS.items()
        ),
        "rule_fields",
    ),
)
def rule_corpus_profile(spark, sf):
    return quality.rule_corpus_profile(_fields(spark, sf))


@query(
    "toc_field_coverage",
    with_tables(
        """SELECT field, field <> 'isVipX' AS known, count(DISTINCT source_id) AS sources FROM (
             SELECT source_id, CASE WHEN field = 'isVip' AND source_id LIKE '%7.example.com' THEN 'isVipX' ELSE field END AS field FROM rule_fields WHERE grp = 'ruleToc') GROUP BY field""",
        "rule_fields",
    ),
)
def toc_field_coverage(spark, sf):
    odd = (F.col("field") == "isVip") & F.col("source_id").like("%7.example.com")
    return quality.toc_field_coverage(_fields(spark, sf).withColumn("field", F.when(odd, "isVipX").otherwise(F.col("field"))))


USES = """
    u AS (SELECT DISTINCT source_id, grp, CASE WHEN rule LIKE '%java.put%' THEN 'k' ELSE 'bid' END AS key, NOT rule LIKE '%@get:%' AS writes
          FROM rule_fields WHERE rule LIKE '%@put:%' OR rule LIKE '%@get:%' OR rule LIKE '%java.put%')"""


@query(
    "cross_group_keys",
    with_tables(f"WITH {USES.strip()} SELECT w.source_id, w.key, w.grp AS written_in, r.grp AS read_in FROM u w JOIN u r ON w.source_id = r.source_id AND w.key = r.key WHERE w.writes AND NOT r.writes AND w.grp <> r.grp", "rule_fields"),
)
def cross_group_keys(spark, sf):
    return quality.cross_group_keys(_fields(spark, sf))


@query(
    "var_lineage",
    with_tables(f"WITH {USES.strip()} SELECT source_id, key, bool_or(writes) AS has_put, bool_or(NOT writes) AS has_get FROM u GROUP BY ALL", "rule_fields"),
)
def var_lineage(spark, sf):
    return quality.var_lineage(_fields(spark, sf))


def _scripts(spark, sf):
    return _fields(spark, sf).select("source_id", F.col("rule").alias("text"))


@query(
    "surface_gap",
    with_tables(
        """SELECT name, count(*) AS uses, count(DISTINCT source_id) AS sources FROM (
             SELECT source_id, unnest(regexp_extract_all(rule, '\\bjava\\.([A-Za-z_$][\\w$]*)\\s*\\(', 1)) AS name FROM rule_fields)
           WHERE name <> 'put' GROUP BY name""",
        "rule_fields",
    ),
)
def surface_gap(spark, sf):
    return quality.surface_gap(_scripts(spark, sf), spark.createDataFrame([("put",), ("get",)], "name string"))


@query(
    "cookie_flag_mismatch",
    with_tables(
        """WITH s AS (SELECT source_id, bool_or(rule LIKE '%cookie.getKey(%') AS reads FROM rule_fields GROUP BY source_id),
             f AS (SELECT id, CASE WHEN json_valid(payload) THEN coalesce(CAST(json_extract(payload, '$.enabledCookieJar') AS VARCHAR) = 'true', false) ELSE false END AS enabled FROM registry)
           SELECT enabled, CASE WHEN reads THEN 'reads only' ELSE 'none' END AS uses, count(*) AS n FROM f LEFT JOIN s ON s.source_id = f.id GROUP BY ALL""",
        "rule_fields", "registry",
    ),
)
def cookie_flag_mismatch(spark, sf):
    flags = derived(spark, sf, "registry").select(
        F.col("id").alias("source_id"), F.from_json("payload", "enabledCookieJar boolean")["enabledCookieJar"].alias("enabled")
    )
    return quality.cookie_flag_mismatch(_scripts(spark, sf), flags)


@query(
    "location_readers",
    with_tables("SELECT DISTINCT source_id FROM rule_fields WHERE rule LIKE '%java.ajax%' AND grp = 'ruleSearch'", "rule_fields"),
)
def location_readers(spark, sf):
    """Search scripts made to read the header behind their request."""
    asked = F.when(
        F.col("rule").contains("java.ajax") & (F.col("grp") == "ruleSearch"), F.concat("rule", F.lit(".raw().headers('Location')"))
    ).otherwise(F.col("rule"))
    return quality.location_readers(_fields(spark, sf).select("source_id", asked.alias("text")))


@query(
    "connector_script_use",
    with_tables(
        """SELECT CASE WHEN regexp_matches(rule, '&&|\\|\\||%%') AND regexp_matches(rule, '(?i).@js:|<js[\\s>]') THEN 'connector and script'
                  WHEN regexp_matches(rule, '(?i).@js:') THEN 'script tail' WHEN regexp_matches(rule, '(?i)<js[\\s>]') THEN 'script block'
                  WHEN regexp_matches(rule, '&&|\\|\\||%%') THEN 'connector' ELSE 'selector' END AS class, count(*) AS n FROM rule_fields GROUP BY ALL""",
        "rule_fields",
    ),
)
def connector_script_use(spark, sf):
    return quality.connector_script_use(_fields(spark, sf))


# --- captured bodies ----------------------------------------------------------------------------
@query("read_pages", "SELECT page_id, url, CAST(length(html) AS INT) AS chars FROM pages")
def read_pages(spark, sf):
    return P.read_pages(spark, f"{sf}/pages.parquet").select("page_id", "url", F.length("html").alias("chars"))


def _raw(spark, sf):
    """Bodies in five encodings; the label sits in the plan, the header or the page."""
    k = F.col("page_id") % 5
    marked = F.when(k == 3, F.regexp_replace("html", 'charset="utf-8"', 'charset="x-unknown"')).otherwise(F.col("html"))
    plain = F.regexp_replace("html", r"[^\x00-\xff]", "?")
    return texts(spark, sf, "pages", "page_id", "html").select(
        "page_id", F.lit("u").alias("url"),
        F.when(k == 0, F.encode("html", "utf-8")).when(k == 1, F.encode("html", "utf-16LE")).when(k == 2, F.encode(plain, "iso-8859-1")).otherwise(F.encode(marked, "utf-8")).alias("body"),
        F.when(k == 2, "text/html; Charset=ISO-8859-1").alias("content_type"), F.when(k == 1, "'UTF-16LE'").when(k == 4, "auto").alias("declared"),
    )


@query(
    "decode_charset",
    r"""SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'utf-16le' WHEN 2 THEN 'iso-8859-1' WHEN 3 THEN 'x-unknown' ELSE 'utf-8' END AS charset,
               CASE page_id % 5 WHEN 3 THEN replace(html, 'charset="utf-8"', 'charset="x-unknown"')
                 WHEN 2 THEN regexp_replace(html, '[^\x{00}-\x{ff}]', '?', 'g') ELSE html END AS html FROM pages""",
)
def decode_charset(spark, sf):
    return P.decode_charset(_raw(spark, sf)).select("page_id", "charset", "html")


@query(
    "bounded_body",
    """SELECT page_id, CAST(least(octet_length(encode(html)), 1500) AS INT) AS kept FROM pages WHERE page_id % 3 <> 0""",
)
def bounded_body(spark, sf):
    raw = texts(spark, sf, "pages", "page_id", "html").select(
        "page_id", F.encode("html", "utf-8").alias("body"), F.when(F.col("page_id") % 3 == 0, 5000).alias("content_length")
    )
    usable, _ = P.bounded_body(raw, 1500)
    return usable.select("page_id", F.octet_length("body").alias("kept"))


# --- hooks ----------------------------------------------------------------------------------------
@query(
    "rule_hook",
    """SELECT doc_id, CASE WHEN source IS NULL OR doc_id % 3 = 2 THEN array_to_string(w, ' ') WHEN doc_id % 3 = 0 THEN array_to_string(list_reverse(w), ' ')
              ELSE coalesce(w[1], '') END AS words FROM (SELECT doc_id, source, regexp_extract_all("text", '[^\\s]+') AS w FROM documents)""",
)
def rule_hook(spark, sf):
    hooks.register_hook("backwards", lambda values: values[::-1])
    hooks.register_hook("first", lambda values: values[0] if values else None)
    k = F.col("doc_id") % 3
    rows = texts(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", F.regexp_extract_all("text", F.lit(r"[^\s]+"), F.lit(0)).alias("values"), F.when(k == 0, "backwards").when(k == 1, "first").alias("hook")
    )
    return hooks.apply_hooks(rows).select("doc_id", F.array_join("values", " ").alias("words"))
