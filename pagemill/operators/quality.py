"""Quality reports over surveys, books, contents and rule texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse_space, web_trim

# --- fixed values -----------------------------------------------------------------------------
SLOWEST = 5
MESSAGE_CHARS = 120
TAG_LIKE = "<[a-zA-Z/][^>]{0,120}>"
FILL_FIELDS = ("name", "author", "intro", "kind", "cover_url")
ERROR_CLASSES = [
    (r"请求超时", "timeout"), (r"HTTP 4\d\d", "upstream 4xx"), (r"HTTP 5\d\d", "upstream 5xx"),
    (r"TypeError|cannot read|is not a function", "script"), (r"XPath 执行失败|CSS 选择器无效", "selector"),
    (r"不是合法 JSON", "bad options"), (r"(?i)WebView", "needs a browser"),
]
TOC_FIELDS = ("chapterList", "chapterName", "chapterUrl", "nextTocUrl", "isVip", "isPay", "isVolume", "updateTime")
COOKIE_READS = ("getCookie", "getKey")
COOKIE_WRITES = ("setCookie", "replaceCookie", "removeCookie")
# Constructs counted in a rule corpus.
CONSTRUCTS = {
    "directive": r"(?i)^@(?:css|json|js|xpath):", "script": r"(?i)@js:|<js[\s>]", "template": r"\{\{", "put": r"(?i)@put:",
    "get": r"(?i)@@?get:", "regex chain": r"##", "first match": r"###$", "concat": r"&&", "first of": r"\|\|", "interleave": r"%%",
    "reverse": r"^-(?!\d)", "plus": r"^\+", "exclude": r"[A-Za-z_\])]!-?\d", "bracket index": r"\[-?\d[^\]]*\]", "all in one": r"^:",
    "xpath": r"^\(?/", "json path": r"^\$[.\[]",
}
# ----------------------------------------------------------------------------------------------


def systematic_sample(df: DataFrame, order: list[Column], k: int, n: int) -> DataFrame:
    """Every k-th row in order, at most n: this operator is a sampler.

    Ranks come from a global sort in which only the first k * n rows take part, so one small slice
    is numbered, not the table.
    """
    first = df.orderBy(*order).limit(k * n)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1).where(F.col("rank") % k == 0).drop("rank")


def error_class(error: Column) -> Column:
    out = F.lit("other error")
    for pattern, name in reversed(ERROR_CLASSES):
        out = F.when(error.rlike(pattern), name).otherwise(out)
    return out


def outcome_class(ok: Column, count: Column, error: Column) -> Column:
    return F.when(ok, F.when(count > 0, "has results").otherwise("silent 0")).otherwise(error_class(F.coalesce(error, F.lit(""))))


def with_class(survey: DataFrame) -> DataFrame:
    return survey.withColumn("class", outcome_class(F.col("ok"), F.col("cnt"), F.col("error")))


def outcome_tally(survey: DataFrame) -> DataFrame:
    """class, n, pct, most frequent first."""
    counts = with_class(survey).groupBy("class").agg(F.count("*").alias("n"))
    share = F.col("n") * 100 / F.sum("n").over(Window.partitionBy())  # a dozen rows
    return counts.withColumn("pct", F.round(share, 0).cast("int")).orderBy(F.col("n").desc(), "class")


def field_fill_rate(books: DataFrame) -> DataFrame:
    """field, filled, pct over all books of sources that gave any."""
    total = F.count("*").alias("total")
    counts = [F.count_if(web_trim(F.coalesce(f, F.lit(""))) != "").alias(f) for f in FILL_FIELDS]
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("filled")) for f in FILL_FIELDS])
    out = books.agg(total, *counts).select("total", F.explode(rows).alias("r"))
    return out.select("r.field", "r.filled", F.round(F.col("r.filled") * 100 / F.col("total"), 0).cast("int").alias("pct"))


def slowest_sources(survey: DataFrame, n: int = SLOWEST) -> DataFrame:
    return survey.where("ok").orderBy(F.col("elapsed_ms").desc(), "ord").limit(n)


def error_detail(survey: DataFrame) -> DataFrame:
    failed = with_class(survey.where(~F.col("ok")))
    return failed.select("source_id", "name", "ord", "class", F.substring(collapse_space(F.col("error")), 1, MESSAGE_CHARS).alias("message"))


def residual_tags(df: DataFrame, col: str) -> DataFrame:
    """+ tags (first four different tag-like strings), length, paragraphs of a text column."""
    tags = F.slice(F.array_distinct(F.regexp_extract_all(F.col(col), F.lit(TAG_LIKE), F.lit(0))), 1, 4)
    paragraphs = F.size(F.filter(F.split(col, "\n"), lambda x: web_trim(x) != ""))
    return df.withColumns({"tags": tags, "length": F.length(col), "paragraphs": paragraphs})


def content_class(survey: DataFrame) -> DataFrame:
    """``survey``: content_kind, content, content_error → + class."""
    error = F.col("content_error")
    bad = F.when(error.contains("响应不是 JSON"), "cut off by the platform").when(
        error.contains("未配置正文规则"), "no content rule"
    ).otherwise(error_class(error))
    text = F.coalesce(F.col("content"), F.lit(""))
    kind = (
        F.when(F.coalesce(error, F.lit("")) != "", bad)
        .when(F.coalesce(F.col("content_kind"), F.lit("text")) != "text", F.concat(F.lit("not text: "), "content_kind"))
        .when(text == "", "empty").when(text.rlike(TAG_LIKE), "tags left").otherwise("content")
    )
    return survey.withColumn("class", kind)


def cover_liveness(responses: DataFrame) -> DataFrame:
    """``responses``: proxied, status, content_type → via, ok, bad."""
    ok = F.coalesce((F.col("status") == 200) & F.col("content_type").startswith("image/"), F.lit(False))
    return responses.groupBy(F.when(F.col("proxied"), "proxy").otherwise("direct").alias("via")).agg(
        F.count_if(ok).alias("ok"), F.count_if(~ok).alias("bad")
    )


# --- rule corpus -----------------------------------------------------------------------------------
def _sources(column: str = "source_id") -> Column:
    """Exact distinct count of sources, two-level so that a frequent value spreads over tasks."""
    return F.count_distinct(column).alias("sources")


def rule_corpus_profile(rule_fields: DataFrame) -> DataFrame:
    """construct, rules, sources."""
    hits = F.filter(
        F.array(*[F.when(F.col("rule").rlike(p), F.lit(n)) for n, p in CONSTRUCTS.items()]), lambda x: x.isNotNull()
    )
    rows = rule_fields.select("source_id", F.explode(hits).alias("construct"))
    return rows.groupBy("construct").agg(F.count("*").alias("rules"), _sources())


def toc_field_coverage(rule_fields: DataFrame) -> DataFrame:
    """field, known, sources of the chapter-list group."""
    used = rule_fields.where((F.col("grp") == "ruleToc") & (web_trim(F.col("rule")) != ""))
    return used.groupBy("field").agg(_sources()).select("field", F.col("field").isin(*TOC_FIELDS).alias("known"), "sources")


_PUT = r"(?is)@put:\s*\{([^{}]*)\}"
_GET = r"(?i)@@?get:\s*\{([^{}]*)\}"
_JS_PUT = r"""\bjava\s*\.\s*put\s*\(\s*["']([^"'\\]*)["']"""
_JS_GET = r"""\bjava\s*\.\s*get\s*\(\s*["']([^"'\\]*)["']\s*\)"""


def _bare(key: Column) -> Column:
    return F.regexp_replace(web_trim(key), r"""^["']|["']$""", "")


def variable_uses(rule_fields: DataFrame) -> DataFrame:
    """source_id, grp, key, writes: every variable a rule writes or reads."""
    def found(pattern: str) -> Column:
        return F.regexp_extract_all("rule", F.lit(pattern), F.lit(1))

    puts = F.flatten(F.transform(found(_PUT), lambda b: F.regexp_extract_all(b, F.lit(r"""(?:^|,)\s*["']?([\w$-]+)["']?\s*:"""), F.lit(1))))
    writes = F.transform(F.concat(puts, found(_JS_PUT)), lambda k: F.struct(_bare(k).alias("key"), F.lit(True).alias("writes")))
    reads = F.transform(F.concat(found(_GET), found(_JS_GET)), lambda k: F.struct(_bare(k).alias("key"), F.lit(False).alias("writes")))
    return rule_fields.select("source_id", "grp", F.explode(F.concat(writes, reads)).alias("u")).select(
        "source_id", "grp", "u.key", "u.writes"
    ).where("key <> ''").dropDuplicates()


def cross_group_keys(rule_fields: DataFrame) -> DataFrame:
    """source_id, key, written_in, read_in: variables one group writes and another reads."""
    uses = variable_uses(rule_fields)
    written = uses.where("writes").select("source_id", "key", F.col("grp").alias("written_in"))
    read = uses.where("NOT writes").select("source_id", "key", F.col("grp").alias("read_in"))
    return written.join(read, ["source_id", "key"]).where("written_in <> read_in")


def var_lineage(rule_fields: DataFrame) -> DataFrame:
    """source_id, key, has_put, has_get."""
    return variable_uses(rule_fields).groupBy("source_id", "key").agg(
        F.bool_or("writes").alias("has_put"), F.bool_or(~F.col("writes")).alias("has_get")
    )


def surface_gap(scripts: DataFrame, supported: DataFrame, host: str = "java") -> DataFrame:
    """``scripts``: source_id, text; ``supported``: name → name, uses, sources of helpers used but not supported."""
    calls = F.regexp_extract_all("text", F.lit(rf"\b{host}\.([A-Za-z_$][\w$]*)\s*\("), F.lit(1))
    used = scripts.select("source_id", F.explode(calls).alias("name"))
    return used.join(supported.select("name").dropDuplicates(), "name", "left_anti").groupBy("name").agg(
        F.count("*").alias("uses"), _sources()
    )


def cookie_flag_mismatch(scripts: DataFrame, flags: DataFrame) -> DataFrame:
    """``scripts``: source_id, text; ``flags``: source_id, enabled → enabled, uses, n (crosstab over sources)."""
    reads = F.col("text").rlike(rf"\bcookie\.(?:{'|'.join(COOKIE_READS)})\s*\(")
    writes = F.col("text").rlike(rf"\bcookie\.(?:{'|'.join(COOKIE_WRITES)})\s*\(")
    per_source = scripts.groupBy("source_id").agg(F.bool_or(reads).alias("reads"), F.bool_or(writes).alias("writes"))
    uses = F.when(F.col("writes"), "writes").when(F.col("reads"), "reads only").otherwise("none")
    joined = flags.join(per_source, "source_id", "left")
    return joined.groupBy(F.coalesce("enabled", F.lit(False)).alias("enabled"), uses.alias("uses")).agg(F.count("*").alias("n"))


def location_readers(scripts: DataFrame) -> DataFrame:
    """Sources whose scripts read the Location header."""
    hit = F.col("text").rlike(r"""(?i)headers?\s*\(\s*['"`]\s*location""")
    return scripts.where(hit).select("source_id").dropDuplicates()


def connector_script_use(rule_fields: DataFrame) -> DataFrame:
    """class, n: how rules mix connectors and scripts."""
    rule = F.col("rule")
    joined, tail, block = rule.rlike(r"&&|\|\||%%"), rule.rlike(r"(?i).@js:"), rule.rlike(r"(?i)<js[\s>]")
    kind = (
        F.when(joined & (tail | block), "connector and script").when(tail, "script tail").when(block, "script block")
        .when(rule.rlike("(?i)^@js:"), "script only").when(joined, "connector").otherwise("selector")
    )
    return rule_fields.groupBy(kind.alias("class")).agg(F.count("*").alias("n"))
