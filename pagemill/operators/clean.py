"""Text cleaning by user rules, and search inside texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import regex
from ..functions.text import SPACE_CHARS, quote_literal, search_count


def _lines(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_no", "line"))


def text_search(df: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """Lines with hits of a literal, case-insensitive query, and how many each has."""
    hits = _lines(df, key, text).select(
        key, F.col("line_no").cast("bigint").alias("line_no"),
        search_count(F.col("line"), query).cast("bigint").alias("hits"),
    )
    return hits.where("hits > 0")


def text_segments(df: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """Every line cut into hit and non-hit segments, original spelling kept."""
    needle = query.strip(SPACE_CHARS)
    literal = quote_literal(needle) if needle else r"(?!)"
    # A segment is a hit, or the shortest run up to the next hit or the line end.
    pattern = f"(?isu){literal}|.+?(?={literal}|\\z)"
    lines = _lines(df, key, text)
    return lines.select(
        key, F.col("line_no").cast("bigint").alias("line_no"),
        F.posexplode(F.regexp_extract_all("line", F.lit(pattern), F.lit(0))).alias("seg_no", "seg"),
    ).select(
        key, "line_no", F.col("seg_no").cast("bigint").alias("seg_no"), "seg",
        (F.lower("seg") == needle.lower()).alias("hit") if needle else F.lit(False).alias("hit"),
    )


# --- fixed values -----------------------------------------------------------------------------
MAX_RULES = 200
MAX_RULE_LABEL = 200
MAX_RULE_FIELD = 2000
DEFAULT_GROUP = "默认"
PRESETS = [
    ("去掉「本站网址」类推广", "通用", r"(?:本书首发|首发于|更多精彩|请记住本站|最新章节请?访问)[^\n]{0,40}", ""),
    ("去掉网址", "通用", r"https?://[^\s，。、）)】]+", ""),
    ("去掉「手机阅读」提示", "通用", r"(?:手机|移动端)(?:用户)?(?:请)?(?:访问|阅读|打开)[^\n]{0,30}", ""),
    ("去掉广告分隔符行", "通用", r"^[=\-*~_—]{4,}$", ""),
    ("去掉方括号广告", "通用", r"【[^】]{0,20}(?:广告|推广|订阅|微信|公众号)[^】]{0,20}】", ""),
    ("去掉全角空白", "排版", r"[\u3000]+", " "),
    ("去掉空行", "排版", r"\n{2,}", "\n"),
    ("去掉行首缩进空格", "排版", r"^[ \t]+", ""),
]
# ----------------------------------------------------------------------------------------------

RULE_SCHEMA = "ord int, name string, group string, pattern string, replacement string, enabled boolean"


def replace_presets(spark) -> DataFrame:
    """The ready-made rules as a rules table."""
    return spark.createDataFrame([(i, *p, True) for i, p in enumerate(PRESETS)], RULE_SCHEMA)


def compiled_rule(pattern: str, replacement: str) -> tuple[str, str, bool] | None:
    """(pattern, replacement, is_regex) of a rule; None when it has no pattern.

    ``…##flags`` sets flags; global and multi-line are always on. What does not compile is literal.
    """
    if pattern == "":
        return None
    at = pattern.rfind("##")
    flagged = at > 0 and re.fullmatch(r"[gimsuy]*", pattern[at + 2 :]) is not None
    body, flags = (pattern[:at], pattern[at + 2 :]) if flagged else (pattern, "")
    java = "(?m" + ("iu" if "i" in flags else "") + ("s" if "s" in flags else "") + ")"
    java += f"\\G(?:{body})" if "y" in flags else body
    if regex.is_valid_pattern(java):
        return java, regex.java_replacement(replacement), True
    return body, replacement, False


def _rule_rows(rules: DataFrame) -> list:
    """A reader's rules on the driver: at most 200 rows, more is an error."""
    rows = rules.orderBy("ord").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} replace rules")
    return rows


def replace_apply(df: DataFrame, col: str, rules: DataFrame) -> DataFrame:
    """Texts after all enabled rules, in rule order."""
    out: Column = F.coalesce(F.col(col), F.lit(""))
    for rule in _rule_rows(rules):
        compiled = compiled_rule(rule["pattern"], rule["replacement"]) if rule["enabled"] else None
        if compiled is None:
            continue
        pattern, replacement, is_regex = compiled
        out = (
            F.regexp_replace(out, F.lit(pattern), F.lit(replacement)) if is_regex
            else F.replace(out, F.lit(pattern), F.lit(replacement))
        )
    return df.withColumn(col, out)


def replace_hits(df: DataFrame, col: str, rules: DataFrame) -> DataFrame:
    """ord, name, hits of each rule over the texts as they are (one pass, sums combine early)."""
    rows = _rule_rows(rules)
    sums = []
    for rule in rows:
        compiled = compiled_rule(rule["pattern"], rule["replacement"]) if rule["enabled"] else None
        if compiled is None:
            hits = F.lit(0)
        elif compiled[2]:
            hits = F.regexp_count(F.col(col), F.lit(compiled[0]))
        else:
            gone = F.length(col) - F.length(F.replace(F.col(col), F.lit(compiled[0]), F.lit("")))
            hits = F.floor(gone / len(compiled[0]))
        sums.append(F.coalesce(F.sum(hits), F.lit(0)).cast("bigint").alias(f"h{len(sums)}"))
    listed = F.array(*[
        F.struct(F.lit(r["ord"]).alias("ord"), F.lit(r["name"]).alias("name"), F.col(f"h{i}").alias("hits")) for i, r in enumerate(rows)
    ])
    return df.agg(*sums).select(F.explode(listed).alias("r")).select("r.*")


def replace_validate(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs``: owner, doc (JSON text) → (rules with owner, errors[owner, idx, reason]).

    A document is taken whole or not at all.
    """
    v = docs.select("owner", F.try_parse_json("doc").alias("v")).withColumn(
        "items", F.when(F.schema_of_variant("v").startswith("ARRAY"), F.col("v").try_cast("array<variant>"))
    )
    wrong = F.filter(
        F.transform("items", lambda x, i: F.when(~F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False)), i)),
        lambda i: i.isNotNull(),
    )
    checked = v.withColumn("wrong", wrong).withColumn(
        "reason",
        F.when(F.col("items").isNull(), "not a list").when(F.size("items") > MAX_RULES, f"more than {MAX_RULES} rules")
        .when(F.size("wrong") > 0, "not an object"),
    )
    errors = checked.where(F.col("reason").isNotNull()).select("owner", F.get("wrong", F.lit(0)).alias("idx"), "reason")

    def text(name: str, limit: int) -> Column:
        return F.substring(F.coalesce(F.try_variant_get("r", f"$.{name}", "string"), F.lit("")), 1, limit)

    rows = checked.where(F.col("reason").isNull()).select("owner", F.posexplode("items").alias("ord", "r"))
    flag = F.try_variant_get("r", "$.enabled", "variant")
    off = (F.schema_of_variant(flag) == "BOOLEAN") & (F.try_variant_get("r", "$.enabled", "string") == "false")
    group = text("group", MAX_RULE_LABEL)
    return rows.select(
        "owner", "ord", text("name", MAX_RULE_LABEL).alias("name"), F.when(group == "", DEFAULT_GROUP).otherwise(group).alias("group"),
        text("pattern", MAX_RULE_FIELD).alias("pattern"), text("replacement", MAX_RULE_FIELD).alias("replacement"),
        (~F.coalesce(off, F.lit(False))).alias("enabled"),
    ), errors


def replace_summary(rules: DataFrame) -> DataFrame:
    """owner, total, disabled."""
    return rules.groupBy("owner").agg(F.count("*").alias("total"), F.count_if(~F.col("enabled")).alias("disabled"))
