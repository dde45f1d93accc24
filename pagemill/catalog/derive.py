"""Domain tables that Spark derives from the given tables, one SQL text for both engines.

The texts use the common subset of both dialects; ``{name}`` stands for a given or derived table and
``EPOCH_MS(x)`` for the epoch milliseconds of a timestamp.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .base import table

GIVEN = frozenset(
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations".split()
)

# What a rule of each kind looks like; one per source and field, picked by key.
RULE_TEXTS = (
    "class.item.0@tag.a@href",
    "@css:div.list > a.title@text",
    "//div[@id=''main'']/a[1]/text()",
    "$.data.list[*].name",
    ":<a href=\"([^\"]*)\">",
    "id.info@tag.p.-1@text##^by ##",
    "class.a b@li!0:1@text||tag.h1@text",
    "tag.dd@a@href&&tag.dt@a@href",
    "-class.chapters@tag.li",
    "+class.rows@li",
    "@put:{bid:tag.a@href}tag.h3@text",
    "https://api.example.com/b/@get:{bid}",
    "{{$.title}}",
    "tag.a@href@js:java.put(''k'', result); java.ajax(result)",
    "<js>java.getString(''tag.p''); cookie.getKey(baseUrl, ''t'')</js>",
    "tag.span.1:3@ownText%%tag.em@text",
    "##(\\d+)##no $1###",
    "$..[?(@.type==''audio'')]",
)


def _rule(seed: str) -> str:
    """A rule text chosen by ``seed``, as a CASE both engines read."""
    texts = [t.replace("{", "{{").replace("}", "}}") for t in RULE_TEXTS]
    cases = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(texts))
    return f"CASE ({seed}) % {len(RULE_TEXTS)} {cases} END"


DERIVED = {
    # One offer of a book by a source; blanks, spacing and case vary as they do between sites.
    "books": """
        SELECT CAST('s' || CAST(s_suppkey AS STRING) AS STRING) AS source_id,
               s_name AS source_name, s_suppkey % 17 <> 0 AS ok,
               s_suppkey * 10000000 + p_partkey AS ord,
               CASE WHEN s_suppkey % 4 = 0 THEN replace(p_name, ' ', '  ')
                    WHEN s_suppkey % 4 = 1 THEN upper(p_name) ELSE p_name END AS name,
               CASE WHEN (p_partkey + s_suppkey) % 5 = 0 THEN ''
                    WHEN s_suppkey % 3 = 0 THEN lower(p_brand) || ' ' ELSE p_brand END AS author,
               CASE WHEN (p_size + s_suppkey) % 3 = 0 THEN '' ELSE p_type END AS kind,
               CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'chapter ' || CAST(p_size AS STRING) END AS last_chapter,
               CASE WHEN p_size % 4 = 0 THEN '' ELSE p_name || ' by ' || p_brand END AS intro,
               CASE WHEN (p_partkey + s_suppkey) % 3 = 0 THEN ''
                    ELSE 'http://img' || CAST(s_suppkey AS STRING) || '.example.com/' || CAST(p_partkey AS STRING) || '.jpg'
               END AS cover_url,
               CASE WHEN (p_partkey + s_suppkey) % 6 = 1 THEN '/media?t=' || CAST(s_suppkey AS STRING) ELSE '' END
                    AS cover_proxy_url,
               'https://s' || CAST(s_suppkey AS STRING) || '.example.com/b/' || CAST(p_partkey AS STRING) AS book_url
        FROM (SELECT DISTINCT l_partkey, l_suppkey FROM {lineitem}) o
        JOIN {part} ON p_partkey = l_partkey JOIN {supplier} ON s_suppkey = l_suppkey""",
    # Source registry; payload is the rule record as JSON text, broken for one source in nine.
    "registry": f"""
        SELECT 'user:https://c' || CAST(c_custkey AS STRING) || '.example.com' AS id,
               c_name AS name,
               'https://c' || CAST(c_custkey AS STRING) || '.example.com' AS url,
               CASE WHEN c_custkey % 7 = 0 THEN ''
                    WHEN c_custkey % 7 = 1 THEN ' ' || c_mktsegment || ',' || n_name
                    WHEN c_custkey % 7 = 2 THEN c_mktsegment || '、top' ELSE c_mktsegment END AS group_name,
               c_acctbal > 0 AS enabled,
               c_custkey % 13 AS sort_order,
               CASE WHEN c_custkey % 9 = 8 THEN '{{{{broken' ELSE
               '{{{{"bookSourceName":"' || c_name || '","bookSourceType":' || CAST(c_custkey % 4 AS STRING)
               || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ',"searchUrl":"/s?q={{{{{{{{key}}}}}}}}"' END
               || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE ',"exploreUrl":"top::/top"' END
               || CASE WHEN c_custkey % 6 = 0 THEN ',"loginUrl":" /login "' ELSE '' END
               || CASE WHEN c_custkey % 10 = 0 THEN ',"enabledCookieJar":true' ELSE '' END
               || ',"ruleSearch":{{{{"bookList":"' || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '.item' END || '"}}}}'
               || ',"ruleExplore":{{{{"bookList":".item"}}}}}}}}' END AS payload,
               CASE WHEN c_custkey % 11 = 0 THEN 'token' ELSE '' END AS login_header,
               CASE WHEN c_custkey % 14 = 0 THEN 'user' ELSE '' END AS login_info,
               CASE WHEN c_custkey % 8 = 0 THEN CAST(0 AS BIGINT) ELSE 1700000000000 + c_custkey % 50 END AS last_ok_at,
               CAST(c_custkey % 9 AS BIGINT) AS fail_streak,
               CAST(1600000000000 AS BIGINT) AS updated_at
        FROM {{customer}} JOIN {{nation}} ON n_nationkey = c_nationkey""",
    # One row per rule text of a source.
    "rule_fields": "\n UNION ALL ".join(
        f"""SELECT 'user:https://c' || CAST(c_custkey AS STRING) || '.example.com' AS source_id,
                   '{grp}' AS grp, '{field}' AS field, {_rule(f'c_custkey * 7 + {i} * 7')} AS rule
            FROM {{customer}} WHERE (c_custkey + {i}) % 3 <> 0"""
        for i, (grp, field) in enumerate(
            [("ruleSearch", "bookList"), ("ruleSearch", "name"), ("ruleBookInfo", "tocUrl"),
             ("ruleToc", "chapterList"), ("ruleToc", "isVip"), ("ruleContent", "content")]
        )
    ),
    # What each search of a source came to.
    "outcomes": """
        SELECT 'user:https://c' || CAST(user_id AS STRING) || '.example.com' AS source_id,
               EPOCH_MS(ts) AS ts, event_id AS seq,
               CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'fail' ELSE 'idle' END AS outcome
        FROM {events}""",
    # Library state.
    "shelf": """
        SELECT 'u:' || CAST(o_custkey AS STRING) AS owner,
               's' || CAST(o_orderkey % 10 AS STRING) || chr(10) || 'https://b.example.com/' || CAST(o_orderkey AS STRING) AS book_key,
               's' || CAST(o_orderkey % 10 AS STRING) AS source_id,
               'https://b.example.com/' || CAST(o_orderkey AS STRING) AS book_url,
               'Order | ' || CAST(o_orderkey AS STRING) AS name,
               CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS author,
               '' AS cover_url,
               EPOCH_MS(o_orderdate) + o_orderkey AS created_at,
               EPOCH_MS(o_orderdate) + o_orderkey AS updated_at
        FROM {orders}""",
    "progress": """
        SELECT 'u:' || CAST(o_custkey AS STRING) AS owner,
               's' || CAST(o_orderkey % 10 AS STRING) || chr(10) || 'https://b.example.com/' || CAST(o_orderkey AS STRING) AS book_key,
               'https://b.example.com/' || CAST(o_orderkey AS STRING) || '/1' AS chapter_url,
               CASE WHEN o_orderkey % 4 = 1 THEN '' ELSE 'chapter ' || CAST(o_orderkey % 50 AS STRING) END AS chapter_name,
               CAST(o_orderkey % 50 AS INT) AS chapter_index, CAST(o_orderkey % 7 AS INT) AS page_index,
               EPOCH_MS(o_orderdate) + 86400000 + o_orderkey AS updated_at
        FROM {orders} WHERE o_orderstatus = 'F'""",
    "bookmarks": """
        SELECT 'u:' || CAST(o_custkey AS STRING) AS owner,
               'b' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING)
                   || '-' || CAST(l_suppkey AS STRING) AS id,
               's' || CAST(o_orderkey % 10 AS STRING) AS source_id,
               'https://b.example.com/' || CAST(o_orderkey + o_orderkey % 2 * 100000000 AS STRING) AS book_url,
               CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE 'chapter ' || CAST(l_linenumber AS STRING) END AS chapter_name,
               l_linenumber AS chapter_index, CAST(l_partkey % 30 AS INT) AS page_index,
               CASE WHEN l_partkey % 2 = 0 THEN CAST(0 AS DOUBLE) ELSE l_discount * 8 END AS percent,
               'a|b ' || l_returnflag || CASE WHEN l_suppkey % 5 = 0 THEN chr(10) || 'next' ELSE '' END AS excerpt,
               CASE WHEN l_suppkey % 4 = 0 THEN 'say "hi", ' || l_linestatus ELSE '' END AS note,
               EPOCH_MS(l_shipdate) + l_orderkey AS created_at
        FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey""",
    "users": """
        SELECT CAST(c_custkey AS BIGINT) AS id, lower(c_name) AS username, c_name AS display_name
        FROM {customer}""",
    "sessions": """
        SELECT 't' || CAST(event_id AS STRING) AS token, user_id, EPOCH_MS(ts) AS created_at,
               EPOCH_MS(ts) + 2592000000 AS expires_at
        FROM {events} WHERE event_type = 'view'""",
    "attempts": """
        SELECT 'user' || CAST(user_id % 5 AS STRING) AS username, EPOCH_MS(ts) AS ts, event_id AS seq,
               event_type = 'purchase' AS ok
        FROM {events}""",
    # A page of a chapter per conversation turn; every fourth turn repeats the address before it.
    "toc_raw": """
        SELECT 's' || CAST(conv_id % 5 AS STRING) AS source_id, 'b' || CAST(conv_id AS STRING) AS book_key,
               CAST(floor(turn / 4) AS INT) AS page_no, CAST(turn AS INT) AS pos,
               CASE WHEN turn % 7 = 6 THEN ' ' ELSE role || ' ' || CAST(turn AS STRING) END AS name,
               CASE WHEN turn % 5 = 4 THEN '' ELSE 'https://t.example.com/' || CAST(conv_id AS STRING) || '/'
                    || CAST(turn - CASE WHEN turn % 4 = 3 THEN 1 ELSE 0 END AS STRING) END AS url,
               CASE WHEN turn % 10 = 4 THEN 'TRUE' WHEN turn % 10 = 9 THEN 'False' ELSE '' END AS is_volume,
               CASE turn % 4 WHEN 0 THEN 'VIP' WHEN 1 THEN '0' WHEN 2 THEN '' ELSE 'false' END AS is_vip,
               CASE turn % 3 WHEN 0 THEN ' 1 ' ELSE '' END AS is_pay,
               CASE turn % 2 WHEN 0 THEN ' 2024-01-0' || CAST(turn % 9 AS STRING) ELSE '  ' END AS update_time
        FROM {conversations}""",
    # Search survey rows: one per event, with error texts of every class.
    "survey": """
        SELECT 'c' || CAST(user_id AS STRING) AS source_id, 'site ' || CAST(user_id AS STRING) AS name,
               event_id AS ord, event_type <> 'error' AS ok,
               CASE WHEN event_type = 'error' OR event_type = 'view' THEN CAST(0 AS BIGINT) ELSE event_id % 9 END AS cnt,
               CASE WHEN event_type <> 'error' THEN '' ELSE CASE event_id % 9
                    WHEN 0 THEN '请求超时（>6000ms）' WHEN 1 THEN '上游返回 HTTP 403：x' WHEN 2 THEN '上游返回 HTTP 502：x'
                    WHEN 3 THEN 'TypeError: x is not a function' WHEN 4 THEN 'CSS 选择器无效，无法解析'
                    WHEN 5 THEN '书源 URL 的请求选项不是合法 JSON' WHEN 6 THEN '需要 webview 嗅探'
                    WHEN 7 THEN '响应不是 JSON' ELSE 'other   failure' END END AS error,
               CAST(floor(value * 100) AS BIGINT) AS elapsed_ms
        FROM {events}""",
}


def _references(sql: str) -> list[str]:
    return re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql)


def sql_text(name: str) -> str:
    """The derived table as a sub-query of the SQL dialect of the checks."""
    sql = DERIVED[name]
    for ref in _references(sql):
        if ref not in GIVEN:
            sql = sql.replace("{" + ref + "}", f"({sql_text(ref)})")
        else:
            sql = sql.replace("{" + ref + "}", ref)
    sql = re.sub(r"EPOCH_MS\((\w+)\)", r"(epoch_us(\1) // 1000)", sql)
    return sql.replace("{{", "{").replace("}}", "}")


def with_tables(body: str, *names: str) -> str:
    """``body`` behind WITH clauses that define the named derived tables."""
    ctes = ", ".join(f"{n} AS ({sql_text(n)})" for n in names)
    rest = body.strip()
    if rest.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {rest[15:]}"
    if rest.upper().startswith("WITH "):
        return f"WITH {ctes}, {rest[5:]}"
    return f"WITH {ctes} {rest}"


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived table as a DataFrame."""
    sql = re.sub(r"EPOCH_MS\((\w+)\)", r"unix_millis(CAST(\1 AS TIMESTAMP))", DERIVED[name])
    frames = {
        ref: table(spark, sf_dir, ref) if ref in GIVEN else derived(spark, sf_dir, ref)
        for ref in set(_references(sql))
    }
    # Spark reads backslashes in string literals as escapes.
    return spark.sql(sql.replace("\\", "\\\\"), **frames)
