"""Source registry queries over customers as sources and events as search outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import registry
from ..sources import rules
from .base import query, table
from .derive import derived, with_tables

SUMMARY = """
    parsed AS (SELECT *, CASE WHEN json_valid(payload) THEN payload END AS p FROM registry),
    summary AS (
      SELECT id, name, coalesce(group_name, '') AS "group", enabled, sort_order,
             coalesce(TRY_CAST(json_extract_string(p, '$.bookSourceType') AS INT), 0) AS type,
             coalesce(json_extract_string(p, '$.searchUrl'), '') <> ''
               AND coalesce(json_extract_string(p, '$.ruleSearch.bookList'), '') <> '' AS has_search,
             coalesce(json_extract_string(p, '$.exploreUrl'), '') <> ''
               AND coalesce(json_extract_string(p, '$.ruleExplore.bookList'), '') <> '' AS has_explore,
             trim(coalesce(json_extract_string(p, '$.loginUrl'), '')) <> '' AS has_login,
             login_header <> '' OR login_info <> '' AS logged_in,
             list_filter(list_transform(regexp_split_to_array(group_name, '[,，、]'), lambda x: trim(x)), lambda x: x <> '') AS labels
      FROM parsed),
    facets AS (SELECT *, coalesce(labels[1], '') AS facet FROM summary)"""


def oracle(body: str) -> str:
    return with_tables(f"WITH {SUMMARY} {body}", "registry")


def _registry(spark, sf):
    return derived(spark, sf, "registry")


def _summary(spark, sf):
    return registry.source_summary(_registry(spark, sf))


@query("source_summary", oracle("SELECT * EXCLUDE (labels) FROM summary"))
def source_summary(spark, sf):
    return _summary(spark, sf)


@query(
    "source_filter",
    oracle("""SELECT id, name FROM facets WHERE enabled AND has_search AND facet = 'BUILDING'
              AND (contains(lower(name), '00') OR contains(lower("group"), '00'))"""),
)
def source_filter(spark, sf):
    return registry.source_filter(_summary(spark, sf), " 00 ", "BUILDING", "on", "search").select("id", "name")


@query(
    "split_groups",
    oracle("SELECT id, CAST(ordinality - 1 AS INT) AS pos, label FROM summary, unnest(labels) WITH ORDINALITY AS u(label, ordinality)"),
)
def split_groups(spark, sf):
    return registry.split_groups(_summary(spark, sf))


@query("group_facets", oracle("SELECT facet AS name, count(*) AS count FROM facets GROUP BY facet"))
def group_facets(spark, sf):
    return registry.group_facets(_summary(spark, sf))


@query(
    "group_sources",
    oracle("""SELECT facet, count(*) OVER (PARTITION BY facet) AS facet_size, id, name FROM facets WHERE NOT enabled"""),
)
def group_sources(spark, sf):
    return registry.group_sources(_summary(spark, sf), status="off").select("facet", "facet_size", "id", "name")


@query(
    "source_tally",
    oracle("""SELECT count(*) AS total, count_if(enabled) AS "on", count_if(NOT enabled) AS off, count_if(has_search) AS search,
                     count_if(has_explore) AS explore, count_if(has_login) AS login FROM summary"""),
)
def source_tally(spark, sf):
    return registry.source_tally(_summary(spark, sf))


# Requested ids: customers of orders in order of the orders, many of them repeated.
@query(
    "searchable_ids",
    with_tables(
        f"""WITH {SUMMARY}, wanted AS (
              SELECT 'user:https://c' || CAST(o_custkey AS VARCHAR) || '.example.com' AS id, min(o_orderkey) AS ord
              FROM orders GROUP BY o_custkey)
            SELECT ord, w.id FROM wanted w JOIN summary s ON s.id = w.id WHERE enabled AND has_search""",
        "registry",
    ),
)
def searchable_ids(spark, sf):
    return registry.searchable_ids(_summary(spark, sf), _wanted(spark, sf))


def _wanted(spark, sf):
    return table(spark, sf, "orders").select(
        F.concat(F.lit("user:https://c"), "o_custkey", F.lit(".example.com")).alias("id"), F.col("o_orderkey").alias("ord")
    )


@query(
    "ranked_page",
    with_tables(
        """SELECT id, name, fail_streak, last_ok_at FROM registry WHERE enabled
           ORDER BY fail_streak >= 5, last_ok_at = 0, fail_streak, last_ok_at DESC, sort_order, name LIMIT 40 OFFSET 20""",
        "registry",
    ),
)
def ranked_page(spark, sf):
    return registry.ranked_page(_registry(spark, sf), 20, 40).select("id", "name", "fail_streak", "last_ok_at")


@query(
    "sources_by_ids",
    with_tables(
        """SELECT id, name FROM registry WHERE id IN (
             SELECT 'user:https://c' || CAST(o_custkey AS VARCHAR) || '.example.com' FROM orders)""",
        "registry",
    ),
)
def sources_by_ids(spark, sf):
    return registry.sources_by_ids(_registry(spark, sf), _wanted(spark, sf)).select("id", "name")


@query(
    "source_counts",
    with_tables("SELECT count_if(enabled) AS enabled, count(*) AS total FROM registry", "registry"),
)
def source_counts(spark, sf):
    return registry.source_counts(_registry(spark, sf))


@query(
    "source_health",
    with_tables(
        """WITH w AS (
             SELECT source_id, ts, outcome,
                    count_if(outcome = 'ok') OVER (PARTITION BY source_id ORDER BY ts, seq
                      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ok_to_come
             FROM outcomes WHERE outcome <> 'idle')
           SELECT source_id, coalesce(max(ts) FILTER (outcome = 'ok'), 0) AS last_ok_at,
                  count_if(outcome = 'fail' AND ok_to_come = 0) AS fail_streak
           FROM w GROUP BY source_id""",
        "outcomes",
    ),
)
def source_health(spark, sf):
    return registry.source_health(derived(spark, sf, "outcomes"))


@query(
    "bulk_enable",
    with_tables(
        """WITH ids AS (SELECT DISTINCT 'user:https://c' || CAST(o_custkey AS VARCHAR) || '.example.com' AS id FROM orders WHERE o_orderstatus = 'P')
           SELECT r.id, CASE WHEN i.id IS NULL THEN enabled ELSE false END AS enabled,
                  CASE WHEN i.id IS NULL THEN updated_at ELSE 1800000000000 END AS updated_at
           FROM registry r LEFT JOIN ids i ON i.id = r.id""",
        "registry",
    ),
)
def bulk_enable(spark, sf):
    ids = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(
        F.concat(F.lit("user:https://c"), "o_custkey", F.lit(".example.com")).alias("id")
    )
    state, _ = registry.bulk_enable(_registry(spark, sf), ids, False, 1_800_000_000_000)
    return state.select("id", "enabled", "updated_at")


@query(
    "revision_counter",
    """SELECT n_name AS key, CASE WHEN n_name = 'NATION_7' THEN CAST(n_regionkey + 1 AS VARCHAR) ELSE CAST(n_regionkey AS VARCHAR) END AS value,
              CASE WHEN n_name = 'NATION_7' THEN 1800000000000 ELSE 0 END AS updated_at FROM nation""",
)
def revision_counter(spark, sf):
    settings = table(spark, sf, "nation").select(
        F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"), F.lit(0).cast("bigint").alias("updated_at")
    )
    return registry.revision_counter(settings, "NATION_7", 1_800_000_000_000)


# Explore pages of the registry: categories from nations, books from parts.
CATEGORIES = """
    SELECT 'user:https://c' || CAST(c_custkey AS STRING) || '.example.com' AS source_id, n_nationkey AS ord,
           CASE WHEN n_nationkey % 6 = 5 THEN 'Top ' || n_name ELSE n_name END AS title,
           '/n/' || CAST(n_nationkey AS STRING) AS url
    FROM {customer} JOIN {nation} ON n_regionkey = c_custkey % 5"""
EXPLORED = """
    SELECT 'user:https://c' || CAST(o_custkey AS STRING) || '.example.com' AS source_id,
           '/n/' || CAST(c_custkey % 5 + 5 * (o_orderkey % 5) AS STRING) AS category_url, o_orderkey AS ord,
           'Order ' || CAST(o_orderkey AS STRING) AS name, '/b/' || CAST(o_orderkey AS STRING) AS book_url
    FROM {orders} JOIN {customer} ON c_custkey = o_custkey"""
HOME = f"""
    liked AS (SELECT DISTINCT 'user:https://c' || CAST(o_custkey AS VARCHAR) || '.example.com' AS source_id
              FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey % 50 = 7),
    picked AS (SELECT id AS source_id, name AS source_name FROM summary LEFT JOIN liked ON source_id = id WHERE has_explore
               ORDER BY CASE WHEN source_id IS NULL THEN 1 ELSE 0 END, name, id LIMIT 4),
    cats AS ({CATEGORIES.replace('{', '').replace('}', '')}),
    chosen AS (SELECT source_id, source_name, arg_min(title, rk) AS category, arg_min(url, rk) AS category_url FROM (
               SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY NOT regexp_matches(title, '(?i)top'), ord) AS rk
               FROM cats JOIN picked USING (source_id)) GROUP BY source_id, source_name),
    explored AS ({EXPLORED.replace('{', '').replace('}', '')}),
    sections AS (SELECT * FROM (
               SELECT source_id, source_name, category, category_url,
                      row_number() OVER (PARTITION BY source_id ORDER BY ord) AS rank, name, book_url
               FROM explored JOIN chosen USING (source_id, category_url)) WHERE rank <= 8)"""


def _home(spark, sf):
    tables = {n: table(spark, sf, n) for n in ("customer", "nation", "orders")}
    liked = tables["orders"].where("o_orderpriority = '1-URGENT' AND o_custkey % 50 = 7").select(
        F.concat(F.lit("user:https://c"), "o_custkey", F.lit(".example.com")).alias("source_id")
    )
    categories = spark.sql(CATEGORIES, customer=tables["customer"], nation=tables["nation"])
    explored = spark.sql(EXPLORED, orders=tables["orders"], customer=tables["customer"])
    return registry.home_sections(_registry(spark, sf), categories, explored, liked)


@query("home_sections", with_tables(f"WITH {SUMMARY}, {HOME} SELECT * FROM sections", "registry"))
def home_sections(spark, sf):
    sections, _ = _home(spark, sf)
    return sections


@query(
    "home_feed_sink",
    with_tables(
        f"""WITH {SUMMARY}, {HOME}, n AS (SELECT count(*) AS books, count(DISTINCT source_id) AS sections FROM sections)
            SELECT 'home' AS scope, CAST(sections AS BIGINT) AS sections, CAST(books AS BIGINT) AS books,
                   (SELECT count(*) FROM picked) - sections AS failures, CAST(1700000000000 AS BIGINT) AS built_at FROM n""",
        "registry",
    ),
)
def home_feed_sink(spark, sf):
    """The cached document, read back as counts of what it lists."""
    from ..sources.exports import fresh_feed, home_feed

    feed = fresh_feed(home_feed(*_home(spark, sf), now=1_700_000_000_000), 1_700_001_000_000)
    doc = F.from_json("payload", "sections array<struct<books:array<string>>>, failures array<string>")
    return feed.withColumn("d", doc).select(
        "scope", F.size("d.sections").cast("bigint").alias("sections"),
        F.aggregate("d.sections", F.lit(0), lambda n, s: n + F.size(s["books"])).cast("bigint").alias("books"),
        F.size("d.failures").cast("bigint").alias("failures"), "built_at",
    )


# --- rule records --------------------------------------------------------------------------------
# One document per nation with the records of its customers, some of them unusable.
RECORDS = """
    SELECT c_custkey, c_nationkey, c_custkey % 8 AS kind,
           CASE c_custkey % 8
             WHEN 0 THEN '"text"' WHEN 1 THEN '{{"bookSourceUrl":"https://a.example.com"}}'
             WHEN 2 THEN '{{"bookSourceName":" ","bookSourceUrl":"https://a.example.com"}}'
             WHEN 3 THEN '{{"bookSourceName":"' || c_name || '","bookSourceUrl":"ftp://c' || CAST(c_custkey AS STRING) || '.example.com"}}'
             WHEN 4 THEN '{{"bookSourceName":"' || c_name || '","bookSourceUrl":"no address"}}'
             WHEN 5 THEN '{{"bookSourceName":"' || c_name || '","bookSourceUrl":"https://dup' || CAST(c_nationkey AS STRING) || '.example.com"}}'
             ELSE '{{"bookSourceName":" ' || c_name || '","bookSourceUrl":"https://c' || CAST(c_custkey AS STRING)
                  || '.example.com","bookSourceGroup":"' || c_mktsegment || '","enabled":' || CASE WHEN c_custkey % 16 = 6 THEN 'false' ELSE 'true' END || '}}'
           END AS payload
    FROM {customer}"""
RECORDS_SQL = RECORDS.replace("{customer}", "customer").replace("{{", "{").replace("}}", "}")


def _records(spark, sf):
    rows = spark.sql(RECORDS, customer=table(spark, sf, "customer"))
    listed = F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("payload")), ","), F.lit("]"))
    docs = rows.groupBy("c_nationkey").agg(listed.alias("l")).select(
        "c_nationkey",
        F.when(F.col("c_nationkey") % 2 == 0, F.col("l")).otherwise(F.concat(F.lit('{"sources":'), "l", F.lit("}"))).alias("text"),
    )
    broken = table(spark, sf, "region").select(
        (F.col("r_regionkey") + 1000).alias("c_nationkey"),
        F.when(F.col("r_regionkey") == 0, "[{]").when(F.col("r_regionkey") == 1, "[ ]").otherwise('{"x":[]}').alias("text"),
    )
    return rules.rule_records(docs.unionByName(broken))


@query(
    "read_rules",
    f"""SELECT c_nationkey, count(*) AS records, CAST(sum(length(payload)) AS BIGINT) AS chars, NULL::VARCHAR AS error
        FROM (SELECT c_nationkey, CASE WHEN kind = 0 THEN 'text' ELSE payload END AS payload FROM ({RECORDS_SQL})) GROUP BY c_nationkey
        UNION ALL SELECT r_regionkey + 1000, 1, NULL,
               CASE r_regionkey WHEN 0 THEN 'invalid_json' WHEN 1 THEN 'empty_import' ELSE 'invalid_shape' END FROM region""",
)
def read_rules(spark, sf):
    return _records(spark, sf).groupBy("c_nationkey").agg(
        F.count("*").alias("records"), F.sum(F.length("payload")).alias("chars"), F.max("error").alias("error")
    )


@query(
    "read_rule_dump",
    """SELECT n_nationkey, count(*) AS records FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_nationkey""",
)
def read_rule_dump(spark, sf):
    """The three dump shapes, one per nation, each with a record per customer."""
    payload = F.to_json(F.struct(F.col("c_name").alias("bookSourceName")))
    rows = table(spark, sf, "customer").groupBy("c_nationkey").agg(
        F.array_sort(F.collect_list(payload)).alias("p")
    )
    flat = F.to_json(F.transform("p", lambda x: F.struct(x.alias("payload"))))
    grouped = F.to_json(F.array(F.struct(F.transform("p", lambda x: F.struct(x.alias("payload"))).alias("results"))))
    bare = F.concat(F.lit("note\n["), F.array_join("p", ","), F.lit("]"))
    shape = F.col("c_nationkey") % 3
    docs = rows.select(
        F.col("c_nationkey").alias("n_nationkey"), F.when(shape == 0, flat).when(shape == 1, grouped).otherwise(bare).alias("text")
    )
    return rules.rule_dump_records(docs).groupBy("n_nationkey").agg(F.count("*").alias("records"))


def _validated(spark, sf):
    rows = spark.sql(RECORDS, customer=table(spark, sf, "customer"))
    return rules.validate_rules(rows.select(F.col("c_custkey").alias("ord"), "payload"))


@query(
    "validate_rules",
    f"""SELECT c_custkey AS ord, CASE WHEN kind <= 2 THEN 'row ' || CAST(c_custkey + 1 AS VARCHAR) ELSE 'Customer#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') END AS name,
               CASE kind WHEN 0 THEN 'not an object' WHEN 1 THEN 'bookSourceName is missing' WHEN 2 THEN 'bookSourceName is missing'
                 WHEN 3 THEN 'only http and https, not ftp:' WHEN 4 THEN 'bookSourceUrl is no address: no address' END AS reason
        FROM ({RECORDS_SQL}) WHERE kind <= 4
        UNION ALL SELECT c_custkey, CASE WHEN kind = 5 THEN 'dup' || CAST(c_nationkey AS VARCHAR) ELSE 'c' || CAST(c_custkey AS VARCHAR) END
               || '.example.com', CASE WHEN c_custkey % 16 = 6 THEN 'off' ELSE 'on' END FROM ({RECORDS_SQL}) WHERE kind >= 5""",
)
def validate_rules(spark, sf):
    accepted, rejected = _validated(spark, sf)
    ok = accepted.select(
        "ord", F.regexp_replace("url", "^https://", "").alias("name"), F.when(F.col("enabled"), "on").otherwise("off").alias("reason")
    )
    return rejected.unionByName(ok)


@query(
    "import_rules",
    with_tables(
        f"""WITH acc AS (SELECT c_custkey AS ord, c_custkey, kind, trim(json_extract_string(payload, '$.bookSourceName')) AS name,
                     json_extract_string(payload, '$.bookSourceUrl') AS url,
                     coalesce(json_extract_string(payload, '$.bookSourceGroup'), '') AS group_name,
                     coalesce(json_extract_string(payload, '$.enabled'), 'true') <> 'false' AS enabled, payload
                   FROM ({RECORDS_SQL}) WHERE kind >= 5),
             inc AS (SELECT 'user:' || url AS id, arg_min(name, ord) AS name, arg_min(group_name, ord) AS group_name,
                            arg_min(enabled, ord) AS enabled, arg_min(payload, ord) AS payload, min(ord) AS ord
                     FROM acc GROUP BY url),
             old AS (SELECT * FROM registry WHERE id IN (SELECT 'user:https://c' || CAST(o_custkey AS VARCHAR) || '.example.com' FROM orders))
           SELECT coalesce(o.id, i.id) AS id, coalesce(o.name, i.name) AS name, coalesce(o.group_name, i.group_name) AS group_name,
                  coalesce(o.enabled, i.enabled) AS enabled, CASE WHEN i.id IS NULL THEN o.payload ELSE i.payload END AS payload,
                  CASE WHEN i.id IS NULL THEN o.updated_at ELSE 1800000000000 END AS updated_at
           FROM old o FULL OUTER JOIN inc i ON i.id = o.id""",
        "registry",
    ),
)
def import_rules(spark, sf):
    accepted, _ = _validated(spark, sf)
    known = registry.sources_by_ids(_registry(spark, sf), _wanted(spark, sf)).select(
        "id", "name", "url", "group_name", "enabled", "sort_order", "payload", F.lit(0).cast("bigint").alias("created_at"), "updated_at"
    )
    merged, _, _ = rules.import_rules(known, accepted, 1_800_000_000_000)
    return merged.select("id", "name", "group_name", "enabled", "payload", "updated_at")


@query(
    "rule_fields",
    with_tables(
        """WITH p AS (SELECT id, payload FROM registry WHERE json_valid(payload))
           SELECT id AS source_id, grp, field, rule FROM (
             SELECT id, 'ruleSearch' AS grp, 'bookList' AS field, json_extract_string(payload, '$.ruleSearch.bookList') AS rule FROM p
             UNION ALL SELECT id, 'ruleExplore', 'bookList', json_extract_string(payload, '$.ruleExplore.bookList') FROM p
             UNION ALL SELECT id, '', 'searchUrl', json_extract_string(payload, '$.searchUrl') FROM p
             UNION ALL SELECT id, '', 'exploreUrl', json_extract_string(payload, '$.exploreUrl') FROM p)
           WHERE rule IS NOT NULL""",
        "registry",
    ),
)
def rule_fields(spark, sf):
    return rules.rule_fields(_registry(spark, sf))
