"""Library state over orders, lineitem, events and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cache, cookies, library
from ..operators.throttle import login_throttle as throttle
from ..session import stored
from ..sources import backup, exports
from .base import query, table
from .derive import derived, with_tables

NOW = 1_705_500_000_000
KEYS = ["owner", "book_key"]


@query(
    "shelf_list",
    with_tables(
        """SELECT s.owner, s.book_key, s.name, p.chapter_name, p.chapter_index, p.page_index, p.updated_at AS read_at,
                  coalesce(p.updated_at, s.created_at) AS shelf_at
           FROM shelf s LEFT JOIN progress p ON p.owner = s.owner AND p.book_key = s.book_key""",
        "shelf", "progress",
    ),
)
def shelf_list(spark, sf):
    return library.shelf_list(derived(spark, sf, "shelf"), derived(spark, sf, "progress")).select(
        "owner", "book_key", "name", "chapter_name", "chapter_index", "page_index", "read_at", "shelf_at"
    )


@query(
    "continue_reading",
    with_tables(
        """SELECT * FROM (
             SELECT s.owner, s.book_key, CAST(row_number() OVER (PARTITION BY s.owner ORDER BY p.updated_at DESC, s.book_key) AS INT) AS rank
             FROM shelf s JOIN progress p ON p.owner = s.owner AND p.book_key = s.book_key) WHERE rank <= 8""",
        "shelf", "progress",
    ),
)
def continue_reading(spark, sf):
    return library.continue_reading(derived(spark, sf, "shelf"), derived(spark, sf, "progress")).select("owner", "book_key", "rank")


# Incoming state: progress of the open orders and, again and later or earlier, of half the closed ones.
INCOMING = """
    SELECT 'u:' || CAST(o_custkey AS STRING) AS owner,
           's' || CAST(o_orderkey % 10 AS STRING) || chr(10) || 'https://b.example.com/' || CAST(o_orderkey AS STRING) AS book_key,
           '/new' AS chapter_url, o_orderpriority AS chapter_name, CAST(o_orderkey % 90 AS INT) AS chapter_index, 0 AS page_index,
           EPOCH_MS(o_orderdate) + CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 200000000 END + o_orderkey AS updated_at
    FROM {orders} WHERE o_orderkey % 2 = 0 OR o_orderstatus = 'O'"""


def _incoming(spark, sf):
    return spark.sql(
        INCOMING.replace("EPOCH_MS(o_orderdate)", "unix_millis(CAST(o_orderdate AS TIMESTAMP))"), orders=table(spark, sf, "orders")
    )


INCOMING_SQL = INCOMING.replace("{orders}", "orders").replace("EPOCH_MS(o_orderdate)", "(epoch_us(o_orderdate) // 1000)")
MERGE_COLS = ("chapter_url", "chapter_name", "chapter_index", "page_index", "updated_at")


def _merge_sql(take: str) -> str:
    cols = ", ".join(
        f"CASE WHEN i.owner IS NOT NULL AND (p.owner IS NULL OR {take}) THEN i.{c} ELSE p.{c} END AS {c}" for c in MERGE_COLS
    )
    return with_tables(
        f"""WITH inc AS ({INCOMING_SQL})
            SELECT coalesce(p.owner, i.owner) AS owner, coalesce(p.book_key, i.book_key) AS book_key, {cols}
            FROM progress p FULL OUTER JOIN inc i ON i.owner = p.owner AND i.book_key = p.book_key""",
        "progress",
    )


@query("merge_upsert", _merge_sql("true"))
def merge_upsert(spark, sf):
    merged, _ = library.merge_upsert(
        derived(spark, sf, "progress"), _incoming(spark, sf), KEYS, list(MERGE_COLS), [F.col("updated_at")]
    )
    return merged


@query("merge_ignore", _merge_sql("false"))
def merge_ignore(spark, sf):
    merged, _ = library.merge_ignore(derived(spark, sf, "progress"), _incoming(spark, sf), KEYS, [F.col("updated_at")])
    return merged


@query("merge_newest", _merge_sql("i.updated_at > p.updated_at"))
def merge_newest(spark, sf):
    merged, _ = library.merge_newest(derived(spark, sf, "progress"), _incoming(spark, sf), KEYS)
    return merged


@query(
    "merge_report",
    with_tables(
        f"""WITH inc AS ({INCOMING_SQL}),
             j AS (SELECT p.owner AS po, i.updated_at > p.updated_at AS newer FROM inc i LEFT JOIN progress p
                   ON i.owner = p.owner AND i.book_key = p.book_key)
            SELECT 'newest' AS merge, CASE WHEN po IS NULL THEN 'created' WHEN newer THEN 'updated' ELSE 'kept' END AS status, count(*) AS count
            FROM j GROUP BY ALL
            UNION ALL SELECT 'ignore', CASE WHEN po IS NULL THEN 'added' ELSE 'kept' END, count(*) FROM j GROUP BY ALL""",
        "progress",
    ),
)
def merge_report(spark, sf):
    stored, incoming = derived(spark, sf, "progress"), _incoming(spark, sf)
    _, newest = library.merge_newest(stored, incoming, KEYS)
    _, ignored = library.merge_ignore(stored, incoming, KEYS, [F.col("updated_at")])
    return newest.select(F.lit("newest").alias("merge"), "status", "count").unionByName(
        ignored.select(F.lit("ignore").alias("merge"), "status", "count")
    )


@query(
    "delete_cascade",
    with_tables(
        """SELECT 'shelf' AS kind, owner, book_key FROM shelf WHERE book_url NOT IN (SELECT 'https://b.example.com/' || CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_returnflag = 'R')
           UNION ALL
           SELECT 'progress', owner, book_key FROM progress WHERE replace(chapter_url, '/1', '') IS NOT NULL AND regexp_extract(book_key, 'https.*') NOT IN (SELECT 'https://b.example.com/' || CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_returnflag = 'R')""",
        "shelf", "progress",
    ),
)
def delete_cascade(spark, sf):
    returned = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(
        F.concat(F.lit("https://b.example.com/"), "l_orderkey").alias("book_url")
    ).dropDuplicates()
    shelf, progress = derived(spark, sf, "shelf"), derived(spark, sf, "progress")
    gone = shelf.join(returned, "book_url", "left_semi")
    left, read = library.delete_cascade(shelf, progress, gone)
    return left.select(F.lit("shelf").alias("kind"), *KEYS).unionByName(read.select(F.lit("progress").alias("kind"), *KEYS))


# Switch requests: every third order moves, one in seven of them nowhere, some from books not kept.
def _requests(spark, sf):
    o = table(spark, sf, "orders").where("o_orderkey % 3 = 0")
    source = F.concat(F.lit("s"), (F.col("o_orderkey") % 10).cast("string"))
    url = F.concat(F.lit("https://b.example.com/"), F.col("o_orderkey").cast("string"))
    same = F.col("o_orderkey") % 7 == 0
    return o.select(
        F.concat(F.lit("u:"), "o_custkey").alias("owner"), source.alias("from_source_id"),
        F.when(F.col("o_orderkey") % 11 == 0, F.concat(url, F.lit("/gone"))).otherwise(url).alias("from_book_url"),
        F.when(same, source).otherwise("new").alias("to_source_id"),
        F.when(same & (F.col("o_orderkey") % 11 != 0), url).otherwise(F.concat(url, F.lit("/n"))).alias("to_book_url"),
        F.lit("moved").alias("name"), F.col("o_orderpriority").alias("author"), F.lit(None).cast("string").alias("cover_url"),
        F.when(F.col("o_orderkey") % 2 == 0, "/c").alias("chapter_url"), F.lit("c").alias("chapter_name"),
        F.lit(4).alias("chapter_index"), F.lit(None).cast("int").alias("page_index"),
    )


SWITCH = """
    req AS (SELECT 'u:' || CAST(o_custkey AS VARCHAR) AS owner, o_orderkey AS k, o_orderpriority AS author,
              's' || CAST(o_orderkey % 10 AS VARCHAR) || chr(10) || 'https://b.example.com/' || CAST(o_orderkey AS VARCHAR) AS key,
              o_orderkey % 7 = 0 AND o_orderkey % 11 <> 0 AS same, o_orderkey % 11 = 0 AS gone
            FROM orders WHERE o_orderkey % 3 = 0),
    moves AS (SELECT *, 'new' || chr(10) || 'https://b.example.com/' || CAST(k AS VARCHAR) || '/n' AS to_key
              FROM req WHERE NOT same AND NOT gone)"""


@query(
    "switch_source",
    with_tables(
        f"""WITH {SWITCH}
            SELECT owner, book_key, name, author, created_at, updated_at FROM shelf WHERE (owner, book_key) NOT IN (SELECT owner, key FROM moves)
            UNION ALL
            SELECT m.owner, m.to_key, 'moved', m.author, s.created_at, {NOW} FROM moves m JOIN shelf s ON s.owner = m.owner AND s.book_key = m.key""",
        "shelf",
    ),
)
def switch_source(spark, sf):
    shelf, _, _ = library.switch_source(derived(spark, sf, "shelf"), derived(spark, sf, "progress"), _requests(spark, sf), NOW)
    return shelf.select("owner", "book_key", "name", "author", "created_at", "updated_at")


@query(
    "switch_source_progress",
    with_tables(
        f"""WITH {SWITCH}
            SELECT owner, book_key, chapter_index, page_index, updated_at FROM progress WHERE (owner, book_key) NOT IN (SELECT owner, key FROM moves)
            UNION ALL SELECT owner, to_key, 4, 0, {NOW} FROM moves WHERE k % 2 = 0""",
        "progress",
    ),
)
def switch_source_progress(spark, sf):
    _, progress, _ = library.switch_source(derived(spark, sf, "shelf"), derived(spark, sf, "progress"), _requests(spark, sf), NOW)
    return progress.select("owner", "book_key", "chapter_index", "page_index", "updated_at")


@query(
    "switch_source_errors",
    f"WITH {SWITCH.strip()} SELECT owner, CASE WHEN same THEN 'same_target' ELSE 'not_on_shelf' END AS error, count(*) AS n "
    "FROM req WHERE same OR gone GROUP BY ALL",
)
def switch_source_errors(spark, sf):
    _, _, errors = library.switch_source(derived(spark, sf, "shelf"), derived(spark, sf, "progress"), _requests(spark, sf), NOW)
    return errors.groupBy("owner", "error").agg(F.count("*").alias("n"))


# Reading events: one per line of an order, some with positions out of range.
@query(
    "save_progress",
    with_tables(
        """WITH ev AS (SELECT 'u:' || CAST(o_custkey AS VARCHAR) AS owner,
                 's' || CAST(o_orderkey % 10 AS VARCHAR) || chr(10) || 'https://b.example.com/' || CAST(o_orderkey AS VARCHAR) AS book_key,
                 epoch_us(l_shipdate) // 1000 AS ts, l_linenumber * 100000 + l_partkey AS seq, greatest(l_linenumber - 3, 0) AS ci
               FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
             last AS (SELECT owner, book_key, arg_max(ci, ts * 1000000 + seq) AS ci, max(ts) AS ts FROM ev GROUP BY ALL)
           SELECT coalesce(p.owner, l.owner) AS owner, coalesce(p.book_key, l.book_key) AS book_key,
                  CAST(coalesce(l.ci, p.chapter_index) AS INT) AS chapter_index, coalesce(l.ts, p.updated_at) AS updated_at
           FROM progress p FULL OUTER JOIN last l ON l.owner = p.owner AND l.book_key = p.book_key""",
        "progress",
    ),
)
def save_progress(spark, sf):
    _, progress = library.save_progress(derived(spark, sf, "shelf"), derived(spark, sf, "progress"), _reading(spark, sf))
    return progress.select("owner", "book_key", "chapter_index", "updated_at")


def _reading(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select(
        F.concat(F.lit("u:"), "o_custkey").alias("owner"), F.concat(F.lit(" s"), F.col("o_orderkey") % 10).alias("source_id"),
        F.concat(F.lit("https://b.example.com/"), "o_orderkey").alias("book_url"), F.lit("/c").alias("chapter_url"),
        F.lit(None).cast("string").alias("chapter_name"), (F.col("l_linenumber") - 3).alias("chapter_index"),
        F.lit(None).cast("int").alias("page_index"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("ts"),
        (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("seq"),
    )


@query(
    "normalize_marks",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
              CASE WHEN l_suppkey % 10 = 1 THEN 'source_id is over 2048 characters' WHEN l_suppkey % 9 = 0 THEN 'missing chapter_url' END AS error,
              CASE WHEN l_suppkey % 9 = 0 OR l_suppkey % 10 = 1 THEN NULL ELSE repeat(l_returnflag, 120) END AS excerpt,
              CASE WHEN l_suppkey % 9 = 0 OR l_suppkey % 10 = 1 THEN NULL ELSE greatest(0, l_linenumber - 4) END AS chapter_index,
              CASE WHEN l_suppkey % 9 = 0 OR l_suppkey % 10 = 1 THEN NULL ELSE least(1, greatest(0, round(l_discount * 20 - 0.5, 6))) END AS percent
       FROM lineitem""",
)
def normalize_marks(spark, sf):
    marks = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(F.col("l_suppkey") % 10 == 1, F.repeat(F.lit("s"), F.lit(3000))).otherwise(" s ").alias("source_id"), F.lit("b").alias("book_url"),
        F.when(F.col("l_suppkey") % 9 == 0, "　 ").otherwise("/c").alias("chapter_url"), F.lit(None).cast("string").alias("chapter_name"),
        F.concat(F.lit(" "), F.repeat("l_returnflag", F.lit(150))).alias("excerpt"), F.lit("").alias("note"),
        (F.col("l_linenumber") - 4).alias("chapter_index"), F.lit(None).cast("int").alias("page_index"),
        F.round(F.col("l_discount") * 20 - 0.5, 6).alias("percent"),
    )
    good, bad = library.normalize_marks(marks, library.BOOKMARK_REQUIRED, library.BOOKMARK_OPTIONAL)
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return good.select(*keys, F.lit(None).cast("string").alias("error"), "excerpt", "chapter_index", "percent").unionByName(
        bad.select(*keys, "error", F.lit(None).cast("string").alias("excerpt"), F.lit(None).cast("int").alias("chapter_index"),
                   F.lit(None).cast("double").alias("percent"))
    )


def _bookmarks(spark, sf):
    marks = derived(spark, sf, "bookmarks").withColumn("percent", F.least(F.lit(1.0), F.col("percent")))
    return marks.withColumn("percent", F.round("percent", 4))


@query("marks_by_book", with_tables("SELECT owner, id, book_url, chapter_index, page_index, created_at FROM bookmarks", "bookmarks"))
def marks_by_book(spark, sf):
    return library.marks_by_book(_bookmarks(spark, sf)).select("owner", "id", "book_url", "chapter_index", "page_index", "created_at")


REPORT = """
    report AS (
      SELECT b.owner, b.source_id, b.book_url, coalesce(s.name, '') AS book_name, coalesce(s.author, '') AS book_author,
             CASE WHEN chapter_name <> '' THEN chapter_name ELSE '第 ' || CAST(chapter_index + 1 AS VARCHAR) || ' 章' END AS chapter,
             CASE WHEN percent > 0 THEN printf('%.1f%%', round(least(1, percent), 4) * 100)
                  ELSE '第 ' || CAST(page_index + 1 AS VARCHAR) || ' 页' END AS position,
             excerpt, note, chapter_index, page_index, b.created_at
      FROM bookmarks b LEFT JOIN shelf s ON s.owner = b.owner AND s.source_id = b.source_id AND s.book_url = b.book_url)"""


@query("bookmark_report", with_tables(f"WITH {REPORT} SELECT * FROM report", "bookmarks", "shelf"))
def bookmark_report(spark, sf):
    return library.bookmark_report(_bookmarks(spark, sf), derived(spark, sf, "shelf"))


@query(
    "format_position",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
              CASE WHEN l_discount > 0 THEN printf('%.1f%%', l_discount * 100) ELSE '第 ' || CAST(l_linenumber + 1 AS VARCHAR) || ' 页' END AS position,
              CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus ELSE '第 ' || CAST(l_linenumber + 1 AS VARCHAR) || ' 章' END AS chapter
       FROM lineitem""",
)
def format_position(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        library.format_position(F.col("l_linenumber"), F.col("l_discount")).alias("position"),
        library.format_chapter(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linestatus")).otherwise(" "), F.col("l_linenumber")).alias("chapter"),
    )


MD_CELL = "trim(replace(replace(replace({0}, chr(92), chr(92)||chr(92)), '|', chr(92)||'|'), chr(10), '<br>'))"


def _md_sql() -> str:
    cells = " || ' | ' || ".join(MD_CELL.format(c) for c in ("chapter", "position", "excerpt", "note"))
    stamp = "strftime(make_timestamp((created_at + 28800000) * 1000), '%Y-%m-%d %H:%M')"
    return f"""WITH {REPORT},
        h AS (SELECT *, CASE WHEN trim(book_author) = '' THEN book_name ELSE book_name || '（' || book_author || '）' END AS heading,
                     row_number() OVER (PARTITION BY owner ORDER BY source_id, book_url, chapter_index, page_index, created_at) AS rn FROM report),
        b AS (SELECT owner, heading, min(rn) AS first FROM h GROUP BY ALL),
        lines AS (
          SELECT owner, 0 AS a, 0 AS b, 0 AS c, '# 书签清单' AS line FROM b GROUP BY owner
          UNION ALL SELECT owner, 0, 0, 1, '' FROM b GROUP BY owner
          UNION ALL SELECT owner, 0, 0, 2, '- 导出时间：2024-01-17 22:00（UTC+8）' FROM b GROUP BY owner
          UNION ALL SELECT owner, 0, 0, 3, '- 共 ' || CAST(count(*) AS VARCHAR) || ' 条，来自 ' || CAST(count(DISTINCT heading) AS VARCHAR) || ' 本书' FROM h GROUP BY owner
          UNION ALL SELECT owner, first, 0, 0, '' FROM b
          UNION ALL SELECT owner, first, 0, 1, '## ' || heading FROM b
          UNION ALL SELECT owner, first, 0, 2, '' FROM b
          UNION ALL SELECT owner, first, 0, 3, '| 章节 | 位置 | 摘录 | 备注 | 添加时间 |' FROM b
          UNION ALL SELECT owner, first, 0, 4, '| --- | --- | --- | --- | --- |' FROM b
          UNION ALL SELECT h.owner, b.first, 1, rn, '| ' || {cells} || ' | ' || {stamp} || ' |' FROM h JOIN b ON b.owner = h.owner AND b.heading = h.heading)
        SELECT owner, row_number() OVER (PARTITION BY owner ORDER BY a, b, c) - 1 AS line_no, line FROM lines"""


@query("export_bookmarks_md", with_tables(_md_sql(), "bookmarks", "shelf"))
def export_bookmarks_md(spark, sf):
    return exports.export_bookmarks_md(bookmark_report(spark, sf), NOW)


CSV_CELL = """CASE WHEN regexp_matches({0}, '[",\\r\\n]') THEN '"' || replace({0}, '"', '""') || '"' ELSE {0} END"""


@query(
    "export_bookmarks_csv",
    with_tables(
        f"""WITH {REPORT}
            SELECT DISTINCT owner, 0 AS line_no, chr(65279) || '书名,作者,章节,位置,摘录,备注,添加时间' AS line FROM report
            UNION ALL
            SELECT owner, row_number() OVER (PARTITION BY owner ORDER BY source_id, book_url, chapter_index, page_index, created_at),
                   {" || ',' || ".join(CSV_CELL.format(c) for c in ("book_name", "book_author", "chapter", "position", "excerpt", "note"))}
                   || ',' || strftime(make_timestamp((created_at + 28800000) * 1000), '%Y-%m-%d %H:%M')
            FROM report""",
        "bookmarks", "shelf",
    ),
)
def export_bookmarks_csv(spark, sf):
    return exports.export_bookmarks_csv(bookmark_report(spark, sf))


@query(
    "anon_data_count",
    with_tables(
        "SELECT owner, count(*) AS n FROM (SELECT owner FROM shelf UNION ALL SELECT owner FROM progress) GROUP BY owner",
        "shelf", "progress",
    ),
)
def anon_data_count(spark, sf):
    return library.anon_data_count(derived(spark, sf, "shelf"), derived(spark, sf, "progress"))


SESSION_NOW = 1_707_500_000_000


@query(
    "session_lookup",
    with_tables(
        f"""SELECT token, u.id, username, display_name, expires_at FROM sessions s JOIN users u ON u.id = s.user_id
            WHERE expires_at > {SESSION_NOW}""",
        "sessions", "users",
    ),
)
def session_lookup(spark, sf):
    return library.session_lookup(derived(spark, sf, "sessions"), derived(spark, sf, "users"), SESSION_NOW)


@query(
    "session_prune",
    with_tables(
        f"""SELECT token, user_id FROM sessions WHERE expires_at > {SESSION_NOW}
            AND NOT (user_id % 2 = 0 AND token <> (SELECT max(token) FROM sessions x WHERE x.user_id = sessions.user_id))""",
        "sessions",
    ),
)
def session_prune(spark, sf):
    sessions = derived(spark, sf, "sessions")
    changed = sessions.where("user_id % 2 = 0").groupBy("user_id").agg(F.max("token").alias("keep_token"))
    live = library.session_prune(sessions, SESSION_NOW)
    return library.session_revoke_others(live, changed).select("token", "user_id")


# One attempt of every user per round, the way the service meets them.
THROTTLE = with_tables(
    """WITH RECURSIVE a AS (SELECT *, row_number() OVER (PARTITION BY username ORDER BY ts, seq) AS rn FROM attempts),
         r AS (
           SELECT username, rn, ts, seq, CASE WHEN ok THEN 0 ELSE 1 END AS cnt, CASE WHEN ok THEN 0 ELSE ts END AS first,
                  CASE WHEN ok THEN 'ok' ELSE 'failed' END AS decision FROM a WHERE rn = 1
           UNION ALL
           SELECT username, rn, ts, seq, CASE WHEN c >= 10 THEN c WHEN ok THEN 0 ELSE c + 1 END,
                  CASE WHEN c >= 10 THEN first WHEN ok THEN 0 WHEN c = 0 THEN ts ELSE first END,
                  CASE WHEN c >= 10 THEN 'blocked' WHEN ok THEN 'ok' ELSE 'failed' END
           FROM (SELECT a.*, r.first, CASE WHEN a.ts - r.first > 900000 THEN 0 ELSE r.cnt END AS c
                 FROM r JOIN a ON a.username = r.username AND a.rn = r.rn + 1))
       SELECT username, ts, seq, decision FROM r""",
    "attempts",
)


@query("login_throttle", THROTTLE)
def login_throttle(spark, sf):
    return throttle(derived(spark, sf, "attempts"))


# Stored rule documents per customer and writes made on the right or an outdated version.
def _documents(spark, sf):
    c = table(spark, sf, "customer")
    owner = F.concat(F.lit("u:"), "c_custkey").alias("owner")
    stored = c.where("c_custkey % 4 <> 0").select(owner, F.col("c_name").alias("doc"), (F.col("c_custkey") % 3 * NOW).alias("updated_at"))
    requests = c.where("c_custkey % 5 <> 0").select(
        owner, F.col("c_mktsegment").alias("doc"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey") % 3 * NOW).otherwise(0).cast("bigint").alias("base"),
    )
    return stored, requests


DOCUMENTS = f"""
    st AS (SELECT 'u:' || CAST(c_custkey AS VARCHAR) AS owner, c_name AS doc, c_custkey % 3 * {NOW} AS stamp FROM customer WHERE c_custkey % 4 <> 0),
    rq AS (SELECT 'u:' || CAST(c_custkey AS VARCHAR) AS owner, c_mktsegment AS doc,
                  CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 3 * {NOW} ELSE 0 END AS base FROM customer WHERE c_custkey % 5 <> 0)"""


@query(
    "versioned_write",
    f"""WITH {DOCUMENTS.strip()}
        SELECT rq.owner, CASE WHEN coalesce(stamp, 0) = base THEN 'saved' ELSE 'conflict' END AS outcome,
               CASE WHEN coalesce(stamp, 0) = base THEN greatest({NOW}, coalesce(stamp, 0) + 1) ELSE coalesce(stamp, 0) END AS updated_at,
               CASE WHEN coalesce(stamp, 0) <> base THEN st.doc END AS server_doc
        FROM rq LEFT JOIN st ON st.owner = rq.owner""",
)
def versioned_write(spark, sf):
    _, outcomes = library.versioned_write(*_documents(spark, sf), NOW)
    return outcomes


@query(
    "sync_state",
    f"""WITH {DOCUMENTS.strip()}
        SELECT rq.owner, CASE WHEN coalesce(stamp, 0) = 0 THEN 'remote-empty' WHEN stamp = base THEN 'same-version' ELSE 'moved' END AS state
        FROM rq LEFT JOIN st ON st.owner = rq.owner""",
)
def sync_state(spark, sf):
    stored, requests = _documents(spark, sf)
    return library.sync_state(stored, requests.select("owner", "base"))


@query(
    "book_variables",
    """SELECT 'b' || CAST(user_id AS VARCHAR) AS book_key, event_type AS name, arg_max(props, epoch_us(ts)) AS value
       FROM events WHERE event_type <> 'view' GROUP BY ALL""",
)
def book_variables(spark, sf):
    name = F.when(F.col("event_type") == "view", F.repeat(F.lit("x"), F.lit(201))).otherwise(F.col("event_type"))
    writes = table(spark, sf, "events").select(
        F.concat(F.lit("b"), "user_id").alias("book_key"), name.alias("name"), F.col("props").alias("value"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("updated_at"), F.col("event_id").alias("seq"),
    )
    return library.book_variables(writes).select("book_key", "name", "value")


@query(
    "item_var_flush",
    with_tables(
        r"""SELECT source_id || chr(10) || book_url AS book_key, 'bid' AS name, CAST(ord AS VARCHAR) AS value FROM books WHERE kind <> ''
            UNION ALL SELECT source_id || chr(10) || book_url, 'kind', kind FROM books WHERE kind <> ''""",
        "books",
    ),
)
def item_var_flush(spark, sf):
    items = derived(spark, sf, "books").select(
        "source_id", F.when(F.col("kind") != "", F.col("name")).otherwise(" ").alias("name"), "book_url",
        F.create_map(F.lit("bid"), F.col("ord").cast("string"), F.lit("kind"), F.col("kind"), F.lit("none"), F.lit("")).alias("vars"),
    )
    return library.item_var_flush(items)


# --- cookies: every event sets, overwrites or deletes one on one of three hosts -------------------
COOKIES = """
    log AS (SELECT 's' || CAST(user_id % 3 AS VARCHAR) AS source_id, event_id AS seq,
              CASE event_id % 3 WHEN 0 THEN 'a.b.example.com' WHEN 1 THEN 'b.example.com' ELSE 'example.com' END AS host,
              'k' || CAST(user_id % 7 AS VARCHAR) AS name, CAST(event_id AS VARCHAR) AS value,
              event_type IN ('error', 'view') AS deleted FROM events),
    st AS (SELECT source_id, host, name, arg_max(value, seq) AS value, arg_max(deleted, seq) AS deleted, min(seq) AS first_seq
           FROM log GROUP BY ALL)"""


def _set_cookie(spark, sf):
    host = F.when(F.col("event_id") % 3 == 0, "https://A.b.example.com:8080/x").when(F.col("event_id") % 3 == 1, "http://b.example.com").otherwise("example.com")
    tail = F.when(F.col("event_type") == "error", "; Max-Age=0").when(F.col("event_type") == "view", "; Expires=Wed, 01 Jan 2020 00:00:00 GMT").when(
        F.col("event_type") == "click", "; Expires=").otherwise("; Expires=Wed, 01-Jan-2031 00:00:00 GMT; Path=/")
    return table(spark, sf, "events").select(
        F.concat(F.lit("s"), F.col("user_id") % 3).alias("source_id"), F.col("event_id").alias("seq"), host.alias("url"),
        F.concat(F.lit("k"), F.col("user_id") % 7, F.lit("="), "event_id", tail).alias("value"),
    )


@query("cookie_state", f"WITH {COOKIES.strip()} SELECT source_id, host, name, value, first_seq FROM st WHERE NOT deleted")
def cookie_state(spark, sf):
    return cookies.cookie_state(_set_cookie(spark, sf), NOW)


@query(
    "cookie_lookup",
    f"""WITH {COOKIES.strip()},
         u AS (SELECT DISTINCT 's' || CAST(user_id % 3 AS VARCHAR) AS source_id,
                 CASE user_id % 3 WHEN 0 THEN 'https://a.b.example.com/q' WHEN 1 THEN 'https://b.example.com/' ELSE 'https://other.org/' END AS url FROM events),
         c AS (SELECT source_id, url, unnest(CASE WHEN url LIKE '%a.b.%' THEN [(0, 'a.b.example.com'), (1, 'b.example.com'), (2, 'example.com')]
                 WHEN url LIKE '%b.example%' THEN [(0, 'b.example.com'), (1, 'example.com')] ELSE [(0, 'other.org')] END) AS h FROM u),
         m AS (SELECT c.source_id, url, h[1] AS level, name, value, first_seq,
                 row_number() OVER (PARTITION BY c.source_id, url, name ORDER BY h[1]) AS rn
               FROM c JOIN st ON st.source_id = c.source_id AND st.host = h[2] WHERE NOT deleted)
       SELECT u.source_id, u.url, coalesce(string_agg(name || '=' || value, '; ' ORDER BY level, first_seq), '') AS cookie
       FROM u LEFT JOIN m ON m.source_id = u.source_id AND m.url = u.url AND rn = 1 GROUP BY ALL""",
)
def cookie_lookup(spark, sf):
    url = F.when(F.col("user_id") % 3 == 0, "https://a.b.example.com/q").when(F.col("user_id") % 3 == 1, "https://b.example.com/").otherwise("https://other.org/")
    urls = table(spark, sf, "events").select(F.concat(F.lit("s"), F.col("user_id") % 3).alias("source_id"), url.alias("url"))
    return cookies.cookie_lookup(cookies.cookie_state(_set_cookie(spark, sf), NOW), urls)


# --- backups ---------------------------------------------------------------------------------------
def _notes(spark, sf):
    return derived(spark, sf, "bookmarks").where("note <> ''").select(
        "owner", "id", "source_id", "book_url", "chapter_name", "chapter_index", "page_index", F.lit(0.5).alias("percent"), "excerpt",
        F.col("note").alias("text"), "created_at", F.col("created_at").alias("updated_at"),
    ).withColumn("book_key", library.book_key(F.col("source_id"), F.col("book_url")))


def _state(spark, sf):
    marks = _bookmarks(spark, sf).withColumn("chapter_url", F.lit("/c")).withColumn("updated_at", F.col("created_at")).withColumn(
        "book_key", library.book_key(F.col("source_id"), F.col("book_url"))
    )
    return {
        "shelf": derived(spark, sf, "shelf"), "progress": derived(spark, sf, "progress"), "bookmarks": marks, "notes": _notes(spark, sf),
    }


def _documents_of_all(spark, sf):
    return backup.export_backup(**_state(spark, sf), now=NOW)


@query(
    "export_backup",
    with_tables(
        """WITH s AS (SELECT owner, count(*) AS shelf, string_agg(name, ',' ORDER BY created_at, book_key) AS names FROM shelf GROUP BY owner),
             p AS (SELECT owner, count(*) AS progress, arg_max(book_key, updated_at) AS newest FROM progress GROUP BY owner),
             b AS (SELECT owner, count(*) AS bookmarks, count_if(note <> '') AS notes, string_agg(id, ',' ORDER BY created_at, id) AS ids FROM bookmarks GROUP BY owner),
             o AS (SELECT owner FROM shelf UNION SELECT owner FROM bookmarks)
           SELECT o.owner, 0 AS part, CAST(coalesce(shelf, 0) AS INT) AS shelf, CAST(coalesce(progress, 0) AS INT) AS progress,
                  CAST(coalesce(bookmarks, 0) AS INT) AS bookmarks, CAST(coalesce(notes, 0) AS INT) AS notes,
                  names, newest, ids
           FROM o LEFT JOIN s ON s.owner = o.owner LEFT JOIN p ON p.owner = o.owner LEFT JOIN b ON b.owner = o.owner""",
        "shelf", "progress", "bookmarks",
    ),
)
def export_backup(spark, sf):
    """Every document, read back: counts, shelf names and bookmark ids in order, the newest position."""
    schema = (
        "counts struct<shelf:int,progress:int,bookmarks:int,notes:int>, shelf array<struct<name:string>>, "
        "progress array<struct<sourceId:string,bookUrl:string>>, bookmarks array<struct<id:string>>"
    )
    docs = _documents_of_all(spark, sf).withColumn("d", F.from_json("doc", schema))
    last = F.try_element_at("d.progress", F.lit(-1))
    return docs.select(
        "owner", "part", "d.counts.shelf", "d.counts.progress", "d.counts.bookmarks", "d.counts.notes",
        F.when(F.size("d.shelf") > 0, F.array_join("d.shelf.name", ",")).alias("names"),
        library.book_key(last["sourceId"], last["bookUrl"]).alias("newest"),
        F.when(F.size("d.bookmarks") > 0, F.array_join("d.bookmarks.id", ",")).alias("ids"),
    )


# Documents made from customers, faulty in one way or another.
def _faulty(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey") % 8
    book = F.struct(F.lit("s").alias("sourceId"), F.lit("b").alias("bookUrl"), F.col("c_name").alias("name"))
    noname = F.struct(F.lit("s").alias("sourceId"), F.lit(" ").alias("bookUrl"), F.lit(None).cast("string").alias("name"))
    late = F.struct(F.lit("s").alias("sourceId"), F.lit("b").alias("bookUrl"), F.lit("/c").alias("chapterUrl"), F.lit(-1).alias("chapterIndex"))
    shelf = F.when(k == 1, F.to_json(F.array(book, noname))).when(k == 2, '{"a":1}').when(k == 3, '[7]').otherwise(F.to_json(F.array(book)))
    progress = F.when(k == 4, F.to_json(F.array(late))).otherwise("[]")
    kind = F.when(k == 5, "other").otherwise("library-backup")
    version = F.when(k == 6, F.lit(3)).otherwise(F.lit(1))
    doc = F.format_string('{"kind":"%s","version":%d,"shelf":%s,"progress":%s}', kind, version, shelf, progress)
    return c.select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("u:"), "c_custkey").alias("owner"), F.when(k == 7, "[]").otherwise(doc).alias("doc"))


@query(
    "validate_backup",
    """WITH e AS (SELECT c_custkey AS doc_id, unnest(CASE c_custkey % 8
            WHEN 1 THEN [('shelf', 1, 'bookUrl', 'not valid'), ('shelf', 1, 'name', 'not valid')]
            WHEN 2 THEN [('shelf', NULL, NULL, 'not a list')]
            WHEN 3 THEN [('shelf', 0, 'record', 'not valid')] WHEN 4 THEN [('progress', 0, 'chapterIndex', 'not valid')]
            WHEN 5 THEN [(NULL, NULL, NULL, 'not a backup')] WHEN 6 THEN [(NULL, NULL, NULL, 'newer version')]
            WHEN 7 THEN [(NULL, NULL, NULL, 'not an object')] ELSE [] END) AS r FROM customer)
       SELECT doc_id, CAST(r[1] AS VARCHAR) AS list, CAST(r[2] AS INT) AS idx, CAST(r[3] AS VARCHAR) AS field, r[4] AS reason FROM e""",
)
def validate_backup(spark, sf):
    return backup.validate_backup(_faulty(spark, sf).select("doc_id", "doc"))


@query(
    "import_backup",
    with_tables(
        """WITH docs AS (SELECT owner, book_key FROM shelf),
             half AS (SELECT * FROM shelf WHERE CAST(regexp_extract(book_url, '[0-9]+$') AS BIGINT) % 2 = 0),
             hp AS (SELECT owner, book_key, updated_at + CASE WHEN chapter_index % 3 = 0 THEN 5 WHEN chapter_index % 3 = 1 THEN 0 ELSE -5 END AS at,
                           chapter_index FROM progress WHERE chapter_index % 4 <> 0),
             hb AS (SELECT * FROM bookmarks WHERE page_index % 2 = 0)
           SELECT 'shelf' AS list, 'added' AS status, count(*) - (SELECT count(*) FROM half) AS count FROM shelf
           UNION ALL SELECT 'shelf', 'kept', count(*) FROM half
           UNION ALL SELECT 'progress', CASE WHEN h.owner IS NULL THEN 'created' WHEN p.updated_at > h.at THEN 'updated' ELSE 'kept' END, count(*)
             FROM progress p LEFT JOIN hp h ON h.owner = p.owner AND h.book_key = p.book_key GROUP BY ALL
           UNION ALL SELECT 'bookmarks', 'added', count(DISTINCT id) FROM bookmarks WHERE page_index % 2 <> 0
           UNION ALL SELECT 'bookmarks', 'kept', count(*) - (SELECT count(DISTINCT id) FROM bookmarks WHERE page_index % 2 <> 0) FROM bookmarks
           UNION ALL SELECT 'notes', 'added', count(DISTINCT id) FROM bookmarks WHERE note <> ''
           UNION ALL SELECT * FROM (SELECT 'notes', 'kept', count(*) - count(DISTINCT id) AS n FROM bookmarks WHERE note <> '') WHERE n > 0""",
        "shelf", "progress", "bookmarks",
    ),
)
def import_backup(spark, sf):
    """Documents of every owner into a library that has half of it; what was added and kept."""
    state = _state(spark, sf)
    # Documents normally come from storage.
    docs = stored(
        backup.export_backup(**state, now=NOW).select("owner", F.concat_ws("/", "owner", "part").alias("doc_id"), "doc"), "backups"
    )
    shift = F.when(F.col("chapter_index") % 3 == 0, 5).when(F.col("chapter_index") % 3 == 1, 0).otherwise(-5)
    held = {
        "shelf": state["shelf"].where(F.regexp_extract("book_url", "[0-9]+$", 0).cast("bigint") % 2 == 0),
        "progress": state["progress"].where("chapter_index % 4 <> 0").withColumn("updated_at", F.col("updated_at") + shift),
        "bookmarks": state["bookmarks"].where("page_index % 2 = 0"),
        "notes": state["notes"].where("false"),
    }
    _, counts = backup.import_backup(held, docs, NOW)
    return counts


# --- keyed cache: purchases write, errors delete, the other events read -----------------------------
CACHE = """
    e AS (SELECT user_id % 20 AS key, event_id, event_type, epoch_us(ts) // 1000 AS "at", CAST((event_id % 3) * 3600000 AS BIGINT) AS ttl_ms FROM events),
    w AS (SELECT key, "at", event_id AS seq, ttl_ms, CASE WHEN event_type = 'purchase' THEN 'v' || CAST(event_id AS VARCHAR) END AS value,
                 CAST("at" AS HUGEINT) * 1000000000000 + event_id AS place FROM e WHERE event_type IN ('purchase', 'error'))"""


def _cache_log(spark, sf):
    e = table(spark, sf, "events").select(
        (F.col("user_id") % 20).alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"),
        ((F.col("event_id") % 3) * 3_600_000).cast("bigint").alias("ttl_ms"), "event_type",
    )
    writes = e.where(F.col("event_type").isin("purchase", "error")).withColumn(
        "value", F.when(F.col("event_type") == "purchase", F.concat(F.lit("v"), "seq"))
    )
    return writes.drop("event_type"), e.where(~F.col("event_type").isin("purchase", "error")).drop("ttl_ms")


@query(
    "cache_lookup",
    f"""WITH {CACHE.strip()}
        SELECT r.key, r."at", r.event_id AS seq, r.event_type, CASE WHEN w.value IS NOT NULL AND (w.ttl_ms = 0 OR r."at" < w."at" + w.ttl_ms) THEN w.value END AS cached
        FROM (SELECT *, CAST("at" AS HUGEINT) * 1000000000000 + event_id AS place FROM e WHERE event_type NOT IN ('purchase', 'error')) r
        ASOF LEFT JOIN w ON r.key = w.key AND r.place >= w.place""",
)
def cache_lookup(spark, sf):
    writes, reads = _cache_log(spark, sf)
    return cache.cache_lookup(writes, reads)


@query(
    "cache_compact",
    f"""WITH {CACHE.strip()}, n AS (SELECT max("at") AS now FROM e)
        SELECT key, arg_max("at", place) AS "at", max(seq) FILTER (place = top) AS seq, arg_max(ttl_ms, place) AS ttl_ms, max(value) FILTER (place = top) AS value
        FROM (SELECT w.*, max(place) OVER (PARTITION BY key) AS top FROM w), n GROUP BY key, now
        HAVING max(value) FILTER (place = top) IS NOT NULL AND (arg_max(ttl_ms, place) = 0 OR now < arg_max("at", place) + arg_max(ttl_ms, place))""",
)
def cache_compact(spark, sf):
    writes, reads = _cache_log(spark, sf)
    now = writes.select("at").union(reads.select("at")).agg(F.max("at").alias("now"))
    return cache.cache_compact(writes, F.lit(now.first().now)).select("key", "at", "seq", "ttl_ms", "value")
