"""Bookmark lists as Markdown and CSV lines, and the front-page feed.

Lists are rows (owner, line_no, line), so a reader with very many bookmarks is written by many
tasks; ``write_lines`` stores one folder per owner.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import csv_cell, format_stamp, markdown_cell
from ..functions.text import web_trim
from ..operators.skew import positions

# --- fixed values -----------------------------------------------------------------------------
MD_TITLE = "# 书签清单"
MD_TABLE_HEAD = "| 章节 | 位置 | 摘录 | 备注 | 添加时间 |"
MD_TABLE_RULE = "| --- | --- | --- | --- | --- |"
CSV_HEADERS = "书名,作者,章节,位置,摘录,备注,添加时间"
FEED_TTL_MS = 30 * 60 * 1000
# ----------------------------------------------------------------------------------------------


def _book_heading() -> Column:
    author = web_trim(F.coalesce("book_author", F.lit("")))
    return F.when(author == "", F.col("book_name")).otherwise(F.concat("book_name", F.lit("（"), author, F.lit("）")))


def _book_starts(rows: DataFrame) -> DataFrame:
    """Per owner, heading and book: n, and ``at``, the line of its first entry; where headings open and documents end.

    A heading may hold several books. One row a book, so an owner's meet in one task.
    """
    books = rows.repartition("owner").withColumn(
        "first", F.min(F.struct("source_id", "book_url", "first")).over(Window.partitionBy("owner", "heading"))
    )
    by_first = Window.partitionBy("owner").orderBy("first", "heading", "source_id", "book_url")
    so_far = by_first.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    books = books.withColumns({
        "opens": (F.row_number().over(by_first) == 1) | ~F.lag("heading").over(by_first).eqNullSafe(F.col("heading")),
        "ends": F.lead(F.lit(True)).over(by_first).isNull(),
        "total": F.sum("n").over(so_far),
    }).withColumn("headings", F.count_if("opens").over(so_far))
    # Four lines open the document, five more each heading.
    return books.withColumn("at", 4 + F.col("headings") * 5 + F.col("total") - F.col("n"))


def _head_lines(starts: DataFrame, at: int) -> DataFrame:
    """What stands above the entries: an owner's last book knows the totals, a heading's first one where it opens."""
    def lines(first: Column, texts: list[Column]) -> Column:
        return F.array(*[F.struct((first + i).cast("bigint").alias("line_no"), t.alias("line")) for i, t in enumerate(texts)])

    opening = lines(F.lit(0), [
        F.lit(MD_TITLE), F.lit(""), F.concat(F.lit("- 导出时间："), format_stamp(F.lit(at)), F.lit("（UTC+8）")),
        F.concat(F.lit("- 共 "), F.col("total").cast("string"), F.lit(" 条，来自 "), F.col("headings").cast("string"), F.lit(" 本书")),
    ])
    titles = lines(
        F.col("at") - 5, [F.lit(""), F.concat(F.lit("## "), "heading"), F.lit(""), F.lit(MD_TABLE_HEAD), F.lit(MD_TABLE_RULE)]
    )
    blocks = F.array(F.when(F.col("ends"), opening), F.when(F.col("opens"), titles))
    return starts.select("owner", F.explode(F.flatten(F.array_compact(blocks))).alias("l")).select("owner", "l.*")


def export_bookmarks_md(report: DataFrame, at: int) -> DataFrame:
    """owner, line_no, line of Markdown tables, one per book heading in first-seen order.

    Rows stay where the report's join on owner, source and address dealt them: counts and positions are
    taken by book, and only one row a book travels on. Rows without an owner or heading have no line.
    """
    rows = report.withColumn("heading", _book_heading())
    texts = ("chapter", "position", "excerpt", "note")
    key = ["owner", "source_id", "book_url", "heading"]
    place = ["chapter_index", "page_index", "created_at"]
    keyed = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in key])

    def counted(part: DataFrame) -> DataFrame:
        # Counting reads the texts as well, so that Spark finds one shuffle for counts and lines, not one of other columns for each.
        has_texts = F.length(F.concat_ws("", *texts)) >= 0
        return part.groupBy(*key).agg(F.count_if(has_texts).alias("n"), F.min(F.struct(*place)).alias("first"))

    def written(placed: DataFrame) -> DataFrame:
        cells = [markdown_cell(F.col(c)) for c in texts]
        return placed.select(
            "owner", (F.col("at") + F.col("pos")).cast("bigint").alias("line_no"),
            F.concat(F.lit("| "), F.concat_ws(" | ", *cells, format_stamp(F.col("created_at"))), F.lit(" |")).alias("line"),
        )

    whole, rest = rows.where(keyed), rows.where(~keyed)
    starts = _book_starts(counted(whole).unionByName(counted(rest)))
    def numbered(part: DataFrame, by: list[str]) -> DataFrame:
        return part.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(*place)) - 1)

    placed = numbered(whole, key).join(starts.where(keyed).select(*key, "at"), key)
    # Books without a source or address are compared as structs, in which NULLs are equal.
    loose_key, book = ["owner", "heading", "book"], F.struct("source_id", "book_url").alias("book")
    named = ~keyed & F.col("owner").isNotNull() & F.col("heading").isNotNull()
    loose = numbered(rest.where(named).select("*", book), loose_key).drop("source_id", "book_url")
    found = loose.join(starts.where(named).select("owner", "heading", book, "at"), loose_key)
    return _head_lines(starts, at).unionByName(written(placed)).unionByName(written(found))


def export_bookmarks_csv(report: DataFrame) -> DataFrame:
    """owner, line_no, line; a file starts with a byte-order mark and its lines end in CR LF."""
    head = report.select("owner").dropDuplicates().select(
        "owner", F.lit(0).cast("bigint").alias("line_no"), F.lit("\ufeff" + CSV_HEADERS).alias("line")
    )
    placed = positions(
        report, ["owner"], F.struct("source_id", "book_url", "chapter_index"), [F.col("page_index"), F.col("created_at")]
    )
    cells = [csv_cell(F.col(c)) for c in ("book_name", "book_author", "chapter", "position", "excerpt", "note")]
    rows = placed.select(
        "owner", (F.col("pos") + 1).alias("line_no"), F.concat_ws(",", *cells, format_stamp(F.col("created_at"))).alias("line")
    )
    return head.unionByName(rows)


def write_lines(lines: DataFrame, path: str, line_sep: str = "\n") -> None:
    """Ordered text files per owner; file names follow line order."""
    ordered = lines.repartitionByRange("owner", "line_no").sortWithinPartitions("owner", "line_no")
    ordered.select("owner", F.col("line").alias("value")).write.mode("overwrite").partitionBy("owner").option(
        "lineSep", line_sep
    ).text(path)


def home_feed(sections: DataFrame, failures: DataFrame, now: int, scope: str = "home") -> DataFrame:
    """scope, payload, built_at: at most four sections of eight books, so one small document."""
    books = F.array_sort(F.collect_list(F.struct("rank", "name", "book_url")))
    lists = sections.groupBy("source_id", "source_name", "category", "category_url").agg(books.alias("books"))
    listed = F.array_sort(F.collect_list(F.struct("source_id", "source_name", "category", "category_url", "books")))
    failed = failures.agg(F.array_sort(F.collect_list(F.struct("source_id", "reason"))).alias("failures"))
    doc = lists.agg(listed.alias("sections")).withColumn("scope", F.lit(scope)).join(
        failed.withColumn("scope", F.lit(scope)), "scope"
    )
    return doc.select(
        "scope", F.to_json(F.struct("sections", "failures")).alias("payload"),
        F.lit(now).cast("bigint").alias("built_at"),
    )


def home_feed_sink(feed: DataFrame, path: str) -> None:
    feed.write.mode("overwrite").partitionBy("scope").json(path)


def fresh_feed(feed: DataFrame, now: int, ttl: int = FEED_TTL_MS) -> DataFrame:
    """Feeds young enough to be served."""
    return feed.where(now - F.col("built_at") <= ttl)
