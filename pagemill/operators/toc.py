"""Chapter lists: page chains, flags, dedupe, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import web_trim
from ..session import cut_lineage
from .skew import positions

# --- fixed values -----------------------------------------------------------------------------
MAX_TOC_PAGES = 20
MAX_CONTENT_PAGES = 10
MAX_EXPLORE_PAGES = 50
MAX_MARKED = 1200
# ----------------------------------------------------------------------------------------------


def toc_flag(c: Column) -> Column:
    """True unless blank, false or 0."""
    return ~F.lower(web_trim(F.coalesce(c, F.lit("")))).isin("", "false", "0")


def toc_time(c: Column) -> Column:
    """Trimmed text, NULL when blank."""
    text = web_trim(F.coalesce(c, F.lit("")))
    return F.when(text != "", text)


def page_chain(links: DataFrame, seeds: DataFrame, cap: int = MAX_TOC_PAGES) -> DataFrame:
    """Pages reached from each seed by following next links: seed, page_no, url.

    ``links``: url (unique), next_url (NULL or '' at the end), one row per captured page.
    ``seeds``: seed, url. A chain stops at a page it has seen, at a page that was not captured, and
    at ``cap`` pages. Hops double every round (1, 2, 4, …), so a cap of 20 takes five joins; a page
    many others point to is the large side of such a join only on its left, which AQE splits.
    """
    captured = links.select("url")
    hop = (
        links.where((F.coalesce("next_url", F.lit("")) != "") & (F.col("next_url") != F.col("url")))
        .select("url", F.col("next_url").alias("to"))
        .join(captured.withColumnRenamed("url", "to"), "to", "left_semi")
    )
    reached = seeds.join(captured, "url", "left_semi").select("seed", F.lit(0).alias("page_no"), "url")
    span = 1
    while span < cap:
        ahead = reached.join(hop, "url").select("seed", (F.col("page_no") + span).alias("page_no"), F.col("to").alias("url"))
        # A page seen before ends the chain, and everything after it repeats: keep first visits.
        reached = cut_lineage(
            reached.unionByName(ahead).where(F.col("page_no") < cap).groupBy("seed", "url").agg(F.min("page_no").alias("page_no"))
        )
        span *= 2
        if span < cap:
            second = hop.select(F.col("url").alias("to"), F.col("to").alias("far"))
            hop = cut_lineage(hop.join(second, "to").select("url", F.col("far").alias("to")))
    return reached.select("seed", "page_no", "url")


def clean_toc(rows: DataFrame) -> DataFrame:
    """``rows``: source_id, book_key, page_no, pos, name, url, is_volume, is_vip, is_pay, update_time.

    Chapters in page order: nameless ones go, those without address go unless they open a volume,
    and of equal addresses the first stays. Adds ``ord``.
    """
    flagged = rows.select(
        "source_id", "book_key", "page_no", "pos", web_trim(F.col("name")).alias("name"), F.coalesce("url", F.lit("")).alias("url"),
        toc_flag(F.col("is_volume")).alias("is_volume"), toc_flag(F.col("is_vip")).alias("is_vip"),
        toc_flag(F.col("is_pay")).alias("is_pay"), toc_time(F.col("update_time")).alias("update_time"),
    ).where((F.col("name") != "") & ((F.col("url") != "") | F.col("is_volume")))
    # Rows without address are never equal: their place makes their key unique.
    own = F.when(F.col("url") == "", F.struct("page_no", "pos"))
    fields = ("name", "is_volume", "is_vip", "is_pay", "update_time")
    first = flagged.withColumn("own", own).groupBy("source_id", "book_key", "url", "own").agg(
        F.min_by(F.struct("page_no", "pos", *fields), F.struct("page_no", "pos")).alias("r")
    ).select("source_id", "book_key", "url", "r.*")
    return positions(first, ["source_id", "book_key"], F.col("page_no"), [F.col("pos")], "ord")


def mark_cap(toc: DataFrame, cap: int = MAX_MARKED) -> tuple[DataFrame, DataFrame]:
    """Marks only on the first ``cap`` chapters of a book; (toc, notes for books that were cut)."""
    marked = F.col("ord") < cap
    out = toc
    for c in ("is_vip", "is_pay", "update_time"):
        out = out.withColumn(c, F.when(marked, F.col(c)))
    cut = toc.groupBy("source_id", "book_key").agg(F.count("*").alias("chapters")).where(F.col("chapters") > cap)
    return out, cut.withColumn("note", F.lit(f"marks only on the first {cap} chapters"))


def stitch_content(parts: DataFrame) -> DataFrame:
    """``parts``: chapter_key, page_no, raw → chapter_key, text: pages in order, blank ones skipped.

    A chapter has at most ten pages, so its text is put together in one row.
    """
    filled = parts.where(web_trim(F.coalesce("raw", F.lit(""))) != "")
    return filled.groupBy("chapter_key").agg(F.expr("listagg(raw, '\n') WITHIN GROUP (ORDER BY page_no)").alias("text"))
