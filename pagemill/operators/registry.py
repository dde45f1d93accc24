"""Queries over the source registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lists import group_labels, primary_group
from ..functions.text import web_trim
from ..session import broadcast_if_small

# --- fixed values -----------------------------------------------------------------------------
BUILTIN_PREFIX = "builtin:"
SINK_STREAK = 5  # so many failures in a row put a source behind all others
HOME_SOURCES = 4
HOME_BOOKS = 8
PREFERRED_CATEGORY = "(?i)推荐|热门|排行|最新|完结|精选|榜单|必看|top"
# ----------------------------------------------------------------------------------------------

PAYLOAD = (
    "bookSourceType string, searchUrl string, exploreUrl string, loginUrl string, enabledCookieJar boolean, "
    "ruleSearch struct<bookList:string>, ruleExplore struct<bookList:string>"
)


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def source_summary(sources: DataFrame) -> DataFrame:
    """List view: what a source can do, from one parse of its record; a broken record can nothing."""
    parsed = sources.withColumn("p", F.from_json("payload", PAYLOAD))
    login = web_trim(F.coalesce(F.col("p.loginUrl"), F.lit(""))) != ""
    return parsed.select(
        "id", "name", F.coalesce("group_name", F.lit("")).alias("group"), "enabled", "sort_order",
        F.coalesce(F.col("p.bookSourceType").try_cast("int"), F.lit(0)).alias("type"),
        (_filled("p.searchUrl") & _filled("p.ruleSearch.bookList")).alias("has_search"),
        (_filled("p.exploreUrl") & _filled("p.ruleExplore.bookList")).alias("has_explore"),
        login.alias("has_login"),
        (_filled("login_header") | _filled("login_info")).alias("logged_in"),
    )


def source_filter(
    summary: DataFrame, keyword: str = "", group: str | None = None, status: str = "all", ability: str = "all"
) -> DataFrame:
    """All conditions given must hold; ``group`` compares with the primary group, '' is ungrouped."""
    out = summary
    if status in ("on", "off"):
        on = F.coalesce(F.col("enabled"), F.lit(False))
        out = out.where(on if status == "on" else ~on)
    if ability in ("search", "explore", "login"):
        out = out.where(F.col(f"has_{ability}"))
    if group is not None:
        out = out.where(primary_group(F.col("group")) == group)
    needle = keyword.strip().lower()
    if needle:
        out = out.where(F.lower("name").contains(needle) | F.lower("group").contains(needle))
    return out


def split_groups(summary: DataFrame) -> DataFrame:
    return summary.select("id", F.posexplode(group_labels(F.col("group"))).alias("pos", "label"))


def group_facets(summary: DataFrame) -> DataFrame:
    """Sources per primary group: the ungrouped last, then by count, then by name in Chinese order."""
    counts = summary.groupBy(primary_group(F.col("group")).alias("name")).agg(F.count("*").alias("count"))
    return counts.orderBy(F.col("name") == "", F.col("count").desc(), F.collate("name", "zh"))


def group_sources(summary: DataFrame, **conditions) -> DataFrame:
    """Matching sources with the facet they are listed under, in listing order."""
    hits = source_filter(summary, **conditions).withColumn("facet", primary_group(F.col("group")))
    sizes = hits.groupBy("facet").agg(F.count("*").alias("facet_size"))
    return hits.join(broadcast_if_small(sizes), "facet").orderBy(
        F.col("facet") == "", F.col("facet_size").desc(), F.collate("facet", "zh"), "sort_order", "name"
    )


def source_tally(summary: DataFrame) -> DataFrame:
    on = F.coalesce(F.col("enabled"), F.lit(False))
    return summary.agg(
        F.count("*").alias("total"), F.count_if(on).alias("on"), F.count_if(~on).alias("off"),
        F.count_if("has_search").alias("search"), F.count_if("has_explore").alias("explore"),
        F.count_if("has_login").alias("login"),
    )


def searchable(summary: DataFrame) -> DataFrame:
    return summary.where(F.coalesce(F.col("enabled"), F.lit(True)) & F.col("has_search"))


def searchable_ids(summary: DataFrame, wanted: DataFrame) -> DataFrame:
    """Requested ids that can be searched, distinct, in request order. ``wanted``: ord, id."""
    asked = wanted.groupBy("id").agg(F.min("ord").alias("ord"))
    return asked.join(searchable(summary).select("id"), "id", "left_semi").select("ord", "id")


def health_order() -> list[Column]:
    return [
        F.col("fail_streak") >= SINK_STREAK, F.col("last_ok_at") == 0, F.col("fail_streak"),
        F.col("last_ok_at").desc(), F.col("sort_order"), F.col("name"),
    ]


def ranked_page(sources: DataFrame, offset: int, limit: int) -> DataFrame:
    """One page of the enabled sources, healthy ones first."""
    return sources.where("enabled").orderBy(*health_order()).offset(offset).limit(limit)


def sources_by_ids(sources: DataFrame, ids: DataFrame) -> DataFrame:
    return sources.join(broadcast_if_small(ids.select("id").dropDuplicates()), "id", "left_semi")


def source_counts(sources: DataFrame) -> DataFrame:
    return sources.agg(F.count_if("enabled").alias("enabled"), F.count("*").alias("total"))


def source_health(outcomes: DataFrame) -> DataFrame:
    """``outcomes``: source_id, ts, seq, outcome → source_id, last_ok_at, fail_streak.

    The streak is the failures after the last success, so no order has to be walked: both levels
    are plain counts that combine before their shuffle.
    """
    real = outcomes.where(
        F.col("outcome").isin("ok", "fail") & ~F.col("source_id").startswith(BUILTIN_PREFIX)
    ).select("source_id", "ts", "seq", "outcome")
    ok = F.col("outcome") == "ok"
    last = real.groupBy("source_id").agg(
        F.max(F.when(ok, F.struct("ts", "seq"))).alias("last_ok"), F.coalesce(F.max(F.when(ok, F.col("ts"))), F.lit(0)).alias("last_ok_at")
    )
    at = F.struct("ts", "seq")
    fails = real.where(~ok).join(last.select("source_id", "last_ok"), "source_id").where(
        F.col("last_ok").isNull() | (at > F.col("last_ok"))
    )
    streaks = fails.groupBy("source_id").agg(F.count("*").alias("fail_streak"))
    return last.join(streaks, "source_id", "left").select(
        "source_id", "last_ok_at", F.coalesce("fail_streak", F.lit(0)).alias("fail_streak")
    )


def bulk_enable(sources: DataFrame, ids: DataFrame, enabled: bool, now: int) -> tuple[DataFrame, DataFrame]:
    """Set the flag of the listed sources; built-in ones cannot be changed. Also the number changed."""
    usable = ids.select("id").where((F.col("id") != "") & ~F.col("id").startswith(BUILTIN_PREFIX)).dropDuplicates()
    joined = sources.join(broadcast_if_small(usable.withColumn("hit", F.lit(True))), "id", "left")
    hit = F.coalesce(F.col("hit"), F.lit(False))
    state = joined.withColumn("enabled", F.when(hit, F.lit(enabled)).otherwise(F.col("enabled"))).withColumn(
        "updated_at", F.when(hit, F.lit(now).cast("bigint")).otherwise(F.col("updated_at"))
    )
    return state.drop("hit"), joined.agg(F.count_if(hit).alias("changed"))


def revision_counter(settings: DataFrame, key: str, now: int) -> DataFrame:
    """Settings (key, value, updated_at) with the counter one up; a missing counter starts at 1."""
    bumped = settings.where(F.col("key") == key).agg(
        (F.coalesce(F.max(F.col("value").try_cast("bigint")), F.lit(0)) + 1).cast("string").alias("value")
    )
    return settings.where(F.col("key") != key).unionByName(
        bumped.select(F.lit(key).alias("key"), "value", F.lit(now).cast("bigint").alias("updated_at"))
    )


def home_sections(
    sources: DataFrame, categories: DataFrame, books: DataFrame, preferred: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Front page: the first sources that can be explored, one category each, its first books.

    ``categories``: source_id, ord, title, url. ``books``: source_id, category_url, ord, name, book_url.
    ``preferred``: source_id of shelves, listed first. Returns (sections, failures).
    """
    summary = source_summary(sources).where("has_explore").select("id", "name")
    liked = preferred.select(F.col("source_id").alias("id")).dropDuplicates().withColumn("liked", F.lit(0))
    picked = (
        summary.join(liked, "id", "left")
        .orderBy(F.coalesce("liked", F.lit(1)), F.collate("name", "zh"), "id")
        .limit(HOME_SOURCES)
        .select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    )
    # At most HOME_SOURCES rows from here on.
    chosen = (
        categories.join(F.broadcast(picked), "source_id")
        .groupBy("source_id", "source_name")
        .agg(F.min_by(F.struct("title", "url"), F.struct(~F.col("title").rlike(PREFERRED_CATEGORY), F.col("ord"))).alias("c"))
        .select("source_id", "source_name", F.col("c.title").alias("category"), F.col("c.url").alias("category_url"))
    )
    first = Window.partitionBy("source_id").orderBy("ord")
    sections = (
        books.join(F.broadcast(chosen), ["source_id", "category_url"])
        .withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= HOME_BOOKS)
        .select("source_id", "source_name", "category", "category_url", "rank", "name", "book_url")
    )
    failures = picked.join(sections.select("source_id").dropDuplicates(), "source_id", "left_anti").select(
        "source_id", "source_name", F.lit("no books on the explore page").alias("reason")
    )
    return sections, failures
