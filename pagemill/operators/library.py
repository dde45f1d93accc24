"""Library state as merge jobs over all owners at once; the owner is part of every key.

Keys are unique in state tables, so these joins spread evenly however many rows an owner has.
Reports count what happened per status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import web_trim
from .skew import keep_first, keep_last

# --- fixed values -----------------------------------------------------------------------------
CONTINUE_READING = 8
MAX_URL = 2048
MAX_CHAPTER_NAME = 200
MAX_BOOKMARK_EXCERPT = 120
MAX_BOOKMARK_NOTE = 500
MAX_NOTE_EXCERPT = 200
MAX_NOTE_TEXT = 5000
MAX_VARIABLE_NAME = 200
MAX_VARIABLE_VALUE = 8192
# ----------------------------------------------------------------------------------------------


def book_key(source_id: Column, book_url: Column) -> Column:
    return F.concat(source_id, F.lit("\n"), book_url)


def report(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count("*").alias("count"))


def _merge(target: DataFrame, incoming: DataFrame, keys: list[str], updated: list[str], take: Column) -> DataFrame:
    """Full outer join of unique keys: update columns from incoming rows where ``take`` holds."""
    t = target.select(*keys, F.struct(*[c for c in target.columns if c not in keys]).alias("t"))
    i = incoming.select(*keys, F.struct(*[c for c in incoming.columns if c not in keys]).alias("i"))
    joined = t.join(i, keys, "full_outer")
    both = F.col("t").isNotNull() & F.col("i").isNotNull()
    status = F.when(F.col("i").isNull(), "stored").when(F.col("t").isNull(), "created").when(take, "updated").otherwise("kept")
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.col(c))
        elif c not in incoming.columns:
            out.append(F.col(f"t.{c}").alias(c))
        elif c in updated:
            out.append(F.when(both & ~take, F.col(f"t.{c}")).when(F.col("i").isNotNull(), F.col(f"i.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
        else:
            out.append(F.when(F.col("t").isNotNull(), F.col(f"t.{c}")).otherwise(F.col(f"i.{c}")).alias(c))
    return joined.select(*out, status.alias("status"))


def merge_upsert(
    target: DataFrame, incoming: DataFrame, keys: list[str], cols: list[str], order: list[Column]
) -> tuple[DataFrame, DataFrame]:
    """Insert, or update ``cols`` of what is stored (other columns, such as created_at, stay)."""
    merged = _merge(target, keep_last(incoming, keys, order), keys, cols, F.lit(True))
    return merged.drop("status"), report(merged.where("status <> 'stored'"))


def merge_ignore(
    target: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]
) -> tuple[DataFrame, DataFrame]:
    """Insert only what is not stored yet; the first of several incoming rows counts, the rest is kept out."""
    firsts = keep_first(incoming, keys, order)
    fresh = firsts.join(target.select(*keys), keys, "left_anti").select(*target.columns)
    sizes = incoming.groupBy(*keys).agg(F.count("*").alias("n"))
    known = sizes.join(target.select(*keys, F.lit(True).alias("stored")), keys, "left")
    totals = known.agg(F.count_if(F.col("stored").isNull()).alias("added"), F.sum("n").alias("n"))
    counts = F.array(
        F.struct(F.lit("added").alias("status"), F.col("added").alias("count")),
        F.struct(F.lit("kept").alias("status"), (F.col("n") - F.col("added")).alias("count")),
    )
    rows = totals.select(F.explode(counts).alias("c")).select("c.*").where(F.col("count") > 0)
    return target.unionByName(fresh), rows


def merge_newest(
    target: DataFrame, incoming: DataFrame, keys: list[str], stamp: str = "updated_at", order: list[Column] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Take an incoming row only when it is strictly newer than the stored one.

    Of incoming rows with one stamp the last by ``order`` counts; without an order a hash of the row
    decides, so that the result is the same each time.
    """
    newest = keep_last(incoming, keys, [F.col(stamp), *(order or [F.xxhash64(*incoming.columns)])])
    cols = [c for c in target.columns if c not in keys]
    merged = _merge(target, newest, keys, cols, F.col(f"i.{stamp}") > F.col(f"t.{stamp}"))
    return merged.drop("status"), report(merged.where("status <> 'stored'"))


# --- shelf -------------------------------------------------------------------------------------
PROGRESS_COLUMNS = ("chapter_name", "chapter_index", "chapter_url", "page_index")


def shelf_with_progress(shelf: DataFrame, progress: DataFrame) -> DataFrame:
    read = progress.select("owner", "book_key", *PROGRESS_COLUMNS, F.col("updated_at").alias("read_at"))
    return shelf.join(read, ["owner", "book_key"], "left").withColumn(
        "shelf_at", F.coalesce("read_at", "created_at")
    )


def shelf_list(shelf: DataFrame, progress: DataFrame) -> DataFrame:
    """Shelves with their progress, last read (else added) first per owner."""
    return shelf_with_progress(shelf, progress).orderBy("owner", F.col("shelf_at").desc(), "book_key")


def continue_reading(shelf: DataFrame, progress: DataFrame, n: int = CONTINUE_READING) -> DataFrame:
    """Per owner the books with progress among the latest ``n`` of those that have any."""
    begun = shelf_with_progress(shelf, progress).where(F.col("read_at").isNotNull())
    latest = Window.partitionBy("owner").orderBy(F.col("shelf_at").desc(), "book_key")
    return begun.withColumn("rank", F.row_number().over(latest)).where(F.col("rank") <= n)


def delete_cascade(shelf: DataFrame, progress: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = keys.select("owner", "book_key").dropDuplicates()
    on = ["owner", "book_key"]
    return shelf.join(gone, on, "left_anti"), progress.join(gone, on, "left_anti")


def switch_source(
    shelf: DataFrame, progress: DataFrame, requests: DataFrame, now: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Move shelf entries to another source, keeping when they were added.

    ``requests``: owner, from_source_id, from_book_url, to_source_id, to_book_url, name, author,
    cover_url and, where a chapter moves along, chapter_url, chapter_name, chapter_index, page_index.
    """
    on = ["owner", "book_key"]
    asked = requests.withColumn("from_key", book_key(F.col("from_source_id"), F.col("from_book_url"))).withColumn(
        "to_key", book_key(F.col("to_source_id"), F.col("to_book_url"))
    )
    held = shelf.select("owner", F.col("book_key").alias("from_key"), F.col("created_at").alias("since"))
    checked = asked.join(held, ["owner", "from_key"], "left").withColumn(
        "error",
        F.when(F.col("from_key") == F.col("to_key"), "same_target").when(F.col("since").isNull(), "not_on_shelf"),
    )
    errors = checked.where(F.col("error").isNotNull()).select("owner", "from_key", "to_key", "error")
    moves = checked.where(F.col("error").isNull())
    moved = moves.select(
        "owner", F.col("to_key").alias("book_key"), F.col("to_source_id").alias("source_id"),
        F.col("to_book_url").alias("book_url"), "name", F.coalesce("author", F.lit("")).alias("author"),
        F.coalesce("cover_url", F.lit("")).alias("cover_url"), F.col("since").alias("created_at"),
        F.lit(now).cast("bigint").alias("updated_at"),
    )
    gone = moves.select("owner", F.col("from_key").alias("book_key"))
    entries, _ = merge_upsert(
        shelf.join(gone, on, "left_anti"), moved, on, ["name", "author", "cover_url", "updated_at"],
        [F.col("updated_at"), F.col("created_at")],
    )
    landed = moves.where(F.col("chapter_url").isNotNull()).select(
        "owner", F.col("to_key").alias("book_key"), "chapter_url", "chapter_name", "chapter_index",
        F.coalesce("page_index", F.lit(0)).alias("page_index"), F.lit(now).cast("bigint").alias("updated_at"),
    )
    cols = [c for c in progress.columns if c not in on]
    read, _ = merge_upsert(progress.join(gone, on, "left_anti"), landed, on, cols, [F.col("chapter_index")])
    return entries, read, errors


def save_progress(shelf: DataFrame, progress: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Latest reading position per book from an event log, and the shelf entry touched.

    ``events``: owner, source_id, book_url, chapter_url, chapter_name, chapter_index, page_index, ts, seq.
    """
    on = ["owner", "book_key"]

    def position(c: str) -> Column:
        return F.coalesce(F.greatest(F.lit(0), F.col(c).cast("int")), F.lit(0)).alias(c)

    rows = events.where(web_trim(F.col("chapter_url")) != "").select(
        "owner", book_key(web_trim(F.col("source_id")), web_trim(F.col("book_url"))).alias("book_key"),
        web_trim(F.col("chapter_url")).alias("chapter_url"),
        F.coalesce(web_trim(F.col("chapter_name")), F.lit("")).alias("chapter_name"),
        position("chapter_index"), position("page_index"), F.col("ts").alias("updated_at"), "seq",
    )
    last = keep_last(rows, on, [F.col("updated_at"), F.col("seq")]).drop("seq")
    cols = [c for c in progress.columns if c not in on]
    read, _ = merge_upsert(progress, last, on, cols, [F.col("updated_at")])
    touched = shelf.join(last.select(*on, F.col("updated_at").alias("touched")), on, "left")
    entries = touched.withColumn("updated_at", F.coalesce("touched", "updated_at")).drop("touched")
    return entries, read


# --- bookmarks and notes -------------------------------------------------------------------------
def normalize_marks(df: DataFrame, required: dict[str, int], optional: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """Cleaned marks, and (row, error) for those missing or overrunning a required text.

    Optional texts are cut to length, counts are whole and not negative, the ratio stays in 0..1.
    """
    error, cleaned = F.lit(None).cast("string"), {}
    for c, limit in reversed(required.items()):
        text = F.coalesce(web_trim(F.col(c)), F.lit(""))
        cleaned[c] = text
        error = F.when(text == "", F.lit(f"missing {c}")).when(
            F.length(text) > limit, F.lit(f"{c} is over {limit} characters")
        ).otherwise(error)
    for c, limit in optional.items():
        cleaned[c] = F.substring(F.coalesce(web_trim(F.col(c)), F.lit("")), 1, limit)
    for c in ("chapter_index", "page_index"):
        cleaned[c] = F.coalesce(F.greatest(F.lit(0), F.col(c).cast("int")), F.lit(0))
    ratio = F.col("percent")
    finite = ratio.isNotNull() & ~F.isnan(ratio)
    cleaned["percent"] = F.when(finite, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio))).otherwise(F.lit(0.0))
    rows = df.withColumn("error", error)
    good = rows.where(F.col("error").isNull()).drop("error").withColumns(cleaned)
    return good, rows.where(F.col("error").isNotNull())


BOOKMARK_REQUIRED = {"source_id": MAX_URL, "book_url": MAX_URL, "chapter_url": MAX_URL}
BOOKMARK_OPTIONAL = {"chapter_name": MAX_CHAPTER_NAME, "excerpt": MAX_BOOKMARK_EXCERPT, "note": MAX_BOOKMARK_NOTE}
NOTE_REQUIRED = {"source_id": MAX_URL, "book_url": MAX_URL, "text": MAX_NOTE_TEXT}
NOTE_OPTIONAL = {"chapter_name": MAX_CHAPTER_NAME, "excerpt": MAX_NOTE_EXCERPT}


def marks_by_book(marks: DataFrame) -> DataFrame:
    return marks.orderBy("owner", "source_id", "book_url", "chapter_index", "page_index", "created_at")


def format_position(page_index: Column, percent: Column) -> Column:
    page = F.greatest(F.lit(1), F.round(F.coalesce(page_index, F.lit(0))).cast("bigint") + 1)
    return F.when(percent > 0, F.format_string("%.1f%%", percent * 100)).otherwise(
        F.concat(F.lit("第 "), page.cast("string"), F.lit(" 页"))
    )


def format_chapter(name: Column, index: Column) -> Column:
    label = web_trim(F.coalesce(name, F.lit("")))
    number = F.greatest(F.lit(1), F.round(F.coalesce(index, F.lit(0))).cast("bigint") + 1)
    return F.when(label != "", label).otherwise(F.concat(F.lit("第 "), number.cast("string"), F.lit(" 章")))


def bookmark_report(bookmarks: DataFrame, shelf: DataFrame) -> DataFrame:
    """Bookmarks with the names of their books ('' for books no longer on the shelf)."""
    on = ["owner", "source_id", "book_url"]
    named = shelf.select(*on, F.col("name").alias("book_name"), F.col("author").alias("book_author"))
    out = bookmarks.join(named, on, "left")
    return out.select(
        *on, F.coalesce("book_name", F.lit("")).alias("book_name"), F.coalesce("book_author", F.lit("")).alias("book_author"),
        format_chapter(F.col("chapter_name"), F.col("chapter_index")).alias("chapter"),
        format_position(F.col("page_index"), F.col("percent")).alias("position"),
        "excerpt", "note", "chapter_index", "page_index", "created_at",
    )


# --- accounts ------------------------------------------------------------------------------------
def anon_data_count(shelf: DataFrame, progress: DataFrame) -> DataFrame:
    return shelf.select("owner").unionAll(progress.select("owner")).groupBy("owner").agg(F.count("*").alias("n"))


def session_lookup(sessions: DataFrame, users: DataFrame, now: int) -> DataFrame:
    """Who holds which live session."""
    live = sessions.where(F.col("expires_at") > now).select("token", "user_id", "expires_at")
    return live.join(users, F.col("user_id") == F.col("id")).select(
        "token", "id", "username", "display_name", "expires_at"
    )


def session_prune(sessions: DataFrame, now: int) -> DataFrame:
    return sessions.where(F.col("expires_at") > now)


def session_revoke_others(sessions: DataFrame, changed: DataFrame) -> DataFrame:
    """After a password change every session of the user goes but the one kept.

    ``changed``: user_id, keep_token.
    """
    gone = sessions.join(changed, "user_id").where(~F.col("token").eqNullSafe(F.col("keep_token")))
    return sessions.join(gone.select("token"), "token", "left_anti")


# --- versioned documents and variables -----------------------------------------------------------
def versioned_write(stored: DataFrame, requests: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Compare-and-set of one document per owner.

    ``stored``: owner, doc, updated_at. ``requests``: owner, doc, base (0 when nothing was read).
    A request made on another version is a conflict and brings the stored copy back.
    """
    s = stored.select("owner", F.col("doc").alias("old_doc"), F.col("updated_at").alias("old_at"))
    joined = s.join(requests.select("owner", F.col("doc").alias("new_doc"), "base"), "owner", "full_outer")
    asked = F.col("base").isNotNull()
    current = F.coalesce("old_at", F.lit(0))
    saved = asked & (current == F.col("base"))
    stamp = F.greatest(F.lit(now).cast("bigint"), current + 1)
    state = joined.where(saved | F.col("old_at").isNotNull()).select(
        "owner", F.when(saved, F.col("new_doc")).otherwise(F.col("old_doc")).alias("doc"),
        F.when(saved, stamp).otherwise(F.col("old_at")).alias("updated_at"),
    )
    outcomes = joined.where(asked).select(
        "owner", F.when(saved, "saved").otherwise("conflict").alias("outcome"),
        F.when(saved, stamp).otherwise(current).alias("updated_at"),
        F.when(~saved, F.col("old_doc")).alias("server_doc"),
    )
    return state, outcomes


def sync_state(stored: DataFrame, bases: DataFrame) -> DataFrame:
    """``bases``: owner, base — the version a device last saw."""
    at = F.coalesce("updated_at", F.lit(0))
    state = F.when(at == 0, "remote-empty").when(at == F.coalesce("base", F.lit(0)), "same-version").otherwise("moved")
    return bases.join(stored.select("owner", "updated_at"), "owner", "left").select("owner", state.alias("state"))


def book_variables(writes: DataFrame) -> DataFrame:
    """Last value per (book_key, name); names and values out of bounds are ignored."""
    usable = writes.where(
        (F.col("name") != "") & (F.length("name") <= MAX_VARIABLE_NAME) & (F.length("value") <= MAX_VARIABLE_VALUE)
    )
    return keep_last(usable, ["book_key", "name"], [F.col("updated_at"), F.col("seq")]).drop("seq")


def item_var_flush(items: DataFrame) -> DataFrame:
    """Variables written while an item was read, filed under the item's own book.

    ``items``: source_id, name, book_url, vars MAP. Items that were dropped take theirs along.
    """
    kept = items.where((web_trim(F.col("name")) != "") & (F.coalesce(F.col("book_url"), F.lit("")) != ""))
    rows = kept.select(
        book_key(F.col("source_id"), F.col("book_url")).alias("book_key"), F.explode("vars").alias("name", "value")
    )
    return rows.where((F.col("value") != "") & (F.length("name") <= MAX_VARIABLE_NAME) & (F.length("value") <= MAX_VARIABLE_VALUE))
