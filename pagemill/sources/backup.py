"""Backup documents: export, validation, import.

A document holds at most as many records per list as an import accepts. An owner with more gets
numbered documents, each complete in itself, so no owner is ever gathered whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import let
from ..functions.text import SPACE_CHARS, web_trim
from ..operators import library
from ..operators.skew import positions
from ..session import stored

# --- fixed values -----------------------------------------------------------------------------
BACKUP_VERSION = 2
CAPS = {"shelf": 5000, "progress": 5000, "bookmarks": 20000, "notes": 5000}
MAX_URL = 2048
MAX_NAME = 200
DAY_MS = 86_400_000
# (field, column, kind, longest, required) of each list, in document order.
_PLACE = [("chapterIndex", "chapter_index", "count", 0, False), ("pageIndex", "page_index", "count", 0, False)]
_BOOK = [("sourceId", "source_id", "text", MAX_URL, True), ("bookUrl", "book_url", "text", MAX_URL, True)]
_STAMPS = [("createdAt", "created_at", "time", 0, False), ("updatedAt", "updated_at", "time", 0, False)]
_CHAPTER = ("chapterName", "chapter_name", "text", 200, False)
FIELDS = {
    "shelf": [
        *_BOOK, ("name", "name", "text", MAX_NAME, True), ("author", "author", "text", MAX_NAME, False),
        ("coverUrl", "cover_url", "text", MAX_URL, False), *_STAMPS,
    ],
    "progress": [
        *_BOOK, ("chapterUrl", "chapter_url", "text", MAX_URL, True), _CHAPTER, *_PLACE,
        ("updatedAt", "updated_at", "time", 0, False),
    ],
    "bookmarks": [
        ("id", "id", "text", 128, True), *_BOOK, ("chapterUrl", "chapter_url", "text", MAX_URL, True), _CHAPTER,
        *_PLACE, ("percent", "percent", "ratio", 0, False), ("excerpt", "excerpt", "text", 120, False),
        ("note", "note", "text", 500, False), *_STAMPS,
    ],
    "notes": [
        ("id", "id", "text", 128, True), *_BOOK, _CHAPTER, *_PLACE, ("percent", "percent", "ratio", 0, False),
        ("excerpt", "excerpt", "text", 200, False), ("text", "text", "text", 5000, True), *_STAMPS,
    ],
}
ORDER_BY = {"shelf": "created_at", "progress": "updated_at", "bookmarks": "created_at", "notes": "created_at"}
# ----------------------------------------------------------------------------------------------

_TYPES = {"text": "string", "count": "int", "ratio": "double", "time": "bigint"}


def _ordered(rows: DataFrame, name: str) -> DataFrame:
    """The rows of one list with ``_order``, their place within an owner; rows without owner or stamp have none."""
    if name == "progress":
        rows = rows.withColumns({
            "source_id": F.regexp_extract("book_key", r"(?s)^(.*?)\n", 1),
            "book_url": F.regexp_extract("book_key", r"(?s)\n(.*)$", 1),
        })
    order = F.struct(F.col(ORDER_BY[name]).alias("stamp"), F.col("id" if "id" in rows.columns else "book_key").alias("tie"))
    return rows.where(F.col("owner").isNotNull() & F.col(ORDER_BY[name]).isNotNull()).withColumn("_order", order)


def _list_parts(rows: DataFrame, name: str, long: DataFrame | None) -> DataFrame:
    """owner, part, order and record of one list, at most CAPS[name] per part; ``long``: owners with more than that."""
    parts = rows.withColumn("part", F.lit(0).cast("bigint"))
    if long is not None:
        # Few by definition: each has more records than a document takes.
        owners = F.broadcast(long.select("owner"))
        day = F.floor(F.col("_order.stamp") / DAY_MS)
        placed = positions(rows.join(owners, "owner", "left_semi"), ["owner"], day, [F.col("_order.stamp"), F.col("_order.tie")])
        numbered = placed.withColumn("part", F.floor(F.col("pos") / CAPS[name])).drop("pos")
        parts = parts.join(owners, "owner", "left_anti").unionByName(numbered)
    record = F.struct(*[F.col(c).cast(_TYPES[kind]).alias(f) for f, c, kind, _, _ in FIELDS[name]])
    return parts.select("owner", "part", F.struct(F.col("_order").alias("o"), record.alias("r")).alias(name))


def export_backup(
    shelf: DataFrame, progress: DataFrame, bookmarks: DataFrame, notes: DataFrame, now: int, kind: str = "library-backup"
) -> DataFrame:
    """owner, part, doc: documents of all owners. Counts first who has more than one document takes."""
    lists = {n: _ordered(rows, n) for n, rows in {"shelf": shelf, "progress": progress, "bookmarks": bookmarks, "notes": notes}.items()}
    sizes = [rows.select("owner", F.lit(n).alias("list"), F.lit(CAPS[n]).alias("cap")) for n, rows in lists.items()]
    long = reduce(DataFrame.unionByName, sizes).groupBy("owner", "list", "cap").agg(F.count("*").alias("n")).where("n > cap")
    long = stored(long.select("owner", "list"), "long-lists")
    having = {r["list"] for r in long.select("list").dropDuplicates().collect()}
    rows = [_list_parts(r, n, long.where(F.col("list") == n) if n in having else None) for n, r in lists.items()]
    # All lists of a document meet in one shuffle.
    joined = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows).groupBy("owner", "part").agg(
        *[F.transform(F.sort_array(F.collect_list(n)), lambda x: x["r"]).alias(n) for n in lists]
    )
    doc = F.to_json(
        F.struct(
            F.lit(kind).alias("kind"), F.lit(BACKUP_VERSION).alias("version"), F.lit(now).cast("bigint").alias("exportedAt"),
            F.struct(*[F.size(n).alias(n) for n in lists]).alias("counts"),
            *[F.col(n) for n in lists],
        )
    )
    return joined.select("owner", "part", doc.alias("doc"))


_ERROR = "struct<list:string,idx:int,field:string,reason:string>"


def _error(name: str | None, idx: Column | None, field: Column | None, reason: str | Column) -> Column:
    return F.struct(
        F.lit(name).cast("string").alias("list"), (F.lit(None) if idx is None else idx).cast("int").alias("idx"),
        (F.lit(None) if field is None else field).cast("string").alias("field"),
        (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"),
    )


def _number_error(value: Column, highest: float) -> Column:
    """Whether a JSON value, read as a number the way scripts read it, is outside 0..highest."""
    def of_kind(kind: Column) -> Column:
        text = web_trim(F.try_variant_get(value, "$", "string"))
        number = F.when(kind == "STRING", F.when(text == "", F.lit(0.0)).otherwise(text.try_cast("double"))).when(
            kind.rlike("^(?:BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"), F.try_variant_get(value, "$", "double")
        )
        return (kind != "BOOLEAN") & let(number, lambda n: n.isNull() | F.isnan(n) | (n < 0) | (n > highest))

    return let(F.schema_of_variant(value), of_kind)


def _text_error(value: Column, longest: int, required: bool) -> Column:
    def wrong(text: Column) -> Column:
        too_long = F.length(text) > longest
        return too_long | (text == "") if required else too_long

    return (F.schema_of_variant(value) != "STRING") | let(web_trim(F.try_variant_get(value, "$", "string")), wrong)


def _field_error(record: Column, field: str, kind: str, longest: int, required: bool) -> Column:
    def wrong(v: Column) -> Column:
        if kind == "text":
            test = _text_error(v, longest, required)
        else:
            test = _number_error(v, 1.0 if kind == "ratio" else 1.7e308)
        return F.when(v.isNull() | F.is_variant_null(v), F.lit(required)).otherwise(F.coalesce(test, F.lit(True)))

    return let(F.try_variant_get(record, f"$.{field}", "variant"), wrong)


def _is_object(v: Column) -> Column:
    # The schema of a document would be put together from all its records.
    return F.try_variant_get(v, "$", "struct<kind: variant>").isNotNull()


def _plain_type(name: str) -> str:
    fields = ", ".join(f"{f}: {'string' if kind == 'text' else 'double'}" for f, _, kind, _, _ in FIELDS[name])
    return f"array<struct<{fields}>>"


def _is_plain(doc: Column, values: Column, name: str) -> Column:
    """Whether a list is sound at first sight: texts are strings, numbers are numbers, all of them in bounds.

    Values are read from the text, which is far cheaper than one by one from the variant; their kinds
    only the variant knows. A list that is not plain may still be sound.
    """
    def odd(record: Column) -> Column:
        tests = [record.isNull()]
        for f, _, kind, _, required in FIELDS[name]:
            v = record[f]
            found = F.schema_of_variant(v)
            right = found == "STRING" if kind == "text" else (found == "BIGINT") | (found == "DOUBLE") | found.startswith("DECIMAL")
            tests.append(v.isNull() | ~right if required else v.isNotNull() & ~F.is_variant_null(v) & ~right)
        return reduce(lambda a, b: a | b, tests)

    def outside(record: Column) -> Column:
        tests = []
        for f, _, kind, longest, required in FIELDS[name]:
            v = record[f]
            if kind == "text":
                tests.append(F.length(v) > longest)
                if required:
                    tests.append(F.ltrim(v, F.lit(SPACE_CHARS)) == "")
            else:
                tests.append(~v.between(0.0, 1.0 if kind == "ratio" else 1.7e308))
        return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])

    fields = ", ".join(f"{f}: variant" for f, *_ in FIELDS[name])
    kinds = F.try_variant_get(doc, f"$.{name}", f"array<struct<{fields}>>")
    return F.coalesce(let(kinds, lambda k: (F.size(k) <= CAPS[name]) & ~F.exists(k, odd)) & ~F.exists(values, outside), F.lit(False))


def _list_errors(doc: Column, values: Column, name: str) -> Column:
    none = F.array().cast(f"array<{_ERROR}>")

    def of_record(record: Column, idx: Column) -> Column:
        fields = F.array(*[
            F.when(_field_error(record, f, k, n, req), F.lit(f)) for f, _, k, n, req in FIELDS[name]
        ])
        found = F.filter(fields, lambda x: x.isNotNull())
        return F.transform(
            F.when(_is_object(record), found).otherwise(F.array(F.lit("record"))), lambda f: _error(name, idx, f, "not valid")
        )

    def of_items(items: Column) -> Column:
        return (
            F.when(items.isNull(), F.array(_error(name, None, None, "not a list")))
            .when(F.size(items) > CAPS[name], F.array(_error(name, None, None, "over the cap")))
            .otherwise(F.flatten(F.transform(items, of_record)))
        )

    def of_raw(raw: Column) -> Column:
        items = F.when(F.schema_of_variant(raw).startswith("ARRAY"), raw.try_cast("array<variant>"))
        return F.when(raw.isNull() | F.is_variant_null(raw), none).otherwise(let(items, of_items))

    return F.when(_is_plain(doc, values, name), none).otherwise(let(F.try_variant_get(doc, f"$.{name}", "variant"), of_raw))


def backup_errors(doc: Column, kind: str = "library-backup") -> Column:
    """ARRAY<STRUCT<list, idx, field, reason>> of everything wrong with a document, empty when sound.

    Lists over their cap are one error and are not opened.
    """
    def of_doc(v: Column) -> Column:
        version = F.try_variant_get(v, "$.version", "double")
        head = (
            F.when(~_is_object(v), "not an object")
            .when(~F.try_variant_get(v, "$.kind", "string").eqNullSafe(F.lit(kind)), "not a backup")
            .when(version.isNull() | F.isnan(version) | (version < 1), "no version")
            .when(version > BACKUP_VERSION, "newer version")
        )
        lists = let(
            F.from_json(doc, ", ".join(f"{name} {_plain_type(name)}" for name in FIELDS)),
            lambda values: F.concat(*[_list_errors(v, values[name], name) for name in FIELDS]),
        )
        return let(head, lambda h: F.when(h.isNotNull(), F.array(_error(None, None, None, h))).otherwise(lists))

    return let(F.try_parse_json(doc), of_doc)


def validate_backup(docs: DataFrame, kind: str = "library-backup") -> DataFrame:
    """``docs``: doc_id, doc → doc_id, list, idx, field, reason; a document without rows is sound."""
    return docs.select("doc_id", F.explode(backup_errors(F.col("doc"), kind)).alias("e")).select("doc_id", "e.*")


def _records(docs: DataFrame, name: str, now: int) -> DataFrame:
    """One list of sound documents (owner, and the text of each list) as state rows."""
    schema = ", ".join(f"{f}: {_TYPES[k]}" for f, _, k, _, _ in FIELDS[name])
    rows = docs.select("owner", F.posexplode(F.from_json(name, f"array<struct<{schema}>>")).alias("at", "r"))

    def value(f: str, kind: str) -> Column:
        c = F.col(f"r.{f}")
        if kind == "text":
            return F.coalesce(web_trim(c), F.lit(""))
        if kind == "time":
            return F.when(c > 0, c).otherwise(F.lit(now).cast("bigint"))
        return F.coalesce(c, F.lit(0).cast(_TYPES[kind]))

    out = rows.select("owner", "at", *[value(f, k).alias(c) for f, c, k, _, _ in FIELDS[name]])
    return out.withColumn("book_key", library.book_key(F.col("source_id"), F.col("book_url")))


def import_backup(
    state: dict[str, DataFrame], docs: DataFrame, now: int, kind: str = "library-backup"
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Merge sound documents (owner, doc_id, doc) into the state; (new state, list/status counts).

    Shelf, bookmarks and notes keep what is stored, progress takes what is newer.
    """
    # Checked once and taken apart once; each list then reads its own column.
    texts = F.json_tuple("doc", *FIELDS).alias(*FIELDS)
    sound = stored(docs.where(F.size(backup_errors(F.col("doc"), kind)) == 0).select("owner", texts), "sound-backups")
    merged, reports = {}, []
    for name in FIELDS:
        incoming = _records(sound, name, now)
        target = state[name]
        if name == "progress":
            new, counts = library.merge_newest(target, incoming.select(*target.columns), ["owner", "book_key"])
        else:
            keys = ["owner", "book_key"] if name == "shelf" else ["owner", "id"]
            new, counts = library.merge_ignore(target, incoming.select(*target.columns, "at"), keys, [F.col("at")])
        merged[name] = new
        reports.append(counts.select(F.lit(name).alias("list"), "status", "count"))
    total = reports[0]
    for counts in reports[1:]:
        total = total.unionByName(counts)
    return merged, total
