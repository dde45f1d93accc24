"""Book lists, detail pages, search over all sources, explore pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonpath import with_json_values
from ..functions.text import web_trim
from ..functions.urls import first_address, resolve_address
from ..operators.nodes import html_nodes
from ..operators.skew import keep_first
from ..session import broadcast_if_small, stored
from . import rulesets

# --- fixed values -----------------------------------------------------------------------------
BOOK_FIELDS = ["name", "author", "kind", "wordCount", "lastChapter", "intro", "coverUrl", "bookUrl"]
BOOK_DEFAULTS = {"name": "text", "bookUrl": "tag.a@href"}
INFO_FIELDS = ["tocUrl", "name", "author", "intro", "coverUrl"]
# ----------------------------------------------------------------------------------------------


def node_table(pages: DataFrame) -> DataFrame:
    """Node table of the pages, written once and read by every step after it."""
    return stored(html_nodes(pages), "nodes")


def first_line_address(values: Column, base: Column) -> Column:
    """The first address among a field's values, made absolute."""
    first = F.get(F.filter(F.transform(values, first_address), lambda a: a != ""), F.lit(0))
    return F.when(first.isNotNull(), resolve_address(first, base)).otherwise("")


def tolerant_fields(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``cells``: source_id, field, value, error, ord → (values, warnings).

    A broken display field is blank; the first message per source and field is kept. A broken
    address field is ``fatal``: its source has no rows.
    """
    fatal = F.col("field").isin(*rulesets.ADDRESS_FIELDS)
    broken = cells.where(F.col("error").isNotNull())
    warnings = broken.groupBy("source_id", "field").agg(F.min_by("error", "ord").alias("message")).withColumn("fatal", fatal)
    failed = warnings.where("fatal").select("source_id").dropDuplicates()
    values = cells.withColumn("value", F.when(F.col("error").isNull(), F.col("value")).otherwise("")).join(
        broadcast_if_small(failed), "source_id", "left_anti"
    )
    return values.drop("error"), warnings


def _with_variables(rows: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with vars, the variables of each; an empty MAP where there are none."""
    none = F.create_map().cast("map<string,string>")
    found = rulesets.variables_of(values).select(*keys, "vars")
    return rows.join(found, keys, "left").withColumn("vars", F.coalesce("vars", none))


def known_variables(items: DataFrame, variables: DataFrame | None, keys: list[str]) -> DataFrame:
    """Items with vars, what earlier jobs wrote for them; ``variables``: the keys and vars MAP, one row each."""
    return items if variables is None else items.join(variables.select(*keys, "vars"), keys, "left")


def _warnings(errors: DataFrame) -> DataFrame:
    """source_id, field, message, fatal: a broken list or address field leaves its source without rows."""
    fatal = F.col("field").isin(*rulesets.ADDRESS_FIELDS, *rulesets.LIST_FIELDS) & ~F.col("used")
    return errors.select("source_id", "field", "message", fatal.alias("fatal"))


def without_failed(rows: DataFrame, warnings: DataFrame) -> DataFrame:
    failed = warnings.where("fatal").select("source_id").dropDuplicates()
    return rows.join(broadcast_if_small(failed), "source_id", "left_anti")


def extract_book_list(
    pages: DataFrame, rule_fields: DataFrame, group: str = "ruleSearch", nodes: DataFrame | None = None, with_vars: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``pages``: page_id, source_id, url, html → (books, warnings); the same job for search and explore.

    books: page_id, source_id, item and the book fields; rows without a name are dropped. ``with_vars``
    adds vars, a MAP of the variables that the item's rules wrote.
    """
    rules = rulesets.with_defaults(rule_fields, group, BOOK_DEFAULTS, "bookList").where(
        F.col("field").isin("bookList", *BOOK_FIELDS)
    )
    compiled = rulesets.compile_rules(rules)
    warnings = _warnings(compiled.errors)
    usable = without_failed(pages, warnings)
    nodes = node_table(pages) if nodes is None else nodes
    items = stored(rulesets.list_items(nodes, usable, compiled.parts.where("field = 'bookList'")), "items")
    values = rulesets.field_values(nodes, usable, items, compiled, without="bookList")
    values = stored(values, "values") if with_vars else values
    based = values.join(pages.select("page_id", "url"), "page_id")
    address = F.col("field").isin("bookUrl", "coverUrl")
    value = F.when(address, first_line_address(F.col("values"), F.col("url"))).otherwise(rulesets.joined_value(F.col("values")))
    books = rulesets.wide(based, ["page_id", "source_id", "item"], BOOK_FIELDS, value).where("name <> ''")
    return _with_variables(books, values, ["page_id", "source_id", "item"]) if with_vars else books, warnings


def search_all(
    pages: DataFrame, rule_fields: DataFrame, responses: DataFrame, nodes: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Search over captured result pages: (books, summary[source_id, ok, count, elapsed_ms, error]).

    ``responses``: source_id, page_id, elapsed_ms, error — what each source answered. One failing
    source never fails the rest.
    """
    books, warnings = extract_book_list(pages, rule_fields, "ruleSearch", nodes)
    counts = books.groupBy("source_id").agg(F.count("*").alias("count"))
    broken = keep_first(warnings.where("fatal").select("source_id", "field", "message"), ["source_id"], [F.col("field")])
    answered = responses.groupBy("source_id").agg(
        F.max("elapsed_ms").alias("elapsed_ms"), F.max("error").alias("failure")
    )
    error = F.coalesce("failure", "message")
    summary = answered.join(broken.select("source_id", "message"), "source_id", "left").join(counts, "source_id", "left").select(
        "source_id", error.isNull().alias("ok"), F.when(error.isNull(), F.coalesce("count", F.lit(0))).otherwise(0).alias("count"),
        "elapsed_ms", error.alias("error"),
    )
    return books, summary


def init_reroot(nodes: DataFrame, pages: DataFrame, parts: DataFrame) -> DataFrame:
    """Start points of detail fields: page_id, source_id, item 0, node_id, json.

    ``init`` names a node set or a JSON path; where it finds nothing, or only has side effects, the
    fields start at the page itself.
    """
    roots = rulesets.list_items(nodes, pages, parts.withColumn("reverse", F.lit(False)).where("hook IS NULL"))
    is_path = (F.col("dialect") == "json") | ((F.size("path") > 0) & ~F.col("body").rlike(r"^(?:class|id|tag|text|children)(?:\.|$)"))
    is_json = web_trim(F.col("html")).rlike(r"^[\[{]")
    paths = broadcast_if_small(parts.where(is_path).select("source_id", "path"))
    deeper = with_json_values(pages.where(is_json).join(paths, "source_id"), "html", "path", rulesets.deep_places(parts)).select(
        "page_id", "source_id", F.get("values", F.lit(0)).alias("json")
    ).where(web_trim(F.col("json")) != "")
    found = roots.where(F.col("node_id").isNotNull()).select("page_id", "source_id", "node_id", "json").join(
        pages.where(is_json).select("page_id"), "page_id", "left_anti"
    ).unionByName(deeper.select("page_id", "source_id", F.lit(None).cast("int").alias("node_id"), "json"))
    whole = pages.join(found.select("page_id", "source_id").dropDuplicates(), ["page_id", "source_id"], "left_anti").select(
        "page_id", "source_id", F.when(~is_json, F.lit(0)).alias("node_id"), F.when(is_json, F.col("html")).alias("json")
    )
    return found.unionByName(whole).withColumn("item", F.lit(0).cast("bigint"))


def extract_book_info(
    pages: DataFrame, rule_fields: DataFrame, nodes: DataFrame | None = None, variables: DataFrame | None = None, with_vars: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``pages``: page_id, source_id, url, html → (info, warnings).

    info: page_id, source_id, toc_url (the page itself when no rule finds one), name, author, intro, cover_url.
    ``variables`` (source_id, url, vars): what the search wrote for the book of that address, at most one row a
    book. ``with_vars`` adds vars: those, and what the detail rules write.
    """
    rules = rule_fields.where("grp = 'ruleBookInfo'").where(F.col("field").isin("init", *INFO_FIELDS))
    compiled = rulesets.compile_rules(rules)
    nodes = node_table(pages) if nodes is None else nodes
    starts = init_reroot(nodes, pages, compiled.parts.where("field = 'init'"))
    if variables is not None:
        starts = known_variables(starts.join(pages.select("page_id", "url"), "page_id"), variables, ["source_id", "url"]).drop("url")
    values = rulesets.field_values(nodes, pages, starts, compiled, without="init")
    values = stored(values, "values") if with_vars else values
    based = values.join(pages.select("page_id", "url"), "page_id")
    address = F.col("field").isin("tocUrl", "coverUrl")
    value = F.when(address, first_line_address(F.col("values"), F.col("url"))).otherwise(rulesets.joined_value(F.col("values")))
    found = rulesets.wide(based, ["page_id", "source_id"], INFO_FIELDS, value)
    info = pages.select("page_id", "source_id", "url").join(found, ["page_id", "source_id"], "left").select(
        "page_id", "source_id",
        F.when(F.coalesce("tocUrl", F.lit("")) != "", F.col("tocUrl")).otherwise(F.col("url")).alias("toc_url"),
        *[F.coalesce(f, F.lit("")).alias(a) for f, a in (("name", "name"), ("author", "author"), ("intro", "intro"), ("coverUrl", "cover_url"))],
    )
    info = _with_variables(info, values, ["page_id", "source_id"]) if with_vars else info
    return info, _warnings(compiled.errors)


def explore_page(
    pages: DataFrame, rule_fields: DataFrame, nodes: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Category pages: (books, next[page_id, next_url], warnings); a page that names itself has no next one."""
    nodes = node_table(pages) if nodes is None else nodes
    books, warnings = extract_book_list(pages, rule_fields, "ruleExplore", nodes)
    onward, more = next_links(pages, rule_fields, "ruleExplore", "nextPageUrl", nodes)
    warnings = warnings.unionByName(more)
    return without_failed(books, more), without_failed(onward, warnings), warnings


def next_links(pages: DataFrame, rule_fields: DataFrame, grp: str, field: str, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(page_id, source_id, url, next_url of pages whose next-page rule finds another address; warnings)."""
    compiled = rulesets.compile_rules(rule_fields.where((F.col("grp") == grp) & (F.col("field") == field)))
    starts = pages.select(
        "page_id", "source_id", F.lit(0).cast("bigint").alias("item"), F.lit(0).alias("node_id"), F.col("html").alias("json")
    ).withColumn("json", F.when(web_trim(F.col("json")).rlike(r"^[\[{]"), F.col("json")))
    values = rulesets.field_values(nodes, pages, starts, compiled).join(pages.select("page_id", "url"), "page_id")
    values = values.where(F.col("field") == field)
    found = values.select("page_id", "source_id", "url", first_line_address(F.col("values"), F.col("url")).alias("next_url"))
    return found.where((F.col("next_url") != "") & (F.col("next_url") != F.col("url"))), _warnings(compiled.errors)
