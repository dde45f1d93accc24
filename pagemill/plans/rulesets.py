"""Rules as a table: compiling rule texts and evaluating them over the node table.

Rules of all sources are evaluated together. ``rule_fields`` rows (source_id, grp, field, rule)
become part rows and programs; list rules give items, field rules give values per item. Whatever a
template, a variable or a function needs is a part of its own, evaluated in the same rounds; the programs
then put an item's values together in one expression. The rules side of every join is broadcast only
while it is small.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import lists, rulesyntax
from ..functions.jsonpath import json_items, with_json_values
from ..functions.regex import compiles
from ..functions.text import web_trim
from ..hooks import HOOKS, apply_hooks
from ..operators import select
from ..operators.nodes import html_nodes
from ..session import broadcast_if_small, stored

# --- fixed values -----------------------------------------------------------------------------
LIST_FIELDS = ("bookList", "chapterList")
ADDRESS_FIELDS = ("bookUrl", "tocUrl", "chapterUrl", "nextTocUrl", "nextContentUrl", "nextPageUrl")
# ----------------------------------------------------------------------------------------------


@F.pandas_udf(StringType())
def _parse(rules: pd.Series, listing: pd.Series) -> pd.Series:
    return pd.Series([json.dumps(rulesyntax.parse_rule(r, bool(flag))) for r, flag in zip(rules, listing)], dtype="object")


def _usable_ops(ops: Column) -> Column:
    """Operations whose pattern compiles, replacements in Java's form."""
    def java(op: Column) -> Column:
        plain = F.replace(op["r"], F.lit("\\"), F.lit("\\\\"))
        return F.struct(
            op["p"].alias("p"), F.regexp_replace(F.replace(plain, F.lit("$&"), F.lit("$0")), r"\$(?![0-9])", r"\\\$").alias("r"),
            op["first"].alias("first"),
        )

    return F.transform(F.filter(ops, lambda op: compiles(op["p"])), java)


@F.pandas_udf(StringType())
def _ordered(fields: pd.Series) -> pd.Series:
    def one(rows) -> str:
        programs, errors = rulesyntax.in_order([(r["field"], r["programs"]) for r in rows])
        return json.dumps(dict(programs=programs, errors=[dict(field=f, message=m) for f, m in errors]))

    return pd.Series([one(rows) for rows in fields], dtype="object")


@dataclass
class Rules:
    """Compiled rules: what to select, how to put values together, and what could not be read.

    parts: source_id, grp, owner (the field), field (the field or a selection inside it), joiner, part, alt,
    alts, pick, dialect, body, steps, path, extract, reverse, ops, hook, after.
    programs: source_id, grp, programs in the order in which they are to run.
    errors: source_id, grp, field, message, used — rules that use what is not evaluated here; ``used``
    rules are evaluated without it, the others not at all. Unpacks as (parts, errors).
    """

    parts: DataFrame
    programs: DataFrame
    errors: DataFrame

    def __iter__(self) -> Iterator[DataFrame]:
        return iter((self.parts, self.errors))


def compile_rules(rule_fields: DataFrame) -> Rules:
    """Rule texts as data. Of several rules of one group that write a variable, the last field by name wins."""
    rows = rule_fields.where(web_trim(F.coalesce("rule", F.lit(""))) != "")
    # Read by every step below: parsed once, and small next to any page table.
    parsed = stored(rows.select(
        "source_id", "grp", "field",
        F.from_json(_parse(F.col("rule"), F.col("field").isin(*LIST_FIELDS)), rulesyntax.RULE).alias("r"),
    ), "rules")
    message = F.coalesce("r.error", "r.note")
    errors = parsed.where(message.isNotNull()).select("source_id", "grp", "field", message.alias("message"), F.col("r.error").isNull().alias("used"))
    each = parsed.select("source_id", "grp", F.col("field").alias("owner"), F.explode("r.rows").alias("row")).select(
        "source_id", "grp", "owner", F.when(F.col("row.sub") == "", F.col("owner")).otherwise(F.concat("owner", F.lit(rulesyntax.SUB), "row.sub")).alias("field"),
        "row.joiner", "row.part", "row.p.*",
    )
    bad_pattern = (F.col("dialect") == "allinone") & ~compiles(F.concat(F.lit("(?m)"), "body"))
    bad_hook = F.col("hook").isNotNull() & ~F.col("hook").isin(*HOOKS) if HOOKS else F.col("hook").isNotNull()
    said = F.when(bad_pattern, F.concat(F.lit("a pattern that does not compile: "), "body")).when(bad_hook, F.concat(F.lit("no hook named "), "hook"))
    refused = each.where(said.isNotNull()).select("source_id", "grp", F.col("owner").alias("field"), said.alias("message"), F.lit(False).alias("used"))
    fields = F.array_sort(F.collect_list(F.struct("field", F.col("r.programs").alias("programs"))))
    grouped = parsed.where("r.programs <> '[]'").groupBy("source_id", "grp").agg(fields.alias("fields"))
    circle = "array<struct<field:string,message:string>>"
    ordered = grouped.select("source_id", "grp", F.from_json(_ordered("fields"), f"struct<programs:array<{rulesyntax.PROGRAM}>,errors:{circle}>").alias("o"))
    ordered = stored(ordered, "programs")
    circles = ordered.select("source_id", "grp", F.explode("o.errors").alias("e")).select(
        "source_id", "grp", "e.field", "e.message", F.lit(False).alias("used")
    )

    def usable(program: Column) -> Column:
        parts = F.transform(program["parts"], lambda q: F.struct(q["fn"].alias("fn"), q["pieces"].alias("pieces"), _usable_ops(q["ops"]).alias("ops")))
        return F.struct(program["name"].alias("name"), program["put"].alias("put"), program["joiner"].alias("joiner"), parts.alias("parts"))

    programs = ordered.where(F.size("o.programs") > 0).select("source_id", "grp", F.transform("o.programs", usable).alias("programs"))
    parts = each.where(said.isNull()).withColumns({"ops": _usable_ops(F.col("ops")), "after": _usable_ops(F.col("after"))})
    return Rules(stored(parts, "rules"), programs, errors.unionByName(refused).unionByName(circles))


@F.pandas_udf(StringType())
def _dialect(rules: pd.Series) -> pd.Series:
    return rules.map(lambda rule: rulesyntax.dialect_of(rule or "")[0])


def rule_dialect(rule_fields: DataFrame) -> DataFrame:
    """+ dialect of each rule text."""
    return rule_fields.withColumn("dialect", _dialect("rule"))


def rule_steps(rule_fields: DataFrame) -> DataFrame:
    """Default-dialect rules as rows: source_id, grp, field, part, joiner, step_ord, by, name, index_expr, extract."""
    parts = compile_rules(rule_fields).parts.where("dialect = 'default' AND field = owner")
    steps = parts.select("source_id", "grp", "field", "part", "joiner", "extract", F.posexplode("steps").alias("step_ord", "step"))
    step = {name: F.col(f"step.{name}") for name in ("axis", "id", "own", "tag", "pick")}
    classes = F.size("step.classes") > 0
    by = (
        F.when(step["axis"] == "child", "children").when(classes, "class").when(step["id"].isNotNull(), "id")
        .when(step["own"].isNotNull(), "text").otherwise("tag")
    )
    name = F.when(classes, F.array_join("step.classes", " ")).otherwise(F.coalesce(step["id"], step["own"], step["tag"], F.lit("")))
    return steps.select(
        "source_id", "grp", "field", "part", "joiner", "step_ord", by.alias("by"), name.alias("name"),
        F.coalesce(step["pick"], F.lit("")).alias("index_expr"), "extract",
    )


# --- evaluation ------------------------------------------------------------------------------------
NODE_DIALECTS = ("default", "css", "xpath")
BARE = r"^[A-Za-z_][\w-]*$"  # on JSON a bare word is a field name


def _terms(parts: DataFrame) -> DataFrame:
    steps = parts.select(F.explode("steps").alias("step"))
    return broadcast_if_small(steps.select(select._term_of(F.col("step")).alias("term")).dropDuplicates())


def _deep_in(path: Column) -> Column:
    places = F.transform(path, lambda s, i: F.when(s["kind"] == "deep", i))
    return F.filter(places, lambda i: i.isNotNull())


def _all_deep() -> Column:
    return F.array_distinct(F.flatten(F.collect_set(_deep_in(F.col("path")))))


def deep_places(parts: DataFrame) -> list[int]:
    """Places in the JSON paths at which some rule descends."""
    return parts.agg(_all_deep()).first()[0]


def _needs(parts: DataFrame):
    """One small aggregate over compiled rules: step shapes, dialects and value kinds in use."""
    return parts.agg(
        *select.StepShapes.aggregates(),
        F.bool_or(F.col("dialect").isin(*NODE_DIALECTS)).alias("dom"), F.bool_or(F.col("dialect") == "json").alias("json"),
        F.bool_or(F.col("dialect").isin("allinone", "source")).alias("patterns"), F.bool_or(F.col("dialect") == "allinone").alias("allinone"),
        F.bool_or((F.col("alts") > 1) | F.col("pick").isNotNull()).alias("lists"), F.bool_or(F.col("hook").isNotNull()).alias("hooks"),
        F.bool_or((F.col("dialect") == "default") & F.col("body").rlike(BARE)).alias("bare"),
        F.bool_or(F.col("extract").isin(*select.TEXT_KINDS)).alias("text"), F.bool_or(F.col("extract").isin(*select.HTML_KINDS)).alias("html"),
        F.bool_or(F.col("extract").isin(*select.OWN_KINDS)).alias("own"),
        _all_deep().alias("deep"),
    ).first()


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def _runs(nodes: DataFrame, starts: DataFrame, dom: DataFrame, carried: list[str], need) -> DataFrame:
    """Hits of node rules from start nodes, alternatives as one list: page_id, *carried, node_id, ord, node columns."""
    shapes = select.StepShapes.of_row(need)
    ways = ["alt", "alts", "pick"] if need["lists"] else []
    runs = starts.join(broadcast_if_small(dom.select("source_id", *[c for c in carried if c not in starts.columns], *ways, "steps")), "source_id")
    hits = select.run_steps(select.flagged(nodes, dom, shapes), runs, [*carried, *ways], _terms(dom), shapes)
    return select.in_one_list(hits, carried) if ways else hits


def _page_patterns(pages: DataFrame, parts: DataFrame) -> DataFrame:
    """Matches of whole-page patterns: page_id, source_id, part, joiner, reverse, ord, text, groups.

    The text is the first group where the pattern has groups, else the match, cleaned and trimmed; blank ones go.
    """
    patterns = parts.select("source_id", "part", "joiner", "reverse", "ops", F.concat(F.lit("(?m)"), "body").alias("pattern"), _group_count(F.col("body")).alias("n"))
    found = pages.select("page_id", "source_id", "html").join(broadcast_if_small(patterns), "source_id")
    each = F.transform(F.sequence(F.lit(0), "n"), lambda k: F.regexp_extract_all("html", F.col("pattern"), k))
    matched = found.withColumn("every", each).select("page_id", "source_id", "part", "joiner", "reverse", "ops", "n", "every", F.posexplode(F.get("every", F.lit(0))).alias("ord", "whole"))
    groups = F.transform("every", lambda g: F.get(g, F.col("ord")))
    value = F.when(F.col("n") > 0, F.get(groups, F.lit(1))).otherwise(F.col("whole"))
    cleaned = web_trim(F.get(_apply_ops(F.array(value), F.col("ops")), F.lit(0)))
    return matched.select("page_id", "source_id", "part", "joiner", "reverse", F.col("ord").cast("bigint").alias("ord"), cleaned.alias("text"), groups.alias("groups")).where("text <> ''")


def _group_count(pattern: Column) -> Column:
    """Capturing groups of a pattern: parentheses that open one, outside of escapes and character classes."""
    bare = F.regexp_replace(F.regexp_replace(pattern, r"(?s)\\Q.*?(?:\\E|$)|\\.", ""), r"\[\^?\]?[^\]]*\]", "")
    return F.regexp_count(bare, F.lit(r"\((?!\?)|\(\?<(?![=!])"))


def list_items(nodes: DataFrame, pages: DataFrame, parts: DataFrame) -> DataFrame:
    """Items of list rules: page_id, source_id, item (place in the page), node_id, json, text, groups.

    ``pages``: page_id, source_id, html. Node rules give a node, JSON rules the item's JSON text, patterns
    over the whole page a piece of its text with all groups.
    """
    need = _needs(parts)
    keys = ["page_id", "source_id", "part", "joiner", "reverse"]
    nothing = {"node_id": "int", "json": "string", "text": "string", "groups": "array<string>"}

    def branch(rows: DataFrame) -> DataFrame:
        return rows.select(*keys, "ord", *[c if c in rows.columns else F.lit(None).cast(kind).alias(c) for c, kind in nothing.items()])

    branches = []
    if need["dom"] or not (need["json"] or need["allinone"]):
        dom = parts.where(F.col("dialect").isin(*NODE_DIALECTS))
        starts = select.with_nodes(
            nodes, pages.select("page_id", "source_id", F.lit(0).alias("node_id"), F.lit(0).cast("bigint").alias("ord"))
        )
        branches.append(branch(_runs(nodes, starts, dom, keys[1:], need).select(*keys, "ord", "node_id")))
    if need["json"]:
        as_json = broadcast_if_small(parts.where("dialect = 'json'").select("source_id", "part", "joiner", "reverse", "path"))
        listed = with_json_values(pages.join(as_json, "source_id"), "html", "path", need["deep"])
        texts = listed.select(*keys, F.posexplode(json_items(F.col("values"))).alias("ord", "json"))
        branches.append(branch(texts.withColumn("ord", F.col("ord").cast("bigint"))))
    if need["allinone"]:
        branches.append(branch(_page_patterns(pages, parts.where("dialect = 'allinone'"))))
    found = _union(branches)
    page = Window.partitionBy("page_id", "source_id")
    turned = F.when(F.col("reverse"), -F.col("ord")).otherwise(F.col("ord"))
    # && part after part, || the first part with hits, %% one of each part in turn.
    rows = found.withColumn("turned", turned).withColumn("first_part", F.min("part").over(page)).where(
        ~F.col("joiner").eqNullSafe(F.lit("||")) | (F.col("part") == F.col("first_part"))
    ).withColumn("place", F.row_number().over(Window.partitionBy("page_id", "source_id", "part").orderBy("turned")))
    order = [F.when(F.col("joiner") == "%%", F.col("place")).otherwise(0), F.col("part"), F.col("place")]
    return rows.select(
        "page_id", "source_id", (F.row_number().over(page.orderBy(*order)) - 1).cast("bigint").alias("item"), *nothing
    )


def _apply_ops(values: Column, ops: Column) -> Column:
    def one(value: Column) -> Column:
        def apply(acc: Column, op: Column) -> Column:
            match = F.regexp_substr(acc, op["p"])
            first = F.coalesce(F.regexp_replace(match, op["p"], op["r"]), F.lit(""))
            return F.when(op["first"], first).otherwise(F.regexp_replace(acc, op["p"], op["r"]))

        return F.aggregate(ops, value, apply)

    return F.when(F.size(ops) > 0, F.transform(values, one)).otherwise(values)


def _combined(parts: Column) -> Column:
    """Values of a field from its parts (sorted array of part, joiner, values)."""
    joiner = F.get(parts, F.lit(0))["joiner"]
    every = F.transform(parts, lambda p: p["values"])
    longest = F.array_max(F.transform(every, F.size))
    turns = F.transform(
        F.sequence(F.lit(0), F.greatest(longest - 1, F.lit(0))), lambda i: F.filter(F.transform(every, lambda v: F.get(v, i)), lambda v: v.isNotNull())
    )
    first = F.coalesce(F.get(F.filter(every, lambda v: F.size(v) > 0), F.lit(0)), F.array().cast("array<string>"))
    return F.when(joiner == "||", first).when(joiner == "%%", F.flatten(turns)).otherwise(F.flatten(every))


def field_values(nodes: DataFrame, pages: DataFrame, items: DataFrame, rules: Rules, without: str | None = None) -> DataFrame:
    """Values of field rules: page_id, source_id, item, field, values ARRAY<STRING>.

    ``items``: page_id, source_id, item, node_id, json and, where there are any, text and groups (of a
    pattern's match) and vars (a MAP of variables known before); several rows of one item are several
    start nodes. ``without`` names the list rule. Fields without values are absent. Variables that rules write or
    that were known come as fields of the name ``variable_field`` gives.
    """
    parts = rules.parts if without is None else rules.parts.where(F.col("field") != without)
    plain = _selected_values(nodes, pages, items, parts)
    if "text" in items.columns and not items.where("text is not null").isEmpty():
        plain = plain.unionByName(_fragment_values(items, parts))
    if rules.programs.isEmpty():
        return plain
    plain = stored(plain, "selected-values")
    made = _run_programs(pages, items, plain.where(F.col("field").contains(rulesyntax.SUB)), rules.programs)
    return plain.where(~F.col("field").contains(rulesyntax.SUB)).unionByName(made)


def _fragment_values(items: DataFrame, parts: DataFrame) -> DataFrame:
    """Values of node and JSON rules on items that are pieces of text: each piece is read as a page of its own."""
    whole = items.where("text is not null").select(
        F.concat_ws("\n", F.col("page_id").cast("string"), "source_id", F.col("item").cast("string")).alias("key"), "page_id", "source_id", "item", "text"
    )
    pieces = whole.select(F.col("key").alias("page_id"), "source_id", F.col("text").alias("html"))
    nodes = stored(html_nodes(pieces), "fragment-nodes")
    starts = whole.select(
        F.col("key").alias("page_id"), "source_id", "item", F.lit(0).alias("node_id"),
        F.when(web_trim(F.col("text")).rlike(r"^[\[{]"), F.col("text")).alias("json"),
    )
    on_pieces = parts.where(F.col("dialect").isin(*NODE_DIALECTS, "json"))
    found = _selected_values(nodes, pieces, starts, on_pieces).select(F.col("page_id").alias("key"), "field", "values")
    return found.join(whole.select("key", "page_id", "source_id", "item"), "key").select("page_id", "source_id", "item", "field", "values")


def _numbered(parts: DataFrame, told: list[str]) -> tuple[DataFrame, DataFrame]:
    """Parts + rule, a number for what they say in the columns ``told``, and those columns by number.

    Rows that carry the number instead of texts and lists of operations are short, and quick to sort.
    """
    rest = [c for c in parts.columns if c not in told]
    grouped = parts.groupBy(*told).agg(F.collect_list(F.struct(*rest)).alias("ways"))
    grouped = stored(grouped.withColumn("rule", F.monotonically_increasing_id()), "numbered-rules")
    each = grouped.select(*told, "rule", F.explode("ways").alias("way")).select(*told, "rule", "way.*")
    return each, grouped.select("rule", *told)


def _selected_values(nodes: DataFrame, pages: DataFrame, items: DataFrame, parts: DataFrame) -> DataFrame:
    """Values of selections per item: page_id, source_id, item, field, values."""
    need = _needs(parts)
    keys = ["source_id", "item", "field", "part", "joiner"]
    kept = ["ops", "hook", "after"]
    branches = []
    if need["dom"] or not (need["json"] or need["patterns"]):
        dom = parts.where(F.col("dialect").isin(*NODE_DIALECTS))
        dom, told = _numbered(dom, ["source_id", "field", "part", "joiner", "extract", "reverse", *kept])
        placed = items.where(F.col("node_id").isNotNull()).withColumn(
            "ord", (F.row_number().over(Window.partitionBy("page_id", "source_id", "item").orderBy("node_id")) - 1).cast("bigint")
        )
        starts = select.with_nodes(nodes, placed.select("page_id", "source_id", "item", "node_id", "ord"))
        hits = _runs(nodes, starts, dom, ["item", "rule"], need).join(broadcast_if_small(told.select("rule", "extract")), "rule")
        rows = select.value_lists(
            hits, select.page_texts(nodes) if need["text"] else None, select.own_texts(nodes) if need["own"] else None, pages.select("page_id", "html") if need["html"] else None
        )
        ordered = F.array_sort(F.collect_list(F.struct("ord", "values")))
        grouped = rows.groupBy("page_id", "item", "rule").agg(F.flatten(F.transform(ordered, lambda v: v["values"])).alias("values"))
        grouped = grouped.join(broadcast_if_small(told), "rule")
        values = F.when(F.col("reverse"), F.reverse("values")).otherwise(F.col("values"))
        branches.append(grouped.withColumn("values", values).select("page_id", *keys, *kept, "values"))
    if need["json"] or need["bare"]:
        as_json = parts.where((F.col("dialect") == "json") | ((F.col("dialect") == "default") & F.col("body").rlike(BARE))).select(
            "source_id", "field", "part", "joiner", *kept, "path"
        )
        texts = items.where(F.col("json").isNotNull()).join(broadcast_if_small(as_json), "source_id")
        found = with_json_values(texts, "json", "path", need["deep"])
        branches.append(found.where(F.size("values") > 0).select("page_id", *keys, *kept, "values"))
    if need["patterns"]:
        # Whole-page patterns read the source text itself.
        patterns = parts.where(F.col("dialect").isin("allinone", "source")).select(
            "source_id", "field", "part", "joiner", *kept, "dialect", "body"
        )
        on_page = items.select("page_id", "source_id", "item").dropDuplicates().join(
            broadcast_if_small(patterns), "source_id"
        ).join(pages.select("page_id", "html"), "page_id")
        pattern = F.concat(F.lit("(?m)"), "body")
        grouped_pattern = _group_count(F.col("body")) > 0
        every = F.when(grouped_pattern, F.regexp_extract_all("html", pattern, F.lit(1))).otherwise(F.regexp_extract_all("html", pattern, F.lit(0)))
        trimmed = F.filter(F.transform(every, web_trim), lambda v: v != "")
        matched = on_page.withColumn("values", F.when(F.col("dialect") == "source", F.array("html")).otherwise(trimmed))
        branches.append(matched.select("page_id", *keys, *kept, "values"))
    cleaned = _union(branches).withColumn("values", _apply_ops(F.col("values"), F.col("ops")))
    if need["hooks"]:
        # Only rows whose rule names a hook pass through Python; what was found is not computed once for each hook.
        cleaned = apply_hooks(stored(cleaned, "hook-input")).withColumn("values", _apply_ops(F.col("values"), F.col("after")))
    # One row per part of a rule, so the list per field is as long as the rule has parts.
    sorted_parts = F.array_sort(F.collect_list(F.struct("part", "joiner", "values")))
    return cleaned.groupBy("page_id", "source_id", "item", "field").agg(sorted_parts.alias("parts")).select(
        "page_id", "source_id", "item", "field", _combined(F.col("parts")).alias("values")
    )


# --- programs ----------------------------------------------------------------------------------------
_VARIABLE = f"{rulesyntax.SUB}variable{rulesyntax.SUB}"


def variable_field(name: str) -> str:
    """The field under which a variable's value comes among the values."""
    return _VARIABLE + name


def variables_of(values: DataFrame) -> DataFrame:
    """page_id, source_id, item, vars MAP of the values of ``field_values``."""
    named = values.where(F.col("field").startswith(_VARIABLE)).select(
        "page_id", "source_id", "item", F.struct(F.expr(f"substring(field, {len(_VARIABLE) + 1})").alias("k"), F.get("values", F.lit(0)).alias("v")).alias("e")
    )
    return named.groupBy("page_id", "source_id", "item").agg(F.map_from_entries(F.collect_list("e")).alias("vars"))


def _run_programs(pages: DataFrame, items: DataFrame, selected: DataFrame, programs: DataFrame) -> DataFrame:
    """What the programs of each item's source make of its selections: rows like those of ``field_values``.

    Programs are in the order of what they read, so one fold over them evaluates templates, functions and
    variables, however deep they lie on each other.
    """
    per_item = selected.groupBy("page_id", "source_id", "item").agg(F.map_from_entries(F.collect_list(F.struct("field", "values"))).alias("subs"))
    none = F.lit(None).cast("array<string>")
    known = F.col("vars") if "vars" in items.columns else F.lit(None).cast("map<string,string>")
    each = items.select(
        "page_id", "source_id", "item", (F.col("groups") if "groups" in items.columns else none).alias("groups"), known.alias("vars")
    ).dropDuplicates(["page_id", "source_id", "item"])
    rows = each.join(broadcast_if_small(programs.groupBy("source_id").agg(F.flatten(F.collect_list("programs")).alias("programs"))), "source_id")
    rows = rows.join(per_item, ["page_id", "source_id", "item"], "left").join(pages.select("page_id", F.col("url").alias("_address")), "page_id", "left")
    empty, no_map = F.array().cast("array<string>"), F.create_map().cast("map<string,string>")
    start = F.struct(
        F.map_concat(F.map_filter(F.coalesce("vars", no_map), lambda k, _: k != rulesyntax.PAGE_ADDRESS), F.create_map(F.lit(rulesyntax.PAGE_ADDRESS), F.coalesce("_address", F.lit("")))).alias("vars"),
        F.array().cast("array<struct<field:string,values:array<string>>>").alias("outs"),
    )

    def listed(piece: Column) -> Column:
        return F.coalesce(F.try_element_at("subs", piece["sub"]), empty)

    def joined(values: Column) -> Column:
        return F.array_join(F.filter(values, lambda v: v != ""), "\n")

    def other(piece: Column, variables: Column) -> Column:
        group = F.coalesce(F.get("groups", piece["grp"]), F.lit(""))
        return F.when(piece["lit"].isNotNull(), piece["lit"]).when(piece["var"].isNotNull(), F.coalesce(F.try_element_at(variables, piece["var"]), F.lit(""))).otherwise(group)

    def values_of(part: Column, variables: Column) -> Column:
        fn, pieces = part["fn"], part["pieces"]
        found = listed(F.get(pieces, F.lit(0)))
        first = F.coalesce(F.get(found, F.lit(0)), F.lit(""))
        text = F.array_join(F.transform(pieces, lambda p: F.when(p["sub"].isNotNull(), joined(listed(p))).otherwise(other(p, variables))), "")
        firsts = F.transform(pieces, lambda p: F.when(p["sub"].isNotNull(), F.coalesce(F.get(listed(p), F.lit(0)), F.lit(""))).otherwise(other(p, variables)))
        one, two = F.get(firsts, F.lit(0)), F.coalesce(F.get(firsts, F.lit(1)), F.lit(""))
        at = F.instr(one, two)
        before = F.when(at > 0, F.substr(one, F.lit(1), at - 1)).otherwise("")
        after = F.when(at > 0, F.substr(one, at + F.char_length(two))).otherwise("")
        blank = F.regexp_replace(text, r"\s+", "") == ""
        scalar = (
            F.when(fn == "count", F.size(found).cast("string")).when(fn == "length", F.char_length(first).cast("string"))
            .when(fn == "norm", F.trim(F.regexp_replace(first, r"\s+", " "))).when(fn == "concat", F.array_join(firsts, ""))
            .when(fn == "before", before).when(fn == "after", after).when(fn == "none", (F.size(found) == 0).cast("string"))
            .when(fn == "some", (F.size(found) > 0).cast("string")).otherwise(first)
        )
        values = F.when(fn == "list", found).when(fn == "get", F.array(text)).when(fn == "text", F.when(blank, empty).otherwise(F.array(text))).otherwise(F.array(scalar))
        return _apply_ops(values, part["ops"])

    def run(state: Column, program: Column) -> Column:
        joiner = program["joiner"]
        values = _combined(F.transform(program["parts"], lambda q, i: F.struct(i.alias("part"), joiner.alias("joiner"), values_of(q, state["vars"]).alias("values"))))
        kept = F.map_filter(state["vars"], lambda k, _: k != program["name"])
        written = F.map_concat(kept, F.create_map(program["name"], joined(values)))
        out = F.array(F.struct(program["name"].alias("field"), values.alias("values")))
        return F.struct(
            F.when(program["put"], written).otherwise(state["vars"]).alias("vars"),
            F.when(program["put"], state["outs"]).otherwise(F.concat(state["outs"], out)).alias("outs"),
        )

    done = rows.withColumn("done", F.aggregate("programs", start, run))
    variables = F.transform(
        F.map_entries(F.map_filter("done.vars", lambda k, _: k != rulesyntax.PAGE_ADDRESS)),
        lambda e: F.struct(F.concat(F.lit(_VARIABLE), e["key"]).alias("field"), F.array(e["value"]).alias("values")),
    )
    return done.select("page_id", "source_id", "item", F.explode(F.concat("done.outs", variables)).alias("o")).select(
        "page_id", "source_id", "item", "o.field", "o.values"
    ).where(F.size("values") > 0)


def joined_value(values: Column) -> Column:
    return lists.value_join(values)


def wide(values: DataFrame, keys: list[str], fields: list[str], value: Column) -> DataFrame:
    """One row per key with a column per field ('' where the rule found nothing)."""
    return values.where(F.col("field").isin(*fields)).withColumn("_v", value).groupBy(*keys).agg(
        *[F.coalesce(F.max(F.when(F.col("field") == f, F.col("_v"))), F.lit("")).alias(f) for f in fields]
    )


def with_defaults(rule_fields: DataFrame, grp: str, defaults: dict[str, str], owner: str) -> DataFrame:
    """Rules of a group plus default texts for fields a source leaves out (sources that have ``owner``)."""
    rows = rule_fields.where((F.col("grp") == grp) & (web_trim(F.col("rule")) != ""))
    out = rows
    owners = rows.where(F.col("field") == owner).select("source_id").dropDuplicates()
    for field, text in defaults.items():
        have = rows.where(F.col("field") == field).select("source_id")
        missing = owners.join(have, "source_id", "left_anti")
        out = out.unionByName(missing.select("source_id", F.lit(grp).alias("grp"), F.lit(field).alias("field"), F.lit(text).alias("rule")))
    return out
