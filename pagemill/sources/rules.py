"""Rule records: reading files and dumps, validating, importing, rule texts as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import web_trim
from ..operators.library import merge_upsert
from ..operators.skew import keep_first

# --- fixed values -----------------------------------------------------------------------------
MAX_PER_IMPORT = 1000
MAX_NAME = 200
MAX_URL = 512
MAX_PAYLOAD_BYTES = 256 * 1024
RULE_GROUPS = ("ruleSearch", "ruleBookInfo", "ruleToc", "ruleContent", "ruleExplore")
URL_FIELDS = ("searchUrl", "exploreUrl")
SCRIPT_FIELDS = ("jsLib", "loginUrl")
NOT_RULES = ("replaceRegex", "imageDecode")
# ----------------------------------------------------------------------------------------------


class RuleFileError(ValueError):
    """``invalid_json``, ``invalid_shape``, ``empty_import`` or ``too_many_sources``."""


def rule_records(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents that hold a rule list (bare array or ``{"sources": […]}``) as record rows.

    Returns every document column but the text, plus ord, payload, error; a document that is no
    rule list is one row with its error.
    """
    json = web_trim(F.col(text))
    valid = F.try_parse_json(json).isNotNull()
    wrapped = F.get_json_object(json, "$.sources")
    listed = F.when(json.startswith("["), json).when(web_trim(wrapped).startswith("["), wrapped)
    error = F.when(~valid, "invalid_json").when(listed.isNull(), "invalid_shape").when(
        F.regexp_replace(listed, r"\s", "") == "[]", "empty_import"
    )
    rest = [c for c in docs.columns if c != text]
    # Elements stay JSON texts; the variant tells an object from a string that looks like one.
    rows = docs.select(*rest, error.alias("error"), F.from_json(listed, "array<string>").alias("items"))
    bad = rows.where(F.col("error").isNotNull()).select(
        *rest, F.lit(None).cast("int").alias("ord"), F.lit(None).cast("string").alias("payload"), "error"
    )
    good = rows.where(F.col("error").isNull()).select(
        *rest, F.posexplode("items").alias("ord", "payload"), F.lit(None).cast("string").alias("error")
    )
    return good.unionByName(bad)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rule files under a path, one document each: file, ord, payload, error."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return rule_records(files)


def rule_dump_records(docs: DataFrame, text: str = "text") -> DataFrame:
    """Exported dumps as record rows: flat rows with ``payload``, grouped ``results[].payload``, or bare records.

    Anything before the first bracket (a console banner) is skipped.
    """
    json = F.regexp_extract(F.col(text), r"(?s)(\[.*)$", 1)
    rest = [c for c in docs.columns if c != text]
    rows = docs.select(*rest, F.posexplode(F.from_json(json, "array<string>")).alias("row", "item"))
    flat = F.get_json_object("item", "$.payload")
    grouped = F.from_json(F.get_json_object("item", "$.results"), "array<string>")
    nested = F.transform(grouped, lambda r: F.get_json_object(r, "$.payload"))
    readable = flat.isNotNull() & F.try_parse_json(flat).isNotNull()
    payloads = F.when(readable, F.array(flat)).when(grouped.isNotNull(), nested).otherwise(F.array("item"))
    out = rows.select(*rest, "row", F.posexplode(payloads).alias("at", "payload"))
    return out.where(F.col("payload").isNotNull() & web_trim(F.col("payload")).startswith("{"))


def read_rule_dump(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return rule_dump_records(files)


def _is_address(url: Column) -> Column:
    """A scheme, and behind a web scheme a usable host."""
    web = url.rlike(r"(?i)^(?:https?|ftp|wss?):")
    hosted = url.rlike(r"(?i)^(?:https?|ftp|wss?):[/\\]*[^/?#\\\s<>^|%]+(?:[/?#\\]|$)")
    return url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") & (~web | hosted)


def validate_rules(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``records``: ord, payload (plus other columns) → (accepted, rejected with name and reason)."""
    def text_of(name: str) -> Column:
        value = F.from_json("payload", f"struct<{name}:variant>")[name]
        return F.when(
            F.schema_of_variant(value) == "STRING", web_trim(F.try_variant_get(value, "$", "string"))
        ).otherwise("")

    is_object = web_trim(F.col("payload")).startswith("{") & F.try_parse_json("payload").isNotNull()
    rows = records.withColumn("_object", F.coalesce(is_object, F.lit(False)))
    rows = rows.withColumn("name", F.when(F.col("_object"), text_of("bookSourceName")).otherwise(""))
    rows = rows.withColumn("url", F.when(F.col("_object"), text_of("bookSourceUrl")).otherwise(""))
    name, url = F.coalesce("name", F.lit("")), F.coalesce("url", F.lit(""))
    size = F.octet_length("payload")
    reason = (
        F.when(~F.col("_object"), "not an object")
        .when(name == "", "bookSourceName is missing")
        .when(url == "", "bookSourceUrl is missing")
        .when(F.length(name) > MAX_NAME, f"bookSourceName is over {MAX_NAME} characters")
        .when(F.length(url) > MAX_URL, f"bookSourceUrl is over {MAX_URL} characters")
        .when(~_is_address(url), F.concat(F.lit("bookSourceUrl is no address: "), url))
        .when(~url.rlike("(?i)^https?:"), F.concat(F.lit("only http and https, not "), F.lower(F.regexp_extract(url, "^[^:]+:", 0))))
        .when(size > MAX_PAYLOAD_BYTES, F.concat(F.round(size / 1024).cast("bigint").cast("string"), F.lit(" KB is over the limit")))
    )
    row_label = F.concat(F.lit("row "), (F.col("ord") + 1).cast("string"))
    label = F.when(~F.col("_object") | (name == ""), row_label).otherwise(
        F.when(F.length(name) > MAX_NAME, F.substring(name, 1, 40)).otherwise(name)
    )
    rows = rows.withColumn("reason", reason)
    rejected = rows.where(F.col("reason").isNotNull()).select("ord", label.alias("name"), "reason")
    flags = F.from_json("payload", "struct<bookSourceGroup:string, enabled:variant>")
    enabled = F.coalesce(F.try_variant_get(flags["enabled"], "$", "string"), F.lit("")) != "false"
    accepted = rows.where(F.col("reason").isNull()).select(
        "ord", F.concat(F.lit("user:"), url).alias("id"), "name", "url",
        F.coalesce(flags["bookSourceGroup"], F.lit("")).alias("group_name"), enabled.alias("enabled"), "payload",
    )
    return accepted, rejected


def import_rules(target: DataFrame, accepted: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Upsert by id: (registry, report, rejected duplicates).

    The first of several records of one address counts; what is known keeps its name, group and
    switch and only gets the new record.
    """
    stamped = F.lit(now).cast("bigint")
    first = keep_first(accepted, ["id"], [F.col("ord")])
    incoming = first.select(
        "id", "name", "url", "group_name", "enabled", F.col("ord").cast("int").alias("sort_order"), "payload",
        stamped.alias("created_at"), stamped.alias("updated_at"),
    )
    merged, counts = merge_upsert(target, incoming, ["id"], ["payload", "updated_at"], [F.col("sort_order")])
    kept = first.select("id", F.col("ord").alias("first_ord"))
    repeats = accepted.join(kept, "id").where(F.col("ord") > F.col("first_ord")).select(
        "ord", "name", F.lit("address repeated in this batch").alias("reason")
    )
    return merged, counts, repeats


# --- rule texts as rows -------------------------------------------------------------------------
def rule_fields(sources: DataFrame) -> DataFrame:
    """``sources``: id, payload → source_id, grp, field, rule: every rule text of a record.

    Script fields (``…Js``) and the two cleaning fields are no rules; the url templates count too.
    """
    schema = ", ".join([f"{g} map<string,string>" for g in RULE_GROUPS] + [f"{u} string" for u in URL_FIELDS])
    parsed = sources.select(F.col("id").alias("source_id"), F.from_json("payload", schema).alias("p"))
    groups = F.array(*[
        F.struct(F.lit(g).alias("grp"), F.col(f"p.{g}").alias("fields")) for g in RULE_GROUPS
    ], F.struct(F.lit("").alias("grp"), F.map_from_arrays(
        F.array(*[F.lit(u) for u in URL_FIELDS]), F.array(*[F.col(f"p.{u}") for u in URL_FIELDS])
    ).alias("fields")))
    rows = parsed.select("source_id", F.explode(groups).alias("g")).select(
        "source_id", "g.grp", F.explode("g.fields").alias("field", "rule")
    )
    is_rule = F.col("rule").isNotNull() & ~F.col("field").rlike("Js$") & ~F.col("field").isin(*NOT_RULES)
    return rows.where(is_rule & ((F.col("grp") != "") | (F.col("rule") != "")))


def script_texts(sources: DataFrame) -> DataFrame:
    """``sources``: id, payload → source_id, path, text: everything that may hold script code."""
    names = SCRIPT_FIELDS + URL_FIELDS
    schema = ", ".join([f"{g} map<string,string>" for g in RULE_GROUPS] + [f"{u} string" for u in names])
    parsed = sources.select(F.col("id").alias("source_id"), F.from_json("payload", schema).alias("p"))
    parts = F.array(*[
        F.struct(F.lit(f"{g}.").alias("prefix"), F.col(f"p.{g}").alias("fields")) for g in RULE_GROUPS
    ], F.struct(F.lit("").alias("prefix"), F.map_from_arrays(
        F.array(*[F.lit(u) for u in names]), F.array(*[F.col(f"p.{u}") for u in names])
    ).alias("fields")))
    rows = parsed.select("source_id", F.explode(parts).alias("g")).select(
        "source_id", "g.prefix", F.explode("g.fields").alias("field", "text")
    )
    return rows.where(F.coalesce("text", F.lit("")) != "").select(
        "source_id", F.concat("prefix", "field").alias("path"), "text"
    )
