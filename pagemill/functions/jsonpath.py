"""JSON paths over JSON text columns.

Values travel as JSON text, so key order and spelling of nested values stay as captured. Plain
paths are native; only recursive descent, whose hits must come in document order, goes through an
Arrow-batched function.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .text import web_trim


class UnsupportedRule(ValueError):
    """A rule uses something this library does not evaluate; it fails loudly instead of yielding nothing."""


_TOKEN = re.compile(
    r"""\.\.(?P<deep>\*|[\w$@-]+|(?=\[))
      | \.?\[(?P<inner>\?\(.*?\)|[^\]]*)\]
      | \.(?P<star>\*)
      | \.(?P<key>[\w$@-]+)""",
    re.X,
)
_FILTER = re.compile(r"^\?\(\s*@((?:\.[\w$-]+)*)\s*(?:(==|!=|>=|<=|>|<)\s*(.+?))?\s*\)$", re.S)


def path_steps(path: str) -> list[tuple]:
    """A literal path as (kind, argument…) steps."""
    text, at, steps = path.strip().removeprefix("$"), 0, []
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise UnsupportedRule(f"cannot read JSON path {path!r} at {text[at:]!r}")
        at = m.end()
        if m["deep"] is not None:
            steps.append(("deep", m["deep"] or "*"))
        elif m["star"]:
            steps.append(("all",))
        elif m["key"]:
            steps.append(("key", m["key"]))
        else:
            steps.append(_bracket(m["inner"].strip(), path))
    return steps


def _bracket(inner: str, path: str) -> tuple:
    if inner == "*":
        return ("all",)
    if re.fullmatch(r"-?\d+", inner):
        return ("index", int(inner))
    if re.fullmatch(r"-?\d*:-?\d*", inner):
        return ("slice", *[int(x) if x else None for x in inner.split(":")])
    if re.fullmatch(r"'.*'|\".*\"", inner):
        return ("key", inner[1:-1])
    m = _FILTER.match(inner)
    if not m or re.search(r"&&|\|\|", inner):
        raise UnsupportedRule(f"cannot read [{inner}] in JSON path {path!r}")
    literal = m[3]
    if literal is not None and re.fullmatch(r"'.*'|\".*\"", literal):
        literal = literal[1:-1]
    return ("filter", m[1], m[2], literal)


def _items(text: Column) -> Column:
    """Elements of a JSON array as JSON texts; NULL when the text is no array."""
    return F.when(web_trim(text).startswith("["), F.from_json(text, "array<string>"))


def _children(text: Column) -> Column:
    t = web_trim(text)
    return F.coalesce(
        F.when(t.startswith("["), F.from_json(t, "array<string>")).when(
            t.startswith("{"), F.map_values(F.from_json(t, "map<string,string>"))
        ),
        F.array().cast("array<string>"),
    )


def _field(text: Column, name: str) -> Column:
    quoted = name.replace("'", "\\'")
    return F.when(web_trim(text).startswith("{"), F.get_json_object(text, f"$['{quoted}']"))


def _keep(item: Column, keys: str, op: str | None, literal: str | None) -> Column:
    value = item
    for key in keys.split(".")[1:]:
        value = _field(value, key)
    if op is None:
        return value.isNotNull()
    if op in ("==", "!="):
        same = value == F.lit(literal)
        return F.coalesce(same if op == "==" else ~same, F.lit(False))
    left, right = value.try_cast("double"), F.lit(literal).try_cast("double")
    bad = value.isNotNull() & (left.isNull() | right.isNull())
    checked = F.when(bad, F.raise_error(F.lit(f"{op} needs numbers"))).otherwise(left)
    test = {">": checked > right, "<": checked < right, ">=": checked >= right, "<=": checked <= right}[op]
    return F.coalesce(test, F.lit(False))


def _native_step(values: Column, step: tuple) -> Column:
    kind = step[0]
    if kind == "key":
        out = F.transform(values, lambda v: _field(v, step[1]))
    elif kind == "index":
        at = step[1]
        out = F.transform(values, lambda v: F.try_element_at(_items(v), F.lit(at if at < 0 else at + 1)))
    elif kind == "all":
        out = F.flatten(F.transform(values, _children))
    elif kind == "slice":
        def cut(v: Column) -> Column:
            items = F.coalesce(_items(v), F.array().cast("array<string>"))
            n = F.size(items)

            def end(i: int | None, default: Column) -> Column:
                if i is None:
                    return default
                return F.greatest(n + i, F.lit(0)) if i < 0 else F.least(F.lit(i), n)

            start, stop = end(step[1], F.lit(0)), end(step[2], n)
            return F.slice(items, start + 1, F.greatest(stop - start, F.lit(0)))

        out = F.flatten(F.transform(values, cut))
    else:
        _, keys, op, literal = step

        def matching(v: Column) -> Column:
            candidates = F.coalesce(_items(v), F.array(v))
            objects = F.filter(candidates, lambda x: web_trim(x).startswith("{"))
            return F.filter(objects, lambda x: _keep(x, keys, op, literal))

        out = F.flatten(F.transform(values, matching))
    return F.filter(out, lambda v: v.isNotNull())


def deep_texts(texts, name: str) -> list[str]:
    """What a recursive descent to ``name`` hits in JSON texts, in document order."""
    def walk(node, out):
        children = node if isinstance(node, list) else None
        if children is not None:
            for child in children:
                walk(child, out)
        elif isinstance(node, dict):
            for key, child in node.items():
                if name in ("*", key):
                    out.append(child)
                walk(child, out)

    def text(value):
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))

    out: list = []
    for t in texts if texts is not None else ():
        try:
            walk(json.loads(t), out)
        except ValueError:
            continue
    return [text(v) for v in out if v is not None]


def _deep_function(name: str):
    @F.pandas_udf("array<string>")
    def deep(values: pd.Series) -> pd.Series:
        return values.map(lambda texts: deep_texts(texts, name))

    return deep


def json_values(c: Column, path: str) -> Column:
    """ARRAY<STRING> of everything ``path`` hits; text that is no JSON has no hits."""
    doc = F.when(F.try_parse_json(c).isNotNull(), c)
    values = F.filter(F.array(doc), lambda v: v.isNotNull())
    deep_seen = False
    for step in path_steps(path):
        if step[0] == "deep":
            values, deep_seen = _deep_function(step[1])(values), True
        else:
            values = _native_step(values, step)
            if step[0] == "filter" and deep_seen:
                values = F.array_distinct(values)
    return values


# --- paths as data --------------------------------------------------------------------------------
STEP = "struct<kind:string,name:string,start:int,stop:int,op:string,literal:string,distinct:boolean>"


def path_rows(path: str) -> list[dict]:
    """The steps of a literal path as STEP data, for paths that differ by row."""
    out, deep_seen = [], False
    for kind, *given in path_steps(path):
        row = dict(kind=kind, name=None, start=None, stop=None, op=None, literal=None, distinct=False)
        if kind in ("key", "deep"):
            row["name"] = given[0]
        elif kind == "index":
            row["start"] = given[0]
        elif kind == "slice":
            row["start"], row["stop"] = given
        elif kind == "filter":
            keys, row["op"], row["literal"] = given
            row["name"], row["distinct"] = "$" + "".join(f"['{k}']" for k in keys.split(".")[1:]), deep_seen
            if row["op"] in (">", "<", ">=", "<="):
                try:
                    float(row["literal"])
                except ValueError:
                    raise UnsupportedRule(f"{row['op']} needs a number in JSON path {path!r}") from None
        deep_seen = deep_seen or kind == "deep"
        out.append(row)
    return out


def _data_step(values: Column, step: Column) -> Column:
    """One step of a path given as data; ``deep`` is not among them."""
    kind, name, start, stop = step["kind"], step["name"], step["start"], step["stop"]
    none = F.array().cast("array<string>")

    def field(v: Column) -> Column:
        inner = F.concat(F.lit("$['"), F.replace(name, F.lit("'"), F.lit("\\'")), F.lit("']"))
        return F.when(web_trim(v).startswith("{"), F.call_function("get_json_object", v, inner))

    def cut(v: Column) -> Column:
        items = F.coalesce(_items(v), none)
        n = F.size(items)
        from_, to = (F.when(i < 0, F.greatest(n + i, F.lit(0))).otherwise(F.least(i, n)) for i in (F.coalesce(start, F.lit(0)), F.coalesce(stop, n)))
        return F.slice(items, from_ + 1, F.greatest(to - from_, F.lit(0)))

    def keep(x: Column) -> Column:
        value = F.call_function("get_json_object", x, name)
        left, right, op, literal = value.try_cast("double"), step["literal"].try_cast("double"), step["op"], step["literal"]
        test = (
            F.when(op.isNull(), value.isNotNull()).when(op == "==", value == literal).when(op == "!=", value != literal)
            .when(op == ">", left > right).when(op == "<", left < right).when(op == ">=", left >= right).otherwise(left <= right)
        )
        return F.coalesce(test, F.lit(False))

    def matching(v: Column) -> Column:
        return F.filter(F.coalesce(_items(v), F.array(v)), lambda x: web_trim(x).startswith("{") & keep(x))

    at = F.when(start < 0, start).otherwise(start + 1)
    found = F.flatten(F.transform(values, matching))
    out = (
        F.when(kind == "key", F.transform(values, field))
        .when(kind == "index", F.transform(values, lambda v: F.try_element_at(_items(v), at)))
        .when(kind == "all", F.flatten(F.transform(values, _children)))
        .when(kind == "slice", F.flatten(F.transform(values, cut)))
        .otherwise(F.when(step["distinct"], F.array_distinct(found)).otherwise(found))
    )
    return F.filter(out, lambda v: v.isNotNull())


@F.pandas_udf(ArrayType(StringType()))
def _deep_hits(values: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([deep_texts(v, name) if v is not None else None for v, name in zip(values, names)], dtype="object")


# Computed once, in its own step: filters and explodes on its result never take it in.
_deep_hits = _deep_hits.asNondeterministic()


def with_json_values(rows: DataFrame, text: str, path: str, deep_at: list[int]) -> DataFrame:
    """+ ``values``: everything the STEP array in column ``path`` hits in the JSON text of column ``text``.

    ``deep_at``: places in the paths at which some row has a recursive descent. A text that is no JSON
    has no hits; an ordered comparison with a value that is no number does not hold.
    """
    doc = F.when(F.get_json_object(text, "$").isNotNull(), F.col(text))
    out, done = rows.withColumn("values", F.filter(F.array(doc), lambda v: v.isNotNull())), 0

    def native(begin: int, length: int | None) -> Column:
        steps = F.slice(path, begin + 1, length if length is not None else 1 << 30)
        return F.aggregate(steps, F.col("values"), _data_step)

    for k in sorted(deep_at):
        out = out.withColumn("values", native(done, k - done))
        step = F.get(F.col(path), F.lit(k))
        is_deep = F.coalesce(step["kind"] == "deep", F.lit(False))
        out = out.withColumn("_deep", _deep_hits(F.when(is_deep, F.col("values")), step["name"])).withColumn(
            "values", F.when(is_deep, F.col("_deep")).otherwise(native(k, 1))
        ).drop("_deep")
        done = k + 1
    return out.withColumn("values", native(done, None))


def json_items(values: Column) -> Column:
    """Items of a list rule: hits that are arrays are taken apart without their nulls."""
    each = F.transform(values, lambda v: F.coalesce(F.filter(_items(v), lambda x: x.isNotNull()), F.array(v)))
    return F.flatten(each)


def is_json_content(c: Column) -> Column:
    """Content that is a JSON object or array."""
    return web_trim(c).rlike(r"^[\[{]") & F.try_parse_json(c).isNotNull()


def json_bare_field(c: Column, name: str) -> Column:
    """A bare word on JSON content means the field of that name; NULL on other content."""
    if not re.fullmatch(r"[A-Za-z_][\w-]*", name):
        return F.lit(None).cast("string")
    return F.when(is_json_content(c), F.get_json_object(c, f"$['{name}']"))


def json_list_items(c: Column) -> Column:
    """Items of a list value: a JSON array is taken apart without its nulls, other text is one item."""
    items = F.when(web_trim(c).startswith("[") & F.try_parse_json(c).isNotNull(), _items(c))
    return F.when(items.isNotNull(), F.filter(items, lambda v: v.isNotNull())).otherwise(F.array(c))
