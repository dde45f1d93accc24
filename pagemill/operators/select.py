"""Selecting nodes: steps as data, joined with the node table.

A *run* is one evaluation of one rule part from one start node. Runs travel as rows
(page_id, run, steps, node_id, ord); every round takes the next step of all runs of all rules at
once, so the number of rounds is the longest rule, not the number of rules.

Descendants are found over each node's list of ancestors, as an equality on (page_id, ancestor,
term); pairs that cannot match are never formed. Nodes are looked up by their rarest key (id, else
class, else tag). A page is bounded in size, and so is everything grouped by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rulesyntax
from ..functions.lists import is_index_spec, picked_positions
from ..functions.text import web_trim
from ..session import broadcast_if_small, by_page, stored
from .nodes import NUL, SPANS

_WS = r"[ \t\n\f\r]+"


def _class_list(attrs: Column) -> Column:
    return F.split(F.trim(F.coalesce(F.try_element_at(attrs, F.lit("class")), F.lit(""))), _WS)


def _terms(tag: Column, attrs: Column) -> Column:
    """Keys a node can be looked up by."""
    classes = F.transform(F.filter(_class_list(attrs), lambda c: c != ""), lambda c: F.concat(F.lit("."), c))
    ident = F.try_element_at(attrs, F.lit("id"))
    return F.array_distinct(
        F.concat(
            F.array(F.lit("*"), tag),
            F.when(ident.isNotNull(), F.array(F.concat(F.lit("#"), ident))).otherwise(F.array().cast("array<string>")),
            classes,
        )
    )


def _term_of(step: Column) -> Column:
    return (
        F.when(step["id"].isNotNull(), F.concat(F.lit("#"), step["id"]))
        .when(F.size(step["classes"]) > 0, F.concat(F.lit("."), step["classes"][0]))
        .when(step["tag"].isNotNull(), step["tag"])
        .otherwise("*")
    )


# What a run keeps of the node it stands on: enough to go on from it and to read its values.
NODE_COLUMNS = ("parent_id", "sib_ord", "attrs", *SPANS)


# What a test can ask of the node it is put to, beside those.
HIT_COLUMNS = ("tag", "sib_n", "like_ord", "like_n", "flags")


def edges(nodes: DataFrame, terms: DataFrame, parents: bool = False, selves: bool = False) -> DataFrame:
    """Every element under each of its ancestors, by lookup key; only keys some step asks for.

    ``terms``: the distinct keys of the steps. With ``parents`` also every element under its child,
    by the key ``^``, and with ``selves`` under itself, by the key ``=``. ``nodes`` have the column ``flags`` (see ``flagged``).
    """
    elements = nodes.where("node_id > 0").select(
        "page_id", "node_id", "anc", *HIT_COLUMNS, *NODE_COLUMNS, F.explode(_terms(F.col("tag"), F.col("attrs"))).alias("term")
    )
    hit = F.struct("node_id", *HIT_COLUMNS, *NODE_COLUMNS).alias("hit")
    out = elements.join(terms, "term", "left_semi").select("page_id", F.explode("anc").alias("anc_id"), "term", hit)
    if parents:
        above = nodes.where("node_id > 0").select("page_id", F.col("node_id").alias("parent_id"), hit)
        up = nodes.select("page_id", F.col("node_id").alias("anc_id"), "parent_id").join(above, ["page_id", "parent_id"])
        out = out.unionByName(up.select("page_id", "anc_id", F.lit("^").alias("term"), "hit"))
    if selves:
        out = out.unionByName(nodes.where("node_id > 0").select("page_id", F.col("node_id").alias("anc_id"), F.lit("=").alias("term"), hit))
    return out


def with_nodes(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows with page_id and node_id plus the NODE_COLUMNS of their nodes."""
    return rows.join(nodes.select("page_id", "node_id", *NODE_COLUMNS), ["page_id", "node_id"])


def own_texts(nodes: DataFrame) -> DataFrame:
    return nodes.select("page_id", "node_id", "own_text")


def page_texts(nodes: DataFrame) -> DataFrame:
    return nodes.where("node_id = 0").select("page_id", "page_text")


def _attr_holds(attrs: Column, test: Column) -> Column:
    have, want, op = F.try_element_at(attrs, test["name"]), test["value"], test["op"]
    return F.coalesce(
        F.when(op == "has", have.isNotNull())
        .when(op == "=", have == want)
        .when(op == "!=", have.isNotNull() & (have != want))
        .when(op == "^=", (want != "") & have.startswith(want))
        .when(op == "$=", (want != "") & have.endswith(want))
        .when(op == "*=", (want != "") & have.contains(want))
        .when(op == "~=", F.array_contains(F.split(have, _WS), want))
        .when(op == "|=", (have == want) | have.startswith(F.concat(want, F.lit("-")))),
        F.lit(False),
    )


def _matches(step: Column, tag: Column, attrs: Column) -> Column:
    ident = F.try_element_at(attrs, F.lit("id"))
    return (
        F.coalesce(tag == step["tag"], step["tag"].isNull())
        & F.when(step["id"].isNull(), F.lit(True)).otherwise(F.coalesce(ident == step["id"], F.lit(False)))
        & F.when(F.size(step["classes"]) < 1, F.lit(True)).otherwise(
            F.size(F.array_except(step["classes"], _class_list(attrs))) == 0
        )
        & F.forall(step["attrs"], lambda t: _attr_holds(attrs, t))
    )


def _nth_holds(a: Column, b: Column, place: Column) -> Column:
    """Whether ``place`` (from 1) is a n + b for some n from 0."""
    return F.when(a == 0, place == b).otherwise(((place - b) * F.signum(a) >= 0) & (F.pmod(place - b, F.abs(a)) == 0))


def _test_holds(t: Column, hit: dict[str, Column]) -> Column:
    """One test of a clause put to a node; ``below``, ``own``, ``place`` and ``size`` where steps ask for them."""
    none, number = F.lit(None), F.lit(None).cast("int")
    below, own = hit.get("below", none.cast("string")), hit.get("own", none.cast("string"))
    place, size = hit.get("place", number), hit.get("size", number)
    text = F.when(t["name"] == "own", own).when(t["name"] == "norm", F.trim(F.regexp_replace(below, _WS, " "))).otherwise(below)
    text_holds = F.when(t["op"] == "*=", text.contains(t["value"])).when(t["op"] == "^=", text.startswith(t["value"])).otherwise(text == t["value"])
    wanted = F.when(t["name"] == "last", size - t["a"]).otherwise(t["a"])
    place_holds = (
        F.when(t["op"] == "<", place < wanted).when(t["op"] == "<=", place <= wanted).when(t["op"] == ">", place > wanted)
        .when(t["op"] == ">=", place >= wanted).when(t["op"] == "!=", place != wanted).otherwise(place == wanted)
    )
    nth = (
        F.when(t["name"] == "child", hit["sib_ord"] + 1).when(t["name"] == "last-child", hit["sib_n"] - hit["sib_ord"])
        .when(t["name"] == "type", hit["like_ord"] + 1).otherwise(hit["like_n"] - hit["like_ord"])
    )
    holds = (
        F.when(t["kind"] == "tag", hit["tag"] == t["value"])
        .when(t["kind"] == "id", F.try_element_at(hit["attrs"], F.lit("id")) == t["value"])
        .when(t["kind"] == "class", F.array_contains(_class_list(hit["attrs"]), t["value"]))
        .when(t["kind"] == "attr", _attr_holds(hit["attrs"], t))
        .when(t["kind"] == "text", text_holds).when(t["kind"] == "nth", _nth_holds(t["a"], t["b"], nth))
        .when(t["kind"] == "place", place_holds).when(t["kind"] == "has", F.array_contains(hit["flags"], t["value"]))
    )
    return F.coalesce(holds, F.lit(False)) != t["no"]


def _clauses_hold(clauses: Column, hit: dict[str, Column]) -> Column:
    return F.coalesce(F.forall(clauses, lambda c: F.exists(c, lambda t: _test_holds(t, hit))), F.lit(True))


def _asks_text(clauses: Column) -> Column:
    return F.exists(clauses, lambda c: F.exists(c, lambda t: t["kind"] == "text"))


def _asks_below(clauses: Column) -> Column:
    return F.exists(clauses, lambda c: F.exists(c, lambda t: t["kind"] == "has"))


def _hit(prefix: str = "hit.", **more: Column) -> dict[str, Column]:
    return {c: F.col(prefix + c) for c in (*HIT_COLUMNS, "attrs", "sib_ord")} | more


def _between(text: Column, start: Column, end: Column) -> Column:
    return F.substr(text, start + 1, end - start)


def _keep_by_text(nodes: DataFrame, hits: DataFrame, run: list[str]) -> DataFrame:
    """Steps that ask for text: ``contains`` in the subtree; ``own`` in the node itself, else anywhere below; clauses."""
    below = F.replace(_between(F.col("page_text"), F.col("hit.text_start"), F.col("hit.text_end")), F.lit(NUL), F.lit(""))
    strict = F.coalesce(F.replace(F.col("own_text"), F.lit(NUL), F.lit("")).contains(F.col("step.own")), F.lit(False))
    loose = F.coalesce(below.contains(F.coalesce("step.own", "step.contains")), F.lit(False))
    asks = F.col("step.own").isNotNull() | F.col("step.contains").isNotNull()
    context = Window.partitionBy("page_id", *run, "seg", "node_id")
    held = _clauses_hold(F.col("step.clauses"), _hit(below=below, own=F.replace(F.col("own_text"), F.lit(NUL), F.lit(""))))
    return (
        hits.join(page_texts(nodes), "page_id")
        .withColumn("hit_id", F.col("hit.node_id"))
        .join(own_texts(nodes).withColumnRenamed("node_id", "hit_id"), ["page_id", "hit_id"])
        .where(F.col("step").isNull() | held)
        .withColumn("strict", strict).withColumn("loose", loose).drop("page_text", "own_text", "hit_id")
        .withColumn("any_strict", F.max("strict").over(context))
        .where(
            F.when(~asks | F.col("step").isNull(), F.lit(True))
            .when(F.col("step.own").isNotNull() & F.col("any_strict"), F.col("strict")).otherwise(F.col("loose"))
        )
        .drop("strict", "loose", "any_strict")
    )


def _in_position(pos: Column, place: Column, size: Column) -> Column:
    """XPath positions count the hits of one parent."""
    number = F.regexp_extract(pos, r"(\d+)$", 1).try_cast("int")
    return (
        F.when(pos.isNull(), F.lit(True))
        .when(pos == "last", place == size)
        .when(pos.startswith("last-"), place == size - number)
        .when(pos.startswith("<="), place <= number)
        .when(pos.startswith(">="), place >= number)
        .when(pos.startswith("<"), place < number)
        .when(pos.startswith(">"), place > number)
        .otherwise(place == number)
    )


class StepShapes:
    """What the rules at hand need, so that plans leave out what none of them uses."""

    FLAGS = ("siblings", "parents", "selves", "texts", "positions", "picks", "clauses", "below")

    def __init__(self, longest: int, **flags: bool):
        self.longest = longest
        for name in self.FLAGS:
            setattr(self, name, bool(flags.get(name)))

    @staticmethod
    def of_steps(steps: list[dict]) -> "StepShapes":
        axes = {s["axis"] for s in steps}
        kinds = {t["kind"] for s in steps for c in (*s["clauses"], *s["late"]) for t in c}
        return StepShapes(
            len(steps), siblings=axes & {"next", "later", "earlier"}, parents="parent" in axes, selves="self" in axes,
            texts=any(s["own"] or s["contains"] for s in steps) or "text" in kinds, positions=any(s["pos"] or s["late"] for s in steps),
            picks=any(s["pick"] for s in steps), clauses=any(s["clauses"] for s in steps), below="has" in kinds,
        )

    @staticmethod
    def aggregates() -> list[Column]:
        """The same from a rules table with ``steps`` arrays, as aggregate columns."""
        tests = {
            "siblings": lambda s: s["axis"].isin("next", "later", "earlier"), "parents": lambda s: s["axis"] == "parent", "selves": lambda s: s["axis"] == "self",
            "texts": lambda s: s["own"].isNotNull() | s["contains"].isNotNull() | _asks_text(s["clauses"]) | _asks_text(s["late"]),
            "positions": lambda s: s["pos"].isNotNull() | (F.size(s["late"]) > 0), "picks": lambda s: s["pick"].isNotNull(),
            "clauses": lambda s: F.size(s["clauses"]) > 0, "below": lambda s: _asks_below(s["clauses"]) | _asks_below(s["late"]),
        }
        return [F.max(F.size("steps")).alias("longest"), *[F.bool_or(F.exists("steps", t)).alias(n) for n, t in tests.items()]]

    @staticmethod
    def of_row(row) -> "StepShapes":
        return StepShapes(row["longest"] or 0, **{n: row[n] for n in StepShapes.FLAGS})


def flagged(nodes: DataFrame, rules: DataFrame | list[dict], shapes: StepShapes) -> DataFrame:
    """The nodes with ``flags``: the conditions on nodes below that hold for them.

    A condition is a selection as data (``value`` of tests of kind ``has``). It is read backwards: nodes
    that its last step fits, then up or sideways to the nodes each step may start from. ``rules``: a
    table with ``steps``, or literal steps. Each condition of all rules is evaluated once.
    """
    empty = F.array().cast("array<string>")
    if not shapes.below:
        return nodes.withColumn("flags", empty)
    spark = nodes.sparkSession
    if isinstance(rules, list):
        texts = {t["value"] for s in rules for c in (*s["clauses"], *s["late"]) for t in c if t["kind"] == "has"}
        wanted = spark.createDataFrame([(t,) for t in sorted(texts)], "has string")
    else:
        tests = F.flatten(F.flatten(F.transform("steps", lambda s: F.concat(s["clauses"], s["late"]))))
        wanted = rules.select(F.explode(F.transform(F.filter(tests, lambda t: t["kind"] == "has"), lambda t: t["value"])).alias("has")).dropDuplicates()
    ways = wanted.select("has", F.explode(F.from_json("has", f"array<array<{rulesyntax.STEP}>>")).alias("way")).withColumn("at", F.size("way") - 1)
    ways = stored(ways, "conditions")
    longest = (ways.agg(F.max("at").alias("n")).first().n or 0) + 1
    texted = ways.agg(F.bool_or(F.exists("way", lambda s: s["contains"].isNotNull() | _asks_text(s["clauses"]))).alias("t")).first().t
    elements = nodes.where("node_id > 0").withColumn("flags", empty)
    here = F.struct("node_id", "anc", *HIT_COLUMNS, *NODE_COLUMNS).alias("hit")

    def fitting(rows: DataFrame) -> DataFrame:
        """Rows (has, way, at, page_id, hit) whose node fits the step they stand at."""
        step = F.get("way", F.col("at"))
        kept = rows.where(_matches(step, F.col("hit.tag"), F.col("hit.attrs")))
        more = {}
        if texted:
            kept = kept.withColumn("node_id", F.col("hit.node_id")).join(page_texts(nodes), "page_id").join(own_texts(nodes), ["page_id", "node_id"])
            below = F.replace(_between(F.col("page_text"), F.col("hit.text_start"), F.col("hit.text_end")), F.lit(NUL), F.lit(""))
            more = dict(below=below, own=F.replace(F.col("own_text"), F.lit(NUL), F.lit("")))
            kept = kept.where(F.coalesce(below.contains(step["contains"]), step["contains"].isNull()))
        return kept.where(_clauses_hold(step["clauses"], _hit(**more))).select("has", "way", "at", "page_id", "hit")

    keyed = elements.select("page_id", here, F.explode(_terms(F.col("tag"), F.col("attrs"))).alias("term"))
    first = ways.withColumn("term", _term_of(F.get("way", F.col("at"))))
    current = fitting(keyed.join(broadcast_if_small(first), "term"))
    found = []
    for _ in range(longest):
        axis = F.get("way", F.col("at"))["axis"]
        up = current.select(
            "has", "way", (F.col("at") - 1).alias("at"), "page_id", axis.alias("axis"), "hit.sib_ord", "hit.parent_id",
            F.explode(F.when(axis == "desc", F.col("hit.anc")).otherwise(F.array("hit.parent_id"))).alias("to"),
        )
        level = up.where(F.col("axis").isin("desc", "child")).select("has", "way", "at", "page_id", F.col("to").alias("node_id"))
        beside = up.where(F.col("axis").isin("next", "later")).join(
            nodes.select("page_id", F.col("parent_id").alias("to"), "node_id", F.col("sib_ord").alias("before")), ["page_id", "to"]
        ).where(F.when(F.col("axis") == "next", F.col("before") == F.col("sib_ord") - 1).otherwise(F.col("before") < F.col("sib_ord")))
        moved = level.unionByName(beside.select("has", "way", "at", "page_id", "node_id")).dropDuplicates(["has", "way", "at", "page_id", "node_id"])
        found.append(moved.where("at < 0").select("page_id", "node_id", "has"))
        rest = moved.where("at >= 0").join(elements.select("page_id", "node_id", here), ["page_id", "node_id"])
        current = fitting(rest.drop("node_id"))
    held = found[0]
    for more in found[1:]:
        held = held.unionByName(more)
    flags = held.groupBy("page_id", "node_id").agg(F.collect_set("has").alias("flags"))
    return stored(nodes.join(flags, ["page_id", "node_id"], "left").withColumn("flags", F.coalesce("flags", empty)), "flagged-nodes")


def run_steps(nodes: DataFrame, runs: DataFrame, run: list[str], terms: DataFrame, shapes: StepShapes) -> DataFrame:
    """All runs to their end: page_id, *run, node_id, ord (place in the run's result list), NODE_COLUMNS.

    ``nodes`` come from ``flagged``.

    ``runs``: page_id, *run, node_id, ord, steps, NODE_COLUMNS. A run that has no step left stays as
    it is, so every round is one join whatever the lengths of the rules.
    """
    # Partitioned by page once, the joins and windows of all rounds need no further shuffle.
    candidates = by_page(edges(nodes, terms, shapes.parents, shapes.selves))
    keys = ["page_id", *run]
    kinds = {f.name: f.dataType for f in nodes.schema.fields}
    here = F.struct("node_id", *[F.lit(None).cast(kinds[c]).alias(c) for c in HIT_COLUMNS], *NODE_COLUMNS)
    current = by_page(runs.select(*keys, "node_id", "ord", F.col("ord").alias("seg"), "steps", *NODE_COLUMNS))
    for k in range(shapes.longest):
        axis = F.col("step.axis")
        sideways = axis.isin("next", "later", "earlier")
        going = (
            current.withColumn("step", F.get("steps", F.lit(k)))
            .withColumn("seg", F.when(F.col("step").isNull() | F.col("step.start"), F.col("ord")).otherwise(F.col("seg")))
            .withColumn("term", F.when(axis == "parent", "^").when(axis == "self", "=").when(F.col("step").isNotNull(), _term_of(F.col("step"))))
            .withColumn("anc_id", F.when(sideways, F.col("parent_id")).otherwise(F.col("node_id")))
        )
        joined = going.join(candidates, ["page_id", "anc_id", "term"], "left")
        side = F.col("hit.sib_ord") - F.col("sib_ord")
        placed_right = (
            F.when(axis == "child", F.col("hit.parent_id") == F.col("anc_id"))
            .when(sideways, (F.col("hit.parent_id") == F.col("anc_id")) & F.when(axis == "next", side == 1).when(axis == "later", side > 0).otherwise(side < 0))
            .otherwise(True)
        )
        found = F.col("hit").isNotNull() & placed_right & _matches(F.col("step"), F.col("hit.tag"), F.col("hit.attrs"))
        hits = joined.withColumn("hit", F.when(F.col("step").isNull(), here).otherwise(F.col("hit"))).where(
            F.col("step").isNull() | found
        ).select(*keys, "seg", "steps", "step", "node_id", "hit")
        if shapes.texts:
            hits = _keep_by_text(nodes, hits, run)
        elif shapes.clauses:
            hits = hits.where(F.col("step").isNull() | _clauses_hold(F.col("step.clauses"), _hit()))
        if shapes.positions:
            # Positions are counted among the hits of one parent, from one start.
            direction = F.when(F.col("step.axis") == "earlier", -F.col("hit.node_id")).otherwise(F.col("hit.node_id"))
            group = Window.partitionBy(*keys, "seg", "node_id", "hit.parent_id")
            hits = (
                hits.withColumn("place", F.row_number().over(group.orderBy(direction)))
                .withColumn("size", F.count("*").over(group))
                .where(_in_position(F.col("step.pos"), F.col("place"), F.col("size")))
                .where(F.col("step").isNull() | _clauses_hold(F.col("step.late"), _hit(place=F.col("place"), size=F.col("size"))))
                .drop("place", "size")
            )
        # A node reached twice in one segment counts once; order is by segment start, then by page.
        order = Window.partitionBy(*keys).orderBy("seg", "hit.node_id")
        placed = (
            hits.withColumn("twin", F.lag("hit.node_id").over(order)).withColumn("twin_seg", F.lag("seg").over(order))
            .where(~((F.col("twin") == F.col("hit.node_id")) & (F.col("twin_seg") == F.col("seg"))) | F.col("twin").isNull())
            .withColumn("ord", (F.row_number().over(order) - 1).cast("bigint"))
        )
        if shapes.picks:
            whole = Window.partitionBy(*keys)
            counted = placed.withColumn("n", F.count("*").over(whole).cast("int"))
            placed = counted.withColumn("ord", F.explode(_output_spots(F.col("ord"), F.col("n"), F.col("step.pick"))))
        current = placed.select(*keys, "ord", "seg", "steps", "hit.node_id", *[F.col(f"hit.{c}").alias(c) for c in NODE_COLUMNS])
    return current.select(*keys, "node_id", "ord", *NODE_COLUMNS)


def _output_spots(ord_: Column, n: Column, spec: Column) -> Column:
    """Where item ``ord_`` of a list of ``n`` goes under a position spec: nowhere, once, or repeatedly."""
    plain = F.array(ord_)
    chosen = picked_positions(n, spec)
    spots = F.filter(
        F.transform(chosen, lambda p, i: F.when(p == ord_, i.cast("bigint"))), lambda i: i.isNotNull()
    )
    return F.when(spec.isNull() | ~is_index_spec(spec), plain).otherwise(spots)


def in_one_list(hits: DataFrame, run: list[str]) -> DataFrame:
    """Alternatives of one selection (columns alt, alts, pick) as one list: in page order, each node once, then the positions."""
    keys = ["page_id", *run]
    several = F.col("alts") > 1
    order = Window.partitionBy(*keys).orderBy(F.when(several, F.col("node_id")), "alt", "ord")
    twin = F.lag("node_id").over(order)
    once = hits.withColumn("twin", twin).where(~several | F.col("twin").isNull() | (F.col("twin") != F.col("node_id")))
    placed = once.withColumn("ord", F.when(several, (F.row_number().over(order) - 1).cast("bigint")).otherwise(F.col("ord")))
    n = F.count("*").over(Window.partitionBy(*keys)).cast("int")
    spots = _output_spots(F.col("ord"), F.col("n"), F.col("pick"))
    return placed.withColumn("n", n).withColumn("ord", F.explode(spots)).drop("n", "twin", "alt", "alts", "pick")


# --- selectors from literal texts ----------------------------------------------------------------
def _steps_column(steps: list[dict]) -> Column:
    import json

    return F.from_json(F.lit(json.dumps(steps)), f"array<{rulesyntax.STEP}>")


def _terms_of(steps: list[dict]) -> list[str]:
    return sorted({
        "#" + s["id"] if s["id"] else "." + s["classes"][0] if s["classes"] else s["tag"] or "*" for s in steps
    })


def select_steps(nodes: DataFrame, ctx: DataFrame, steps: list[dict]) -> DataFrame:
    """``ctx``: page_id, ctx_id, node_id, ord → hits of the same shape."""
    terms = F.broadcast(nodes.sparkSession.createDataFrame([(t,) for t in _terms_of(steps)], "term string"))
    runs = with_nodes(nodes, ctx.select("page_id", "ctx_id", "node_id", "ord")).withColumn("steps", _steps_column(steps))
    shapes = StepShapes.of_steps(steps)
    return run_steps(flagged(nodes, steps, shapes), runs, ["ctx_id"], terms, shapes)


def select_any(nodes: DataFrame, ctx: DataFrame, alternatives: list[list[dict]], pick: str | None = None) -> DataFrame:
    """Hits of several selections as one list."""
    if len(alternatives) == 1 and pick is None:
        return select_steps(nodes, ctx, alternatives[0])
    every = [s for steps in alternatives for s in steps]
    terms = F.broadcast(nodes.sparkSession.createDataFrame([(t,) for t in _terms_of(every)], "term string"))
    shapes = StepShapes.of_steps(every)
    shapes.longest = max(map(len, alternatives))
    given = [F.struct(F.lit(k).alias("alt"), _steps_column(steps).alias("steps")) for k, steps in enumerate(alternatives)]
    starts = with_nodes(nodes, ctx.select("page_id", "ctx_id", "node_id", "ord")).withColumn("way", F.explode(F.array(*given)))
    runs = starts.withColumns({"alt": F.col("way.alt"), "steps": F.col("way.steps")}).drop("way")
    hits = run_steps(flagged(nodes, every, shapes), runs, ["ctx_id", "alt"], terms, shapes)
    several = hits.withColumns({"alts": F.lit(max(2, len(alternatives))), "pick": F.lit(pick).cast("string")})
    return in_one_list(several, ["ctx_id"])


def select_children(nodes: DataFrame, ctx: DataFrame) -> DataFrame:
    return select_steps(nodes, ctx, [rulesyntax.step("child", start=True)])


def select_descendants(nodes: DataFrame, ctx: DataFrame, by: str, name: str) -> DataFrame:
    """By tag, id or class; several class names must all be there."""
    return select_steps(nodes, ctx, [rulesyntax.default_step(f"{by}.{name}") | {"pick": None}])


def select_by_text(nodes: DataFrame, ctx: DataFrame, text: str) -> DataFrame:
    """Elements whose own text holds ``text``; where there is none, elements whose whole text does."""
    return select_steps(nodes, ctx, [rulesyntax.step(start=True, own=text)])


def select_css(nodes: DataFrame, ctx: DataFrame, css: str) -> DataFrame:
    return select_any(nodes, ctx, rulesyntax.css_alternatives(css))


def select_xpath(nodes: DataFrame, ctx: DataFrame, expr: str) -> DataFrame:
    found, _, pick = rulesyntax.xpath_alternatives(expr)
    return select_any(nodes, ctx, found, pick)


def pick_hits(hits: DataFrame, spec: str) -> DataFrame:
    """Position spec over the hits of each context."""
    group = Window.partitionBy("page_id", "ctx_id")
    numbered = hits.withColumn("i", (F.row_number().over(group.orderBy("ord")) - 1).cast("bigint")).withColumn(
        "n", F.count("*").over(group).cast("int")
    )
    return numbered.withColumn("ord", F.explode(_output_spots(F.col("i"), F.col("n"), F.lit(spec)))).drop("i", "n")


# --- values ---------------------------------------------------------------------------------------
TEXT_KINDS = ("text", "textNodes", "xtextNodes")
OWN_KINDS = ("ownText", "xownText")
HTML_KINDS = ("html", "outerHtml", "all")


def value_lists(hits: DataFrame, texts: DataFrame | None, owns: DataFrame | None, pages: DataFrame | None) -> DataFrame:
    """``hits`` (NODE_COLUMNS and ``extract``) with ``values``: one value per node, or one per text node.

    ``texts`` (page_id, page_text), ``owns`` (page_id, node_id, own_text) and ``pages`` (page_id,
    html) serve the text, own-text and markup kinds; leave out what no rule asks for.
    """
    kind = F.col("extract")
    rows = hits
    none = F.lit(None).cast("string")
    below = markup = own = none
    if owns is not None:
        rows, own = rows.join(owns, ["page_id", "node_id"]), F.col("own_text")
    if texts is not None:
        rows = rows.join(texts, "page_id")
        below = _between(F.col("page_text"), F.col("text_start"), F.col("text_end"))
    if pages is not None:
        rows = rows.join(pages.select("page_id", "html"), "page_id")
        inner = _between(F.col("html"), F.col("inner_start"), F.col("inner_end"))
        markup = F.when(kind == "html", inner).otherwise(_between(F.col("html"), F.col("outer_start"), F.col("outer_end")))

    def joined(text: Column) -> Column:
        return F.array(web_trim(F.replace(text, F.lit(NUL), F.lit(""))))

    def single(text: Column) -> Column:
        return F.filter(F.transform(F.split(text, NUL), web_trim), lambda v: v != "")

    attr = F.coalesce(F.try_element_at("attrs", F.lower(kind)), F.lit(""))
    values = (
        F.when(kind == "text", joined(below)).when(kind == "ownText", joined(own))
        .when(kind.isin("textNodes", "xtextNodes"), single(below)).when(kind == "xownText", single(own))
        .when(kind.isin(*HTML_KINDS), F.array(web_trim(markup))).otherwise(F.array(web_trim(attr)))
    )
    return rows.withColumn("values", values).drop("page_text", "own_text", "html")


def extract_value(nodes: DataFrame, hits: DataFrame, kind: str, pages: DataFrame | None = None) -> DataFrame:
    """``hits`` of a selector → page_id, ctx_id, values ARRAY<STRING> in result order."""
    if "text_start" not in hits.columns:
        hits = with_nodes(nodes, hits)
    texts = page_texts(nodes) if kind in TEXT_KINDS else None
    owns = own_texts(nodes) if kind in OWN_KINDS else None
    rows = value_lists(hits.withColumn("extract", F.lit(kind)), texts, owns, pages if kind in HTML_KINDS else None)
    ordered = F.array_sort(F.collect_list(F.struct("ord", "values")))
    return rows.groupBy("page_id", "ctx_id").agg(F.flatten(F.transform(ordered, lambda v: v["values"])).alias("values"))
