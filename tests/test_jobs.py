"""Jobs against step-by-step folds and tree walks on small random inputs."""

import random

from pyspark.sql import functions as F

from pagemill import hooks
from pagemill.functions import rulesyntax
from pagemill.operators import library, merge, nodes, quality, registry, select, skew, throttle, toc
from pagemill.plans import books, rulesets
from pagemill.session import BATCH_BYTES, BATCH_ROWS
from pagemill.sources import backup, rules
from pagemill.streaming import jobs
from pagemill.streaming.state import VersionedTable

BOOK = (
    "source_id string, source_name string, ok boolean, ord bigint, name string, author string, kind string, last_chapter string, "
    "intro string, cover_url string, cover_proxy_url string, book_url string"
)


def greedy(rows):
    """The merge one book at a time."""
    def key(s):
        return "".join(s.split()).lower()

    entries = []
    for r in sorted((r for r in rows if r[2]), key=lambda r: r[3]):
        name, author = key(r[4]), key(r[5])
        if not name:
            continue
        hit = next((e for e in entries if e["name"] == name and (not e["author"] or not author or e["author"] == author)), None)
        if hit is None:
            hit = {"name": name, "author": author, "n": 0, "kind": "", "cover": ("", "")}
            entries.append(hit)
        elif not hit["author"]:
            hit["author"] = author
        hit["n"] += 1
        hit["kind"] = hit["kind"] or r[6]
        if not hit["cover"][0] and r[9]:
            hit["cover"] = (r[9], r[10])
    return sorted((e["name"], e["author"], e["n"], e["kind"], *e["cover"]) for e in entries)


def test_merge_equals_the_greedy_walk(spark):
    rng = random.Random(7)
    rows = [
        (f"s{i % 9}", "", rng.random() > 0.1, i, rng.choice(["A b", "a B", "ab", "C", " "]), rng.choice(["", "", "X", "x ", "Y", "Z"]),
         rng.choice(["", "k1", "k2"]), "", "", rng.choice(["", "c1", "c2"]), rng.choice(["", "p"]), f"u{i}")
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, BOOK)
    for part in ([rows[:1], rows[:7], rows]):
        got = merge.merge_books(df.where(F.col("ord") < len(part))).collect()
        have = sorted((r["name_key"], r["entry_author"], r["source_count"], r["kind"], r["cover_url"], r["cover_proxy_url"]) for r in got)
        assert have == greedy(part)


def test_merge_sorts_only_the_books_that_lead(spark, monkeypatch):
    """Texts are aggregated over a few books of a title and author, whatever their number; joined either way."""
    rng = random.Random(8)
    rows = [
        (f"s{i % 9}", "", True, i, rng.choice(["A b", "a B", "C"]), rng.choice(["", "X", "x ", "Y"]), rng.choice(["", "k1", "k2"]), rng.choice(["", "l"]),
         rng.choice(["", "i"]), rng.choice(["", "c1", "c2"]), rng.choice(["", "p"]), f"u{i}")
        for i in range(5000)
    ]
    # A book that comes twice is two sources; one without an order leads only where all are.
    rows += [rows[0], ("s0", "", True, None, "C", "Y", "late", "", "", "", "", "u"), ("s0", "", True, None, "D", "", "", "", "", "", "", "u")]
    df = spark.createDataFrame(rows, BOOK)
    aggregated, partial = [], merge._partial
    monkeypatch.setattr(merge, "_partial", lambda leading: (aggregated.append(leading.count()), partial(leading))[1])
    found = []
    for limit in (merge.FIRSTS_LIMIT_BYTES, 0):
        monkeypatch.setattr(merge, "FIRSTS_LIMIT_BYTES", limit)
        found.append(sorted(merge.merge_books(df).collect(), key=lambda r: (r["name_key"], r["entry_author"])))
    assert found[0] == found[1] and max(aggregated) <= 7 * 6
    have = sorted((r["name_key"], r["entry_author"], r["source_count"], r["kind"], r["cover_url"], r["cover_proxy_url"]) for r in found[0] if r["name_key"] != "d")
    counted = greedy([r if r[3] is not None else (*r[:3], 9999, *r[4:]) for r in rows if r[4] != "D"])
    assert have == counted
    assert [(r["source_count"], r["first_ord"], r["name"]) for r in found[0] if r["name_key"] == "d"] == [(1, None, None)]


def test_match_chapter(spark):
    chapters = spark.createDataFrame([("k", 0, "第 1 章"), ("k", 1, "第2章"), ("k", 2, "第2 章")], "key string, idx bigint, name string")
    wanted = spark.createDataFrame([("k", "第1章", 9), ("k", "第 2章", 0), ("k", "x", 2), ("k", "", 7), ("none", "y", 0)], "key string, name string, idx int")
    got = sorted((r["key"], r["index"], r["how"]) for r in merge.match_chapter(chapters, wanted).collect())
    assert got == [("k", -1, "none"), ("k", 0, "name"), ("k", 1, "name"), ("k", 2, "index"), ("none", -1, "none")]


def step_by_step(attempts):
    state, out = {}, {}
    for user, ts, seq, ok in sorted(attempts, key=lambda a: (a[1], a[2])):
        count, first = state.get(user, (0, 0))
        count, first, out[(user, seq)] = throttle.decide(count, first, ts, ok)
        state[user] = (count, first)
    return out


def attempts_for(seed, n=1500):
    rng, ts, out = random.Random(seed), 1_700_000_000_000, []
    for i in range(n):
        ts += rng.choice([1, 1000, 1000, 30_000, 30_000, 60_000, 200_000] * 5 + [15 * 60_000, 15 * 60_000 + 1, 3_600_000])
        out.append((rng.choice(["hot", "hot", "hot", "b", "c"]), ts, i, rng.random() < 0.07))
    return out


def test_throttle_equals_the_fold(spark):
    rows = attempts_for(3)
    df = spark.createDataFrame(rows, "username string, ts bigint, seq bigint, ok boolean").repartition(5)
    got = {(r["username"], r["seq"]): r["decision"] for r in throttle.login_throttle(df).collect()}
    want = step_by_step(rows)
    assert got == want and "blocked" in want.values()
    assert throttle.bursts(df).where("username = 'hot'").select("burst").distinct().count() > 5


def test_positions_with_a_hot_key(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", i * 37 % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, at int, id int")
    got = {(r["id"]): r["pos"] for r in skew.positions(df, ["k"], F.floor(F.col("at") / 100), [F.col("at"), F.col("id")]).collect()}
    for key in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        assert [got[r[2]] for r in ordered] == list(range(len(ordered)))


def test_source_health_equals_the_fold(spark):
    rng, rows, state = random.Random(5), [], {}
    for i in range(800):
        source, outcome = f"s{rng.randrange(12)}", rng.choice(["ok", "fail", "fail", "idle"])
        rows.append((source, 1000 + i // 3, i, outcome))
        ok_at, streak = state.get(source, (0, 0))
        if outcome != "idle":
            state[source] = (1000 + i // 3, 0) if outcome == "ok" else (ok_at, streak + 1)
    df = spark.createDataFrame(rows, "source_id string, ts bigint, seq bigint, outcome string")
    assert {r["source_id"]: (r["last_ok_at"], r["fail_streak"]) for r in registry.source_health(df).collect()} == state


def test_page_chain(spark):
    links = [("a0", "a1"), ("a1", "a2"), ("a2", "a1"), ("s", "s"), ("m", "gone"), ("e", None)] + [(f"l{i}", f"l{i + 1}") for i in range(40)]
    df = spark.createDataFrame(links, "url string, next_url string")
    seeds = spark.createDataFrame([(u, u) for u in ("a0", "s", "m", "e", "l0", "l35", "absent")], "seed string, url string")
    chains = {}
    for r in toc.page_chain(df, seeds, 20).collect():
        chains.setdefault(r["seed"], {})[r["page_no"]] = r["url"]
    assert chains["a0"] == {0: "a0", 1: "a1", 2: "a2"} and chains["s"] == {0: "s"} and chains["m"] == {0: "m"} and chains["e"] == {0: "e"}
    assert chains["l0"] == {i: f"l{i}" for i in range(20)} and chains["l35"] == {i: f"l{35 + i}" for i in range(5)}
    assert "absent" not in chains
    assert toc.page_chain(df, seeds.where("seed = 'l0'"), 10).count() == 10


# --- selectors against a walk over the same nodes -------------------------------------------------
PAGE = """<html><body><div class="a b" id="x"><p>one<p class="b">two <b>bold</b><ul><li>1<li class=b>2<li>3</ul></div>
<div class="a"><a href="/1">next page</a><a href="/2" class="b c">two</a><span>next</span><div class="b"><a href="/3">3</a></div></div>
<table><tr><td>1<td>2<tr><td>3</table></body></html>"""


def hits(spark, pick, kind="text"):
    pages = spark.createDataFrame([(1, PAGE)], "page_id bigint, html string")
    table = nodes.html_nodes(pages)
    rows = select.extract_value(table, pick(table, nodes.root_context(pages)), kind, pages).collect()
    return rows[0]["values"] if rows else []


def test_selectors(spark):
    css = lambda q, kind="text": hits(spark, lambda n, c: select.select_css(n, c, q), kind)
    xpath = lambda q, kind="text": hits(spark, lambda n, c: select.select_xpath(n, c, q), kind)
    assert css("li") == ["1", "2", "3"] and css("ul > li.b") == ["2"] and css("div.a.b p") == ["one", "two bold"]
    assert css("td") == ["1", "2", "3"] and css("tr td:first-child") == ["1", "3"] and css("li:last-child") == ["3"]
    assert css("div div a", "href") == ["/3"] and css("div a", "href") == ["/1", "/2", "/3"]
    assert css("a[href$='2']", "href") == ["/2"] and css("a[class~=c]") == ["two"] and css("a:contains(next)") == ["next page"]
    assert css("a + a", "href") == ["/2"] and css("a ~ span") == ["next"] and css("#x p.b", "html") == ["two <b>bold</b>"]
    assert xpath("//li[2]") == ["2"] and xpath("//div[@class='a']/a[last()]", "href") == ["/2"]
    assert xpath("//td[1]") == ["1", "3"] and xpath("//a[contains(@href,'1')]/..", "class") == ["a"]
    assert xpath("//a[starts-with(@href,'/')]/following-sibling::a", "href") == ["/2"] and xpath("//span/preceding-sibling::a[1]", "href") == ["/2"]
    assert hits(spark, lambda n, c: select.select_by_text(n, c, "next")) == ["next page", "next"]
    assert hits(spark, lambda n, c: select.select_descendants(n, c, "class", "b a"), "id") == ["x"]
    assert hits(spark, lambda n, c: select.select_css(n, c, "p.b"), "ownText") == ["two"]
    assert hits(spark, lambda n, c: select.select_css(n, c, "p.b"), "textNodes") == ["two", "bold"]
    assert hits(spark, lambda n, c: select.pick_hits(select.select_css(n, c, "li"), "-1:0")) == ["3", "2", "1"]


def test_nested_starts_repeat_as_lists_do(spark):
    both = rulesyntax.default_plan("tag.div@tag.a", listing=True)[0]
    got = hits(spark, lambda n, c: select.select_steps(n, c, both), "href")
    assert got == ["/1", "/2", "/3", "/3"]  # the inner div is a start of its own


def test_rule_parts():
    read = rulesyntax.parse_rule
    assert [s["pick"] for s in read("class.odd.0@tag.a.-1@href")["parts"][0]["steps"]] == ["0", "-1"]
    assert read("tag.tr!0:-1@text")["parts"][0]["steps"][0]["pick"] == "!0:-1"
    assert read("class.a!b@text")["parts"][0]["steps"][0]["classes"] == ["a!b"]
    assert read("a@text||b@text")["joiner"] == "||" and read("-tag.li")["parts"][0]["reverse"] is True
    assert read("text.下一页@href")["parts"][0]["steps"][0]["own"] == "下一页"
    assert read("##(\\d+)##$1###")["parts"][0]["dialect"] == "source"
    assert read("$.a.b")["parts"][0]["dialect"] == "json" and read("//a/@href")["parts"][0]["extract"] == "href"
    assert "hook" in read("<js>x</js>")["error"] and "predicate" in read("//a[foo()]")["error"]


def test_json_sources(spark):
    body = '{"data":{"list":[{"title":"A","id":1,"who":"x"},{"title":"","id":2},{"title":"B","id":3}]}}'
    pages = spark.createDataFrame([(1, "j", "https://a.com/s/", body)], "page_id bigint, source_id string, url string, html string")
    fields = [("bookList", "$.data.list[*]"), ("name", "$.title"), ("author", "who"), ("bookUrl", "$.id##^##/b/")]
    table = spark.createDataFrame([("j", "ruleSearch", f, r) for f, r in fields], "source_id string, grp string, field string, rule string")
    got = books.extract_book_list(pages, table)[0].orderBy("item").collect()
    assert [(r["name"], r["author"], r["bookUrl"]) for r in got] == [("A", "x", "https://a.com/b/1"), ("B", "", "https://a.com/b/3")]


def test_broken_rules_are_named(spark):
    rows = [("s", "ruleSearch", "bookList", "tag.li"), ("s", "ruleSearch", "coverUrl", "//img["), ("t", "ruleSearch", "bookUrl", "//a[foo()]")]
    _, errors = rulesets.compile_rules(spark.createDataFrame(rows, "source_id string, grp string, field string, rule string"))
    assert sorted((r["source_id"], r["field"]) for r in errors.collect()) == [("s", "coverUrl"), ("t", "bookUrl")]


# --- state ------------------------------------------------------------------------------------------
def test_import_keeps_name_group_and_switch(spark):
    text = '[{"bookSourceName":"new","bookSourceUrl":"https://a.com","enabled":false},{"bookSourceName":"twice","bookSourceUrl":"https://a.com"}, 5]'
    records = rules.rule_records(spark.createDataFrame([(text,)], "text string"))
    accepted, rejected = rules.validate_rules(records)
    target = spark.createDataFrame(
        [("user:https://a.com", "old", "https://a.com", "g", True, 3, "{}", 1, 1)],
        "id string, name string, url string, group_name string, enabled boolean, sort_order int, payload string, created_at bigint, updated_at bigint",
    )
    merged, counts, repeats = rules.import_rules(target, accepted, 99)
    row = merged.first()
    assert (row["name"], row["group_name"], row["enabled"], row["created_at"], row["updated_at"]) == ("old", "g", True, 1, 99)
    assert "new" in row["payload"] and counts.collect()[0]["count"] == 1
    assert [r["name"] for r in repeats.collect()] == ["twice"] and rejected.first()["reason"] == "not an object"


def test_backup_parts_stay_within_caps(spark, monkeypatch):
    monkeypatch.setitem(backup.CAPS, "shelf", 4)
    shelf = spark.createDataFrame(
        [("u", f"s\nb{i}", "s", f"b{i}", f"n{i}", "", "", i, i) for i in range(1, 11)],
        "owner string, book_key string, source_id string, book_url string, name string, author string, cover_url string, created_at bigint, updated_at bigint",
    )
    progress = spark.createDataFrame([], jobs.PROGRESS)
    place = "chapter_name string, chapter_index int, page_index int, percent double, excerpt string"
    book = "owner string, id string, source_id string, book_url string"
    stamps = "created_at bigint, updated_at bigint, book_key string"
    marks = spark.createDataFrame([], f"{book}, chapter_url string, {place}, note string, {stamps}")
    notes = spark.createDataFrame([], f"{book}, {place}, text string, {stamps}")
    docs = backup.export_backup(shelf, progress, marks, notes, 1)
    assert sorted(r["part"] for r in docs.collect()) == [0, 1, 2]
    assert backup.validate_backup(docs.select(F.col("part").alias("doc_id"), "doc")).count() == 0
    state = {"shelf": shelf.where("created_at <= 3"), "progress": progress, "bookmarks": marks, "notes": notes}
    merged, counts = backup.import_backup(state, docs.withColumn("doc_id", F.col("part")), 5)
    assert merged["shelf"].count() == 10
    assert {(r["list"], r["status"]): r["count"] for r in counts.collect()} == {("shelf", "added"): 7, ("shelf", "kept"): 3}


def test_streams_in_several_batches(spark, tmp_path):
    rows = attempts_for(11, 400)
    schema = "username string, ts bigint, seq bigint, ok boolean"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(4):
        spark.createDataFrame(rows[k * 100 : (k + 1) * 100], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    running = jobs.stream_login_throttle(stream).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", str(tmp_path / "c1")
    ).trigger(availableNow=True).start()
    running.awaitTermination()
    got = {(r["username"], r["seq"]): r["decision"] for r in spark.read.parquet(out).collect()}
    assert got == step_by_step(rows)
    outcomes = stream.select(
        F.col("username").alias("source_id"), "ts", "seq", F.when(F.col("ok"), "ok").otherwise("fail").alias("outcome")
    )
    path = str(tmp_path / "health")
    jobs.stream_source_health(outcomes, path, str(tmp_path / "c2")).awaitTermination()
    batch = spark.createDataFrame(rows, schema).select(
        F.col("username").alias("source_id"), "ts", "seq", F.when(F.col("ok"), "ok").otherwise("fail").alias("outcome")
    )
    assert sorted(VersionedTable(spark, path, jobs.HEALTH).read().collect()) == sorted(registry.source_health(batch).collect())


def test_versioned_write_and_sync(spark):
    stored = spark.createDataFrame([("a", "old", 50), ("b", "old", 200)], "owner string, doc string, updated_at bigint")
    asked = spark.createDataFrame([("a", "new", 50), ("b", "new", 1), ("c", "new", 0)], "owner string, doc string, base bigint")
    state, outcomes = library.versioned_write(stored, asked, 40)
    assert {r["owner"]: (r["doc"], r["updated_at"]) for r in state.collect()} == {"a": ("new", 51), "b": ("old", 200), "c": ("new", 40)}
    assert {r["owner"]: r["outcome"] for r in outcomes.collect()} == {"a": "saved", "b": "conflict", "c": "saved"}


def test_hooks(spark):
    hooks.register_hook("twice", lambda v: v + v)
    df = spark.createDataFrame([(["a"], "twice"), (["b"], None)], "values array<string>, hook string")
    assert sorted(r["values"] for r in hooks.apply_hooks(df).collect()) == [["a", "a"], ["b"]]


def test_rule_field_cases(spark):
    rows = [("s", "ruleToc", "a", "@put:{bid:tag.a@href, 'n':$.x}"), ("s", "ruleContent", "b", "x@get:{bid}java.get('n')"), ("s", "ruleToc", "c", "@get:{lost}")]
    df = spark.createDataFrame(rows, "source_id string, grp string, field string, rule string")
    assert sorted((r["key"], r["written_in"], r["read_in"]) for r in quality.cross_group_keys(df).collect()) == [
        ("bid", "ruleToc", "ruleContent"), ("n", "ruleToc", "ruleContent"),
    ]
    lost = quality.var_lineage(df).where("NOT has_put").collect()
    assert [r["key"] for r in lost] == ["lost"]


def test_rounds_carry_numbers_of_rules(spark, monkeypatch):
    """What is the same in all runs of a rule does not go through the rounds; rules told apart stay apart."""
    html = '<ul><li><a href="/1">one 1</a> <b>x</b></li><li><a href="/2">two 2</a></li></ul>'
    pages = spark.createDataFrame([(p, s, "https://x.example.com/", html) for p, s in ((1, "s"), (2, "s"), (3, "t"))], "page_id bigint, source_id string, url string, html string")
    texts = [
        ("s", "bookList", "tag.li"), ("s", "name", "tag.a@text"), ("s", "name", "tag.a@text"), ("s", "author", r"tag.a@text##\s*\d"), ("s", "kind", "tag.b@text&&tag.a@href"),
        ("s", "intro", "tag.none@text||tag.a@text"), ("t", "bookList", "tag.li"), ("t", "name", "-tag.a@text##o##0"), ("t", "kind", "tag.b@text"),
    ]
    rule_fields = spark.createDataFrame([(s, "ruleSearch", f, r) for s, f, r in texts], "source_id string, grp string, field string, rule string")
    carried, run_steps = [], select.run_steps
    monkeypatch.setattr(select, "run_steps", lambda nodes, runs, run, *more: (carried.append(set(run)), run_steps(nodes, runs, run, *more))[1])
    found, _ = books.extract_book_list(pages, rule_fields)
    got = sorted(tuple(r[c] for c in ("page_id", "source_id", "item", "name", "author", "kind", "intro", "bookUrl")) for r in found.collect())
    at = "https://x.example.com"
    of_s = [("s", 0, "one 1", "one", "x\n/1", "one 1", f"{at}/1"), ("s", 1, "two 2", "two", "/2", "two 2", f"{at}/2")]
    of_t = [("t", 0, "0ne 1", "", "x", "", f"{at}/1"), ("t", 1, "tw0 2", "", "", "", f"{at}/2")]
    assert got == [(1, *r) for r in of_s] + [(2, *r) for r in of_s] + [(3, *r) for r in of_t]
    assert carried[-1] <= {"item", "rule", "alt", "alts", "pick"}


def test_pages_reach_python_in_short_batches(spark):
    """However long a split and its pages are, a worker holds a bounded piece of them."""
    pages = spark.range(0, 3000, 1, 1).select(F.col("id").alias("page_id"), F.concat(F.lit("<p>"), F.repeat(F.lit("long "), 4000)).alias("html"))
    nodes.html_nodes(pages)

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "bytes": [batch.nbytes]})

    most = pages.mapInArrow(sizes, "n bigint, bytes bigint").agg(F.max("n").alias("n"), F.max("bytes").alias("bytes")).first()
    assert most["n"] <= BATCH_ROWS and most["bytes"] <= 2 * BATCH_BYTES
