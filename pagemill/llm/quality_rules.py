"""Quality rules: a threshold table compiled into projections of native expressions.

Everything is read from the words and lines of a whole text in place; no row is exploded and nothing is
shuffled. Steps that several later ones read are columns of their own, so each is computed once.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # per cent of the words

# Frequent words of the languages that the rules know. Fixed values.
STOP_WORDS = (
    "the of and to in is that for it with as was on be this by are or from at "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "le la les de des et du un une que est pour dans qui sur par plus pas avec au "
    "el los las y en del se por con una su para es al lo como más o pero sus"
).split()


class Rule(NamedTuple):
    """A measure must lie between two bounds; None is no bound."""

    measure: str
    low: float | None
    high: float | None


RULES = (
    Rule("mean_word_length", 1.5, 20.0),
    Rule("symbols_per_word", None, 0.2),
    Rule("stop_word_share", 0.02, None),
    Rule("dup_line_share", None, 0.5),
)

_BLANK = " \t\n\x0b\f\r"
_NO_NUMBERS = "CAST(array() AS array<bigint>)"


def _measures() -> dict[str, Column]:
    """Ratios the table may bound, over the counts of a text; none divides by zero."""
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "mean_word_length": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "stop_word_share": (F.col("n_stop_words") + 1) / words,  # one more, so that short texts may have none
        "dup_line_share": F.col("n_dup_lines") / lines,
    }


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """One condition: every measure within its bounds."""
    measures, verdict = _measures(), F.lit(True)
    for rule in rules:
        value = measures[rule.measure]
        if rule.low is not None:
            verdict = verdict & (value >= rule.low)
        if rule.high is not None:
            verdict = verdict & (value <= rule.high)
    return verdict


def _repeated_words(df: DataFrame) -> DataFrame:
    """Add ``n_repeat_words``: words in windows found twice or more in the text.

    Windows are sorted by one number each, hash above and place below. Neighbours with one hash are only
    candidates: their words are compared before they count.
    """
    keep = df.columns
    n = F.col("n_words")
    df = df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    df = df.withColumn("_unit", F.expr("shiftleft(1L, length(bin(n_words)))"))
    high = -F.col("_unit")

    def packed(i: Column) -> Column:
        return F.xxhash64(*[F.get("_hashes", i + k) for k in range(WINDOW)]).bitwiseAND(high) + i

    windows = F.transform(F.sequence(F.lit(0).cast("bigint"), n - WINDOW), packed)
    df = df.withColumn("_sorted", F.sort_array(F.when(n >= WINDOW, windows).otherwise(F.expr(_NO_NUMBERS))))
    last = F.size("_sorted") - 1

    def alike(i: Column, j: Column) -> Column:
        return F.get("_sorted", i).bitwiseAND(high) == F.get("_sorted", j).bitwiseAND(high)

    def suspect(x: Column, i: Column) -> Column:
        return ((i > 0) & alike(i, i - 1)) | ((i < last) & alike(i, i + 1))

    df = df.withColumn("_suspects", F.transform(F.filter("_sorted", suspect), lambda x: x.bitwiseAND(F.col("_unit") - 1)))

    def spelled(place: Column) -> Column:
        text = F.array_join(F.slice("_words", place.cast("int") + 1, F.lit(WINDOW)), " ")
        return F.struct(text.alias("text"), place.alias("place"))

    df = df.withColumn("_spelled", F.sort_array(F.transform("_suspects", spelled)))
    end = F.size("_spelled") - 1

    def same(i: Column, j: Column) -> Column:
        return F.get("_spelled", i)["text"] == F.get("_spelled", j)["text"]

    repeated = F.filter("_spelled", lambda x, i: ((i > 0) & same(i, i - 1)) | ((i < end) & same(i, i + 1)))
    df = df.withColumn("_places", F.sort_array(F.transform(repeated, lambda x: x["place"])))
    # A window adds its words from the end of the one before on.
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("stop"))
    covered = F.aggregate(
        "_places",
        start,
        lambda s, p: F.struct((s["n"] + p + WINDOW - F.greatest(p, s["stop"])).alias("n"), (p + WINDOW).alias("stop")),
        lambda s: s["n"],
    )
    return df.select(*keep, covered.alias("n_repeat_words"))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of every whole text, ``base_failed`` and ``kept``; one row for each row of ``docs``.

    Null and empty texts have no words and fail. Only ``doc_id`` and ``text`` are read, so other columns
    may have any names; repeated rows are judged each.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike("[^ \\t-\\r]"))
    df = docs.select(
        "doc_id",
        F.array_remove(F.split(text, "[ \\t-\\r]+", -1), "").alias("_words"),
        lines.alias("_lines"),
        F.length(F.translate(text, _BLANK, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
    )
    df = df.select(
        "*",
        F.size("_words").cast("bigint").alias("n_words"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.filter("_words", lambda w: w.isin(*STOP_WORDS))).cast("bigint").alias("n_stop_words"),
    ).drop("_lines")
    df = _repeated_words(df)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words",
        failed.alias("base_failed"), (~failed & compile_rules(rules)).alias("kept"),
    )
