"""Secret scans: fixed patterns, and a battery of randomness tests for other tokens.

All of it is native expressions. A long token whose characters look like draws from the whole of its
encoding's alphabet is a secret: a chi-squared test of uniform use, a runs test of values above and below
the middle, and a serial-correlation test of neighbours must all fail to reject that. Words pass such
tests by chance, the more easily the shorter they are. So the bound on the combined p-value is set for each
encoding and length class where the estimated share of words among the accepted tokens is small enough; where
the high p-values give no sign of random tokens, none is accepted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kind, pattern, fewest characters of the group that counts. Fixed values.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{16,}", 0, 16),
)
KINDS = ("assign", "access", "hex", "random")
# Shortest token the tests look at, and the characters tokens consist of.
LEAST_CHARS = 20
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
ALPHABETS = {
    "dec": "0123456789",
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
# Accepted share of false discoveries, and bins of p-values in which they are estimated.
FALSE_SHARE = 0.05
BINS = 20
# Standard errors that count as chance, and the smallest bound.
CHANCE = 1.64
LEAST_BOUND = 0.01


def located(text: Column, pattern: str) -> Column:
    """Array of (start, end, match): leftmost non-overlapping matches with places in code points.

    The pieces between the matches give the places.
    """
    # A lambda over a one-element array names the two lists once.
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def spans(pair: Column) -> Column:
        begin = F.struct(
            F.lit(0).cast("bigint").alias("at"), F.expr("CAST(array() AS array<struct<start: bigint, end: bigint, match: string>>)").alias("out")
        )

        def step(state: Column, i: Column) -> Column:
            match = F.get(pair["found"], i)
            start = state["at"] + F.length(F.get(pair["gaps"], i))
            end = start + F.length(match)
            one = F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), match.alias("match"))
            return F.struct(end.cast("bigint").alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(pair["found"]) - 1), begin, step, lambda s: s["out"])

    some = F.struct(found.alias("found"), gaps.alias("gaps"))
    none = F.expr("CAST(array() AS array<struct<start: bigint, end: bigint, match: string>>)")
    return F.when(text.rlike(pattern), F.get(F.transform(F.array(some), spans), F.lit(0))).otherwise(none)


def _normal_tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution; Zelen and Severo's polynomial, within 1e-7."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.least(F.lit(1.0), 2 * F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly)


def _upper_tail(z: Column) -> Column:
    half = _normal_tail(z) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def inferred_encoding(token: Column) -> Column:
    """The smallest alphabet that has all characters; padding and URL-safe signs are base64's."""
    return (
        F.when(token.rlike("^[0-9]+$"), "dec")
        .when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(token.rlike("^[A-Z2-7]+=*$"), "base32")
        .otherwise("base64")
    )


def with_p_value(tokens: DataFrame) -> DataFrame:
    """Add ``encoding``, ``n_chars`` and ``p_value``: three times the smallest of the three tests', at most 1.

    ``tokens`` has a ``token`` column. A test without enough different values says nothing (p is 1).
    """
    size, alphabet = F.lit(None), F.lit(None)
    for name, letters in ALPHABETS.items():
        size = F.when(F.col("encoding") == name, F.lit(float(len(letters)))).otherwise(size)
        alphabet = F.when(F.col("encoding") == name, letters).otherwise(alphabet)
    plain = F.rtrim(F.translate("token", "-_", "+/"), F.lit("="))
    kept = tokens.columns
    df = tokens.withColumn("encoding", inferred_encoding(F.col("token")))
    df = df.withColumn("_plain", F.when(F.col("encoding") == "hex", F.lower("token")).otherwise(plain))
    df = df.withColumn("_alphabet", alphabet).withColumn("_size", size).withColumn("n_chars", F.length("_plain"))
    n, k = F.col("n_chars").cast("double"), F.col("_size")
    values = F.transform(F.split("_plain", ""), lambda c: F.instr(F.col("_alphabet"), c).cast("double") - 1)
    df = df.withColumn("_values", F.filter(values, lambda v: v >= 0))
    counts = F.transform(F.split("_alphabet", ""), lambda c: (n - F.length(F.replace(F.col("_plain"), c, F.lit("")))).cast("double"))
    squares = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * c)
    chi = k * squares / n - n
    free = k - 1
    cube = (F.pow(F.greatest(chi, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    df = df.withColumn("_uniform", _upper_tail(cube))
    high = F.aggregate("_values", F.lit(0.0), lambda s, v: s + (v >= k / 2).cast("double"))
    steps = F.sequence(F.lit(1), F.size("_values") - 1)

    def value(i: Column) -> Column:
        return F.get("_values", i)

    changes = F.aggregate(steps, F.lit(0.0), lambda s, i: s + ((value(i) >= k / 2) != (value(i - 1) >= k / 2)).cast("double"))
    middle = (k - 1) / 2
    along = F.aggregate(steps, F.lit(0.0), lambda s, i: s + (value(i) - middle) * (value(i - 1) - middle))
    power = F.aggregate("_values", F.lit(0.0), lambda s, v: s + (v - middle) * (v - middle))
    df = df.withColumn("_high", high).withColumn("_runs", changes + 1).withColumn("_serial", along).withColumn("_power", power)
    expected = 2 * F.col("_high") * (n - F.col("_high")) / n + 1
    spread = (expected - 1) * (expected - 2) / (n - 1)
    runs = F.when(spread > 0, _normal_tail((F.col("_runs") - expected) / F.sqrt(spread))).otherwise(F.lit(0.0))
    serial = F.when(F.col("_power") > 0, _normal_tail(F.col("_serial") / F.col("_power") * F.sqrt(n))).otherwise(F.lit(0.0))
    p = F.least(F.lit(1.0), 3 * F.least(F.col("_uniform"), runs, serial))
    return df.select(*kept, "encoding", "n_chars", p.alias("p_value"))


def length_class(n: Column) -> Column:
    """Lengths within a factor of about 1.4 make one class."""
    return F.floor(2 * F.log2(n)).cast("int")


def bounds(tested: DataFrame) -> DataFrame:
    """(encoding, class, bound): the smallest p-value accepted in each encoding and length class.

    Random tokens spread evenly over all p-values; those of words crowd near 0 and thin out above. So the
    highest quarter estimates how many random ones there are, if the quarter below it holds no more than
    chance allows. A bound up to one half is accepted if the tokens above it that this estimate does not
    explain are a FALSE_SHARE of all there, within the estimate's own error. A class without such a bound, or
    without any token in the highest quarter, is left out: nothing of it is accepted. The table has one row
    an encoding and class at most, however many tokens there are.
    """
    binned = tested.select("encoding", length_class(F.col("n_chars")).alias("class"), F.least(F.floor(F.col("p_value") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
    counted = binned.groupBy("encoding", "class", "bin").agg(F.count("*").alias("n"))

    def between(low: int, high: int) -> Column:
        return F.sum(F.when((F.col("bin") >= low) & (F.col("bin") < high), F.col("n")).otherwise(0))

    grouped = counted.groupBy("encoding", "class").agg(
        between(BINS * 3 // 4, BINS).alias("top"), between(BINS // 2, BINS * 3 // 4).alias("middle"), F.collect_list(F.struct("bin", "n")).alias("bins")
    )
    flat = F.col("middle") - F.col("top") <= CHANCE * F.sqrt(F.col("middle") + F.col("top"))

    def above(b: Column) -> Column:
        return F.aggregate("bins", F.lit(0).cast("bigint"), lambda s, x: s + F.when(x["bin"] >= b, x["n"]).otherwise(0))

    def unexplained(b: Column) -> Column:
        part = (BINS - b) / BINS
        return above(b) - 4 * F.col("top") * part - CHANCE * 4 * F.sqrt(F.col("top")) * part

    good = F.filter(F.sequence(F.lit(0), F.lit(BINS // 2)), lambda b: (above(b) > 0) & (unexplained(b) <= FALSE_SHARE * above(b)))
    found = grouped.where(flat & (F.col("top") > 0)).withColumn("good", good).where(F.size("good") > 0)
    # A bound of 0 would accept what the tests reject outright.
    return found.select("encoding", "class", F.greatest(F.array_min("good").cast("double") / BINS, F.lit(LEAST_BOUND)).alias("bound"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): every secret of each whole text as (start, place of its kind, end, kind), in order.

    One row for each row of ``docs``; null and empty texts have no spans. Tokens without a digit or mixed
    case are words, and those that overlap a fixed pattern's span add none. Only ``doc_id`` and ``text``
    are read, so other columns may have any names; repeated rows give the same spans each.
    """
    from ..session import stored

    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(*[_base_spans(text, number, *rule) for number, rule in enumerate(BASE)])
    tokens = F.filter(located(text, TOKEN), lambda s: s["match"].rlike("[0-9]|[a-z].*[A-Z].*[a-z].*[A-Z]"))
    found = stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", base.alias("base"), tokens.alias("tokens")), "secret-spans")
    tested = with_p_value(found.select("row", "base", F.explode("tokens").alias("one")).withColumn("token", F.col("one.match")))
    tested = stored(tested, "secret-tests").withColumn("class", length_class(F.col("n_chars")))
    free = ~F.exists("base", lambda b: (b["start"] < F.col("one.end")) & (F.col("one.start") < b["end"]))
    # One row an encoding and length class.
    accepted = tested.join(F.broadcast(bounds(tested)), ["encoding", "class"]).where(free & (F.col("p_value") >= F.col("bound")))
    more = accepted.groupBy("row").agg(F.collect_list(_span(F.col("one.start"), len(BASE), F.col("one.end"))).alias("more"))
    none = F.expr("CAST(array() AS array<struct<start: bigint, place: int, end: bigint, kind: string>>)")
    return found.join(more, "row", "left").select("doc_id", F.array_sort(F.concat("base", F.coalesce("more", none))).alias("spans"))


def _span(start: Column, place: int, end: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(place).alias("place"), end.alias("end"), F.lit(KINDS[place]).alias("kind"))


def _base_spans(text: Column, place: int, kind: str, pattern: str, group: int, least: int) -> Column:
    spans = located(text, pattern)
    if group:
        spans = F.filter(spans, lambda s: F.length(F.regexp_extract(s["match"], pattern, group)) >= least)
    return F.transform(spans, lambda s: _span(s["start"], place, s["end"]))


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
