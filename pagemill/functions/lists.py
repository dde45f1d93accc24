"""Columns over ordered value lists (ARRAY<STRING>): positions, combiners, joining."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import let

INT = r"^\s*-?\d+\s*$"


def _as_column(spec: Column | str) -> Column:
    return F.lit(spec) if isinstance(spec, str) else spec


def _strings(c: Column) -> Column:
    """NULL lists count as empty ones."""
    return F.coalesce(c, F.array().cast("array<string>"))


def _number(c: Column) -> Column:
    return F.when(c.rlike(INT), web_int(c))


def web_int(c: Column) -> Column:
    return F.trim(c).try_cast("int")


def _from_end(i: Column, n: Column) -> Column:
    return F.when(i < 0, n + i).otherwise(i)


def is_index_spec(spec: Column | str) -> Column:
    """Whether a position expression selects anything: at least one number in it."""
    s = F.trim(_as_column(spec))
    return (
        F.when(s.startswith("!"), s.rlike(r"^!(?:.*[:,])?\s*-?\d+\s*(?:[:,]|$)"))
        .otherwise(s.contains(":") | s.rlike(r"(?:^|,)\s*-?\d+\s*(?:,|$)"))
    )


def picked_positions(n: Column, spec: Column | str) -> Column:
    """Zero-based positions of a list of length ``n`` chosen by ``spec``, in output order.

    ``1`` one item, ``-1`` from the end, ``1:5:2`` an inclusive range with step, ``-1:0`` a range
    that runs backwards, ``1,3`` a list, ``!0,2`` or ``!0:2`` everything but these. A spec without a
    number keeps every item.
    """
    return let(n, lambda size: let(F.trim(_as_column(spec)), lambda s: _positions(size, s)))


def _positions(n: Column, s: Column) -> Column:
    every = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(
        F.array().cast("array<int>")
    )
    dropped = F.transform(
        F.filter(F.split(F.substr(s, F.lit(2)), "[:,]"), lambda x: x.rlike(INT)),
        lambda x: _from_end(web_int(x), n),
    )

    def one_range(part: Column) -> Column:
        bits = F.split(part, ":")
        ends = F.struct(
            F.coalesce(_from_end(_number(F.get(bits, F.lit(0))), n), F.lit(0)).alias("start"),
            F.coalesce(_from_end(_number(F.get(bits, F.lit(1))), n), n - 1).alias("stop"),
            _number(F.get(bits, F.lit(2))).alias("step"),
        )

        def within(r: Column) -> Column:
            start, stop = r["start"], r["stop"]
            step = F.coalesce(r["step"], F.when(start <= stop, F.lit(1)).otherwise(F.lit(-1)))
            # First position inside the list that the range reaches, and where it ends.
            size = F.abs(step)
            up = F.when(start >= 0, start).otherwise(F.pmod(start, size))
            down = F.when(start < n, start).otherwise(n - 1 - F.pmod(n - 1 - start, size))
            high, low = F.least(stop, n - 1), F.greatest(stop, F.lit(0))
            return (
                F.when((step > 0) & (up <= high), F.sequence(up.cast("int"), high, step))
                .when((step < 0) & (down >= low), F.sequence(down.cast("int"), low, step))
                .otherwise(F.array().cast("array<int>"))
            )

        return let(ends, within)

    def one_part(part: Column) -> Column:
        one = let(
            _from_end(_number(part), n),
            lambda at: F.when((at >= 0) & (at < n), F.array(at)).otherwise(F.array().cast("array<int>")),
        )
        return F.when(part.contains(":"), one_range(part)).otherwise(one)

    picked = F.flatten(F.transform(F.split(s, ","), one_part))
    return (
        F.when(~is_index_spec(s) | s.isNull(), every)
        .when(s.startswith("!"), F.filter(every, lambda i: ~F.array_contains(dropped, i)))
        .otherwise(picked)
    )


def pick_index(values: Column, spec: Column | str) -> Column:
    """Items of a list at the positions of ``spec``."""
    return let(
        _strings(values),
        lambda items: F.transform(picked_positions(F.size(items), spec), lambda i: F.get(items, i)),
    )


def reverse_list(values: Column) -> Column:
    return F.reverse(_strings(values))


def combine_concat(*lists: Column) -> Column:
    """``&&``: all values of all parts, one part after the other."""
    return F.concat(*[_strings(c) for c in lists])


def combine_first(*lists: Column) -> Column:
    """``||``: the first part that has values; later parts are not evaluated."""
    out = F.array().cast("array<string>")
    for c in reversed(lists):
        out = F.when(F.size(_strings(c)) > 0, c).otherwise(out)
    return out


def combine_interleave(*lists: Column) -> Column:
    """``%%``: first values of all parts, then second values, and so on; gaps are skipped."""
    names = [f"p{i}" for i in range(len(lists))]
    zipped = F.arrays_zip(*[_strings(c).alias(n) for c, n in zip(lists, names)])
    rows = F.transform(zipped, lambda z: F.array(*[z[n] for n in names]))
    return F.filter(F.flatten(rows), lambda v: v.isNotNull())


def value_join(values: Column) -> Column:
    """One field value: the non-blank values joined by line feeds."""
    return F.array_join(F.filter(_strings(values), lambda v: v != ""), "\n")


def group_labels(c: Column) -> Column:
    """A multi-label group text split at ASCII, full-width and enumeration commas."""
    from .text import web_trim

    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[,，、]"), web_trim)
    return F.filter(parts, lambda x: x != "")


def primary_group(c: Column) -> Column:
    return F.coalesce(F.get(group_labels(c), F.lit(0)), F.lit(""))
