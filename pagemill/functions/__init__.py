"""Column functions: every one takes and returns Spark columns and stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` computed once per row.

    A column used several times is otherwise copied into the plan each time, and copies of copies
    grow without end.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
