"""User functions as rule steps: the counterpart of per-source scripts.

A hook takes the list of values a rule found and returns a list. It runs as an Arrow-batched
function, only on rows of sources whose rules name it. In a rule it follows the selection and its
cleaning as ``@js:name``; a cleaning chain behind the name works on what the hook returns.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

Hook = Callable[[list[str]], list[str] | str | None]

HOOKS: dict[str, Hook] = {}


def _call(fn: Hook, values) -> list[str]:
    out = fn([] if values is None else list(values))
    return [] if out is None else [out] if isinstance(out, str) else list(out)


def register_hook(name: str, fn: Hook) -> Callable[[Column], Column]:
    """Register ``fn`` under a name rules can use (``selector@js:name``); a scalar result is one value."""
    HOOKS[name] = fn

    @F.pandas_udf(ArrayType(StringType()))
    def hook(values: pd.Series) -> pd.Series:
        return values.map(lambda v: _call(fn, v))

    return hook


def apply_hooks(df: DataFrame, values: str = "values", hook: str = "hook") -> DataFrame:
    """Rows with ``values`` replaced by what the hook named in the row makes of them.

    Rows without a hook pass by without Python; the others go through one function that calls the hook each
    row names. An unknown name is an error.
    """
    known = dict(HOOKS)

    @F.pandas_udf(ArrayType(StringType()))
    def named(given: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([_call(known[n], v) for v, n in zip(given, names, strict=True)], dtype="object")

    unknown = F.raise_error(F.concat(F.lit("no hook named "), F.col(hook))).cast(df.schema[values].dataType)
    is_known = F.col(hook).isin(*known) if known else F.lit(False)
    called = df.where(F.col(hook).isNotNull() & is_known).withColumn(values, named(F.col(values), F.col(hook)))
    rest = df.where(F.col(hook).isNotNull() & ~is_known).withColumn(values, unknown)
    return df.where(F.col(hook).isNull()).unionByName(called).unionByName(rest)
