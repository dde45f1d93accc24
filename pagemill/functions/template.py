"""Templates and variables inside rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TEMPLATE = re.compile(r"\{\{([\s\S]*?)\}\}|(?<!\$)\{(\$[^{}]*)\}")


def template_expand(template: str, parts: dict[str, Column]) -> Column:
    """``{{rule}}`` and ``{$.path}`` replaced by the columns given for them, the rest literal."""
    pieces, last = [], 0
    for m in _TEMPLATE.finditer(template):
        pieces.append(F.lit(template[last : m.start()]))
        pieces.append(F.coalesce(parts[(m[1] or m[2]).strip()].cast("string"), F.lit("")))
        last = m.end()
    return F.concat(*pieces, F.lit(template[last:]))


def put_vars(current: Column | None, puts: dict[str, Column]) -> Column:
    """Variables after some writes: the last write of a name wins."""
    written = F.create_map(*[x for k, v in puts.items() for x in (F.lit(k), v)])
    if current is None:
        return written
    fresh = F.map_filter(current, lambda k, _: ~k.isin(*puts))
    return F.map_concat(fresh, written)


def get_var(name: str, *scopes: Column) -> Column:
    """A variable read from the nearest scope that has it, '' when none does."""
    return F.coalesce(*[F.try_element_at(m, F.lit(name)) for m in scopes], F.lit(""))
