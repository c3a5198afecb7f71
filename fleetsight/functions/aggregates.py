"""Aggregate-expression helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIRECTION = re.compile(r"\b(asc|desc|nulls)\b", re.IGNORECASE)


def ordered_list(value: str, order_by: str | list[str], sep: str = ", ",
                 distinct: bool = False) -> Column:
    """Ordered string aggregation (``listagg ... WITHIN GROUP (ORDER BY ...)``).

    ``value`` and ``order_by`` are SQL expressions; NULL values are skipped
    and an empty group gives NULL. Plain ascending orders are built as a
    sorted ``collect_list`` of (order keys, value) structs, which hashes
    instead of sorting the whole group; DISTINCT or DESC orders use
    ``listagg``. Only use it on groups whose size is bounded by the data
    model (the columns of one index, the devices of one backup set, the few
    categories of one plan): the list is built in one buffer per group.
    """
    orders = list(order_by) if isinstance(order_by, (list, tuple)) else [order_by]
    if distinct and orders == [value]:
        # distinct values in their own order: a hashed set, sorted once
        vals = F.array_sort(F.collect_set(F.expr(value).cast("string")))
        return F.when(F.size(vals) > 0, F.array_join(vals, sep))
    if not distinct and not any(_DIRECTION.search(o) for o in orders):
        fields = [F.expr(o).alias(f"o{i}") for i, o in enumerate(orders)]
        fields.append(F.expr(value).cast("string").alias("v"))
        arr = F.array_sort(F.collect_list(F.struct(*fields)))
        vals = F.transform(F.filter(arr, lambda x: x["v"].isNotNull()), lambda x: x["v"])
        return F.when(F.size(vals) > 0, F.array_join(vals, sep))
    sep_sql = sep.replace("'", "''")
    dist = "DISTINCT " if distinct else ""
    return F.expr(f"listagg({dist}{value}, '{sep_sql}') WITHIN GROUP (ORDER BY {', '.join(orders)})")


def exact_mean(c) -> Column:
    """Mean as (exact sum) / count, returned as DOUBLE; NULL for an empty
    group (no division by zero under ANSI mode). With decimal or integer
    input the sum is exact, so the mean does not depend on task order."""
    col = F.col(c) if isinstance(c, str) else c
    return F.sum(col).cast("double") / F.nullif(F.count(col), F.lit(0))
