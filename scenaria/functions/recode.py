"""Value recoding with an explicit map (``recode(x, a = b)``): unmapped values are kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def recode(c: str | Column, mapping: dict) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    if not mapping:
        return c
    expr = None
    for k, v in mapping.items():
        expr = F.when(c == F.lit(k), F.lit(v)) if expr is None else expr.when(c == F.lit(k), F.lit(v))
    return expr.otherwise(c)
