"""What the operators on vectors share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(column: str) -> Column:
    """True for a vector with components, none null or non-finite, not all zero."""
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce((F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0), F.lit(False))
