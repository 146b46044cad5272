from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    """Column name or Column -> Column."""
    return F.col(c) if isinstance(c, str) else c


def lit_or_col(v) -> Column:
    """Python value -> literal, Column -> itself."""
    return v if isinstance(v, Column) else F.lit(v)


def round6(c) -> Column:
    """Round a double to 6 decimals, the precision all reports are compared at."""
    return F.round(as_col(c).cast("double"), 6)
