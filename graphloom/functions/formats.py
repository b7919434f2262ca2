"""Number formats of result files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exponent(value: Column) -> Column:
    """A double with the fewest digits that give it back, and an exponent: 3 is ``3E+00`` and 0.25 is ``2.5E-01``."""
    tries = [F.format_string(f"%.{n}E", value) for n in range(17)]
    return F.when(value.isNull(), None).otherwise(F.coalesce(*[F.when(t.cast("double") == value, t) for t in tries], tries[-1]))
