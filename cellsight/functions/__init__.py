"""Column and name functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(c) -> Column:
    """A Column as it is, a string as the column of that name, anything else as a literal."""
    return c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else F.lit(c)
